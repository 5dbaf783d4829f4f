"""Set comprehensions: an operator over the set of distinct head values of a body, for each binding of the outer
variables that it shares."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lang.ast import Compre, Expr, Lit, Var
from ..types import INTEGER, PRIMITIVES, REAL, Type, one

VALUE = "~value"
#: Values that the cuts between ranges are drawn from, and ranges that a set's ordinals are worked out in.
SAMPLE, RANGES = 1024, 64
LIST = one("~List")


def values(body, env, e: Compre, shared: list[str], numeric: bool) -> tuple[DataFrame, Type]:
    """The distinct (shared, value) rows of the heads; of several types, as tagged structs; numbers only, if numeric."""
    from ..plans.compile import Env, col, divides

    outer = Env(env.df.select(*map(col, shared)).distinct(), {v: env.types[v] for v in shared}) if shared else None
    needed = set().union(*(_vars(h) for h in e.heads)) | set(shared)
    inner = body.compile(e.body, needed, outer)
    heads = [(h, body.value(body.plain(h), inner.types)) for h in e.heads]
    if numeric:
        real = any(t.leaves & {"Real", "Rational"} for _, (_, t) in heads)
        want = REAL if real else INTEGER
        heads = [(h, (v, t)) for h, (v, t) in heads if t.leaves & {"Integer", "Natural", "PosInteger", "NegInteger", "Real", "Rational"}]
    else:
        want = Type(frozenset().union(*(t.leaves for _, (_, t) in heads)))
    parts = []
    for h, (value, t) in heads:
        got, test = body.schema.cast(value, t, want)
        df = inner.df if test is None else inner.df.where(test)
        if divides(h):
            df = df.where(value.isNotNull())
        parts.append(df.select(*map(col, shared), got.alias(VALUE)))
    if not parts:
        parts = [inner.df.where(F.lit(False)).select(*map(col, shared), F.lit(None).cast("bigint").alias(VALUE))]
    return reduce(DataFrame.unionByName, parts).distinct(), want


def _vars(e: Expr) -> set[str]:
    from ..plans.analyze import expr_vars

    return expr_vars(e)


def aggregate(body, env, e: Compre, name: str) -> tuple[DataFrame, Type]:
    """The environment with the comprehension's value as `name`. Where the set is empty: 0 for count and sum, the
    default argument for the others, or no row if there is none."""
    from ..plans.compile import col

    df = env.df if env.df is not None else body.unit()
    env.df = df
    inside = set().union(*map(_vars, e.heads)) | _vars(Compre(e.op, (), e.heads, e.body))
    shared = sorted(inside & set(env.types))
    args = [body.plain(a) for a in e.args]
    if e.op == "toOrdinal":
        return _ordinal(body, env, e, args, shared, name)
    numeric = e.op in ("sum", "minAll", "maxAll")
    rows, t = values(body, env, e, shared, numeric)
    v = col(VALUE)
    if e.op in ("topK", "bottomK"):
        if not args or not isinstance(args[0], Lit):
            raise ValueError(f"{e.op} needs a number first")
        k, up = args[0].value, e.op == "bottomK"
        # the k best of each task, then of all: no group is gathered whole
        rank = Window.partitionBy(*map(col, shared)).orderBy(v.asc() if up else v.desc()) if shared else None
        best = rows.withColumn("~rank", F.row_number().over(rank)).where(F.col("`~rank`") <= k).drop("~rank") if rank is not None else rows.orderBy(v.asc() if up else v.desc()).limit(k)
        made = F.sort_array(F.collect_list(v), asc=up)
        default = F.array().cast(f"array<{body.schema.spark(t).simpleString()}>")
        kind = LIST
    else:
        best = rows
        made = {"count": F.count(v), "sum": F.sum(v), "minAll": F.min(v), "maxAll": F.max(v)}[e.op]
        kind = INTEGER if e.op == "count" else t
        default = F.lit(0) if e.op in ("count", "sum") else None
        if e.op == "count":
            made = F.count(F.lit(1))
        if args and e.op != "count":
            default = body.value(args[0], env.types)[0]
    if shared:
        grouped = best.groupBy(*map(col, shared)).agg(made.alias(name))
        out = df.join(grouped, shared, "left")
    else:
        out = df.crossJoin(best.agg(made.alias(name)))
    if default is None:
        return out.where(col(name).isNotNull()), kind
    return out.withColumn(name, F.coalesce(col(name), default)), kind


def _ordinal(body, env, e: Compre, args: list[Expr], shared: list[str], name: str) -> tuple[DataFrame, Type]:
    """toOrdinal(x, default, set): how many values of the set are less than x, or the default if x isn't in it."""
    from ..plans.compile import col

    rows, t = values(body, env, e, shared, False)
    x, have = body.value(args[0], env.types)
    got, test = body.schema.cast(x, have, t)
    if shared:
        order = Window.partitionBy(*map(col, shared)).orderBy(col(VALUE))
        ranked = rows.withColumn(name, (F.row_number().over(order) - 1).cast("bigint"))
    else:
        ranked = _ranked(rows, name, t)
    ranked = ranked.withColumnRenamed(VALUE, "~key")
    keyed = env.df.withColumn("~key", got if test is None else F.when(test, got))
    default = body.value(args[1], env.types)[0] if len(args) > 1 else None
    out = keyed.join(ranked, [*shared, "~key"], "left").drop("~key")
    if default is None:
        return out.where(col(name).isNotNull()), INTEGER
    return out.withColumn(name, F.coalesce(col(name), default)), INTEGER


def _ranked(rows: DataFrame, name: str, t: Type) -> DataFrame:
    """Ranks, from 0, of all values of one set. Cuts from a fixed sample deal the values over ranges, each ranked by a task
    of its own; a range's first rank is the sum of the sizes before it."""
    v = col_of(VALUE)
    cuts = []
    if t.plain in PRIMITIVES:
        sample = sorted(r[0] for r in rows.orderBy(F.xxhash64(v), v).limit(SAMPLE).collect())
        cuts = sample[:: SAMPLE // RANGES][1:] if len(sample) == SAMPLE else []
    if not cuts:  # few values, or terms of several types
        return rows.withColumn(name, (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(v)) - 1).cast("bigint"))
    dealt = rows.withColumn("~range", F.aggregate(F.array(*map(F.lit, cuts)), F.lit(0), lambda n, c: n + (v >= c).cast("int")))
    sizes = dealt.groupBy("`~range`").agg(F.count("*").alias("~n"))  # RANGES rows at most
    starts = sizes.select("`~range`", (F.sum("`~n`").over(Window.orderBy("`~range`")) - F.col("`~n`")).alias("~start"))
    ranked = dealt.withColumn("~own", F.row_number().over(Window.partitionBy("`~range`").orderBy(v)) - 1).join(F.broadcast(starts), "~range")
    return ranked.select(v, (F.col("`~start`") + F.col("`~own`")).cast("bigint").alias(name))


def col_of(name: str):
    return F.col(f"`{name}`")


__all__ = ["aggregate", "values", "VALUE", "Var"]
