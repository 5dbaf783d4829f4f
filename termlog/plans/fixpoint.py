"""Evaluation stratum by stratum; recursive strata by a semi-naive loop with one job or two for each round."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.ast import HasType, Lit, Pred, Rule
from ..types import Schema
from .analyze import Stratum, expr_vars, strata
from .compile import WHOLE, Body
from .store import Store


#: Parts of a relation beyond which they are written as one.
MOST_PARTS = 32


class DivergenceError(RuntimeError):
    pass


class Relations:
    """Relations by name; those that nothing fills are empty. Union types are views over their members."""

    def __init__(self, spark: SparkSession, schema: Schema, known: Mapping[str, DataFrame] | None = None):
        self.spark, self.schema, self.known = spark, schema, dict(known or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.known:
            return self.known[name]
        if name in self.schema.unions:
            return self.view(name, self.__getitem__)
        if name not in self.schema.composites and name not in self.schema.constants:
            raise KeyError(f"no relation {name}")
        return self.spark.createDataFrame([], self.schema.relation(name))

    def view(self, name: str, of) -> DataFrame:
        t, parts = self.schema.unions[name], []
        for leaf in sorted(t.leaves & (set(self.schema.composites) | self.schema.constants)):
            fields = self.schema.composites[leaf].fields if leaf in self.schema.composites else ()
            whole = F.struct(*(F.col(f"`{f}`").alias(f) for f, _ in fields)) if fields else None
            tagged = self.schema._tagged(whole if whole is not None else F.lit(None), leaf, t) if not (t.plain and fields) else whole
            parts.append(of(leaf).select(tagged.alias(WHOLE)))
        return reduce(DataFrame.unionByName, parts)


def run_rule(spark: SparkSession, schema: Schema, rule: Rule, source, params: dict[str, Lit], first: int | None = None, store: Store | None = None) -> list[tuple[str, DataFrame]]:
    body = Body(spark, schema, source, params, first)
    heads = rule.heads
    needed = set().union(*map(expr_vars, heads), set())
    env = body.compile(rule.body, needed)
    if store is not None and len(heads) > 1:
        env.df = store.save(env.df)  # the body runs once, whatever the number of heads
    return [(h.name, body.head(env, h)) for h in heads]


def evaluate(spark: SparkSession, schema: Schema, rules: list[Rule], base: Mapping[str, DataFrame], params: dict[str, Lit] | None = None, max_rounds: int = 1000, store: Store | None = None) -> Relations:
    """The least model over the base relations."""
    out = Relations(spark, schema, base)
    store = store or Store(spark)
    for stratum in strata(rules, members(schema)):
        run_stratum(out, stratum, params or {}, max_rounds, store)
    return out


def members(schema: Schema) -> dict[str, set[str]]:
    return {n: set(t.leaves) & (set(schema.composites) | schema.constants) for n, t in schema.unions.items()}


def run_stratum(out: Relations, stratum: Stratum, params: dict[str, Lit], max_rounds: int, store: Store) -> None:
    if stratum.parts:
        for part in stratum.parts:
            run_stratum(out, part, params, max_rounds, store)
            for name in part.relations & set(out.known):
                out.known[name] = store.save(out.known[name])  # later parts read it more than once
        return
    derived: dict[str, list[DataFrame]] = {}
    start = [r for r in stratum.rules if not stratum.recursive or not scans_of(r, stratum, out.schema)]
    for r in start:
        for name, df in run_rule(out.spark, out.schema, r, lambda n, _: out[n], params, store=store):
            derived.setdefault(name, []).append(df)
    if not stratum.recursive:
        for name, parts in derived.items():
            out.known[name] = reduce(DataFrame.unionByName, [*([out.known[name]] if name in out.known else []), *parts]).distinct()
        return
    first = {}
    for name in stratum.relations:
        parts = [*([out.known[name]] if name in out.known else []), *derived.get(name, [])]
        if parts:
            first[name] = reduce(DataFrame.unionByName, parts).distinct()
    loop(out, stratum, {}, first, params, max_rounds, store)


def scans_of(rule: Rule, stratum: Stratum, schema: Schema) -> list[int]:
    """Numbers of the positive scans that read a relation of the stratum."""
    of = members(schema)
    numbers, n = [], 0
    for c in rule.body:
        if isinstance(c, Pred) and not c.negated or isinstance(c, HasType) and c.scan and not c.negated:
            name = c.term.name if isinstance(c, Pred) else c.type
            if of.get(name, {name}) & stratum.relations:
                numbers.append(n)
            n += 1
    return numbers


def loop(out: Relations, stratum: Stratum, full: dict[str, list[str]], delta: dict[str, DataFrame], params: dict[str, Lit], max_rounds: int, store: Store, changed: frozenset[str] | None = None) -> dict[str, list[str]]:
    """Semi-naive rounds from `delta` on; full: paths of what each relation held before. Returns the paths of what was
    added. In each rule one scan at a time reads the last round's rows, those before it all rows, those after it the
    rows of the round before."""
    schemas = {n: out.schema.relation(n) for n in stratum.relations | set(delta)}
    full = {n: list(p) for n, p in full.items()}
    added: dict[str, list[str]] = {}
    recursive = [r for r in stratum.rules if scans_of(r, stratum, out.schema)]
    for k in range(max_rounds):
        now: dict[str, str] = {}
        for name, df in delta.items():
            if full.get(name):
                columns = df.columns
                known = store.read(schemas[name], *full[name])
                df = df.join(known, columns, "left_anti")
            path = store.write(df)
            if not store.read(schemas[name], path).isEmpty():
                now[name] = path
        before = {n: list(p) for n, p in full.items()}
        for name, path in now.items():
            full.setdefault(name, []).append(path)
            added.setdefault(name, []).append(path)
            if len(full[name]) > MOST_PARTS:  # long chains of small rounds are written as one part now and then
                full[name] = [store.write(store.read(schemas[name], *full[name]))]
        if not now:
            for name in stratum.relations:
                if full.get(name):
                    out.known[name] = store.read(schemas[name], *full[name])
            return added

        def read(name: str, paths: list[str] | None) -> DataFrame:
            if name in stratum.relations:
                return store.read(schemas[name], *paths) if paths else out.spark.createDataFrame([], schemas[name])
            return out[name]

        delta = {}
        made: dict[str, list[DataFrame]] = {}
        for r in recursive:
            own = scans_of(r, stratum, out.schema)
            for turn in own:

                def source(name: str, number: int | None, turn=turn) -> DataFrame:
                    state = full if number is None or number < turn else before if number > turn else {n: [p] for n, p in now.items()}
                    if name in out.schema.unions:
                        return out.view(name, lambda leaf: read(leaf, state.get(leaf)))
                    return read(name, state.get(name))

                names = _read_by(r, turn, out.schema)
                if not names & set(now):
                    continue
                for name, df in run_rule(out.spark, out.schema, r, source, params, turn, store):
                    made.setdefault(name, []).append(df)
        delta = {name: reduce(DataFrame.unionByName, parts).distinct() for name, parts in made.items()}
    raise DivergenceError(f"{', '.join(sorted(stratum.relations))} did not settle in {max_rounds} rounds")


def _read_by(rule: Rule, number: int, schema: Schema) -> set[str]:
    of, n = members(schema), 0
    for c in rule.body:
        if isinstance(c, Pred) and not c.negated or isinstance(c, HasType) and c.scan and not c.negated:
            name = c.term.name if isinstance(c, Pred) else c.type
            if n == number:
                return of.get(name, {name})
            n += 1
    return set()
