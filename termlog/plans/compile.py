"""Rule bodies to DataFrames. An environment is a DataFrame whose columns are the variables bound so far."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, replace as changed

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lang.ast import Binary, Compare, Compre, Constraint, Expr, HasType, Lit, NoSet, Param, Pred, Term, Unary, Var
from ..operators.aggregate import aggregate
from ..types import BOOLEAN, INTEGER, PRIMITIVES, REAL, STRING, Schema, Type, TypeError_, one
from .analyze import AnalysisError, constraint_vars, expr_vars, variable_split

#: (relation or union, number of the positive scan in its body, or None for one under `no` or in a comprehension)
Source = Callable[[str, int | None], DataFrame]
UNIT, WHOLE = "~unit", "~whole"


@dataclass
class Env:
    df: DataFrame | None
    types: dict[str, Type]


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def all_of(tests: list[Column | None]) -> Column | None:
    out = None
    for t in tests:
        if t is not None:
            out = t if out is None else out & t
    return out


def where(df: DataFrame, tests: list[Column | None]) -> DataFrame:
    test = all_of(tests)
    return df if test is None else df.where(test)


class Body:
    """Compiles one body. `needed`: variables that its user reads; others may be dropped as soon as possible."""

    def __init__(self, spark: SparkSession, schema: Schema, source: Source, params: dict[str, Lit] | None = None, first: int | None = None):
        self.spark, self.schema, self.source, self.params, self.first = spark, schema, source, params or {}, first
        self.fresh = 0

    # preparation
    def name(self) -> str:
        self.fresh += 1
        return f"~{self.fresh}"

    def plain(self, e: Expr) -> Expr:
        """Parameters become their values, and names of constants terms."""
        if isinstance(e, Param):
            if e.name not in self.params:
                raise AnalysisError(f"no value for {e}")
            return self.params[e.name]
        if isinstance(e, Var):
            whole = str(e)
            return Term(whole) if whole in self.schema.constants or whole in self.schema.composites and not self.schema.composites[whole].fields else e
        if isinstance(e, Term):
            return Term(e.name, tuple(map(self.plain, e.args)))
        if isinstance(e, Unary):
            return Unary(e.op, self.plain(e.of))
        if isinstance(e, Binary):
            return Binary(e.op, self.plain(e.left), self.plain(e.right))
        if isinstance(e, Compre):
            return Compre(e.op, tuple(map(self.plain, e.args)), tuple(map(self.plain, e.heads)), e.body)
        return e

    def lift(self, e: Expr, out: list[Constraint], pattern: bool) -> Expr:
        """Comprehensions - and within patterns all that isn't one - become variables of their own."""
        if isinstance(e, Compre) or pattern and (isinstance(e, (Binary, Unary)) or isinstance(e, Var) and e.fragments):
            v = Var(self.name())
            out.append(Compare("=", v, e if isinstance(e, Compre) else self.lift(e, out, False)))
            return v
        if isinstance(e, Term):
            return Term(e.name, tuple(self.lift(a, out, pattern) for a in e.args))
        if isinstance(e, Unary):
            return Unary(e.op, self.lift(e.of, out, pattern))
        if isinstance(e, Binary):
            return Binary(e.op, self.lift(e.left, out, pattern), self.lift(e.right, out, pattern))
        return e

    def prepared(self, body: tuple[Constraint, ...]) -> list[Constraint]:
        out: list[Constraint] = []
        for c in body:
            extra: list[Constraint] = []
            if isinstance(c, Pred):
                out.append(changed(c, term=self.lift(self.plain(c.term), extra, True)))
            elif isinstance(c, Compare):
                left, right = self.plain(c.left), self.plain(c.right)
                if c.op == "=" and isinstance(left, Compre) and isinstance(right, Var):
                    left, right = right, left
                if not (c.op == "=" and isinstance(left, Var) and not left.fragments and isinstance(right, Compre)):
                    left, right = self.lift(left, extra, False), self.lift(right, extra, False)
                out.append(Compare(c.op, left, right))
            elif isinstance(c, NoSet):
                out.append(NoSet(self.plain(c.compre)))
            else:
                out.append(c)
            out += extra
        return out

    # types of variables
    def infer(self, body: list[Constraint], types: dict[str, Type]) -> None:
        def see(v: str, t: Type) -> None:
            if v in types:
                both = self.schema.meet(types[v], t)
                if both is None:
                    both = Type(frozenset(t.leaves))  # no value has both: the casts leave no row
                types[v] = both
            else:
                types[v] = Type(t.leaves)

        def walk(e: Expr, t: Type) -> None:
            if isinstance(e, Var) and e.root != "_" and not e.fragments:
                see(e.root, t)
            elif isinstance(e, Term) and e.name in self.schema.composites:
                self.arity(e)
                for a, (_, ft) in zip(e.args, self.schema.composites[e.name].fields, strict=True):
                    walk(a, ft)

        for c in body:
            if isinstance(c, Pred) and not c.negated:
                walk(c.term, one(c.term.name))
                if c.alias:
                    see(c.alias, one(c.term.name))
            elif isinstance(c, HasType) and c.scan and not c.negated and c.var.root != "_":
                see(c.var.root, self.schema.type_of(c.type))

    def arity(self, t: Term) -> None:
        c = self.schema.composites.get(t.name)
        n = len(c.fields) if c else 0
        if c is None and t.name not in self.schema.constants:
            raise TypeError_(f"{t.name} is not a constructor")
        if len(t.args) != n:
            raise TypeError_(f"{t.name} takes {n} arguments, not {len(t.args)}: {t}")

    # patterns
    def match(self, e: Expr, value: Column, have: Type, tests: list, binds: list) -> None:
        if isinstance(e, Var):
            if e.root != "_":
                binds.append((e.root, value, have))
        elif isinstance(e, Lit):
            leaf = BOOLEAN if isinstance(e.value, bool) else STRING if isinstance(e.value, str) else INTEGER if isinstance(e.value, int) else REAL
            if have.plain in ("Real", "Rational") and leaf is INTEGER:
                leaf = have
            got, test = self.schema.cast(value, have, leaf)
            tests += [test, got == F.lit(e.value)]
        elif isinstance(e, Term) and e.name in self.schema.composites:
            self.arity(e)
            if "~Text" in have.leaves and e.name not in have.leaves:
                got, test = self.schema.cast(value, have, one("~Text"))
                if not expr_vars(e) and not _wild(e):  # a ground term, told by its text
                    made, _ = self.value(e, {})
                    tests += [test, got == self.schema.text(made, one(e.name))]
                    return
                tests += [test, got.startswith(f"{e.name}(")]
                args = self.schema.arguments(got)
                for i, (a, (_, t)) in enumerate(zip(e.args, self.schema.composites[e.name].fields, strict=True)):
                    part, fits = self.schema.parsed(F.get(args, F.lit(i)), t)
                    tests.append(fits)
                    self.match(a, part, t, tests, binds)
                return
            got, test = self.schema.cast(value, have, one(e.name))
            tests.append(test)
            for a, (f, t) in zip(e.args, self.schema.composites[e.name].fields, strict=True):
                self.match(a, got.getField(f), t, tests, binds)
        elif isinstance(e, Term):
            self.arity(e)
            tests.append(value.getField("tag") == e.name if have.plain is None or have.plain in self.schema.constants else F.lit(False))
        else:
            raise AnalysisError(f"{e} can't be matched")

    def scan(self, c: Pred | HasType, number: int | None, types: dict[str, Type], keep: set[str]) -> Env:
        """The variables of a predicate that are kept, from its relation: literals and repeats are tested at the scan."""
        name = c.term.name if isinstance(c, Pred) else c.type
        df, tests, binds = self.source(name, number), [], []
        if isinstance(c, HasType) and name in self.schema.unions:
            if c.var.root != "_":
                binds.append((c.var.root, col(WHOLE), self.schema.unions[name]))
        else:
            fields = self.schema.composites[name].fields if name in self.schema.composites else ()
            if isinstance(c, Pred):
                self.arity(c.term)
                for a, (f, t) in zip(c.term.args, fields, strict=True):
                    self.match(a, col(f), t, tests, binds)
            alias = c.alias if isinstance(c, Pred) else c.var.root
            if alias and alias != "_" and alias in keep:
                whole = F.struct(*(col(f).alias(f) for f, _ in fields)) if fields else self.schema.constant(name)
                binds.append((alias, whole, one(name)))
        columns: dict[str, Column] = {}
        for v, value, have in binds:
            if v not in types:
                types[v] = Type(have.leaves)
            value, test = self.schema.cast(value, have, types[v])
            tests.append(test)
            if v in columns:
                tests.append(columns[v] == value)
            else:
                columns[v] = value
        kept = {v: x for v, x in columns.items() if v in keep}
        df = where(df, tests)
        if not kept:
            return Env(df.limit(1).select(F.lit(True).alias(UNIT)), {})
        return Env(df.select(*(x.alias(v) for v, x in kept.items())), {v: types[v] for v in kept})

    # expressions
    def value(self, e: Expr, types: dict[str, Type]) -> tuple[Column, Type]:
        if isinstance(e, Lit):
            t = BOOLEAN if isinstance(e.value, bool) else STRING if isinstance(e.value, str) else INTEGER if isinstance(e.value, int) else REAL
            return F.lit(e.value).cast(self.schema.spark(t)), t
        if isinstance(e, Var):
            if e.root not in types:
                raise AnalysisError(f"{e.root} is not bound")
            value, t = col(e.root), types[e.root]
            for f in e.fragments:
                owner = next((x for x in sorted(t.leaves) if x in self.schema.composites and f in dict(self.schema.composites[x].fields)), None)
                if owner is None:
                    raise TypeError_(f"{t} has no field {f}")
                value, _ = self.schema.cast(value, t, one(owner))
                value, t = value.getField(f), dict(self.schema.composites[owner].fields)[f]
            return value, Type(t.leaves)
        if isinstance(e, Term):
            self.arity(e)
            if e.name not in self.schema.composites or not e.args:
                return self.schema.constant(e.name), one(e.name)
            parts = []
            for a, (f, t) in zip(e.args, self.schema.composites[e.name].fields, strict=True):
                value, have = self.value(a, types)
                got, _ = self.schema.cast(value, have, t)
                parts.append(got.alias(f))
            return F.struct(*parts), one(e.name)
        if isinstance(e, Unary):
            value, t = self.value(e.of, types)
            if e.op == "!":
                if t.plain != "Boolean":
                    raise TypeError_(f"{e} needs a Boolean, not {t}")
                return ~value, t
            value = self.number(value, t, e)
            if e.op == "~" and t.leaves & {"Real", "Rational"}:
                raise TypeError_(f"{e} needs an Integer, not {t}")
            return (-value if e.op == "-" else F.bitwise_not(value)), t if t.plain in ("Real", "Rational") else INTEGER
        if isinstance(e, Binary):
            (a, ta), (b, tb) = self.value(e.left, types), self.value(e.right, types)
            a, b = self.number(a, ta, e), self.number(b, tb, e)
            real = any(t.plain in ("Real", "Rational") for t in (ta, tb))
            if e.op == "/":
                b = F.nullif(b, F.lit(0))  # no value, so no row: see defined()
                return (a / b if real else F.call_function("div", a, b)), REAL if real else INTEGER
            return {"+": a + b, "-": a - b, "*": a * b}[e.op], REAL if real else INTEGER
        raise AnalysisError(f"{e} has no value here")

    def number(self, value: Column, t: Type, e: Expr) -> Column:
        if t.plain in PRIMITIVES and t.plain not in ("String", "Boolean"):
            return value
        if "Integer" in t.leaves:
            return F.when(*reversed_pair(self.schema.cast(value, t, INTEGER)))
        raise TypeError_(f"{e} needs numbers, not {t}")

    def test(self, c: Compare, types: dict[str, Type]) -> Column:
        (a, ta), (b, tb) = self.value(c.left, types), self.value(c.right, types)
        if ta.plain == tb.plain and ta.plain in PRIMITIVES or {ta.plain, tb.plain} <= set(PRIMITIVES) - {"String", "Boolean"}:
            return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[c.op]
        both = self.schema.meet(ta, tb)
        if c.op in ("=", "!="):
            if both is None:
                return F.lit(c.op == "!=")
            (x, p), (y, q) = self.schema.cast(a, ta, both), self.schema.cast(b, tb, both)
            same = F.coalesce(all_of([p, q, x == y]), F.lit(False))
            return same if c.op == "=" else ~same
        for leaf in (INTEGER, STRING, REAL):
            if leaf.plain in ta.leaves and leaf.plain in tb.leaves:
                (x, p), (y, q) = self.schema.cast(a, ta, leaf), self.schema.cast(b, tb, leaf)
                return F.coalesce(all_of([p, q, {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[c.op]]), F.lit(False))
        raise TypeError_(f"{ta} and {tb} have no order: {c}")

    # bodies
    def compile(self, body: tuple[Constraint, ...], needed: set[str], outer: Env | None = None) -> Env:
        pending = self.prepared(body)
        numbers, n = {}, 0
        for i, c in enumerate(pending):
            if isinstance(c, (Pred, HasType)) and not c.negated and (isinstance(c, Pred) or c.scan):
                numbers[i], n = n, n + 1
        types = dict(outer.types) if outer else {}
        self.infer(pending, types)
        if outer:
            types |= outer.types
        env = Env(outer.df, dict(outer.types)) if outer else Env(None, {})
        uses = Counter(v for c in pending for v in constraint_vars(c))
        keep = needed | {v for v, k in uses.items() if k > 1} | (set(outer.types) if outer else set())
        left = list(enumerate(pending))
        while left:
            step = self.simple(left, env) or self.next_scan(left, env, numbers, types, keep) or self.next_set(left, env) or self.next_absence(left, env, types)
            if not step:
                raise AnalysisError(f"unbound variables in {', '.join(str(c) for _, c in left)}")
        return Env(env.df if env.df is not None else self.unit(), env.types)

    def unit(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(True).alias(UNIT))

    def extend(self, env: Env, name: str, value: Column, t: Type, partial: bool = False) -> None:
        env.df = (env.df if env.df is not None else self.unit()).withColumn(name, value)
        if partial:
            env.df = env.df.where(col(name).isNotNull())
        env.types[name] = Type(t.leaves)

    def simple(self, left: list, env: Env) -> bool:
        """One comparison, assignment, destructuring or type test whose variables are bound."""
        for at, (_, c) in enumerate(left):
            if isinstance(c, HasType) and not c.scan and c.var.root in env.types:
                value, t = self.value(c.var, env.types)
                _, test = self.schema.cast(value, t, self.schema.type_of(c.type))
                env.df = where(env.df, [test])
            elif isinstance(c, HasType) and c.scan and not c.negated and c.var.root in env.types and c.type in PRIMITIVES:
                value, t = self.value(c.var, env.types)
                env.df = where(env.df, [self.schema.cast(value, t, self.schema.type_of(c.type))[1]])
            elif isinstance(c, Compare) and not isinstance(c.right, Compre):
                a, b = expr_vars(c.left) <= set(env.types), expr_vars(c.right) <= set(env.types)
                if a and b and not _wild(c.left) and not _wild(c.right):
                    env.df = (env.df if env.df is not None else self.unit()).where(self.test(c, env.types))
                elif c.op == "=" and b and isinstance(c.left, Var) and not c.left.fragments:
                    self.extend(env, c.left.root, *self.value(c.right, env.types), divides(c.right))
                elif c.op == "=" and a and isinstance(c.right, Var) and not c.right.fragments:
                    self.extend(env, c.right.root, *self.value(c.left, env.types), divides(c.left))
                elif c.op == "=" and (b and isinstance(c.left, Term) or a and isinstance(c.right, Term)):
                    pattern, known = (c.left, c.right) if b and isinstance(c.left, Term) else (c.right, c.left)
                    self.destructure(env, pattern, known)
                else:
                    continue
            else:
                continue
            left.pop(at)
            return True
        return False

    def destructure(self, env: Env, pattern: Term, known: Expr) -> None:
        value, t = self.value(known, env.types)
        tests, binds = [], []
        self.match(pattern, value, t, tests, binds)
        if env.df is None:
            env.df = self.unit()
        env.df = where(env.df, tests)
        for v, x, have in binds:
            if v in env.types:
                got, test = self.schema.cast(x, have, env.types[v])
                env.df = where(env.df, [test, got == col(v)])
            else:
                self.extend(env, v, x, have)

    def next_scan(self, left: list, env: Env, numbers: dict, types: dict, keep: set[str]) -> bool:
        """The next scan: the changed one first, then one that shares variables, with literals before without; a cross
        product last."""
        scans = [(at, i, c) for at, (i, c) in enumerate(left) if i in numbers]
        if not scans:
            return False

        def rank(x):
            _, i, c = x
            own = constraint_vars(c)
            return (not (env.df is None and numbers[i] == self.first), env.df is not None and bool(env.types) and not own & set(env.types), -len(own & set(env.types)), -_literals(c), i)

        at, i, c = min(scans, key=rank)
        left.pop(at)
        found = self.scan(c, numbers[i], types, keep)
        if env.df is None:
            env.df, env.types = found.df, found.types
            return True
        # a variable that an assignment bound keeps its type: the scan's column is cast to it
        for v in set(found.types) & set(env.types):
            if found.types[v].leaves != env.types[v].leaves:
                value, test = self.schema.cast(col(v), found.types[v], env.types[v])
                found.df = where(found.df, [test]).withColumn(v, value)
        shared, _, new = variable_split(env.types, found.types)
        if shared:
            env.df = env.df.join(found.df, shared, "inner" if new else "left_semi")
        else:
            env.df = env.df.crossJoin(found.df.drop(UNIT) if new else found.df.select(F.lit(True).alias(self.name())))
        env.types |= {v: found.types[v] for v in new}
        return True

    def next_set(self, left: list, env: Env) -> bool:
        """A comprehension none of whose variables another pending constraint has still to bind."""
        waiting = [(at, c) for at, (_, c) in enumerate(left) if isinstance(c, Compare) and isinstance(c.right, Compre)]
        given = {c.left.root for _, c in waiting} - set(env.types)
        for at, c in waiting:
            if not (expr_vars(c.right) & given - {c.left.root}):
                left.pop(at)
                bound = c.left.root in env.types
                name = self.name() if bound else c.left.root
                env.df, t = aggregate(self, env, c.right, name)
                env.types[name] = t
                if bound:
                    env.df = env.df.where(self.test(Compare("=", Var(name), c.left), env.types))
                return True
        return False

    def next_absence(self, left: list, env: Env, types: dict) -> bool:
        for at, (_, c) in enumerate(left):
            if isinstance(c, NoSet):
                shared = sorted(expr_vars(c.compre) & set(env.types))
                outer = Env(env.df.select(*map(col, shared)).distinct(), {v: env.types[v] for v in shared}) if shared else None
                found = self.compile(c.compre.body, set(shared), outer)
            elif isinstance(c, (Pred, HasType)) and c.negated:
                shared = sorted(constraint_vars(c) & set(env.types))
                local = {v: env.types[v] for v in shared}
                found = self.scan(c, None, local, set(shared))
            else:
                continue
            left.pop(at)
            if shared:
                env.df = env.df.join(found.df.select(*map(col, shared)), shared, "left_anti")
            else:
                none = found.df.limit(1).agg(F.count("*").alias("~n")).where("`~n` = 0").select(F.lit(True).alias(self.name()))
                env.df = (env.df if env.df is not None else self.unit()).crossJoin(none)
            return True
        return False

    def head(self, env: Env, head: Term) -> DataFrame:
        head = self.plain(head)
        self.arity(head)
        if not head.args:
            return env.df.limit(1).select(F.lit(True).alias("present"))
        tests, columns = [], []
        for a, (f, t) in zip(head.args, self.schema.composites[head.name].fields, strict=True):
            value, have = self.value(a, env.types)
            got, test = self.schema.cast(value, have, t)
            tests += [test, value.isNotNull() if divides(a) else None]
            columns.append(got.alias(f))
        return where(env.df, tests).select(*columns)


def _wild(e: Expr) -> bool:
    return isinstance(e, Var) and e.root == "_" or isinstance(e, Term) and any(map(_wild, e.args))


def divides(e: Expr) -> bool:
    """Whether an expression may lack a value: a quotient by zero has none, so no row comes from it."""
    if isinstance(e, Binary):
        return e.op == "/" or divides(e.left) or divides(e.right)
    return divides(e.of) if isinstance(e, Unary) else isinstance(e, Term) and any(map(divides, e.args))


def _literals(c: Constraint) -> int:
    def count(e: Expr) -> int:
        return 1 if isinstance(e, Lit) else sum(map(count, e.args)) if isinstance(e, Term) else 0

    return count(c.term) if isinstance(c, Pred) else 0


def reversed_pair(x: tuple[Column, Column | None]) -> tuple[Column, Column]:
    value, test = x
    return (F.lit(True) if test is None else test), value
