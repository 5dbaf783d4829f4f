"""Types of the language, their Spark representation, and casts between them.

A composite that doesn't contain itself is a struct; a union is a tagged struct with one nullable slot for each member
that has a value; a composite inside itself is known there by its canonical text, so that schemas stay finite.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lang.ast import CompositeDef, EnumDef, Expr, Lit, Term, TypeDef, TypeRef, UnionDef


class TypeError_(ValueError):
    """A program's type error."""


PRIMITIVES: dict[str, T.DataType] = {"Integer": T.LongType(), "Natural": T.LongType(), "PosInteger": T.LongType(), "NegInteger": T.LongType(), "String": T.StringType(), "Boolean": T.BooleanType(), "Real": T.DoubleType(), "Rational": T.DoubleType()}
#: The least and largest value of the integer types that have one.
BOUNDS = {"Natural": (0, None), "PosInteger": (1, None), "NegInteger": (None, -1)}


@dataclass(frozen=True)
class Type:
    """A set of leaves: primitives, composites and constants. One that isn't a constant is a plain column."""

    leaves: frozenset[str]
    allowed: tuple = field(default=(), compare=False)  # literal values or (lo, hi) ranges that an enumeration admits

    @property
    def plain(self) -> str | None:
        return next(iter(self.leaves)) if len(self.leaves) == 1 else None

    def __str__(self) -> str:
        return " + ".join(sorted(self.leaves))


def one(name: str) -> Type:
    return Type(frozenset([name]))


INTEGER, STRING, BOOLEAN, REAL, TEXT = one("Integer"), one("String"), one("Boolean"), one("Real"), one("~Text")


@dataclass(frozen=True)
class Composite:
    name: str
    fields: tuple[tuple[str, Type], ...]
    bijection: int = 0


class Schema:
    """Resolved types: composites, named unions and constants."""

    def __init__(self) -> None:
        self.composites: dict[str, Composite] = {}
        self.unions: dict[str, Type] = {}
        self.constants: set[str] = set()

    @staticmethod
    def resolve(defs: Iterable[TypeDef], constants: Iterable[str] = ()) -> Schema:
        s, by_name = Schema(), {}
        for d in defs:
            if d.name in by_name and by_name[d.name] != d:
                raise TypeError_(f"type {d.name} is defined twice")
            by_name[d.name] = d
        s.constants |= set(constants)

        def leaves(x, inside: tuple[str, ...]) -> tuple[set[str], list]:
            if isinstance(x, EnumDef):
                found = {"Boolean" if isinstance(v, bool) else "Integer" if isinstance(v, int) else "String" if isinstance(v, str) else "Real" for v in x.values} | ({"Integer"} if x.ranges else set())
                constants = {c for c in x.constants if c not in by_name and c not in PRIMITIVES}
                s.constants.update(constants)
                out, allowed = found | constants, [*x.values, *x.ranges]
                for c in set(x.constants) - constants:
                    more, _ = leaves(TypeRef(c), inside)
                    out |= more
                return out, allowed
            if isinstance(x, UnionDef):
                out, allowed, free = set(), [], set()
                for m in x.members:
                    more, a = leaves(m, inside)
                    out |= more
                    allowed += a
                    free |= more if not a else set()
                return out, [] if free & set(PRIMITIVES) else allowed
            name = x.name
            if name in PRIMITIVES:
                return {name}, []
            if name not in by_name:
                if name in s.constants:
                    return {name}, []
                raise TypeError_(f"type {name} is not defined")
            if name in inside:
                raise TypeError_(f"union {name} contains itself")
            d = by_name[name].definition
            return ({name}, []) if isinstance(d, CompositeDef) and d.fields else ({name}, []) if isinstance(d, CompositeDef) else leaves(d, (*inside, name))

        composites = {n for n, d in by_name.items() if isinstance(d.definition, CompositeDef)}
        raw = {n: [(f.name or f"_{i}", leaves(f.type, ())) for i, f in enumerate(by_name[n].definition.fields)] for n in composites}
        holds = {n: {x for _, (ls, _) in fields for x in ls if x in composites} for n, fields in raw.items()}
        reach = {n: _reach(holds, n) for n in composites}
        for n, fields in raw.items():
            cut = [(f, Type(frozenset("~Text" if x in composites and n in reach[x] | {x} else x for x in ls), tuple(a))) for f, (ls, a) in fields]
            s.composites[n] = Composite(n, tuple(cut), by_name[n].definition.bijection)
        for n, d in by_name.items():
            if n not in composites:
                ls, allowed = leaves(d.definition, (n,))
                s.unions[n] = Type(frozenset(ls), tuple(allowed))
        return s

    def type_of(self, name: str) -> Type:
        if name in PRIMITIVES or name in self.composites or name in self.constants:
            return one(name)
        if name in self.unions:
            return self.unions[name]
        raise TypeError_(f"type {name} is not defined")

    def is_primitive(self, name: str) -> bool:
        return name in PRIMITIVES

    def is_composite(self, name: str) -> bool:
        return name in self.composites

    def is_union(self, name: str) -> bool:
        """Of types or of an enumeration's values."""
        return name in self.unions

    # Spark representation
    def spark(self, t: Type) -> T.DataType:
        if t.plain and t.plain not in self.constants:
            return self._leaf(t.plain)
        slots = [T.StructField("tag", T.StringType())]
        return T.StructType(slots + [T.StructField(x, self._leaf(x)) for x in sorted(t.leaves) if x not in self.constants])

    def _leaf(self, name: str) -> T.DataType:
        if name == "~Text":
            return T.StringType()
        if name in PRIMITIVES:
            return PRIMITIVES[name]
        fields = self.composites[name].fields
        return T.StructType([T.StructField(f, self.spark(t)) for f, t in fields]) if fields else T.StructType([T.StructField("tag", T.StringType())])

    def relation(self, name: str) -> T.StructType:
        """Columns of a relation: its fields, or `present` for one without."""
        c = self.composites.get(name)
        if c is None or not c.fields:
            return T.StructType([T.StructField("present", T.BooleanType())])
        return T.StructType([T.StructField(f, self.spark(t)) for f, t in c.fields])

    # casts
    def meet(self, a: Type, b: Type) -> Type | None:
        """The values that both types have; None if there are none. Text stands for any composite it may hold."""
        both = a.leaves & b.leaves
        for x, y in ((a, b), (b, a)):
            if "~Text" in x.leaves:
                both |= {"~Text"} if "~Text" in y.leaves or any(n in self.composites for n in y.leaves) else set()
            if x.leaves & _INTEGERS and y.leaves & _INTEGERS and not both & _INTEGERS:
                both |= {"Integer"}
        if "~Text" in both:
            both -= set(self.composites)
        return Type(frozenset(both)) if both else None

    def cast(self, value: Column, have: Type, want: Type) -> tuple[Column, Column | None]:
        """(the value as `want`, the condition under which it is one, or None if always)."""
        if have.leaves == want.leaves:
            return value, self._admits(value, want)
        if have.leaves <= _INTEGERS and want.leaves <= _INTEGERS and have.plain and want.plain:
            lo, hi = BOUNDS.get(want.plain, (None, None))
            tests = [c for c in (value >= lo if lo is not None else None, value <= hi if hi is not None else None) if c is not None]
            return value, tests[0] if tests else None
        if have.plain == "Integer" and want.plain in ("Real", "Rational"):
            return value.cast("double"), None
        parts = {x: self._part(value, have, x) for x in sorted(have.leaves)}
        if want.plain and want.plain not in self.constants:
            for leaf, (part, test) in sorted(parts.items(), key=lambda x: x[0] != want.plain):
                if leaf == want.plain or leaf in _INTEGERS and want.plain in _INTEGERS:
                    return part, _both(test, self._admits(part, want))
                if want.plain == "~Text" and leaf in self.composites:
                    return self.text(part, one(leaf)), test
                if self.twin(leaf, want) == want.plain:
                    return self._copied(part, leaf, want.plain), test
            return F.lit(None).cast(self.spark(want)), F.lit(False)
        made, tests = [], []
        for leaf, (part, test) in parts.items():
            to = leaf if leaf in want.leaves else next((x for x in sorted(want.leaves) if x in _INTEGERS and leaf in _INTEGERS or x == "~Text" and leaf in self.composites), self.twin(leaf, want))
            if to is not None:
                made.append((test, self._tagged(part if to == leaf or to in _INTEGERS or to in self.constants else self.text(part, one(leaf)) if to == "~Text" else self._copied(part, leaf, to), to, want)))
                tests.append(test)
        if not made:
            return F.lit(None).cast(self.spark(want)), F.lit(False)
        if made[0][0] is None:
            return made[0][1], None
        out = F.when(*made[0])
        for m in made[1:]:
            out = out.when(*m)
        any_of = tests[0]
        for t in tests[1:]:
            any_of = any_of | t
        return out, None if len(made) == len(parts) else any_of

    def twin(self, leaf: str, want: Type) -> str | None:
        """The type of the same name under another scope: a transform copies terms from one to the other."""
        base = leaf.rpartition(".")[2]
        same = [x for x in sorted(want.leaves) if x != leaf and x.rpartition(".")[2] == base and (x in self.composites) == (leaf in self.composites) and (x in self.constants) == (leaf in self.constants)]
        return same[0] if same and "." in leaf + same[0] else None

    def _copied(self, value: Column, leaf: str, to: str) -> Column:
        if to in self.constants:
            return self.constant(to)
        fields = zip(self.composites[leaf].fields, self.composites[to].fields, strict=True)
        return F.struct(*(self.cast(value.getField(f), t, u)[0].alias(g) for (f, t), (g, u) in fields))

    def _admits(self, value: Column, t: Type) -> Column | None:
        """Membership in an enumeration's values and ranges, for a plain column."""
        if not t.allowed or not t.plain:
            return None
        out = F.lit(False)
        for a in t.allowed:
            out = out | (value.between(*a) if isinstance(a, tuple) else value == F.lit(a))
        return out

    def _part(self, value: Column, have: Type, leaf: str) -> tuple[Column, Column | None]:
        if have.plain and have.plain not in self.constants:
            return value, None
        return (value if leaf in self.constants else value.getField(leaf)), value.getField("tag") == leaf

    def _tagged(self, part: Column, leaf: str, want: Type) -> Column:
        slots = [F.lit(leaf).alias("tag")]
        slots += [(part if x == leaf else F.lit(None)).cast(self._leaf(x)).alias(x) for x in sorted(want.leaves) if x not in self.constants]
        return F.struct(*slots)

    def constant(self, name: str, want: Type | None = None) -> Column:
        return self._tagged(F.lit(None), name, want or one(name))

    # text
    def text(self, value: Column, t: Type) -> Column:
        """Canonical text of a value: constructors with their arguments, strings in quotes."""
        if t.plain and t.plain not in self.constants:
            return self._leaf_text(value, t.plain)
        out = None
        for x in sorted(t.leaves):
            made = F.lit(x) if x in self.constants else self._leaf_text(value.getField(x), x)
            out = F.when(value.getField("tag") == x, made) if out is None else out.when(value.getField("tag") == x, made)
        return out

    def _leaf_text(self, value: Column, leaf: str) -> Column:
        if leaf == "~Text":
            return value
        if leaf == "String":
            return F.concat(F.lit('"'), value, F.lit('"'))
        if leaf in PRIMITIVES:
            return value.cast("string")
        fields = self.composites[leaf].fields
        args = [self.text(value.getField(f), t) for f, t in fields]
        return F.concat(F.lit(f"{leaf}("), F.concat_ws(", ", *args), F.lit(")")) if fields else F.lit(leaf)

    def arguments(self, text: Column) -> Column:
        """The texts of a term's arguments, from its canonical text: commas and the outer parentheses count only where no
        other parenthesis or quote is open. One pass over the text's tokens, in the JVM."""
        tokens = F.regexp_extract_all(text, F.lit(r'"[^"]*"|[(),]|[^"(),]+'), F.lit(0))
        start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

        def step(s: Column, x: Column) -> Column:
            depth, now, done = s["depth"], s["now"], s["done"]
            after = depth + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)
            ends = ((x == ",") & (depth == 1)) | ((x == ")") & (depth == 1))
            taken = F.when((depth == 0) | ends, F.lit("")).otherwise(F.concat(now, F.when(now == "", F.ltrim(x)).otherwise(x)))
            return F.struct(after.alias("depth"), taken.alias("now"), F.when(ends, F.concat(done, F.array(now))).otherwise(done).alias("done"))

        return F.aggregate(tokens, start, step, lambda s: s["done"])

    def parsed(self, text: Column, want: Type) -> tuple[Column, Column]:
        """(the value of type `want` that a canonical text stands for, whether it stands for one)."""
        made = [(test, part, x) for x in sorted(want.leaves) for part, test in [self._parsed_leaf(text, x)]]
        if want.plain and want.plain not in self.constants:
            test, part, _ = made[0]
            admitted = self._admits(part, want)
            return F.when(test, part), test if admitted is None else test & F.coalesce(F.when(test, admitted), F.lit(False))
        out = None
        for test, part, x in made:
            value = self._tagged(F.when(test, part), x, want)
            out = F.when(test, value) if out is None else out.when(test, value)
        any_of = made[0][0]
        for test, _, _ in made[1:]:
            any_of = any_of | test
        return out, any_of

    def _parsed_leaf(self, text: Column, leaf: str) -> tuple[Column, Column]:
        if leaf in self.constants:
            return F.lit(None), text == leaf
        if leaf == "~Text":
            return text, text.rlike(r"^[A-Za-z_][^(\"]*\(")
        if leaf == "String":
            return F.substring(text, F.lit(2), F.length(text) - 2), text.startswith('"')
        if leaf == "Boolean":
            return text == "true", text.isin("true", "false")
        if leaf in PRIMITIVES:
            whole = leaf not in ("Real", "Rational")
            test = text.rlike(r"^-?[0-9]+$" if whole else r"^-?[0-9]+\.[0-9]+(E-?[0-9]+)?$")
            value = F.when(test, text).cast(PRIMITIVES[leaf])
            lo, hi = BOUNDS.get(leaf, (None, None))
            for bound in [value >= lo] * (lo is not None) + [value <= hi] * (hi is not None):
                test = test & F.coalesce(bound, F.lit(False))
            return value, test
        fields = self.composites[leaf].fields
        if not fields:
            return self.constant(leaf), text == leaf
        args, test, parts = self.arguments(text), text.startswith(f"{leaf}("), []
        for i, (f, t) in enumerate(fields):
            value, fits = self.parsed(F.get(args, F.lit(i)), t)
            parts.append(value.alias(f))
            test = test & F.coalesce(fits, F.lit(False))
        return F.struct(*parts), test

    # literal values for createDataFrame
    def python(self, e: Expr, want: Type):
        """A ground term as the Python value of a column of type `want`."""
        if isinstance(e, Lit):
            leaf = "Boolean" if isinstance(e.value, bool) else "Integer" if isinstance(e.value, int) else "String" if isinstance(e.value, str) else "Real"
            if leaf == "Integer" and leaf not in want.leaves:
                leaf = next((x for x in sorted(want.leaves) if x in _INTEGERS or x in ("Real", "Rational")), leaf)
            if leaf == "Real" and leaf not in want.leaves and "Rational" in want.leaves:
                leaf = "Rational"
            value = float(e.value) if leaf in ("Real", "Rational") else e.value
            lo, hi = BOUNDS.get(leaf, (None, None))
            admitted = not want.allowed or any(a[0] <= value <= a[1] if isinstance(a, tuple) else a == value and type(a) is type(value) for a in want.allowed if not isinstance(a, tuple) or not isinstance(value, str))
            if leaf not in want.leaves or not admitted or lo is not None and value < lo or hi is not None and value > hi:
                raise TypeError_(f"{e} is not of type {want}")
        elif isinstance(e, Term) and e.name in self.composites:
            leaf, c = e.name, self.composites[e.name]
            if len(e.args) != len(c.fields):
                raise TypeError_(f"{e.name} takes {len(c.fields)} arguments, not {len(e.args)}")
            if leaf not in want.leaves and "~Text" in want.leaves:
                leaf, value = "~Text", canonical(e)
            else:
                value = tuple(self.python(a, t) for a, (_, t) in zip(e.args, c.fields, strict=True)) or (leaf,)
        else:
            leaf, value = getattr(e, "name", str(e)), None
            if leaf not in self.constants:
                raise TypeError_(f"{e} is neither a value nor a constant")
        if leaf not in want.leaves:
            raise TypeError_(f"{e} is not of type {want}")
        if want.plain and want.plain not in self.constants:
            return value
        return (leaf, *(value if x == leaf else None for x in sorted(want.leaves) if x not in self.constants))


_INTEGERS = {"Integer", "Natural", "PosInteger", "NegInteger"}


def _both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def _reach(edges: dict[str, set[str]], start: str) -> set[str]:
    seen, todo = set(), list(edges.get(start, ()))
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += edges.get(x, ())
    return seen


def canonical(e: Expr) -> str:
    """Canonical text of a ground term, as Schema.text gives it for a column."""
    if isinstance(e, Term):
        return f"{e.name}({', '.join(map(canonical, e.args))})" if e.args else e.name
    return str(e)
