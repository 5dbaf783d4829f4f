"""Domains, models and transforms: inheritance with renaming, facts with aliases, application."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lang.ast import Binary, Compare, CompositeDef, Compre, Constraint, EnumDef, Expr, FieldDef, HasType, Lit, Module, NoSet, Pred, Program, Require, Rule, Term, TypeDef, TypeRef, Unary, UnionDef, Var
from .lang.parser import parse, parse_body
from .plans.analyze import AnalysisError, check_safety, constraint_vars, ground, normalized, strata
from .plans.compile import Body
from .plans.fixpoint import Relations, evaluate, members, run_rule

from .types import PRIMITIVES, Schema, Type, one


@dataclass
class Parts:
    """What a module has, its inheritance resolved."""

    types: list[TypeDef] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    conforms: list[tuple[Constraint, ...]] = field(default_factory=list)
    requires: list[Require] = field(default_factory=list)

    def add(self, other: Parts, conformance: bool) -> None:
        self.types += [t for t in other.types if t not in self.types]
        self.rules += [r for r in other.rules if r not in self.rules]
        if conformance:
            self.conforms += [c for c in other.conforms if c not in self.conforms]
            self.requires += [r for r in other.requires if r not in self.requires]

    def names(self) -> set[str]:
        out = {t.name for t in self.types}
        for t in self.types:
            out |= _constants(t.definition)
        return out | {h.name for r in self.rules for h in r.heads}

    def renamed(self, scope: str) -> Parts:
        names = {n: f"{scope}.{n}" for n in self.names() if n not in PRIMITIVES}
        to = Renamer(names)
        return Parts([TypeDef(names[t.name], to.type(t.definition)) for t in self.types], [to.rule(r) for r in self.rules], [tuple(map(to.constraint, b)) for b in self.conforms], [replace(r, type=names.get(r.type, r.type)) for r in self.requires])


def _constants(d) -> set[str]:
    if isinstance(d, EnumDef):
        return set(d.constants)
    if isinstance(d, UnionDef):
        return set().union(*map(_constants, d.members), set())
    if isinstance(d, CompositeDef):
        return set().union(*(_constants(f.type) for f in d.fields), set())
    return set()


class Renamer:
    """Replaces names of types, constructors and constants."""

    def __init__(self, names: Mapping[str, str]):
        self.names = names

    def name(self, n: str) -> str:
        return self.names.get(n, n)

    def type(self, d):
        if isinstance(d, TypeRef):
            return TypeRef(self.name(d.name))
        if isinstance(d, EnumDef):
            return replace(d, constants=tuple(map(self.name, d.constants)))
        if isinstance(d, UnionDef):
            return UnionDef(tuple(map(self.type, d.members)))
        return replace(d, fields=tuple(FieldDef(f.name, self.type(f.type)) for f in d.fields))

    def expr(self, e: Expr) -> Expr:
        if isinstance(e, Var):
            return Term(self.names[str(e)]) if str(e) in self.names else e
        if isinstance(e, Term):
            return Term(self.name(e.name), tuple(map(self.expr, e.args)))
        if isinstance(e, Unary):
            return Unary(e.op, self.expr(e.of))
        if isinstance(e, Binary):
            return Binary(e.op, self.expr(e.left), self.expr(e.right))
        if isinstance(e, Compre):
            return Compre(e.op, tuple(map(self.expr, e.args)), tuple(map(self.expr, e.heads)), tuple(map(self.constraint, e.body)))
        return e

    def constraint(self, c: Constraint) -> Constraint:
        if isinstance(c, Pred):
            return replace(c, term=self.expr(c.term))
        if isinstance(c, Compare):
            return Compare(c.op, self.expr(c.left), self.expr(c.right))
        if isinstance(c, HasType):
            return replace(c, type=self.name(c.type))
        return NoSet(self.expr(c.compre))

    def rule(self, r: Rule) -> Rule:
        return Rule(tuple(map(self.expr, r.heads)), tuple(map(self.constraint, r.body)))


@dataclass
class Domain:
    name: str
    schema: Schema
    rules: list[Rule]
    conforms: list[tuple[Constraint, ...]]
    requires: list[Require]

    def explain(self) -> str:
        """The rules by stratum."""
        lines = []
        for i, s in enumerate(strata(self.rules, members(self.schema))):
            lines.append(f"stratum {i}{' (recursive)' if s.recursive else ''}: {', '.join(sorted(s.relations))}")
            for part in s.parts or (s,):
                lines += [f"  {'* ' if s.parts and part.recursive else ''}{r}" for r in part.rules]
        return "\n".join(lines)


def build(name: str, parts: Parts) -> Domain:
    """Types resolved, heads without arguments made constants, rules checked."""
    declared = {t.name for t in parts.types}
    constants = {h.name for r in parts.rules for h in r.heads if not h.args and h.name not in declared}
    schema = Schema.resolve(parts.types, constants)
    rules = list({normalized(x): x for r in parts.rules for x in _expand(r, schema)}.values())  # each once, whatever its names
    for r in rules:
        check_safety(Renamer({n: n for n in schema.constants}).rule(Rule(tuple(h for h in r.heads if h.args), r.body)))
        for h in r.heads:
            if h.name not in schema.composites and h.name not in schema.constants:
                raise AnalysisError(f"{h.name} is not a constructor: {r}")
    strata(rules, members(schema))
    return Domain(name, schema, rules, parts.conforms, parts.requires)


def _expand(r: Rule, schema: Schema) -> list[Rule]:
    """Out._(x) :- In._(x): one rule for each constructor that both sides have."""
    wild = [h for h in r.heads if h.name.endswith("._")]
    if not wild:
        return [r]
    scans = [c for c in r.body if isinstance(c, Pred) and c.term.name.endswith("._")]
    if len(scans) != 1 or len(r.heads) != 1:
        raise AnalysisError(f"a wildcard constructor needs one scan and one head: {r}")
    out, to, of = [], wild[0].name[:-1], scans[0].term.name[:-1]
    for n, c in schema.composites.items():
        if n.startswith(of) and to + n[len(of) :] in schema.composites:
            args = tuple(Var(f"~w{i}") for i in range(len(c.fields)))
            rest = tuple(x for x in r.body if x is not scans[0])
            out.append(Rule((Term(to + n[len(of) :], args),), (Pred(Term(n, args)), *rest)))
    return out


class Result:
    """The least model of a domain over given relations."""

    def __init__(self, engine: Engine, domain: Domain, relations: Relations, params: dict[str, Lit] | None = None):
        self.engine, self.domain, self.relations, self.params = engine, domain, relations, params or {}

    def relation(self, name: str) -> DataFrame:
        """A relation's rows, one column for each field; of a union, one column `value`."""
        df = self.relations[name]
        return df.toDF("value") if name in self.domain.schema.unions else df

    def flat(self, name: str, columns: list[str] | None = None) -> DataFrame:
        """Rows with scalar columns: structs opened into field_subfield, unions left as canonical text."""
        schema, out = self.domain.schema, []

        def add(value: Column, t: Type, at: str) -> None:
            if t.plain in schema.composites and schema.composites[t.plain].fields:
                own = schema.composites[t.plain].fields
                for f, ft in own:
                    add(value.getField(f), ft, at if len(own) == 1 else f"{at}_{f}")
            elif t.plain and t.plain not in schema.constants:
                out.append(value.alias(at))
            else:
                out.append(schema.text(value, t).alias(at))

        for f, t in schema.composites[name].fields:
            add(F.col(f"`{f}`"), t, f)
        df = self.relations[name].select(*out)
        return df.toDF(*columns) if columns else df

    def lookup(self, name: str, **keys) -> DataFrame:
        """Rows of flat(name) by the values of some columns: a filter that reaches the stored relation."""
        df = self.flat(name)
        for column, value in keys.items():
            df = df.where(F.col(f"`{column}`") == value)
        return df

    def observed(self, name: str) -> tuple[DataFrame, Observation]:
        """A relation and an observation of it: how many rows passed, once an action has run. For watching a relation
        inside a larger plan without another job."""
        seen = Observation(name)
        return self.relation(name).observe(seen, F.count(F.lit(1)).alias("rows")), seen

    def explain(self, mode: str = "formatted") -> str:
        """Each rule and the Spark plan of its last evaluation step, over the relations as they are now."""
        lines = []
        for i, s in enumerate(strata(self.domain.rules, members(self.domain.schema))):
            for r in s.rules:
                lines.append(f"stratum {i}: {r}")
                for name, df in run_rule(self.engine.spark, self.domain.schema, r, lambda n, _: self.relations[n], self.params):
                    lines += [f"-- {name}", self.engine.spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)]
        return "\n".join(lines)

    def holds(self, name: str) -> bool:
        return not self.relations[name].isEmpty()

    def query(self, body: str, columns: list[str] | None = None) -> DataFrame:
        """Bindings of a body's variables, one column each, without repeats."""
        constraints = parse_body(body)
        names = sorted(set().union(*map(constraint_vars, constraints)))
        found = Body(self.engine.spark, self.domain.schema, lambda n, _: self.relations[n], self.params).compile(constraints, set(names))
        kept = columns or [n for n in names if n in found.types]
        return found.df.select(*(F.col(f"`{n}`") for n in kept)).distinct() if kept else found.df.limit(1)

    def text(self, name: str) -> DataFrame:
        """Canonical text of each term of a relation."""
        fields = self.domain.schema.composites[name].fields if name in self.domain.schema.composites else ()
        args = [self.domain.schema.text(F.col(f"`{f}`"), t) for f, t in fields]
        return self.relations[name].select((F.concat(F.lit(f"{name}("), F.concat_ws(", ", *args), F.lit(")")) if args else F.lit(name)).alias("term"))

    def conformance(self) -> DataFrame:
        """(rule, holds): a conforms rule holds where its body has a row; bijections and cardinalities by counts."""
        spark, parts = self.engine.spark, []

        def row(label: str, df: DataFrame) -> DataFrame:
            return df.limit(1).agg((F.count("*") > 0).alias("holds")).select(F.lit(label).alias("rule"), "holds")

        for body in self.domain.conforms:
            env = Body(spark, self.domain.schema, lambda n, _: self.relations[n], self.params).compile(body, set())
            parts.append(row(", ".join(map(str, body)), env.df))
        for r in self.domain.requires:
            n = self.relations[r.type].agg(F.count("*").alias("n"))
            test = {"atleast": F.col("n") >= r.n, "atmost": F.col("n") <= r.n, "some": F.col("n") >= r.n, "exactly": F.col("n") == r.n}[r.kind]
            parts.append(n.select(F.lit(f"requires {r.kind} {r.n} {r.type}").alias("rule"), test.alias("holds")))
        for c in self.domain.schema.composites.values():
            if c.bijection:
                sides = [f for f, _ in c.fields[: c.bijection]], [f for f, _ in c.fields[c.bijection :]]
                for own in sides:
                    twice = self.relations[c.name].groupBy(*own).count().where("count > 1")
                    parts.append(twice.limit(1).agg((F.count("*") == 0).alias("holds")).select(F.lit(f"{c.name} has each {', '.join(own)} once").alias("rule"), "holds"))
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "rule string, holds boolean")

    def conforms(self) -> bool:
        return self.conformance().where("not holds").isEmpty()


class Engine:
    """Programs over Spark: load text, run domains over relations or models, apply transforms."""

    def __init__(self, spark: SparkSession, max_rounds: int = 1000):
        self.spark, self.max_rounds, self.program = spark, max_rounds, Program()
        self.made: dict[str, tuple[str, dict[str, DataFrame]]] = {}

    def load(self, text: str) -> Engine:
        more = parse(text)
        twice = set(more.modules) & set(self.program.modules)
        if twice:
            raise AnalysisError(f"defined twice: {', '.join(sorted(twice))}")
        self.program.modules |= more.modules
        self.program.applications += more.applications
        return self

    def module(self, name: str, kind: str) -> Module:
        m = self.program.modules.get(name)
        if m is None or m.kind != kind:
            raise KeyError(f"no {kind} {name}")
        return m

    def parts(self, name: str, seen: tuple[str, ...] = ()) -> Parts:
        if name in seen:
            raise AnalysisError(f"{name} inherits from itself")
        m, out = self.module(name, "domain"), Parts()
        for i in m.inherits:
            base = self.parts(i.name, (*seen, name))
            out.add(base.renamed(i.scope) if i.scope else base, i.mode == "extends")
        out.add(Parts(m.types, m.rules, m.conforms, m.requires), True)
        return out

    def domain(self, name: str) -> Domain:
        return build(name, self.parts(name))

    # models
    def model_domain(self, name: str) -> str:
        if name in self.made:
            return self.made[name][0]
        m = self.module(name, "model")
        of = next((i for i in m.inherits if i.mode == "of"), None)
        if of is None:
            raise AnalysisError(f"model {name} has no domain")
        return of.name

    def model_facts(self, name: str) -> list[Term]:
        """Ground facts of a model and those it includes, aliases replaced; each once."""
        return self._facts(name, ())[0]

    def _facts(self, name: str, seen: tuple[str, ...]) -> tuple[list[Term], dict[str, Term]]:
        """(facts, alias -> ground term), renamed where a scope is given."""
        if name in seen:
            raise AnalysisError(f"model {name} includes itself")
        m, out, known = self.module(name, "model"), [], {}
        for i in m.inherits:
            if i.mode != "of":
                facts, aliases = self._facts(i.name, (*seen, name))
                if i.scope:
                    to = Renamer({n: f"{i.scope}.{n}" for n in self.parts(self.model_domain(i.name)).names()})
                    facts, aliases = list(map(to.expr, facts)), {f"{i.scope}.{n}": to.expr(t) for n, t in aliases.items()}
                out += facts
                known |= aliases
        own = {f.alias: f.term for f in m.facts if f.alias}

        def ground(e: Expr, inside: tuple[str, ...] = ()) -> Expr:
            if isinstance(e, Var):
                n = str(e)
                if n in inside:
                    raise AnalysisError(f"alias {n} stands for itself")
                return ground(own[n], (*inside, n)) if n in own else known.get(n, Term(n))
            return Term(e.name, tuple(ground(a, inside) for a in e.args)) if isinstance(e, Term) else e

        aliases = known | {n: ground(t, (n,)) for n, t in own.items()}
        return list(dict.fromkeys([*out, *(ground(f.term) for f in m.facts)])), aliases

    def facts(self, domain: Domain, terms: list[Term]) -> dict[str, DataFrame]:
        """Relations of ground terms; arguments are checked against their types."""
        rows: dict[str, list] = {}
        for t in terms:
            fields = domain.schema.composites[t.name].fields if t.name in domain.schema.composites else None
            if fields is None and t.name not in domain.schema.constants:
                raise AnalysisError(f"{t.name} is not a constructor")
            if not ground(Renamer({c: c for c in domain.schema.constants}).expr(t)):
                raise AnalysisError(f"a fact has no variables: {t}")
            if fields and len(fields) != len(t.args):
                raise AnalysisError(f"{t.name} takes {len(fields)} arguments: {t}")
            rows.setdefault(t.name, []).append(tuple(domain.schema.python(a, ft) for a, (_, ft) in zip(t.args, fields, strict=True)) if fields else (True,))
        return {n: self.spark.createDataFrame(list(dict.fromkeys(r)), domain.schema.relation(n)) for n, r in rows.items()}

    def solve(self, model: str) -> Result:
        domain = self.domain(self.model_domain(model))
        base = self.made[model][1] if model in self.made else self.facts(domain, self.model_facts(model))
        return self.run(domain, base)

    def run(self, domain: Domain | str, base: Mapping[str, DataFrame], params: dict[str, Lit] | None = None) -> Result:
        """base: relations by name, columns in the order of the fields; scalars become one-field terms as needed."""
        d = self.domain(domain) if isinstance(domain, str) else domain
        given = {n: conform(d.schema, n, df) for n, df in base.items()}
        return Result(self, d, evaluate(self.spark, d.schema, d.rules, given, params, self.max_rounds), params)

    # transforms
    def apply(self, result: str, transform: str, *args: Lit | str | int | float | bool) -> dict[str, Result]:
        """Runs a transform on literals and models; its outputs become models: `result`, or result.Scope if several."""
        m = self.module(transform, "transform")
        wanted = [*m.params, *m.inputs]
        literals = [a if isinstance(a, Lit) else Lit(a) for a in args if not (isinstance(a, str) and (a in self.made or a in self.program.modules))]
        models = [a for a in args if isinstance(a, str) and (a in self.made or a in self.program.modules)]
        if len(literals) != len(m.params) or len(models) != len(m.inputs):
            raise AnalysisError(f"{transform} takes {len(wanted)} arguments: {len(m.params)} values and {len(m.inputs)} models")
        params = {p.name: v for p, v in zip(m.params, literals, strict=True)}
        parts, base = Parts(), {}
        for i, name in zip(m.inputs, models, strict=True):
            own = self.parts(i.name)
            parts.add(own.renamed(i.scope), False)
            solved = self.solve(name)
            for n in [*solved.domain.schema.composites, *solved.domain.schema.constants]:
                if n in solved.relations.known and f"{i.scope}.{n}" not in base:
                    base[f"{i.scope}.{n}"] = solved.relations.known[n]
        for o in m.outputs:
            out = self.parts(o.name).renamed(o.scope)
            parts.add(Parts(types=out.types), False)
        parts.add(Parts(m.types, m.rules), False)
        domain = build(transform, parts)
        base = {n: df for n, df in base.items() if n in domain.schema.composites or n in domain.schema.constants}
        check = domain.schema.python
        for p in m.params:
            for t in [p.type] if isinstance(p.type, TypeRef) else []:
                if t.name in PRIMITIVES:
                    check(params[p.name], domain.schema.type_of(t.name))
        relations = evaluate(self.spark, domain.schema, domain.rules, retagged(domain.schema, base), params, self.max_rounds)
        results = {}
        for o in m.outputs:
            own = self.domain(o.name)
            facts = {n: untagged(own.schema, n, relations[f"{o.scope}.{n}"]) for n in own.schema.composites if f"{o.scope}.{n}" in relations.known}
            name = result if len(m.outputs) == 1 else f"{result}.{o.scope}"
            self.made[name] = (o.name, facts)
            results[o.scope] = self.solve(name)
        return results

    def run_applications(self) -> dict[str, dict[str, Result]]:
        return {a.result: self.apply(a.result, a.transform, *a.args) for a in self.program.applications}


def conform(schema: Schema, name: str, df: DataFrame) -> DataFrame:
    """Columns by position, cast to the relation's types; a scalar for a one-field constructor is wrapped in it.

    A term has a value in each field, so rows of a table with a null in one aren't terms and are left out."""
    want = schema.relation(name)
    if len(df.columns) != len(want.fields):
        raise AnalysisError(f"{name} has {len(want.fields)} fields, not {len(df.columns)}")
    out = []
    for have, field_ in zip(df.schema.fields, want.fields, strict=True):
        value = F.col(f"`{have.name}`")
        kind = field_.dataType
        while isinstance(kind, T.StructType) and not isinstance(have.dataType, T.StructType) and len(kind.fields) == 1:
            kind = kind.fields[0].dataType
        value = value.cast(kind)
        kind = field_.dataType
        names = []
        while isinstance(kind, T.StructType) and not isinstance(have.dataType, T.StructType) and len(kind.fields) == 1:
            names.append(kind.fields[0].name)
            kind = kind.fields[0].dataType
        for n in reversed(names):
            value = F.struct(value.alias(n))
        out.append(value.alias(field_.name))
    types = [t for _, t in schema.composites[name].fields] if name in schema.composites else []
    whole = [present(schema, F.col(f"`{w.name}`"), t) for w, t in zip(want.fields, types, strict=False)]
    return df.select(*out).where(reduce(Column.__and__, whole, F.lit(True))).distinct()


def present(schema: Schema, value: Column, t: Type) -> Column:
    """Whether a column's value has no null where a term has a value: of a union, only the slot that the tag names counts."""
    if t.plain and t.plain not in schema.constants:
        fields = schema.composites[t.plain].fields if t.plain in schema.composites else ()
        return reduce(Column.__and__, [present(schema, value.getField(f), ft) for f, ft in fields], value.isNotNull())
    tag = value.getField("tag")
    slots = [(tag != x) | present(schema, value.getField(x), one(x)) for x in sorted(t.leaves) if x not in schema.constants]
    return reduce(Column.__and__, slots, tag.isNotNull())


def retagged(schema: Schema, base: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Relations of a model under the names of a scope: tags and slots of unions take the scope's names by position."""
    return {n: _reshaped(df, schema.relation(n)) for n, df in base.items()}


def untagged(schema: Schema, name: str, df: DataFrame) -> DataFrame:
    return _reshaped(df, schema.relation(name))


def _reshaped(df: DataFrame, want: T.StructType) -> DataFrame:
    def shape(value: Column, have: T.DataType, to: T.DataType) -> Column:
        if not isinstance(to, T.StructType) or have == to:
            return value.cast(to)
        parts = []
        by_end = {f.name.rpartition(".")[2]: f for f in have.fields}
        for f in to.fields:
            g = by_end[f.name.rpartition(".")[2]]
            part = shape(value.getField(g.name), g.dataType, f.dataType)
            if f.name == "tag" and to.fields[0].name == "tag":
                scope = next((x.name.rpartition(".")[0] for x in to.fields[1:] if "." in x.name), "")
                bare = F.element_at(F.split(part, r"\."), -1)
                known = {x.name.rpartition(".")[2] for x in to.fields[1:] if "." in x.name}
                part = F.when(bare.isin(*known), F.concat(F.lit(f"{scope}."), bare)).otherwise(bare) if known else bare
            parts.append(part.alias(f.name))
        return F.struct(*parts)

    have = df.schema.fields
    return df.select(*(shape(F.col(f"`{h.name}`"), h.dataType, w.dataType).alias(w.name) for h, w in zip(have, want.fields, strict=True)))


