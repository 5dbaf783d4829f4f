"""Sessions: base facts under transactions, results kept up to date stratum by stratum, changes with weights.

Insertions into strata without negation or aggregates above them continue the semi-naive loop from the inserted rows;
otherwise the strata that a change reaches are computed anew, and only those.

Relations are lists of stored parts: an insertion adds a part with the new rows only, and the parts are written as one
when there are many. Parts that later commits supersede stay until the session ends, as DataFrames handed out earlier
may still read them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lang.ast import Lit, Term
from ..lang.parser import parse_term
from ..modules import Domain, Engine, Result, conform
from ..plans.analyze import Stratum, strata, uses
from ..plans.fixpoint import MOST_PARTS, Relations, loop, members, run_rule, run_stratum
from ..plans.store import Store
from ..sources.commands import Command, parse_commands


#: Rows of an update up to which it is broadcast.
BROADCAST_ROWS = 200_000


class TransactionError(RuntimeError):
    pass


class Session:
    def __init__(self, engine: Engine, domain: Domain | str, base: Mapping[str, DataFrame] | None = None):
        self.engine, self.spark = engine, engine.spark
        self.domain = engine.domain(domain) if isinstance(domain, str) else domain
        self.schema, self.store = self.domain.schema, Store(engine.spark)
        self.strata = strata(self.domain.rules, members(self.schema))
        self.base: dict[str, DataFrame] = {}
        self.done: dict[str, DataFrame] = {}
        self.before: dict[str, DataFrame] = {}
        self.parts: dict[str, tuple[DataFrame, list[str]]] = {}  # a relation's state and the paths that hold it
        self.callbacks: list[Callable[[str, DataFrame], None]] = []
        self.pending: dict[str, list[tuple[str, DataFrame]]] | None = None
        self.begin()
        for name, df in (base or {}).items():
            self.insert(name, df)
        self.commit()

    # transactions
    def begin(self) -> Session:
        if self.pending is not None:
            raise TransactionError("a transaction is open")
        self.pending = {}
        return self

    def rollback(self) -> None:
        self._open()
        self.pending = None

    def _open(self) -> dict:
        if self.pending is None:
            raise TransactionError("no transaction is open")
        return self.pending

    def _rows(self, name: str | Term, rows: DataFrame | list | None) -> tuple[str, DataFrame]:
        if isinstance(name, str) and rows is None:
            name = parse_term(name)
        if isinstance(name, Term):
            return next(iter(self.engine.facts(self.domain, [name]).items()))
        if not isinstance(rows, DataFrame):
            terms = [x if isinstance(x, Term) else Term(name, tuple(v if isinstance(v, (Term, Lit)) else Lit(v) for v in x)) for x in rows]
            found = self.engine.facts(self.domain, terms)
            return name, found.get(name, self.spark.createDataFrame([], self.schema.relation(name)))
        return name, conform(self.schema, name, rows)

    def insert(self, name: str | Term, rows: DataFrame | list | None = None) -> None:
        name, df = self._rows(name, rows)
        self._open().setdefault(name, []).append(("+", df))

    def delete(self, name: str | Term, rows: DataFrame | list | None = None) -> None:
        name, df = self._rows(name, rows)
        self._open().setdefault(name, []).append(("-", df))

    def delete_key(self, name: str, keys: DataFrame) -> None:
        """Deletes the rows whose columns, by the names of `keys`, are among its rows."""
        self._open().setdefault(name, []).append(("key", keys))

    def commit(self) -> None:
        """Applies the updates in order, then brings derived relations up to date."""
        pending, self.pending = self._open(), None
        added: dict[str, DataFrame] = {}
        removed: set[str] = set()
        old, base = dict(self.done), dict(self.base)
        for name, updates in pending.items():
            was = base.get(name, self.spark.createDataFrame([], self.schema.relation(name)))
            now = was
            if all(kind == "+" for kind, _ in updates):
                new = self.store.save(reduce(DataFrame.unionByName, [df for _, df in updates]).distinct())
                small = F.broadcast(new) if new.count() <= BROADCAST_ROWS else new
                known = was.join(small, new.columns, "left_semi")  # the base is scanned, not shuffled, for a small update
                more = self.store.save(new.join(known, new.columns, "left_anti"))
                if not more.isEmpty():
                    added[name] = more
                    base[name] = self._extended(name, was, [self.store.paths[-1]])
                else:
                    base[name] = was
                continue
            for kind, df in updates:
                now = now.unionByName(df).distinct() if kind == "+" else now.join(df, df.columns, "left_anti")
            now = self._stored(name, now)
            more = now.join(was, now.columns, "left_anti")
            if any(kind != "+" for kind, _ in updates) and not was.join(now, was.columns, "left_anti").isEmpty():
                removed.add(name)
            if not more.isEmpty():
                added[name] = self.store.save(more)
            base[name] = now
        self._update(base, added, removed)
        self.base, self.before = base, old
        for f in self.callbacks:
            for name in self.touched(added, removed):
                f(name, self.changes(name))

    def _stored(self, name: str, df: DataFrame) -> DataFrame:
        out = self.store.save(df)
        self.parts[name] = (out, [self.store.paths[-1]])
        return out

    def _extended(self, name: str, was: DataFrame, more: list[str]) -> DataFrame:
        """A relation with parts added to its state before."""
        paths = [*self._paths(name, was), *more]
        out = self.store.read(self.schema.relation(name), *paths)
        if len(paths) > MOST_PARTS:
            return self._stored(name, out)
        self.parts[name] = (out, paths)
        return out

    def _paths(self, name: str, df: DataFrame) -> list[str]:
        """Where a state of a relation is stored; it is written if it isn't."""
        held = self.parts.get(name)
        return list(held[1]) if held and held[0] is df else [self.store.write(df)]

    def touched(self, added: Mapping, removed: set[str]) -> list[str]:
        seen = set(added) | removed
        for s in self.strata:
            if self._reads(s) & seen:
                seen |= s.relations
        return sorted(seen)

    def _reads(self, s: Stratum) -> set[str]:
        of = members(self.schema)
        return set(s.relations) | {u.relation for r in s.rules for u in uses(r.body, of)}

    def _update(self, base: dict[str, DataFrame], added: dict[str, DataFrame], removed: set[str]) -> None:
        heads = {n for s in self.strata for n in s.relations}
        done = {n: df for n, df in base.items() if n not in heads}
        grown, broken = {n: df for n, df in added.items() if n not in heads}, {n for n in removed if n not in heads}
        of = members(self.schema)
        for s in self.strata:
            reads = self._reads(s)
            hit = reads & (set(grown) | broken | (s.relations & (set(added) | removed)))
            if not hit and all(n in self.done or n not in heads for n in s.relations) and self.done:
                done |= {n: self.done[n] for n in s.relations if n in self.done}
                continue
            negative = {u.relation for r in s.rules for u in uses(r.body, of) if u.negative}
            fresh = bool(s.parts) or not self.done or broken & reads or removed & s.relations or negative & (set(grown) | broken)
            out = Relations(self.spark, self.schema, done | {n: base[n] for n in s.relations if n in base})
            if fresh:
                run_stratum(out, s, {}, self.engine.max_rounds, self.store)
                for n in s.relations & set(out.known):
                    out.known[n] = self._stored(n, out.known[n])
                    was = self.done.get(n)
                    if was is None:
                        grown[n] = out.known[n]
                    else:
                        more = out.known[n].join(was, was.columns, "left_anti")
                        if not more.isEmpty():
                            grown[n] = self.store.save(more)
                        if not was.join(out.known[n], was.columns, "left_anti").isEmpty():
                            broken.add(n)
            else:
                grown |= self._continue(out, s, grown, {n: added[n] for n in s.relations & set(added)})
            done |= {n: out.known[n] for n in s.relations if n in out.known}
        self.done = done

    def _continue(self, out: Relations, s: Stratum, grown: dict[str, DataFrame], own: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """Rows that insertions add to a stratum: each rule with one changed scan at a time, then the loop."""
        of, made = members(self.schema), {n: [df] for n, df in own.items()}
        for n in s.relations:
            if n in self.done:
                out.known[n] = self.done[n]
        from ..lang.ast import HasType, Pred

        for r in s.rules:
            k = 0
            for c in r.body:
                if not (isinstance(c, Pred) and not c.negated or isinstance(c, HasType) and c.scan and not c.negated):
                    continue
                name = c.term.name if isinstance(c, Pred) else c.type
                if of.get(name, {name}) & set(grown):

                    def source(n: str, number: int | None, k=k) -> DataFrame:
                        if number != k:
                            return out[n]
                        if n in self.schema.unions:
                            return out.view(n, lambda leaf: grown.get(leaf, self.spark.createDataFrame([], self.schema.relation(leaf))))
                        return grown[n]

                    for n, df in run_rule(self.spark, self.schema, r, source, {}, k, self.store):
                        made.setdefault(n, []).append(df)
                k += 1
        delta = {n: reduce(DataFrame.unionByName, parts).distinct() for n, parts in made.items()}
        full = {n: self._paths(n, self.done[n]) for n in s.relations if n in self.done}
        paths = loop(out, s, full, delta, {}, self.engine.max_rounds, self.store)
        for n, more in paths.items():
            was = self.done.get(n)
            out.known[n] = self._extended(n, was, more) if was is not None else self.store.read(self.schema.relation(n), *more)
        return {n: self.store.read(self.schema.relation(n), *p) for n, p in paths.items()}

    # results
    @property
    def result(self) -> Result:
        return Result(self.engine, self.domain, Relations(self.spark, self.schema, self.base | self.done))

    def relation(self, name: str) -> DataFrame:
        return self.result.relation(name)

    def query(self, body: str) -> DataFrame:
        return self.result.query(body)

    def changes(self, name: str) -> DataFrame:
        """Rows of a relation that the last commit added (weight 1) or removed (weight -1)."""
        now = self.result.relation(name)
        was = self.before.get(name, self.spark.createDataFrame([], now.schema))
        return now.join(was, now.columns, "left_anti").withColumn("weight", F.lit(1)).unionByName(was.join(now, now.columns, "left_anti").withColumn("weight", F.lit(-1)))

    def all_changes(self) -> DataFrame:
        """(relation, term, weight) over all relations, terms as canonical text."""
        parts = []
        for name in sorted((set(self.done) | set(self.base) | set(self.before)) & (set(self.schema.composites) | self.schema.constants)):
            fields = self.schema.composites[name].fields if name in self.schema.composites else ()
            args = [self.schema.text(F.col(f"`{f}`"), t) for f, t in fields]
            term = F.concat(F.lit(f"{name}("), F.concat_ws(", ", *args), F.lit(")")) if args else F.lit(name)
            parts.append(self.changes(name).select(F.lit(name).alias("relation"), term.alias("term"), "weight"))
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], "relation string, term string, weight int")

    def on_change(self, callback: Callable[[str, DataFrame], None]) -> None:
        """callback(relation, changes) after each commit, for relations that it may have changed."""
        self.callbacks.append(callback)

    def execute(self, script: str) -> list[DataFrame]:
        """Runs a command script; returns the changes of each `commit dump_changes` and the rows of each dump."""
        out: list[DataFrame] = []
        for c in parse_commands(script):
            self._command(c, out)
        return out

    def _command(self, c: Command, out: list[DataFrame]) -> None:
        if c.verb == "start":
            self.begin()
        elif c.verb == "rollback":
            self.rollback()
        elif c.verb == "insert":
            self.insert(c.term)
        elif c.verb == "delete":
            self.delete(c.term)
        elif c.verb == "commit":
            self.commit()
            if c.changes:
                out.append(self.store.save(self.all_changes()))
        else:
            out.append(self.store.save(self.relation(c.relation)))
