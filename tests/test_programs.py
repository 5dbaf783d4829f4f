"""Programs with known models: parts lists, unions, lists, ranks, recursion, transforms, commands."""

import random

import pytest

from termlog.functions import lists, terms
from termlog.lang.parser import parse_term
from termlog.modules import Engine
from termlog.plans.analyze import AnalysisError
from termlog.plans.fixpoint import DivergenceError
from termlog.sources.generate import graph_program
from termlog.sources.tables import random_graph
from termlog.types import TypeError_

#: What is built into what: needs is the closure, Loose things are in nothing, Cost adds up.
PARTS = """
domain Build {
  Thing ::= new (no: Integer). In ::= new (part: Thing, whole: Thing, amount: Integer). Price ::= new (of: Thing, cents: Integer).
  Needs ::= new (whole: Thing, part: Thing). Loose ::= new (of: Thing). Kinds ::= new (of: Thing, n: Integer). Spent ::= new (cents: Integer).
  Needs(w, p) :- In(p, w, _). Needs(w, p) :- In(q, w, _), Needs(q, p).
  Loose(t) :- t is Thing(_), no In(t, _, _). Sound :- no Needs(t, t).
  Kinds(w, n) :- w is Thing(_), n = count({ p | In(p, w, _) }).
  Spent(c) :- c = sum(0, { x | Loose(t), Price(t, x), count({ p | Needs(t, p) }) > 1 }).
}
model bike of Build { frame is Thing(1). wheel is Thing(2). hub is Thing(3). In(wheel, frame, 2). In(hub, wheel, 1). Price(frame, 900). Price(hub, 40). Thing(1). }
"""


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_parts(spark):
    r = Engine(spark).load(PARTS).solve("bike")
    assert rows(r.flat("Needs")) == [(1, 2), (1, 3), (2, 3)] and r.holds("Sound")
    assert rows(r.flat("Kinds")) == [(1, 1), (2, 1), (3, 0)]
    assert rows(r.flat("Loose")) == [(1,)] and rows(r.flat("Spent")) == [(900,)]
    assert rows(r.query("Needs(Thing(1), Thing(x))")) == [(2,), (3,)] and rows(r.lookup("Needs", whole=2)) == [(2, 3)]
    assert "recursive" in r.domain.explain()
    plans = r.explain("simple")
    assert "-- Needs" in plans and "Scan" in plans
    seen_df, seen = r.observed("Needs")
    assert seen_df.count() == 3 and seen.get["rows"] == 3


def test_rules_that_differ_by_names_run_once(spark):
    d = Engine(spark).load("domain D { A ::= new (x: Integer). B ::= new (x: Integer). B(x) :- A(x). B(y) :- A(y). B(y) :- A(y), y > 1. }").domain("D")
    assert len(d.rules) == 2
    s = d.schema
    assert s.is_composite("A") and s.is_primitive("Integer") and not s.is_union("A")


def test_unions_enums_and_recursive_terms(spark):
    r = Engine(spark).load("""
    domain Shop {
      Item ::= new (no: Integer). Bag ::= new (top: Integer, under: Bag + {EMPTY}). Any ::= Item + Bag. Seen ::= new (a: Any).
      Grade ::= {7, "good", BEST}. Note ::= new (g: Grade, stars: {0..5}). Size ::= new (n: Integer). Pair ::= new (a: Integer, b: Integer). Odd ::= new (n: Integer).
      Bag(i, EMPTY) :- Item(i). Bag(i, b) :- Item(i), b is Bag(j, EMPTY), j < i. Seen(a) :- a is Any.
      Pair(a, b) :- Bag(a, Bag(b, EMPTY)). Size(n) :- n = count({ i, Bag(i, EMPTY), "x" | Item(i) }).
      Odd(n) :- Item(n); Note(_, n). Fine :- Note(BEST, _), no { q | q is Item(9) }.
    }
    model m of Shop { Item(4). Item(6). Note("good", 1). Note(BEST, 0). Note(7, 5). }""").solve("m")
    text = lambda n: sorted(x.term for x in r.text(n).collect())
    assert text("Bag") == ["Bag(4, EMPTY)", "Bag(6, Bag(4, EMPTY))", "Bag(6, EMPTY)"]
    assert text("Pair") == ["Pair(6, 4)"] and len(text("Seen")) == 5 and text("Size") == ["Size(5)"]
    assert text("Odd") == [f"Odd({n})" for n in (0, 1, 4, 5, 6)] and r.holds("Fine")
    with pytest.raises(TypeError_):
        Engine(spark).load("domain Shop { Note ::= new (stars: {0..5}). } model m of Shop { Note(6). }").solve("m")


def test_taking_terms_apart(spark):
    r = Engine(spark).load("""
    domain Expr {
      Num ::= new (v: Integer). Word ::= new (tag: String, w: Real). E ::= new (op: String, l: E + Num + Word + {NONE}, r: E + Num + Word + {NONE}). Sum ::= new (v: Integer). Name ::= new (n: String). Depth ::= new (n: Integer). Same ::= new (v: Integer).
      Sum(t) :- E("+", E("*", Num(a), Num(b)), Num(c)), t = a * b + c. Name(n) :- E(_, E(_, Word(n, w), _), _), w > 1.0.
      Depth(2) :- E(_, E(_, _, _), _). Depth(3) :- E(_, E(_, E(_, _, _), _), _). Same(v) :- E(_, E(_, Num(v), Num(v)), _).
    }
    model m of Expr { E("+", E("*", Num(3), Num(-4)), Num(5)). E("-", E("(", Word("a, b)", 2.5), NONE), NONE). E("-", E("(", Word("c", 0.5), NONE), Num(1)). E("+", E("*", Num(7), Num(7)), NONE). }""").solve("m")
    assert rows(r.flat("Sum")) == [(-7,)] and rows(r.flat("Name")) == [("a, b)",)] and rows(r.flat("Depth")) == [(2,)] and rows(r.flat("Same")) == [(7,)]


def test_conformance_and_transforms(spark):
    e = Engine(spark).load("""
    domain Tasks { Job ::= new (no: Integer). Before ::= new (a: Job, b: Job). late ::= new (a: Job, b: Job).
      late(x, y) :- Before(x, y); Before(x, z), late(z, y). conforms no late(x, x). }
    domain Plans extends Old:: Tasks, New:: Tasks { As ::= bij (a: Old.Job => b: New.Job). }
    model week of Tasks { wash is Job(1). dry is Job(2). iron is Job(3). Before(wash, dry). Before(dry, iron). }
    model knot of Tasks { Before(Job(5), Job(6)). Before(Job(6), Job(5)). }
    model both of Plans includes Old:: week, New:: week { As(Old.wash, New.iron). As(Old.dry, New.iron). }
    transform With (no: Integer, From:: Tasks) returns (To:: Tasks) { To.Job(%no). To._(x) :- From._(x). }
    transform After (no: Integer, From:: Tasks) returns (To:: Tasks) { To.Job(x) :- From.late(From.Job(y), From.Job(x)), y = %no. To.Before(a, b) :- From.Before(a, b), a.no >= %no. }
    rest = After(2, week).
    """)
    assert rows(e.solve("week").flat("late")) == [(1, 2), (1, 3), (2, 3)] and e.solve("week").conforms() and not e.solve("knot").conforms()
    held = {x.rule: x.holds for x in e.solve("both").conformance().collect()}
    assert held["As has each a once"] and not held["As has each b once"]
    assert rows(e.apply("more", "With", 100, "week")["To"].flat("Job")) == [(1,), (2,), (3,), (100,)]
    out = e.run_applications()["rest"]["To"]
    assert rows(out.flat("Before")) == [(2, 3)] and out.conforms()
    with pytest.raises(AnalysisError):
        e.apply("x", "With", "week")


def test_ranks_and_recursion_with_values(spark):
    r = Engine(spark).load("""
    domain Race { Time ::= new (s: Integer). Place ::= new (p: Integer, s: Integer). Halved ::= new (n: Integer). Best ::= new (s: Integer).
      Place(p, s) :- Time(s), o = toOrdinal(s, -1, { t | Time(t) }), p = o + 1. Best(s) :- s = minAll(0, { t | Time(t) }).
      Halved(s) :- Time(s). Halved(h) :- Halved(n), n > 1, h = n / 2. }
    model m of Race { Time(40). Time(38). Time(51). }""").solve("m")
    assert rows(r.flat("Place")) == [(1, 38), (2, 40), (3, 51)] and rows(r.flat("Best")) == [(38,)]
    assert rows(r.flat("Halved")) == [(n,) for n in (1, 2, 3, 4, 5, 6, 9, 10, 12, 19, 20, 25, 38, 40, 51)]
    with pytest.raises(DivergenceError):
        Engine(spark, max_rounds=4).load("domain T { N ::= new (n: Integer). N(b) :- N(a), b = 2 * a. } model m of T { N(1). }").solve("m")


def test_ordinals_over_ranges(spark, monkeypatch):
    from termlog.operators import aggregate

    monkeypatch.setattr(aggregate, "SAMPLE", 16)
    monkeypatch.setattr(aggregate, "RANGES", 4)
    values = random.Random(6).sample(range(-500, 500), 200)
    d = "domain T { V ::= new (n: %s). R ::= new (n: %s, o: Integer). R(v, o) :- V(v), o = toOrdinal(v, -1, { w | V(w) }). }"
    for kind, own in (("Integer", values), ("String", [f"k{v}" for v in values])):
        r = Engine(spark).load(d % (kind, kind)).run("T", {"V": spark.createDataFrame([(v,) for v in own])})
        assert rows(r.flat("R")) == [(v, i) for i, v in enumerate(sorted(own))]


def test_division_and_unary(spark):
    e = Engine(spark).load("""domain T { V ::= new (n: Integer). Q ::= new (n: Integer). D ::= new (n: Integer, q: Integer). S ::= new (s: Integer). F ::= new (b: Boolean). U ::= new (a: Integer, b: Integer).
      Q(b) :- V(a), b = a / 2. D(a, 12 / a) :- V(a). S(s) :- s = sum(0, { 12 / a | V(a) }). F(b) :- V(a), a = 0, b = !false. U(a, b) :- V(a), b = ~a. }
      model m of T { V(-7). V(7). V(0). V(-2). }""")
    r = e.solve("m")
    assert rows(r.flat("Q")) == [(-3,), (-1,), (0,), (3,)] and rows(r.flat("D")) == [(-7, -1), (-2, -6), (7, 1)]
    assert rows(r.flat("S")) == [(-6,)] and rows(r.flat("F")) == [(True,)] and rows(r.flat("U")) == [(-7, 6), (-2, 1), (0, -1), (7, -8)]
    with pytest.raises(TypeError_):
        Engine(spark).load("domain T { V ::= new (n: Integer). Q ::= new (n: Boolean). Q(b) :- V(a), b = !a. } model m of T { V(1). }").solve("m").flat("Q")


def test_rows_with_nulls_are_no_terms(spark):
    e = Engine(spark).load("domain D { K ::= new (a: Integer). P ::= new (k: K, v: Integer + String). Q ::= new (k: K). Q(k) :- P(k, _). }")
    df = spark.createDataFrame([(1, ("Integer", 5, None)), (2, ("String", None, "x")), (None, ("Integer", 1, None)), (3, None), (4, ("String", None, None))], "k int, v struct<tag: string, Integer: bigint, String: string>")
    assert rows(e.run("D", {"P": df}).flat("Q")) == [(1,), (2,)]


def test_strata_by_pattern(spark):
    r = Engine(spark).load("""domain D { A ::= new (x: Integer). P ::= new (k: Integer, x: Integer).
      P(1, x) :- A(x). P(2, x) :- P(1, x), no P(3, x). P(3, x) :- P(1, x), x > 5. P(4, y) :- P(2, x), y = x + 10. P(4, y) :- P(4, x), x < 13, y = x + 1. }
      model m of D { A(1). A(9). }""").solve("m")
    assert rows(r.flat("P")) == [(1, 1), (1, 9), (2, 1), (3, 9), (4, 11), (4, 12), (4, 13)]
    with pytest.raises(AnalysisError):
        Engine(spark).load("domain D { A ::= new (x: Integer). P ::= new (k: Integer, x: Integer). P(1, x) :- A(x), no P(2, x). P(2, x) :- A(x), no P(k, x). }").domain("D")


@pytest.mark.parametrize("seed", [1, 2])
def test_closure_against_plain_python(spark, seed):
    rng = random.Random(seed)
    within = {(rng.randrange(12), rng.randrange(12)) for _ in range(16)}
    needs, new = {(b, a) for a, b in within}, {(b, a) for a, b in within}
    while new:
        new = {(w, p) for q, w in within for x, p in new if x == q} - needs
        needs |= new
    e = Engine(spark).load(PARTS)
    r = e.run("Build", {"In": spark.createDataFrame([(a, b, 1) for a, b in sorted(within)], "a int, b int, n int"), "Thing": spark.range(12)})
    assert rows(r.flat("Needs")) == sorted(needs) and r.holds("Sound") == all(a != b for a, b in needs)
    assert rows(r.flat("Loose")) == [(n,) for n in range(12) if n not in {a for a, _ in within}]
    assert rows(r.flat("Kinds")) == [(n, sum(b == n for _, b in within)) for n in range(12)]


def test_random_graph_and_lists_and_term_table(spark):
    from pyspark.sql import functions as F

    g = random_graph(spark, 20, 30, seed=5)
    assert g["Edge"].distinct().count() == 30 and g["Node"].count() == 20
    e = Engine(spark).load(graph_program("Gen", "Node ::= new (id: Integer). Edge ::= new (src: Node, dst: Node).", 6, 10))
    assert e.solve("Gen_facts").relation("Edge").count() == 10
    df = spark.createDataFrame([([1, 2, 3],)], "xs array<int>")
    xs = F.col("xs")
    got = df.select(lists.length(xs), lists.nth(xs, 1), lists.nth(xs, 9), lists.reverse(xs), lists.append(xs, xs), lists.push(xs, F.lit(4)), lists.mapped(xs, lambda x: x * 2), lists.to_list_term(xs, "Cons", "NIL")).first()
    assert tuple(got) == (3, 2, None, [3, 2, 1], [1, 2, 3, 1, 2, 3], [1, 2, 3, 4], [2, 4, 6], "Cons(1, Cons(2, Cons(3, NIL)))")
    t = terms.table(spark, [parse_term("Pair(Wrap(Low(1, 2)), true)")])
    ids = spark.createDataFrame([("Pair(Wrap(Low(1, 2)), true)",)], "p string")
    inner = terms.destructure(ids, "p", t, "Pair", ["q", "r"])
    assert inner.first().q == "Wrap(Low(1, 2))" and t.count() == 6


def test_commands(spark, tmp_path):
    from termlog.__main__ import execute, split_commands

    (tmp_path / "b.txt").write_text(PARTS + "transform Keep (From:: Build) returns (To:: Build) { To.In(a, b, n) :- From.In(a, b, n). }")
    script = f"load {tmp_path / 'b.txt'} | query bike n = count({{ p | Needs(Thing(1), p) }}) | apply k = Keep(bike)\nrules Build | conforms bike | plans bike"
    commands = split_commands(script)
    assert len(commands) == 6 and commands[1].endswith("p) })")
    e, out = Engine(spark), []
    for c in commands:
        execute(e, c, out.append)
    assert out[0] == "n = 2" and out[1].startswith("k is To of Keep") and "stratum" in out[2] and "-- Needs" in out[-1]
    with pytest.raises(ValueError):
        execute(e, "nonsense", out.append)
