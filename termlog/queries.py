"""The driver's queries: programs over the driver tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lists
from .modules import Engine, Result
from .operators.groups import group_by, join_core
from .sources.generate import graph_program
from .sources.tables import random_graph, record, relation
from .streaming.session import Session
from .streaming.stream import attach

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Facts that programs may ask for: table, columns for the fields in order, filter.
FACTS = {
    "Nation": ("nation", ["n_nationkey", "n_name", "n_regionkey"], None),
    "Region": ("region", ["r_regionkey", "r_name"], None),
    "Customer": ("customer", ["c_custkey", "c_nationkey"], None),
    "Supplier": ("supplier", ["s_suppkey", "s_nationkey"], None),
    "Part": ("part", ["p_partkey", "p_brand", "p_size"], None),
    "Order": ("orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], None),
    "Line": ("lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "cast(l_quantity as bigint)"], None),
    "Square": ("nation", ["n_nationkey", "n_nationkey * n_nationkey % 25"], None),
    "Ring": ("nation", ["n_nationkey", "(2 * n_nationkey + 1) % 25"], None),
    "Home": ("customer", ["c_custkey", "nullif(c_nationkey, 3)"], None),
    "Parent": ("customer", ["c_custkey", "c_custkey div 3"], "c_custkey > 0"),
}
TYPES = """
  Nation ::= new (key: Integer, name: String, region: Integer).
  Region ::= new (key: Integer, name: String).
  Customer ::= new (key: Integer, nation: Integer).
  Supplier ::= new (key: Integer, nation: Integer).
  Part ::= new (key: Integer, brand: String, size: Integer).
  Order ::= new (key: Integer, cust: Integer, status: String, priority: String).
  Line ::= new (order: Integer, number: Integer, part: Integer, quantity: Integer).
  Home ::= new (cust: Integer, nation: Integer).
  Node ::= new (id: Integer).
  Square ::= new (src: Node, dst: Node).
  Ring ::= new (src: Node, dst: Node).
  Parent ::= new (src: Node, dst: Node).
"""
CUST = "(SELECT c_custkey AS src, c_custkey // 3 AS dst FROM customer WHERE c_custkey > 0)"
SQUARE = "(SELECT n_nationkey::BIGINT AS src, (n_nationkey * n_nationkey % 25)::BIGINT AS dst FROM nation)"
RING = "(SELECT n_nationkey::BIGINT AS src, ((2 * n_nationkey + 1) % 25)::BIGINT AS dst FROM nation)"


def base(spark: SparkSession, sf_dir: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: relation(spark.read.parquet(f"{sf_dir}/{t}.parquet"), c, w) for n in names for t, c, w in [FACTS[n]]}


def solve(spark: SparkSession, sf_dir: str, facts: list[str], program: str) -> Result:
    return Engine(spark).load(f"domain Q {{ {TYPES} {program} }}").run("Q", base(spark, sf_dir, facts))


def query(name: str, sql: str, facts: str = "", program: str = "", head: str = "", columns: str = ""):
    """Registers a program whose relation `head` is the result, or a function of (spark, sf_dir)."""
    SQL[name] = sql
    if program:
        QUERIES[name] = lambda spark, sf_dir: solve(spark, sf_dir, facts.split(), program).flat(head, columns.split() or None)
        return None

    def own(f):
        QUERIES[name] = f
        return f

    return own


def flag(spark: SparkSession, sf_dir: str, facts: str, program: str, heads: list[str]) -> DataFrame:
    """(name, holds) of nullary relations."""
    r = solve(spark, sf_dir, facts.split(), program)
    parts = [r.relations[h].agg((F.count("*") > 0).alias("holds")).select(F.lit(h).alias("name"), "holds") for h in heads]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# scans, patterns, expressions
query("proj_pattern", "SELECT DISTINCT n_name AS n FROM nation WHERE n_regionkey = 1", "Nation", "Out ::= new (n: String). Out(n) :- Nation(_, n, 1).", "Out")
query("self_loop", f"SELECT src AS a FROM {SQUARE} WHERE src = dst", "Square", "Loop ::= new (a: Node). Loop(a) :- Square(a, a).", "Loop")
query("nested_literal", f"SELECT dst AS b FROM {SQUARE} WHERE src = 3", "Square", "Out ::= new (b: Node). Out(b) :- Square(Node(3), b).", "Out")
query("arith", "SELECT n_nationkey::BIGINT AS a, (n_nationkey * n_nationkey + 1)::BIGINT AS b, (n_nationkey // 4 - 7)::BIGINT AS c FROM nation WHERE n_nationkey * n_nationkey + 1 < 400", "Nation", "Out ::= new (a: Integer, b: Integer, c: Integer). Out(a, b, c) :- Nation(a, _, _), b = a * a + 1, b < 400, c = a / 4 - 7.", "Out")
query("field_access", "SELECT DISTINCT o_custkey AS cust, o_orderpriority AS priority FROM orders WHERE o_orderstatus = 'F'", "Order", 'Out ::= new (cust: Integer, priority: String). Out(o.cust, p) :- o is Order(_, _, s, _), s = "F", p = o.priority.', "Out")
query("construct_unify", f"SELECT DISTINCT dst AS a, 100 + dst AS b FROM {RING}", "Ring", "Out ::= new (a: Integer, b: Node). Out(x, n) :- Ring(_, e), e = Node(x), y = x + 100, n = Node(y).", "Out")
query("type_range", "SELECT p_partkey AS k, p_size::BIGINT AS s FROM part WHERE p_size BETWEEN 10 AND 20", "Part", "Small ::= {10..20}. Out ::= new (k: Integer, s: Small). Out(k, s) :- Part(k, _, s), s : Small.", "Out")
query("disjunction", "SELECT n_nationkey::BIGINT AS k FROM nation WHERE n_regionkey = 0 UNION SELECT n_nationkey FROM nation WHERE n_regionkey = 3", "Nation", "Out ::= new (k: Integer). Out(k) :- Nation(k, _, 0); Nation(k, _, 3).", "Out")
query("comparison_ops", "SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey <= b.n_nationkey AND a.n_name != b.n_name AND b.n_nationkey >= 10", "Nation", "Out ::= new (a: Integer, b: Integer). Out(a, b) :- Nation(a, n, r), Nation(b, m, r), a <= b, n != m, b >= 10.", "Out")

# joins
query("two_hop", f"SELECT DISTINCT x.src AS a, y.dst AS c FROM {CUST} x JOIN {CUST} y ON x.dst = y.src", "Parent", "Hop ::= new (a: Node, c: Node). Hop(a, c) :- Parent(a, b), Parent(b, c).", "Hop")
query("triangle", "WITH e AS (SELECT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON (a.n_nationkey * 7 + b.n_nationkey * 3) % 5 = 0) SELECT x.src::BIGINT AS a, y.src::BIGINT AS b, z.src::BIGINT AS c FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src AND z.dst = x.src", "Nation", "E ::= new (src: Integer, dst: Integer). T ::= new (a: Integer, b: Integer, c: Integer). E(a, b) :- Nation(a, _, _), Nation(b, _, _), x = a * 7 + b * 3, x = x / 5 * 5. T(a, b, c) :- E(a, b), E(b, c), E(c, a).", "T")
query("star_join", "SELECT c_custkey AS c, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", "Customer Nation Region", "Loc ::= new (c: Integer, r: String). Loc(c, r) :- Customer(c, n), Nation(n, _, k), Region(k, r).", "Loc")
query("four_way", "SELECT DISTINCT l_partkey AS part, n_name AS nation FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE CAST(l_quantity AS BIGINT) > 45", "Line Order Customer Nation", "Out ::= new (part: Integer, nation: String). Out(p, m) :- Line(o, _, p, q), Order(o, c, _, _), Customer(c, n), Nation(n, m, _), q > 45.", "Out")
query("theta", "SELECT DISTINCT a.o_custkey AS c, a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey > b.o_orderkey WHERE a.o_orderstatus = 'P' AND b.o_orderstatus = 'P'", "Order", 'Out ::= new (c: Integer, x: Integer, y: Integer). Out(c, x, y) :- Order(x, c, "P", _), Order(y, c, "P", _), x > y.', "Out")
query("cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b", "Region", "Out ::= new (a: String, b: String). Out(a, b) :- Region(_, a), Region(_, b).", "Out")
query("field_join", "SELECT DISTINCT o_orderkey AS o, c_nationkey::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey", "Order Customer", "Out ::= new (o: Integer, n: Integer). Out(o.key, n) :- o is Order(_, _, _, _), Customer(o.cust, n).", "Out")
query("semi_join", "SELECT c_custkey AS c FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", "Customer Order", 'Out ::= new (c: Integer). Out(c) :- Customer(c, _), Order(_, c, "P", _).', "Out")
query("anti_join", "SELECT c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", "Customer Order", 'Out ::= new (c: Integer). Out(c) :- Customer(c, _), no Order(_, c, "P", _).', "Out")
query("intersect_rel", f"SELECT a.n_nationkey::BIGINT AS a, b.n_nationkey::BIGINT AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey INTERSECT SELECT src, dst FROM {SQUARE}", "Square Nation", "Near ::= new (a: Node, b: Node). Out ::= new (a: Node, b: Node). Near(Node(x), Node(y)) :- Nation(x, _, r), Nation(y, _, r). Out(a, b) :- Square(a, b), Near(a, b).", "Out")


@query("global_neg", f"WITH RECURSIVE p AS (SELECT src, dst FROM {CUST} UNION SELECT p.src, e.dst FROM p JOIN {CUST} e ON p.dst = e.src) SELECT 'Acyclic' AS name, NOT EXISTS (SELECT 1 FROM p WHERE src = dst) AS holds UNION ALL SELECT 'RingFree', NOT EXISTS (SELECT 1 FROM {RING} WHERE src = dst)")
def global_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag(spark, sf_dir, "Parent Ring", "Path ::= new (a: Node, b: Node). Path(a, b) :- Parent(a, b). Path(a, c) :- Path(a, b), Path(b, c). Acyclic :- no Path(u, u). RingFree :- no Ring(u, u).", ["Acyclic", "RingFree"])


@query("nullary_body", "SELECT 'Hello' AS name, EXISTS (SELECT 1 FROM nation) AS holds UNION ALL SELECT 'Goodbye', EXISTS (SELECT 1 FROM nation WHERE n_regionkey = 1) UNION ALL SELECT 'Never', false")
def nullary_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag(spark, sf_dir, "Nation", "Hello :- Nation(_, _, _). Goodbye :- Nation(_, _, 1), Hello. Never :- Nation(_, _, 77), Hello.", ["Hello", "Goodbye", "Never"])


@query("multi_head", f"SELECT DISTINCT term FROM (SELECT 'A(' || src || ')' AS term FROM {SQUARE} UNION ALL SELECT 'B(' || dst || ')' FROM {SQUARE})")
def multi_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = solve(spark, sf_dir, ["Square"], "A ::= new (x: Integer). B ::= new (x: Integer). U ::= A + B. Out ::= new (u: U). A(x), B(y) :- Square(Node(x), Node(y)). Out(u) :- u is U.")
    return r.flat("Out", ["term"])


# aggregates
query("agg_count_corr", "SELECT c_custkey AS c, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey", "Customer Order", 'Out ::= new (c: Integer, n: Integer). Out(c, n) :- Customer(c, _), n = count({ o | o is Order(_, c, "P", _) }).', "Out")
query("agg_sum_set", "SELECT o_orderkey AS o, coalesce(sum(DISTINCT CAST(l_quantity AS BIGINT)), 0)::BIGINT AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey", "Order Line", "Out ::= new (o: Integer, s: Integer). Out(o, s) :- Order(o, _, _, _), s = sum(0, { q | Line(o, _, _, q) }).", "Out")
query("agg_minmax_default", "SELECT c_custkey AS c, coalesce(min(o_orderkey), -1) AS lo, coalesce(max(o_orderkey), -2) AS hi FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey", "Customer Order", 'Out ::= new (c: Integer, lo: Integer, hi: Integer). Out(c, lo, hi) :- Customer(c, _), lo = minAll(-1, { o | Order(o, c, "P", _) }), hi = maxAll(-2, { o | Order(o, c, "P", _) }).', "Out")
query("agg_nested", "SELECT c_nationkey::BIGINT AS n, count(*) FILTER (WHERE k > 10) AS m FROM (SELECT c_nationkey, c_custkey, count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) GROUP BY c_nationkey", "Customer Order", "Out ::= new (n: Integer, m: Integer). Out(n, m) :- Customer(_, n), m = count({ c | Customer(c, n), count({ o | o is Order(_, c, _, _) }) > 10 }).", "Out")
query("agg_union_head", f"SELECT count(DISTINCT x) AS n FROM (SELECT src::VARCHAR AS x FROM {SQUARE} UNION ALL SELECT dst::VARCHAR FROM {SQUARE} UNION ALL SELECT 'n' || src FROM {SQUARE} UNION ALL SELECT 'hello')", "Square", 'Out ::= new (n: Integer). Out(n) :- n = count({ x, y, Node(x), "hello" | Square(Node(x), Node(y)) }).', "Out")
query("agg_compare", "SELECT c_nationkey::BIGINT AS n FROM customer GROUP BY c_nationkey HAVING count(*) * 2 > 1 + (SELECT count(*) FROM nation WHERE n_regionkey = 1) * 20", "Customer Nation", "Out ::= new (n: Integer). Out(n) :- Customer(_, n), count({ c | Customer(c, n) }) * 2 > 1 + count({ k | Nation(k, _, 1) }) * 20.", "Out")
query("rank_ordinal", "SELECT n_nationkey::BIGINT AS n, (SELECT count(DISTINCT m.n_name) FROM nation m WHERE m.n_name < nation.n_name)::BIGINT AS rank FROM nation", "Nation", "Out ::= new (n: Integer, rank: Integer). Out(n, o) :- Nation(n, name, _), o = toOrdinal(name, -1, { m | Nation(_, m, _) }).", "Out")
query("set_negation", f"SELECT n_nationkey::BIGINT AS n FROM nation WHERE NOT EXISTS (SELECT 1 FROM {SQUARE} WHERE dst = n_nationkey AND src != n_nationkey)", "Nation Square", "Out ::= new (n: Integer). Out(n) :- Nation(n, _, _), no { x | Square(Node(x), Node(n)), x != n }.", "Out")
query("social_scores", "WITH c AS (SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey), s AS (SELECT c_nationkey AS nation, coalesce(sum(DISTINCT n), 0) AS likes, 10 * count(DISTINCT c_custkey) AS size FROM customer JOIN c ON id = c_custkey GROUP BY c_nationkey) SELECT n_nationkey::BIGINT AS nation, coalesce(likes, 0)::BIGINT AS likes, (coalesce(likes, 0) + coalesce(size, 0))::BIGINT AS total FROM nation LEFT JOIN s ON nation = n_nationkey", "Nation Customer Order", "Score ::= new (c: Integer, nation: Integer, n: Integer). Likes ::= new (nation: Integer, v: Integer). Size ::= new (nation: Integer, v: Integer). Total ::= new (nation: Integer, likes: Integer, total: Integer). Score(c.key, c.nation, n) :- c is Customer(_, _), n = count({ o | o is Order(_, c.key, _, _) }). Likes(p.key, v) :- p is Nation(_, _, _), v = sum(0, { k | Score(_, p.key, k) }). Size(p.key, v) :- p is Nation(_, _, _), k = count({ c | c is Customer(_, p.key) }), v = k * 10. Total(a.nation, a.v, t) :- a is Likes(_, _), b is Size(a.nation, _), t = a.v + b.v.", "Total")


@query("agg_global", "SELECT 'TwentyFive' AS name, (SELECT count(*) FROM nation) = 25 AS holds UNION ALL SELECT 'Half', (SELECT count(*) FROM region) * 2 = (SELECT count(*) FROM nation)")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flag(spark, sf_dir, "Nation Region", "TwentyFive :- count({ n | n is Nation(_, _, _) }) = 25. Half :- count({ r | r is Region(_, _) }) * 2 = count({ n | n is Nation(_, _, _) }).", ["TwentyFive", "Half"])


@query("agg_topk", "SELECT r, k, x FROM (SELECT n_regionkey::BIGINT AS r, c_custkey AS x, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey DESC) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE k <= 3 UNION ALL SELECT r, -k, x FROM (SELECT n_regionkey::BIGINT AS r, c_custkey AS x, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE k <= 2")
def agg_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = solve(spark, sf_dir, ["Customer", "Nation", "Region"], "")
    found = r.query("Region(r, _), top = topK(3, { c | Customer(c, n), Nation(n, _, r) }), low = bottomK(2, { c | Customer(c, n), Nation(n, _, r) })", ["r", "top", "low"])
    return found.select("r", F.posexplode("top").alias("i", "x")).select("r", (F.col("i") + 1).cast("bigint").alias("k"), "x").unionByName(found.select("r", F.posexplode("low").alias("i", "x")).select("r", (-1 - F.col("i")).cast("bigint").alias("k"), "x"))


# recursion
CLOSURE = "WITH RECURSIVE p AS (SELECT src, dst FROM {e} UNION SELECT p.src, e.dst FROM p JOIN {e} e ON p.dst = e.src) "
PATH = "Path ::= new (src: Node, dst: Node). Path(a, b) :- {e}(a, b). Path(a, c) :- {first}(a, b), Path(b, c)."
query("closure_nonlinear", CLOSURE.format(e=CUST) + "SELECT src, dst FROM p", "Parent", PATH.format(e="Parent", first="Path"), "Path")
query("closure_linear", CLOSURE.format(e=RING) + "SELECT src, dst FROM p", "Ring", PATH.format(e="Ring", first="Ring"), "Path")
query("closure_ring", CLOSURE.format(e=RING) + "SELECT src, dst FROM p", "Ring", PATH.format(e="Ring", first="Path"), "Path")
query("mutual_rec", f"WITH RECURSIVE p(src, dst, odd) AS (SELECT src, dst, true FROM {RING} UNION SELECT p.src, e.dst, NOT p.odd FROM p JOIN {RING} e ON p.dst = e.src) SELECT src, dst FROM p WHERE NOT odd", "Ring", "Odd ::= new (src: Node, dst: Node). Even ::= new (src: Node, dst: Node). Odd(a, b) :- Ring(a, b). Odd(a, c) :- Even(a, b), Ring(b, c). Even(a, c) :- Odd(a, b), Ring(b, c).", "Even")
query("gen_rec", "SELECT range AS n FROM range(3, 50)", "Nation", "N ::= new (n: Integer). N(3) :- Nation(3, _, _). N(b) :- N(a), b = a + 1, b < 50.", "N")
query("no_cycle", CLOSURE.format(e=SQUARE) + "SELECT src AS n FROM " + SQUARE + " s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.src = s.src AND p.dst = s.src)", "Square", PATH.format(e="Square", first="Path") + " Out ::= new (n: Node). Out(u) :- Square(u, _), no Path(u, u).", "Out")
query("hops_k", f"SELECT DISTINCT x.src AS a, z.dst AS d FROM {RING} x JOIN {RING} y ON x.dst = y.src JOIN {RING} z ON y.dst = z.src", "Ring", "Out ::= new (a: Node, d: Node). Out(a, d) :- Ring(a, b), Ring(b, c), Ring(c, d).", "Out")
query("rec_negation", CLOSURE.format(e=RING) + f", q AS (SELECT p.src, p.dst FROM p WHERE NOT EXISTS (SELECT 1 FROM {SQUARE} s WHERE s.src = p.dst AND s.dst = p.src)) SELECT src, count(*) AS n FROM q GROUP BY src", "Ring Square", PATH.format(e="Ring", first="Path") + " Q ::= new (a: Node, b: Node). Out ::= new (src: Node, n: Integer). Q(a, b) :- Path(a, b), no Square(b, a). Out(a, n) :- Q(a, _), n = count({ b | Q(a, b) }).", "Out")


# modules, sessions
@query("conforms", f"SELECT 'no Ring(u, u)' AS rule, NOT EXISTS (SELECT 1 FROM {RING} WHERE src = dst) AS holds UNION ALL SELECT 'count({{ n | n is Node(_) }}) = 25', (SELECT count(*) FROM nation) = 25 UNION ALL SELECT 'requires atleast 5 Ring', (SELECT count(*) FROM nation) >= 5".replace("{{", "{").replace("}}", "}"))
def conforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = base(spark, sf_dir, ["Ring"])
    facts["Node"] = facts["Ring"].select("_0")
    return Engine(spark).load(f"domain Q {{ {TYPES} conforms no Ring(u, u). conforms count({{ n | n is Node(_) }}) = 25. requires atleast 5 Ring. }}").run("Q", facts).conformance()


@query("transform_shift", f"SELECT src + 100 AS src, dst + 100 AS dst FROM {RING} WHERE dst > src")
def transform_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark).load("domain Road { Town ::= new (no: Integer). Way ::= new (src: Town, dst: Town). } transform Renumber (by: Integer, Old:: Road) returns (New:: Road) { New.Way(New.Town(x), New.Town(y)) :- Old.Way(Old.Town(a), Old.Town(b)), b > a, x = a + %by, y = b + %by. }")
    ring = base(spark, sf_dir, ["Ring"])["Ring"]
    e.made["roads"] = ("Road", e.run("Road", {"Town": ring.select("_0"), "Way": ring}).relations.known)
    return e.apply("renumbered", "Renumber", 100, "roads")["New"].flat("Way")


@query("renamed_domains", f"SELECT 'L' AS side, count(*) AS n FROM (SELECT DISTINCT x.src, y.dst FROM {RING} x JOIN {RING} y ON x.dst = y.src) UNION ALL SELECT 'R', count(*) FROM (SELECT DISTINCT x.src, y.dst FROM {SQUARE} x JOIN {SQUARE} y ON x.dst = y.src)")
def renamed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark).load("domain G { V ::= new (lbl: Integer). E ::= new (src: V, dst: V). Hop ::= new (src: V, dst: V). Hop(a, c) :- E(a, b), E(b, c). } domain Two extends L:: G, R:: G { Out ::= new (side: String, n: Integer). Out(\"L\", n) :- n = count({ h | h is L.Hop(_, _) }). Out(\"R\", n) :- n = count({ h | h is R.Hop(_, _) }). }")
    facts = base(spark, sf_dir, ["Ring", "Square"])
    return e.run("Two", {"L.E": facts["Ring"], "R.E": facts["Square"]}).flat("Out")


# the whole of Parent: batches by the customers' nations, with SQL of their own
WHOLE = "(SELECT c_custkey AS src, c_custkey // 3 AS dst, c_nationkey AS nation FROM customer WHERE c_custkey > 0)"
WHOLE_PATHS = "p AS (SELECT src, dst FROM o UNION SELECT p.src, o.dst FROM p JOIN o ON p.dst = o.src), q AS (SELECT src, dst FROM n UNION SELECT q.src, n.dst FROM q JOIN n ON q.dst = n.src)"


def whole_session(spark: SparkSession, sf_dir: str) -> tuple[Session, Callable[[str], DataFrame]]:
    """A session over all Parent facts but those of nation 7, and the facts by a condition on the nation."""
    facts = base(spark, sf_dir, ["Parent", "Customer"])

    def of(nation: str) -> DataFrame:
        return facts["Parent"].join(facts["Customer"].where(f"_1 {nation}").select("_0"), "_0", "left_semi")

    e = Engine(spark).load(f"domain Q {{ {TYPES} {PATH.format(e='Parent', first='Path')} }}")
    return Session(e, "Q", {"Parent": of("!= 7")}), of


@query("delta_changes", f"WITH RECURSIVE o AS (SELECT src, dst FROM {WHOLE} WHERE nation != 7), n AS (SELECT src, dst FROM {WHOLE} WHERE nation != 3), {WHOLE_PATHS} SELECT src, dst, 1 AS weight FROM (SELECT * FROM q EXCEPT SELECT * FROM p) UNION ALL SELECT src, dst, -1 FROM (SELECT * FROM p EXCEPT SELECT * FROM q)")
def delta_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, of = whole_session(spark, sf_dir)
    s.begin()
    s.delete("Parent", of("= 3"))
    s.insert("Parent", of("= 7"))
    s.commit()
    return s.changes("Path").select(F.col("src.id").alias("src"), F.col("dst.id").alias("dst"), "weight")


@query("insert_changes", f"WITH RECURSIVE o AS (SELECT src, dst FROM {WHOLE} WHERE nation != 7), n AS (SELECT src, dst FROM {WHOLE}), {WHOLE_PATHS} SELECT src, dst, 1 AS weight FROM (SELECT * FROM q EXCEPT SELECT * FROM p)")
def insert_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, of = whole_session(spark, sf_dir)
    s.begin().insert("Parent", of("= 7"))
    s.commit()
    return s.changes("Path").select(F.col("src.id").alias("src"), F.col("dst.id").alias("dst"), "weight")


# tables with nulls, partial operators, strata by pattern
query("null_fields", "SELECT c_custkey AS c, c_nationkey::BIGINT AS n FROM customer WHERE c_nationkey != 3", "Home", "Out ::= new (c: Integer, n: Integer). Out(c, n) :- Home(c, n).", "Out")
@query("null_closure", CLOSURE.format(e="(SELECT * FROM " + SQUARE + " WHERE dst != 4)") + "SELECT src, dst FROM p")
def null_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closure over edges some of whose ends are null: rows with a null are no terms."""
    edges = base(spark, sf_dir, ["Square"])["Square"].selectExpr("_0", "nullif(_1, 4)")
    return Engine(spark).load(f"domain Q {{ {TYPES} {PATH.format(e='Square', first='Path')} }}").run("Q", {"Square": edges}).flat("Path")


@query("null_updates", "SELECT src, dst, -1 AS weight FROM " + RING + " WHERE src < 5 AND dst != 7")
def null_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session over rows with nulls: what was never a term is neither deleted nor a change."""
    ring = base(spark, sf_dir, ["Ring"])["Ring"].selectExpr("_0", "nullif(_1, 7) as _1")
    s = Session(Engine(spark).load(f"domain Q {{ {TYPES} }}"), "Q", {"Ring": ring})
    s.begin().commit()
    assert s.changes("Ring").isEmpty()
    s.begin().delete("Ring", ring.where("_0 < 5"))
    s.commit()
    return s.changes("Ring").select(F.col("src.id").alias("src"), F.col("dst.id").alias("dst"), "weight")


query("unary_ops", "SELECT n_nationkey::BIGINT AS k, (-n_nationkey)::BIGINT AS neg, (~n_nationkey)::BIGINT AS inv FROM nation", "Nation", "Out ::= new (k: Integer, neg: Integer, inv: Integer). Out(k, a, b) :- Nation(k, _, _), a = -k, b = ~k.", "Out")
query("division_by_zero", "SELECT n_nationkey::BIGINT AS k, (100 // n_regionkey)::BIGINT AS q FROM nation WHERE n_regionkey != 0", "Nation", "Out ::= new (k: Integer, q: Integer). Out(k, q) :- Nation(k, _, r), q = 100 / r.", "Out")
query("pattern_strata", "SELECT 1 AS kind, n_nationkey::BIGINT AS x FROM nation UNION ALL SELECT 3, n_nationkey FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 2, n_nationkey FROM nation WHERE n_regionkey != 2", "Nation", "Mark ::= new (kind: Integer, x: Integer). Mark(1, x) :- Nation(x, _, _). Mark(2, x) :- Mark(1, x), no Mark(3, x). Mark(3, x) :- Mark(1, x), Nation(x, _, 2).", "Mark")
query("ordinal_all", "SELECT o_orderkey AS o, row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS fromtop FROM orders", "Order", "Out ::= new (o: Integer, fromtop: Integer). Out(o, t) :- Order(o, _, _, _), n = toOrdinal(o, 0, { x | Order(x, _, _, _) }), m = count({ x | Order(x, _, _, _) }), t = m - n - 1.", "Out")
query("absence_as_count", f"SELECT n_nationkey::BIGINT AS n FROM nation WHERE n_nationkey NOT IN (SELECT dst FROM {SQUARE})", "Nation Square", "Out ::= new (n: Integer). Out(n) :- Nation(n, _, _), c = count({ x | Square(x, Node(n)) }), c = 0.", "Out")
query("state_search", "WITH RECURSIVE s(a, b) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT unnest([7, a, 0, a, a - least(a, 5 - b), a + least(b, 7 - a)]), unnest([b, 5, b, 0, b + least(a, 5 - b), b - least(b, 7 - a)]) FROM s) SELECT a, b FROM s", "Nation", "Jugs ::= new (a: Integer, b: Integer). Jugs(0, 0) :- Nation(0, _, _). Jugs(7, b), Jugs(a, 5), Jugs(0, b), Jugs(a, 0) :- Jugs(a, b). Jugs(0, t) :- Jugs(a, b), t = a + b, t <= 5. Jugs(r, 5) :- Jugs(a, b), t = a + b, t > 5, r = t - 5. Jugs(t, 0) :- Jugs(a, b), t = a + b, t <= 7. Jugs(7, r) :- Jugs(a, b), t = a + b, t > 7, r = t - 7.", "Jugs")


@query("recursive_terms", "SELECT DISTINCT n_regionkey::BIGINT AS a, n_nationkey::BIGINT AS b, n_name AS name FROM nation")
def recursive_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms built by rules and taken apart again, through three levels."""
    r = solve(spark, sf_dir, ["Nation"], "Leaf ::= new (name: String). Chain ::= new (no: Integer, of: Leaf, rest: Chain + {END}). Out ::= new (a: Integer, b: Integer, name: String). Chain(k, l, END) :- Nation(k, n, _), l = Leaf(n). Chain(r, Leaf(\"region, (so)\"), c) :- c is Chain(k, Leaf(n), END), Nation(k, n, r). Out(a, b, n) :- Chain(a, _, Chain(b, Leaf(n), END)).")
    return r.flat("Out")


@query("pattern_lookup", CLOSURE.format(e=RING) + "SELECT 'lookup' AS way, dst FROM p WHERE src = 3 UNION ALL SELECT 'pattern', dst FROM p WHERE src = 3")
def pattern_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of one key, by a filter and by a pattern."""
    r = solve(spark, sf_dir, ["Ring"], PATH.format(e="Ring", first="Path"))
    found = r.lookup("Path", src=3).select(F.lit("lookup").alias("way"), "dst")
    return found.unionByName(r.query("Path(Node(3), Node(y))", ["y"]).select(F.lit("pattern").alias("way"), F.col("y").alias("dst")))


# raw operations on groups and keys
@query("raw_groups", "SELECT o_custkey AS c, count(*) AS n, sum(o_orderkey)::BIGINT AS total, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS kinds FROM orders GROUP BY o_custkey")
def raw_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = base(spark, sf_dir, ["Order"])["Order"].toDF("o", "c", "status", "priority")
    g = group_by(orders, "c")
    return g.group_count().join(g.group_sum("o"), "c").join(g.group_to_set("status", "kinds"), "c").select("c", "n", "total", F.array_join("kinds", ",").alias("kinds"))


@query("raw_join", "SELECT DISTINCT c_nationkey::BIGINT AS nation, o_orderpriority AS priority FROM customer JOIN orders ON c_custkey = o_custkey")
def raw_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = base(spark, sf_dir, ["Customer", "Order"])
    return join_core(facts["Customer"].toDF("c", "nation"), facts["Order"].toDF("o", "c", "status", "priority"), ["c"], F.col("nation").cast("bigint").alias("nation"), "priority")


# models, wildcards, unions, sources
@query("model_facts", "SELECT * FROM (VALUES (1, 2), (2, 9), (5, 1)) v(src, dst)")
def model_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that includes another, its facts under aliases."""
    e = Engine(spark).load("domain Roads { Town ::= new (no: Integer). Way ::= new (src: Town, dst: Town). } model west of Roads { a is Town(1). b is Town(2). Way(a, b). } model all of Roads includes west { c is Town(9). Way(b, c). Way(Town(5), a). Town(1). }")
    return e.solve("all").flat("Way").selectExpr("cast(src as int) as src", "cast(dst as int) as dst")


@query("wildcard_copy", f"SELECT 'Town' AS kind, count(DISTINCT src) AS n FROM {RING} UNION ALL SELECT 'Way', count(*) FROM {RING}")
def wildcard_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform that copies every constructor by one rule."""
    e = Engine(spark).load("domain Road { Town ::= new (no: Integer). Way ::= new (src: Town, dst: Town). } transform Same (Old:: Road) returns (New:: Road) { New._(x) :- Old._(x). }")
    ring = base(spark, sf_dir, ["Ring"])["Ring"]
    e.made["roads"] = ("Road", e.run("Road", {"Town": ring.select("_0"), "Way": ring}).relations.known)
    out = e.apply("copied", "Same", "roads")["New"]
    return out.relation("Town").agg(F.count("*").alias("n")).select(F.lit("Town").alias("kind"), "n").unionByName(out.relation("Way").agg(F.count("*").alias("n")).select(F.lit("Way").alias("kind"), "n"))


@query("nested_union", "SELECT 'Region(' || r_regionkey || ', \"' || r_name || '\")' AS term FROM region UNION ALL SELECT 'Customer(' || c_custkey || ', ' || c_nationkey || ')' FROM customer WHERE c_nationkey < 2 UNION ALL SELECT 'Small(' || s_suppkey || ')' FROM supplier WHERE s_nationkey = 1")
def nested_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = solve(spark, sf_dir, ["Region", "Customer", "Supplier"], "Small ::= new (no: Integer). Place ::= Region + Small. Thing ::= Place + Customer. Held ::= new (t: Thing). Small(s) :- Supplier(s, 1). Held(t) :- t is Thing, t : Place. Held(t) :- t is Customer(_, n), n < 2.")
    return r.flat("Held", ["term"])


@query("random_graph_size", "SELECT 50::BIGINT AS nodes, 120::BIGINT AS edges, true AS inside")
def random_graph_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = random_graph(spark, 50, 120, seed=9)
    return g["Node"].agg(F.count("*").alias("nodes")).crossJoin(g["Edge"].distinct().agg(F.count("*").alias("edges"), F.max(F.greatest("src", "dst") < 50).alias("inside")))


@query("generated_program", "SELECT 12::BIGINT AS nodes, 30::BIGINT AS edges")
def generated_program(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program made as text, parsed and solved."""
    e = Engine(spark).load(graph_program("Gen", "Node ::= new (id: Integer). Edge ::= new (src: Node, dst: Node). Size ::= new (nodes: Integer, edges: Integer). Size(n, m) :- n = count({ x | x is Node(_) }), m = count({ x | x is Edge(_, _) }).", 12, 30, seed=4))
    return e.solve("Gen_facts").flat("Size")


@query("record_facts", "SELECT * FROM (VALUES (4, 8), (8, 15)) v(src, dst)")
def record_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts from nested records, inserted as terms."""
    s = Session(Engine(spark).load(f"domain Q {{ {TYPES} }}"), "Q").begin()
    for x in ({"Ring": {"src": {"Node": 4}, "dst": {"Node": [8]}}}, {"Ring": [{"Node": 8}, {"Node": 15}]}):
        s.insert(record(x))
    s.commit()
    return s.result.flat("Ring").selectExpr("cast(src as int) as src", "cast(dst as int) as dst")


@query("list_functions", "SELECT r, n, array_to_string(list_reverse(keys), ',') AS backwards, keys[2] AS second, array_to_string(list_append(keys, 99), ',') AS longer FROM (SELECT n_regionkey::BIGINT AS r, count(*) AS n, list(n_nationkey::BIGINT ORDER BY n_nationkey) AS keys FROM nation GROUP BY n_regionkey)")
def list_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = base(spark, sf_dir, ["Nation"])["Nation"].selectExpr("cast(_2 as bigint) as r", "cast(_0 as bigint) as k")
    keys, text = F.col("keys"), lambda xs: F.array_join(xs.cast("array<string>"), ",")
    return group_by(nations, "r").group_to_set("k", "keys").select("r", lists.length(keys).alias("n"), text(lists.reverse(keys)).alias("backwards"), lists.nth(keys, 1).alias("second"), text(lists.push(keys, F.lit(99).cast("bigint"))).alias("longer"))


# sessions: scripts, rollback, keys, streams
@query("command_script", "SELECT * FROM (VALUES ('Hop(Node(20), Node(40))', 1), ('Hop(Node(30), Node(50))', 1), ('Hop(Node(20), Node(40))', -1)) v(term, weight)")
def command_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Session(Engine(spark).load(f"domain Q {{ {TYPES} Hop ::= new (src: Node, dst: Node). Hop(a, c) :- Ring(a, b), Ring(b, c). }}"), "Q")
    both = s.execute("start; insert Ring(Node(20), Node(30)); commit; start; insert Ring(Node(30), Node(40)), insert Ring(Node(40), Node(50)); commit dump_changes; start; insert Ring(Node(1), Node(1)); rollback; start; delete Ring(Node(20), Node(30)); commit dump_changes;")
    return both[0].unionByName(both[1]).where("relation = 'Hop'").select("term", "weight")


@query("rollback_and_keys", f"SELECT src, dst, -1 AS weight FROM {RING} WHERE src IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def rollback_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was rolled back leaves no trace; a deletion by key takes every row of the key."""
    facts = base(spark, sf_dir, ["Ring", "Nation"])
    s = Session(Engine(spark).load(f"domain Q {{ {TYPES} }}"), "Q", {"Ring": facts["Ring"]}).begin()
    s.insert("Ring", facts["Ring"].selectExpr("_1", "_0"))
    s.rollback()
    s.begin().delete_key("Ring", facts["Nation"].where("_2 = 2").select(F.struct(F.col("_0").cast("bigint").alias("id")).alias("src")))
    s.commit()
    return s.changes("Ring").select(F.col("src.id").alias("src"), F.col("dst.id").alias("dst"), "weight")


@query("stream_epochs", CLOSURE.format(e=RING) + "SELECT src, dst FROM p")
def stream_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that arrive as a stream; each micro-batch is a transaction."""
    s = Session(Engine(spark).load(f"domain Q {{ {TYPES} {PATH.format(e='Ring', first='Path')} }}"), "Q")
    nations = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/nation.parquet").schema).option("pathGlobFilter", "nation.parquet").parquet(sf_dir)
    ring = nations.selectExpr("n_nationkey as _0", "(2 * n_nationkey + 1) % 25 as _1")
    attach(s, ring, "Ring", f"{s.store.base}/stream", trigger={"availableNow": True}).awaitTermination()
    return s.result.flat("Path")
