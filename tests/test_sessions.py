import random

import pytest

from termlog.modules import Engine
from termlog.streaming import session
from termlog.streaming.session import Session, TransactionError
from termlog.streaming.stream import attach

PATHS = "domain G { Stop ::= new (no: Integer). Bus ::= new (at: Stop, to: Stop). Trip ::= new (at: Stop, to: Stop). Oneway ::= new (s: Stop). Trip(a, b) :- Bus(a, b). Trip(a, c) :- Bus(a, b), Trip(b, c). Oneway(s) :- Bus(s, _), no Trip(s, s). }"


def terms(df):
    return sorted((r.term, r.weight) for r in df.where("relation = 'Trip'").collect())


def test_script_changes_and_rollback(spark):
    s = Session(Engine(spark).load(PATHS), "G")
    added, gone = s.execute("""
      start; insert Bus(Stop(4), Stop(5)), insert Bus(Stop(6), Stop(8)); commit;
      start; insert Bus(Stop(5), Stop(6)); commit dump_changes;
      start; delete Bus(Stop(6), Stop(8)); commit dump_changes;
      start; insert Bus(Stop(7), Stop(7)); rollback;""")
    assert terms(added) == [(f"Trip(Stop({a}), Stop({b}))", 1) for a, b in ((4, 6), (4, 8), (5, 6), (5, 8))]
    assert terms(gone) == [(f"Trip(Stop({a}), Stop(8))", -1) for a in (4, 5, 6)]
    assert s.query("Bus(Stop(7), x)").isEmpty()
    with pytest.raises(TransactionError):
        s.commit()


def test_incremental_equals_recomputed(spark):
    rng, e, edges = random.Random(3), Engine(spark).load(PATHS), set()
    s, seen = Session(e, "G"), []
    s.on_change(lambda name, df: seen.append(name))
    for k in range(3):
        new = {(rng.randrange(7), rng.randrange(7)) for _ in range(4)}
        old = set(sorted(edges)[:2]) if k == 1 else set()
        s.begin()
        if old:
            s.delete("Bus", spark.createDataFrame(sorted(old), "a int, b int"))
        s.insert("Bus", spark.createDataFrame(sorted(new), "a int, b int"))
        s.commit()
        edges = edges - old | new
        whole = e.run("G", {"Bus": spark.createDataFrame(sorted(edges), "a int, b int")})
        for name in ("Trip", "Oneway"):
            assert sorted(map(tuple, s.result.flat(name).collect())) == sorted(map(tuple, whole.flat(name).collect()))
    assert "Trip" in seen
    s.begin()
    s.delete_key("Bus", s.relation("Bus").select("at").distinct())
    s.commit()
    assert s.relation("Trip").isEmpty()


def test_stream_of_updates(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([(1, 2, 1), (2, 3, 1)], "src int, dst int, weight int").coalesce(1).write.parquet(str(source))
    s, got = Session(Engine(spark).load(PATHS), "G"), []
    stream = spark.readStream.schema("src int, dst int, weight int").parquet(str(source))
    q = attach(s, stream, "Bus", str(tmp_path / "state"), sink=lambda df, n: got.append(df.count()), trigger={"availableNow": True})
    q.awaitTermination(120)
    assert s.relation("Trip").count() == 3 and got and got[0] > 0


def test_nulls_are_no_changes(spark):
    s = Session(Engine(spark).load(PATHS), "G", {"Bus": spark.createDataFrame([(1, 2), (2, 1), (1, None)], "a int, b int")})
    assert s.relation("Trip").count() == 4
    s.begin().commit()
    assert s.all_changes().isEmpty()
    s.begin().delete("Bus", spark.createDataFrame([(1, None), (2, 1)], "a int, b int"))
    s.commit()
    assert sorted(map(tuple, s.changes("Bus").selectExpr("at.no", "to.no", "weight").collect())) == [(2, 1, -1)]


def test_many_commits(spark, monkeypatch):
    """Relations are appended to, and their parts written as one now and then."""
    monkeypatch.setattr(session, "MOST_PARTS", 5)
    s = Session(Engine(spark).load(PATHS), "G")
    for k in range(8):
        s.begin().insert("Bus", spark.createDataFrame([(k, k + 1)], "a int, b int"))
        s.commit()
        assert all(len(paths) <= 5 for _, paths in s.parts.values())
    assert s.relation("Bus").count() == 8 and s.relation("Trip").count() == 36
