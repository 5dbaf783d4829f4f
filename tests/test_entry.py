"""Registered program queries against their SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
SAMPLE = ("two_hop", "agg_count_corr", "agg_union_head", "type_range", "agg_topk", "closure_ring", "transform_shift", "pattern_strata", "null_updates", "recursive_terms", "conforms")


def test_registered():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(SAMPLE) <= set(q) and set(o) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", SAMPLE)
def test_sql_agrees(spark, name):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, rel = e.queries()[name](spark, SF), con.sql(e.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[rel.columns.index(c)] for c in columns]) for r in rel.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["delta_changes", "insert_changes"])
def test_whole_relation_changes(spark, name):
    import __spark_entry__ as e
    from termlog.queries import base, whole_session

    test_sql_agrees(spark, name)
    s, of = whole_session(spark, SF)
    parents = base(spark, SF, ["Parent"])["Parent"].count()
    assert s.relation("Parent").count() + of("= 7").count() == parents
    assert e.queries()[name](spark, SF).where("src > 260 or dst > 260").count() or parents <= 260
