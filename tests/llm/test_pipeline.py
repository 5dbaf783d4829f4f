"""The pipeline, stage by stage, against plain versions on a small corpus."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))
import brute
from test_llm import near, prose

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    texts = [prose(60, rng).replace("\n", " ") for _ in range(30)]
    item = prose(30, rng).replace("\n", " ")
    docs = [(i, f"{t}\nShared footer line of all sites\n{prose(20, rng)}") for i, t in enumerate(texts)]
    docs += [(100 + i, near(docs[i][1], 3, rng)) for i in range(5)] + [(200, docs[7][1]), (300, prose(30, rng) + " " + item), (400, None), (401, ""), (402, "123 456")]
    rows = [(i, t, "en", f"s{i % 13}", len(t or "")) for i, t in docs]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    df, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        seen[name] = df.collect()
        if name != "packed":
            assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: {r.doc_id for r in seen[name]}
    assert ids("language_id") == {i for i, _ in docs} - {400, 401, 402}
    lines = {r.doc_id: r.text for r in seen["boilerplate_lines"]}
    assert not any("Shared footer line of all sites" in t.split("\n") for t in lines.values()) and all(r.n_chars == len(r.text) for r in seen["boilerplate_lines"])
    want = brute.components(lines)
    assert ids("near_duplicates") == {i for i, (_, c) in want.items() if i == c} and not ids("near_duplicates") & {200}
    assert ids("benchmark_leaks") == ids("near_duplicates") - {300}
    assert ids("packed") == ids("benchmark_leaks")
    direct = corpus_pipeline.run(spark, str(tmp_path))
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in direct.collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in seen["packed"]}
