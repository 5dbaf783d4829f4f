"""Each operator against a plain version, and on odd rows: nulls, empty and long texts, repeats, clashing columns."""

import os
import random
import struct
import sys
import zlib

import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute

from termlog.llm import chat, decontam, langid, licenses, line_dedup, ngram_join, packing, passages, quality, suffix_dedup, token_counts
from termlog.llm.bpe import Encoder, counter, run_counts, run_ids
from termlog.llm.common import Scratch
from termlog.llm.queries import WORD_BPE

RNG = random.Random(11)
VOCAB = ["the", "of", "shing", "Ender", "lich", "keit", "été", "ñaco", "and", "Tion", "ble", "x1", "über", "re", "an", "to"]


def prose(n, rng=RNG):
    return "".join(rng.choice(VOCAB) + rng.choice(VOCAB) + rng.choice([" ", " ", " ", ". ", "\n", ", "]) for _ in range(n))


def near(text, changes, rng=RNG):
    w = text.split(" ")
    for _ in range(changes):
        w[rng.randrange(len(w))] = "changed%d" % rng.randrange(1000)
    return " ".join(w)


LONG = prose(9000)
BASE = [prose(RNG.randrange(20, 120)) for _ in range(8)]
TEXTS = [*BASE, *(near(BASE[i % 4], 2 + i) for i in range(8)), BASE[0], BASE[0], LONG, near(LONG, 40), None, "", "   \n\t ", "one two", "one two", "é", "12 34 !!", BASE[1] + "\n" + BASE[2], "same words here " * 60]
SCHEMA = "doc_id long, text string, lang string, source string, key string, n string, words string, gone string, bucket string, site string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "de" if i % 3 else None, f"s{i % 4}" if i % 5 else None, "k", None, "w", "g", "b", "s") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def more(odd, spark):
    """With a null id and a repeated row."""
    return odd.union(spark.createDataFrame([(None, BASE[3], None, None, *["z"] * 6), (4, TEXTS[4], "de", "s0", *["k"] * 6)], SCHEMA))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_merging_and_counts_equal_the_library(spark, odd, more, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    hard = ["<|endoftext|>a<|startoftext|> b<|endoftext|>", "I'll don't 's'S it's", "ΑΣ ΣΑΣ. İstanbul ǅ", "éà ẛ̣", "a\x1cb c\x85d e f", "日本語 テスト 🎉🎉!!", "x" * 5000, "½ Ⅷ ²³ 1234", "­​ zero", "<|end", "à la carte…—–", "a\u00a0b\u2003c", " lead", "<|endoftext|>\u3000x"]
    ids, (_, counts) = Encoder(WORD_BPE), counter(WORD_BPE)
    for t in [*hard, *(x or "" for x in TEXTS)]:
        want = library.encode(t, add_special_tokens=False).ids
        assert next(run_ids(pa.array([t]), ids)).tolist() == want, t[:50]
        assert run_counts(pa.array([None, t, "a b", t]), counts).tolist() == [0, len(want), 2, len(want)]
    counts = by_id(token_counts.token_counts(odd, WORD_BPE, limit=100), "n_bytes", "n_tokens", "over_limit")
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert counts[i] == (len((t or "").encode()), n, n > 100)
    assert token_counts.token_counts(more, WORD_BPE).count() == len(TEXTS) + 2
    assert token_counts.token_counts(empty, WORD_BPE).count() == 0


def test_packing(odd, more, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD_BPE)
    for docs, capacity in ((odd, 512), (more, 4096)):
        rows = packing.pack(docs, WORD_BPE, capacity, with_ids=True).collect()
        bins = {}
        for r in rows:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(r.ids)}I", *r.ids)) and len(r.ids) == r.length
        for own in bins.values():
            at = 0
            for offset, length in sorted(own):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) <= -(-sum(r.length for r in rows) // capacity) + 1
    whole = {}
    for r in sorted(packing.pack(odd, WORD_BPE, 512, with_ids=True).collect(), key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(whole.get(r.doc_id, []))
        whole.setdefault(r.doc_id, []).extend(r.ids)
    assert whole == {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    assert packing.pack(empty, WORD_BPE).count() == 0


def test_bin_slack_finds_full_bins():
    assert sum(n * k for n, k in packing.fullest(10, {7: 1, 6: 1, 4: 2, 3: 1}, [7, 6, 4, 3])) == 10
    assert sum(n * k for n, k in packing.fullest(11, {5: 3, 3: 1}, [5, 3])) == 10
    plan = packing.plan_bins({6: 4, 4: 4, 10: 2, 3: 1}, 10)
    assert sum(times for times, _ in plan) == 7 and all(sum(n * k for n, k in c) <= 10 for _, c in plan)


def test_language_mixtures(spark, odd, more, empty):
    words = {"aa": ["lamo", "temi", "rosa", "pilu"], "bb": ["krax", "zwolt", "pfund", "strix"]}
    rng = random.Random(2)
    text = lambda lang, n: " ".join(rng.choice(words[lang]) + rng.choice(words[lang]) for _ in range(n))
    rows = [(i, text(x, 40), x) for i, x in enumerate(["aa", "bb"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where(~langid.held_out()))
    got = by_id(langid.predict(docs, model), "lang_pred", "score")
    assert all(got[i][0] == x and got[i][1] > 0.95 for i, _, x in rows)
    mixed = spark.createDataFrame([(1, text("aa", 60) + " " + text("bb", 30)), (2, "123 !!"), (3, None), (4, "")], "doc_id long, text string")
    found = by_id(langid.predict(mixed, model), "lang_pred", "score", "langs")
    assert found[1][0] == "aa" and 0.55 < found[1][1] < 0.78 and "bb:0." in found[1][2]
    assert [found[i][:2] for i in (2, 3, 4)] == [("und", 0.0)] * 3
    assert langid.predict(more, model).count() == len(TEXTS) + 2 and langid.predict(empty, model).count() == 0
    nothing = langid.fit(empty)
    assert set(x for x, _ in by_id(langid.predict(odd, nothing), "lang_pred", "score").values()) == {"und"}
    kept = langid.keep_known(more, langid.fit(odd))
    assert kept.columns == more.columns and kept.where("text is null").count() == 0


def test_line_dedup(spark, more, empty):
    rng = random.Random(4)
    docs = [(i, f"{prose(9, rng).replace(chr(10), ' ')}\n Subscribe to our letter \n{prose(9, rng).replace(chr(10), ' ')}", f"s{i % 12}") for i in range(24)]
    docs += [(100 + i, "a copied text of one long line and another\nand its second line, no boilerplate", f"s{i}") for i in range(12)]
    docs += [(200, "Subscribe to our letter", "s0"), (201, None, "s1"), (202, "", None), (203, "x\n\nSubscribe to our letter\nlonger than the rest of this text, by far\n", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = by_id(line_dedup.dedup_lines(df, 10), "n_lines", "n_removed", "text")
    for i, t, _ in docs[:24]:
        a, _, b = t.split("\n")
        assert got[i] == (3, 1, f"{a}\n{b}")
    assert all(got[100 + i] == (2, 0, docs[24][1]) for i in range(12))
    assert got[200] == (1, 1, "") and got[201] == (0, 0, None) and got[202] == (1, 0, "")
    assert got[203] == (5, 1, "x\n\nlonger than the rest of this text, by far\n")
    assert line_dedup.dedup_lines(more, 2).count() == len(TEXTS) + 2 and line_dedup.dedup_lines(empty).count() == 0


def test_exact_recount_near_the_threshold(spark):
    lines = spark.createDataFrame([(h, f"s{k}", h * 100 + k) for h, n in ((1, 9), (2, 10), (3, 11), (4, 40)) for k in range(n)], "hash long, site string, key long")
    found, salts = line_dedup.spread_lines(lines, 10, Scratch(spark, "test"))
    assert sorted(r.hash for r in found.collect()) == [2, 3, 4] and salts == 1


def test_line_joins_are_salted_by_frequency(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SALT_ROWS", 5)
    docs = [(i, f"own line {i} {prose(6, random.Random(i)).replace(chr(10), ' ')}\nfooter of all", f"s{i % 12}") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert all(n == 1 for (n,) in by_id(line_dedup.dedup_lines(df), "n_removed").values())
    odd = df.selectExpr("*", "1 as size", "2 as gone", "3 as _key", "4 as key", "5 as `row`", "6 as `a.b`", "cast(7 as long) as n_chars")
    out = line_dedup.strip_lines(odd)
    assert out.columns == odd.columns and out.count() == 40
    assert all(r.n_chars == len(r.text) and "footer" not in r.text and r.size == 1 and r["a.b"] == 6 for r in out.collect())
    assert line_dedup.strip_lines(odd.limit(0)).count() == 0


def test_quality(spark, odd, more, empty):
    got = by_id(quality.judge(odd), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    for i, t in enumerate(TEXTS):
        want = brute.quality_counts(t)
        assert got[i] == (*want, want[0] < 10 or 100 * want[4] > 20 * want[0]), i
    rng = random.Random(7)
    good = [(i, prose(80, rng)) for i in range(60)]
    bad = [(100 + i, " ".join(w.upper() + "!!" for w in prose(80, rng).split())) for i in range(6)] + [(200 + i, " ".join(w + "***" for w in prose(80, rng).split())) for i in range(6)]
    kept = by_id(quality.judge(spark.createDataFrame(good + bad, "doc_id long, text string")), "kept")
    assert all(kept[i][0] for i, _ in good) and not any(kept[i][0] for i, _ in bad)
    assert quality.judge(more).count() == len(TEXTS) + 2 and quality.judge(empty).count() == 0


def test_ngram_join(spark, odd, more, empty):
    want = brute.components(dict(enumerate(TEXTS)))
    want = {i: (n, c if n else i) for i, (n, c) in want.items()}
    got = by_id(ngram_join.jaccard_components(odd), "n_shingles", "component_id")
    assert got == want
    assert ngram_join.jaccard_components(more).where("doc_id is null").first().component_id is None
    assert ngram_join.jaccard_components(empty).count() == 0
    one = ngram_join.keep_one(odd)
    assert one.columns == odd.columns and {r.doc_id for r in one.collect()} == {c for _, c in want.values()}


def test_ngram_join_chains_and_large_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "PART", 8)
    monkeypatch.setattr(ngram_join, "PAIRS", 5)
    rng, texts = random.Random(9), []
    head = [f"w{i}" for i in range(60)]
    for k in range(30):  # a chain: neighbours are alike, ends aren't
        texts.append(" ".join(head[k:] + [f"v{i}" for i in range(k)] + ["end", "of", "chain"]))
    texts += [" ".join(head[:20]) + " " + prose(60, rng) for _ in range(25)]  # a passage that unlike texts share
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert by_id(ngram_join.jaccard_components(docs), "n_shingles", "component_id") == brute.components(dict(enumerate(texts)))


def test_tree_bound_loses_no_link():
    import numpy as np

    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, 80, np.uint64)) for _ in range(40)]
    sets += [np.unique(np.concatenate([s[: len(s) - 8], rng.integers(0, 1 << 63, 8, np.uint64)])) for s in sets[:20]]
    vectors, sizes = ngram_join.points([ngram_join.point(s) for s in sets]), np.array([len(s) for s in sets])
    got = {tuple(sorted(p)) for i, j in ngram_join.tree_pairs(vectors, sizes, np.arange(len(sets)), 75) for p in zip(i.tolist(), j.tolist(), strict=True)}
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if ngram_join.linked(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])), 75)}
    assert links and links <= got and len(got) < 200


def test_licenses(spark, odd, more, empty):
    texts = ["Licensed under the Apache License, Version 2.0.", "CC-BY-NC 4.0 or cc by", "GNU General Public License version 3 or later", "the MIT\nlicense. MIT License!", "SPDX-License-Identifier: MPL 2.0", "All rights reserved", "no licence at all", "KELVIN K mit licenſe", None, ""]
    rows = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    for i, t in enumerate(texts):
        assert rows[i][:5] == brute.license_base(t), t
        assert set(filter(None, rows[i][4].split(","))) <= set(rows[i][5].split(","))
    assert rows[0][5] == "apache,apache-2.0" and rows[1][5] == "cc-by,cc-by-nc-4.0" and rows[2][5] == "gpl,gpl-3.0-or-later" and rows[4][5] == "mpl-2.0"
    assert rows[5][5:] == ("all-rights-reserved", 0.7) and rows[8] == (0, 0, None, None, "", "", 0.0)
    assert len(licenses.rules()) > 200
    assert licenses.scan(more).count() == len(TEXTS) + 2 and licenses.scan(empty).count() == 0


def test_suffix_dedup(spark, odd, more, empty):
    for docs, texts in ((odd, TEXTS), (more, [*TEXTS, BASE[3], TEXTS[4]])):
        rows = suffix_dedup.remove_repeats(docs, with_text=True).select("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept").collect()
        assert sorted(tuple(r)[:4] for r in rows) == sorted(brute.repeats_removed(texts, 400))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_of_periods_and_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1500)
    rng = random.Random(8)
    shared = prose(130, rng)
    texts = ["ab" * 700, "x" * 399, "y" * 401, *(prose(20, rng) + shared[k : 700 + k] + prose(20, rng) for k in range(9)), shared, "é" * 450]
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute.repeats_removed(texts, 400)


def test_decontamination(spark, more, empty):
    rng = random.Random(5)
    items = [(i, prose(30, rng)) for i in range(6)] + [(6, "only five words are here"), (7, None), (8, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    swap = items[2][1].split(" ")
    swap[5] = swap[14] = swap[20] = "other"
    docs = [(1, prose(30, rng) + " " + items[0][1].upper() + " " + prose(9, rng)), (2, prose(10, rng) + " ".join(swap)), (3, prose(200, rng)), (4, "so: Only five, words ARE here"), (5, None), (6, ""), (None, items[1][1]), (7, items[1][1]), (7, items[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", decontam.F.lit(1))
    pairs = {(r.doc_id, r.item_id) for r in decontam.overlaps(df, bench).collect()}
    assert {(1, 0), (2, 2), (4, 6), (None, 1), (7, 1)} == pairs
    clean = decontam.decontaminate(df, bench)
    assert clean.columns == df.columns and sorted(r.doc_id for r in clean.collect()) == [3, 5, 6]
    assert decontam.overlaps(more, bench).count() == 0 and decontam.overlaps(empty, bench).count() == 0
    assert decontam.overlaps(df, bench.limit(0)).count() == 0


def test_decontamination_by_shuffle(spark, monkeypatch):
    items = [(i, prose(30, random.Random(i))) for i in range(4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, "lead in words " + t) for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    assert {(r.doc_id, r.item_id) for r in decontam.overlaps(docs, bench).collect()} == {(i, i) for i in range(4)}


def test_chat(spark):
    said = chat.parse([("system", "You are kind."), (None, "User: what is this?\nHuman: and that?"), (None, "It is a box."), ("user", "and?"), (None, "Assistant: Sure,\nhere it is."), ("user", "thanks")])
    assert [[r for r, _ in t] for t in said] == [["system"], ["user"], ["assistant"], ["user"], ["assistant"], ["user"]]
    assert said[1] == [("user", "what is this?\nand that?")]
    assert chat.viterbi([("a", "user", None, True), ("b", None, None, True), ("c", None, None, True)], None) == ["user", "assistant", "user"]
    kept = "Which is right?\nA: red\nB: blue\nQ: none"
    assert chat.parse([("user", kept), ("assistant", "Answer: 42")]) == [[("user", kept)], [("assistant", "Answer: 42")]]
    rows = [(c, t, [None, "user", "assistant", "human"][t % 4] if c else ["user", "assistant"][t % 2] if t % 3 else None, f"line {t}\n- more") for c in (0, 1) for t in range(600 if c == 0 else 4)]
    rows += [(2, 0, "user", None), (2, 1, None, ""), (None, None, None, "x"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("stretch", chat.F.lit(1))
    got = chat.canonical_turns(df).collect()
    assert len(got) == len(rows)
    zero = {r.turn: r.role for r in got if r.conv_id == 0}
    assert [zero[t] for t in range(600)] == [["user", "assistant"][t % 2] for t in range(600)]
    assert next(r for r in got if r.conv_id == 3).rendered == "<|user|>\nsame\n<|end|>\n"
    assert chat.canonical_turns(df.limit(0)).count() == 0


def test_ngram_join_copies_linked_by_the_second_pass(spark):
    """Copies come in descending order, and the document that leads their blocks is linked with neither."""
    shared, tail = [f"s{i}" for i in range(100)], [f"t{i}" for i in range(100)]
    copy, near_copy = " ".join(["c1", "c2", "c3", *shared]), " ".join([*shared, "n1", "n2", "n3"])
    texts = {100: copy, 5: copy, 50: near_copy, 1: " ".join([*shared, *tail])} | {200 + i: " ".join([*tail, *(f"m{k}" for k in range(9))]) for i in range(6)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    assert by_id(ngram_join.jaccard_components(docs), "n_shingles", "component_id") == brute.components(texts)


def test_suffix_dedup_splits_a_bucket_as_one(spark, monkeypatch):
    """A string in a short and in a long context, the bucket's limit between what the two would estimate."""
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 1050)
    rng, texts = random.Random(21), []
    for _ in range(12):
        shared = prose(130, rng)[:440]
        texts += [shared, prose(90, rng) + shared + prose(90, rng)]
    rows = suffix_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in rows] == brute.repeats_removed(texts, 400)


def samples(pattern):
    """Texts that a rule's pattern matches: each alternative, with its optional parts left out and put in."""
    import itertools
    from re import _parser

    def of(tree):
        parts = []
        for op, arg in tree:
            op = str(op)
            if op == "LITERAL":
                parts.append([chr(arg)])
            elif op == "IN":
                parts.append(["x"] if str(arg[0][0]) == "CATEGORY" else [chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])])
            elif op == "BRANCH":
                parts.append([x for t in arg[1] for x in of(t)])
            elif op == "SUBPATTERN":
                parts.append(of(arg[3]))
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                parts.append(sorted({x * max(arg[0], 1) if n else x * arg[0] for x in of(arg[2]) for n in (0, 1)}))
            else:
                raise ValueError(op)
        return ["".join(x) for x in itertools.product(*parts)]

    return of(_parser.parse(pattern))


def test_license_gate_lets_each_rule_through(spark):
    import re

    for r in licenses.rules():
        for text in samples(r.pattern):
            assert re.fullmatch(r.pattern, text)
            for raw in (text, text.replace(" ", ' "')):
                assert re.search(licenses.GATE, raw), (r.label, raw)
    texts = {"Creative Commons Attribution-ShareAlike 4.0": "cc-by-sa-4.0", "Creative Commons Zero 1.0": "cc0-1.0", "GFDL 1.3": "gfdl-1.3", "CPL 1.0": "cpl-1.0", "BSL 1.0": "bsl-1.0", "BUSL 1.1": "busl-1.1", "MIT No Attribution": "mit-0"}
    rows = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "labels")
    assert [rows[i][0] for i in range(len(texts))] == list(texts.values())
    rule = licenses.Rule(0, "own", "house terms", 1.0)
    assert licenses.scan(spark.createDataFrame([(0, "house terms")], "doc_id long, text string"), [rule]).first().labels == "own"


def test_license_keywords_are_in_every_match():
    for r in licenses.rules():
        assert len(r.keyword) >= 2, r
        for text in samples(r.pattern):
            assert r.keyword in f" {text} ", (r.pattern, r.keyword, text)
    assert len({(r.label, r.pattern) for r in licenses.rules()}) == len(licenses.rules()) > 350


def detections(text):
    """All rules over the normalised text, contained ones and then those of lower priority left out."""
    import re

    if not re.search(licenses.GATE, (text or "").lower()):
        return set()
    norm = " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", brute.ascii_lower(text or ""))) + " "
    found = {(r.priority, m.start(), m.end(), r.label) for r in licenses.rules() for m in re.finditer(f"(?<= ){r.pattern}(?= )", norm)}
    outer = [d for d in found if not any(e != d and e[1] <= d[1] and d[2] <= e[2] and ((e[1], e[2]) != (d[1], d[2]) or e[0] < d[0]) for e in found)]
    taken = []
    for d in sorted(outer):
        if not any(d[1] < e[2] and e[1] < d[2] for e in taken):
            taken.append(d)
    return {d[3] for d in taken}


def test_license_detections_equal_brute_force(spark):
    rng = random.Random(17)
    parts = ["gnu", "general public license", "version 2", "v3", "or", "any later", "later", "only", "Apache License", "2.0", "the MIT license", "licensed under the", "CC-BY-SA", "4.0", "cc by", "Creative Commons Attribution", "NonCommercial", "all rights reserved", "public domain", "into the", "BSD 3-clause", "License", "SPDX-License-Identifier:", "mpl 2.0", "word", "copyright (c) 2020", "released under mit", "eclipse public license"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(150)]
    rows = by_id(licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), "base_labels", "labels")
    for i, t in enumerate(texts):
        assert set(filter(None, rows[i][1].split(","))) == detections(t) | set(filter(None, rows[i][0].split(","))), t


def test_viterbi_equals_enumeration():
    """Every path of short stretches, scored one by one."""
    import itertools

    rng = random.Random(31)
    texts = ["what is it?", "Sure, here", "{\"a\": 1}", "You are kind.", "plain words", "- item", "", "x" * 401]
    for _ in range(60):
        lines = [(rng.choice(texts), rng.choice([None, None, None, "user", "tool"]), rng.choice([None, None, "assistant", "user", "system"]), i == 0 or rng.random() < 0.5) for i in range(rng.randrange(1, 6))]
        after = rng.choice([None, "user", "assistant"])

        def score(path, lines=lines, after=after):
            s = chat.START[path[0]] + sum(chat.emission(*x[:3])[r] for x, r in zip(lines, path, strict=True))
            s += sum(m[a, b] for m, a, b in zip(chat.steps(lines), path, path[1:], strict=False))
            return s + (chat.BETWEEN[path[-1], chat.ROLES.index(after)] if after else 0)

        best = max(score(p) for p in itertools.product(range(4), repeat=len(lines)))
        got = [chat.ROLES.index(r) for r in chat.viterbi(lines, after)]
        assert abs(score(got) - best) < 1e-6


def test_split_at_stated_turns_is_exact(spark):
    """A whole conversation in one stretch gives what its stretches give."""
    rng = random.Random(12)
    texts = ["what is it?", "Sure, here it is", "User: and that?\nAssistant: a box", "Answer: 42", "never say no", "plain"]
    turns = [(rng.choice([None, None, "user", "assistant"]), rng.choice(texts)) for _ in range(60)]
    df = spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = {}
    for r in sorted(chat.canonical_turns(df).collect(), key=lambda r: (r.turn, r.part)):
        got.setdefault(r.turn, []).append((r.role, r.text))
    assert [got[i] for i in range(60)] == chat.parse(turns)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_withheld_roles_are_recovered(spark):
    rows = chat.recovery(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")).collect()
    assert all(r.role == r.stated for r in rows if not r.withheld)
    hidden = [r.role == r.stated for r in rows if r.withheld and r.part == 0]
    assert len(hidden) > 80 and sum(hidden) / len(hidden) > 0.85


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(41)
    clean = lambda t: t.replace("\n", " ").replace(".", " ").replace(",", " ")
    items = {i: clean(prose(rng.choice([15, 17, 20, 30]), rng)) for i in range(12)}
    docs = []
    for _ in range(80):
        item = items[rng.randrange(12)].split()
        for k in rng.sample(range(len(item)), rng.randrange(len(item) // 4 + 1)):
            item[k] = f"swap{rng.randrange(9)}"
        cut = item[rng.randrange(3) :][: rng.choice([99, 14, 8])]
        docs.append(clean(prose(rng.randrange(25), rng)) + " " + " ".join(cut) + " " + clean(prose(rng.randrange(25), rng)))
    item = items[3].split()
    docs.append(" ".join(w if k % 4 else "every" for k, w in enumerate(item)))  # each fourth word swapped
    found = {}
    for r in decontam.overlaps(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect():
        found.setdefault(r.doc_id, set()).add(r.item_id)
    assert [found.get(i, set()) for i in range(len(docs))] == [brute.held_items(t, items) for t in docs]


def test_posterior_equals_row_by_row_estimation():
    """The same estimation over documents one by one, in numpy, instead of over counted patterns."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = np.where(rng.random((400, 8)) < 0.75, 1, rng.integers(-1, 1, (400, 8)))
    rows[:60, :4] = -1
    kinds, count = np.unique(rows, axis=0, return_counts=True)
    prior, tables = quality.estimate([(tuple(int(x) for x in k), int(n)) for k, n in zip(kinds, count, strict=True)], rounds=25)
    belief = np.where((rows >= 0).all(axis=1), 0.95, 0.1)
    for _ in range(25):
        p = min(0.99, max(0.5, belief.mean()))
        good = np.stack([((rows == v) * belief[:, None]).sum(axis=0) + 1 for v in (-1, 0, 1)]) / (belief.sum() + 3)
        bad = np.stack([((rows == v) * (1 - belief)[:, None]).sum(axis=0) + 1 for v in (-1, 0, 1)]) / ((1 - belief).sum() + 3)
        bad[2], good[0] = np.minimum(bad[2], good[2]), np.minimum(good[0], bad[0])
        ratio = np.log(good / bad)
        belief = 1 / (1 + np.exp(-(np.log(p / (1 - p)) + ratio[rows + 1, np.arange(8)].sum(axis=1))))
    assert abs(prior - p) < 1e-9
    for j in range(8):
        assert np.allclose([tables[j][v] for v in (-1, 0, 1)], np.stack([good[:, j], bad[:, j]], axis=1))


def test_packing_is_near_the_fewest_bins():
    rng = random.Random(3)
    for _ in range(60):
        capacity, sizes = 20, [rng.randrange(1, 21) for _ in range(rng.randrange(1, 11))]
        plan = packing.plan_bins({x: sizes.count(x) for x in sizes}, capacity)
        used = [n for times, c in plan for _ in range(times) for n, k in c for _ in range(k)]
        assert sorted(used) == sorted(sizes)
        assert sum(times for times, _ in plan) <= brute.fewest_bins(sizes, capacity) + 1


def test_language_answers_do_not_depend_on_neighbours(spark):
    rng, langs = random.Random(8), "abcde"
    word = {x: [x + rng.choice("mnrs") + y for y in ("oka", "ipe", "uta")] for x in langs}
    text = lambda mix: " ".join(rng.choice(word[rng.choice(mix)]) for _ in range(60))
    train = spark.createDataFrame([(i, text(x), x) for i, x in enumerate(langs * 8)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    mixed = [text(m) for m in ("a", "ab", "abc", "abcd", "abcde", "e", "de") for _ in range(3)]
    together = langid.predict(spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string").coalesce(1), model)
    alone = langid.mixtures
    got = by_id(together, "langs")
    import pyarrow as pa

    for i, t in enumerate(mixed):
        pi = alone(*langid._words(*langid._joined(pa.array([t])), model), 1, 8, 1.0)[0]
        assert got[i][0] == ",".join(f"{model.langs[j]}:{pi[j]:.3f}" for j in sorted(range(5), key=lambda j: -pi[j]) if pi[j] >= 0.0005)


def test_stages_keep_clashing_columns(spark):
    """Every stage's function carries columns with the names that it uses itself."""
    rng = random.Random(2)
    texts = [prose(40, rng) for _ in range(6)]
    names = ["key", "gone", "row", "_gone", "_held", "size", "n", "words", "component_id", "stripped", "a.b", "item_id", "lang_pred"]
    rows = [(i, t, "en", "s", 1, *range(len(names))) for i, t in enumerate([*texts, texts[0], None, ""])]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{n}` int" for n in names)]))
    bench = spark.createDataFrame([(0, texts[1])], "item_id long, text string")
    kept = {"language": langid.keep_known(docs, langid.fit(docs)), "lines": line_dedup.strip_lines(docs), "copies": ngram_join.keep_one(docs), "leaks": decontam.decontaminate(docs, bench)}
    gone = {"language": {7, 8}, "lines": set(), "copies": {6}, "leaks": {1}}
    for name, out in kept.items():
        assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == set(range(9)) - gone[name], name
        assert all(list(r)[5:] == list(range(len(names))) for r in out.collect()), name


def test_shared_passages(spark, odd, empty, monkeypatch):
    """Every shared run of over 50 words is found, and none where no window's length of words is shared."""
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    run = lambda n: [word() for _ in range(n)]
    texts, want = [], []
    for n in (51, 52, 55, 60, 75, 200, 34, 20, 5):
        own = run(n)
        for _ in range(2):
            texts.append(" ".join([*run(rng.randrange(90)), *own, *run(rng.randrange(90))]))
            want.append(n > 50)
    alone = run(60)
    texts += [" ".join([*alone, *alone]), " ".join(run(300)), "", None, " ".join(run(50))]
    want += [False] * 5
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3)
    for held in (passages.HELD, 100):
        monkeypatch.setattr(passages, "HELD", held)
        found = {r.id: r.n_shared_windows for r in passages.shared_passages(df).collect()}
        assert [i in found for i in range(len(texts))] == want and all(n > 0 for n in found.values())
    assert passages.shared_passages(empty.selectExpr("doc_id as id", "text")).count() == 0
