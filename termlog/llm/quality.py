"""Quality by weak supervision: rules vote good or bad or abstain, expectation-maximisation estimates how often each is
right in either class, and the posterior probability of good quality gives the verdict.

Documents pass the votes through aggregation as one of at most 3**rules patterns; only pattern counts reach the driver.
Only DataFrame functions are used on documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slim

SPACE = "[ \\t-\\r]+"
#: Vote thresholds, in per cent: (rule, measure, good if at most, bad if over).
RULES = (
    ("symbols", "100 * n_symbols / n_words", 2, 10),
    ("shouts", "100 * n_shouts / n_words", 5, 20),
    ("capitals", "100 * n_capitals / word_chars", 12, 40),
    ("repeats", "100 * n_repeat_words / n_words", 5, 20),
    ("same_lines", "100 * n_dup_lines / n_lines", 10, 40),
    ("long_words", "100 * word_chars / n_words", 900, 1600),
    ("bare_words", "100 * n_bare / n_words", 3, 15),
    ("marked_words", "100 * n_marked / n_words", 4, 25),
)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts that rules read. Repeated five-word windows are told by 64-bit hashes within their text."""
    base = slim(docs, id_col, text_col).toDF("doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    words = base.withColumn("words", F.array_remove(F.split("text", SPACE, -1), ""))
    w = F.col("words")
    counted = words.select(
        "doc_id",
        F.size(w).cast("bigint").alias("n_words"),
        F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("bigint").alias("n_capitals"),
        F.regexp_count("text", F.lit("[!?]{2,}")).cast("bigint").alias("n_shouts"),
        F.regexp_count("text", F.lit("(?:^|[ \\t-\\r])[^\\p{L}\\p{N} \\t-\\r]+(?=$|[ \\t-\\r])")).cast("bigint").alias("n_bare"),
        F.regexp_count("text", F.lit("[\\p{L}\\p{N}][.,]?[^\\p{L}\\p{N}.,;:'\") \\t-\\r]+(?=$|[ \\t-\\r])")).cast("bigint").alias("n_marked"),
        F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^ \\t-\\r]")).alias("lines"),
        F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    h = F.col("windows")
    twice = F.size(F.array_distinct(h)) < F.size(h)
    ordered = counted.withColumn("ordered", F.when(twice, F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("ordered")
    shared = ordered.withColumn("places", F.array_sort(F.transform(F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])), lambda x: x["i"])))
    p = F.col("places")
    covered = F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return shared.select("doc_id", "n_words", "word_chars", "n_symbols", "n_capitals", "n_shouts", "n_bare", "n_marked", F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"), F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"))


def votes() -> list[Column]:
    """1 good, -1 bad, 0 abstain: between the thresholds, or where the measure is not defined."""
    return [F.expr(f"CASE WHEN n_words = 0 OR n_lines = 0 THEN 0 WHEN {m} <= {good} THEN 1 WHEN {m} > {bad} THEN -1 ELSE 0 END").alias(f"vote_{name}") for name, m, good, bad in RULES]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 60) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """(prior of good, for each rule: vote -> (probability if good, if bad)) from pattern counts, by
    expectation-maximisation. It starts from the belief that a bad vote is mostly right; a rule is never taken to be
    worse than chance."""
    n_rules = len(RULES)
    total = sum(n for _, n in patterns) or 1
    belief = [0.95 if min(p) >= 0 else 0.1 for p, _ in patterns]
    prior, tables = 0.9, [{1: (0.8, 0.5), 0: (0.15, 0.2), -1: (0.05, 0.3)} for _ in range(n_rules)]
    for _ in range(rounds if patterns else 0):
        prior = min(0.99, max(0.5, sum(b * n for b, (_, n) in zip(belief, patterns, strict=True)) / total))
        for j in range(n_rules):
            good, bad = dict.fromkeys((-1, 0, 1), 1.0), dict.fromkeys((-1, 0, 1), 1.0)
            for b, (p, n) in zip(belief, patterns, strict=True):
                good[p[j]] += b * n
                bad[p[j]] += (1 - b) * n
            g, d = sum(good.values()), sum(bad.values())
            t = {v: (good[v] / g, bad[v] / d) for v in (-1, 0, 1)}
            t[1] = (t[1][0], min(t[1]))
            t[-1] = (min(t[-1]), t[-1][1])
            tables[j] = t
        belief = []
        for p, _ in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(tables[j][v][0] / tables[j][v][1]) for j, v in enumerate(p))
            belief.append(1 / (1 + math.exp(-max(-50.0, min(50.0, odds)))))
    return prior, tables


def judge(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    quality (posterior of good) and a vote for each rule.

    A null or empty text has no words and fails the base; where no rule can vote, all abstain. Null ids and repeated
    rows stay and count each; an empty table gives no rows; other columns are not read. A text's words, windows and lines
    are arrays in its row, about 80 bytes a word, so that much memory is needed for the longest text. All work on a text is
    within its row, so no group is ever gathered; rows of counts are written once to the shared folder.
    """
    names = [f"vote_{name}" for name, *_ in RULES]
    counts = Scratch(docs.sparkSession, "quality").save(measures(docs, id_col, text_col), "measures").select("*", *votes())
    patterns = [(tuple(r[n] for n in names), r["n"]) for r in counts.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    prior, tables = estimate(sorted(patterns))
    odds = F.lit(math.log(prior / (1 - prior)))
    for n, t in zip(names, tables, strict=True):
        good, none, bad = (math.log(t[v][0] / t[v][1]) for v in (1, 0, -1))
        odds = odds + F.when(F.col(n) == 1, good).when(F.col(n) == -1, bad).otherwise(none)
    scored = counts.withColumn("quality", 1 / (1 + F.exp(-odds)))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("quality") >= threshold)).alias("kept"), "quality", *names)
