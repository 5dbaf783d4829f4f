"""Benchmark decontamination by spaced-seed hashing.

Fixed masks choose which of a few neighbouring words make a seed, so that a substituted word spoils only the seeds that
choose it. Seeds of documents and benchmark items are joined; around each hit the whole item is laid beside the document
and the aligned words are compared. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, keep_rows, quoted, slim
from .line_dedup import content_key

#: Word positions that make a seed.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 6, 7), (0, 2, 3, 5, 7, 8))
#: Seeds of the benchmark up to which they are broadcast (24 bytes each); beyond, the join shuffles.
BROADCAST_SEEDS = 2_000_000
BREAK = "[^\\p{L}\\p{N}]+"


def _word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK, -1), ""), lambda x: F.xxhash64(x))


def _seeds(words: Column, masks: tuple[tuple[int, ...], ...]) -> Column:
    """For each mask, the seed at each word or null past the end; all masks' arrays in a row, each of the same size."""
    n = F.size(words)

    def seed(k: int, mask: tuple[int, ...]):
        return lambda x, i: F.when(i + mask[-1] < n, F.xxhash64(F.lit(k), *(F.get(words, i + j) if j else x for j in mask)))

    each = [F.transform(words, seed(k, mask)) for k, mask in enumerate(masks)]
    return F.concat(*each)


def overlaps(docs: DataFrame, benchmark: DataFrame, min_run: int = 12, min_share: int = 75, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs (key, doc_id, item_id, n_matched, n_item_words, run, start) of documents that hold a benchmark item.

    Lower-cased runs of letters and digits are words. An item is held where, laid beside the document, at least
    `min_share` per cent of its words agree, or where a stretch scores `min_run` with 1 for a word that agrees and -2
    for one that doesn't (the whole item's length, if shorter). Items shorter than a mask have masks of their own
    length. The masks find a seed in every pattern of swaps that leaves `min_share` of 75 per cent of items of 15, 17 and 20
    words, and in all but 6 of the 1,820 ways to swap 4 of 16. Null or empty texts hold and match nothing; repeated rows
    match alike, as one pair (their key is one); rows with a null id stay apart by their text; an empty table gives no
    rows; other columns are not read. A text's words and seeds are arrays in its row: about 50 bytes a word. Each document's seeds stay in its row: nothing is shuffled but hits, unless the benchmark has
    over BROADCAST_SEEDS seeds.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "seeds")
    items = scratch.save(slim(benchmark, item_col, item_text_col).toDF("item_id", "text").select("item_id", _word_hashes(F.col("text")).alias("item")).where(F.size("item") > 0), "items")
    short = sorted(r[0] for r in items.where(F.size("item") < 9).select(F.size("item")).distinct().collect())
    masks = (*MASKS, *(tuple(range(n)) for n in short))
    seeds = items.select("item_id", F.size("item").alias("n"), F.posexplode_outer(_seeds(F.col("item"), masks)).alias("p", "seed")).where("seed is not null").select("seed", "item_id", F.expr("p % n").alias("item_at"))
    seeds = scratch.save(seeds, "seeds")
    if small := seeds.count() <= BROADCAST_SEEDS:
        seeds, items = F.broadcast(seeds), F.broadcast(items)
    rows = slim(docs, id_col, text_col).toDF("doc_id", "text")
    hashed = rows.select(content_key(F.col("doc_id"), F.col("text")).alias("key"), "doc_id", _word_hashes(F.col("text")).alias("words"))
    seeded = hashed.select("key", "doc_id", "words", F.size("words").alias("n"), _seeds(F.col("words"), masks).alias("seeds"))
    # the outer form: Spark would else push a test of the array's size below, with the array's definition in it
    exploded = seeded.select("key", "doc_id", "words", "n", F.posexplode_outer("seeds").alias("p", "seed")).where("seed is not null")
    if small:
        hits = exploded.join(seeds, "seed").select("key", "doc_id", "words", "item_id", F.expr("p % n - item_at").alias("start")).dropDuplicates(["key", "item_id", "start"])
    else:
        found = exploded.select("key", F.expr("p % n").alias("at"), "seed").join(seeds, "seed").select("key", "item_id", (F.col("at") - F.col("item_at")).alias("start")).distinct()
        hits = hashed.join(found, "key")
    laid = hits.join(items, "item_id")
    agree = F.transform("item", lambda x, i: F.coalesce((F.col("start") + i >= 0) & (x == F.get(F.col("words"), F.greatest(F.col("start") + i, F.lit(0)))), F.lit(False)))
    state = F.aggregate(agree, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(0).alias("n")), lambda s, x: F.struct(F.greatest(F.lit(0), s["now"] + F.when(x, 1).otherwise(-2)).alias("now"), F.greatest(s["best"], s["now"] + F.when(x, 1).otherwise(-2)).alias("best"), (s["n"] + F.when(x, 1).otherwise(0)).alias("n")))
    judged = laid.select("key", "doc_id", "item_id", "start", F.size("item").alias("n_item_words"), state.alias("s"))
    held = judged.where((100 * F.col("s.n") >= min_share * F.col("n_item_words")) | (F.col("s.best") >= F.least(F.lit(min_run), F.col("n_item_words"))))
    best = held.groupBy("key", "doc_id", "item_id").agg(F.max(F.struct(F.col("s.n"), -F.col("start"), F.col("n_item_words"), F.col("s.best"))).alias("b"))
    return best.select("key", "doc_id", "item_id", F.col("b.n").cast("bigint").alias("n_matched"), F.col("b.n_item_words").cast("bigint").alias("n_item_words"), F.col("b.best").cast("bigint").alias("run"), (-F.col("b.col2")).cast("bigint").alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents, all columns and rows kept, that hold no benchmark item.

    Those with a null or empty text stay; repeated rows stay or go together; an empty table, or an empty benchmark,
    changes nothing; documents and items are read by id and text only, and no column of theirs can clash."""
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    held = Scratch(docs.sparkSession, "held").save(overlaps(docs, benchmark, **options).select(F.col("key").alias("_held")).distinct(), "held")
    return keep_rows(docs, content_key(F.col(quoted(id_col)), F.col(quoted(text_col))), held, "_held")
