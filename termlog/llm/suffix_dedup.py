"""Exact removal of long repeated strings by blockwise sorting of suffixes.

A suffix matters only up to `width` bytes (400), so each place where a string of that width starts is a suffix cut to
it. Suffixes are dealt to buckets by their minimizer: the least hashed 64-byte piece inside, at its leftmost place. Equal
strings have the same piece at the same distance, so they meet in one bucket, aligned at it. Buckets with one suffix run
only never leave the first pass; the others are sorted one at a time. Within a bucket strings are compared at equal
distance from the anchor, so the places that are a multiple of `cover` bytes from it are a difference cover: any two
suffixes to be compared reach cover places together after the same few bytes. Ranks of the cover places are computed
first, by doubling over the bucket's text; a tie of any length is then resolved by at most a head shorter than `cover`,
two ranks and a tail, in memory bounded by the bucket's text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grouped, release, slim
from .hashing import STEP, mix, powers

PIECE = 64
COVER = 16
#: Text of one bucket, in bytes, that one task sorts at a time; beyond it, a bucket is split by distance and content.
BUCKET_BYTES = 8 << 20
_RANDOM = np.random.default_rng(7_400_001)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)


#: Places within a window fit in so many bits; the same for all texts, so that equal strings choose equal pieces.
_PLACE_BITS = np.uint64(21)
WINDOW = 1 << 20


@functools.cache
def _weights() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2**64, for a whole window."""
    n = WINDOW + (1 << 16)
    back = np.full(n, pow(int(STEP), -1, 1 << 64), np.uint64)
    back[0] = 1
    return powers(n), np.multiply.accumulate(back)


def piece_hashes(data: np.ndarray, size: int = PIECE) -> np.ndarray:
    """Hash of each run of `size` bytes: a polynomial modulo 2**64, mixed."""
    n = len(data)
    weight, back = _weights()
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * weight[:n], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * back[: n - size + 1])


def leftmost_minima(h: np.ndarray, span: int) -> np.ndarray:
    """For each start s, the leftmost place of the least of h[s : s + span] by its upper bits: block prefix and suffix
    minima of value and place in one integer."""
    n = len(h) - span + 1
    key = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    padded = np.concatenate([key, np.full(-len(key) % span, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)


def anchors(data: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the piece, its place, first start, last start) of the runs of starts that share a minimizer.

    Works in windows that overlap by a suffix, so memory doesn't follow the text's length."""
    out, n = [], len(data) - width + 1
    for lo in range(0, n, WINDOW):
        part = data[lo : min(len(data), lo + WINDOW + width - 1)]
        h = piece_hashes(part)
        at = leftmost_minima(h, width - PIECE + 1)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        out.append((h[at[first]], at[first] + lo, first + lo, last + lo))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def content_hash(part: np.ndarray | bytes) -> tuple[int, int]:
    d = hashlib.blake2b(part if isinstance(part, bytes) else part.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def cover_ranks(text: np.ndarray, places: np.ndarray, width: int) -> dict[int, np.ndarray]:
    """Ranks, for lengths cover * 2**k up to `width`, of the strings at each cover place; -1 where the text ends.

    text: the concatenation of contexts. places[c]: cover places, ascending by COVER within a context; the rank of a
    string that would leave its context is never asked for."""
    high, low = _few_bytes(text, places, np.full(len(places), COVER))
    order = np.lexsort((low, high))
    new = np.concatenate([[False], (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])])
    first = np.empty(len(order), np.int64)
    first[order] = np.cumsum(new)
    ranks = {COVER: first}
    length = COVER
    while 2 * length <= width:
        step = length // COVER
        now = ranks[length]
        after = np.full(len(now), -1, np.int64)
        after[:-step] = now[step:] if step < len(now) else after[:-step]
        ranks[2 * length] = np.unique(now * (len(now) + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        length *= 2
    return ranks


def repeated_starts(contexts: list[bytes], before: list[int], counts: list[int], bucket: np.ndarray, width: int) -> list[np.ndarray]:
    """For each context, which of its suffixes (starts) occur twice or more in its bucket, by one sort.

    contexts[i] is the text from its first start to `width` bytes past its last; before[i] is the anchor's place in it;
    counts[i] is how often that context stands in the corpus; bucket[i] is the number of its bucket."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    anchor = np.array(before, np.int64)
    starts = sizes - width + 1
    base = np.concatenate([[0], np.cumsum(sizes)])
    text = np.frombuffer(b"".join(contexts) + bytes(width + COVER), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), starts)
    place = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
    distance = anchor[owner] - place  # from the start to the anchor; only equal ones are compared
    head = distance % COVER  # bytes until a cover place
    first = anchor % COVER  # the first cover place of each context
    n_cover = (sizes - first + COVER - 1) // COVER
    cover_base = np.concatenate([[0], np.cumsum(n_cover)])
    cover_owner = np.repeat(np.arange(len(contexts)), n_cover)
    cover_place = (np.arange(int(n_cover.sum())) - cover_base[cover_owner]) * COVER + first[cover_owner] + base[cover_owner]
    ranks = cover_ranks(text, cover_place, width)
    whole = (width - head) // COVER  # blocks from the cover place on
    tail = width - head - whole * COVER
    at = cover_base[owner] + (place + head - first[owner]) // COVER
    longest = max(x for x in ranks if x <= int(whole.min()) * COVER)
    steps = -(-whole * COVER // longest)
    key = (np.asarray(bucket, np.int64)[owner] << 24 | distance).astype(np.uint64)
    absolute = base[owner] + place
    parts = [key, *_few_bytes(text, absolute, head)]
    for k in range(int(steps.max())):
        shift = np.minimum(k * (longest // COVER), whole - longest // COVER)
        parts.append(ranks[longest][at + shift].astype(np.uint64))
    parts += _few_bytes(text, absolute + head + whole * COVER, tail)
    order = np.lexsort(parts[::-1])
    same = np.ones(len(order) - 1, bool)
    for p in parts:
        q = p[order]
        same &= q[1:] == q[:-1]
    twice = np.zeros(len(order), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice |= np.array(counts)[owner] > 1
    return np.split(twice, np.cumsum(starts)[:-1])


def _few_bytes(text: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to 16 bytes at each place as two integers, zeroed past n; n itself is told by the distance key."""
    out = []
    for lo in (0, 8):
        word = np.zeros(len(at), np.uint64)
        for k in range(lo, lo + 8):
            word = word << np.uint64(8) | np.where(k < n, text[at + np.minimum(k, n)], 0).astype(np.uint64)
        out.append(word)
    return out[0], out[1]


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of the runs of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def remove_repeats(docs: DataFrame, width: int = 400, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and with_text: kept, as bytes).

    Each byte of a text's UTF-8 form that a `width`-byte string covers which also starts anywhere else in the input,
    the same document included, is removed; strings are judged on the input. A null text counts as empty; texts shorter
    than `width` stay whole; repeated rows, and rows with a null id, are texts of their own; an empty table gives no
    rows; other columns are not read.

    The first pass writes, for each run of starts that share a minimizer (about one for every 170 bytes), its hash and a
    128-bit hash of its context. Equal contexts are counted by aggregation, so a group of copies of any size is one row
    in its bucket. Only documents with a repeated minimizer are carried on. A bucket of over BUCKET_BYTES is split into
    cells of strings that agree in all but 15 bytes, so that a passage that a third of all documents hold, each time
    among other words, isn't one task's; joins on hot buckets are left to the adaptive skew join.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    # rows are told by 128 bits of content and id, so that repeated ids do no harm
    rows = slim(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.unhex(F.md5(F.concat_ws("\0", F.col("doc_id").cast("string"), F.col("text"))))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row_key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = np.frombuffer(text.as_py().encode(), np.uint8)
                if len(data) < width:
                    continue
                h, at, first, last = anchors(data, width)
                for lo in range(0, len(h), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    hashes = [content_hash(data[f : e + width]) for f, e in zip(first[part], last[part], strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([row_key] * len(hashes), pa.binary()), pa.array(h[part].view(np.int64)), pa.array(at[part] - first[part]), pa.array(first[part]), pa.array(last[part]), *(pa.array(list(x), pa.int64()) for x in zip(*hashes, strict=True))], ["key", "bucket", "anchor", "first", "last", "a", "b"])

    def joined_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Many small batches make the transfer slow: they are put together up to 64 Ki rows."""
        release()
        held, n = [], 0
        for b in scan(batches):
            held.append(b)
            n += b.num_rows
            if n >= 1 << 16:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    found = scratch.save(rows.select(key.alias("key"), "text").mapInArrow(joined_batches, "key binary, bucket bigint, anchor bigint, first bigint, last bigint, a bigint, b bigint"), "found")
    contexts = found.groupBy("bucket", "a", "b").agg(F.count("*").alias("n"), F.min(F.struct("key", "anchor", "first", "last")).alias("one"))
    by_bucket = contexts.groupBy("bucket").agg(F.sum("n").alias("all"), F.count("*").alias("kinds"), F.sum(F.col("one.last") - F.col("one.first") + width).alias("bytes")).where(F.col("all") > 1)
    shared = scratch.save(contexts.join(by_bucket, "bucket").select("bucket", "a", "b", "n", "one", "kinds", "bytes"), "shared")
    suspects = scratch.save(rows.withColumn("key", key).join(found.join(shared.select("bucket").distinct(), "bucket", "left_semi").select("key").distinct(), "key", "left_semi"), "suspects")

    alone = shared.where("kinds = 1").select("bucket", "a", "b", F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), (F.col("one.last") - F.col("one.first")).alias("hi"))).alias("runs"))
    several = shared.where("kinds > 1").groupBy("one.key").agg(F.collect_list(F.struct("bucket", "a", "b", "n", "one.anchor", "one.first", "one.last", "bytes")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["part", "common", "bucket", "a", "b", "n", "anchor", "first", "context"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 8 else pa.int64()) for i, c in enumerate(zip(*rows, strict=True))], names)

        for batch in batches:
            out: list[tuple] = []
            for text, cuts in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = text.as_py().encode()
                for c in cuts:
                    # a bucket of more text than a task sorts at a time is split, all its contexts alike, by distance from the
                    # anchor and by the hash of what all strings of like distances have in common
                    share = 1 << 30 if c["bytes"] <= BUCKET_BYTES else COVER
                    lo, place = c["first"], c["first"] + c["anchor"]
                    while lo <= c["last"]:
                        distance = c["anchor"] - (lo - c["first"])
                        hi = min(c["last"], lo + distance % share)
                        own = place - distance // share * share
                        common = content_hash(data[own : own + width - share + 1])[0] if share == COVER else 0
                        out.append((distance // share, common, c["bucket"], c["a"], c["b"], c["n"], distance, lo - c["first"], data[lo : hi + width]))
                        lo = hi + 1
                if len(out) >= 2048:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "cell"):
            cells = table["cell"].to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(cells[1:] != cells[:-1]) + 1, [len(cells)]])
            columns = {c: table[c].to_pylist() for c in ("bucket", "a", "b", "n", "anchor", "first", "context")}
            out: list[tuple] = []
            start = 0
            while start < len(edge) - 1:  # small buckets are sorted together, by their number first
                stop = start + 1
                size = sum(map(len, columns["context"][edge[start] : edge[stop]]))
                while stop < len(edge) - 1 and size < BUCKET_BYTES // 4:
                    size += sum(map(len, columns["context"][edge[stop] : edge[stop + 1]]))
                    stop += 1
                lo, hi = int(edge[start]), int(edge[stop])
                number = np.repeat(np.arange(stop - start), np.diff(edge[start : stop + 1]))
                flags = repeated_starts(columns["context"][lo:hi], columns["anchor"][lo:hi], columns["n"][lo:hi], number, width)
                for i, f in enumerate(flags, lo):
                    if f.any():
                        own = [{"lo": columns["first"][i] + x, "hi": columns["first"][i] + y} for x, y in runs(f)]
                        out.append((columns["bucket"][i], columns["a"][i], columns["b"][i], own))
                start = stop
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], kind)], ["bucket", "a", "b", "runs"])

    cells = suspects.join(several, "key").select("text", "cuts").mapInArrow(cut, "part bigint, common bigint, bucket bigint, a bigint, b bigint, n bigint, anchor bigint, first bigint, context binary").withColumn("cell", F.xxhash64("bucket", "part", "common"))
    sorted_runs = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(sort, "bucket bigint, a bigint, b bigint, runs array<struct<lo:bigint,hi:bigint>>")
    repeats = scratch.save(alone.union(sorted_runs), "repeats")
    spans = found.join(repeats, ["bucket", "a", "b"]).select("key", F.transform("runs", lambda r: F.struct((F.col("first") + r["lo"]).alias("lo"), (F.col("first") + r["hi"] + width).alias("hi"))).alias("spans"))
    by_row = scratch.save(spans.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")
    scratch.drop("shared")

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row_key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                data, kept, at, removed, n = text.as_py().encode(), [], 0, 0, 0
                for lo, hi in sorted({(s["lo"], s["hi"]) for s in spans}):
                    if lo > at or n == 0:
                        kept.append(data[at:lo])
                        n += 1
                        at = lo
                    if hi > at:
                        removed += hi - at
                        at = hi
                rest = b"".join(kept) + data[at:]
                out.append((row_key, removed, n, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 5, kinds, strict=True)], ["key", "removed", "spans", "sha", "rest"])

    changed = suspects.join(by_row, "key").select("key", "text", "spans").mapInArrow(cut_out, "key binary, removed bigint, spans bigint, sha string, rest binary").dropDuplicates(["key"])
    data = F.col("text").cast("binary")
    own = rows.select(key.alias("key"), "doc_id", F.octet_length(data).cast("bigint").alias("n_bytes"), F.sha2(data, 256).alias("whole"), *[data.alias("data")] * with_text)
    none = F.lit(0).cast("bigint")
    out = [F.coalesce("removed", none).alias("n_removed"), F.coalesce("spans", none).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256")]
    return own.join(changed, "key", "left").select("doc_id", "n_bytes", *out, *[F.coalesce("rest", "data").alias("kept")] if with_text else out[:0])
