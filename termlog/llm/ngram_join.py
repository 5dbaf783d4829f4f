"""Exact Jaccard join on word n-grams, by count-vector R-trees.

A document is its set of distinct five-word shingles, hashed to 64 bits. Two sets of Jaccard similarity t or more share
some of the first (1 - t) of their shingles in any common order, rarer first here, so documents meet in blocks by such
shingles. A first pass verifies each document of a block against the block's leader, the one in most blocks, which joins
copies of one text into one component. Where a block still holds several components, its documents' shingles are hashed into groups, the
group counts are the points of an R-tree, and pairs of nodes and then of documents go on only if the sum of coordinate
minima, a bound on their overlap, can reach the similarity. Surviving pairs are verified on the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grouped, keep_rows, quoted, release, slim
from .components import components
from .hashing import mix, shingles, text_batches

BUCKET_BITS = 18
CHUNK = 4096
GROUPS = 128
LEAF = 16
#: Documents of a block up to which its pairs are listed outright; larger blocks get an R-tree.
SMALL = 16
#: Documents of a mixed block that one task may hold; larger blocks are dealt over pairs of parts.
PART = 2048
#: Rows of (doc_id, a few numbers) up to which a table is broadcast; beyond, its join shuffles.
BROADCAST_ROWS = 200_000
#: Rows of one cluster's blocks that a task searches, and pairs that it adds up before it sends them on.
DEAL_ROWS = 16384
HELD_PAIRS = 1 << 19
#: A shingle whose bucket holds so many times the mean is hot: its documents are dealt over so many tasks.
HOT = 16
SALTS = 64
#: Hashes of a set that travel in one row, so that Arrow batches of long texts stay small, and bytes of a batch made.
SET_PART = 1024
BATCH_BYTES = 1 << 20
#: One shared block is asked for each so many shingles of the smaller set, besides the first.
SHARE = 50
#: Pairs of one leader that one task verifies.
PAIRS = 2000
_SALT = np.uint64(0xD6E8FEB86659FD93)
_BUCKETS = np.uint64((1 << BUCKET_BITS) - 1)


def linked(n_a, n_b, both, percent: int):
    return 100 * both >= percent * (n_a + n_b - both)


def least_shared(n: int) -> int:
    """How many of their first shingles two linked sets share at least, the smaller having n: with prefixes longer by
    as many less one, since the first shingles in common are in both prefixes."""
    return 1 + n // SHARE


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + least_shared(n)


def point(h: np.ndarray) -> bytes:
    """Counts of a set's shingles by hash group, in the narrowest integers that hold them."""
    counts = np.bincount((h >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)
    return counts.astype(np.uint8 if counts.max() < 1 << 8 else np.uint16 if counts.max() < 1 << 16 else np.uint32).tobytes()


def points(data: list[bytes]) -> np.ndarray:
    kinds = {GROUPS: np.uint8, 2 * GROUPS: np.uint16, 4 * GROUPS: np.uint32}
    return np.stack([np.frombuffer(x, kinds[len(x)]).astype(np.int32) for x in data])


def added_up(rows: np.ndarray) -> np.ndarray:
    """Columns (x, y, shared) with each pair once, its counts added up."""
    if not rows.shape[1]:
        return rows
    order = np.lexsort((rows[1], rows[0]))
    rows = rows[:, order]
    first = np.flatnonzero(np.concatenate([[True], (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])]))
    return np.stack([rows[0][first], rows[1][first], np.add.reduceat(rows[2], first)])


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A saved table, marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= most else df


class Node:
    """A node of the R-tree: coordinate maxima and size range of its rows; children or, for a leaf, the rows."""

    __slots__ = ("children", "most", "rows", "sizes")

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, rows: np.ndarray):
        own = vectors[rows]
        self.most, self.sizes, self.rows, self.children = own.max(axis=0), (int(sizes[rows].min()), int(sizes[rows].max())), rows, ()
        if len(rows) > LEAF:
            spread = own.max(axis=0) - own.min(axis=0)
            lo, hi = self.sizes
            key = sizes[rows] if hi > 1.2 * lo else own[:, int(spread.argmax())]
            order = rows[np.argsort(key, kind="stable")]
            self.children = (Node(vectors, sizes, order[: len(order) // 2]), Node(vectors, sizes, order[len(order) // 2 :]))


def tree_pairs(vectors: np.ndarray, sizes: np.ndarray, component: np.ndarray, percent: int, part: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows in different components (and in different parts, if given two) whose bound allows a link, those of
    two leaves at a time."""
    stack = [(root := Node(vectors, sizes, np.arange(len(sizes))), root)]
    while stack:
        a, b = stack.pop()
        if 100 * a.sizes[1] < percent * b.sizes[0] or 100 * b.sizes[1] < percent * a.sizes[0]:
            continue
        if not linked(a.sizes[0], b.sizes[0], min(int(np.minimum(a.most, b.most).sum()), a.sizes[1], b.sizes[1]), percent):
            continue
        if a.children or b.children:
            if a is b:
                x, y = a.children
                stack += [(x, x), (x, y), (y, y)]
            elif a.children and (not b.children or len(a.rows) >= len(b.rows)):
                stack += [(x, b) for x in a.children]
            else:
                stack += [(a, x) for x in b.children]
            continue
        i, j = np.repeat(a.rows, len(b.rows)), np.tile(b.rows, len(a.rows))
        keep = (component[i] != component[j]) & ((i < j) | (a is not b))
        if part is not None:
            keep &= part[i] != part[j]
        i, j = i[keep], j[keep]
        if len(i):
            bound = np.minimum(vectors[i], vectors[j]).sum(axis=1, dtype=np.int64)
            ok = linked(sizes[i], sizes[j], bound, percent)
            yield i[ok], j[ok]


def _scan(docs: DataFrame) -> DataFrame:
    """Rows of kind 0: doc_id, set size, 128-bit set hash and point. Rows of kind 1: a task's shingle counts by hash bucket."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts = np.zeros(1 << BUCKET_BITS, np.uint32)
        names = ["kind", "doc_id", "n", "a", "b", "vector", "chunk", "counts"]
        for batch in batches:
            n, a, b, vectors = [], [], [], []
            for _, texts in text_batches(batch, 1):
                found = shingles(texts)
                for h in found:
                    n.append(len(h))
                    a.append(int(mix(h).sum(dtype=np.uint64).astype(np.int64)))
                    b.append(int(mix(h ^ _SALT).sum(dtype=np.uint64).astype(np.int64)))
                    vectors.append(point(h))
                counts += np.bincount((np.concatenate(found) & _BUCKETS).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int32)), batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(vectors, pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        parts = counts.reshape(-1, CHUNK)
        rows = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(rows, np.int32)), pa.nulls(rows, pa.int64()), *[pa.nulls(rows, pa.int64())] * 3, pa.nulls(rows, pa.binary()), pa.array(np.arange(rows, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names)

    return docs.mapInArrow(scan, "kind int, doc_id bigint, n bigint, a bigint, b bigint, vector binary, chunk int, counts binary")


def _bucket_counts(scanned: DataFrame) -> np.ndarray:
    """Shingles by hash bucket over the whole corpus: 2**18 sums, whatever its size."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(data, np.uint32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "counts"])

    rows = scanned.where("kind = 1").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect()
    out = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in rows:
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], np.int64)
    return out


def _keys(docs: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(key, doc_id, salt): the first shingles of each set, rarer first. A task emits a set that it has just seen once
    only. salt is -1 but for hot keys."""
    sent, hot = docs.sparkSession.sparkContext.broadcast(counts), HOT * max(counts.mean(), 1)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts, seen = sent.value, {}
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for first, texts in text_batches(batch, 1):
                found, owner, salt = [], [], []
                for i, h in enumerate(shingles(texts), first):
                    if not len(h) or (own := h.tobytes() if len(h) < 4 else (len(h), int(mix(h).sum(dtype=np.uint64)), int(h[0]))) in seen:
                        continue
                    if len(seen) > 100_000:
                        seen.clear()
                    seen[own] = None
                    size = prefix_size(len(h), percent)
                    rare = counts[(h & _BUCKETS).astype(np.int64)]
                    order = np.argsort(rare, kind="stable")[:size]  # h is sorted, so ties go by hash
                    found.append(h[order])
                    owner.append(np.full(size, ids[i], np.int64))
                    salt.append(np.where(rare[order] > hot, ids[i] % SALTS, -1).astype(np.int32))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(owner)), pa.array(np.concatenate(salt))], ["key", "doc_id", "salt"])

    return docs.where("doc_id is not null").mapInArrow(keys, "key bigint, doc_id bigint, salt int")


def _blocks(keys: DataFrame) -> DataFrame:
    """(key, doc_id) of keys with more than one document, or hot. Streams: no block is held."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, waiting = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc, salt = (batch.column(i).to_numpy() for i in range(3))
            if waiting is not None:
                key, doc, salt = (np.append(w, c) for w, c in zip(waiting, (key, doc, salt), strict=True))
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(first, len(key)))
            keep = (size > 1) | (salt[first] >= 0)
            keep[0] |= waiting is None and key[0] == last_key
            waiting = None if keep[-1] else (key[-1:], doc[-1:], salt[-1:])
            last_key = key[-1]
            rows = np.repeat(keep, size)
            yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(doc[rows])], ["key", "doc_id"])

    return keys.repartition("key", "salt").sortWithinPartitions("key", "doc_id").mapInArrow(blocks, "key bigint, doc_id bigint")


def _star_pairs(blocks: DataFrame, scratch: Scratch) -> DataFrame:
    """(x, y, shared): each document y with the leaders x of its blocks, and of how many."""
    degree = scratch.save(blocks.groupBy("doc_id").agg(F.count("*").alias("degree")), "degree")
    leaders = blocks.join(sized(degree), "doc_id").groupBy("key").agg(F.max(F.struct(F.col("degree"), -F.col("doc_id"))).alias("leader"))
    return blocks.join(leaders, "key").select((-F.col("leader.col2")).alias("x"), F.col("doc_id").alias("y")).where("x != y").groupBy("x", "y").agg(F.count("*").alias("shared"))


def _bounded(pairs: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs(x, y, shared) whose sizes, shared blocks and sum of coordinate minima allow a link."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                n, m = batch.column(2).to_numpy(), batch.column(4).to_numpy()
                both = np.minimum(points(batch.column(3).to_pylist()), points(batch.column(5).to_pylist())).sum(axis=1, dtype=np.int64)
                yield batch.select(["x", "y"]).filter(pa.array(linked(n, m, both, percent)))

    x = vectors.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("vector").alias("vx"))
    y = vectors.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("vector").alias("vy"))
    fits = (100 * F.col("nx") >= percent * F.col("ny")) & (100 * F.col("ny") >= percent * F.col("nx"))
    fits &= F.col("shared") >= 1 + F.floor(F.least("nx", "ny") / SHARE)
    return pairs.join(y, "y").join(x, "x").where(fits).select("x", "y", "nx", "vx", "ny", "vy").mapInArrow(bound, "x bigint, y bigint").distinct()


def _verified(pairs: DataFrame, texts: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Links (a, b) among pairs(x, y), by their whole sets. Each text goes to its pairs' x, hot ones in several parts."""
    parts = pairs.groupBy("x").agg(F.ceil(F.count("*") / PAIRS).cast("int").alias("parts"))
    dealt = pairs.join(parts, "x").select(F.col("y").alias("doc_id"), "x", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int").alias("part"))
    own = parts.select(F.col("x").alias("doc_id"), "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = dealt.union(own).groupBy("doc_id").agg(F.collect_list(F.xxhash64("x", "part")).alias("groups"), F.collect_list(F.col("x") == F.col("doc_id")).alias("leads"))
    wanted = sized(scratch.save(wanted, name))

    names = ["group", "follows", "doc_id", "n", "a", "part", "hashes"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        rows, size = [], 0

        def made() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            groups, leads, ids = (batch.column(i).to_pylist() for i in (2, 3, 0))
            for first, run in text_batches(batch, 1, 1 << 18):
                for i, h in enumerate(shingles(run), first):
                    own = int(mix(h).sum(dtype=np.uint64).astype(np.int64))
                    for part, lo in enumerate(range(0, len(h), SET_PART)):
                        data = h[lo : lo + SET_PART].tobytes()
                        for g, lead in zip(groups[i], leads[i], strict=True):
                            rows.append((g, not lead, ids[i], len(h), own, part, data))
                            size += len(data)
                            if size > BATCH_BYTES:
                                yield made()
                                rows, size = [], 0
        yield made()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets come part by part, a group's leaders first; of the others only the words shared so far are kept."""
        group, leaders, now, both = None, {}, None, []  # leaders: (doc_id, a) -> parts, then the whole set
        a, b = [], []

        def close() -> None:
            if now is not None:
                for (lead, _), other, k in zip(leaders, leaders.values(), both, strict=True):
                    if linked(now[1], len(other), k, percent):
                        a.append(now[0])
                        b.append(lead)

        for batch in batches:
            edge, data = np.frombuffer(batch.column(6).buffers()[1], np.int32)[batch.column(6).offset :] // 8, np.frombuffer(batch.column(6).buffers()[2] or b"", np.uint64)
            for i, (g, follows, doc, n, own, part) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True)):
                h = data[edge[i] : edge[i + 1]]
                if g != group:
                    close()
                    group, leaders, now = g, {}, None
                if not follows:
                    parts = leaders.setdefault((doc, own), [])
                    if part == len(parts):  # not the same again: a repeated row
                        parts.append(h.copy())
                    continue
                if now is None or now[0] != doc or now[2] != own:
                    if now is None:
                        leaders = {k: np.concatenate(x) for k, x in leaders.items()}
                    close()
                    now, both, done = (doc, n, own), [0] * len(leaders), 0
                if part != done:
                    continue
                done += 1
                for k, other in enumerate(leaders.values()):
                    if 100 * min(n, len(other)) >= percent * max(n, len(other)):
                        at = np.searchsorted(other, h)
                        at[at == len(other)] = 0
                        both[k] += int((other[at] == h).sum())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a.clear()
            b.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    made = texts.join(wanted, "doc_id").select("doc_id", "text", "groups", "leads").mapInArrow(sets, "group bigint, follows boolean, doc_id bigint, n bigint, a bigint, part int, hashes binary")
    return made.repartition("group").sortWithinPartitions("group", "follows", "doc_id", "a", "part").mapInArrow(verify, "a bigint, b bigint")


def _mixed(named: DataFrame) -> DataFrame:
    """Rows of blocks(key, doc_id, component) with more than one component, with their blocks' sizes."""
    sizes = named.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.count("*").alias("size")).where("least != most")
    return named.join(sizes.select("key", "least", "size"), "key")


def _block_pairs(mixed: DataFrame) -> DataFrame:
    """(x, y): the pairs of different components in blocks of SMALL documents at most."""

    def list_pairs(key: np.ndarray, doc: np.ndarray, comp: np.ndarray) -> pa.RecordBatch:
        edge = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        x, y = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size in range(2, SMALL + 1):  # blocks of one size at a time
            lo = edge[:-1][np.diff(edge) == size]
            for i in range(size):
                for j in range(i):
                    apart = comp[lo + i] != comp[lo + j]
                    p, q = doc[lo + i][apart], doc[lo + j][apart]
                    x.append(np.minimum(p, q))
                    y.append(np.maximum(p, q))
        x, y = np.concatenate(x), np.concatenate(y)
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["x", "y"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3  # the rows of a small block that a batch has cut
        for batch in batches:
            small = [np.append(h, batch.column(i).to_numpy()) for i, h in enumerate(held)]
            earlier = np.flatnonzero(small[0] != small[0][-1:])  # not of the last block
            cut = int(earlier[-1]) + 1 if len(earlier) else 0
            held = [c[cut:] for c in small]
            yield list_pairs(*(c[:cut] for c in small))
        yield list_pairs(*held)

    small = mixed.where(F.col("size") <= SMALL).select("key", "doc_id", "component")
    return small.repartition("key").sortWithinPartitions("key").mapInArrow(pairs, "x bigint, y bigint")


def _tree_candidates(mixed: DataFrame, vectors: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y, shared) that the R-trees of larger blocks leave, and in how many they do."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held, n_held = [np.zeros((3, 0), np.int64)], 0  # x, y, shared: added up over the task, as one pair meets in many cells

        def batch_of(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c) for c in rows], ["x", "y", "shared"])

        for table in grouped(batches, "cell"):
            cells = table["cell"].to_numpy()
            doc, comp, n, side, two = (table[c].to_numpy() for c in ("doc_id", "component", "n", "side", "two"))
            vectors = points(table["vector"].to_pylist())
            first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            for lo, hi in zip(first, np.append(first[1:], len(cells)), strict=True):
                for i, j in tree_pairs(vectors[lo:hi], n[lo:hi], comp[lo:hi], percent, side[lo:hi] if two[lo] else None):
                    p, q = doc[lo + i], doc[lo + j]
                    held.append(np.stack([np.minimum(p, q), np.maximum(p, q), np.ones(len(p), np.int64)]))
                    n_held += len(p)
                    if n_held > HELD_PAIRS:
                        found = added_up(np.concatenate(held, axis=1))
                        if found.shape[1] > HELD_PAIRS // 2:
                            yield batch_of(found)
                            found = found[:, :0]
                        held, n_held = [found], found.shape[1]
        yield batch_of(added_up(np.concatenate(held, axis=1)))

    counted = mixed.where(F.col("size") > SMALL).withColumn("parts", F.ceil(F.col("size") / PART).cast("int")).withColumn("side", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    dealt = counted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = dealt.select(F.xxhash64("key", F.least("side", "other"), F.greatest("side", "other")).alias("cell"), "least", "doc_id", "component", "side", (F.col("other") != F.col("side")).alias("two")).distinct()
    # blocks of one cluster go to as few tasks as can search them, where their pairs are added up before they are shuffled
    deals = counted.groupBy("least").agg(F.ceil(F.sum("parts") / DEAL_ROWS).alias("deals"))
    # a document meets its own part in the cell (side, side) only, and another part in the cell of both
    joined = cells.join(deals, "least").join(vectors.select("doc_id", "n", "vector"), "doc_id").select(F.xxhash64("least", F.pmod("cell", "deals")).alias("deal"), "cell", "doc_id", "component", "n", "side", "two", "vector")
    return joined.repartition("deal").sortWithinPartitions("cell").mapInArrow(search, "x bigint, y bigint, shared bigint")


def jaccard_components(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id reachable by links, itself included).

    Every pair of Jaccard similarity of `percent` / 100 or more is a link; none between different texts is lost. A null
    or empty text, or one without words, has 0 shingles and is linked with nothing; of fewer than five words, the whole
    sequence is its one shingle; rows with a null id have no links and a null component; rows that repeat an id are one
    node; an empty table gives no rows; other columns are not read.

    Texts are hashed a megabyte at a time; a set is 8 bytes a word, held whole for a block's leader only.

    Copies of one set are found by its 128-bit hash and joined to the least of them. Nothing about all documents reaches
    the driver but 2**18 bucket sums.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    rows = slim(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    scanned = scratch.save(_scan(rows), "scanned")
    sets = scanned.where("kind = 0").select("doc_id", "n", "a", "b", "vector")
    blocks = scratch.save(_blocks(_keys(rows, _bucket_counts(scanned), percent)), "blocks")
    stars = scratch.save(_bounded(_star_pairs(blocks, scratch), sets, percent), "stars")
    links = scratch.save(_verified(stars, rows, percent, scratch, "star_texts"), "links")
    first = scratch.save(components(links, scratch), "first")
    named = blocks.select("key", "doc_id").join(sized(first), blocks["doc_id"] == first["node"], "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = scratch.save(_mixed(named), "mixed")
    scratch.drop("blocks", "degree", "star_texts")
    listed = _block_pairs(mixed).groupBy("x", "y").agg(F.count("*").alias("shared"))
    searched = _tree_candidates(mixed, sets, percent)
    met = listed.union(searched).groupBy("x", "y").agg(F.sum("shared").alias("shared"))
    known = stars.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    candidates = scratch.save(_bounded(met.join(known, ["x", "y"], "left_anti"), sets, percent), "candidates")
    more = scratch.save(_verified(candidates, rows, percent, scratch, "more_texts"), "more")
    scratch.drop("mixed", "stars", "candidates", "more_texts")
    least = scratch.save(sets.where("n > 0 and doc_id is not null").groupBy("n", "a", "b").agg(F.min("doc_id").alias("rep")), "least")
    owned = sets.join(least, ["n", "a", "b"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("rep"))
    # a task sends one of its copies only, not always the least: every node of either pass is joined to its rep
    nodes = first.select("node").union(more.select("a")).union(more.select("b")).distinct()
    copies = nodes.join(owned, F.col("node") == F.col("doc_id")).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = scratch.save(components(links.union(more).union(copies), scratch), "final")
    return owned.join(final, owned["rep"] == final["node"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def keep_one(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, but of each component only the rows of the least id.

    Rows with a null id, and texts that are null, empty or without words, stay; rows that repeat an id stay or go together;
    an empty table stays empty; ids and texts are read by name, and no other column can clash."""
    gone = jaccard_components(docs, percent, id_col, text_col).where("doc_id != component_id").select(F.col("doc_id").alias("_gone"))
    gone = Scratch(docs.sparkSession, "gone").save(gone, "gone")
    return keep_rows(docs, F.col(quoted(id_col)), gone, "_gone")
