"""Best-fit packing by minimum bin slack.

The plan works on the histogram of piece lengths, which has at most `capacity` entries at any corpus size. A bin takes
the longest length left and the fullest combination for the rest, found by subset-sum dynamic programming over a bitset
of reachable sums; the combination is removed as often as the counts allow, so that each step uses up a length. Pieces
then find their bin from their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Encoder, loaded, run_ids
from .common import Scratch, slim


def fullest(room: int, counts: dict[int, int], lengths: list[int]) -> list[tuple[int, int]]:
    """[(length, how many)] with the largest sum of at most `room`, longer lengths tried first."""
    reach, full, steps = 1, (1 << room + 1) - 1, []
    for length in lengths:
        if length > room:
            continue
        left, take = min(counts[length], room // length), 1
        while left:  # binary splitting of the multiplicity
            take = min(take, left)
            grown = (reach | reach << length * take) & full
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return sorted(used.items(), reverse=True)


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(how many bins, [(length, how many in each)])] covering the whole histogram."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    lengths, out = sorted(counts, reverse=True), []
    while lengths:
        longest = lengths[0]
        counts[longest] -= 1
        combination = dict(fullest(capacity - longest, counts, [x for x in lengths if counts[x]])) if longest < capacity else {}
        counts[longest] += 1
        combination[longest] = combination.get(longest, 0) + 1
        times = min(counts[x] // m for x, m in combination.items())
        for x, m in combination.items():
            counts[x] -= m * times
        out.append((times, sorted(combination.items(), reverse=True)))
        lengths = [x for x in lengths if counts[x]]
    return out


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool, id_col: str, text_col: str) -> DataFrame:
    ids_field = ", ids array<int>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(tokenizer, Encoder)
        end, task, seen = end_id.to_bytes(4, "little"), TaskContext.get().partitionId(), {}
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"] + ["ids"] * with_ids
        for batch in batches:
            rows: list[tuple] = []
            for key, ids in zip(batch.column(0).to_pylist(), run_ids(batch.column(1), encoder), strict=True):
                data = ids.tobytes() + end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    length = len(part) // 4
                    nth = seen[length] = seen.get(length, -1) + 1
                    rows.append((key, piece, at // 4, length, zlib.crc32(part), task, nth) + ((np.frombuffer(part, "<u4").astype("i4").tolist(),) if with_ids else ()))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            kinds = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return slim(docs, id_col, text_col).mapInArrow(cut, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint{ids_field}")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if with_ids).

    A null or empty text is the end id alone; only documents of more than `capacity` ids are cut. Repeated rows are
    packed each; null ids stay; an empty table gives no rows; other columns are not read. Pieces are written once to the
    shared folder, so ranks hold whichever executors are lost later. The driver sees only the length histogram
    (at most `capacity` rows); the plan, sent to executors, has at most a few rows for each length.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    pieces = scratch.save(cut_pieces(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col), "pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = scratch.save(by_task.withColumn("rank0", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")), "ranks")
    histogram = {r[0]: r[1] for r in before.groupBy("length").agg(F.sum("n")).collect()}

    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    given, sequence = dict.fromkeys(histogram, 0), 0
    for times, combination in plan_bins(histogram, capacity):
        offset = 0
        for length, m in combination:
            ranges.setdefault(length, []).append((given[length], m, sequence, offset))
            given[length] += m * times
            offset += m * length
        sequence += times
    plan = {k: np.array(v, np.int64) for k, v in ranges.items()}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            sequence_id, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(own):
                    rows = plan[int(length[own[0]])]
                    lo, m, first, at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1].T
                    nth = rank[own] - lo
                    sequence_id[own], offset[own] = first + nth // m, at + nth % m * length[own]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence_id), pa.array(offset)], [*kept, "sequence_id", "offset"])

    ranked = pieces.join(before.select("task", "length", "rank0"), ["task", "length"]).withColumn("rank", F.col("rank0") + F.col("nth"))
    out = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "rank")
    return out.mapInArrow(assign, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name != "rank") + ", sequence_id bigint, offset bigint")
