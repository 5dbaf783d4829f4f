"""Passages of many words that texts share, found by anchored windows of words.

Among any `words` words in a row the least hashed 8-word shingle is an anchor, so texts that share such a run share an
anchor in it. Around each anchor a few windows, a stride apart, are hashed: whatever the anchor's place in a shared run, one
of them lies inside it. A window that stands in two texts is a shared passage of at least its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, grouped, release
from .hashing import _PLACE, mix, text_batches, word_hashes
from .suffix_dedup import WINDOW, _weights, leftmost_minima

SHINGLE = 8
STRIDE = 14
#: Windows that a task puts in order at a time.
HELD = 1 << 21


def window_words(words: int) -> int:
    """The length of the hashed windows: a shared run of over `words` words holds one of them at some stride."""
    return words + 1 - STRIDE - 1


def windows(h: np.ndarray, words: int) -> np.ndarray:
    """Distinct hashes of a text's anchored windows, from its words' hashes; none for a text of `words` words or fewer."""
    size, out = window_words(words), [np.zeros(0, np.uint64)]
    weight, back = _weights()
    span = words - SHINGLE + 1
    for lo in range(0, max(len(h) - words, 0), WINDOW - words):
        part = h[lo : lo + WINDOW]
        n = len(part)
        rolled = np.zeros(n - SHINGLE + 1, np.uint64)
        for k in range(SHINGLE):
            rolled += part[k : n - SHINGLE + 1 + k] * _PLACE[k]
        anchors = np.unique(leftmost_minima(mix(rolled), span))
        starts = np.unique((anchors[:, None] - STRIDE * np.arange(-(-words // STRIDE))).ravel())
        starts = starts[(starts >= 0) & (starts <= n - size)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part * weight[:n])])
        out.append(mix((sums[starts + size] - sums[starts]) * back[starts]))
    return np.unique(np.concatenate(out))


def shared_passages(rows: DataFrame, words: int = 50) -> DataFrame:
    """(id, n_shared_windows) of the rows(id bigint, text) that share a run of over `words` words with a row of another id.

    Rows with n windows in common with others may also share somewhat shorter runs, of window_words(words) words at least;
    words are equal up to the case of A-Z. Null, empty and short texts share nothing; an empty table gives no rows. A task
    settles what its own rows share and sends each window once, so a passage that a third of all rows hold is as many
    rows as there are tasks.
    """
    scratch = Scratch(rows.sparkSession, "passages")

    def settle(found: list[np.ndarray], owner: list[np.ndarray]) -> pa.RecordBatch:
        h, i = np.concatenate(found), np.concatenate(owner)
        order = np.lexsort((i, h))
        h, i = h[order], i[order]
        first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, len(h)))
        several = np.repeat(i[start] != i[np.append(start[1:], len(h)) - 1] if len(h) else np.zeros(0, bool), size)
        ids, n = np.unique(i[several], return_counts=True)
        nothing = np.zeros(len(ids), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[first].view(np.int64), nothing])), pa.array(np.concatenate([i[first], ids])), pa.array(np.concatenate([np.zeros(len(start), np.int64), n]))], ["hash", "id", "n"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with n = 0: a window and one of its rows; with n > 0: a row and how many windows others of the task share."""
        release()
        found, owner, held = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for at, texts in text_batches(batch, 1):
                h, bounds = word_hashes(texts)
                for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:], strict=True), at):
                    if hi - lo > words:
                        own = windows(h[lo:hi], words)
                        found.append(own)
                        owner.append(np.full(len(own), ids[k]))
                        held += len(own)
                if held > HELD:
                    yield settle(found, owner)
                    found, owner, held = found[:1], owner[:1], 0
        yield settle(found, owner)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "hash"):
            made = settle([table["hash"].to_numpy().view(np.uint64)], [table["id"].to_numpy()])
            yield made.filter(pa.array(made.column(2).to_numpy() > 0)).select(["id", "n"])

    scanned = scratch.save(rows.select("id", "text").mapInArrow(scan, "hash bigint, id bigint, n bigint"), "windows")
    met = scanned.where("n = 0").select("hash", "id").repartition("hash").sortWithinPartitions("hash").mapInArrow(meet, "id bigint, n bigint")
    counted = met.union(scanned.where("n > 0").select("id", "n")).groupBy("id").agg(F.sum("n").alias("n_shared_windows"))
    out = scratch.save(counted, "shared")
    scratch.drop("windows")
    return out
