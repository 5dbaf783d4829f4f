"""Language ID by multilingual mixture inference.

A model holds, for each language, byte-trigram counts over lower-cased letters; a word's likelihood under a language is
that of its bytes given the two before. Expectation-maximisation estimates a document's language proportions from its
words' likelihoods, and the language set is the one of highest penalised likelihood among the nested sets that the full
mixture ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slim

BUCKET_BITS = 18
WINDOW = 1 << 19
#: Rows worked on at a time.
SLICE = 256
_SMOOTH = 0.05
#: Letters and all bytes over 0x7F keep their place in a word; anything else ends it.
_FOLD = np.array([b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)], np.uint8)


@dataclass
class Model:
    langs: list[str]
    trigrams: np.ndarray  # [bucket, language] log of count + smoothing
    bigrams: np.ndarray  # [context, language] log of count + smoothing over all bytes


def _codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of letters, their trigram buckets and their contexts. data starts with two spaces."""
    at = np.flatnonzero(data != 0x20)
    a, b, c = data[at - 2].astype(np.uint32), data[at - 1].astype(np.uint32), data[at].astype(np.uint32)
    a[b == 0x20] = 0x20  # a word begins with no memory of the last one
    context = a << np.uint32(8) | b
    return at, (context << np.uint32(8) | c) * np.uint32(2654435761) >> np.uint32(32 - BUCKET_BITS), context


def _joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The folded bytes of all texts, each after two spaces, and where each text starts; ends with a space."""
    low = pc.fill_null(pc.utf8_lower(texts), "").to_pylist()
    parts = [x.encode() for x in low]
    sizes = np.array([len(x) + 2 for x in parts], np.int64)
    data = np.frombuffer(b"  " + b"  ".join(parts) + b"  ", np.uint8)
    return _FOLD[data], np.concatenate([[0], np.cumsum(sizes)])


def held_out(id_col: str = "doc_id"):
    """Whether a document is held out of learning; one without an id isn't."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", most_langs: int = 128) -> Model:
    """Counts over all rows with a language and a text; each task sends its distinct trigrams only.

    The driver gets at most 2**18 + 2**16 counts for each language, 12 bytes each in packed arrays, whatever the corpus
    size; more than `most_langs` languages are an error. No labelled row at all gives a model without languages, which answers `und`.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            table = pa.Table.from_batches([batch])
            for lang in pc.unique(table["lang"]).to_pylist():
                tri, bi = found.setdefault(lang, (np.zeros(1 << BUCKET_BITS, np.int64), np.zeros(1 << 16, np.int64)))
                if len(found) > most_langs:
                    raise ValueError(f"more than {most_langs} languages")
                data, _ = _joined(table.filter(pc.equal(table["lang"], lang))["text"].combine_chunks())
                _, bucket, context = _codes(data)
                tri += np.bincount(bucket, minlength=len(tri))
                bi += np.bincount(context, minlength=len(bi))
        for lang, both in found.items():
            for kind, counts in enumerate(both):
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "kind", "code", "n"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Many counts of one language and kind in a row, as the bytes of two arrays."""
        names = ["lang", "kind", "codes", "counts"]
        for batch in batches:
            lang, kind = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            code, n = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            groups: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(lang, kind, strict=True)):
                groups.setdefault(key, []).append(i)
            rows = [(*key, code[own].astype("<i4").tobytes(), n[own].astype("<i8").tobytes()) for key, own in groups.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, [pa.string(), pa.int32(), pa.binary(), pa.binary()], strict=True)], names)

    labelled = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    summed = labelled.mapInArrow(count, "lang string, kind int, code int, n bigint").groupBy("lang", "kind", "code").agg(F.sum("n").alias("n"))
    rows = summed.mapInArrow(packed, "lang string, kind int, codes binary, counts binary").collect()
    langs = sorted({r["lang"] for r in rows})
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    index = {x: i for i, x in enumerate(langs)}
    tables = [np.zeros((1 << BUCKET_BITS, len(langs)), np.float32), np.zeros((1 << 16, len(langs)), np.float32)]
    for r in rows:
        tables[r["kind"]][np.frombuffer(r["codes"], "<i4"), index[r["lang"]]] = np.frombuffer(r["counts"], "<i8")
    return Model(langs, np.log(tables[0] + np.float32(_SMOOTH)), np.log(tables[1] + np.float32(256 * _SMOOTH)))


def _words(data: np.ndarray, starts: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihoods [word, language] and each word's text, worked out window by window to bound memory."""
    likely, owner, lo = [], [], 0
    while lo < len(data):
        hi = min(len(data), lo + WINDOW)
        while hi < len(data) and data[hi - 1] != 0x20:
            hi += 1  # windows end between words
        part = np.concatenate([np.full(2, 0x20, np.uint8), data[lo:hi]])
        at, bucket, context = _codes(part)
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
            likely.append(np.add.reduceat(model.trigrams[bucket] - model.bigrams[context], first, axis=0))
            owner.append(np.searchsorted(starts, at[first] - 2 + lo, side="right") - 1)
        lo = hi
    if not likely:
        return np.zeros((0, len(model.langs)), np.float32), np.zeros(0, np.int64)
    return np.concatenate(likely), np.concatenate(owner)


def mixtures(likely: np.ndarray, owner: np.ndarray, n: int, rounds: int, penalty: float) -> np.ndarray:
    """Proportions [text, language] of the selected sets; a row of zeros for a text without words. EM runs for `rounds`
    rounds, the same for all, so that no text's answer depends on those beside it."""
    langs = likely.shape[1]
    out = np.zeros((n, langs))
    if not len(owner) or not langs:
        return out
    first = np.flatnonzero(np.concatenate([[True], np.diff(owner) > 0]))
    doc = np.cumsum(np.concatenate([[0], (np.diff(owner) > 0).astype(np.int64)]))
    words = np.diff(np.append(first, len(owner))).astype(np.float64)[:, None]
    top = likely.max(axis=1, keepdims=True)
    p = np.exp(np.maximum(likely - top, -60.0)).astype(np.float32)

    def em(pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            r = p * pi.astype(np.float32)[doc]
            r /= r.sum(axis=1, keepdims=True) + np.float32(1e-30)
            pi = np.add.reduceat(r, first, axis=0) / words
        s = np.log((p * pi.astype(np.float32)[doc]).sum(axis=1) + np.float32(1e-30))
        return pi, np.add.reduceat(s, first)

    full, whole = em(np.full((len(first), langs), 1.0 / langs))
    place = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    best, score = None, None
    going = np.ones(len(first), bool)  # each text stops by itself, at the first size over 2 by which it gains nothing
    for k in range(1, langs + 1):
        pi, value = (full, whole) if k == langs else em(np.where(place < k, full + 1e-9, 0) / np.where(place < k, full + 1e-9, 0).sum(axis=1, keepdims=True))
        value = value - penalty * k * np.log(words[:, 0] + 1)
        if best is None:
            best, score = pi, value
            continue
        better = going & (value > score)
        best, score = np.where(better[:, None], pi, best), np.where(better, value, score)
        if k > 2:
            going &= better
            if not going.any():
                break
    out[owner[first]] = best
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8, penalty: float = 1.0) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (the proportion of that language), langs (all, with proportions).

    `und` with score 0 if the text is null, empty or without a letter, or the model has no language; ties go to the
    language first in the alphabet. Null ids and repeated rows stay; an empty table gives no rows; other columns are not
    read. Whole texts count; work is done in windows, so a very long text needs memory for its words only.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = batch.column(1)
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_pylist()
                pi = mixtures(*_words(*_joined(texts), model), len(texts), rounds, penalty) if model.langs else np.zeros((len(texts), 1))
                best = pi.argmax(axis=1)
                known = [ok and pi[i, best[i]] > 0 for i, ok in enumerate(letters)]
                lang = [model.langs[b] if ok else "und" for b, ok in zip(best, known, strict=True)]
                score = [float(min(1.0, pi[i, b])) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, known, strict=True))]
                mixed = [",".join(f"{model.langs[j]}:{row[j]:.3f}" for j in np.argsort(-row, kind="stable") if row[j] >= 0.0005) if ok else "" for row, ok in zip(pi, known, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mixed, pa.string())], ["doc_id", "lang_pred", "score", "langs"])

    kind = docs.schema[id_col].dataType.simpleString()
    return slim(docs, id_col, text_col).mapInArrow(infer, f"doc_id {kind}, lang_pred string, score double, langs string")


def keep_known(docs: DataFrame, model: Model, least: float = 0.34, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, in which one learned language has at least the share `least`; the others are
    rejected: `und`, or a mixture without a main language.

    A null or empty text is rejected, as is any text if the model has no language; repeated rows are judged alike; an empty
    table stays empty; only the text is read, and no other column can clash. No shuffle, no join."""
    sent, at_text = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                texts = batch.column(at_text)
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False)
                share = mixtures(*_words(*_joined(texts), model), len(texts), 8, 1.0).max(axis=1) if model.langs else np.zeros(len(texts))
                yield batch.filter(pc.and_(letters, pa.array(share >= least)))

    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # names with dots can't pass
    return plain.mapInArrow(choose, plain.schema).toDF(*docs.columns)
