"""Vectorised 64-bit hashing of words and five-word shingles over batches of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WINDOW = 1 << 20
_RANDOM = np.random.default_rng(20_240_501)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64)
_PLACE = _RANDOM.integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1), STEP, np.uint64)]))[:n]


_POWERS = powers(1024)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words in bytes; a word's hash is a polynomial over its lower-cased bytes."""
    at = np.flatnonzero(~_SPACE[data])
    if not len(at):
        return np.zeros(0, np.uint64), at
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
    size = np.diff(np.append(first, len(at)))
    place = np.arange(len(at)) - np.repeat(first, size)
    table = _POWERS if (most := int(size.max())) <= len(_POWERS) else powers(most)
    return mix(np.add.reduceat(_BYTE[_LOWER[data[at]]] * table[place], first) + size.astype(np.uint64)), at[first]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (one more entry than texts). Works window by window."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    hashes, starts, lo = [], [], 0
    while lo < len(data):
        hi = min(len(data), lo + WINDOW)
        while hi < len(data) and not _SPACE[data[hi - 1]]:
            hi += 1
        h, s = _words(data[lo:hi])
        hashes.append(h)
        starts.append(s + lo)
        lo = hi
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def shingles(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes; the whole word sequence if it has fewer than `width` words."""
    words, bounds = word_hashes(texts)
    if len(words) >= width:
        rolled = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            rolled += words[k : len(words) - width + 1 + k] * _PLACE[k]
        rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def text_batches(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of runs of rows of about `most` bytes; a longer text is a run of its own."""
    texts, size, first = [], 0, 0
    for i, x in enumerate(batch.column(column)):
        t = (x.as_py() or "").encode()
        if texts and size + len(t) > most:
            yield first, texts
            texts, size, first = [], 0, i
        texts.append(t)
        size += len(t)
    if texts:
        yield first, texts
