"""Heap-and-linked-list byte-pair merging for byte-level vocabularies whose words end in a suffix.

Texts are cut into chunks at ASCII white space, which no token of such a vocabulary crosses, many texts at a time. Chunks
repeat so often that only the distinct ones of a run are looked up, and most of those are answered from a bounded cache.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import keep

#: Bytes of texts that are cut into chunks at a time.
RUN_BYTES = 1 << 23
#: Chunks whose ids are put together at a time.
GATHERED = 1 << 18
#: Words up to the last of these many bytes are merged together, with those of like length.
LOCKSTEP = (8, 16, 32)
#: Letters whose lower case and composed form are one letter each, then punctuation: most chunks are of this kind.
PLAIN = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[.,!?;:]*)$"
LOCKSTEP_ROWS = 1 << 15
_NONE = np.int64(1) << 40


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100 on."""
    out, extra = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(extra))
            extra += 1
    return out


class WordBpe:
    """A vocabulary file of the tokenizers library: NFC, lower case, word pattern, byte level, word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        shape = [x["type"] for x in spec["normalizer"]["normalizers"]], [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]]
        if model["type"] != "BPE" or shape != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]):
            raise ValueError(f"{path}: not a lower-casing byte-level BPE vocabulary with word ends")
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        alphabet = byte_alphabet()
        self.inner = [vocab[c] for c in alphabet]
        self.final = [vocab[c + suffix] for c in alphabet]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        for r, (a, b) in enumerate(pairs):
            self.rank[vocab[a]][vocab[b]] = r
        self.made = [vocab[a + b] for a, b in pairs]
        self.first_ids = np.array([self.inner, self.final], np.int64)
        codes = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.by_code = np.argsort(codes)
        self.codes, self.made_ids = codes[self.by_code], np.array(self.made, np.int64)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, word: bytes) -> tuple[list[int], int]:
        """(symbols with -1 where merged away, merges): repeatedly pops the lowest-rank adjacent pair, leftmost first."""
        n, rank, made = len(word), self.rank, self.made
        ids = [self.inner[b] for b in word]
        ids[-1] = self.final[word[-1]]
        bits = 12 if n < 4096 else 40  # a heap entry is rank and place in one integer, small where it can be
        place, heap, last = (1 << bits) - 1, [], ids[0]
        for i in range(1, n):
            x = ids[i]
            if x in (row := rank[last]):
                heap.append(row[x] << bits | i - 1)
            last = x
        if not heap:
            return ids, 0
        heapify(heap)
        after, before, merges = list(range(1, n + 1)), list(range(-1, n - 1)), 0
        while heap:
            top = heappop(heap)
            r, i = top >> bits, top & place
            j = after[i]
            if ids[i] < 0 or j >= n or rank[ids[i]].get(ids[j]) != r:
                continue  # stale: one side has since been merged
            new = ids[i] = made[r]
            ids[j] = -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if ids[k] in (row := rank[new]):
                    heappush(heap, row[ids[k]] << bits | i)
            h = before[i]
            if h >= 0 and new in (row := rank[ids[h]]):
                heappush(heap, row[new] << bits | h)
        return ids, merges

    def words(self, part: str) -> list[str]:
        s = part if part.isascii() else unicodedata.normalize("NFC", part)
        s = s.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        if s.isalpha():
            return [s]
        core = s.rstrip(".,!?;:")
        if core.isalpha():
            return [core, s[len(core) :]]
        return self.pieces.findall(s)

    def split(self, chunk: str) -> list[str | int]:
        """Words, and the ids of special strings, in order."""
        if "<" not in chunk or not self.specials:
            return self.words(chunk)
        return [x for part in self.specials.split(chunk) if part for x in ([self.special[part]] if part in self.special else self.words(part))]

    def count_word(self, word: str) -> int:
        b = word.encode()
        return len(b) - self.merge(b)[1]

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b), or _NONE; -1 is past a word's end."""
        code = a << 20 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.by_code[at], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids in each word, ids of all in turn): those of like length advance together, each by its leftmost pair of
        lowest rank."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        n, parts = np.zeros(len(words), np.int64), []
        for i in np.flatnonzero(size > LOCKSTEP[-1]).tolist():
            found = np.array([x for x in self.merge(words[i])[0] if x >= 0])
            n[i] = len(found)
            parts.append((np.array([i]), found[None]))
        for low, width in zip((0, *LOCKSTEP), LOCKSTEP, strict=False):
            alike = np.flatnonzero((size > low) & (size <= width))
            for lo in range(0, len(alike), LOCKSTEP_ROWS):
                own = alike[lo : lo + LOCKSTEP_ROWS]
                found = self._lockstep([words[i] for i in own.tolist()], size[own], width)
                n[own] = (found >= 0).sum(axis=1)
                parts.append((own, found))
        base, out = np.cumsum(n) - n, np.zeros(int(n.sum()), "<u4")
        for own, found in parts:
            has = found >= 0
            out[(base[own][:, None] + np.arange(found.shape[1]))[has]] = found[has]
        return n, out

    def _lockstep(self, words: list[bytes], size: np.ndarray, width: int) -> np.ndarray:
        """Ids [word, place] of words of at most `width` bytes, -1 past the end."""
        data = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        place = np.arange(width)
        ids = np.where(place < size[:, None], self.first_ids[(place == size[:, None] - 1).astype(np.int8), data], -1)
        out, live, rank = np.full(ids.shape, -1), np.arange(len(ids)), self.ranks_of(ids[:, :-1], ids[:, 1:])
        while rank.shape[1]:
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(at)), at]
            if not (go := best < _NONE).all():
                out[live[~go], : ids.shape[1]] = ids[~go]
                ids, rank, live, at, best = ids[go], rank[go], live[go], at[go], best[go]
            if not len(live):
                return out
            row, at, place = np.arange(len(live)), at[:, None], place[:-1]
            ids = np.take_along_axis(ids, place + (place > at), axis=1)  # the pair's second symbol goes
            rank = np.take_along_axis(rank, place[:-1] + (place[:-1] > at), axis=1)
            at = at[:, 0]
            ids[row, at] = self.made_ids[best]
            for side in (at - 1, at):  # the two pairs that the new symbol is in
                has = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                rank[has, side[has]] = self.ranks_of(ids[has, side[has]], ids[has, side[has] + 1])
        out[live, : ids.shape[1]] = ids
        return out


class Cache(dict):
    """text -> answer. Beyond `most` entries the older half goes: what recurs comes back at the price of one computation."""

    def __init__(self, answer, most: int):
        super().__init__()
        self.answer, self.most = answer, most

    def __missing__(self, text: str):
        if len(self) >= self.most:
            for k in list(self)[: self.most // 2]:
                del self[k]
        out = self.answer(text)
        if len(text) <= 64:
            self[text] = out
        return out


def counter(path: str) -> tuple[WordBpe, Cache]:
    """Cached token counts of chunks."""
    bpe = WordBpe(path)
    words = Cache(bpe.count_word, 300_000)
    return bpe, Cache(lambda chunk: sum([words[x] if isinstance(x, str) else 1 for x in bpe.split(chunk)]), 700_000)


def gather(n: np.ndarray, flat: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of the chosen ones of the runs of lengths n that make up `flat`."""
    size = n[which]
    ends = np.cumsum(size)
    return size, flat[np.repeat((np.cumsum(n) - n)[which] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Ids of distinct chunks. Plain words, with punctuation after them, are cut by Arrow; others one by one."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)

    def of(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids in each chunk, ids of all in turn)."""
        cut = pc.extract_regex(chunks, PLAIN)
        plain = pc.is_valid(cut).to_numpy(zero_copy_only=False)
        core, tail = (cut.filter(pa.array(plain)).field(k).dictionary_encode() for k in (0, 1))
        odd = [self.bpe.split(c) for c in chunks.filter(pa.array(~plain)).to_pylist()]
        words = pc.utf8_lower(core.dictionary).to_pylist()
        tails, more = tail.dictionary.to_pylist(), list(dict.fromkeys(x for parts in odd for x in parts if isinstance(x, str)))
        n, flat = self.bpe.encode_words([x.encode() for x in (*words, *tails, *more)])
        special = list(self.bpe.special.values())
        n, flat = np.append(n, np.ones(len(special), np.int64)), np.append(flat, np.array(special, "<u4"))
        place = {x: i for i, x in enumerate(more, len(words) + len(tails))} | {x: i for i, x in enumerate(special, len(n) - len(special))}
        pairs = np.stack([core.indices.to_numpy(), tail.indices.to_numpy() + len(words)], axis=1).ravel()
        in_odd = np.fromiter((place[x] for parts in odd for x in parts), np.int64)
        sizes, ids = gather(n, flat, np.concatenate([pairs, in_odd]))
        of_plain, count = len(pairs) // 2, np.fromiter(map(len, odd), np.int64, len(odd))
        each = np.concatenate([sizes[: 2 * of_plain].reshape(-1, 2).sum(axis=1), np.diff(np.concatenate([[0], np.cumsum(sizes[2 * of_plain :])])[np.concatenate([[0], np.cumsum(count)])])])
        order = np.empty(len(chunks), np.int64)  # plain chunks came first
        order[plain], order[~plain] = np.arange(of_plain), np.arange(of_plain, len(chunks))
        return gather(each, ids, order)


def loaded(path: str, make):
    """make(path): a vocabulary and its cache, kept by a Python worker from one task to the next."""
    return keep((path, make.__name__), lambda: make(path))


def chunk_runs(texts: pa.Array, most: int = RUN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """For runs of rows of about `most` bytes: where each row's chunks begin (one more entry than rows), every chunk's
    number, and the distinct chunks by number. A null text has none; a longer text is a run of its own."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    first = np.flatnonzero(np.concatenate([[True], (ends // most)[1:] != (ends // most)[:-1]])) if len(ends) else ends
    for lo, hi in zip(first, np.append(first[1:], len(ends)), strict=True):
        parts = pc.ascii_split_whitespace(texts.slice(lo, hi - lo))
        bounds = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        yield bounds - bounds[0], coded.indices.to_numpy(), coded.dictionary


def run_counts(texts: pa.Array, cache: Cache) -> np.ndarray:
    """Tokens of each text."""
    out = [np.zeros(0, np.int64)]
    for bounds, codes, chunks in chunk_runs(texts):
        each = np.fromiter(map(cache.__getitem__, chunks.to_pylist()), np.int64, len(chunks))
        out.append(np.diff(np.concatenate([[0], np.cumsum(each[codes])])[bounds]))
    return np.concatenate(out)


def run_ids(texts: pa.Array, encoder: Encoder) -> Iterator[np.ndarray]:
    """Ids of each text in turn, as little-endian unsigned 32-bit integers."""
    for bounds, codes, chunks in chunk_runs(texts, 2 * RUN_BYTES):
        n, flat = encoder.of(chunks)
        row = 0
        while row < len(bounds) - 1:  # the ids of some rows at a time, as they are larger than the texts
            last = max(row + 1, int(np.searchsorted(bounds, bounds[row] + GATHERED, side="right")) - 1)
            size, ids = gather(n, flat, codes[bounds[row] : bounds[last]])
            ends = np.concatenate([[0], np.cumsum(size)])[bounds[row : last + 1] - bounds[row]]
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                yield ids[lo:hi]
            row = last
