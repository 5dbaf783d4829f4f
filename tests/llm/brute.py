"""Plain Python versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile("[^\x20\x09-\x0d]+")


def ascii_lower(t: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingle_set(text: str | None) -> set:
    w = WORD.findall(ascii_lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(docs: dict[int, str | None], percent: int = 75) -> dict[int, tuple[int, int]]:
    sets = {k: shingle_set(t) for k, t in docs.items()}
    root = {k: k for k in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in docs:
        for b in docs:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in docs}


def quality_counts(text: str | None) -> tuple[int, int, int, int, int]:
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def repeats_removed(texts: list[str | None], width: int) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + width] for t in data for i in range(len(t) - width + 1))
    out = []
    for t in data:
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if count[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def license_base(text: str | None) -> tuple:
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", ascii_lower(text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def held_items(text: str | None, items: dict[int, str], min_run: int = 12, min_share: int = 75) -> set[int]:
    """Items held by a text: every item laid at every place, words compared one by one."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    words, out = split(text), set()
    for key, item in items.items():
        own = split(item)
        for start in range(-len(own) + 1, len(words)):
            agree = [0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(own)]
            best = now = 0
            for a in agree:
                now = max(0, now + (1 if a else -2))
                best = max(best, now)
            if 100 * sum(agree) >= min_share * len(own) or best >= min(min_run, len(own)):
                out.add(key)
    return out


def fewest_bins(sizes: list[int], capacity: int) -> int:
    """The least number of bins, by trying each piece in each open bin."""
    sizes, best = sorted(sizes, reverse=True), [len(sizes)]

    def place(i: int, bins: list[int]) -> None:
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] >= sizes[i] and bins[k] not in bins[:k]:
                bins[k] -= sizes[i]
                place(i + 1, bins)
                bins[k] += sizes[i]
        place(i + 1, [*bins, capacity - sizes[i]])

    place(0, [])
    return best[0]
