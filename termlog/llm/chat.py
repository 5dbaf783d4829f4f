"""Transcript parsing by a hidden Markov model, and canonical turn rendering.

States are roles. A line's observation is its speaker marker, if it has one, and features of its text; Viterbi's
algorithm recovers the likeliest roles, and each run of lines of one role within a turn is rendered as one turn.

A turn whose role is stated has that role in all its lines, whatever its text looks like, and its text stays as it is; so
the model is independent on both sides of it: conversations are split there, exactly, and each stretch carries the role
that follows it. However long a conversation, a task holds one stretch. In other turns a marker is evidence, strong but
not final, and is taken off where it names the role that was recovered.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import grouped

ROLES = ("system", "user", "assistant", "tool")
#: Names that speakers go by, and their roles.
SPEAKERS = {"system": "system", "instruction": "system", "developer": "system", "user": "user", "human": "user", "customer": "user", "question": "user", "q": "user", "prompter": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "agent": "assistant", "answer": "assistant", "a": "assistant", "model": "assistant", "tool": "tool", "function": "tool", "observation": "tool"}
_NAMES = "|".join(sorted(SPEAKERS, key=len, reverse=True))
MARKER = re.compile(rf"^\s*(?:<\|(?:im_start\|>)?({_NAMES})(?:\|>)?|\[({_NAMES})\]:?|(?:#+ |\*\*)?({_NAMES})(?:\*\*)? ?(?::|>)(?:\*\*)?)[ \t]*", re.IGNORECASE)
CHUNK = 256

#: Probabilities of a feature's being present, by role: system, user, assistant, tool.
FEATURES = (
    (re.compile(r"\?\s*$"), (0.02, 0.40, 0.08, 0.01)),
    (re.compile(r"^\s*(?:you are|you must|your task|never|always)\b", re.IGNORECASE), (0.60, 0.04, 0.02, 0.01)),
    (re.compile(r"^\s*(?:what|why|how|when|where|who|can|could|please|i want|i need|help)\b", re.IGNORECASE), (0.04, 0.45, 0.08, 0.01)),
    (re.compile(r"^\s*(?:sure|certainly|of course|here(?:'s| is| are)|sorry|i'm sorry|as an ai)\b", re.IGNORECASE), (0.01, 0.03, 0.40, 0.01)),
    (re.compile(r"^\s*[\[{].*[\]}]\s*$"), (0.02, 0.02, 0.03, 0.70)),
    (re.compile(r"^.{400,}"), (0.08, 0.06, 0.30, 0.15)),
    (re.compile(r"^\s*(?:[-*•]|\d+[.)])\s"), (0.08, 0.04, 0.25, 0.03)),
)
_log = lambda rows: np.log(np.array(rows))
START = _log([0.25, 0.65, 0.08, 0.02])
#: From a role to that of the next line, within a turn and where a new turn begins.
WITHIN = _log([[0.970, 0.015, 0.010, 0.005], [0.005, 0.970, 0.020, 0.005], [0.005, 0.020, 0.970, 0.005], [0.005, 0.005, 0.020, 0.970]])
BETWEEN = _log([[0.02, 0.92, 0.04, 0.02], [0.01, 0.05, 0.90, 0.04], [0.01, 0.88, 0.05, 0.06], [0.01, 0.05, 0.92, 0.02]])
_HARD = -1e6
#: Log likelihoods of a marker that names the line's own role, and of one that names another.
MARKED, MISMARKED = math.log(0.9), math.log(0.1 / 3)


def marker(line: str) -> tuple[str | None, str]:
    """(role, rest of the line) if a speaker marker opens the line, else (None, line)."""
    m = MARKER.match(line)
    return (SPEAKERS[next(g for g in m.groups() if g).lower()], line[m.end() :]) if m else (None, line)


def emission(line: str, said: str | None, marked: str | None = None) -> np.ndarray:
    """Log likelihood of a line by role; `said`: its turn's stated role, `marked`: the role that its marker names."""
    if said is not None:
        return np.array([0.0 if r == said else _HARD for r in ROLES])
    out = np.zeros(len(ROLES))
    for pattern, p in FEATURES:
        hit = pattern.search(line) is not None
        out += [math.log(x if hit else 1 - x) for x in p]
    if marked is not None:
        out += [MARKED if r == marked else MISMARKED for r in ROLES]
    return out


def steps(lines: list[tuple[str, str | None, str | None, bool]]) -> list[np.ndarray]:
    """For each line but the first, log probabilities from the role before to its own: a marker may open a turn too."""
    return [BETWEEN if opens or marked is not None else WITHIN for _, _, marked, opens in lines[1:]]


def viterbi(lines: list[tuple[str, str | None, str | None, bool]], after: str | None) -> list[str]:
    """Roles of (line, stated role or None, marked role or None, opens a turn); `after`: the stated role of the turn that
    follows. Of equally likely paths the one whose roles come first in ROLES, from the end on."""
    score, back = START + emission(*lines[0][:3]), []
    for (line, said, marked, _), step in zip(lines[1:], steps(lines), strict=True):
        reached = score[:, None] + step
        back.append(reached.argmax(axis=0))
        score = reached.max(axis=0) + emission(line, said, marked)
    if after is not None:
        score = score + BETWEEN[:, ROLES.index(after)]
    at = int(score.argmax())
    path = [at]
    for b in reversed(back):
        path.append(at := int(b[at]))
    return [ROLES[i] for i in reversed(path)]


def parse(turns: list[tuple[str | None, str | None]], after: str | None = None) -> list[list[tuple[str, str]]]:
    """For each (stated role, text) its [(role, text)]: the stretch's lines by role, recovered roles' markers taken off."""
    lines, plain, owner = [], [], []
    for i, (said, text) in enumerate(turns):
        for j, line in enumerate((text or "").split("\n")):
            marked, rest = marker(line) if said is None else (None, line)
            lines.append((rest, said, marked, j == 0))
            plain.append(line)
            owner.append(i)
    out: list[list[tuple[str, list[str]]]] = [[] for _ in turns]
    for i, whole, (rest, _, marked, _), role in zip(owner, plain, lines, viterbi(lines, after), strict=True):
        kept = rest if marked == role else whole
        if out[i] and out[i][-1][0] == role:
            out[i][-1][1].append(kept)
        else:
            out[i].append((role, [kept]))
    return [[(role, "\n".join(x)) for role, x in parts] for parts in out]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text.strip()}\n<|end|>\n"


def _stretches(turns: DataFrame) -> DataFrame:
    """Adds stretch (the last turn at or before whose role is stated) and after (the next stated role). Two levels of
    windows, over chunks of turns and over the chunks, so that no task orders a whole conversation."""
    own = Window.partitionBy("conv_id", "chunk").orderBy("turn", "tie")
    place = F.when(F.col("said").isNotNull(), F.struct("turn", "tie"))
    near = turns.withColumn("last_in", F.max(place).over(own.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next_in", F.first("said", ignorenulls=True).over(own.rowsBetween(1, Window.unboundedFollowing)))
    whole = turns.groupBy("conv_id", "chunk").agg(F.max(place).alias("last"), F.min_by("said", place).alias("first"))
    order = Window.partitionBy("conv_id").orderBy("chunk")
    far = whole.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("last_far"), F.first("first", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("next_far"))
    joined = near.join(far, near["conv_id"].eqNullSafe(far["c"]) & (near["chunk"] == far["k"]))
    start = F.coalesce("last_in", "last_far")
    return joined.select(F.xxhash64("conv_id", start["turn"], start["tie"]).alias("stretch"), "conv_id", "turn", "tie", "said", "text", F.coalesce("next_in", "next_far").alias("after"))


def canonical_turns(conversations: DataFrame) -> DataFrame:
    """One row per part of a turn: conv_id, turn, part (from 0), role, n_lines, text, rendered.

    Reads conv_id, turn, role, text. A role by another name (human, bot, ...) counts as its own, and its turn is one part
    with its text unchanged; a null or unknown role is inferred, line by line. A null or empty text is one empty line.
    Turns that repeat a number keep the order of their hashes; null conversations or turns are kept, nulls first; an
    empty table gives no rows; other columns are not read. A very long text's lines are held with its stretch.
    """
    known = F.create_map(*(F.lit(x) for pair in SPEAKERS.items() for x in pair))
    kinds = {c: conversations.schema[c].dataType.simpleString() for c in ("conv_id", "turn")}
    turns = conversations.select("conv_id", "turn", F.element_at(known, F.lower(F.trim("role"))).alias("said"), "text", F.xxhash64("role", "text").alias("tie"))
    turns = turns.withColumn("chunk", F.coalesce(F.floor(F.col("turn").cast("double") / CHUNK), F.lit(-(1 << 62))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in grouped(batches, "stretch"):
            stretch = table["stretch"].to_numpy()
            edge = np.concatenate([[0], np.flatnonzero(stretch[1:] != stretch[:-1]) + 1, [len(stretch)]])
            said, text, after = (table[c].to_pylist() for c in ("said", "text", "after"))
            rows, parts = [], []
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                for i, found in enumerate(parse(list(zip(said[lo:hi], text[lo:hi], strict=True)), after[hi - 1]), int(lo)):
                    for part, (role, body) in enumerate(found):
                        rows.append(i)
                        parts.append((part, role, body.count("\n") + 1, body, render(role, body)))
            at = pa.array(rows, pa.int64())
            cols = list(zip(*parts, strict=True)) or [[]] * 5
            types = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string()]
            taken = [table[c].take(at).combine_chunks() for c in ("conv_id", "turn")]
            yield pa.RecordBatch.from_arrays([*taken, *(pa.array(c, k) for c, k in zip(cols, types, strict=True))], ["conv_id", "turn", "part", "role", "n_lines", "text", "rendered"])

    stretched = _stretches(turns).select("stretch", "conv_id", "turn", "tie", "said", "text", "after")
    return stretched.repartition("stretch").sortWithinPartitions("stretch", "turn", "tie").mapInArrow(run, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, part int, role string, n_lines bigint, text string, rendered string")


def withheld(conv_col: str = "conv_id", turn_col: str = "turn"):
    """The quarter of turns whose stated roles recovery() hides, told by their numbers."""
    return F.coalesce(F.crc32(F.concat_ws(":", F.col(conv_col).cast("string"), F.col(turn_col).cast("string")).cast("binary")) % 4 == 2, F.lit(False))


def recovery(conversations: DataFrame) -> DataFrame:
    """canonical_turns() with a column `stated` (the role as given, by its usual name, or null), and, marked `withheld`, the
    parts of a quarter of the turns as they come out when those turns' roles are hidden: how well the model recovers
    roles that it is not told. Turns that repeat a number take the first stated role of theirs by name."""
    known = F.create_map(*(F.lit(x) for pair in SPEAKERS.items() for x in pair))
    said = conversations.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.element_at(known, F.lower(F.trim("role"))).alias("said"))
    given = said.groupBy("c", "t").agg(F.min("said").alias("stated"))
    hidden = conversations.select("conv_id", "turn", F.when(~withheld(), F.col("role")).alias("role"), "text")
    both = canonical_turns(conversations).withColumn("withheld", F.lit(False)).unionByName(canonical_turns(hidden).where(withheld()).withColumn("withheld", F.lit(True)))
    joined = both.join(given, both["conv_id"].eqNullSafe(given["c"]) & both["turn"].eqNullSafe(given["t"]), "left")
    return joined.select("conv_id", "turn", "part", "role", "n_lines", "text", "rendered", "stated", "withheld")
