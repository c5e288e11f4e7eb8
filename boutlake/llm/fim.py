"""Fill-in-middle by an indexable skip list over a text's units.

The list's ground lane holds the text in runs of units; each lane above links a
random quarter of the nodes below. Every link carries its widths: how many units,
code points and bytes it passes. A cut after a given number of units is found by
descending from the sparsest lane, following links while the widths added up stay
within that number, so a cut costs a logarithmic number of links and gives its
place in code points and in bytes exactly. The text is then put together anew from
its bytes, which are never decoded.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutlake.llm.common import quoted

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
RUN = 64
BLOCK = 1 << 20
UNITS, POINTS, BYTES = range(3)


@lru_cache(maxsize=4096)
def _shape(nodes: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The lanes over ``nodes`` nodes, sparsest first: each lane's nodes, and where each of them is in the lane below.

    A node's height is the number of trailing zero pairs of a hash of its place, so a quarter of a lane's nodes reach
    the next. The first node is the head and reaches all lanes.
    """
    h = np.arange(nodes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    lanes, own, down = [], np.arange(nodes), np.arange(nodes)
    k = 0
    while True:
        lanes.append((own, down))
        up = np.flatnonzero((h[own] >> np.uint64(2 * k) & np.uint64(3)) == 0)
        up = np.union1d(up, [0])
        if len(up) == len(own) or len(own) <= 4:
            return lanes[::-1]
        own, down, k = own[up], up, k + 1


class SkipList:
    """An indexable skip list over the units of a UTF-8 text.

    ``widths`` has a row (units, code points, bytes) for each node of the ground lane. A node of more than one unit holds
    single code points, which the last step counts off.
    """

    def __init__(self, raw: bytes, widths: np.ndarray):
        self.raw = raw
        ends = np.zeros((len(widths) + 1, 3), np.int64)
        np.cumsum(widths, axis=0, out=ends[1:])
        self.units, self.points = int(ends[-1, UNITS]), int(ends[-1, POINTS])
        self.lanes = [(np.diff(ends[np.append(own, len(widths))], axis=0).tolist(), down) for own, down in _shape(len(widths))] if len(widths) else []
        self.steps = 0

    @classmethod
    def of_points(cls, raw: bytes, run: int = RUN) -> SkipList:
        """Units are code points: a node holds ``run`` of them."""
        data = np.frombuffer(raw, np.uint8)
        points, at = 0, []
        for lo in range(0, len(data), BLOCK):
            starts = np.flatnonzero((data[lo : lo + BLOCK] & 0xC0) != 0x80)
            at.append(starts[-points % run :: run] + lo)
            points += len(starts)
        at = np.concatenate([*at, [len(data)]]) if at else np.zeros(1, np.int64)
        widths = np.full((len(at) - 1, 3), run, np.int64)
        widths[:, BYTES] = np.diff(at)
        if len(widths):
            widths[-1, [UNITS, POINTS]] = points - run * (len(widths) - 1)
        return cls(raw, widths)

    @classmethod
    def of_pattern(cls, raw: bytes, pattern: str) -> SkipList:
        """Units are the pattern's non-empty matches from left to right, and single code points between them."""
        text = raw.decode("utf-8")
        points, at = [], 0
        for m in regex.finditer(pattern, text):
            if m.end() > m.start():
                points += [1] * (m.start() - at) + [m.end() - m.start()]
                at = m.end()
        points = np.array(points + [1] * (len(text) - at), np.int64)
        starts = np.append(np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw))
        ends = starts[np.concatenate([[0], np.cumsum(points)]).astype(np.int64)]
        return cls(raw, np.stack([np.ones(len(points), np.int64), points, np.diff(ends)], axis=1))

    def descend(self, rank: int) -> tuple[int, int]:
        """(code points, bytes) before the cut behind ``rank`` units."""
        units = points = size = at = 0
        for links, down in self.lanes:
            while at < len(links) and units + links[at][UNITS] <= rank:
                step = links[at]
                units, points, size = units + step[UNITS], points + step[POINTS], size + step[BYTES]
                at += 1
                self.steps += 1
            if at == len(links):
                return points, size
            at = int(down[at])
        rest = rank - units
        if rest:  # within a run of code points
            run = np.frombuffer(self.raw, np.uint8, min(4 * (rest + 1), len(self.raw) - size), size)
            size += int(np.flatnonzero((run & 0xC0) != 0x80)[rest])
        return points + rest, size


def draws(doc_id: int | None, seed: int = 1) -> tuple[int, int, int, int]:
    """Four 32-bit numbers from a document's id alone; a null id counts as an empty one."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()[:16])


@dataclass(frozen=True)
class Rule:
    """How often a text is transformed and how often suffix first, in percent; ``unit`` is a pattern of the units, none: code points."""

    rate: int = 90
    spm_rate: int = 20
    unit: str | None = None
    seed: int = 1

    def transform(self, doc_id: int | None, raw: bytes) -> tuple[bytes, int, str, int | None, int | None]:
        """(output, units, form, code points of the prefix, of the middle)."""
        h1, h2, h3, h4 = draws(doc_id, self.seed)
        parts = SkipList.of_points(raw) if self.unit is None else SkipList.of_pattern(raw, self.unit)
        n = parts.units
        if not raw or h3 % 100 >= self.rate or any(s in raw for s in (PREFIX, SUFFIX, MIDDLE)):
            return raw, n, "plain", None, None
        (p1, b1), (p2, b2) = (parts.descend(r) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = raw[:b1], raw[b1:b2], raw[b2:]
        if h4 % 100 < self.spm_rate:
            return b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)), n, "spm", p1, p2 - p1
        return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)), n, "psm", p1, p2 - p1


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), id_col: str = "doc_id", text_col: str = "text", most_bytes: int = 1 << 24) -> DataFrame:
    """id, n (units), form, prefix_chars, middle_chars and output of every whole text.

    One row per row, repeated rows (whose ids make the same cuts) and null ids (which
    count as the empty id) too. A null text counts as empty; an empty text, or one that
    holds a sentinel, stays plain. Only the two named columns are read, and nothing is
    shuffled. Arrow batches leave at about ``most_bytes``. An empty table gives no row.
    """
    names = ["k", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = [None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).cast(pa.binary())
            rows, size, at = [], 0, 0

            def batch(rows, at):
                out, n, form, p, m = zip(*rows)
                return pa.RecordBatch.from_arrays([ids.slice(at, len(rows)), *[pa.array(x, t) for x, t in zip((n, form, p, m, out), types[1:])]], names=names)  # noqa: B023

            for i in range(len(texts)):
                rows.append(rule.transform(ids[i].as_py(), texts[i].as_py() or b""))
                size += len(rows[-1][0])
                if size >= most_bytes:
                    yield batch(rows, at)
                    rows, size, at = [], 0, i + 1
            if rows:
                yield batch(rows, at)

    id_type = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(quoted(id_col)).alias("k"), F.col(quoted(text_col)).alias("x"))
    return plain.mapInArrow(run, f"k {id_type}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("k", id_col)


def restored(form: Column, output: Column) -> Column:
    """The text that ``fill_in_middle`` made an output of. No text that it transforms holds a sentinel, so these are the only ones."""
    at = lambda part: F.locate(part.decode(), output)
    first, second = F.when(form == "psm", at(SUFFIX)).otherwise(at(PREFIX)), at(MIDDLE)
    one = F.substring(output, F.lit(4), first - 4)  # what stands between the first two sentinels
    two = F.substring(output, first + 3, second - first - 3)
    middle = F.substring(output, second + 3, F.length(output))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
