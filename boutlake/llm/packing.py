"""Variable-capacity best-fit packing of sequences into permitted lengths.

Best-fit decreasing treats items of one length alike, so the plan is made from the
histogram of lengths, which has at most as many entries as the longest permitted
length has tokens, however many items there are. Bins with equal contents are
kept as one run. Items find their bins by their rank within their length, in a
join with the runs' rank ranges.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlake.llm.common import lanes, pinned, quoted

#: Permitted sequence lengths of production, in words, and the fixed cost of opening a sequence.
CAPACITIES = (512, 1024, 2048, 4096)
OVERHEAD = 16.0


def bin_cost(capacity: int, overhead: float = OVERHEAD, quadratic: float = 1 / 16384) -> float:
    """What a sequence of a permitted length costs to train on: linear work, attention and a fixed part."""
    return overhead + capacity * (1 + capacity * quadratic)


@dataclass
class Run:
    """``bins`` bins alike, each of ``capacity`` with ``left`` tokens free. Part (length, each, rank): bin b holds the ``each`` items of that length from rank + b * each on."""

    capacity: int
    left: int
    bins: int
    parts: list[tuple[int, int, int]] = field(default_factory=list)

    def cut(self, lo: int, hi: int) -> Run:
        return Run(self.capacity, self.left, hi - lo, [(length, each, rank + lo * each) for length, each, rank in self.parts])

    def add(self, length: int, each: int, rank: int) -> Run:
        self.parts.append((length, each, rank))
        self.left -= length * each
        return self


def likely_contents(capacity: int, length: int, spare: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """What best fit would put into a new bin: this length first, then the longest that fit and are still spare."""
    left, take, at = capacity, {}, bisect_right(lengths, length)
    while at:
        at = bisect_right(lengths, left, 0, at)
        if at == 0:
            break
        size = lengths[at - 1]
        n = min(left // size, spare[size])
        if n:
            take[size] = n
            left -= n * size
        at -= 1
    return take


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD) -> list[Run]:
    """Runs of bins that hold ``histogram`` (length -> items); lengths must be 1 to the largest capacity.

    Lengths are placed in descending order, each into the open bins with the least
    room that still fits. What is left over opens bins of the capacity whose cost
    per token, over what is likely to come into it, is least. At last each bin is
    cut to the smallest capacity that holds its contents.
    """
    caps = sorted(capacities)
    if histogram and (min(histogram) < 1 or max(histogram) > caps[-1]):
        raise ValueError("lengths must be at least 1 and at most the largest capacity")
    spare, lengths = dict(histogram), sorted(histogram)
    open_runs: dict[int, list[Run]] = defaultdict(list)
    rooms: list[int] = []
    done: list[Run] = []

    def keep(run: Run) -> None:
        if run.bins == 0:
            return
        if run.left < lengths[0]:
            done.append(run)
            return
        if not open_runs[run.left]:
            insort(rooms, run.left)
        open_runs[run.left].append(run)

    def tightest(length: int) -> Run | None:
        at = bisect_right(rooms, length - 1)
        if at == len(rooms):
            return None
        run = open_runs[rooms[at]].pop()
        if not open_runs[run.left]:
            del rooms[at]
        return run

    def opened(length: int, todo: int) -> Run:
        contents = {c: likely_contents(c, length, spare, lengths) for c in caps if c >= length}
        best = min(contents, key=lambda c: (bin_cost(c, overhead) / sum(size * n for size, n in contents[c].items()), c))
        bins = max(1, min(spare[size] // n for size, n in contents[best].items()))
        for size, n in contents[best].items():
            spare[size] -= n * bins
        return Run(best, best, min(bins, -(-todo // (best // length))))

    for length in reversed(lengths):
        todo, rank = histogram[length], 0
        while todo:
            spare[length] = max(spare[length], todo)
            run = tightest(length) or opened(length, todo)
            each = run.left // length
            full = min(run.bins, todo // each)
            rest = min(todo - full * each, each - 1) if full < run.bins else 0
            keep(run.cut(full + (rest > 0), run.bins))
            if rest:
                keep(run.cut(full, full + 1).add(length, rest, rank + full * each))
            if full:
                keep(run.cut(0, full).add(length, each, rank))
            rank += full * each + rest
            todo -= full * each + rest
    done += [r for runs in open_runs.values() for r in runs]
    for run in done:
        used = run.capacity - run.left
        run.capacity = next(c for c in caps if c >= used)
        run.left = run.capacity - used
    return [r for r in done if r.parts]


WORD_GAP = "[\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), f"^{WORD_GAP}|{WORD_GAP}$", "")
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, WORD_GAP))).cast("int")


def pack(docs: DataFrame, length: Column, capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, rank_parts: int | None = None, id_col: str = "doc_id") -> DataFrame:
    """(id, piece, start, length, bin_id, bin_offset, capacity) of every piece of every row.

    A row longer than the largest capacity is cut into pieces of that length and a
    rest. A row of length 0 (empty or null text, or a null length) is returned with null bin. Equal
    ids and null ids are packed like others; other columns are not read. Ranks within
    a length are counted in ``rank_parts`` parts (None: as the cluster has lanes) whose
    totals give offsets. Rows are dealt to the parts by their place in the input, so
    neither a length nor an id that many rows share is ever sorted in one task. The
    deal is written to the checkpoint folder once, so a lost executor doesn't change
    it. The plan sees only the histogram (at most max(capacities) rows) and is
    broadcast: its size depends on the number of distinct lengths alone.
    """
    spark, top = docs.sparkSession, max(capacities)
    pieces = (
        docs.select(F.col(quoted(id_col)).alias("id"), F.coalesce(length.cast("int"), F.lit(0)).alias("n"))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / top).cast("int") - 1, F.lit(0)))))
        .select("id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("n") - F.col("piece") * top).alias("length"))
    )
    pieces = pinned(pieces.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(rank_parts or lanes(spark))).cast("int")))
    sizes = pieces.where("length > 0").groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, first_bin = [], 0
    for run in plan(histogram, capacities, overhead):
        offset = 0
        for size, each, rank in run.parts:
            rows.append((size, rank, rank + run.bins * each, each, first_bin, offset, run.capacity))
            offset += size * each
        first_bin += run.bins
    parts = spark.createDataFrame(rows, "length int, lo long, hi long, each int, first_bin long, first_offset int, capacity int")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    ranked = pieces.withColumn("r", F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece")) - 1).join(offsets, ["length", "part"], "left")  # by the window's own partitioning
    ranked = ranked.withColumn("rank", F.col("skip") + F.col("r"))
    p, q = ranked.alias("p"), F.broadcast(parts).alias("q")
    joined = p.join(q, (F.col("p.length") == F.col("q.length")) & (F.col("p.rank") >= F.col("q.lo")) & (F.col("p.rank") < F.col("q.hi")), "left")
    within = F.col("p.rank") - F.col("q.lo")
    return joined.select(
        F.col("p.id").alias(id_col),
        F.col("p.piece").alias("piece"),
        F.col("p.start").alias("start"),
        F.col("p.length").alias("length"),
        (F.col("q.first_bin") + F.expr("(p.rank - q.lo) div q.each")).alias("bin_id"),
        (F.col("q.first_offset") + (within % F.col("q.each")) * F.col("p.length")).cast("int").alias("bin_offset"),
        F.col("q.capacity").alias("capacity"),
    )
