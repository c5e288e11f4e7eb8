"""Approximate nearest neighbours by cross-polytope hashing.

A hash rotates unit vectors by three rounds of random signs and a fast Hadamard
transform and names the nearest signed axis. A table concatenates as many hashes
(the last one over fewer axes) as give its buckets a set number of vectors, so the
number of buckets grows with the data and the share of it that a query meets falls.

Queries probe in two rounds. The first takes the query's own bucket of every table;
the k-th best score found is a lower bound of what a neighbour must reach. The second
takes, of every table, the likeliest buckets of a neighbour at that bound, until each
table would hold it with the probability that the tables' joint recall asks for.
Candidates are scored where their bucket is and ranked exactly, in double precision.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boutlake.llm.common import bounded_sample, hot_keys, join_hot, pinned

BLOCK = 4096


def hadamard(y: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, of a length that is a power of two."""
    n, width, h = *y.shape, 1
    while h < width:
        y = y.reshape(n, -1, 2, h)
        y = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return y


def rotate(x: np.ndarray, number: int, seed: int = 11) -> np.ndarray:
    """Pseudo-rotation ``number`` of the rows; they are padded with zeros to a power of two."""
    width = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), width))
    y[:, : x.shape[1]] = x
    rng = np.random.default_rng((seed, number))
    for _ in range(3):
        y = hadamard(y * rng.choice([-1.0, 1.0], width)) / np.sqrt(width)
    return y


def nearest_axis(y: np.ndarray) -> np.ndarray:
    """The signed axis 2*i (or 2*i+1, its opposite) nearest to each row."""
    i = np.abs(y).argmax(axis=1)
    return 2 * i + (y[np.arange(len(y)), i] < 0)


def axis_odds(y: np.ndarray, cosine: np.ndarray, width: int, steps: int = 12) -> np.ndarray:
    """The probability of every signed axis to be the nearest of a vector at ``cosine`` from each row.

    ``y`` are the rotated rows' coordinates that the hash looks at, of ``width`` in
    all. Beside its part along the row the vector is taken as isotropic noise; the
    axis with the largest coordinate wins, which is integrated over ``steps`` values.
    """

    def below(z):  # normal distribution function, by the usual tanh form
        return 0.5 * (1 + np.tanh(0.7978845608 * (z + 0.044715 * z**3)))

    c = np.clip(cosine, -0.999, 0.999)[:, None]
    sigma = np.sqrt(1 - c * c) / np.sqrt(width)
    mean = c * y
    top = np.abs(mean).max(axis=1, keepdims=True) + 4 * sigma
    z = (np.arange(steps) + 0.5)[None, :] / steps * top  # rows x steps
    odds = np.zeros((len(y), y.shape[1], 2))
    inside = np.empty((len(y), y.shape[1], steps))
    for s in range(steps):
        at = z[:, s : s + 1]
        inside[:, :, s] = np.log(np.maximum(below((at - mean) / sigma) - below((-at - mean) / sigma), 1e-30))
    rest = inside.sum(axis=1, keepdims=True) - inside
    for sign in (0, 1):
        density = np.exp(-0.5 * ((z[:, None, :] - (1 - 2 * sign) * mean[:, :, None]) / sigma[:, :, None]) ** 2 + rest)
        odds[:, :, sign] = density.sum(axis=2)
    odds = odds.reshape(len(y), -1)
    return odds / np.maximum(odds.sum(axis=1, keepdims=True), 1e-300)


def usable(v: str) -> Column:
    """Neither null, nor zero, nor with a null or non-finite component."""
    c = F.col(v)
    finite = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return c.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(c, lambda x: x != 0)


def lengths_of(x: np.ndarray) -> np.ndarray:
    """The rows' norms, by their largest component, so that no square over- or underflows."""
    most = np.abs(x).max(axis=1)
    with np.errstate(over="ignore"):
        return np.minimum(most * np.linalg.norm(x / most[:, None], axis=1), sys.float_info.max)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """The rows at length 1, whatever their size."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of all rows; one that overflows both ways, hence is no number, counts as minus infinity."""
    with np.errstate(over="ignore", invalid="ignore"):
        s = x @ y.T
    return np.where(np.isnan(s), -np.inf, s)


@dataclass(frozen=True)
class Part:
    """Vectors of one length whose norms lie within a factor of two: their number, least and greatest norm.

    Where norms differ, a coordinate sqrt(top^2 - |x|^2) is appended, which makes all
    of one length and keeps the order of inner products with any query.
    """

    dim: int
    count: int
    least: float
    top: float

    @property
    def lifted(self) -> bool:
        return self.least < 0.999 * self.top

    @property
    def width(self) -> int:
        return 1 << max(0, self.dim + self.lifted - 1).bit_length()

    def axes(self, bucket: int) -> list[int]:
        """How many coordinates each of a table's hashes looks at, for about ``bucket`` vectors a bucket."""
        bits = max(0, int(np.log2(max(1, self.count / bucket))))
        full = self.width.bit_length()  # log2 of 2 x width
        return [self.width] * (bits // full) + ([1 << bits % full - 1] if bits % full else [])

    def units(self, x: np.ndarray) -> np.ndarray:
        """The indexed vectors, of length 1."""
        if not self.lifted:
            return unit_rows(x)
        x = x / self.top
        rest = np.sqrt(np.maximum(1 - (x * x).sum(axis=1, keepdims=True), 0))
        return np.concatenate([x, rest], axis=1)

    def asked(self, x: np.ndarray) -> np.ndarray:
        """The queries, of length 1, with nothing in the appended coordinate."""
        x = unit_rows(x)
        return np.concatenate([x, np.zeros((len(x), 1))], axis=1) if self.lifted else x


def bucket_of(unit: np.ndarray, table: int, axes: list[int]) -> np.ndarray:
    """The bucket of each row in a table: its hashes as one number."""
    code = np.zeros(len(unit), np.int64)
    for h, n in enumerate(axes):
        code = code * 2 * n + nearest_axis(rotate(unit, table * 64 + h)[:, :n])
    return code


def likely_buckets(unit: np.ndarray, cosine: np.ndarray, table: int, axes: list[int], share: float) -> list[np.ndarray]:
    """For each row the fewest buckets of a table that hold a vector at its cosine with probability ``share``, likeliest first."""
    if not axes:
        return [np.zeros(1, np.int64)] * len(unit)
    odds = []
    for h, n in enumerate(axes):
        y = rotate(unit, table * 64 + h)
        odds.append(axis_odds(y[:, :n], cosine, y.shape[1]))
    out: list[np.ndarray] = []
    some = max(1, (1 << 21) // int(np.prod([2.0 * n for n in axes])))
    for lo in range(0, len(unit), some):
        p = odds[0][lo : lo + some]
        code = np.broadcast_to(np.arange(p.shape[1]), p.shape)
        for o, n in zip(odds[1:], axes[1:]):
            order = np.argsort(-p, axis=1)
            mass = np.take_along_axis(p, order, 1)
            most = int((np.cumsum(mass, axis=1) < 0.98 * mass.sum(axis=1, keepdims=True)).sum(axis=1).max()) + 1  # the unlikeliest fiftieth is among what isn't probed
            code = (np.take_along_axis(code, order[:, :most], 1)[:, :, None] * 2 * n + np.arange(2 * n)).reshape(len(p), -1)
            p = (mass[:, :most, None] * o[lo : lo + some, None, :]).reshape(len(p), -1)
        order = np.argsort(-p, axis=1)
        counts = (np.cumsum(np.take_along_axis(p, order, 1), axis=1) < share).sum(axis=1) + 1
        code = np.take_along_axis(code, order, 1)
        out += [code[i, :n] for i, n in enumerate(counts.tolist())]
    return out


def _rows(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _by_length(batch: pa.RecordBatch):
    """(rows, matrix) of the vectors of each length in a batch whose columns are an id, a vector and others."""
    lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths).tolist():
        at = pa.array(np.flatnonzero(lengths == dim))
        part = batch.take(at)
        yield dim, part, _rows(part.column(1), dim)


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, tables: int = 8, recall: float = 0.88, bucket: int = 64, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, sample: int = 2048, compared=None
) -> DataFrame:
    """(query_id, rank, id, score) of the ``k`` nearest found for every query row by inner product.

    Every row that takes part is indexed. Equal vectors are folded to one class
    first, of which only the k+1 smallest ids can ever be among the k nearest, so
    a vector that many rows share costs no more than another. Vectors of one length
    are parted by norm, a factor of two each, and every part has its ``tables``.
    Their buckets hold about ``bucket`` vectors at any size of the input. ``recall``
    is what the probes aim at for a neighbour right at the bound of round one; that
    bound is at least the k-th best score in ``sample`` vectors (bounded, sent to the
    executors), and parts that can't reach it aren't probed. Buckets of more than
    ``block`` classes are cut into blocks, each met by all queries of the bucket in a
    stream. Vectors are compared with those of the same length only. Ids are taken as
    distinct; rows with a null id take no part; other columns are not read. An empty
    table, or one without usable vectors, gives no row. Products are doubles: one
    that overflows is infinite, and one that is no number counts as minus infinity. ``compared``, an accumulator,
    counts the pairs scored.
    """
    spark = vectors.sparkSession
    element = vectors.schema[vec_col].dataType.elementType.simpleString()
    element = element if element == "float" else "double"
    plain = F.transform(F.col(vec_col), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast(element))  # one zero only
    v = vectors.where(F.col(id_col).isNotNull() & usable(vec_col)).select(F.col(id_col).alias("id"), plain.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    counted = pinned(v.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.count_if("q").alias("asked")))
    classes, total = counted.select("rep", "v"), v.count()
    hot_vectors, hot_reps = hot_keys(counted, "v", total), hot_keys(counted, "rep", total)
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    norm = F.least(most * F.sqrt(F.aggregate(F.transform("v", lambda x: F.pow(x.cast("double") / most, F.lit(2))), F.lit(0.0), lambda s, x: s + x)), F.lit(sys.float_info.max))
    band = F.floor(F.log2(norm)).cast("int")  # squares are of shares of the largest component, as those of components may over- or underflow
    found = classes.groupBy(F.size("v").alias("dim"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.min(norm).alias("lo"), F.max(norm).alias("hi")).collect()  # a row per length and factor of two
    parts = [Part(r.dim, r.n, r.lo, r.hi) for r in sorted(found, key=lambda r: (r.dim, -r.hi))]
    own_parts = {dim: [g for g, p in enumerate(parts) if p.dim == dim] for dim in {p.dim for p in parts}}
    known = [r.v for r in bounded_sample(classes, sample, F.col("rep")).select("v").collect()]
    pilots = {dim: np.array([x for x in known if len(x) == dim], dtype=np.float64).reshape(-1, dim) for dim in own_parts}
    shared = spark.sparkContext.broadcast((parts, own_parts, pilots))
    each = 1 - (1 - recall) ** (1 / tables)
    id_type = v.schema["id"].dataType.simpleString()
    key = ["g", "t", "bucket"]
    schema = f"rep {id_type}, v array<{element}>, bound double, g int, t int, bucket long"

    def rows(part, at, g, t, codes, bound=None):
        at = pa.array(at)
        n = len(at)
        return pa.RecordBatch.from_arrays(
            [part.column(0).take(at), part.column(1).take(at), pa.array(np.full(n, -np.inf) if bound is None else bound), pa.array(np.full(n, g, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(codes, pa.int64())],
            names=["rep", "v", "bound", *key],
        )

    def place(batches):
        parts, own_parts, _ = shared.value
        for b in batches:
            for dim, part, x in _by_length(b):
                tops = np.array([parts[g].top for g in own_parts[dim]])
                mine = np.array([len(tops) - 1 - np.searchsorted(tops[::-1], r * (1 - 1e-12)) for r in lengths_of(x)])  # the part with the least top that isn't below
                for i, g in enumerate(own_parts[dim]):
                    at = np.flatnonzero(mine == i)
                    if len(at):
                        unit, axes = parts[g].units(x[at]), parts[g].axes(bucket)
                        for t in range(tables):
                            yield rows(part, at, g, t, bucket_of(unit, t, axes))

    def probe_own(batches):
        parts, own_parts, _ = shared.value
        for b in batches:
            for dim, part, x in _by_length(b):
                for g in own_parts[dim]:
                    unit, axes = parts[g].asked(x), parts[g].axes(bucket)
                    for t in range(tables):
                        yield rows(part, np.arange(len(x)), g, t, bucket_of(unit, t, axes))

    def probe_likely(batches):
        parts, own_parts, pilots = shared.value
        for b in batches:
            for dim, part, x in _by_length(b):
                bound = part.column(2).to_numpy(zero_copy_only=False)
                if len(pilots[dim]) > k:
                    s = products(x, pilots[dim])
                    bound = np.fmax(bound, -np.partition(-s, k, axis=1)[:, k])
                bound = np.where(np.isnan(bound), -np.inf, bound)
                length = lengths_of(x)
                for g in own_parts[dim]:
                    with np.errstate(over="ignore", invalid="ignore"):
                        cosine = bound / length / parts[g].top
                    cosine = np.where(np.isnan(cosine), -np.inf, cosine)
                    near = np.flatnonzero(cosine <= 1 + 1e-9)  # no vector of the part reaches more
                    if not len(near):
                        continue
                    unit, axes = parts[g].asked(x[near]), parts[g].axes(bucket)
                    for t in range(tables):
                        done = bucket_of(unit, t, axes)
                        lists = likely_buckets(unit, np.where(np.isfinite(cosine[near]), cosine[near], -1.0), t, axes, each)
                        lists = [c[c != d] for c, d in zip(lists, done)]
                        at = np.repeat(near, [len(c) for c in lists])
                        for lo in range(0, len(at), 8192):
                            yield rows(part, at[lo : lo + 8192], g, t, np.concatenate(lists)[lo : lo + 8192], bound[at[lo : lo + 8192]])

    placed = classes.mapInArrow(place, schema)
    hot = pinned(placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select(*key, F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    n_hot = hot.count()
    hot = F.broadcast(hot) if n_hot <= 100_000 else hot
    blocks = F.coalesce("blocks", F.lit(1))

    def with_blocks(df: DataFrame) -> DataFrame:
        return df.join(hot, key, "left") if n_hot else df.withColumn("blocks", F.lit(1))

    data_side = with_blocks(placed).withColumn("b", F.pmod(F.xxhash64("rep", F.lit(3)), blocks).cast("int"))

    def score(batches):
        at_key, held, reps, x = None, [], [], None
        pairs = 0
        for batch in batches:
            side, vs, ids, bound = (batch.column(c) for c in ("side", "v", "rep", "bound"))
            side, bound = side.to_numpy(zero_copy_only=False), bound.to_numpy(zero_copy_only=False)
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*key, "b")] + [side.astype(np.int64)], axis=1)
            starts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
            out = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                run = vs.slice(lo, hi - lo)
                m = _rows(run, len(run[0]))
                names = ids.slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                here = tuple(keys[lo, :4])
                if here != at_key:
                    at_key, held, reps, x = here, [], [], None
                if side[lo] == 0:
                    held.append(m)
                    reps.append(names)
                    continue
                if not held:
                    continue
                if x is None:
                    x, reps = np.concatenate(held), [np.concatenate(reps)]
                for a in range(0, len(m), 512):
                    s = products(m[a : a + 512], x)
                    pairs += s.size
                    bar = bound[lo + a : lo + a + len(s)]
                    if s.shape[1] > k + 1:
                        bar = np.fmax(bar, -np.partition(-s, k, axis=1)[:, k])
                    i, j = np.nonzero(s >= (bar - 1e-9 * np.abs(np.where(np.isfinite(bar), bar, 0)))[:, None])
                    out.append((names[a + i], reps[0][j], s[i, j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(3)], names=["q", "rep", "score"]).cast(pa.schema([("q", ids.type), ("rep", ids.type), ("score", pa.float64())]))
        if compared is not None:
            compared.add(pairs)

    def meet(asked: DataFrame) -> DataFrame:
        """The best classes of every probed bucket: each block and then its queries come to a task in order of their keys."""
        query_side = with_blocks(asked).withColumn("b", F.explode(F.sequence(F.lit(0), blocks - 1)))
        cols = [*key, "b", "rep", "v", "bound"]
        both = data_side.select(*cols, F.lit(0).alias("side")).unionByName(query_side.select(*cols, F.lit(1).alias("side")))
        met = both.repartition(*key, "b").sortWithinPartitions(*key, "b", "side").mapInArrow(score, f"q {id_type}, rep {id_type}, score double")
        return met

    queries = counted.where("asked > 0").select("rep", "v")
    none = F.lit(float("-inf"))
    def folded(pairs: DataFrame) -> DataFrame:  # a pair may come from several tables
        return pairs.groupBy("q", "rep").agg(F.max("score").alias("score"))

    first = pinned(folded(meet(queries.select("rep", "v", none.alias("bound")).mapInArrow(probe_own, schema))))
    order = Window.partitionBy("q").orderBy(F.desc("score"))
    bounds = first.where("q != rep").withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select(F.col("q").alias("rep"), F.col("score").alias("bound"))
    second = meet(queries.join(bounds, "rep", "left").select("rep", "v", F.coalesce("bound", none).alias("bound")).mapInArrow(probe_likely, schema))
    near = folded(first.unionByName(second)).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= 2 * k + 2).drop("score")
    product = F.aggregate(F.zip_with("qv", "cv", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    product = F.when(F.isnan(product), F.lit(float("-inf"))).otherwise(product)
    exact = near.join(classes.withColumnRenamed("v", "cv"), "rep").join(classes.select(F.col("rep").alias("q"), F.col("v").alias("qv")), "q").select("q", "rep", product.alias("score"))
    best = exact.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "rep"))).where(F.col("r") <= k + 1)
    alike = v.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1).select("id", "v")
    ids = alike.join(classes, "v").select("rep", "id")
    # what a class finds is what each of its queries finds, less the query itself
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    of_class = best.select("q", "rep", "score").join(ids, "rep").withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1).select(F.col("q").alias("rep"), "id", "score")
    asked = join_hot(v.where("q").select(F.col("id").alias("query_id"), "v"), classes, hot_vectors, "v").select("query_id", "rep")
    per_query = join_hot(asked, pinned(of_class), hot_reps, "rep").where("id != query_id")
    place_of = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return per_query.withColumn("rank", F.row_number().over(place_of).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
