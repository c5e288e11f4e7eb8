"""Compression classifier of text quality.

Two zstandard dictionaries are built from good and from bad labelled text. A
text is compressed with both, in independent chunks so that the dictionary
counts everywhere in a long text; (bad size - good size) / (length + 40) is the
feature, and a logistic calibration on labelled rows outside the dictionaries
turns it into a probability that the text is good.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from boutlake.llm.common import bounded_sample, numbered, pinned

CHUNK = 768
SMOOTH = 40.0


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    bias: float
    level: int = 3


def chunks(raw: bytes, size: int = CHUNK) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def _dictionary(data: bytes, level: int) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(data)
    d.precompute_compress(level=level)
    return d


@lru_cache(maxsize=4)
def _compressors(good: bytes, bad: bytes, level: int):
    flags = {"level": level, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return tuple(zstandard.ZstdCompressor(dict_data=_dictionary(d, level), **flags) for d in (good, bad))


def size_difference(text: str | None, good: bytes, bad: bytes, level: int = 3) -> float:
    """The normalised difference of the compressed sizes; 0 for empty or null text."""
    raw = (text or "").encode("utf-8")
    with_good, with_bad = _compressors(good, bad, level)
    diff = sum(len(with_bad.compress(c)) - len(with_good.compress(c)) for c in chunks(raw))
    return diff / (len(raw) + SMOOTH)


def train_dictionary(samples: list[bytes], size: int, level: int) -> bytes:
    """A zstandard dictionary; where there are too few samples to train one, the samples themselves as raw content."""
    samples = [s for s in samples if len(s) >= 16]
    try:
        return zstandard.train_dictionary(size, samples, level=level).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b"\0" * 8


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a logistic fit with a weak pull to 0; slope 0 where only one class is there."""
    if len(x) == 0:
        return 0.0, 0.0
    rate = (y.sum() + 1) / (len(y) + 2)
    if y.min() == y.max():
        return 0.0, float(np.log(rate / (1 - rate)))
    scale = max(float(np.std(x)), 1e-9)
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w, pull = np.array([0.0, np.log(rate / (1 - rate))]), np.array([1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-9), a.T @ (p - y) + pull * w)
        w = w - np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, usable: Column, max_docs: int = 6000, max_chunks: int = 5000, dict_size: int = 112_640, level: int = 3) -> QualityModel:
    """Fit on at most ``max_docs`` labelled documents for which ``usable`` holds.

    The documented bound: the distinct labelled rows (doc_id, text) with the smallest
    hashes; repeated rows count once, rows that only share a doc_id count each. Two
    thirds give at most ``max_chunks`` distinct chunks of 768 bytes per class to the
    dictionaries, so that copies of one passage don't fill them; one third calibrates.
    Labels that are null, and doc_ids that are null or have contradicting labels, are
    left out. Columns but doc_id and text of ``docs`` are not read.
    """
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("quality").alias("_q2")).where("_q = _q2").where(usable).select("doc_id", F.col("_q").cast("int").alias("_q"))
    hashed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text", F.lit(20240501)).alias("_hash"))
    chosen = hashed.select("doc_id", "_hash").join(marks, "doc_id").distinct().orderBy("_hash", "doc_id").limit(max_docs)
    rows = pinned(hashed.join(F.broadcast(chosen), ["doc_id", "_hash"]).dropDuplicates(["doc_id", "_hash"])).withColumn("_part", F.pmod(F.xxhash64("doc_id", "text", F.lit(9)), F.lit(3)))

    def cut(batches):
        for b in batches:
            out = [(q, c) for q, t in zip(b.column("_q").to_pylist(), b.column("text").to_pylist()) for c in chunks((t or "").encode("utf-8"))]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in out], pa.int32()), pa.array([c for _, c in out], pa.binary())], names=["_q", "chunk"])

    pieces = rows.where("_part < 2").select("_q", "text").mapInArrow(cut, "_q int, chunk binary").distinct()
    both = [[bytes(r.chunk) for r in bounded_sample(pieces.where(F.col("_q") == q), max_chunks, F.col("chunk")).collect()] for q in (1, 0)]
    good, bad = (train_dictionary(s, dict_size, level) for s in both)
    model = QualityModel(good, bad, 1.0, 0.0, level)
    seen = np.array([(r.diff, r._q) for r in apply(rows.where("_part = 2"), model, keep=("_q",)).collect()], dtype=float).reshape(-1, 2)
    slope, bias = calibrate(seen[:, 0], seen[:, 1])
    return QualityModel(good, bad, slope, bias, level)


def apply(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("diff", "score")) -> DataFrame:
    """``keep`` columns with size difference and probability of good, under ``names``, of every whole text.

    One row per row, repeated rows and null ids too; a null text counts as empty.
    Columns outside ``keep`` are not read; ``names`` must not be among ``keep``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            diff = np.array([size_difference(t, m.good, m.bad, m.level) for t in b.column(len(keep)).to_pylist()], dtype=float)
            score = 1 / (1 + np.exp(-np.clip(m.slope * diff + m.bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(diff), pa.array(score)], names=[f.name for f in schema])

    plain, fields = numbered(docs, keep, text_col)
    schema = StructType([*fields, StructField("diff", DoubleType()), StructField("score", DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*keep, *names)
