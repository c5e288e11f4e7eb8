"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character 1- to 3-grams of the lower-cased
text, of unit length. Each shard of a bounded training sample is fitted by
follow-the-regularised-leader with elastic-net penalties (the bias too, as a
feature that is always 1 and has no penalty), the shards' weights are averaged, and
one temperature, fitted on rows outside the training part, calibrates the
probabilities. Every language of the sample is learned: the more there are, the
fewer buckets the n-grams are hashed to, so the state of a shard stays bounded.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from boutlake.llm.common import numbered, pinned, sampled_rows

BITS = 16
#: Weights that a shard holds at most; beyond BITS buckets for 256 languages, buckets halve as languages double.
CELLS = 1 << 24
UND = "und"
LETTER = regex.compile(r"\p{L}")
_MIX = np.uint32(2654435761)


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    idf: np.ndarray  # (buckets,)
    place: np.ndarray  # (buckets,): the bucket's row of weights, 0 where all its weights are 0
    weights: np.ndarray  # (1 + buckets with weights, langs), the first row 0
    bias: np.ndarray
    temperature: float

    @property
    def bits(self) -> int:
        return len(self.idf).bit_length() - 1

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The score of every language, before the temperature."""
        rows = self.place[at]
        some = rows > 0
        return tfidf(at, counts, self.idf)[some] @ self.weights[rows[some]] + self.bias


def bits_for(langs: int) -> int:
    """Bits of the n-grams' buckets for a number of languages."""
    return max(8, min(BITS, (CELLS // max(1, langs)).bit_length() - 1))


def ngram_counts(text: str, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed buckets (2 to the ``bits``) of the character 1-, 2- and 3-grams of a whole text and how often each comes."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    grams, h = [], a * _MIX
    grams.append(h >> np.uint32(32 - bits))
    for n in (1, 2):
        if len(a) > n:
            h = ((h[:-1] ^ (h[:-1] >> np.uint32(13))) * np.uint32(31) + a[n:]) * _MIX
            grams.append(h >> np.uint32(32 - bits))
    counts = np.bincount(np.concatenate(grams), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


def tfidf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / np.sqrt(x @ x)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """FTRL-proximal weights over rows of (buckets, values, class): the buckets seen, their weights (buckets, langs) and the bias."""
    seen = np.unique(np.concatenate([np.zeros(0, np.int64), *(at for at, _, _ in rows)]))
    places = [np.searchsorted(seen, at) for at, _, _ in rows]
    z, n = np.zeros((len(seen), n_langs)), np.zeros((len(seen), n_langs))
    bias_z, bias_n = np.zeros(n_langs), np.zeros(n_langs)

    def weights(z, n, l1=l1, l2=l2):
        return np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)

    for _ in range(epochs):
        for at, (_, x, y) in zip(places, rows):
            zs, ns = z[at], n[at]
            w, bias = weights(zs, ns), weights(bias_z, bias_n, 0.0, 0.0)
            s = x @ w + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            grown = ns + g * g
            z[at] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / alpha * w
            n[at] = grown
            grown = bias_n + p * p
            bias_z += p - (np.sqrt(grown) - np.sqrt(bias_n)) / alpha * bias
            bias_n = grown
    return seen, weights(z, n), weights(bias_z, bias_n, 0.0, 0.0)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search on its logarithm."""
    if len(y) == 0 or logits.shape[1] < 2:
        return 1.0

    def loss(t):
        s = logits / np.exp(t)
        m = s.max(axis=1, keepdims=True)
        return float(np.mean(m[:, 0] + np.log(np.exp(s - m).sum(axis=1)) - s[np.arange(len(y)), y]))

    lo, hi, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _features(rows: DataFrame, bits: int) -> DataFrame:
    def run(batches):
        for b in batches:
            found = [ngram_counts(t, bits) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("_lang"), b.column("_shard"), pa.array([a.astype(np.int32) for a, _ in found], pa.list_(pa.int32())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))],
                names=["_lang", "_shard", "at", "n"],
            )

    return rows.select("_lang", "_shard", "text").mapInArrow(run, "_lang int, _shard int, at array<int>, n array<int>")


def fit(docs: DataFrame, usable: Column, max_docs: int = 6000, shards: int = 4, epochs: int = 3, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> LanguageModel:
    """Fit on at most ``max_docs`` rows with text and non-null lang for which ``usable`` holds.

    The documented bound: the distinct rows (doc_id, lang, text) with the smallest
    hashes; repeated rows count once, rows that only share a doc_id (or have none)
    count each. One fifth of them fits the temperature, the rest is trained in
    ``shards`` groups. Every language of the sample is learned. With
    no usable row the model knows no language and answers ``und`` to every text.
    Columns but doc_id, lang and text are not read, beside those in ``usable``.
    """
    good = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", "text")
    sample = pinned(sampled_rows(good, max_docs))
    langs = tuple(sorted(r.lang for r in sample.select("lang").distinct().collect()))  # at most max_docs of them
    bits = bits_for(len(langs))
    dims = 1 << bits
    if not langs:
        return LanguageModel((), np.zeros(dims), np.zeros(dims, np.int32), np.zeros((1, 0)), np.zeros(0), 1.0)
    code = F.array_position(F.lit(list(langs)), F.col("lang")).cast("int") - 1
    part = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(5 * shards)).cast("int")
    rows = _features(sample.withColumn("_lang", code).withColumn("_shard", F.when(part < shards, -1).otherwise(part % shards).cast("int")), bits).persist()
    try:
        df = rows.where("_shard >= 0").select(F.explode("at").alias("at")).groupBy("at").count().toArrow()  # at most a row per bucket
        total = rows.where("_shard >= 0").count()
        idf = np.full(dims, np.log(1.0 + total) + 1)
        idf[df["at"].to_numpy()] = np.log((1.0 + total) / (1 + df["count"].to_numpy())) + 1
        shared = docs.sparkSession.sparkContext.broadcast(idf)

        def shard(pdf: pd.DataFrame) -> pd.DataFrame:
            order = np.random.default_rng(1).permutation(len(pdf))
            data = []
            for i in order:
                at = np.asarray(pdf["at"].iloc[i])
                data.append((at, tfidf(at, np.asarray(pdf["n"].iloc[i]), shared.value), int(pdf["_lang"].iloc[i])))
            data.sort(key=lambda r: (r[0].tobytes(), r[2]))
            data = [data[i] for i in np.random.default_rng(2).permutation(len(data))]
            seen, w, bias = train_ftrl(data, len(langs), epochs, alpha, beta, l1, l2)
            i, j = np.nonzero(w)
            return pd.DataFrame({"i": np.r_[seen[i], np.full(len(langs), -1)].astype("int32"), "j": np.r_[j, np.arange(len(langs))].astype("int32"), "w": np.r_[w[i, j], bias], "s": 1})

        parts = rows.where("_shard >= 0").groupBy("_shard").applyInPandas(shard, "i int, j int, w double, s int")
        mean = parts.groupBy("i", "j").agg(F.sum("w").alias("w")).toArrow()  # the weights that aren't 0, at most CELLS
        used = max(1, rows.where("_shard >= 0").select("_shard").distinct().count())
        bias = np.zeros(len(langs))
        i, j, w = (mean[c].to_numpy() for c in ("i", "j", "w"))
        bias[j[i < 0]] = w[i < 0] / used
        i, j, w = i[i >= 0], j[i >= 0], w[i >= 0] / used
        place = np.zeros(dims, np.int32)
        held = np.unique(i)
        place[held] = np.arange(1, len(held) + 1)
        weights = np.zeros((len(held) + 1, len(langs)))
        weights[place[i], j] = w
        model = LanguageModel(langs, idf, place, weights, bias, 1.0)
        linear = docs.sparkSession.sparkContext.broadcast(model)

        def logits_of(batches):
            m = linear.value
            for b in batches:
                s = [m.logits(np.asarray(at), np.asarray(n)) for at, n in zip(b.column("at").to_pylist(), b.column("n").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("_lang"), pa.array(s, pa.list_(pa.float64()))], names=["_lang", "s"])

        held = rows.where("_shard = -1").select("_lang", "at", "n").mapInArrow(logits_of, "_lang int, s array<double>").toArrow()  # about a fifth of max_docs rows
        logits = np.array(held["s"].to_pylist(), dtype=float).reshape(len(held), len(langs))
        t = fit_temperature(logits, held["_lang"].to_numpy().astype(int))
    finally:
        rows.unpersist()
    return replace(model, temperature=t)


def predict_text(text: str | None, m: LanguageModel) -> tuple[str, float]:
    """The likeliest language and its calibrated probability; ``und`` and 0 without a letter."""
    if text is None or not m.langs or not LETTER.search(text):
        return UND, 0.0
    s = m.logits(*ngram_counts(text, m.bits)) / m.temperature
    p = np.exp(s - s.max())
    k = int(p.argmax())
    return m.langs[k], float(p[k] / p.sum())


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns with the language and its probability, under ``names``, of every whole text.

    One row per row, repeated rows and null ids too; null texts and texts without a
    letter are ``und`` with score 0. Columns outside ``keep`` are not read; ``names``
    must not be among ``keep``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            found = [predict_text(t, m) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[f.name for f in schema])

    plain, fields = numbered(docs, keep, text_col)
    schema = StructType([*fields, StructField("lang", StringType()), StructField("score", DoubleType())])
    return plain.mapInArrow(run, schema).toDF(*keep, *names)
