"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boutlake.llm import bpe_fst, bpe_stream, fim, language_id, license_scan, mpeg_audio, neighbours, packing, quality, sharding, simhash, token_counts, whitening
from boutlake.llm.common import fold_of, table


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an MPEG audio stream and read back."""
    return mpeg_audio.store_texts(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text; learned only where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs, fold_of("doc_id", 5) != 0)
    return language_id.predict(docs, model).select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a license template in every text."""
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", F.round("coverage", 6).alias("coverage"), "matched_words", F.to_json("spans").alias("spans"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 512 to 4096 words."""
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, packing.word_count(F.col("text")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every text; labels learned only where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"), fold_of("doc_id", 3) != 1)
    scored = quality.apply(docs, model)
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of near-equal bytes."""
    docs = table(spark, sf_dir, "documents")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    out = sharding.shard_by_bytes(docs, size, ["doc_id"], 40, [F.col("doc_id"), crc.cast("long").alias("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text by byte_bpe_50k.json."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), _file("byte_bpe_50k.json").decode("utf-8"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by byte_bpe_multi_50k.tiktoken and decoded again."""
    import public_tokenizers

    return bpe_fst.encode_column(table(spark, sf_dir, "documents"), _file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every vector whose id is divisible by 20."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints and near-duplicate components of all documents."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text cut at two of its code points and put together anew, and restored from that."""
    made = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(fim.restored(F.col("form"), F.col("output"))).alias("restored_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on the first eight components of the covariance of all, with unit variances."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


def op13_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded by the merge list of byte_bpe_50k.json and decoded again."""
    vocabulary = _file("byte_bpe_50k.json").decode("utf-8")
    both = bpe_stream.decode_ids(bpe_stream.encode_texts(table(spark, sf_dir, "documents"), vocabulary), vocabulary)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def _file(name: str) -> bytes:
    """A vocabulary file, read once where the query is built and sent to the executors."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


QUERIES = (op1_mpeg_audio, op2_language_id, op3_license_scan, op4_best_fit_packing, op5_quality, op6_sharding, op7_token_counts, op8_byte_bpe, op9_neighbours, op10_simhash, op11_fill_in_middle, op12_whitening, op13_bpe_stream)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


_DRAWS = ", ".join(f"('0x' || substr(hex, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
_CUTS = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents),
h AS (SELECT *, {_DRAWS} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN n = 0 OR h3 % 100 >= 90 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, lo) AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def oracle_sql() -> dict[str, str]:
    """Only op11 has an exact DuckDB form; the others need CRC-32, XXH64, a trained model, eigenvectors, a vocabulary file or a sequential plan."""
    return {"op11_fill_in_middle": _CUTS}
