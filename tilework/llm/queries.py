"""The registered queries of this subpackage: each applies its operator to a whole table and derives digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, lm, merge_dropout, packing, periodic_runs, pii, quality, simhash, token_counts, token_files, toxicity, warc, whitening
from .common import new_folder, saved


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each encoded length: its documents, and the suffix sums that answer any context limit."""
    return token_counts.suffix_sums(saved(token_counts.length_histogram(_table(spark, sf_dir, "documents")), "histogram"))


def op2_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as audio samples, stored, read back and described."""
    found = audio.document_audio(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32",
        "media_bytes", "media_sha256", audio.feature_digest().alias("feature"),
        F.col("n_frames").cast("long").alias("n_frames"), F.sha2("tensors", 256).alias("tensors_sha256"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, its rules' votes, the posterior of being good and the verdict."""
    found = quality.judge(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", *quality.FIELDS, "base_failed", "kept", "votes", F.round("quality", 6).alias("quality"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids, written in ascending doc_id order and read back from the files."""
    found = token_files.round_trip(_table(spark, sf_dir, "documents"), new_folder(spark, "token-files"))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's WARC record, read back from the archives."""
    folder = new_folder(spark, "archives")
    files = warc.write_archives(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's code length by prediction by partial matching, beside a unigram base."""
    found = lm.score(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces under merge dropout, and whether they spell its text again."""
    return merge_dropout.documents_round_trip(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    return pii.report(_table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and class of near duplicates."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chance of being toxic, and which sentences make it so."""
    found = toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    first = F.get("sentences", F.lit(0))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("sentences").alias("n_offending"), first["start"].alias("first_start"), first["end"].alias("first_end"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of repeated word sequences, and its text without the repeats."""
    return periodic_runs.report(_table(spark, sf_dir, "documents"), repeat_tails=True)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first sixteen whitened components."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_counts, op2_audio, op3_quality, op4_token_files, op5_warc, op6_ppm, op7_packing, op8_merge_dropout, op9_pii, op10_simhash, op11_toxicity, op12_periodic_runs, op13_whitening)
    return {f.__name__: f for f in found}


#: Payloads' digests in base 32: each of 32 signs takes five bits, out of two neighbouring hexadecimal digits.
_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS sha,
         min(page_id) OVER (PARTITION BY html) AS first_id
  FROM p
)
SELECT CAST(page_id AS BIGINT) AS page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((((strpos('0123456789abcdef', sha[1 + (5 * i) // 4]) - 1) * 16
         + strpos('0123456789abcdef', sha[2 + (5 * i) // 4]) - 1) // (1 << CAST(3 - (5 * i) % 4 AS INTEGER))) % 32) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE CAST(first_id AS BIGINT) END AS refers_to
FROM h
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": _WARC_SQL}
