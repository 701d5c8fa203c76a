"""The registered queries of this subpackage: thin projections of the operators' results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bfd_packing, byte_cnn, license_scan, line_quality, minhash_dedup, piece_dropout, secret_scan, sos_packing, substring_dedup, telephony
from .common import table


def op1_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telephone audio of every document's text, read back."""
    return telephony.telephony(table(spark, sf_dir, "documents"), files=False).drop("media", "pcm", "adpcm_pcm")


def op2_bfd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in id matrices, one row for each matrix row."""
    return bfd_packing.bfd_pack(table(spark, sf_dir, "documents"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdicts of every document, by line frequency."""
    return line_quality.line_quality(table(spark, sf_dir, "documents")).drop("bad_lines")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences found in every document: names, and unit, first line, lines and coefficient of each match."""
    found = license_scan.license_scan(table(spark, sf_dir, "documents"))
    said = F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["unit"], m["line"].cast("string"), m["lines"].cast("string"), F.format_string("%.4f", m["dice"])))
    return found.select("doc_id", "n_matches", "licenses", F.round("best_dice", 6).alias("best_dice"), F.array_join(said, ",").alias("matches"))


def op5_sos_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in windows of 4096 tokens."""
    return sos_packing.sos_pack(table(spark, sf_dir, "documents"))


def op6_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with verdicts by ownership."""
    found = secret_scan.secrets(table(spark, sf_dir, "documents"))
    judged = F.array_join(F.transform("judged", lambda x: F.concat_ws(":", x["start"].cast("string"), x["owners"].cast("string"), x["repositories"].cast("string"), x["verdict"])), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", secret_scan.span_text().alias("spans"), F.coalesce(judged, F.lit("")).alias("verdicts"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 20 words that stand earlier."""
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


def op8_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as SentencePiece ids with merge-dropout: the ids, their digest, and whether decoding gave the text."""
    return piece_dropout.piece_dropout(table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates by shingles of two words, similarity 0.8 or more."""
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=2)


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a byte-level convolutional network."""
    return byte_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries by name."""
    found = (
        op1_telephony, op2_bfd_packing, op3_line_quality, op4_license_scan, op5_sos_packing,
        op6_secret_ownership, op7_substring_dedup, op8_piece_dropout, op9_minhash_dedup, op10_byte_cnn,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL of those that it can express."""
    return {"op3_line_quality": line_quality.SQL}
