"""Registered queries of this subpackage: thin digests over its operators, each on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, extract, fim, langid, licences, neardup, oracles, packing, periodic, pii, quality, secrets, vectors, wordbpe
from cohortlens.llm.common import documents, read_table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures, base rule and verdict of every document."""
    return quality.quality_rules(documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated or inherited licence of every document."""
    files = licences.document_paths(read_table(spark, sf_dir, "documents"))
    return licences.scan_licences(files).withColumnRenamed("file_id", "doc_id")


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document; the smallest id of a class is kept."""
    return neardup.near_duplicates(documents(spark, sf_dir))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    return secrets.secret_digests(secrets.find_secrets(documents(spark, sf_dir)))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids, and digest of the bytes decoded from them."""
    return bpe.encode_digests(documents(spark, sf_dir))


def op7_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; the smallest id of a component is kept."""
    return vectors.near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(documents(spark, sf_dir))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify_language(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    found = pii.find_pii(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.col("span_list").alias("spans"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, lengths and digests of every document's fill-in-middle output and of the text restored from it."""
    return fim.fim_digests(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's periodic runs, the longest one, and digest of the text without their repeats."""
    return periodic.run_digests(documents(spark, sf_dir))


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of every document's ids in the vocabulary with word ends, and digest of the text decoded from them."""
    return wordbpe.word_digests(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_rules, op2_html_extraction, op3_licence_scan, op4_bag_minhash, op5_secrets, op6_byte_bpe, op7_flat_graph, op8_packing, op9_language_id, op10_pii,
                                   op11_fill_in_middle, op12_periodic_runs, op13_word_bpe)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
