"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veinstone.functions.ids import canonical_id
from veinstone.llm import docpairs, mixing, packing, provenance, residue, tokens
from veinstone.session import broadcast_if_small
from veinstone.sources.tables import current_rows, load


#: Owners that the code base's own copyright notices name.
OWNERS = ("Halden Works",)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Files that were not written by hand for the code base."""
    return provenance.file_signs(load(spark, d, "artifacts"), own=OWNERS).select("file_path").distinct()


def p2_signs(spark: SparkSession, d: str) -> DataFrame:
    """The signs of each such file."""
    return provenance.file_signs(load(spark, d, "artifacts"), own=OWNERS)


def _current_code(spark: SparkSession, d: str) -> DataFrame:
    columns = ("function_id", "file_path", "language", "body", "updated_at")
    artifacts = load(spark, d, "artifacts").select(*columns).withColumn("function_id", canonical_id("function_id"))
    return current_rows(artifacts, "function_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Documented members of the current functions."""
    return docpairs.doc_pairs(_current_code(spark, d)).select("function_id", "member_name").distinct()


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pairs themselves: signature, code and description of each documented member."""
    return docpairs.doc_pairs(_current_code(spark, d)).select("function_id", "member_name", "signature", "description", "code")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.with_tokens(load(spark, d, "documents").filter("doc_id is not null"), "text", ["doc_id"]).withColumnsRenamed({"doc_id": "item_id", "n_tokens": "size"})
    return packing.pack_items(sizes, load(spark, d, "pack_sizes").withColumnRenamed("capacity_tokens", "capacity"))


def p7_packs(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one, in its container of each size."""
    return _packed(spark, d).select("pack_name", "bin_id", F.col("item_id").alias("doc_id"), "piece", F.col("size").alias("n_tokens"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and fill of each size."""
    packs = load(spark, d, "pack_sizes")
    bins = _packed(spark, d).groupBy("pack_name", "bin_id").agg(F.sum("size").alias("fill"))
    totals = bins.groupBy("pack_name").agg(F.count("*").alias("n_bins"), F.sum("fill").alias("n_tokens"), F.max("fill").alias("max_fill"))
    return totals.join(broadcast_if_small(packs), "pack_name").withColumn("fill_share", F.col("n_tokens") / (F.col("n_bins") * F.col("capacity_tokens")))


def _mixture(spark: SparkSession, d: str, total: str = "corpus") -> mixing.Mixture:
    documents = load(spark, d, "documents").filter("doc_id is not null and text is not null")
    keyed = documents.select("doc_id", "source", F.md5("text").alias("text_key"), "text")
    sized = tokens.with_tokens(keyed, "text", ["doc_id", "source", "text_key"]).withColumnRenamed("doc_id", "item_id")
    return mixing.mix(sized, load(spark, d, "mix_targets"), total)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a mixture as large as the corpus, with how often each is used."""
    return _mixture(spark, d).uses.withColumnRenamed("item_id", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source in it, and the exponent that the repetition limits allow it."""
    return _mixture(spark, d).shares


def p8_exact_mix(spark: SparkSession, d: str) -> DataFrame:
    """Documents of the largest mixture that meets the targets, which the scarcest source bounds."""
    return _mixture(spark, d, "most").uses.withColumnRenamed("item_id", "doc_id")


def p8_exact_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source in it."""
    return _mixture(spark, d, "most").shares


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold template residue, filler or an error page."""
    return residue.residue(load(spark, d, "documents")).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p2_found, p2_signs, p3_found, p3_pairs, p7_packs, p7_fill, p8_mix, p8_shares, p8_exact_mix, p8_exact_shares, p9_found)}
SQL: dict[str, str] = {}
