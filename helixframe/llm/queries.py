"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import decontaminate, hilbert, jaccard_join, licenses, packing, quality, secrets, substring_dedup, token_blocks, toxicity
from .common import shared_dir


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patched frame-of-reference blocks of every document's ids, written, and read back."""
    path = shared_dir(spark)
    token_blocks.write_token_blocks(_documents(spark, sf_dir), path, _tokenizer("word_bpe_49k.json"), end_id=1)
    return token_blocks.read_token_blocks(spark, path)


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in sequences of 1024 ids, packed by non-negative least squares."""
    return packing.pack_documents(_documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"), window=1024, end_id=0)


def op3_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest, the licence that it is, and the licence notices among its lines."""
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op4_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: fixed patterns, and strings of high entropy."""
    return secrets.find_secrets(_documents(spark, sf_dir))


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality counts of every document, and whether it survives the removal of its host's frequent lines."""
    return quality.quality(_documents(spark, sf_dir))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a copy, exact or edited, of a benchmark item, with the passage."""
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_collinear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in several documents, word for word or edited."""
    return substring_dedup.repeated_passages(_documents(spark, sf_dir), k=5, least_words=50, percent=80)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more."""
    return jaccard_join.jaccard_components(_documents(spark, sf_dir), k=5, percent=80)


def op9_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learnt from the labels that aren't held out."""
    docs = _documents(spark, sf_dir)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of equal row counts, cut from the Hilbert order of size, language and source."""
    out = hilbert.document_shards(_documents(spark, sf_dir), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_blocks, op2_nnls_packing, op3_license_digests, op4_entropy_secrets, op5_line_frequency, op6_decontaminate, op7_collinear_chains, op8_jaccard_join, op9_subword_toxicity, op10_hilbert_shards)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_license_digests": licenses.oracle(), "op5_line_frequency": quality.ORACLE, "op8_jaccard_join": jaccard_join.ORACLE, "op10_hilbert_shards": hilbert.oracle()}
