"""The corpus pipeline: toxicity, n-gram Jaccard join, benchmark decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from helixframe.llm import decontaminate, jaccard_join, packing, secrets, toxicity
from helixframe.llm.common import dropped, scratch, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score 0.5 or more for toxicity; the model learns from the labelled documents of this stage's input.

    Null, empty and wordless texts score 0 and stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, keep=True, name="\x00toxicity")
    return scored.where(F.col("\x00toxicity") < 0.5).drop("\x00toxicity")


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) keep one document, that of the smallest doc_id.

    Documents that nothing links to stay, and all without a word. Rows of one id and different texts are told apart by their
    texts; rows of equal id and text are copies, of which one stays. Of a group, rows without an id come last.
    """
    return jaccard_join.distinct_documents(docs, k=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a copy of a benchmark item, exact or edited; every row is judged by its own text."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark and count the characters of changed texts anew; every document stays."""
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: The classifier, the alignment and the tokenizer can't be expressed in SQL: tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder before the next; a stage's own tables go when it is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for k, (name, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), name, keep=True)
        if last is not None:
            dropped(spark, last)
        last = docs
    return docs
