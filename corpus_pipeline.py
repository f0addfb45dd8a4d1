"""The corpus pipeline: documents in, packed clean documents out.

Every stage takes what its predecessor kept and returns the columns of documents,
with ``n_chars`` brought up to date; the last one returns packed pieces. Documents
with null or empty text pass the first four stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from verbatim.llm import jaccard, packing, queries, secrets, suffixes, toxicity
from verbatim.llm.common import discard, saved, unused


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the present text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon does not reject."""
    lexicon = queries.toxicity_lexicon(docs, queries.table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, lexicon)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word sets of similarity 0.8 or more, the document with the smallest id."""
    return jaccard.one_of_each(docs, 5, 80, 100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier; a text of nothing else goes with its document."""
    had = unused(docs, "had_text")
    left = suffixes.cut_texts(docs.withColumn(had, F.length("text") > 0), 100)
    return _counted(left.where(~F.coalesce(F.col(had) & (F.length("text") == 0), F.lit(False))).drop(had))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of every secret."""
    return _counted(secrets.redacted(docs, secrets.train(docs)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens in their sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), 1024, 2)


STAGES = [
    ("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies), ("suffix-array dedup", cut_repeats), ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]
#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to all documents; what each returns is written and read again, and then removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{k + 1}")
            discard(before)
    return docs
