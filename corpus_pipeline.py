"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import line_dedup, mixing, near_copies, packing, quality_rules, simhash
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.text import table
from tidemark.runtime import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that recur across them; n_chars follows the text."""
    from pyspark.sql import functions as F

    cleaned = line_dedup.dedup(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, four bits)."""
    return simhash.keep_one(docs, n=5, distance=4)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without edited copies, repeated or left out by their source's rate.

    Four bits catch few copies of a shingle similarity of 0.8. So of what the fingerprints
    leave, one document of each group of that similarity is taken, verified on the shingles.
    """
    return mixing.mix(near_copies.keep_one(docs, n=5, similarity=0.8))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash", near_duplicates),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

# XXH64 fingerprints, their components and the packing order are beyond SQL; tests/llm holds
# the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
