"""Words as every operator here takes them: maximal runs outside [\\x20\\x09-\\x0D]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.runtime import workers_import

# The six separators, in code point order (fixed values of the word definition).
SEPARATORS = "\t\n\x0b\x0c\r "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Array of the words of text; null or blank text: an empty array."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SEPARATORS, " " * len(SEPARATORS))
    return F.array_remove(F.split(spaced, " "), "")


def without_separators(text: Column) -> Column:
    return F.translate(text, SEPARATORS, "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it."""
    return F.transform(F.array(value), body)[0]
