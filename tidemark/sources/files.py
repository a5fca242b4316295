"""File sources and sinks: JSON arrays, chart payloads, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHART = "timestamp array<bigint>, close array<double>, gmtoffset bigint"


def read_articles(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """A JSON array file as rows, each key once, the first in file order; rows without a key all stay."""
    rows = spark.read.schema(schema).json(path, multiLine=True).withColumn("_at", F.monotonically_increasing_id())
    first = F.row_number().over(Window.partitionBy(key).orderBy("_at"))
    return rows.withColumn("_n", F.when(F.col(key).isNull(), 1).otherwise(first)).filter("_n = 1").drop("_n", "_at")


def index_rows(charts: DataFrame, payload: str = "payload") -> DataFrame:
    """(index_code, date, close) from chart payloads: null closes are out, days are local."""
    c = charts.select("index_code", F.from_json(payload, CHART).alias("c"))
    each = c.select("index_code", F.col("c.gmtoffset").alias("off"), F.explode(F.arrays_zip("c.timestamp", "c.close")).alias("x"))
    day = F.date_from_unix_date(F.floor((F.col("x.timestamp") + F.coalesce("off", F.lit(0))) / 86400).cast("int"))
    return each.filter("x.close is not null").select("index_code", day.alias("date"), F.col("x.close").alias("close"))


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)
