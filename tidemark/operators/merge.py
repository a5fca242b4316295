"""Upserts and first-write-wins inserts over plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def insert_new(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """old and those rows of new whose key is in neither old nor an earlier row of new."""
    first = Window.partitionBy(*key).orderBy(order if order else F.xxhash64(*new.columns))
    fresh = new.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n").join(old.select(*key), key, "left_anti")
    return old.unionByName(fresh.select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """old with `columns` taken from new where keys meet, and the rows that only new has.

    Other columns of met rows stay as they are. Keys are unique in each.
    """
    n = new.select(*[F.col(c).alias(f"_new_{c}") for c in new.columns], F.lit(True).alias("_there"))
    on = [F.col(k) == F.col(f"_new_{k}") for k in key]
    joined = old.withColumn("_was", F.lit(True)).join(n, on, "full")
    there = F.col("_there").isNotNull()

    def value(c: str):
        if c in key:
            return F.coalesce(F.col(c), F.col(f"_new_{c}"))
        if c in columns:
            return F.when(there, F.col(f"_new_{c}")).otherwise(F.col(c))
        if c in new.columns:
            return F.when(F.col("_was").isNull(), F.col(f"_new_{c}")).otherwise(F.col(c))
        return F.col(c)

    return joined.select(*[value(c).alias(c) for c in old.columns])


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def ledger_summary(rows: DataFrame) -> DataFrame:
    """One row over a ledger of runs: the latest run of a site is the site's state, tokens and
    runs_total are of all runs.

    rows: source_prefix, site_name, seq, status, retry_count, repair_count, first_pass_success,
    coder_tokens. A site is known by its prefix, else its name, else '?'. Runs that do not say
    whether they passed at first did if they had no retry; repairs are else retries.
    """
    key = F.coalesce(F.nullif("source_prefix", F.lit("")), "site_name", F.lit("?"))
    last = latest(rows.withColumn("_key", key), ["_key"], "seq")
    good = F.col("status") == "success"
    sites = last.agg(
        F.count(F.lit(1)).alias("sites_distinct"),
        F.count_if(good).alias("success"),
        F.round(F.avg(F.coalesce(good, F.lit(False)).cast("double")), 4).alias("success_rate"),
        F.count_if(F.col("status") == "escalated").alias("escalated"),
        F.count_if(F.col("status") == "error").alias("error"),
        F.round(F.avg(F.when(good, F.col("retry_count"))), 2).alias("avg_retries_on_success"),
        F.count_if(F.coalesce("first_pass_success", F.col("retry_count") == 0)).alias("first_try_success"),
        F.coalesce(F.sum(F.coalesce("repair_count", "retry_count")), F.lit(0)).alias("repairs_total"),
    )
    sites = sites.withColumn("first_pass_rate", F.round(F.try_divide(F.col("first_try_success").cast("double"), F.col("sites_distinct")), 4))
    return sites.crossJoin(rows.agg(F.count(F.lit(1)).alias("runs_total"), F.coalesce(F.sum("coder_tokens"), F.lit(0)).alias("coder_tokens_total")))
