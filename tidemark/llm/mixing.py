"""Mixing sources to target weights: repetition rates and hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.text import words
from tidemark.runtime import broadcast_if_small, materialize

WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    Sources by code point, null last, get the weights in turn. They share `share` times the
    total size by weight; a target stops at `most` times its source's size and the excess is
    shared again by weight until none is above. That is the level L at which the sum of
    min(weight * L, most * size) reaches the total: with sources ordered by size / weight, L is
    found by two running sums. One row a source after a map-side combined aggregation, so the
    ordering windows see sources, not documents. An empty table gives no rows; a source of size
    0 has rate 0.
    """
    by_source = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    everywhere = Window.partitionBy()
    ranked = by_source.withColumn("weight", F.get(F.array(*map(F.lit, weights)), turn).cast("long")).withColumn("total", share * F.sum("source_size").over(everywhere))
    by_cap = Window.orderBy(F.col("source_size") * most / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("taken_by_capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("taken_by_capped")) / F.col("weight_left"))
        .withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("L", F.min(F.when(F.col("fits"), F.struct(F.col("weight_left") * -1, F.col("level").alias("level")))).over(everywhere)["level"])
    )
    target = F.least(F.coalesce(F.col("weight") * F.col("L"), F.col("cap")), F.col("cap"))
    return level.select("source", "source_size", target.alias("target"), F.coalesce(F.try_divide(target, F.col("source_size")), F.lit(0.0)).alias("rate"))


def copies(doc_id: Column, text: Column, rate: Column, seed: int) -> Column:
    """floor(rate), plus one with the probability of the fraction, drawn from a hash.

    The draw is the first 52 bits of md5(seed:doc_id:md5(text)): any rerun, partitioning or
    engine agrees. A null doc_id or text hashes as empty.
    """
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    draw = F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, F.lit(1)).otherwise(F.lit(0))).cast("long")


def rates(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """docs plus _size, _source_size, _target and _copies (columns of docs keep their names).

    Size: words of the text, null 0. Every row of docs stays. A hot source is one row of the
    joined table and, map-side combined, one row a task of the aggregation. Empty table: no rows.
    """
    text, source = F.col(f"`{text_col}`"), F.col(f"`{source_col}`")
    sized = docs.withColumn("_size", F.size(words(text)).cast("long"))
    by_source = targets(docs.select(source.alias("source"), F.size(words(text)).cast("long").alias("size")), weights, share, most)
    by_source = by_source.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("rate").alias("_rate"))
    joined = sized.join(broadcast_if_small(materialize(by_source, "rates"), 20_000), F.col("_source").eqNullSafe(source), "left")
    return joined.withColumn("_copies", copies(F.col("doc_id"), text, F.col("_rate"), seed)).drop("_source", "_rate")


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 7) -> DataFrame:
    """docs with every row as often as its source's rate and its draw say; columns of docs."""
    rated = rates(docs, text_col, source_col, weights, share, most, seed).filter("_copies > 0")
    repeated = rated.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return repeated.select(*[F.col(f"`{c}`") for c in docs.columns])
