"""Agreement, precision and recall, thresholds, sensitivity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def pair_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Pairwise precision, recall and F1 of two groupings (id, grp), by counting.

    Pairs inside a group of n are n (n - 1) / 2, so nothing is paired up: common pairs are those
    inside the groups of (gold, predicted). No predicted pairs: precision 1; no gold: recall 1.
    """
    both = gold.select("id", F.col("grp").alias("g")).join(predicted.select("id", F.col("grp").alias("p")), "id")
    pairs = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0)).cast("long").alias("x"))
    counts = pairs(both, "g", "p").select(F.col("x").alias("tp")).crossJoin(pairs(both, "g").select(F.col("x").alias("gold_pairs"))).crossJoin(pairs(both, "p").select(F.col("x").alias("predicted_pairs")))
    p, r = _ratio(F.col("tp"), F.col("predicted_pairs"), 1.0), _ratio(F.col("tp"), F.col("gold_pairs"), 1.0)
    return counts.select("tp", "gold_pairs", "predicted_pairs", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def kappa(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two label columns; 1 if chance alone agrees fully."""
    pairs = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = pairs.groupBy("a").agg(F.sum("n").alias("na")), pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    po, pe = F.col("same") / F.col("t"), F.col("c") / (F.col("t") * F.col("t"))
    return total.crossJoin(chance).select(F.round(F.coalesce(F.try_divide(po - pe, 1 - pe), F.lit(1.0)), 6).alias("kappa"), F.round(po, 6).alias("agreement"))


def set_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Share of equal sets and mean Jaccard of two array columns; two empty sets agree."""
    x, y = (F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>")))) for c in (a, b))
    union = F.size(F.array_union(x, y))
    j = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)
    return rows.agg(F.round(F.avg((x == y).cast("int")), 6).alias("exact"), F.round(F.avg(j), 6).alias("jaccard"))


def multi_label(rows: DataFrame, gold: str, predicted: str) -> DataFrame:
    """Precision and recall by label and, as label '*', over all."""
    g, p = F.coalesce(gold, F.array().cast("array<string>")), F.coalesce(predicted, F.array().cast("array<string>"))
    tagged = rows.select(F.explode(F.array_union(F.transform(F.array_distinct(g), lambda x: F.struct(x.alias("label"), F.lit("g").alias("side"))), F.transform(F.array_distinct(p), lambda x: F.struct(x.alias("label"), F.lit("p").alias("side"))))).alias("x"), g.alias("g"), p.alias("p"))
    each = tagged.select("x.label", "x.side", (F.array_contains("g", F.col("x.label")) & F.array_contains("p", F.col("x.label"))).alias("both"))
    counted = each.groupBy("label").agg(F.count_if((F.col("side") == "g") & F.col("both")).alias("tp"), F.count_if(F.col("side") == "g").alias("gold"), F.count_if(F.col("side") == "p").alias("predicted"))
    total = counted.agg(F.sum("tp").alias("tp"), F.sum("gold").alias("gold"), F.sum("predicted").alias("predicted")).select(F.lit("*").alias("label"), "tp", "gold", "predicted")
    return counted.unionByName(total).select("label", "tp", "gold", "predicted", F.round(_ratio(F.col("tp"), F.col("predicted"), 1.0), 6).alias("precision"), F.round(_ratio(F.col("tp"), F.col("gold"), 1.0), 6).alias("recall"))


def threshold(rows: DataFrame, precision: float, least: int) -> DataFrame:
    """The lowest score that still keeps the precision, with at least `least` rows at or above it.

    rows: score, label. Equal scores stand together, one row each, so the running sums are over
    different scores.
    """
    by = rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("y"))
    w = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = by.select("score", F.sum("n").over(w).alias("n"), F.sum("y").over(w).alias("y")).withColumn("p", F.col("y") / F.col("n"))
    return run.filter((F.col("p") >= precision) & (F.col("n") >= least)).agg(F.min("score").alias("threshold"), F.max("n").alias("covered"))


def spearman(rows: DataFrame, a: str, b: str, group: str) -> DataFrame:
    """Spearman's correlation by group, with average ranks for ties."""

    def ranks(df: DataFrame, c: str, name: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy(group).orderBy(c))
        return df.withColumn("_n", n).withColumn(name, F.avg("_n").over(Window.partitionBy(group, c))).drop("_n")

    both = ranks(ranks(rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra"), b, "_rb")
    return both.groupBy(group).agg(F.round(F.corr("_ra", "_rb"), 6).alias("spearman"), F.count(F.lit(1)).alias("n"))


def smoothness(rows: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """Largest step between neighbouring scores of each key."""
    step = F.abs(F.col(score) - F.lag(score).over(Window.partitionBy(key).orderBy(order)))
    return rows.withColumn("_s", step).groupBy(key).agg(F.max("_s").alias("max_jump"))
