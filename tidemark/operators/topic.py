"""Topics of texts: hashed features, calibrated linear classifiers with a band for review, a gate over
groups of items, and their training."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.functions.scoring import wilson_lower
from tidemark.runtime import materialize

DIMENSIONS = 128
GRAM = 3  # characters
STRENGTH = 1.0  # of the pull of all coefficients, the intercept's included, towards 0


@dataclass(frozen=True)
class Classifier:
    """One topic: coefficients, the line that calibrates their sum, and the two thresholds."""

    label: str
    coef: tuple[float, ...]
    intercept: float
    calibration_coef: float
    calibration_intercept: float
    accept: float
    reject: float

    def __post_init__(self) -> None:
        if not self.reject < self.accept:
            raise ValueError(f"{self.label}: the reject threshold must lie below the accept threshold")


def as_rows(spark: SparkSession, model: Sequence[Classifier]) -> DataFrame:
    kind = "label string, coef array<double>, intercept double, calibration_coef double, calibration_intercept double, accept double, reject double"
    return spark.createDataFrame([tuple(asdict(c).values()) for c in model], kind)


def from_rows(rows: DataFrame) -> list[Classifier]:
    return [Classifier(r["label"], tuple(r["coef"]), *list(r)[2:]) for r in rows.orderBy("label").collect()]


def features(title: Column, content: Column, dimensions: int = DIMENSIONS) -> Column:
    """The distinct dimensions that the text's runs of GRAM characters are hashed to, each worth one over
    the root of their number; the text is the title and the beginning of the content."""
    bucket = lambda gram: (F.conv(F.substring(F.md5(gram.cast("binary")), 1, 4), 16, 10).cast("int") % dimensions).cast("int")

    def of(read: Column) -> Column:
        places = F.when(F.length(read) >= GRAM, F.sequence(F.lit(1), F.length(read) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
        grams = F.array_distinct(F.transform(places, lambda i: F.substr(read, i, F.lit(GRAM))))
        return F.array_distinct(F.transform(grams, bucket))

    # the text as a lambda's argument, so that it is made once and not for every run of characters
    return F.transform(F.array(text.feature_text(title, content)), of)[0]


def raw_score(found: Column, coef: Sequence[float], intercept: float) -> Column:
    """The sum of the coefficients of features(), each worth one over the root of their number."""
    weights = F.lit([float(c) for c in coef])
    total = F.aggregate(found, F.lit(0.0), lambda acc, b: acc + F.get(weights, b))
    return F.coalesce(F.try_divide(total, F.sqrt(F.size(found).cast("double"))), F.lit(0.0)) + F.lit(float(intercept))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(x, F.lit(-35.0)), F.lit(35.0))))


def classify(items: DataFrame, model: Sequence[Classifier], found: Column | None = None) -> DataFrame:
    """items with score_<label> (6 digits), labels (accepted ones) and decision.

    accept: some label reaches its threshold; reject: all lie at or below their reject thresholds;
    review: the rest. items: title, content, unless `found` gives the features.
    """
    found = features(F.col("title"), F.col("content")) if found is None else found
    out = items.withColumn("_found", found)
    for c in model:
        line = F.lit(c.calibration_coef) * raw_score(F.col("_found"), c.coef, c.intercept) + F.lit(c.calibration_intercept)
        out = out.withColumn(f"score_{c.label}", F.round(sigmoid(line), 6))
    score = lambda c: F.col(f"score_{c.label}")
    accepted = F.array_compact(F.array(*(F.when(score(c) >= c.accept, F.lit(c.label)) for c in model)))
    none = F.lit(True)
    for c in model:
        none = none & (score(c) <= c.reject)
    decided = out.withColumn("labels", accepted)
    return decided.withColumn("decision", F.when(F.size("labels") > 0, "accept").when(none, "reject").otherwise("review")).drop("_found")


def gate(decided: DataFrame, by: Sequence[str], min_items: int = 3, min_ratio: float = 0.6, mode: str = "enforce") -> DataFrame:
    """For each group its counts by decision, the relevant ratio, gate_pass and passes.

    mode: off (no verdict, all pass), shadow (a verdict, all pass), enforce (the verdict decides).
    """
    if mode not in ("off", "shadow", "enforce"):
        raise ValueError(f"no mode {mode!r}")
    count = lambda d: F.count_if(F.col("decision") == d)
    sums = decided.groupBy(*by).agg(count("accept").alias("relevant_count"), count("review").alias("review_count"), count("reject").alias("reject_count"), F.count(F.lit(1)).alias("_n"))
    ratio = F.col("relevant_count") / F.col("_n")
    verdict = F.lit(None).cast("boolean") if mode == "off" else (F.col("relevant_count") >= min_items) & (ratio >= min_ratio)
    out = sums.withColumns({"relevant_ratio": F.round(ratio, 3), "gate_pass": verdict})
    return out.withColumn("passes", F.col("gate_pass") if mode == "enforce" else F.lit(True)).drop("_n")


def logistic(rows: DataFrame, dimensions: int, balanced: bool, strength: float = STRENGTH, rounds: int = 60) -> tuple[np.ndarray, float]:
    """(coefficients, intercept) of the regression of y (0 or 1) on sparse features.

    rows: y int, at array<int>, x array<double>. The sum of weighted log-losses plus strength / 2
    times the squared coefficients and intercept has one minimum, found by Newton steps; every task
    sends the sums over its rows, (dimensions + 1)^2 numbers, so the data stay where they are and
    their partitions make no difference but in the last digits. balanced: both labels weigh alike.
    """
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(n) != {0, 1}:
        raise ValueError("rows of both labels are needed")
    weight = {y: (n[0] + n[1]) / (2.0 * n[y]) if balanced else 1.0 for y in (0, 1)}
    d = dimensions + 1

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            loss, g, h = 0.0, np.zeros(d), np.zeros((d, d))
            for b in batches:
                x = np.zeros((len(b), d))
                x[:, -1] = 1.0
                if len(b):
                    x[np.repeat(np.arange(len(b)), b["at"].map(len)), np.concatenate(b["at"].to_numpy())] = np.concatenate(b["x"].to_numpy())
                y, c = b["y"].to_numpy(float), np.where(b["y"] == 1, weight[1], weight[0])
                z = x @ w
                p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
                loss += float((c * (np.logaddexp(0, z) - y * z)).sum())
                g += x.T @ (c * (p - y))
                h += (x * (c * p * (1 - p))[:, None]).T @ x
            flat = np.concatenate([[loss], g, h.ravel()])
            yield pd.DataFrame({"k": np.arange(len(flat)), "v": flat})

        flat = np.zeros(1 + d + d * d)
        got = rows.select("y", "at", "x").mapInPandas(part, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
        flat[got["k"]] = got["v"]
        return float(flat[0] + strength / 2 * w @ w), flat[1 : 1 + d] + strength * w, flat[1 + d :].reshape(d, d) + strength * np.eye(d)

    w = np.zeros(d)
    loss, g, h = sums(w)
    for _ in range(rounds):
        step = np.linalg.solve(h, g)
        size = 1.0
        while True:
            after, g_after, h_after = sums(w - size * step)
            if after <= loss + 1e-12 * abs(loss) or size < 1e-6:
                break
            size /= 2
        w, loss, g, h = w - size * step, after, g_after, h_after
        if np.abs(step).max() * size < 1e-11:
            break
    return w[:-1], float(w[-1])


def thresholds(scored: DataFrame, min_precision: float, min_npv: float, least: int) -> tuple[float, float]:
    """(accept, reject) by rows of score and y: the lowest score at and above which the precision
    holds, and below it the highest at and under which the share of 0 holds, over `least` rows or more.

    Scores have 6 digits, so there are at most a million different ones to walk along.
    """
    from pyspark.sql import Window

    by = scored.groupBy(F.round("score", 6).alias("score")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    along = lambda order: Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down, up = along(F.desc("score")), along(F.asc("score"))
    run = by.select("score", F.sum("n").over(down).alias("above"), F.sum("y").over(down).alias("above_y"), F.sum("n").over(up).alias("below"), F.sum("y").over(up).alias("below_y"))
    accept = run.filter((F.col("above") >= least) & (F.col("above_y") / F.col("above") >= min_precision)).agg(F.min("score")).first()[0]
    if accept is None:
        raise ValueError("no score keeps the precision over enough rows")
    lower = run.filter((F.col("score") < accept) & (F.col("below") >= least) & (1 - F.col("below_y") / F.col("below") >= min_npv))
    reject = lower.agg(F.max("score")).first()[0]
    if reject is None:
        raise ValueError("no score keeps the share of negatives over enough rows")
    return accept, reject


def train(items: DataFrame, labels: Sequence[str], min_precision: float = 0.95, min_npv: float = 0.95, least: int = 10, min_test: int = 10, dimensions: int = DIMENSIONS) -> tuple[list[Classifier], DataFrame]:
    """(model, metrics) from rows of title, content, split (train, calibration, test) and a column of
    0 or 1 for each label.

    The coefficients come from the train rows, both labels weighing alike; the calibrating line and the
    thresholds from the calibration rows; the metrics, one row a label, from the test rows. ready: all
    labels accept min_test test rows or more with a lower precision bound (95 %) of min_precision.
    """
    found = features(F.col("title"), F.col("content"), dimensions)
    # every Newton step reads all rows again: the features are made once
    rows = materialize(items.select("split", *labels, found.alias("at")), "features")
    rows = rows.withColumn("x", F.array_repeat(1.0 / F.sqrt(F.size("at").cast("double")), F.size("at")))
    model, measured = [], []
    for label in labels:
        of = lambda split: rows.filter(F.col("split") == split).select(F.col(label).cast("int").alias("y"), "at", "x")  # noqa: B023, E731
        coef, intercept = logistic(of("train"), dimensions, balanced=True)
        coef, intercept = [round(float(c), 10) for c in coef], round(intercept, 10)
        raw = lambda split: of(split).select("y", raw_score(F.col("at"), coef, intercept).alias("raw"))  # noqa: B023, E731
        line, shift = logistic(raw("calibration").select("y", F.array(F.lit(0)).alias("at"), F.array("raw").alias("x")), 1, balanced=False)
        a, b = round(float(line[0]), 10), round(shift, 10)
        scored = lambda split: raw(split).select("y", F.round(sigmoid(F.lit(a) * F.col("raw") + F.lit(b)), 6).alias("score"))  # noqa: B023, E731
        accept, reject = thresholds(scored("calibration"), min_precision, min_npv, least)
        model.append(Classifier(label, tuple(coef), intercept, a, b, accept, reject))
        up, down = F.col("score") >= accept, F.col("score") <= reject
        measured.append(scored("test").agg(
            F.lit(label).alias("label"), F.count(F.lit(1)).alias("count"), F.sum("y").alias("positives"), F.count_if(up).alias("accept_count"), F.count_if(up & (F.col("y") == 1)).alias("accept_correct"),
            F.count_if(down).alias("reject_count"), F.count_if(down & (F.col("y") == 0)).alias("reject_correct"), F.count_if(~up & ~down).alias("review_count"),
        ))
    metrics = measured[0]
    for m in measured[1:]:
        metrics = metrics.unionByName(m)
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    lower = F.round(F.when(F.col("accept_count") > 0, wilson_lower(F.col("accept_correct"), F.col("accept_count"))).otherwise(0.0), 6)
    out = metrics.withColumns({"accept_precision": share("accept_correct", "accept_count"), "accept_precision_lower": lower, "positive_recall": share("accept_correct", "positives"), "npv": share("reject_correct", "reject_count")})
    return model, out.withColumn("ready", (F.col("accept_count") >= min_test) & (F.col("accept_precision_lower") >= min_precision))
