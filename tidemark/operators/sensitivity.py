"""How far scores move when their settings do.

Settings are columns: every row is exploded over the variants of a small table, scored once for
each, and counted by (variant, old score, new score). Whatever is asked of a variant comes from
these counts, which the number of different scores bounds, not the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring

# What each variant of the validation score changes, in the study's own order.
VALIDATION_VARIANTS = (
    ("w_inst 20", {"w_inst": 20.0}),
    ("w_inst 30", {"w_inst": 30.0}),
    ("w_price 15", {"w_price": 15.0}),
    ("w_price 25", {"w_price": 25.0}),
    ("pct_cap 0.15", {"pct_cap": 0.15}),
    ("pct_cap 0.25", {"pct_cap": 0.25}),
    ("z_div 1.5", {"z_div": 1.5}),
    ("z_div 2.5", {"z_div": 2.5}),
    ("days_weight 0.2", {"days_weight": 0.2}),
    ("days_weight 0.4", {"days_weight": 0.4}),
    ("gate_lo 35", {"gate_lo": 35.0}),
    ("gate_hi 60", {"gate_hi": 60.0}),
    ("amp_hi 1.25", {"amp_hi": 1.25}),
)
HEAT_VARIANTS = (
    ("baseline 1.5", {"baseline": 1.5}),
    ("baseline 3", {"baseline": 3.0}),
    ("hi 1.1", {"hi": 1.10}),
    ("hi 1.2", {"hi": 1.20}),
    ("lo 0.85", {"lo": 0.85}),
)
MATURED = (0, 1, 3, 5)


def shifted_weights(by: float = 0.05, weights: Mapping[str, float] = scoring.WEIGHTS) -> list[tuple[str, dict[str, float]]]:
    """One weight up or down, 0.01 at least, and the others in proportion, so that all sum to 1."""
    out = []
    for k in weights:
        for sign in (1, -1):
            moved = max(0.01, weights[k] + sign * by)
            rest = sum(w for other, w in weights.items() if other != k)
            out.append((f"{k} {sign * by:+g}", {other: moved if other == k else w * ((1 - moved) / rest) for other, w in weights.items()}))
    return out


def importance_variants() -> list[tuple[str, dict[str, float]]]:
    return [*shifted_weights(), *HEAT_VARIANTS]


def with_variants(rows: DataFrame, base: Mapping[str, float], variants: Sequence[tuple[str, Mapping[str, float]]]) -> tuple[DataFrame, dict[str, Column]]:
    """rows once for each variant, in column `variant`, and its settings as columns."""
    listed = [F.struct(F.lit(name).alias("variant"), *[F.lit(float(patch.get(k, v))).alias(k) for k, v in base.items()]) for name, patch in variants]
    return rows.withColumn("_cfg", F.explode(F.array(*listed))).withColumn("variant", F.col("_cfg.variant")), {k: F.col(f"_cfg.{k}") for k in base}


def windows(bars: DataFrame, rows: int = 6) -> DataFrame:
    """What the window of `rows` bars from each bar on shows: ticker, date, returns, volatility,
    flows and volume. bars: as bars.derive() gives them; bars without a positive close are out."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(0, rows - 1)
    return bars.filter("close > 0").select(
        "ticker", "date", *[F.col(f"return_{k}d").alias(f"r{k}") for k in (1, 3, 5)], F.col("sigma_20d").alias("sigma"),
        F.avg("net_vs_avg20_volume_pct").over(w).alias("mean_pct"), F.last("foreign_consecutive_days").over(w).alias("cons"), F.max("volume_ratio_vs_avg20").over(w).alias("ratio"),
    )


def judge(seen: DataFrame, score: str, cfg: Mapping = scoring.VALIDATION, price: Callable = scoring.price_signal) -> DataFrame:
    """seen, as windows() gives it, with the validation of a favourable event in column `score`,
    and in `score`_opposed whether flows and price pull apart."""
    i_sign, i_strength = scoring.institution_signal(F.col("mean_pct"), F.col("cons"), cfg)
    p_sign, p_strength, _ = price(F.col("r1"), F.col("r3"), F.col("r5"), F.col("sigma"), cfg)
    signals = {"_is": i_sign, "_if": i_strength, "_ps": p_sign, "_pf": p_strength, "_amp": scoring.volume_amplifier(F.col("ratio"), cfg)}
    named = seen.withColumns(signals)
    total = scoring.validation(*(F.col(c) for c in signals), F.lit("利多"), F.lit("high"), cfg)
    opposed = (F.col("_is") != 0) & (F.col("_is") == -F.col("_ps"))
    return named.withColumns({score: total, f"{score}_opposed": opposed}).drop(*signals)


def _rank(group: str, value: str) -> Column:
    """Average rank of a value among counted rows (n of each)."""
    upto = F.sum("n").over(Window.partitionBy(group).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return upto - (F.sum("n").over(Window.partitionBy(group, value)) - 1) / 2


def agreement(counts: DataFrame, group: str = "variant") -> DataFrame:
    """Of counted pairs of scores (group, a, b, n, opposed): n, Spearman's correlation, share in
    the same band, mean and largest change, share of opposed signals. Shares are percentages;
    the correlation is null where one side has a single score."""
    ranked = counts.withColumns({"_a": _rank(group, "a"), "_b": _rank(group, "b"), "_mid": (F.sum("n").over(Window.partitionBy(group)) + 1) / 2})
    part = lambda x, y: F.sum(F.col("n") * (F.col(x) - F.col("_mid")) * (F.col(y) - F.col("_mid")))
    total, change = F.sum("n"), F.abs(F.col("a") - F.col("b"))
    same = scoring.band(F.col("a")) == scoring.band(F.col("b"))
    return ranked.groupBy(group).agg(
        total.alias("n"), F.round(F.try_divide(part("_a", "_b"), F.sqrt(part("_a", "_a") * part("_b", "_b"))), 6).alias("spearman"),
        F.round(100.0 * F.sum(F.when(same, F.col("n")).otherwise(0)) / total, 4).alias("same_band_pct"),
        F.round(F.sum(F.col("n") * change) / total, 4).alias("mean_change"), F.max(change).alias("max_change"),
        F.round(100.0 * F.sum("opposed") / total, 4).alias("opposed_pct"),
    )


def validation_study(seen: DataFrame, variants: Sequence = VALIDATION_VARIANTS) -> DataFrame:
    """agreement() of each variant's scores with the scores under the usual settings."""
    rows, cfg = with_variants(judge(seen, "a"), scoring.VALIDATION, variants)
    scored = judge(rows, "b", cfg)
    return agreement(scored.groupBy("variant", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if("b_opposed").alias("opposed")))


def gate_checks(seen: DataFrame, z: float = 1.5, share: float = 0.10) -> DataFrame:
    """One row: rows, opposed ones, those of them whose score leaves the gate, and those with
    flows of at least `share` of the volume against a move of at least z deviations."""
    cfg = scoring.VALIDATION
    judged = judge(seen, "score")
    k = F.when(F.col("r5").isNotNull(), 5).when(F.col("r3").isNotNull(), 3).otherwise(1)
    moved = F.abs(F.try_divide(F.coalesce("r5", "r3", "r1"), F.col("sigma") * F.sqrt(k.cast("double"))))
    strong = F.coalesce((moved >= z) & (F.abs("mean_pct") >= share), F.lit(False))
    outside = ~F.col("score").between(cfg["gate_lo"], cfg["gate_hi"])
    return judged.agg(F.count(F.lit(1)).alias("n"), F.count_if("score_opposed").alias("opposed"), F.count_if(F.col("score_opposed") & outside).alias("outside_gate"), F.count_if(F.col("score_opposed") & strong).alias("strong"))


PRICES = (("longest", scoring.price_signal), ("blended", scoring.blended_price_signal))


def maturing(bars: DataFrame, price: Callable) -> DataFrame:
    """ticker, date and the scores s0, s1, s3 and s5 as they stand that many days after each bar,
    when only returns of that age are known. Bars with fewer than five behind them are out."""
    behind = F.lead("date", 5).over(Window.partitionBy("ticker").orderBy("date"))
    rows = bars.filter("close > 0").withColumn("_full", behind.isNotNull())
    w = lambda k: Window.partitionBy("ticker").orderBy("date").rowsBetween(0, k)
    for k in MATURED:
        rows = rows.withColumns({f"_m{k}": F.avg("net_vs_avg20_volume_pct").over(w(k)), f"_c{k}": F.last("foreign_consecutive_days").over(w(k)), f"_v{k}": F.max("volume_ratio_vs_avg20").over(w(k))})
    rows = rows.filter("_full")
    for k in MATURED:
        known = {f"r{d}": F.col(f"return_{d}d") if d <= k else F.lit(None).cast("double") for d in (1, 3, 5)}
        rows = judge(rows.withColumns({**known, "sigma": F.col("sigma_20d"), "mean_pct": F.col(f"_m{k}"), "cons": F.col(f"_c{k}"), "ratio": F.col(f"_v{k}")}), f"s{k}", price=price)
    return rows.select("ticker", "date", *[f"s{k}" for k in MATURED])


def jumps(bars: DataFrame) -> DataFrame:
    """By way of taking the price: the largest step of each bar's score while it matures, as n,
    mean, median, 95th of a hundred, and percentages over 15 and over 25 points."""
    steps = None
    for name, price in PRICES:
        step = F.greatest(*(F.abs(F.col(f"s{b}") - F.col(f"s{a}")) for a, b in zip(MATURED, MATURED[1:], strict=False)))
        one = maturing(bars, price).groupBy(F.lit(name).alias("price"), step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
        steps = one if steps is None else steps.unionByName(one)
    running = F.sum("n").over(Window.partitionBy("price").orderBy("step"))
    all_ = F.sum("n").over(Window.partitionBy("price"))
    placed = steps.withColumns({"_upto": running, "_all": all_})
    at = lambda place: F.min(F.when(F.col("_upto") > place, F.col("step")))  # noqa: E731 - the step of the row in that place, from 0
    over = lambda points: F.round(100.0 * F.sum(F.when(F.col("step") > points, F.col("n")).otherwise(0)) / F.sum("n"), 4)
    low, high = F.floor((F.col("_all") - 1) / 2), F.floor(F.col("_all") / 2)
    return placed.groupBy("price").agg(
        F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("step")) / F.sum("n"), 4).alias("mean_jump"), ((at(low) + at(high)) / 2).alias("median_jump"),
        at(F.floor(F.col("_all") * 0.95)).alias("p95_jump"), over(15).alias("over_15_pct"), over(25).alias("over_25_pct"),
    )


def price_agreement(bars: DataFrame) -> DataFrame:
    """agreement() of the two ways of taking the price, once all returns are known."""
    rows = windows(bars)
    scored = judge(judge(rows, "a"), "b", price=scoring.blended_price_signal)
    return agreement(scored.groupBy(F.lit("blended").alias("variant"), "a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if("b_opposed").alias("opposed")))


def importance_study(parts: DataFrame, share: float = 0.05) -> DataFrame:
    """How stars and the most important events change with weights and amplifier.

    parts: breadth, authority, impact, category and heat_sources. By variant: n, percentage with
    the same stars, largest change of stars, and percentage of the events on top that stay there.
    On top are the first `share` of the events by total, one at least; equal totals stand together.
    """
    names = list(scoring.WEIGHTS)
    dims = {k: F.col(k) for k in names}
    usual = scoring.weighted(dims, scoring.heat(F.col("heat_sources")))
    rows, cfg = with_variants(parts.withColumn("_usual", usual), {**scoring.WEIGHTS, **scoring.HEAT}, importance_variants())
    rows = rows.withColumn("_new", scoring.weighted(dims, scoring.heat(F.col("heat_sources"), cfg), cfg))
    shift = F.abs(scoring.star_count(F.col("_new")) - scoring.star_count(F.col("_usual")))
    counts = rows.groupBy("variant", F.round("_usual", 6).alias("a"), F.round("_new", 6).alias("b"), shift.alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    all_ = F.sum("n").over(Window.partitionBy("variant"))

    def top(c: str) -> Column:
        upto = F.sum("n").over(Window.partitionBy("variant").orderBy(F.desc(c)).rangeBetween(Window.unboundedPreceding, Window.currentRow))
        above = upto - F.sum("n").over(Window.partitionBy("variant", c))
        return above < F.greatest(F.lit(1), F.floor(all_ * share))

    counts = counts.withColumns({"_a": top("a"), "_b": top("b")})
    held = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return counts.groupBy("variant").agg(
        F.sum("n").alias("n"), F.round(100.0 * held(F.col("shift") == 0) / F.sum("n"), 4).alias("same_stars_pct"), F.max("shift").alias("max_shift"),
        F.round(100.0 * held(F.col("_a") & F.col("_b")) / held(F.col("_a")), 4).alias("top_kept_pct"),
    )
