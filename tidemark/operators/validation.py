"""Market validation of events: what institutions and prices did from the event's day on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import serving


def market_validation(bars: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, score, state, divergence) of every anchor.

    bars: as bars.derive() gives them; anchors: id, ticker, day, direction, confidence. Without a
    bar on or after its day an anchor is still observed: no score, no divergence.
    """
    rows = serving.first_on_or_after(bars, anchors)
    first = lambda c: F.max(F.when(F.col("n") == 1, F.col(c)))
    window = rows.groupBy("id").agg(
        F.avg("net_vs_avg20_volume_pct").alias("mean_pct"), F.max_by("foreign_consecutive_days", "date").alias("cons"),
        F.max("volume_ratio_vs_avg20").alias("ratio"), *[first(f"return_{k}d").alias(f"r{k}") for k in (1, 3, 5)], first("sigma_20d").alias("sigma"),
    )
    i_sign, i_str = scoring.institution_signal(F.col("mean_pct"), F.col("cons"))
    p_sign, p_str, k = scoring.price_signal(F.col("r1"), F.col("r3"), F.col("r5"), F.col("sigma"))
    seen = window.select("id", i_sign.alias("i_sign"), i_str.alias("i_str"), p_sign.alias("p_sign"), p_str.alias("p_str"), k.alias("k"), scoring.volume_amplifier(F.col("ratio")).alias("amp"))
    both = anchors.select("id", "direction", "confidence").join(seen, "id", "left")
    score = scoring.validation(F.col("i_sign"), F.col("i_str"), F.col("p_sign"), F.col("p_str"), F.col("amp"), F.col("direction"), F.col("confidence"))
    opposed = (F.col("i_sign") != 0) & (F.col("p_sign") != 0) & (F.col("i_sign") == -F.col("p_sign"))
    unseen = F.col("k").isNull()
    return both.select("id", F.when(~unseen, score).alias("score"), F.when(unseen, "observing").otherwise(scoring.verify_state(F.col("k"))).alias("state"), F.coalesce(opposed, F.lit(False)).alias("divergence"))
