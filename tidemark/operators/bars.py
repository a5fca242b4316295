"""Daily bars: flows, rolling volumes, volatility, forward returns, run lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Investor names of the long flow table, by class.
INVESTORS = {
    "foreign_net": ("Foreign_Investor", "Foreign_Dealer_Self"),
    "trust_net": ("Investment_Trust",),
    "dealer_net": ("Dealer_self", "Dealer_Hedging"),
}
COMMON_STOCK = r"^[1-9][0-9]{3}$"


def is_common_stock(ticker: Column) -> Column:
    return ticker.rlike(COMMON_STOCK)


def investor_nets(flows: DataFrame) -> DataFrame:
    """(stock_id, date) with the net of each investor class; other names make a row of zeros."""
    net = F.col("buy") - F.col("sell")
    nets = [F.sum(F.when(F.col("name").isin(*names), net).otherwise(0)).cast("long").alias(c) for c, names in INVESTORS.items()]
    return flows.groupBy("stock_id", "date").agg(*nets)


def run_length(value: Column, keys: list[str], order: str, seed: Column | None = None) -> tuple[dict[str, Column], Column]:
    """Signed number of rows in a row with value's sign; a zero is 0 and ends a run.

    Returns helper columns to add one after the other, and the expression over them. A seed is
    the run length before the first row: it goes on if the first run has its sign.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    sign = F.signum(value).cast("int")
    steps = {
        "_sign": sign,
        "_starts": F.when(F.lag(sign).over(w).eqNullSafe(sign), 0).otherwise(1),
    }
    steps["_island"] = F.sum("_starts").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = Window.partitionBy(*keys, "_island").orderBy(order)
    length = F.col("_sign") * F.row_number().over(inside)
    if seed is not None:
        length = length + F.when((F.col("_island") == 1) & (F.col("_sign") != 0) & (F.signum(seed) == F.col("_sign")), seed).otherwise(0)
    return steps, length.cast("int")


def signed_runs(bars: DataFrame, value: str = "foreign_net", name: str = "foreign_consecutive_days", keys: tuple[str, ...] = ("ticker",), order: str = "date", seed: Column | None = None) -> DataFrame:
    steps, length = run_length(F.col(value), list(keys), order, seed)
    out = bars
    for c, e in steps.items():
        out = out.withColumn(c, e)
    return out.withColumn(name, length).drop(*steps)


def derive(bars: DataFrame) -> DataFrame:
    """Bars with run lengths, 20-row volume ratios, volatility and forward returns.

    Windows are by ticker and rows in date order, in one shuffle by ticker. A 20-row mean needs
    20 rows, volatility 21 closes and two returns; ratios over zero are null; a forward return
    that has not matured is null.
    """
    w = Window.partitionBy("ticker").orderBy("date")
    last20 = w.rowsBetween(-19, 0)
    n = F.row_number().over(w)
    net = F.col("foreign_net") + F.col("trust_net") + F.col("dealer_net")
    ahead = lambda k: F.try_divide(F.lead("close", k).over(w), F.expr("nullif(close, 0)")) - 1
    out = signed_runs(bars)
    out = out.withColumn("_ret", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    out = out.withColumn("_avg20", F.when(n >= 20, F.avg("volume").over(last20)))
    return out.select(
        "ticker", "date", "close", "volume", "foreign_net", "trust_net", "dealer_net", "foreign_consecutive_days",
        F.try_divide(F.col("volume"), F.col("_avg20")).alias("volume_ratio_vs_avg20"),
        F.try_divide(net, F.col("_avg20")).alias("net_vs_avg20_volume_pct"),
        F.when((n >= 21) & (F.count("_ret").over(last20) >= 2), F.stddev_samp("_ret").over(last20)).alias("sigma_20d"),
        *[ahead(k).alias(f"return_{k}d") for k in (1, 3, 5)],
    )


def zero_flow_share(bars: DataFrame) -> DataFrame:
    """Percentage of the latest day's rows whose three nets are all zero."""
    latest = bars.agg(F.max("date").alias("_d"))
    zero = (F.col("foreign_net") == 0) & (F.col("trust_net") == 0) & (F.col("dealer_net") == 0)
    day = bars.join(F.broadcast(latest), F.col("date") == F.col("_d"))
    return day.agg(F.round(F.try_divide(100.0 * F.count_if(zero), F.count(F.lit(1))), 1).alias("zero_pct"))


def backfill_rows(bars: DataFrame, new_days: int, context: int = 8) -> DataFrame:
    """Rows of the last new_days + context dates; older ones only with a known volatility."""
    days = bars.select("date").distinct()
    numbered = days.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("date"))))
    joined = bars.join(F.broadcast(numbered.filter(F.col("_n") <= new_days + context)), "date")
    return joined.filter((F.col("_n") <= new_days) | F.col("sigma_20d").isNotNull()).drop("_n")


def demand(entities: DataFrame, hot: list[str], verified: Column) -> DataFrame:
    """Tickers to fetch: those of unverified events and the standing pool, common stocks only."""
    asked = entities.filter(~verified.eqNullSafe(F.lit(True))).select(F.explode("tickers").alias("ticker"))
    pool = entities.sparkSession.createDataFrame([(t,) for t in hot], "ticker string")
    return asked.unionByName(pool).filter(is_common_stock(F.col("ticker"))).distinct()
