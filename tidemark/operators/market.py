"""Market breadth, movers, sector averages and index overviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONEY = 1e8  # unit of turnover


def _slice(bars: DataFrame, days: int = 20, day: str | None = None) -> DataFrame:
    """Bars of the `days` calendar days up to the latest day (or up to `day`), with that day.

    The latest day is fetched first: as a literal it reaches the scan as a filter.
    """
    last = day if day is not None else bars.agg(F.max("date").cast("string")).first()[0]
    end = F.lit(last).cast("date")
    return bars.filter(F.col("date").between(F.date_sub(end, days - 1), end)).withColumn("_d", end)


def day_changes(bars: DataFrame, day: str | None = None) -> DataFrame:
    """The day's bars with the previous row's close inside the 20-day slice, and the change."""
    w = Window.partitionBy("ticker").orderBy("date")
    px = _slice(bars, 20, day).withColumn("prev", F.lag("close").over(w))
    return px.filter(F.col("date") == F.col("_d")).withColumn("change", F.try_divide(F.col("close"), F.expr("nullif(prev, 0D)")) - 1).drop("_d")


def breadth(bars: DataFrame, limit: float = 0.095, day: str | None = None) -> DataFrame:
    """Advancers, decliners, unchanged, limit moves, turnover, coverage and median change."""
    d, c = day_changes(bars, day), F.col("change")
    return d.agg(
        F.count_if(c > 0).alias("advancers"),
        F.count_if(c < 0).alias("decliners"),
        F.count_if(c == 0).alias("unchanged"),
        F.count_if(c >= limit).alias("limit_up"),
        F.count_if(c <= -limit).alias("limit_down"),
        F.count("change").alias("covered"),
        F.round(F.sum(F.col("close") * F.col("volume")) / MONEY, 6).alias("turnover"),
        F.round(F.percentile("change", 0.5), 6).alias("median_change"),
    )


def sectors(bars: DataFrame, tickers: DataFrame, least: int = 3, day: str | None = None) -> DataFrame:
    """Average change by industry with enough tickers, best first; unknown industries are out."""
    joined = day_changes(bars, day).filter("change is not null").join(F.broadcast(tickers.select("ticker", "industry")), "ticker").filter("industry is not null")
    agg = joined.groupBy("industry").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("change"), 6).alias("avg_change"), F.count_if(F.col("change") > 0).alias("up"))
    return agg.filter(F.col("n") >= least).orderBy(F.desc("avg_change"), "industry")


def average_turnover(bars: DataFrame, rows: int = 20, days: int = 40) -> DataFrame:
    """Mean of the last `rows` daily turnovers within `days` calendar days."""
    daily = _slice(bars, days).groupBy("date").agg(F.sum(F.col("close") * F.col("volume")).alias("t"))
    return daily.orderBy(F.desc("date")).limit(rows).agg(F.round(F.avg("t") / MONEY, 6).alias("avg_turnover"), F.count(F.lit(1)).alias("days"))


def top_turnover(bars: DataFrame, tickers: DataFrame, n: int = 12, day: str | None = None) -> DataFrame:
    """The n largest turnovers; a ticker without a name is shown by its code."""
    d = day_changes(bars, day).filter((F.col("volume") > 0) & (F.col("close") > 0) & F.col("prev").isNotNull())
    named = d.join(F.broadcast(tickers.select("ticker", "name")), "ticker", "left")
    turnover = F.round(F.col("close") * F.col("volume") / MONEY, 9)
    return named.select("ticker", F.coalesce("name", "ticker").alias("name"), turnover.alias("turnover"), F.round("change", 6).alias("change")).orderBy(F.desc("turnover"), "ticker").limit(n)


def index_changes(index_daily: DataFrame) -> DataFrame:
    """Day-over-day percentage change; the first day of an index has none."""
    w = Window.partitionBy("index_code").orderBy("date")
    prev = index_daily.withColumn("_p", F.lag("close").over(w))
    return prev.withColumn("change_pct", F.round((F.try_divide(F.col("close"), F.expr("nullif(_p, 0D)")) - 1) * 100, 6)).drop("_p")


def last_rows(index_daily: DataFrame, n: int = 21) -> DataFrame:
    w = Window.partitionBy("index_code").orderBy(F.desc("date"))
    return index_daily.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def index_overview(index_daily: DataFrame) -> DataFrame:
    """Per index, its latest day: close, 5- and 20-row returns (0 if short) and 20-value series."""
    w = Window.partitionBy("index_code").orderBy("date")
    back = lambda k: F.coalesce(F.try_divide(F.col("close"), F.lag("close", k).over(w)) - 1, F.lit(0.0))
    rows = last_rows(index_changes(index_daily), 21).withColumn("r5", back(5)).withColumn("r20", back(20))
    out = rows.groupBy("index_code").agg(
        F.max("date").alias("as_of"), F.round(F.max_by("close", "date"), 6).alias("close"), F.max_by("change_pct", "date").alias("change_1d"),
        F.round(F.max_by("r5", "date"), 6).alias("change_5d"), F.round(F.max_by("r20", "date"), 6).alias("change_20d"),
        F.collect_list(F.struct("date", F.round("close", 4).alias("value"))).alias("_s"),
    )
    tail = F.slice(F.sort_array("_s"), F.greatest(F.size("_s") - 19, F.lit(1)), 20)
    return out.withColumn("series", F.array_join(F.transform(tail, lambda x: F.concat_ws("=", x["date"].cast("string"), F.format_number(x["value"], 2))), ";")).drop("_s")


def freshness(as_of: Column, today: Column) -> Column:
    gap = F.date_diff(today, as_of)
    return F.when(gap <= 4, "ready").when(gap <= 10, "stale").otherwise("unavailable")


def session_state(now: Column, zone: Column) -> Column:
    """closed at weekends and outside hours, preopen from 7, open from 9 to 16 local time."""
    local = F.from_utc_timestamp(now, zone)
    hour = F.hour(local)
    return F.when(F.weekday(local) >= 5, "closed").when((hour >= 9) & (hour < 16), "open").when((hour >= 7) & (hour < 9), "preopen").otherwise("closed")


def sparkline(index_daily: DataFrame) -> DataFrame:
    """Closes scaled to 0..1 per index; a range under 0.001 counts as 0.001."""
    w = Window.partitionBy("index_code")
    low, high = F.min("close").over(w), F.max("close").over(w)
    return index_daily.withColumn("scaled", F.round((F.col("close") - low) / F.greatest(high - low, F.lit(0.001)), 6))
