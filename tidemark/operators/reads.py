"""Reads of whole events: details, timelines, days, reactions, and the start page's set of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import serving
from tidemark.runtime import materialize

# Days back for each keyword; an unknown keyword stands for today, all for no bound.
RANGES = {"today": 0, "week": 7, "month": 30, "all": None}


def event_day() -> Column:
    return F.to_date(F.timestamp_seconds("occurred"))


def in_range(entities: DataFrame, ticker: str, keyword: str, today: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A ticker's events of a range of days that ends today, ranked, as a page."""
    rows = serving.by_ticker(entities, ticker)
    days = RANGES.get(keyword, RANGES["today"])
    now = F.lit(today).cast("date")
    if days == 0:
        rows = rows.filter(event_day() == now)
    elif days is not None:
        rows = rows.filter(event_day() >= F.date_sub(now, days))
    return rows.orderBy(*serving.ranking()).offset(min(offset, 10_000)).limit(min(limit, 100))


def details(entities: DataFrame, articles: DataFrame, tickers: DataFrame) -> DataFrame:
    """Renderable events with named tickers, their articles in time order and the addresses."""
    ready = entities.filter(serving.renderable())
    named = serving.named_tickers(ready, tickers).withColumnRenamed("tickers", "named")
    addresses = articles.filter("url is not null").groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("published", "article_id", "url"))).alias("u"))
    addresses = addresses.select("event_id", F.transform("u", lambda x: x["url"]).alias("urls"))
    out = ready.join(named, "event_id", "left").join(serving.members(ready, articles), "event_id", "left").join(addresses, "event_id", "left")
    return out.withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))


ORDERED = 2**19  # rows, at most about, of a task that sorts timelines


def timelines_of(entities: DataFrame, asked: DataFrame) -> DataFrame:
    """(anchor_id, date, title, event_id, is_current) for the events asked for (event_id): all
    events of their first ticker that share a category with them, without a bound in time.

    Sorting is by anchor_id, occurred. An event without tickers or categories has no timeline.
    There are as many rows as events times their anchors, so the tasks that sort are as many as the
    pairs of one ticker need.
    """
    base = entities.join(asked.select("event_id").distinct(), "event_id", "left_semi")
    base = base.select(F.col("event_id").alias("anchor_id"), F.get("tickers", F.lit(0)).alias("ticker"), F.col("categories").alias("_mine")).filter("ticker is not null and size(_mine) > 0")
    base = materialize(base, "anchors")
    ready = entities.filter(serving.renderable()).select("event_id", "title", "occurred", "categories", F.explode(F.array_distinct("tickers")).alias("ticker"))
    ready = materialize(ready, "ready")
    many = lambda rows, name: rows.groupBy("ticker").agg(F.count(F.lit(1)).alias(name))
    pairs = many(base, "a").join(many(ready, "b"), "ticker").agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
    met = ready.join(base, "ticker").filter(F.arrays_overlap("categories", "_mine"))
    out = met.select("anchor_id", event_day().alias("date"), "title", "event_id", (F.col("event_id") == F.col("anchor_id")).alias("is_current"), "occurred")
    order = ("anchor_id", "occurred", "event_id")
    return out.repartitionByRange(max(1, -(-pairs // ORDERED)), *order).sortWithinPartitions(*order)


def events_of(entities: DataFrame, day: str, limit: int = 300) -> DataFrame:
    """A day's events, ranked."""
    return entities.filter(serving.renderable() & (event_day() == F.lit(day).cast("date"))).orderBy(*serving.ranking()).limit(limit)


def reactions(bars: DataFrame, anchors: DataFrame) -> DataFrame:
    """(id, ticker, event_index, as_of, the anchor bar's returns and ratios, series) of anchors
    (id, ticker, day).

    The anchor bar is the last one up to the day; without one, or with a close of 0 or none,
    there is no reaction. Unknown ratios are 1, unknown nets and runs 0; unknown returns stay.
    """
    around = serving.around(bars, anchors).select("id", F.col("date").alias("_date"), "place")
    rows = around.join(anchors, "id").join(bars, "ticker").filter(F.col("date") == F.col("_date"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    ratio = F.coalesce("volume_ratio_vs_avg20", F.lit(1.0)).alias("volume_ratio")
    bar = F.struct("date", F.round(F.coalesce("close", F.lit(0.0)), 2).alias("close"), ratio, *map(zero, ("foreign_net", "trust_net", "dealer_net")))
    at = lambda c: F.max(F.when(F.col("place") == 0, c))
    out = rows.groupBy("id", "ticker").agg(
        F.count_if(F.col("place") < 0).cast("int").alias("event_index"), F.max("date").alias("as_of"), at(F.col("close")).alias("_close"),
        *[at(F.col(c)).alias(c) for c in ("return_1d", "return_3d", "return_5d")], at(ratio).alias("volume_ratio"),
        at(F.coalesce("foreign_consecutive_days", F.lit(0))).alias("foreign_consecutive_days"), F.sort_array(F.collect_list(bar)).alias("series"),
    )
    return out.filter("_close is not null and _close <> 0").drop("_close")


def hydrated(events: DataFrame, entities: DataFrame, articles: DataFrame, tickers: DataFrame, bars: DataFrame) -> DataFrame:
    """Some renderable events with details, their last timeline entries and the market's reaction."""
    full = details(events, articles, tickers)
    lines = serving.timeline(entities).join(events.select(F.col("event_id").alias("anchor_id")), "anchor_id", "left_semi")
    lines = lines.groupBy(F.col("anchor_id").alias("event_id")).agg(F.sort_array(F.collect_list(F.struct("occurred", F.col("event_id").alias("id"), "is_current"))).alias("timeline"))
    anchors = events.select(F.col("event_id").alias("id"), F.get("tickers", F.lit(0)).alias("ticker"), event_day().alias("day")).filter("ticker is not null and day is not null")
    moved = reactions(bars, anchors).select(F.col("id").alias("event_id"), F.struct("ticker", "event_index", "as_of", "return_1d", "return_3d", "return_5d", "volume_ratio", "foreign_consecutive_days", "series").alias("reaction"))
    return full.join(lines, "event_id", "left").join(moved, "event_id", "left")


def start_page(entities: DataFrame, articles: DataFrame, tickers: DataFrame, bars: DataFrame, days: int = 2, limit: int = 12) -> DataFrame:
    """The ranked events of the latest days that have any, hydrated, with their rank."""
    latest = serving.catalogue_days(entities, days)
    events = entities.filter(serving.renderable()).withColumn("_day", event_day()).join(F.broadcast(latest.select(F.col("day").alias("_day"))), "_day", "left_semi").drop("_day")
    return hydrated(events.orderBy(*serving.ranking()).limit(limit), entities, articles, tickers, bars)
