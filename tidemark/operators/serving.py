"""Reads over events: rankings, search, timelines, reactions, catalogue aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renderable() -> Column:
    return F.col("title").isNotNull() & F.col("categories").isNotNull() & F.col("stars").isNotNull()


def ranking() -> list[Column]:
    """Stars, then validation with unknown last, then event time with unknown first; then the id."""
    return [F.desc_nulls_first("stars"), F.desc_nulls_last("market_validation"), F.desc_nulls_first("occurred"), F.asc("event_id")]


def page(entities: DataFrame, category: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    out = entities.filter(renderable())
    if category is not None:
        out = out.filter(F.array_contains("categories", category))
    return out.orderBy(*ranking()).offset(min(offset, 10_000)).limit(min(limit, 100))


def by_ticker(entities: DataFrame, ticker: str) -> DataFrame:
    return entities.filter(renderable() & F.array_contains("tickers", ticker))


def overlapping(entities: DataFrame, categories: Sequence[str]) -> DataFrame:
    return entities.filter(renderable() & F.arrays_overlap("categories", F.array(*map(F.lit, categories))))


def search_tickers(tickers: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """Names that hold the text in any case, or codes that begin with it; those codes first."""
    q = text.strip().lower()
    starts = F.startswith(F.lower("ticker"), F.lit(q))
    return tickers.filter(F.contains(F.lower("name"), F.lit(q)) | starts).orderBy(starts.desc(), "ticker").limit(limit)


def named_tickers(entities: DataFrame, tickers: DataFrame) -> DataFrame:
    """event_id and its tickers with their names, in their order."""
    placed = entities.select("event_id", F.posexplode_outer("tickers").alias("pos", "ticker"))
    joined = placed.join(F.broadcast(tickers.select("ticker", "name")), "ticker", "left")
    pair = F.when(F.col("pos").isNotNull(), F.struct("pos", "ticker", "name"))
    ordered = joined.groupBy("event_id").agg(F.sort_array(F.collect_list(pair)).alias("p"))
    return ordered.select("event_id", F.transform("p", lambda x: F.struct(x["ticker"].alias("ticker"), x["name"].alias("name"))).alias("tickers"))


def members(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """event_id and its articles in time order, with source type and time filled in."""
    rows = entities.select("event_id", "occurred").join(articles.select("event_id", "article_id", "source", "source_type", "published"), "event_id", "left").filter("article_id is not null")
    item = F.struct(F.coalesce("published", "occurred").alias("at"), F.col("article_id"), F.col("source"), F.coalesce("source_type", F.lit("media")).alias("source_type"))
    return rows.groupBy("event_id").agg(F.sort_array(F.collect_list(item)).alias("members"))


def search(entities: DataFrame, tickers: DataFrame, text: str) -> DataFrame:
    """Events with a matching title, or a ticker whose code or name matches."""
    q = text.strip().lower()
    names = tickers.filter(F.contains(F.lower("name"), F.lit(q)) | F.contains(F.lower("ticker"), F.lit(q))).select("ticker")
    by_name = entities.select("event_id", F.explode("tickers").alias("ticker")).join(F.broadcast(names), "ticker", "left_semi").select("event_id")
    hit = by_name.unionByName(entities.filter(F.contains(F.lower("title"), F.lit(q))).select("event_id")).distinct()
    return entities.filter(renderable()).join(hit, "event_id", "left_semi").orderBy(*ranking())


def timeline(entities: DataFrame, days: int = 60, n: int = 6, most: int = 20) -> DataFrame:
    """For every event with a ticker and a category: the up to n latest events up to its time, of
    the `days` before, that have its first ticker and one of its categories. It is one of them.

    Events of over `most` tickers are of the whole market and stand in their own timeline alone, as
    those without a time do. Events are numbered by ticker and category in order of time, and an
    anchor looks up its n last numbers for each category: no two events are paired for a key alone.
    """
    ready = entities.filter(renderable())
    told = ready.filter(F.get("tickers", F.lit(0)).isNotNull() & (F.size("categories") > 0))
    current = told.select(F.col("event_id").alias("anchor_id"), "event_id", "occurred")
    listed = ready.filter(F.col("occurred").isNotNull() & (F.size("tickers") <= most)).select("event_id", "occurred", "categories", F.explode(F.array_distinct("tickers")).alias("t"))
    listed = listed.withColumn("c", F.explode(F.array_distinct("categories"))).select(F.struct("t", "c").alias("ticker"), F.struct("occurred", "event_id").alias("date"))
    asked = told.filter("occurred is not null").select("event_id", "occurred", F.get("tickers", F.lit(0)).alias("t"), F.explode(F.array_distinct("categories")).alias("c"))
    last = F.lit(chr(0x10FFFF)).alias("event_id")  # behind all ids of the same time
    rows, placed = _numbered(listed, asked.select(F.struct("t", "c").alias("ticker"), F.struct("occurred", last).alias("day"), F.col("event_id").alias("anchor_id")), True)
    wanted = placed.withColumn("_n", F.explode(F.sequence(F.col("_at") - n + 1, F.col("_at"))))
    found = wanted.join(rows, ["ticker", "_n"]).filter(F.col("date.occurred") >= F.col("day.occurred") - days * 86400).select("anchor_id", "date.event_id", "date.occurred")
    order = Window.partitionBy("anchor_id").orderBy(F.desc_nulls_last("occurred"), F.desc("is_current"), F.desc("event_id"))
    both = found.unionByName(current).distinct().withColumn("is_current", F.col("event_id") == F.col("anchor_id"))
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select("anchor_id", "event_id", "occurred", "is_current")


def _numbered(bars: DataFrame, anchors: DataFrame, same_day: bool) -> tuple[DataFrame, DataFrame]:
    """Bars with `_n`, their number in their ticker's order of dates, and anchors with `_at`, the
    number of bars before their day, or up to it. Both are one window by ticker: no anchor meets
    a bar that it does not want."""
    rows = bars.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))
    each = anchors.select("ticker", F.col("day").alias("_day"), F.lit(None).cast("int").alias("_n"), F.struct(*anchors.columns).alias("_a"))
    marks = rows.select("ticker", F.col("date").alias("_day"), "_n", F.lit(None).cast(each.schema["_a"].dataType).alias("_a"))
    order = Window.partitionBy("ticker").orderBy("_day", F.col("_a").isNotNull() if same_day else F.col("_a").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = marks.unionByName(each).withColumn("_at", F.coalesce(F.last("_n", True).over(order), F.lit(0))).filter("_a is not null")
    return rows, placed.select("_a.*", "_at")


def around(bars: DataFrame, anchors: DataFrame, before: int = 6, after: int = 5) -> DataFrame:
    """(id, date, close, place): the last bars up to an anchor's day and the first ones after it.

    place counts from 0 at the anchor bar. anchors: id, ticker, day; bars: one a ticker and date.
    An equality join on ticker and number: an anchor looks up before + after bars.
    """
    rows, placed = _numbered(bars.select("ticker", "date", "close"), anchors.select("id", "ticker", "day"), True)
    wanted = placed.withColumn("_n", F.explode(F.sequence(F.col("_at") - before + 1, F.col("_at") + after)))
    return wanted.join(rows, ["ticker", "_n"]).select("id", "date", "close", (F.col("_n") - F.col("_at")).alias("place"))


def first_on_or_after(bars: DataFrame, anchors: DataFrame, rows: int = 6) -> DataFrame:
    """Bars of an anchor from its first trading day on or after `day`, with a positive close;
    n counts them from 1. Anchors without such a bar have no row."""
    numbered, placed = _numbered(bars.filter("close > 0"), anchors, False)
    wanted = placed.withColumn("_n", F.explode(F.sequence(F.col("_at") + 1, F.col("_at") + rows)))
    return wanted.join(numbered, ["ticker", "_n"]).withColumn("n", F.col("_n") - F.col("_at")).drop("_n", "_at")


def catalogue_days(entities: DataFrame, n: int = 30) -> DataFrame:
    day = F.to_date(F.timestamp_seconds("occurred"))
    return entities.filter(renderable()).select(day.alias("day")).filter("day is not null").distinct().orderBy(F.desc("day")).limit(n)


def categories_seen(entities: DataFrame) -> DataFrame:
    """Categories by first appearance in the ranking, behind one that stands for all."""
    place = F.row_number().over(Window.orderBy(*ranking()))
    ranked = entities.filter(renderable()).withColumn("_r", place)
    seen = ranked.select("_r", F.posexplode("categories").alias("p", "category")).groupBy("category").agg(F.min(F.struct("_r", "p")).alias("at"))
    every = entities.sparkSession.sql("select '全部' as category, struct(0, 0) as at")
    both = seen.select("category", F.struct(F.col("at._r").alias("r"), F.col("at.p").alias("p")).alias("at")).unionByName(every.select("category", F.struct(F.col("at.col1").alias("r"), F.col("at.col2").alias("p")).alias("at")))
    return both.withColumn("place", F.row_number().over(Window.orderBy("at")) - 1).select("category", "place")


def industry_heat(entities: DataFrame, tickers: DataFrame, top: int = 4) -> DataFrame:
    """Events and reports by industry, the rest as 'other', with its share of reports."""
    rows = entities.filter(renderable()).select("event_id", F.greatest(F.coalesce("source_count", F.lit(0)), F.lit(1)).alias("w"), F.explode("tickers").alias("ticker"))
    ind = rows.join(F.broadcast(tickers.filter("industry is not null").select("ticker", "industry")), "ticker").select("event_id", "w", "industry").distinct()
    agg = ind.groupBy("industry").agg(F.count(F.lit(1)).alias("events"), F.sum("w").alias("articles"))
    ranked = agg.withColumn("r", F.row_number().over(Window.orderBy(F.desc("articles"), "industry")))
    grouped = ranked.groupBy(F.when(F.col("r") <= top, F.col("industry")).otherwise("other").alias("industry")).agg(F.sum("events").alias("events"), F.sum("articles").alias("articles"))
    return grouped.withColumn("share_pct", F.round(100.0 * F.col("articles") / F.sum("articles").over(Window.partitionBy()), 6))
