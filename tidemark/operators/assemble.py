"""Events put together from their articles: members, tickers, days, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text


def member_tickers(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """(event_id, tickers): the tickers of an event's articles, once each, sorted; none: empty.

    articles: event_id, related_tickers.
    """
    named = articles.select("event_id", F.explode("related_tickers").alias("t")).filter("t is not null").groupBy("event_id").agg(F.sort_array(F.collect_set("t")).alias("tickers"))
    return entities.select("event_id").join(named, "event_id", "left").select("event_id", F.coalesce("tickers", F.array().cast("array<string>")).alias("tickers"))


def event_objects(grouped: DataFrame) -> DataFrame:
    """One record an event: members, tickers in the order first seen, first and last day, number
    of sources, and the id that follows from them; most sources first, then the smallest member.

    grouped: event, place (the member's order), article_id, source, title, url, tickers, day.
    """
    member = F.struct("place", "article_id", "source", "title", "url", "tickers", "day")
    events = grouped.groupBy("event").agg(F.sort_array(F.collect_list(member)).alias("m"))
    seen = F.array_distinct(F.flatten(F.transform("m", lambda x: F.coalesce(x["tickers"], F.array().cast("array<string>")))))
    days = F.filter(F.transform("m", lambda x: x["day"]), lambda d: d.isNotNull())
    out = events.select(
        "event", F.transform("m", lambda x: F.struct(x["article_id"].alias("article_id"), x["source"].alias("source"), x["title"].alias("title"), x["url"].alias("url"))).alias("members"),
        seen.alias("related_tickers"), F.array_min(days).alias("date_start"), F.array_max(days).alias("date_end"), F.size(F.array_distinct(F.transform("m", lambda x: x["source"]))).alias("source_count"),
    )
    ids = F.array_sort(F.transform("members", lambda x: x["article_id"].cast("string")))
    return out.withColumn("event_id", text.event_id(F.col("date_start"), F.col("related_tickers"), ids)).orderBy(*by_sources())


def by_sources() -> list[Column]:
    return [F.desc("source_count"), F.array_min(F.transform("members", lambda x: x["article_id"].cast("string"))).asc()]


def newest_events_first(articles: DataFrame) -> DataFrame:
    """Articles of the event with the latest article first, then by event and time."""
    latest = F.max("published").over(Window.partitionBy("event_id"))
    return articles.withColumn("latest", latest).orderBy(F.desc_nulls_last("latest"), "event_id", F.asc_nulls_last("published"), "article_id")


SORTS = {
    "date": [F.desc_nulls_last, "occurred", F.desc_nulls_last, "stars"],
    "score": [F.desc_nulls_last, "market_validation", F.desc_nulls_last, "stars"],
}


def sorted_by(events: DataFrame, kind: str) -> DataFrame:
    """Events as a reader sorts them: by date, by score; any other kind leaves their order."""
    if kind not in SORTS:
        return events
    first, a, then, b = SORTS[kind]
    return events.orderBy(first(a), then(b), "event_id")


def fetch_queue(demand: DataFrame, universe: DataFrame) -> DataFrame:
    """(ticker, priority): asked-for tickers first (0), then the rest of the universe (1)."""
    asked = demand.select("ticker").distinct()
    rest = universe.select("ticker").distinct().join(asked, "ticker", "left_anti")
    return asked.withColumn("priority", F.lit(0)).unionByName(rest.withColumn("priority", F.lit(1))).orderBy("priority", "ticker")
