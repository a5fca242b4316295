"""Articles to whole events: what is left out and why, groups, and one record for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import assemble, cluster, gates
from tidemark.runtime import materialize

DEFAULT_SOURCE = "鉅亨網"  # fixed value: the source of articles that name none


def checked_ids(articles: DataFrame) -> DataFrame:
    """articles, after a look at their ids: null or repeated ones are an error, as members would
    take each other's place."""
    bad = articles.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("id is null or n > 1").first()
    if bad is not None:
        raise ValueError("an article has no id" if bad["id"] is None else f"the article id {bad['id']!r} stands {bad['n']} times")
    return articles


def records(articles: DataFrame, cut: float = 0.35, gap: int = 3, span: int = 7, exclude_periodic: bool = True) -> tuple[DataFrame, DataFrame]:
    """(events, filtered): one record an event, and the articles of scheduled columns, which are in none.

    articles: id (number), vector, title, content, url, published (seconds), source,
    related_tickers (null: those in brackets in title and content; empty: none). Null or repeated
    ids raise. events: event_id, representative_title (of the member nearest to the centroid),
    source_count (different sources), members (article_id, source, title, url, has_unique_detail: the
    one with the most amounts that no other has, three at least), related_tickers in the order first
    seen, date_start, date_end; most sources first. filtered: article_id, periodic_type.
    """
    named = checked_ids(articles).withColumns({
        "title": F.coalesce("title", F.lit("")),
        "tickers": F.coalesce("related_tickers", text.bracketed_tickers(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit(""))))),
        "details": text.money_details(F.concat_ws(" ", F.coalesce("content", F.lit("")), F.coalesce("title", F.lit("")))),
        "date": F.to_date(F.timestamp_seconds("published")),
    })
    judged = gates.periodic_batch(named) if exclude_periodic else named.withColumn("periodic_type", F.lit(None).cast("string"))
    judged = materialize(judged.select("id", "vector", "title", "url", F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit(DEFAULT_SOURCE)).alias("source"), "tickers", "details", "date", "periodic_type"), "articles")
    kept = judged.filter("periodic_type is null")
    days = kept.withColumn("day", F.unix_date("date").cast("long")).withColumn("periodic", F.lit(False))
    groups = materialize(cluster.assemble_events(days.select("id", "vector", "day", "tickers", "periodic"), cut, gap, span), "groups")
    members = groups.join(kept, "id")
    first = cluster.representatives(members.select("event", "id", cluster.normalised(F.col("vector").cast("array<double>")).alias("vector"))).select("event", F.col("id").alias("_first"))
    most = cluster.unique_details(members.select("event", "id", "details")).select("event", F.col("id").alias("_most"))
    marked = members.join(first, "event").join(most, "event", "left")
    placed = marked.select(
        "event", F.col("id").alias("place"), F.col("id").alias("article_id"), "source", "title", "url", "tickers", F.col("date").alias("day"),
        F.coalesce(F.col("id") == F.col("_most"), F.lit(False)).alias("unique"), F.when(F.col("id") == F.col("_first"), F.col("title")).alias("_title"),
    )
    objects = assemble.event_objects(placed)
    heads = placed.groupBy("event").agg(F.max("_title").alias("representative_title"), F.collect_set(F.when(F.col("unique"), F.col("article_id"))).alias("_u"))
    whole = objects.join(heads, "event")
    listed = F.transform("members", lambda m: F.struct(m["article_id"].alias("article_id"), m["source"].alias("source"), m["title"].alias("title"), m["url"].alias("url"), F.array_contains("_u", m["article_id"]).alias("has_unique_detail")))
    events = whole.select("event_id", "representative_title", "source_count", listed.alias("members"), "related_tickers", "date_start", "date_end")
    return events.orderBy(*assemble.by_sources()), judged.filter("periodic_type is not null").select(F.col("id").alias("article_id"), "periodic_type")


def memberships(events: DataFrame) -> DataFrame:
    """(article_id, event_id) of all members; for tables that keep articles' events."""
    return events.select("event_id", F.explode("members.article_id").alias("article_id")).select("article_id", "event_id")

