"""Repairs, audits and health over events, articles and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_same_title(events: DataFrame, articles: DataFrame, days: int = 3) -> DataFrame:
    """(event_id, keeper): events of one title go to the first of them that has a summary title,
    else to the first id, if their articles lie within `days` whole days of each other.

    events: event_id, representative_title, title; articles: event_id, at (seconds). Events
    without any dated article do not merge, nor do those without a representative title.
    """
    times = articles.groupBy("event_id").agg(F.min("at").alias("_from"), F.max("at").alias("_to"))
    rows = events.filter("representative_title is not null").join(times, "event_id", "left")
    keeper = F.min(F.struct(F.col("title").isNull().alias("x"), F.col("event_id").alias("id")))["id"].alias("keeper")
    span = F.floor((F.max("_to") - F.min("_from")) / 86400).alias("span")
    groups = rows.groupBy("representative_title").agg(F.count(F.lit(1)).alias("n"), keeper, span).filter((F.col("n") > 1) & (F.col("span") <= days))
    return events.select("event_id", "representative_title").join(groups, "representative_title").select("event_id", "keeper")


def dissolve(articles: DataFrame, pattern: str, share: float = 0.8) -> DataFrame:
    """Events of which at least `share` of the articles' titles match the pattern."""
    hits = articles.groupBy("event_id").agg(F.avg(F.col("title").rlike(pattern).cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))
    return hits.filter(F.col("share") >= share).select("event_id", "n")


def rebuild_members(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """(event_id, members, source_count, added) of the events that have more articles than members.

    entities: event_id, members (structs of article_id, source, title, url, has_unique_detail);
    articles: event_id, article_id, source, title, url. A member that the articles confirm keeps
    its entry, missing ones are added and marked restored, others go. Events with nothing to add
    are not returned.
    """
    old = entities.select("event_id", F.size(F.coalesce("members", F.array())).alias("_had"), F.explode_outer("members").alias("_m"))
    known = old.select("event_id", F.col("_m.article_id").alias("article_id"), "_m").filter("article_id is not null")
    had = old.select("event_id", F.greatest("_had", F.lit(0)).alias("_had")).distinct()
    mine = articles.select("event_id", "article_id", *[F.col(c).alias(f"_{c}") for c in ("source", "title", "url")])
    rows = mine.join(had, "event_id").join(known, ["event_id", "article_id"], "left")
    fresh = F.col("_m").isNull()
    text_of = lambda c: F.when(fresh, F.coalesce(f"_{c}", F.lit(""))).otherwise(F.col(f"_m.{c}")).alias(c)
    source = F.when(fresh, F.col("_source")).otherwise(F.col("_m.source"))
    entry = F.struct("article_id", source.alias("source"), text_of("title"), text_of("url"), F.coalesce("_m.has_unique_detail", F.lit(False)).alias("has_unique_detail"), fresh.alias("restored"))
    built = rows.groupBy("event_id").agg(
        F.sort_array(F.collect_list(entry)).alias("members"), F.countDistinct(source).alias("source_count"), F.count_if(fresh).alias("added"), F.count(F.lit(1)).alias("_n"), F.max("_had").alias("_had")
    )
    return built.filter((F.col("_n") > F.col("_had")) & (F.col("added") > 0)).drop("_n", "_had")


def audit(entities: DataFrame, tickers: DataFrame, checks: dict[str, tuple[Column, float]]) -> DataFrame:
    """(name, hits, pct, alert) of each check in one pass: condition, and the percentage allowed."""
    sums = entities.agg(F.count(F.lit(1)).alias("_t"), *[F.count_if(c).alias(k) for k, (c, _) in checks.items()])
    rows = F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("hits"), F.lit(float(limit)).alias("most")) for k, (_, limit) in checks.items()])
    pct = F.coalesce(F.try_divide(F.col("x.hits") * 100.0, F.col("_t")), F.lit(0.0))
    return sums.select("_t", F.explode(rows).alias("x")).select("x.name", "x.hits", F.round(pct, 6).cast("double").alias("pct"), (pct > F.col("x.most")).alias("alert"))


def health(articles: DataFrame, entities: DataFrame, bars: DataFrame, today: str) -> DataFrame:
    """(level, name, value) of the invariants between stages; each part is one aggregation."""
    a = articles.agg(F.count_if(F.col("stage") == "pending").alias("pending"), F.count_if(F.col("stage") == "vectorized").alias("vectorized"), F.count_if(F.col("stage") == "clustered").alias("clustered"))
    e = entities.agg(F.count_if(F.col("title").isNotNull() & F.col("stars").isNull()).alias("unscored"))
    b = bars.agg(F.date_diff(F.lit(today).cast("date"), F.max("date")).cast("long").alias("stale"))
    rules = {
        "pending": lambda v: F.when(v > 800, "WARN"),
        "vectorized": lambda v: F.when(v > 0, "WARN"),
        "clustered": lambda v: F.when(v > 4000, "WARN"),
        "unscored": lambda v: F.when(v > 0, "ALARM"),
        "stale": lambda v: F.when(v > 4, "WARN"),
    }
    row = a.crossJoin(e).crossJoin(b)
    each = F.array(*[F.struct(F.coalesce(rule(F.col(k)), F.lit("OK")).alias("level"), F.lit(k).alias("name"), F.col(k).alias("value")) for k, rule in rules.items()])
    return row.select(F.explode(each).alias("x")).select("x.*")


def fake_zeros(bars: DataFrame, least: int = 3) -> DataFrame:
    """Tickers with at least `least` days on which all nets are zero though shares changed hands."""
    zero = (F.col("foreign_net") == 0) & (F.col("trust_net") == 0) & (F.col("dealer_net") == 0) & (F.col("volume") > 0)
    return bars.filter(zero).groupBy("ticker").agg(F.count(F.lit(1)).alias("days"), F.max("date").alias("last")).filter(F.col("days") >= least)


def compare_nets(bars: DataFrame, truth: DataFrame) -> DataFrame:
    """Keys whose stored nets differ from recomputed ones, nulls told apart from zero."""
    t = truth.select(F.col("stock_id").alias("ticker"), "date", *[F.col(c).alias(f"_{c}") for c in ("foreign_net", "trust_net", "dealer_net")])
    differs = F.lit(False)
    for c in ("foreign_net", "trust_net", "dealer_net"):
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return bars.join(t, ["ticker", "date"]).filter(differs).select("ticker", "date", *[(F.col(f"_{c}") - F.col(c)).alias(f"d_{c}") for c in ("foreign_net", "trust_net", "dealer_net")])
