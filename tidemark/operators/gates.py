"""Gates, guards and validators over articles and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring, text

# Fixed value: titles of routine company notices.
ROUTINE = r"(受邀參加|應邀參加).*(法人說明會|法說)|董事會召開日期|代子公司.*公告|公告本公司.*(更名|名稱變更)"
TRANSITIONS = {
    "pending": ("vectorized", "filtered"),
    "vectorized": ("clustered", "summarized", "periodic"),
    "clustered": ("summarized", "deferred"),
    "summarized": ("scored",),
}


def rejection(title: Column, content: Column, least: int = 100) -> Column:
    """Why an article stays out: no title, a scheduled column, short content; null: it is in."""
    t = F.trim(F.coalesce(title, F.lit("")))
    kind = text.periodic_type(t)
    return (
        F.when(t == "", "無標題")
        .when(kind.isNotNull(), F.concat(F.lit("週期性欄目（"), kind, F.lit("）")))
        .when(F.length(F.trim(F.coalesce(content, F.lit("")))) < least, F.lit(f"內文過短（<{least} 字）"))
    )


def prescreen(articles: DataFrame) -> DataFrame:
    """Pending articles with their rejection reason; the rest of the stages pass by."""
    return articles.filter("stage = 'pending'").withColumn("reason", rejection(F.col("title"), F.col("content")))


def periodic_batch(articles: DataFrame, min_dates: int = 4, min_count: int = 4) -> DataFrame:
    """Each article's scheduled column, by rule or because its title's template recurs by day."""
    t = articles.withColumn("_template", text.title_template(F.col("title"))).withColumn("_day", F.coalesce(F.to_date(F.timestamp_seconds("published")).cast("string"), F.lit("")))
    stats = t.groupBy("_template").agg(F.countDistinct("_day").alias("_days"), F.count(F.lit(1)).alias("_n"))
    joined = t.join(stats, "_template")
    recurs = (F.col("_days") >= min_dates) & (F.col("_n") >= min_count)
    rule = text.periodic_type(F.col("title"))
    kind = F.coalesce(rule, F.when(recurs & ~F.col("title").rlike(text.EVENTS), F.lit(text.DATA_DRIVEN)))
    return joined.withColumn("periodic_type", kind).drop("_template", "_day", "_days", "_n")


def must_send(entities: DataFrame, articles: DataFrame, budget: int | None = None, min_sources: int = 2, min_members: int = 2, heat: DataFrame | None = None) -> DataFrame:
    """Events worth a summary: not summarised, clustered, and reported twice or officially."""
    clustered = articles.filter("stage = 'clustered'").select("event_id").distinct()
    official = articles.filter("source_type in ('official', 'gov')").select(F.col("event_id").alias("_o")).distinct()
    e = entities.filter("title is null").join(clustered, "event_id", "left_semi").join(official, F.col("event_id") == F.col("_o"), "left")
    routine = F.coalesce(F.col("representative_title").rlike(ROUTINE), F.lit(True))
    many = (F.coalesce("source_count", F.lit(0)) >= min_sources) | (F.coalesce("n_members", F.lit(0)) >= min_members)
    chosen = e.filter(many | (F.col("_o").isNotNull() & ~routine)).drop("_o")
    if budget is None:
        return chosen
    score = scoring.importance(F.col("source_count"), F.col("sources") if "sources" in chosen.columns else F.array().cast("array<string>"), F.lit(None).cast("string"), F.col("tickers"), F.lit(None).cast("array<string>"), F.lit(None).cast("int"))["total"]
    return chosen.withColumn("_s", score).orderBy(F.desc("_s"), "event_id").limit(budget).drop("_s")


def expired(articles: DataFrame, entities: DataFrame, now: int, selected: DataFrame, days: int = 7) -> DataFrame:
    """Clustered articles over `days` old whose events have no summary and were not selected."""
    old = articles.filter((F.col("stage") == "clustered") & F.col("event_id").isNotNull() & (F.col("published") < now - days * 86400))
    waiting = entities.filter("title is null").select("event_id")
    return old.join(waiting, "event_id", "left_semi").join(selected.select("event_id"), "event_id", "left_anti")


def heat_sources(articles: DataFrame, hours: int = 24) -> DataFrame:
    """Different sources within `hours` of an event's first article; events without one have no row."""
    first = articles.groupBy("event_id").agg(F.min("published").alias("_first"))
    near = articles.join(first, "event_id").filter(F.col("published") <= F.col("_first") + hours * 3600)
    return near.groupBy("event_id").agg(F.countDistinct("source").alias("heat_sources_24h"))


def guard_official(entities: DataFrame, articles: DataFrame) -> DataFrame:
    """official_confirmed without an official or government article is only developing."""
    official = articles.filter("source_type in ('official', 'gov')").select(F.col("event_id").alias("_o")).distinct()
    joined = entities.join(official, F.col("event_id") == F.col("_o"), "left")
    false = (F.col("status") == "official_confirmed") & F.col("_o").isNull()
    return joined.withColumn("status", F.when(false, "developing").otherwise(F.col("status"))).drop("_o")


def item_problems(title: Column, url: Column, content: Column, published: Column, domains: list[str], least: int = 40) -> Column:
    """What is wrong with a crawled item, in fixed order; empty if nothing is."""
    from tidemark.functions import dates

    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^https?://([^/?#:]*)", 1))
    kind = dates.classify(published)["kind"]
    return F.array_compact(
        F.array(
            F.when(host == "", "bad_url").when(~text.host_allowed(host, domains), "foreign_host"),
            F.when(F.length(F.trim(F.coalesce(title, F.lit("")))) < 4, "short_title"),
            F.when(F.length(F.trim(F.coalesce(content, F.lit("")))) < least, "short_content"),
            F.when(kind.isin("missing", "unknown"), F.concat(F.lit("date_"), kind)),
        )
    )


def funnel(items: DataFrame, problems: Column) -> DataFrame:
    """One row of counts and rates over items with a problems array and a url."""
    rows = items.withColumn("_p", problems)
    return rows.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.size("_p") == 0).alias("valid"),
        F.countDistinct("url").alias("distinct_urls"),
        F.round(F.try_divide(F.count_if(F.size("_p") == 0).cast("double"), F.count(F.lit(1))), 6).alias("valid_rate"),
        F.round(F.try_divide(F.countDistinct("url").cast("double"), F.count(F.lit(1))), 6).alias("unique_rate"),
    )


def reason_counts(rows: DataFrame, reason: str = "reason") -> DataFrame:
    return rows.filter(F.col(reason).isNotNull()).groupBy(reason).agg(F.count(F.lit(1)).alias("n"))


# What block and error pages say.
BLOCK_PAGES = (
    r"\baccess denied\b", r"\brequest (?:was )?blocked\b", r"\battention required\b", r"\bverify (?:that )?you are human\b", r"\bchecking your browser\b",
    r"\bjust a moment\b", r"\benable (?:java\s*script|javascript|cookies?)\b", r"\bcloudflare\b", r"\b(?:404 not found|error 50\d|service unavailable)\b",
    "拒絕存取", "請確認您不是機器人", "請稍候", "服務暫時無法使用",
)
LEAD, LOOKED_AT = 200, 800


def block_page(items: DataFrame, by: list[str], patterns: Sequence[str] = BLOCK_PAGES) -> DataFrame:
    """A verdict for each batch of items (by its columns): block if half of them look like a block
    page in their title and the beginning of their content, or if, of three items and more, the
    beginnings of the contents are nearly all alike; else content.

    items: title, content and the columns of by. Blank contents have no beginning.
    """
    content = F.coalesce("content", F.lit(""))
    seen = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.substring(content, 1, LOOKED_AT))
    lead = F.when(text.strip(content) != "", F.substring(content, 1, LEAD))
    rows = items.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(seen.rlike("(?is)" + "|".join(patterns))).alias("hits"), F.countDistinct(lead).alias("leads"))
    ratio = F.col("hits") / F.col("n")
    alike = (F.col("n") >= 3) & (F.col("leads") > 0) & (F.col("leads") <= F.greatest(F.lit(1), F.floor(F.col("n") / 5)))
    return rows.select(*by, "n", F.when((ratio >= 0.5) | alike, "block").otherwise("content").alias("verdict"), F.round(ratio, 2).alias("block_ratio"), alike.alias("near_identical"))


def advance(articles: DataFrame, ids: DataFrame, before: str, after: str, on: str = "article_id") -> DataFrame:
    """Articles with the stage of those ids moved on, if it is `before`; others are untouched."""
    if after not in TRANSITIONS.get(before, ()):
        raise ValueError(f"no transition from {before} to {after}")
    marked = articles.join(ids.select(F.col(on).alias("_id")).distinct(), F.col(on) == F.col("_id"), "left")
    return marked.withColumn("stage", F.when(F.col("_id").isNotNull() & (F.col("stage") == before), after).otherwise(F.col("stage"))).drop("_id")
