"""Feeds as streams: validated, de-duplicated, inserted once; attachment and expiry by batch."""

from __future__ import annotations

import json
import threading
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import dates, text
from tidemark.operators import cluster, merge
from tidemark.runtime import materialize, scratch

ITEM = "title string, url string, content string, published_at string, source_record_id string"


def read_feed(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    """Lines of JSON files as items; what is no JSON object is dropped. The stream's checkpoint
    remembers what was read, so a restart goes on behind it."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(folder)
    return lines.select(F.from_json("value", ITEM, {"mode": "PERMISSIVE"}).alias("i")).select("i.*").filter("coalesce(title, url, content) is not null")


def normalise(items: DataFrame, source: str, now: Column | None = None) -> DataFrame:
    """Items with content and a readable time as articles; ids follow the record id, else the url."""
    return _marked(items, source, now).filter("valid").drop("valid")


def _marked(items: DataFrame, source: str, now: Column | None = None) -> DataFrame:
    """All items as articles, and whether each is valid."""
    at = dates.parse(F.col("published_at"), F.current_timestamp() if now is None else now)
    identity = F.coalesce(F.nullif(F.trim("source_record_id"), F.lit("")), F.col("url"))
    valid = (F.trim(F.coalesce("content", F.lit(""))) != "") & identity.isNotNull() & at.isNotNull()
    return items.select(
        text.article_id(F.lit(source), identity).alias("article_id"), F.lit(source).alias("source"), text.clean_html(F.col("title")).alias("title"), text.clean_html(F.col("content")).alias("content"), "url", at.alias("published_at"), valid.alias("valid")
    )


def since(articles: DataFrame, bound: Column, delay: str = "2 days") -> DataFrame:
    """Articles from a lower bound on, each id once within the watermark."""
    return articles.filter(F.col("published_at") >= bound).withWatermark("published_at", delay).dropDuplicatesWithinWatermark(["article_id"])


def insert_batches(articles: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's new articles to the table in `folder`: first write wins, so a batch
    that is replayed adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        _new(batch, folder, number).write.mode("append").parquet(folder)

    return articles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _new(batch: DataFrame, folder: str, number: int) -> DataFrame:
    """The batch's articles that the table in `folder` does not hold, each once."""
    fresh = batch.dropDuplicates(["article_id"])
    if number or _exists(batch.sparkSession, folder):
        old = batch.sparkSession.read.schema(batch.schema).parquet(folder).select("article_id")
        fresh = fresh.join(old, "article_id", "left_anti")
    return fresh


class FeedFailed(RuntimeError):
    """A run that read nothing from a source that always has something."""


@dataclass
class FeedCounts:
    fetched: int = 0
    valid: int = 0
    inserted: int = 0


class _Watch(StreamingQueryListener):
    """Adds up what a feed's batches observe; progress of other queries is not counted."""

    def __init__(self, name: str, counts: FeedCounts) -> None:
        self.name, self.counts, self.over = name, counts, threading.Event()
        self.query: str | None = None

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.query = str(event.runId)

    def onQueryProgress(self, event) -> None:
        seen = event.progress.observedMetrics.get("feed") if event.progress.name == self.name else None
        if seen is not None:
            self.counts.fetched += seen["fetched"]
            self.counts.valid += seen["valid"]

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.query:
            self.over.set()


def load_feed(items: DataFrame, source: str, folder: str, checkpoint: str, may_be_empty: bool = False, least: float = 0.8, wait: float = 60.0) -> FeedCounts:
    """Insert a feed's new articles into the table in `folder`, as insert_batches does, and count.

    Counts are of this run. A failed batch raises, and so does a run without any item, unless the
    source may be empty (a bank has days without news). Where under `least` of the items are
    valid there is a warning. Nothing inserted is no failure: a run that is repeated finds all there.
    """
    spark, counts, name = items.sparkSession, FeedCounts(), f"feed {source} {checkpoint}"
    watch = _Watch(name, counts)
    marked = _marked(items, source).observe("feed", F.count(F.lit(1)).alias("fetched"), F.count_if("valid").alias("valid"))

    def write(batch: DataFrame, number: int) -> None:
        # The batch is read once, so that it is counted once.
        with scratch():
            fresh = materialize(_new(batch.filter("valid").drop("valid"), folder, number), "feed")
            fresh.write.mode("append").parquet(folder)
            counts.inserted += fresh.count()

    spark.streams.addListener(watch)
    try:
        query = marked.writeStream.queryName(name).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        if not watch.over.wait(wait):
            raise TimeoutError(f"{source}: the counts of the run did not arrive")
    finally:
        spark.streams.removeListener(watch)
    if not counts.fetched and not may_be_empty:
        raise FeedFailed(f"{source}: no items at all; its pages changed or it was refused")
    if counts.fetched and counts.valid < least * counts.fetched:
        warnings.warn(f"{source}: only {counts.valid / counts.fetched:.0%} of {counts.fetched} items are valid", stacklevel=2)
    return counts


def _exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def attach_batches(articles: DataFrame, targets: Callable[[], DataFrame], sink: Callable[[DataFrame], None], checkpoint: str, farthest: float = 0.35, days: int = 3) -> StreamingQuery:
    """Attach each batch's articles (id, vector, day) to the nearest known event, or to none."""

    def attach(batch: DataFrame, number: int) -> None:
        sink(cluster.nearest(batch, targets(), farthest, days))

    return articles.writeStream.foreachBatch(attach).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def heat(articles: DataFrame, hours: int = 24, delay: str = "2 days") -> DataFrame:
    """Different sources by event in windows of `hours`, for streams: approximate only in that a
    window starts on the clock and not at the event's first article."""
    window = F.window("published_at", f"{hours} hours")
    return articles.withWatermark("published_at", delay).groupBy(window, "event_id").agg(F.size(F.collect_set("source")).alias("sources"))


ANCHORED = "event_id string, first_at timestamp, heat_sources_24h long, final boolean"


def anchored_heat(articles: DataFrame, hours: int = 24, delay: str = "2 days", keep_days: int = 60) -> DataFrame:
    """Different sources within `hours` of each event's first article, as a stream.

    articles: event_id, source, published_at; a row without event or time is left out, one without
    a source only moves the window. In update mode an event has a row whenever its count or its
    first article changes, and a last one, final, once the watermark is past its window: the
    newest row of an event is what gates.heat_sources finds. Articles later than the watermark
    are dropped by it. An event is remembered for keep_days behind its window, so that later
    articles open none anew. State: the earliest time of each source inside the window.
    """
    width, keep = hours * 3_600_000_000, keep_days * 86_400_000_000

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, told, closed, sources = (*state.get[:3], json.loads(state.get[3])) if state.exists else (None, -1, False, {})

        def row(final: bool) -> pd.DataFrame:
            return pd.DataFrame({"event_id": [key[0]], "first_at": [pd.Timestamp(first, unit="us")], "heat_sources_24h": [len(sources)], "final": [final]})

        if state.hasTimedOut:
            if closed:
                state.remove()
                return
            yield row(True)
            state.update((first, len(sources), True, json.dumps(sources)))
            state.setTimeoutTimestamp(max((first + width + keep) // 1000, state.getCurrentWatermarkMs() + 1))
            return
        before = first
        for frame in frames:
            at = frame["published_at"].astype("datetime64[us]").astype("int64")
            first = int(at.min()) if first is None else min(first, int(at.min()))
            for source, earliest in at.groupby(frame["source"]).min().items():
                sources[source] = min(int(earliest), sources.get(source, int(earliest)))
        sources = {source: at for source, at in sources.items() if at <= first + width}
        if first != before or len(sources) != told:
            yield row(closed)
        state.update((first, len(sources), closed, json.dumps(sources)))
        end = first + width + (keep if closed else 0)
        state.setTimeoutTimestamp(max(end // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    timed = articles.select("event_id", "source", "published_at").filter("event_id is not null and published_at is not null").withWatermark("published_at", delay)
    return timed.groupBy("event_id").applyInPandasWithState(step, ANCHORED, "first long, told long, closed boolean, sources string", "update", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(rows: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], key: list[str], columns: list[str], checkpoint: str, order: str) -> StreamingQuery:
    """Merge each batch into a table, the batch's last row a key, by the column order, winning."""

    def apply(batch: DataFrame, number: int) -> None:
        write(merge.upsert(read(), merge.latest(batch, key, order), key, columns))

    return rows.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
