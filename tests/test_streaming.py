import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import gates
from tidemark.sources import files, vectors
from tidemark.streaming import ingest


def test_feed_is_inserted_once_and_resumes(spark, tmp_path):
    feed, table, mark = (str(tmp_path / n) for n in ("feed", "table", "mark"))
    (tmp_path / "feed").mkdir()
    item = lambda i, **k: json.dumps({"title": f"<b>t{i}</b>", "url": f"http://x/{i}", "content": "c &amp; d", "published_at": "2026-01-02T03:04:05+08:00"} | k)
    (tmp_path / "feed" / "a.jsonl").write_text("\n".join([item(1), item(1), "{broken", item(2, content=""), item(3, published_at="who knows"), item(4)]))
    run = lambda: ingest.insert_batches(ingest.normalise(ingest.read_feed(spark, feed), "src"), table, mark).awaitTermination()
    run()
    (tmp_path / "feed" / "b.jsonl").write_text("\n".join([item(4), item(5)]))
    run()
    rows = spark.read.parquet(table).orderBy("url").collect()
    assert [r["url"] for r in rows] == ["http://x/1", "http://x/4", "http://x/5"]
    assert rows[0]["title"] == "t1" and rows[0]["content"] == "c & d"


def test_watermarked_dedupe_plans(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    a = ingest.normalise(ingest.read_feed(spark, str(tmp_path / "feed")), "s")
    assert ingest.since(a, F.lit("2026-01-01").cast("timestamp")).isStreaming


def test_json_array_keeps_rows_without_key(spark, tmp_path):
    p = tmp_path / "a.json"
    p.write_text(json.dumps([{"id": 1, "t": "a"}, {"id": 1, "t": "b"}, {"t": "c"}, {"t": "d"}]))
    got = files.read_articles(spark, str(p), "id long, t string", "id").collect()
    assert sorted(r["t"] for r in got) == ["a", "c", "d"]


def test_chart_rows(spark):
    d = spark.createDataFrame([("X", json.dumps({"timestamp": [0, 86400 - 3600], "close": [1.5, 2.5], "gmtoffset": 7200})), ("Y", json.dumps({"timestamp": [0], "close": [None]}))], "index_code string, payload string")
    assert [(r["index_code"], str(r["date"]), r["close"]) for r in files.index_rows(d).orderBy("date").collect()] == [("X", "1970-01-01", 1.5), ("X", "1970-01-02", 2.5)]


def test_load_feed_counts_warns_and_fails(spark, tmp_path):
    feed, table, mark = (str(tmp_path / n) for n in ("feed", "table", "mark"))
    (tmp_path / "feed").mkdir()
    item = lambda i, **k: json.dumps({"title": f"t{i}", "url": f"http://x/{i}", "content": "text", "published_at": "2026-01-02T03:04:05+08:00"} | k)
    load = lambda **k: ingest.load_feed(ingest.read_feed(spark, feed, max_files=1), "src", table, mark, **k)
    with pytest.raises(ingest.FeedFailed):
        load()
    assert load(may_be_empty=True) == ingest.FeedCounts(0, 0, 0)
    (tmp_path / "feed" / "a.jsonl").write_text("\n".join(item(i) for i in (1, 2, 2, 3)))
    (tmp_path / "feed" / "b.jsonl").write_text("\n".join([item(3), item(4), item(5)]))
    assert load() == ingest.FeedCounts(7, 7, 5)
    (tmp_path / "feed" / "c.jsonl").write_text("\n".join([item(5), "{broken", item(6, content=" "), item(7, published_at="who knows")]))
    with pytest.warns(UserWarning, match="33% of 3"):
        assert load() == ingest.FeedCounts(3, 1, 0)
    assert spark.read.parquet(table).count() == 5


def test_anchored_heat_equals_the_batch_also_across_a_restart(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"e{rng.randint(0, 9)}", rng.choice(["a", "b", "c", "d", "e", None]), 1_767_225_600 + rng.randint(0, 4 * 86400)) for _ in range(200)]
    rows += [("e0", "late", min(t for e, _, t in rows if e == "e0") + 86400), ("solo", None, 1_767_225_600), (None, "a", 1_767_225_600)]
    rng.shuffle(rows)
    schema = "event_id string, source string, published long"
    (tmp_path / "in").mkdir()
    got = {}

    def sink(batch, number):
        for r in batch.collect():
            got[r["event_id"]] = r

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("published_at", F.timestamp_seconds("published"))
        ingest.anchored_heat(stream, delay="10 days").writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()

    for k in range(4):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(("event_id", "source", "published"), r, strict=True))) for r in rows[k::4]))
        if k % 2:
            run()
    want = {r["event_id"]: r["heat_sources_24h"] for r in gates.heat_sources(spark.createDataFrame(rows, schema).filter("event_id is not null")).collect()}
    assert {e: r["heat_sources_24h"] for e, r in got.items()} == want and not any(r["final"] for r in got.values())
    (tmp_path / "in" / "z.json").write_text(json.dumps({"event_id": "far", "source": "a", "published": 1_767_225_600 + 30 * 86400}))
    run()
    assert all(got[e]["final"] and got[e]["heat_sources_24h"] == n for e, n in want.items()) and not got["far"]["final"]


def _cache(folder, ids, x):
    folder.mkdir()
    np.save(folder / "embeddings.npy", x)
    (folder / "meta.jsonl").write_text("\n".join(json.dumps(i) for i in ids) + "\n\n")


def test_vector_cache_is_read_by_ranges_and_skips_what_fits_nothing(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(1000, 7)).astype(np.float32)
    ids = [{"article_id": f"a{i}", "newsId": "n"} if i % 3 else {"article_id": "", "newsId": f"a{i}"} for i in range(1000)]
    ids[5] = {"other": 1}
    _cache(tmp_path / "c", ids, x)
    read = vectors.read_cache(spark, str(tmp_path / "c"), rows=128)
    assert spark.read.format("npy").option("rows", 128).load(str(tmp_path / "c" / "embeddings.npy")).rdd.getNumPartitions() == 8
    rows = read.orderBy("row").collect()
    assert [r["id"] for r in rows] == [None if i == 5 else f"a{i}" for i in range(1000)]
    assert (np.array([r["vector"] for r in rows], np.float32) == x).all()
    articles = spark.createDataFrame([("a7", "t"), ("a700", "u"), ("none", "v"), (None, "w")], "article_id string, title string")
    got = {r["article_id"]: r for r in vectors.with_vectors(articles, str(tmp_path / "c")).collect()}
    assert got.keys() == {"a7", "a700"} and got["a700"]["title"] == "u" and np.allclose(got["a700"]["vector"], x[700])


def test_vector_cache_falls_back_and_refuses(spark, tmp_path):
    x = np.ones((3, 2))
    _cache(tmp_path / "c", [{"article_id": i} for i in "abc"], x)
    _cache(tmp_path / "c_subset", [{"article_id": i} for i in "xyz"], x)
    one = lambda i: spark.createDataFrame([(i,)], "article_id string")
    with pytest.warns(UserWarning, match="_subset"):
        assert vectors.with_vectors(one("y"), str(tmp_path / "c")).first()["row"] == 1
    with pytest.raises(ValueError, match="no vector"):
        vectors.with_vectors(one("q"), str(tmp_path / "c"))
    _cache(tmp_path / "short", [{"article_id": "a"}], x)
    with pytest.raises(ValueError, match="1 lines for 3"):
        vectors.read_cache(spark, str(tmp_path / "short"))
    _cache(tmp_path / "columns", [{"article_id": i} for i in "abc"], np.asfortranarray(np.ones((3, 2))))
    with pytest.raises(ValueError, match="by rows"):
        vectors.read_cache(spark, str(tmp_path / "columns"))
    _cache(tmp_path / "none", [], np.ones((0, 2)))
    assert vectors.read_cache(spark, str(tmp_path / "none")).count() == 0
