from tidemark.operators import tagging
from tidemark.sources import markup


def test_longest_names_mask_shorter_ones(spark):
    tickers = spark.createDataFrame([("1", "台積"), ("2", "台積電"), ("3", "國泰金"), ("4", "same"), ("5", "same"), ("2330", None), ("6", "電子")], "ticker string, name string")
    a = spark.createDataFrame([(1, "台積電 電子"), (2, "台積 (2330) (9999)"), (3, None), (4, "same 台積電子"), (5, "")], "id long, title string")
    got = {r["id"]: r["related_tickers"] for r in tagging.tag(a, tickers).collect()}
    assert got == {1: ["2", "6"], 2: ["1", "2330"], 3: [], 4: ["2"], 5: []}


def test_verified_tickers(spark):
    tickers = spark.createDataFrame([("2886", "兆豐金"), ("2330", "台積電")], "ticker string, name string")
    e = spark.createDataFrame([("a", ["2886", "2330", "2886", "002594", "X.Y", "1111"]), ("b", None)], "event_id string, tickers array<string>")
    c = spark.createDataFrame([("a", "兆豐銀 與 1111 說"), ("b", "")], "event_id string, corpus string")
    assert {r["event_id"]: r["tickers"] for r in tagging.verified(e, tickers, c).collect()} == {"a": ["2886", "1111"], "b": []}


def test_stop_list(spark):
    tickers = spark.createDataFrame([("11", "word"), ("12", "name")], "ticker string, name string")
    a = spark.createDataFrame([(f"word {i}", "x") for i in range(30, 40)] + [("name 12", None)] * 12, "title string, content string")
    assert [(r["name"], r["fires"]) for r in tagging.stop_list(a, tickers, 10, 0.5).collect()] == [("word", 10)]


def test_links_and_items(spark):
    html = '<link rel="canonical" href="/c"><link rel="alternate" type="application/rss+xml" href="f" title="T"><a href="x">A <b>b</b></a><a>no</a><a href="y"></a>'
    p = spark.createDataFrame([(html, "http://h/d/"), (None, None)], "html string, url string")
    one, two = [r["evidence"] for r in markup.page_links(p).collect()]
    assert (one["canonical"], [tuple(x) for x in one["links"]], [tuple(x) for x in one["feeds"]]) == ("http://h/c", [("http://h/d/x", "A b")], [("http://h/d/f", "T")])
    assert two["links"] == []
    xml = '<rss><channel><item><title>t</title><link>http://a</link><pubDate>p</pubDate><guid>g</guid></item><item><title>x</title></item></channel></rss>'
    f = spark.createDataFrame([(xml,), ("<broken",), (None,)], "xml string")
    assert [[(i["title"], i["url"], i["published_at"], i["source_record_id"]) for i in r["items"]] for r in markup.feed_items(f).collect()] == [[("t", "http://a", "p", "g")], [], []]
