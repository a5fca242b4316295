"""Text rules and page evidence against plain Python on hard strings."""

import hashlib
import html
import re
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.sources import markup

HARD = [
    "台積電　營收&nbsp;&eacute;&hellip;<b>成長</b> ", "&amp;lt;b&amp;gt; &#39;x&#x27; &copy 2", "\t a \x1f", "", "<p>一</p> <p>二", "&unknown; & &#0; &#x110000;", "a\x1c\x1db​c", " x\x85",
]


def _column(spark, rows, fn):
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r["o"] for r in d.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()]


def test_clean_html_knows_all_references_and_spaces(spark):
    clean = lambda s: " ".join(re.sub(r"<[^>]+>", " ", html.unescape(s)).split())
    assert _column(spark, HARD, text.clean_html) == [clean(s) for s in HARD]
    assert _column(spark, HARD, text.clean_html_legacy) == [html.unescape(re.sub(r"<[^>]+>", "", s)).strip() for s in HARD]
    assert _column(spark, HARD, text.clean_html_twice) == [clean(html.unescape(s)) for s in HARD]
    assert _column(spark, [None], text.clean_html) == [""]


def test_article_ids_strip_all_white_space(spark):
    want = ["n_" + hashlib.sha256(s.strip().encode()).hexdigest()[:16] for s in HARD]
    assert _column(spark, HARD, lambda c: text.article_id(F.lit("n"), c)) == want


URLS = [
    "HTTPS://User:pw@News.Example.com:443/a/b/?ID=2&utm=x&cat=1#top", "http://example.com:80", "http://Example.com:8080/x//?b=1&a=2", "not a url ", "　https://a.b/c?id=1&id=0&cat=", "https://a.b/c?id=a+b%2Fc&cat=%E4%B8%AD~*",
    "https://a.b:x/c/?id=1", "//h.i/p/", "https://a.b:0/c", "https://a.b:70000/c", "https://a.b:99999999999999/c", "mailto:x@y", "https://a.b?id", "https://a.b/?&&id=1=2", "http://a.b:443/", "x:", "", "https://a.b/中/?cat=中",
]


@pytest.mark.parametrize("keep", [(), ("id", "cat")])
def test_canonical_urls(spark, keep):
    found = _column(spark, URLS, lambda c: text.canonical_url(c, keep))
    assert _column(spark, found, lambda c: text.canonical_url(c, keep)) == found
    for out in set(found) - {u.strip() for u in URLS}:  # what cannot be read stays as it is
        names = [pair.partition("=")[0] for pair in out.partition("?")[2].split("&") if pair]
        assert "#" not in out and names == sorted(names) and set(names) <= set(keep)


def test_canonical_urls_are_spelt_as_written_here(spark):
    expected = {
        "HTTP://Example.COM:80/a/?utm=1#f": "http://example.com/a",
        "https://h.example:8443/x//": "https://h.example:8443/x",
        "https://h.example:443/": "https://h.example",
        "  https://h.example/p ": "https://h.example/p",
        "https://h.example/a?B=2&c=3&a=1": "https://h.example/a?a=1&b=2",
        "https://h.example/a?a=x+y&b=": "https://h.example/a?a=x+y&b=",
        "https://h.example:bad/x/": "https://h.example:bad/x/",
    }
    assert _column(spark, list(expected), lambda c: text.canonical_url(c, ("a", "b"))) == list(expected.values())


def test_clip_ends_at_paragraphs_then_sentences(spark):
    """Of 40 characters at most: up to a paragraph's or else a sentence's end behind the 28th, else cut."""
    expected = {
        "第一段。\n\n" + "字" * 30 + "\n\n" + "尾" * 30: "第一段。\n\n" + "字" * 30,
        "字" * 34 + "。" + "尾" * 20: "字" * 34 + "。",
        "字" * 40 + "？" + "尾": "字" * 40 + "？",
        "字" * 39 + " 　" + "尾" * 9: "字" * 39,
        "a. " * 30: "a. " * 13 + "a",
        "short \n": "short \n",
        "字" * 10 + "！" + "尾" * 40: "字" * 10 + "！" + "尾" * 29,
        "x" * 40 + "\n\n" + "y": "x" * 40,
        "x" * 39 + "\n\n" + "y": "x" * 39,
        "": "",
    }
    assert _column(spark, list(expected), lambda c: text.clip(c, 40)) == list(expected.values())


def test_paragraphs(spark):
    got = _column(spark, ["延伸閱讀：其他\n本文　第一段\n相關新聞\n本文 第一段\n字\n更多新聞 x\nRelated: stays\n\n  two  words ", None], text.paragraphs)
    assert got == ["本文 第一段\n\nRelated: stays\n\ntwo words", ""]


def test_addresses_are_resolved(spark):
    bases = ["http://h.example/a/b/c?q=1#f", "https://h.example", "http://h.example/a/", "", "http://h.example/a/b?x=/y"]
    refs = ["x", "./x", "../x", "../../../x", "/r/./s/../t", "?q=2", "#g", "//other/p", "https://o/p/../q", "mailto:a@b", "x/y?z=../w", "..", ".", "g/", "./g/."]
    d = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    got = {(x["b"], x["r"]): x["o"] for x in d.select("b", "r", markup.resolved(F.col("b"), F.col("r")).alias("o")).collect()}
    for b in (bases[0], bases[1], bases[2], bases[4]):
        for r in refs:
            assert got[b, r] == urljoin(b, r), (b, r)
    assert got["", "x"] == "x" and got["", "/r/./s/../t"] == "/r/t"


def test_links_of_untidy_pages(spark):
    page = """<!-- <a href="/hidden">hidden</a> --><script>var a = '<a href="/code">code</a>';</script>
    <LINK REL="Canonical" HREF='/one'><link rel=canonical href=/two><link rel="alternate" type="application/atom+xml" href="feed?a=1&amp;b=2" title="A &amp; B">
    <link rel="alternate" type="text/html" href="/no"><A class=x HREF=x.html>A&nbsp;<b>b</b>
    c</A><a href="">none</a><a href="/blank">&nbsp;</a><a href="/open">open <a href="/inner" title="a > b">in</a><a name="x">anchor</a>"""
    rows = [(page, "http://h.example/d/e"), (None, None), (("<a href='/" + "y" * 9000 + "'>z</a>") * 60, "http://h.example")]
    d = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "i int, html string, url string, evidence string")
    one, two, three = [r["evidence"] for r in markup.page_links(d).orderBy("i").collect()]
    assert one["canonical"] == "http://h.example/two"
    assert [tuple(x) for x in one["links"]] == [("http://h.example/d/x.html", "A b c"), ("http://h.example/inner", "in")]
    assert [tuple(x) for x in one["feeds"]] == [("http://h.example/d/feed?a=1&b=2", "A & B")]
    assert (two["canonical"], two["links"], two["feeds"]) == (None, [], [])
    assert len(three["links"]) == 40
    assert markup.page_links(d.limit(0)).count() == 0


def test_feeds_of_three_kinds(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title><entry><title type="html">T &amp; U</title><link rel="alternate" href="http://a/1"/><updated>2026-01-01</updated><summary>s</summary><id>i1</id></entry></feed>'
    rdf = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><item><title>R</title><link>http://a/2</link><dc:date>2026</dc:date></item></rdf:RDF>'
    rss = "<rss><channel>" + "".join(f"<item><title>{i}</title><link>http://a/{i}</link></item>" for i in range(30)) + "</channel></rss>"
    d = spark.createDataFrame([(0, atom), (1, rdf), (2, rss), (3, "<rss><channel><item><title>no link</title></item></channel></rss>")], "i int, xml string")
    a, r, s, n = [x["items"] for x in markup.feed_items(d).orderBy("i").collect()]
    assert [(x["title"], x["url"], x["published_at"], x["description"], x["source_record_id"]) for x in a] == [("T & U", "http://a/1", "2026-01-01", "s", "i1")]
    assert [(x["title"], x["url"], x["published_at"]) for x in r] == [("R", "http://a/2", "2026")]
    assert len(s) == 20 and n == []


def test_item_faults(spark):
    from tidemark.operators import contracts

    words = " ".join(f"w{i}" for i in range(80))
    at = "2026-01-02T03:04:05+08:00"
    cases = [
        ("t", "u", words, at, None), (None, "", words, None, "missing_fields:['title', 'url', 'published_at']"), ("", "u", "", at, "missing_fields:['title', 'content']"),
        ("t", "u", words, "2026-02-29T00:00:00Z", "published_at_invalid"), ("t", "u", words, "2026-01-02T24:00:00Z", "published_at_invalid"), ("t", "u", words, "02/01/2026", "published_at_invalid"),
        ("t", "u", words, "2024-02-29", "published_at_missing_timezone"), ("t", "u", words, "2026-01-02 03:04", "published_at_missing_timezone"), ("t", "u", words, "2026-01-02 03:04Z", None), ("t", "u", words, "2026-01-02T03:04:05.5-0330", None),
        ("t", "u", "a \n　 b", at, "content_too_short:3"), ("Big  News", "u", f"big news {words} BIG\nNEWS", at, "content_repeats_title"), ("Big News", "u", f"big news {words}", at, None), ("Big News", "u", f"x big news {words} big news", at, None),
        ("t", "u", "same words here " * 40, at, "content_duplicate_ratio:0.027"), ("t", "u", "long" * 60, at, None), (" ", "u", f" {words}", at, None),
    ]
    d = spark.createDataFrame([(i, *c[:4]) for i, c in enumerate(cases)], "i int, title string, url string, content string, published_at string")
    got = {r["i"]: r["fault"] for r in d.select("i", contracts.item_fault(*(F.col(c) for c in ("title", "url", "content", "published_at"))).alias("fault")).collect()}
    assert got == {i: c[4] for i, c in enumerate(cases)}


def test_signed_numbers_round_by_their_exact_value(spark):
    x = [0.15, 0.25, 0.35, 0.0, -0.04, 12.35, -12.35, 1e15 + 0.125, None, *(k / 1000 * 100 for k in range(-999, 9999, 7))]
    d = spark.createDataFrame(list(enumerate(x)), "i int, x double")
    got = [r["s"] for r in d.select("i", text.signed(F.col("x")).alias("s")).orderBy("i").collect()]
    assert got == [None if v is None else f"{v:+.1f}" for v in x] and got[0] == "+0.1" and got[2] == "+0.3"
    lots = spark.createDataFrame([(2050,), (-1350,), (20500,), (13500,), (999,)], "x long").select(text.lots(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in lots] == [f"{2.05:+.1f}k", f"{-1.35:+.1f}k", f"{2.05:+.1f}萬", f"{1.35:+.1f}萬", "+999"]


def test_registered_percents_are_those_of_the_sql_for_odd_balances(spark, tmp_path):
    import duckdb

    from tidemark.plans.text_queries import book

    odd = [-0.0, 0.0, -0.004, 0.004, -0.5, 12.99, -999.99, 9999.99, None, float("nan"), float("inf"), float("-inf"), 1e15]
    spark.createDataFrame(list(enumerate(odd)), "c_custkey long, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    got = {tuple(r) for r in book.queries["q_X28_signed_percent"](spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert got == set(duck.execute(book.sql["q_X28_signed_percent"]).fetchall())
    assert {(0, "-0.0%"), (1, "+0.0%"), (8, None)} <= got
