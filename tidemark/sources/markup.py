"""Evidence from pages and feeds: links, canonical address, declared feeds, items.

Pages are cut into tags by expressions, feeds are read by Spark's own XML reader; only character
references go through Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import collapse, let, unescape

# How much evidence a page or feed gives.
MOST_LINKS, TEXT_LENGTH, MOST_ITEMS = 40, 300, 20

FEED_TYPES = ("application/rss+xml", "application/atom+xml")

_HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>"
_INSIDE = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_BETWEEN = "\x00"  # no character reference stands for it


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag, quoted or not; empty if there is none."""
    value = F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(value, r"""^(["'])(.*)\1$""", "$2")


def resolved(base: Column, reference: Column) -> Column:
    """An address as seen from a page's own (RFC 3986, section 5.2)."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    bare = F.regexp_extract(base, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    folder = F.regexp_replace(bare, "[^/]*$", "")
    folder = F.when((folder == "") & origin.contains("//"), "/").otherwise(folder)
    path, rest = F.regexp_extract(reference, r"^([^?#]*)", 1), F.regexp_extract(reference, r"(?s)^[^?#]*(.*)$", 1)

    def without_dots(p: Column) -> Column:
        """A path's segments with . and .. carried out."""
        empty = F.array().cast("array<string>")
        step = lambda kept, s: F.when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).when(s == ".", kept).otherwise(F.concat(kept, F.array(s)))
        kept = F.array_join(F.aggregate(F.split(p, "/"), empty, step), "/")
        return F.when(p.rlike(r"(^|/)\.\.?$") & ~F.endswith(kept, F.lit("/")), F.concat(kept, F.lit("/"))).otherwise(kept)

    absolute = F.concat(origin, without_dots(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path))), rest)
    return (
        F.when(reference.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), reference)
        .when(F.startswith(reference, F.lit("//")), F.concat(scheme, reference))
        .when(path != "", absolute)
        .when(F.startswith(rest, F.lit("?")), F.concat(origin, bare, rest))
        .otherwise(F.concat(F.regexp_extract(base, r"^([^#]*)", 1), rest))
    )


def _plain(texts: Column) -> Column:
    """An array of strings with their character references replaced."""
    whole = F.array_join(texts, _BETWEEN)
    return F.when(F.size(texts) == 0, F.array().cast("array<string>")).otherwise(F.split(unescape(whole), _BETWEEN))


def page_links(pages: DataFrame, html: str = "html", url: str = "url", most: int = MOST_LINKS) -> DataFrame:
    """pages with a struct `evidence`: canonical address, up to `most` links (of anchors with an
    address and a text), declared feeds. Null pages have none of them."""
    base = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    seen = F.regexp_replace(F.coalesce(F.col(f"`{html}`"), F.lit("")), _HIDDEN, " ")
    anchors = F.filter(F.split(seen, r"(?i)(?=<a\s)"), lambda x: x.rlike(rf"(?is)^<a\s{_INSIDE}>.*</a\s*>"))
    opening = F.transform(anchors, lambda x: F.regexp_extract(x, rf"(?is)^<a\s{_INSIDE}>", 0))
    inner = F.transform(anchors, lambda x: F.regexp_replace(F.regexp_extract(x, rf"(?is)^<a\s{_INSIDE}>(.*?)</a\s*>", 1), "<[^>]*>", " "))
    tags = F.regexp_extract_all(seen, F.lit(rf"(?is)(<link\s{_INSIDE}>)"), F.lit(1))
    named = lambda rel: (lambda t: F.contains(F.lower(attribute(t, "rel")), F.lit(rel)) & (attribute(t, "href") != ""))
    feeds = F.filter(F.filter(tags, named("alternate")), lambda t: F.lower(attribute(t, "type")).isin(*FEED_TYPES))
    of = lambda which, name: F.transform(which, lambda t: attribute(t, name))

    rows = pages.withColumns({"_hrefs": of(opening, "href"), "_texts": inner, "_feeds": of(feeds, "href"), "_titles": of(feeds, "title"), "_canonical": of(F.filter(tags, named("canonical")), "href")})
    for c in ("_hrefs", "_texts", "_feeds", "_titles", "_canonical"):
        rows = rows.withColumn(c, _plain(F.col(c)))

    def pairs(addresses: str, texts: str) -> Column:
        zipped = F.arrays_zip(F.col(addresses).alias("a"), F.col(texts).alias("t"))
        return F.transform(zipped, lambda x: F.struct(resolved(base, x["a"]).alias("url"), F.substring(collapse(x["t"]), 1, TEXT_LENGTH).alias("text")))

    links = F.slice(F.filter(pairs("_hrefs", "_texts"), lambda x: x["text"] != ""), 1, most)
    with_address = F.filter(F.arrays_zip(F.col("_hrefs").alias("a"), F.col("_texts").alias("t")), lambda x: x["a"] != "")
    rows = rows.withColumns({"_hrefs": F.transform(with_address, lambda x: x["a"]), "_texts": F.transform(with_address, lambda x: x["t"])})
    canonical = F.when(F.size("_canonical") > 0, let(F.element_at("_canonical", -1), lambda c: resolved(base, c)))
    evidence = F.struct(canonical.alias("canonical"), links.alias("links"), pairs("_feeds", "_titles").alias("feeds"))
    return rows.withColumn("evidence", evidence).drop("_hrefs", "_texts", "_feeds", "_titles", "_canonical")


_ENTRY = (
    "struct<title: string, link: array<struct<_href: string, _VALUE: string>>, pubDate: string, published: string, updated: string, date: string, "
    "description: string, summary: string, content: string, guid: string, id: string>"
)
_FEED = f"channel struct<item: array<{_ENTRY}>>, item array<{_ENTRY}>, entry array<{_ENTRY}>"


def feed_items(feeds: DataFrame, xml: str = "xml", most: int = MOST_ITEMS) -> DataFrame:
    """feeds with an array `items` of up to `most` entries that have a title and an address.

    RSS 2 (channel/item), RSS 1 (item) and Atom (entry); what is no XML has none.
    """
    read = F.from_xml(F.coalesce(F.col(f"`{xml}`"), F.lit("<none/>")), _FEED, {"ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"})

    def entry(e: Column) -> Column:
        first = lambda *names: F.coalesce(*[F.nullif(collapse(e[n]), F.lit("")) for n in names])
        address = F.filter(F.transform(F.coalesce(e["link"], F.array().cast("array<struct<_href: string, _VALUE: string>>")), lambda x: F.coalesce(x["_href"], collapse(x["_VALUE"]))), lambda x: x.isNotNull() & (x != ""))
        return F.struct(
            F.substring(first("title"), 1, 500).alias("title"),
            F.substring(F.when(F.size(address) > 0, F.element_at(address, -1)), 1, 2000).alias("url"),
            F.substring(first("pubDate", "published", "updated", "date"), 1, 200).alias("published_at"),
            F.substring(first("description", "summary", "content"), 1, 1000).alias("description"),
            F.substring(first("guid", "id"), 1, 500).alias("source_record_id"),
        )

    none = F.array().cast(f"array<{_ENTRY}>")
    parsed = feeds.withColumn("_feed", read)
    entries = F.concat(*[F.coalesce(F.col(f"_feed.{p}"), none) for p in ("channel.item", "item", "entry")])
    items = F.filter(F.transform(entries, entry), lambda x: x["title"].isNotNull() & x["url"].isNotNull())
    return parsed.withColumn("items", F.slice(items, 1, most)).drop("_feed")
