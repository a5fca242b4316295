"""Text and date rules: registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, scoring, text
from tidemark.plans.book import Book, Tables

book = Book()

# Small fixed inputs for rules whose alphabet the tables lack; both engines get the same rows.
TITLES = (
    "《美股》那斯達克收高 晶片股領軍", "〈台股盤後〉量縮收小黑", "大成鋼法說會談關稅", "中華電 3月營收速報 年減4%", "三大法人同步買超 88 億元", "投信今日加碼金融股",
    "英業達宣布入股 早盤台股開高", "〈熱門股〉紙業股轉強", "運價指數止跌", "新手存股怎麼選", "台塑早盤走勢平穩", "大盤爆量創高 該追還是該收", "本週大事回顧：央行與電價", "亞泥(1102) 公布新產線",
)
PASSAGES = (
    "群創 (3481-TW) 與友達(2409) 今 (2026) 年營收成長 12.5 %，達 1,200 億元", "去 (2025)4 月 大成鋼 (2027-TW) 漲停，(2027) 成交 3 萬張", "台積電(2330)(2330-TW)；EPS 9.5元、目標價 1,000 元，上漲 5 點", "no codes here (12) (1234567)", "(1999) 今(114)年", "",
)
STAMPS = (
    "", "1735689600000", "1735689600", "2026-01-02T03:04:05+08:00", "2026-01-02 03:04", "114/05/06", "Fri, 02 Jan 2026 03:04:05 +0800", "3 小時前", "2026/1/2", "soon", "1150102", "2026-01-02T03:04:05Z",
)
URLS = (
    "HTTPS://User@News.Example.com:443/a/b/?ID=2&utm=x&cat=1#top", "http://example.com:80", "http://Example.com:8080/x//?b=1&a=2", "not a url ", "\u3000https://a.b/c?id=1&id=0&cat=", "https://a.b/c?id=a+b%2Fc&cat=%E4%B8%AD~*", "https://a.b:x/c/?id=1", "//h.i/p/",
)
# What the generated texts lack: white space and marks of other scripts, character references.
MARKUP = ("台積電\u3000營收&nbsp;&eacute;&hellip;<b>成長</b>\u00a0", "&amp;lt;b&amp;gt; &#39;x&#x27; &copy", "\t a \x1f", "", "<p>一</p>\u2003<p>二")
ARTICLES = (
    "第一段。\n\n" + "字" * 30 + "\n\n" + "尾" * 30, "字" * 34 + "。" + "尾" * 20, "字" * 40 + "？" + "尾", "字" * 39 + " \u3000" + "尾" * 9, "a. " * 30, "short", "字" * 10 + "！" + "尾" * 40, "x" * 40 + "\n\n" + "y",
    "延伸閱讀：其他\n本文\u3000第一段\n相關新聞\n本文 第一段\n字\n更多新聞 x\nRelated: stays\n\n  two  words ",
)


def _either(table: str, column: str, key: str, rows: tuple[str, ...]) -> str:
    """SQL of a table's texts, with rows under the keys -1, -2, ..."""
    quoted = ", ".join("({}, '{}')".format(-1 - i, r.replace("'", "''")) for i, r in enumerate(rows))
    return f"(SELECT {key} AS i, {column} AS s FROM {table} UNION ALL SELECT * FROM (VALUES {quoted}) AS v(i, s))"


def _with(t: Tables, df: DataFrame, key: str, column: str, rows: tuple[str, ...]) -> DataFrame:
    own = t.spark.createDataFrame([(-1 - i, r) for i, r in enumerate(rows)], "i long, s string")
    return df.select(F.col(key).cast("long").alias("i"), F.col(column).alias("s")).unionByName(own)


def _when(rules, column: str) -> str:
    return " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in rules)


_PERIODIC = f"CASE {_when(text.COLUMNS_ALWAYS, 's')} WHEN regexp_matches(s, '{text.EVENTS}') THEN NULL {_when(text.COLUMNS, 's')} END"


@book.query(f"SELECT i, {_PERIODIC} AS kind FROM {_either('articles', 'title', 'n', TITLES)}")
def q_X10_periodic_type(t: Tables) -> DataFrame:
    return _with(t, t.articles, "n", "title", TITLES).select("i", text.periodic_type(F.col("s")).alias("kind"))


# White space as DuckDB's expressions know it; blanks at the ends of s go.
_SPACE = r"[\p{{Z}}\x09-\x0d\x1c-\x1f\x{{85}}]"


def _collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE.format()}+', ' ', 'g'))"


def _stripped(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE.format()}+|{_SPACE.format()}+$', '', 'g')"


_TEMPLATE = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '\\([0-9]{{3,6}}[-A-Za-z]*\\)', '', 'g'), '[0-9]+[.,]?[0-9]*', '#', 'g'), '[年月日]', '', 'g'), '" + _SPACE + "+', ' ', 'g'))"


@book.query(f"SELECT i, {_TEMPLATE.format('s')} AS template FROM {_either('articles', 'title', 'n', TITLES + PASSAGES)}")
def q_X09_title_template(t: Tables) -> DataFrame:
    return _with(t, t.articles, "n", "title", TITLES + PASSAGES).select("i", text.title_template(F.col("s")).alias("template"))


@book.query(f"SELECT article_id, {_TEMPLATE.format('title')} AS template, count(*) OVER (PARTITION BY {_TEMPLATE.format('title')}) AS n FROM articles")
def q_X11_templates(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    a = t.articles.select("article_id", text.title_template(F.col("title")).alias("template"))
    return a.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("template")))


@book.query(rf"""WITH v AS {_either("documents", "text", "doc_id", PASSAGES)},
c AS (SELECT i, regexp_replace(s, '[今去前明後隔]\s*\([0-9]{{3,4}}\)\s*年', ' ', 'g') AS s FROM v WHERE contains(s, '(')),
h AS (SELECT i, unnest(regexp_extract_all(s, '\([0-9]{{3,6}}(?:-[A-Za-z]{{1,4}})?\)')) AS m, generate_subscripts(regexp_extract_all(s, '\([0-9]{{3,6}}(?:-[A-Za-z]{{1,4}})?\)'), 1) AS p FROM c),
d AS (SELECT i, p, regexp_extract(m, '[0-9]+') AS code, contains(m, '-') AS suf FROM h),
f AS (SELECT i, code, min(p) AS p FROM d WHERE suf OR NOT regexp_full_match(code, '(19|20)[0-9]{{2}}') OR EXISTS (SELECT 1 FROM d e WHERE e.i = d.i AND e.code = d.code AND e.suf) GROUP BY 1, 2)
SELECT v.i, coalesce((SELECT string_agg(code, ',' ORDER BY p) FROM f WHERE f.i = v.i), '') AS codes FROM v""")
def q_X12_bracketed_tickers(t: Tables) -> DataFrame:
    return _with(t, t.documents, "doc_id", "text", PASSAGES).select("i", F.array_join(text.bracketed_tickers(F.col("s")), ",").alias("codes"))


@book.query(rf"SELECT i, coalesce(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(s, '[0-9][0-9,]*(?:\.[0-9]+)?\s*(?:%|％|億元|億|萬張|萬|張|點|倍|美元|元)'), lambda x: regexp_replace(x, '\s+', '', 'g')))), ';'), '') AS details FROM {_either('documents', 'text', 'doc_id', PASSAGES)}")
def q_X13_details(t: Tables) -> DataFrame:
    return _with(t, t.documents, "doc_id", "text", PASSAGES).select("i", F.array_join(F.array_sort(text.money_details(F.col("s"))), ";").alias("details"))


# The character references that stand in the pages and in MARKUP, for engines that know none;
# an ampersand's own comes last.
_REFERENCES = (("&nbsp;", "\u00a0"), ("&eacute;", "é"), ("&hellip;", "…"), ("&middot;", "·"), ("&copy;", "©"), ("&copy", "©"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&amp", "&"))


def _unescaped(x: str) -> str:
    for reference, plain in _REFERENCES:
        x = f"replace({x}, '{reference}', '{plain}')" if reference != "&amp" else f"regexp_replace({x}, '&amp($|[^;])', '&\\1', 'g')"
    return x


@book.query(rf"""WITH v AS {_either("pages", "html", "page_id", MARKUP)}
SELECT i, md5({_collapsed(f"regexp_replace({_unescaped("coalesce(s, '')")}, '<[^>]+>', ' ', 'g')")}) AS cleaned,
  md5({_stripped(_unescaped("regexp_replace(coalesce(s, ''), '<[^>]+>', '', 'g')"))}) AS legacy FROM v""")
def q_X01_X02_clean_html(t: Tables) -> DataFrame:
    rows = _with(t, t.pages, "page_id", "html", MARKUP)
    return rows.select("i", F.md5(text.clean_html(F.col("s")).cast("binary")).alias("cleaned"), F.md5(text.clean_html_legacy(F.col("s")).cast("binary")).alias("legacy"))


@book.query(rf"""SELECT i, 'news_' || substr(sha256({_stripped("s")}), 1, 16) AS a FROM {_either("documents", "text", "doc_id", MARKUP)}""")
def q_X05_article_id(t: Tables) -> DataFrame:
    return _with(t, t.documents, "doc_id", "text", MARKUP).select("i", text.article_id(F.lit("news"), F.col("s")).alias("a"))


@book.query("SELECT doc_id, substr(sha256(source || '|' || lang || '|' || n_chars::VARCHAR), 1, 16) AS b FROM documents")
def q_X07_composite_id(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.composite_id(F.col("source"), F.col("lang"), F.col("n_chars").cast("string")).alias("b"))


@book.query("""SELECT event_id, 'evt_' || strftime(to_timestamp(min(published))::TIMESTAMP, '%Y%m%d') || '_NA_' || substr(sha1(string_agg(article_id, '' ORDER BY article_id)), 1, 8) AS hashed FROM articles GROUP BY event_id""")
def q_X06_event_id(t: Tables) -> DataFrame:
    a = t.articles.groupBy("event_id").agg(F.to_date(F.timestamp_seconds(F.min("published"))).alias("day"), F.collect_list("article_id").alias("ids"))
    return a.select("event_id", text.event_id(F.col("day"), F.lit(None).cast("array<string>"), F.col("ids")).alias("hashed"))


@book.query("""SELECT event_id, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha1(event_id), ''), lambda x: (strpos('0123456789abcdef', x) - 1)::BIGINT)), lambda a, d: (a * 16 + d) % 7) AS bucket FROM entities""")
def q_X08_pick(t: Tables) -> DataFrame:
    return t.entities.select("event_id", text.pick(F.col("event_id"), F.lit(7).cast("long")).alias("bucket"))


@book.query(f"SELECT article_id, md5({_stripped('title')} || chr(10) || substr(coalesce(content, ''), 1, 500)) AS h FROM articles")
def q_X19_embed_text(t: Tables) -> DataFrame:
    return t.articles.select("article_id", F.md5(text.embed_text(F.col("title"), F.col("content")).cast("binary")).alias("h"))


@book.query("""SELECT conv_id, md5(string_agg('[' || (k - 1)::VARCHAR || '] ' || coalesce(role, '?') || ': ' || coalesce(text, '?'), chr(10) ORDER BY k)) AS prompt
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) GROUP BY conv_id""")
def q_X21_prompt(t: Tables) -> DataFrame:
    ordered = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    block = lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), F.coalesce(x["role"], F.lit("?")), F.lit(": "), F.coalesce(x["text"], F.lit("?")))
    return ordered.select("conv_id", F.md5(F.array_join(F.transform("x", block), "\n").cast("binary")).alias("prompt"))


@book.query(rf"""WITH u AS (SELECT i, {_stripped("s")} AS s FROM {_either("pages", "url", "page_id", URLS)}),
a AS (SELECT i, s, lower(regexp_extract(s, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS sc, regexp_replace(s, '^[A-Za-z][A-Za-z0-9+.-]*:', '') AS r FROM u),
p AS (SELECT i, s, sc, regexp_replace(regexp_extract(r, '^//([^/?#]*)', 1), '^.*@', '') AS h, regexp_replace(regexp_replace(r, '^//[^/?#]*', ''), '[?#].*$', '') AS pa, regexp_extract(r, '^[^?#]*\?([^#]*)', 1) AS q FROM a),
w AS (SELECT *, lower(split_part(h, ':', 1)) AS ho, split_part(h, ':', 2) AS po, list_filter(string_split(q, '&'), lambda x: lower(split_part(x, '=', 1)) IN ('id', 'cat')) AS k FROM p),
e AS (SELECT *, array_to_string(list_sort(list_transform(k, lambda x: lower(split_part(x, '=', 1)) || '=' || replace(replace(url_encode(url_decode(replace(split_part(x, '=', 2), '+', ' '))), '%20', '+'), '%7E', '~'))), '&') AS qs FROM w)
SELECT i, CASE WHEN po <> '' AND NOT regexp_full_match(po, '[0-9]+') THEN s ELSE CASE WHEN sc <> '' THEN sc || ':' ELSE '' END ||
  CASE WHEN ho <> '' THEN '//' || ho || CASE WHEN po = '' OR sc = 'http' AND po = '80' OR sc = 'https' AND po = '443' THEN '' ELSE ':' || po END ELSE '' END || rtrim(pa, '/') || CASE WHEN qs <> '' THEN '?' || qs ELSE '' END END AS url FROM e""")
def q_X22_canonical_url(t: Tables) -> DataFrame:
    return _with(t, t.pages, "page_id", "url", URLS).select("i", text.canonical_url(F.col("s"), ("id", "cat")).alias("url"))


@book.query("SELECT page_id, h = 'example.com' OR ends_with(h, '.example.com') OR h = 'example.org' OR ends_with(h, '.example.org') AS allowed FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS h FROM pages)")
def q_X23_host_allowed(t: Tables) -> DataFrame:
    host = F.lower(F.regexp_extract("url", "://([^/?#]*)", 1))
    return t.pages.select("page_id", text.host_allowed(host, ["example.com", "example.org"]).alias("allowed"))


@book.query(r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS s FROM w WHERE len(w) >= 24)
SELECT doc_id, round(count(DISTINCT s) / count(*), 6) AS share FROM g GROUP BY doc_id UNION ALL SELECT doc_id, 1.0 FROM w WHERE len(w) < 24""")
def q_X24_distinct_share(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(text.distinct_share(F.col("text")), 6).alias("share"))


@book.query("SELECT c_custkey AS id, printf('%+.1f%%', floor(c_acctbal) / 1000 * 100) AS pct FROM customer")
def q_X28_signed_percent(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_custkey").alias("id"), text.signed_percent(text.floored(F.col("c_acctbal")) / 1000).alias("pct"))


@book.query(rf"""WITH l AS (SELECT i, {_collapsed("unnest(string_split(s, chr(10)))")} AS l, generate_subscripts(string_split(s, chr(10)), 1) AS p FROM {_either("documents", "text", "doc_id", ARTICLES)}),
k AS (SELECT i, l, min(p) AS p FROM l WHERE length(l) >= 2 AND NOT regexp_matches(l, '^(延伸閱讀|相關新聞|更多新聞)') GROUP BY i, l)
SELECT i, count(*) AS n, md5(string_agg(l, chr(10) || chr(10) ORDER BY p)) AS h FROM k GROUP BY i""")
def q_X31_paragraphs(t: Tables) -> DataFrame:
    p = text.paragraphs(F.col("s"))
    return _with(t, t.documents, "doc_id", "text", ARTICLES).select("i", F.size(F.split(p, "\n\n")).cast("long").alias("n"), F.md5(p.cast("binary")).alias("h")).filter("h <> md5('')")


@book.query(rf"""WITH h AS (SELECT i, s, substr(s, 1, 41) AS head FROM {_either("documents", "text", "doc_id", ARTICLES)}),
m AS (SELECT *, length(regexp_extract(head, '(?s)^(.*)\n\n', 1)) AS p, contains(head, chr(10) || chr(10)) AS has_p, length(regexp_extract(head, '(?s)^(.*)[。！？]', 1)) AS e, regexp_matches(head, '[。！？]') AS has_e FROM h)
SELECT i, md5(CASE WHEN length(s) <= 40 THEN s ELSE regexp_replace(CASE WHEN has_p AND p >= 28 THEN substr(s, 1, p) WHEN has_e AND e >= 28 THEN substr(s, 1, e + 1) ELSE substr(s, 1, 40) END, '{_SPACE.format()}+$', '') END) AS h FROM m""")
def q_X25_clip(t: Tables) -> DataFrame:
    return _with(t, t.documents, "doc_id", "text", ARTICLES).select("i", F.md5(text.clip(F.col("s"), 40).cast("binary")).alias("h"))


@book.query("SELECT doc_id, regexp_matches(lower(text), 'market|license|rights reserved|the') AS hit FROM documents")
def q_X17_X27_any_word(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.any_word(F.lower("text"), ["market", "license", "rights reserved", "the"]).alias("hit"))


_ZONED = r"regexp_matches(t, '(Z|[+-][0-9]{2}:?[0-9]{2})$')"


@book.query(rf"""WITH x AS (SELECT i, trim(s) AS t FROM {_either("events", "strftime(ts, '%Y-%m-%d %H:%M:%S')", "event_id", STAMPS)}),
k AS (SELECT i, CASE WHEN t = '' THEN 'missing' WHEN regexp_matches(t, '^[0-9]{{13}}$') THEN 'epoch_millis' WHEN regexp_matches(t, '^[0-9]{{10}}$') THEN 'epoch_seconds'
  WHEN regexp_matches(t, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}[T ][0-9]{{2}}:[0-9]{{2}}') THEN CASE WHEN {_ZONED} THEN 'iso8601_tz' ELSE 'iso8601_naive' END
  WHEN regexp_matches(t, '^[0-9]{{2,3}}[/年.-][0-9]{{1,2}}[/月.-][0-9]{{1,2}}') THEN 'roc_year' WHEN regexp_matches(t, '^[A-Z][a-z]{{2}}, [0-9]{{1,2}} [A-Z][a-z]{{2}} [0-9]{{4}}') THEN 'rfc822'
  WHEN regexp_matches(t, '前|昨天|剛剛|ago') THEN 'relative' WHEN regexp_matches(t, '^[0-9]{{4}}[/-][0-9]{{1,2}}[/-][0-9]{{1,2}}$') THEN 'date_only' ELSE 'unknown' END AS kind FROM x)
SELECT i, kind, kind IN ('epoch_millis', 'epoch_seconds', 'iso8601_tz', 'rfc822') AS has_tz FROM k""")
def q_D09_classify(t: Tables) -> DataFrame:
    stamps = _with(t, t.events.withColumn("stamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "event_id", "stamp", STAMPS)
    return stamps.select("i", dates.classify(F.col("s")).alias("d")).select("i", "d.kind", "d.has_tz")


@book.query("""SELECT l_orderkey, l_linenumber, l_shipdate::DATE AS day, make_date((year(l_shipdate) - 1911)::INT + 1911, month(l_shipdate)::INT, day(l_shipdate)::INT) AS roc FROM lineitem""", days=("day", "roc"))
def q_D01_D07_days(t: Tables) -> DataFrame:
    day = F.to_date("l_shipdate")
    text_roc = F.concat(F.lpad((F.year(day) - 1911).cast("string"), 3, "0"), F.date_format(day, "MMdd"))
    return t.lineitem.select("l_orderkey", "l_linenumber", dates.to_day(F.col("l_shipdate").cast("string")).alias("day"), dates.roc_date(text_roc).alias("roc"))


@book.query("""SELECT event_id, CASE WHEN s < 60 THEN s::VARCHAR || ' 秒' WHEN s < 3600 THEN (s // 60)::VARCHAR || ' 分' WHEN s < 86400 THEN (s // 3600)::VARCHAR || ' 小時' ELSE (s // 86400)::VARCHAR || ' 天' END AS age
FROM (SELECT event_id, (event_id * 37) % 200000 AS s FROM events)""")
def q_D15_age(t: Tables) -> DataFrame:
    return t.events.select("event_id", dates.age((F.col("event_id") * 37) % 200000).alias("age"))


@book.query("""SELECT event_id, CASE WHEN o < first_published - 5184000 THEN first_published ELSE o END AS guarded FROM (SELECT event_id, occurred - (k % 4) * 2592000 AS o, first_published FROM entities)""")
def q_D11_guarded_time(t: Tables) -> DataFrame:
    rows = t.entities.withColumn("o", F.col("occurred") - F.col("k") % 4 * 2592000)
    return rows.select("event_id", dates.guarded_event_time(F.col("o"), F.col("first_published")).alias("guarded"))


@book.query("""SELECT c_custkey AS id, round(CASE WHEN n = 0 OR p = 0 THEN 0.0 ELSE (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 1.96 * 1.96 / (4 * n)) / n)) / (1 + 1.96 * 1.96 / n) END, 6) AS wilson,
  CASE WHEN c_acctbal / 100 < -14.5 THEN 0.0::DOUBLE ELSE round(1 / (1 + exp(-least(greatest(c_acctbal / 100, -35), 35))), 6) END AS sig FROM (SELECT *, (c_custkey % 50)::DOUBLE AS n, CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE least(c_custkey % 7, c_custkey % 50)::DOUBLE / (c_custkey % 50) END AS p FROM customer)""")
def q_M16_M17_statistics(t: Tables) -> DataFrame:
    n = F.col("c_custkey") % 50
    return t.customer.select(F.col("c_custkey").alias("id"), F.round(scoring.wilson_lower(F.least(F.col("c_custkey") % 7, n), n), 6).alias("wilson"), F.round(scoring.sigmoid(F.col("c_acctbal") / 100), 6).alias("sig"))
