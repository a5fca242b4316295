"""Scores, serving, gates: registered queries over events and articles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, scoring, text
from tidemark.operators import assemble, bars, contracts, gates, reads, serving, topic, validation
from tidemark.plans.book import Book, Tables
from tidemark.plans.market_queries import _DERIVED

book = Book()

_FEATURE = "trim(trim(regexp_replace(title, '\\s+', ' ', 'g')) || chr(10) || substr(trim(regexp_replace(content, '\\s+', ' ', 'g')), 1, 50), ' ' || chr(10))"
_HEAT = "heat AS (SELECT a.event_id, count(DISTINCT a.source) AS heat_sources_24h FROM articles a JOIN (SELECT event_id, min(published) AS f FROM articles GROUP BY 1) m ON a.event_id = m.event_id AND a.published <= m.f + 86400 GROUP BY 1)"
_READY = "title IS NOT NULL AND categories IS NOT NULL AND stars IS NOT NULL"
_RANK = "stars DESC NULLS FIRST, market_validation DESC NULLS LAST, occurred DESC NULLS FIRST, event_id"


def _tier(x: str) -> str:
    arms = " ".join(f"WHEN {' OR '.join(f'contains(lower({x}), {chr(39)}{w}{chr(39)})' for w in words)} THEN {score}" for score, words in scoring.TIERS)
    return f"CASE {arms} END"


_OVERLAP = "len(list_intersect(coalesce(categories, []), {})) > 0"
_SCORED = f"""
src AS (SELECT event_id, list(source ORDER BY article_id) AS sources, string_agg(lower(source), ' ' ORDER BY article_id) AS joined, max({_tier('source')}) AS best FROM (SELECT *, CASE n % 9 WHEN 0 THEN 'MOPS ' || source WHEN 4 THEN '工商時報' || source WHEN 5 THEN 'Yahoo ' || source WHEN 7 THEN 'PTT' ELSE source END AS s2 FROM articles) x(article_id, n, event_id, source_raw, source_type, title, content, url, published, stage, source) GROUP BY 1),
parts AS (SELECT e.event_id,
  CASE WHEN source_count >= 8 THEN 100 ELSE [25, 45, 60, 70, 80, 85, 92][greatest(source_count, 1)] END AS breadth,
  CASE WHEN status = 'official_confirmed' THEN CASE WHEN {' OR '.join(f"contains(joined, '{w}')" for w in scoring.TIERS[0][1])} THEN 100 WHEN {' OR '.join(f"contains(joined, '{w}')" for w in scoring.TIERS[1][1])} THEN 85 ELSE 72 END
    WHEN status = 'rumor_unconfirmed' THEN least(coalesce(best, 50), 30) ELSE coalesce(best, 50) END AS authority,
  CASE WHEN {_OVERLAP.format("['政策', '關稅']")} THEN 100 WHEN {_OVERLAP.format("['產業供需', 'AI/科技']")} THEN 75 WHEN len(tickers) >= 3 THEN 70 WHEN len(tickers) = 2 THEN 60
    WHEN len(tickers) = 1 THEN CASE WHEN tickers[1] IN ({", ".join(f"'{h}'" for h in scoring.HEAVYWEIGHTS)}) THEN 65 ELSE 45 END ELSE 35 END AS impact,
  coalesce(list_max(list_transform(categories, lambda c: CASE c {" ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.CATEGORIES.items())} ELSE 50 END)), 50) AS category,
  heat_sources_24h AS h FROM entities e JOIN src USING (event_id) LEFT JOIN heat USING (event_id)),
amped AS (SELECT *, CASE WHEN h IS NULL THEN 1.0 WHEN h / 2 <= 0.5 THEN 0.9 WHEN h / 2 <= 1 THEN round(0.9 + (h / 2 - 0.5) / 0.5 * 0.1, 3) WHEN h / 2 >= 2.5 THEN 1.15 ELSE round(1.0 + (h / 2 - 1) / 1.5 * 0.15, 3) END::DOUBLE AS amp FROM parts),
totals AS (SELECT *, least(greatest((0.0::DOUBLE + breadth * 0.30::DOUBLE + authority * 0.25::DOUBLE + impact * 0.30::DOUBLE + category * 0.15::DOUBLE) * amp, 0), 100) AS raw FROM amped)
"""


def _sources(t: Tables) -> DataFrame:
    """Event and its members' source names; a few names are of the kinds that tiers look for."""
    name = F.when(F.col("n") % 9 == 0, F.concat(F.lit("MOPS "), "source")).when(F.col("n") % 9 == 4, F.concat(F.lit("工商時報"), "source")).when(F.col("n") % 9 == 5, F.concat(F.lit("Yahoo "), "source")).when(F.col("n") % 9 == 7, F.lit("PTT")).otherwise(F.col("source"))
    listed = t.articles.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("article_id", name.alias("s")))).alias("x"))
    return listed.select("event_id", F.transform("x", lambda x: x["s"]).alias("sources"))


def _importance(t: Tables) -> DataFrame:
    joined = t.entities.join(_sources(t), "event_id").join(gates.heat_sources(t.articles), "event_id", "left")
    score = scoring.importance(F.col("source_count"), F.col("sources"), F.col("status"), F.col("tickers"), F.col("categories"), F.col("heat_sources_24h"))
    return joined.withColumn("score", score)


@book.query(f"WITH {_HEAT}, {_SCORED} SELECT event_id, breadth::INT AS breadth, authority::INT AS authority, impact::INT AS impact, category::INT AS category, amp, round(raw, 6) AS total, (CASE WHEN raw >= 80 THEN 5 WHEN raw >= 65 THEN 4 WHEN raw >= 50 THEN 3 WHEN raw >= 35 THEN 2 ELSE 1 END)::INT AS stars FROM totals")
def q_M06_importance(t: Tables) -> DataFrame:
    return _importance(t).select("event_id", "score.*")


@book.query(f"""WITH {_HEAT}, {_SCORED}, x AS (SELECT t.*, e.source_count, e.status, coalesce(e.tickers, []) AS tks, coalesce(e.categories, []) AS cats, src.best, list_filter(src.sources, lambda x: {_tier("x")} = src.best)[1] AS label,
  list_filter(e.categories, lambda c: CASE c {" ".join(f"WHEN '{k}' THEN {v}" for k, v in scoring.CATEGORIES.items())} ELSE 50 END = t.category)[1] AS top,
  CASE WHEN h <= 1 THEN 0.9 WHEN h <= 2 THEN 0.9::DOUBLE + (h / 2 - 0.5::DOUBLE) / (1.0::DOUBLE - 0.5::DOUBLE) * (1.0::DOUBLE - 0.9::DOUBLE) WHEN h >= 5 THEN 1.15 ELSE 1.0::DOUBLE + (h / 2 - 1.0::DOUBLE) / (2.5::DOUBLE - 1.0::DOUBLE) * (1.15::DOUBLE - 1.0::DOUBLE) END::DOUBLE AS exact
  FROM totals t JOIN entities e USING (event_id) JOIN src USING (event_id)),
w AS (SELECT *, greatest(source_count, 1)::VARCHAR || ' 家獨立來源報導' || CASE WHEN breadth >= 80 THEN '（廣泛關注）' WHEN breadth >= 60 THEN '（多方報導）' ELSE '（來源有限）' END AS w1,
  CASE WHEN status = 'official_confirmed' THEN CASE authority WHEN 100 THEN '第一手：官方來源在場（MOPS 等）' WHEN 85 THEN '二手：主流媒體轉述官方' ELSE '二手：一般媒體轉述官方' END
    WHEN status = 'rumor_unconfirmed' THEN '消息未經證實（謠言階段），權威性受限' WHEN best = 100 THEN '含官方來源（' || label || '）' WHEN best = 70 THEN '主流財經媒體（' || label || '）' WHEN best = 55 THEN '一般財經媒體（' || label || '）'
    WHEN best = 30 THEN '僅社群/分析師來源，未經證實' ELSE '來源等級一般' END AS w2,
  CASE WHEN list_has_any(cats, ['政策', '關稅']) THEN '總經/政策層級，影響全市場' WHEN list_has_any(cats, ['產業供需', 'AI/科技']) THEN '產業層級，影響整條供應鏈' WHEN len(tks) >= 3 THEN '牽動 ' || len(tks)::VARCHAR || ' 檔個股' WHEN len(tks) = 2 THEN '牽動 2 檔個股'
    WHEN len(tks) = 1 THEN CASE WHEN impact = 65 THEN '權值股 ' || tks[1] || '（單檔但足以牽動大盤）' ELSE '單一個股 ' || tks[1] END ELSE '無明確標的' END AS w3,
  CASE WHEN len(cats) = 0 THEN '類型未標' ELSE '事件類型「' || top || '」' || CASE WHEN category >= 80 THEN '（高影響類型）' WHEN category >= 60 THEN '（中影響類型）' ELSE '（例行揭露類型）' END END AS w4,
  CASE WHEN h IS NULL THEN '熱度資料不足，不調整' WHEN exact >= 1.1::DOUBLE THEN '24h 內 ' || h::VARCHAR || ' 家跟進（快速發酵）' WHEN exact <= 0.95::DOUBLE THEN '24h 內僅 ' || h::VARCHAR || ' 家報導（乏人問津）' ELSE '24h 內 ' || h::VARCHAR || ' 家跟進（一般熱度）' END AS w5 FROM x)
SELECT event_id, printf('[來源廣度 %d分×30%%] %s|[來源權威 %d分×25%%] %s|[影響範圍 %d分×30%%] %s|[事件類型 %d分×15%%] %s|[熱度 ×%s] %s', breadth, w1, authority, w2, impact, w3, category, w4, rtrim(rtrim(printf('%.3f', amp), '0'), '.'), w5) AS reasons FROM w""")
def q_M06_reasons(t: Tables) -> DataFrame:
    why = scoring.explanations(F.col("source_count"), F.col("sources"), F.col("status"), F.col("tickers"), F.col("categories"), F.col("heat_sources_24h"))
    return _importance(t).select("event_id", F.array_join(scoring.reasons(F.col("score"), why), "|").alias("reasons"))


@book.query(f"WITH {_HEAT} SELECT event_id, heat_sources_24h FROM heat")
def q_A06_heat_sources(t: Tables) -> DataFrame:
    return gates.heat_sources(t.articles)


_COMMON = "regexp_full_match(tickers[1], '[1-9][0-9]{3}')"
_SIGNALS = """
anc AS (SELECT event_id AS id, tickers[1] AS ticker, expected_direction AS direction, confidence, DATE '1995-03-01' + ((k * 17) % 2200)::INT AS day FROM entities WHERE regexp_full_match(tickers[1], '[1-9][0-9]{3}')),
j AS (SELECT anc.*, c.* EXCLUDE (ticker), row_number() OVER (PARTITION BY id ORDER BY date) AS n FROM anc JOIN chips c ON anc.ticker = c.ticker AND c.date >= anc.day AND c.close > 0),
win AS (SELECT id, any_value(direction) AS direction, any_value(confidence) AS confidence, avg(net_vs_avg20_volume_pct) AS mean_pct, arg_max(foreign_consecutive_days, date) AS cons, max(volume_ratio_vs_avg20) AS ratio,
  max(return_1d) FILTER (WHERE n = 1) AS r1, max(return_3d) FILTER (WHERE n = 1) AS r3, max(return_5d) FILTER (WHERE n = 1) AS r5, max(sigma_20d) FILTER (WHERE n = 1) AS sigma FROM j WHERE n <= 6 GROUP BY id),
ins AS (SELECT *, CASE WHEN abs(coalesce(mean_pct, 0)) < 0.01 THEN 0 WHEN mean_pct > 0 THEN 1 ELSE -1 END AS si, least(0.3 * least(abs(cons), 5) / 5 + 0.7 * least(abs(coalesce(mean_pct, 0)) / 0.2, 1), 1) AS fi,
  CASE WHEN r5 IS NOT NULL THEN 5 WHEN r3 IS NOT NULL THEN 3 WHEN r1 IS NOT NULL THEN 1 ELSE 0 END AS kk, coalesce(r5, r3, r1) AS ret, coalesce(ratio, 1) AS vr FROM win),
z AS (SELECT *, CASE WHEN sigma > 0 THEN ret / (sigma * sqrt(kk)) END AS z, CASE WHEN vr <= 0.7 THEN 0.8 WHEN vr <= 1 THEN 0.8 + (vr - 0.7) / (1 - 0.7) * 0.2 WHEN vr >= 2.5 THEN 1.15 ELSE 1 + (vr - 1) / 1.5 * 0.15 END AS amp FROM ins),
p AS (SELECT *, CASE WHEN z IS NULL OR abs(z) < 0.3 THEN 0 WHEN z > 0 THEN 1 ELSE -1 END AS sp, coalesce(least(abs(z) / 2, 1), 0) AS fp, CASE WHEN direction = '利多' THEN 1 ELSE -1 END AS e FROM z),
r AS (SELECT *, 50 + (25 * fi * (si * e) + 20 * fp * (sp * e)) * amp AS raw FROM p),
sc AS (SELECT *, round_even(round(CASE WHEN raw > 85 THEN 85 + (raw - 85) * 0.3 WHEN raw < 15 THEN 15 - (15 - raw) * 0.3 ELSE raw END, 9), 0) AS whole FROM r)
"""


@book.query(f"""WITH {_DERIVED}, {_SIGNALS}, seen AS (SELECT id AS event_id, coalesce((CASE WHEN direction = '中性' OR confidence = 'low' THEN NULL WHEN si <> 0 AND sp <> 0 AND si = -sp THEN least(greatest(whole, 40), 55) ELSE least(greatest(whole, 0), 100) END)::INT, -1) AS score,
  CASE WHEN kk >= 5 THEN 'verified' WHEN kk >= 1 THEN 'preliminary' ELSE 'observing' END AS state, si <> 0 AND sp <> 0 AND si = -sp AS divergence FROM sc)
SELECT event_id, coalesce(score, -1) AS score, coalesce(state, 'observing') AS state, coalesce(divergence, false) AS divergence
FROM entities LEFT JOIN seen USING (event_id) WHERE {_COMMON}""")
def q_M12_validation(t: Tables) -> DataFrame:
    day = F.date_add(F.lit("1995-03-01").cast("date"), ((F.col("k") * 17) % 2200).cast("int"))
    anchors = t.entities.select(F.col("event_id").alias("id"), F.get("tickers", F.lit(0)).alias("ticker"), F.col("expected_direction").alias("direction"), "confidence", day.alias("day")).filter(bars.is_common_stock(F.col("ticker")))
    found = validation.market_validation(bars.derive(t.bars), anchors)
    return found.select(F.col("id").alias("event_id"), F.coalesce("score", F.lit(-1)).alias("score"), "state", "divergence")



@book.query("""SELECT event_id, CASE WHEN market_validation >= 80 THEN 'strong' WHEN market_validation >= 60 THEN 'supportive' WHEN market_validation >= 45 THEN 'neutral' WHEN market_validation >= 20 THEN 'weak' ELSE 'contrary' END AS band,
  CASE WHEN market_validation < 45 THEN '背離' WHEN market_validation < 60 THEN '中性' WHEN market_validation >= 60 THEN '支持' END AS label,
  CASE WHEN market_validation IS NOT NULL THEN NULL WHEN expected_direction = '中性' THEN 'neutral' WHEN tickers[1] IS NULL THEN 'no_ticker' WHEN NOT regexp_full_match(tickers[1], '[1-9][0-9]{3}') THEN 'not_common_stock' ELSE 'observing' END AS why FROM entities""")
def q_M15_M24_M25_labels(t: Tables) -> DataFrame:
    s = F.col("market_validation")
    why = scoring.no_score_reason(F.col("expected_direction"), F.col("tickers"), F.lit("observing"), s)
    return t.entities.select("event_id", scoring.band(s).alias("band"), scoring.reaction_label(s).alias("label"), why.alias("why"))


@book.query(f"SELECT event_id, stars::BIGINT AS stars, coalesce(market_validation, -1)::BIGINT AS market_validation, occurred FROM entities WHERE {_READY} AND list_contains(categories, '財報') ORDER BY {_RANK} LIMIT 20 OFFSET 3")
def q_E01_page(t: Tables) -> DataFrame:
    return serving.page(t.entities, "財報", 20, 3).select("event_id", F.col("stars").cast("long").alias("stars"), F.coalesce("market_validation", F.lit(-1)).cast("long").alias("market_validation"), "occurred")


@book.query(f"SELECT event_id, n_members FROM entities WHERE {_READY} AND list_contains(tickers, '2330')")
def q_E05_by_ticker(t: Tables) -> DataFrame:
    return serving.by_ticker(t.entities, "2330").select("event_id", "n_members")


@book.query(f"SELECT event_id FROM entities WHERE {_READY} AND len(list_intersect(categories, ['政策', '法說'])) > 0")
def q_F03_overlap(t: Tables) -> DataFrame:
    return serving.overlapping(t.entities, ["政策", "法說"]).select("event_id")


@book.query("SELECT ticker, name FROM tickers WHERE contains(lower(name), '11') OR starts_with(lower(ticker), '11') ORDER BY starts_with(lower(ticker), '11') DESC, ticker LIMIT 20")
def q_E04_search_tickers(t: Tables) -> DataFrame:
    return serving.search_tickers(t.tickers, " 11 ").select("ticker", "name")


@book.query("""WITH x AS (SELECT event_id, unnest(tickers) AS ticker, generate_subscripts(tickers, 1) AS p FROM entities),
n AS (SELECT event_id, string_agg(ticker || '=' || coalesce(name, '?'), ';' ORDER BY p) AS s FROM x LEFT JOIN tickers USING (ticker) GROUP BY 1) SELECT event_id, coalesce(s, '') AS named FROM entities LEFT JOIN n USING (event_id)""")
def q_J03_named_tickers(t: Tables) -> DataFrame:
    named = serving.named_tickers(t.entities, t.tickers)
    return named.select("event_id", F.array_join(F.transform("tickers", lambda x: F.concat(x["ticker"], F.lit("="), F.coalesce(x["name"], F.lit("?")))), ";").alias("named"))


@book.query("SELECT event_id, string_agg(article_id || ':' || source_type, ';' ORDER BY published, article_id) AS members FROM articles GROUP BY event_id")
def q_J04_members(t: Tables) -> DataFrame:
    m = serving.members(t.entities, t.articles)
    return m.select("event_id", F.array_join(F.transform("members", lambda x: F.concat(x["article_id"], F.lit(":"), x["source_type"])), ";").alias("members"))


@book.query(f"""WITH hit AS (SELECT event_id FROM (SELECT event_id, unnest(tickers) AS ticker FROM entities) JOIN tickers USING (ticker) WHERE contains(lower(name), '110') OR contains(ticker, '110')
  UNION SELECT event_id FROM entities WHERE contains(lower(title), '110')) SELECT event_id FROM entities SEMI JOIN hit USING (event_id) WHERE {_READY}""")
def q_E09_search(t: Tables) -> DataFrame:
    return serving.search(t.entities, t.tickers, " 110 ").select("event_id")


# Events of half a day's steps in pairs, so that some lie exactly 60 days apart, some of 21 tickers, without categories or time.
_STORIES = f"""stories AS (SELECT * REPLACE (CASE WHEN k % 41 = 40 THEN NULL ELSE (1735689600 + (k // 2) * 43200 * (1 + (k % 10 = 2)::INT * 60))::BIGINT END AS occurred,
  CASE WHEN k % 20 = 7 THEN list_transform(range(1100, 1121), lambda x: CAST(x AS VARCHAR)) ELSE tickers END AS tickers, CASE WHEN k % 30 = 11 THEN [] ELSE categories END AS categories) FROM entities),
ready AS (SELECT * FROM stories WHERE {_READY})"""
_LINES = """(SELECT a.event_id AS anchor_id, e.event_id, e.occurred, a.event_id = e.event_id AS is_current,
  row_number() OVER (PARTITION BY a.event_id ORDER BY e.occurred DESC NULLS LAST, a.event_id = e.event_id DESC, e.event_id DESC) AS place
  FROM {anchors} a JOIN {events} e ON a.event_id = e.event_id OR list_contains(e.tickers, a.tickers[1]) AND len(e.tickers) <= 20 AND list_has_any(e.categories, a.categories) AND e.occurred <= a.occurred AND e.occurred >= a.occurred - 60 * 86400
  WHERE len(a.tickers) > 0 AND len(a.categories) > 0)"""


def _stories(t: Tables) -> DataFrame:
    k = F.col("k")
    spread = (F.lit(1735689600) + F.floor(k / 2) * 43200 * (1 + (k % 10 == 2).cast("int") * 60)).cast("long")
    market = F.transform(F.sequence(F.lit(1100), F.lit(1120)), lambda x: x.cast("string"))
    return t.entities.withColumns({
        "occurred": F.when(k % 41 != 40, spread),
        "tickers": F.when(k % 20 == 7, market).otherwise(F.col("tickers")),
        "categories": F.when(k % 30 == 11, F.array().cast("array<string>")).otherwise(F.col("categories")),
    })


@book.query(f"WITH {_STORIES} SELECT anchor_id, event_id, occurred, is_current FROM {_LINES.format(anchors='ready', events='ready')} WHERE place <= 6")
def q_J10_timeline(t: Tables) -> DataFrame:
    return serving.timeline(_stories(t))


@book.query("""WITH a AS (SELECT event_id AS id, tickers[1] AS ticker, DATE '1995-03-01' + ((k * 17) % 2200)::INT AS day FROM entities), j AS (SELECT a.*, date, close FROM a JOIN bars USING (ticker))
SELECT id, date, round(close, 6) AS close, (1 - k)::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS k FROM j WHERE date <= day) WHERE k <= 6
UNION ALL SELECT id, date, round(close, 6), k::INT FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) AS k FROM j WHERE date > day) WHERE k <= 5""", days=("date",))
def q_J15_around(t: Tables) -> DataFrame:
    day = F.date_add(F.lit("1995-03-01").cast("date"), ((F.col("k") * 17) % 2200).cast("int"))
    anchors = t.entities.select(F.col("event_id").alias("id"), F.get("tickers", F.lit(0)).alias("ticker"), day.alias("day"))
    return serving.around(t.bars, anchors).select("id", "date", F.round("close", 6).alias("close"), F.col("place").cast("int").alias("place"))


@book.query(f"SELECT DISTINCT make_timestamp(occurred * 1000000)::DATE AS day FROM entities WHERE {_READY} ORDER BY day DESC LIMIT 30", days=("day",))
def q_A20_days(t: Tables) -> DataFrame:
    return serving.catalogue_days(t.entities)


@book.query(f"""WITH r AS (SELECT *, row_number() OVER (ORDER BY {_RANK}) AS r FROM entities WHERE {_READY}), c AS (SELECT r, unnest(categories) AS category, generate_subscripts(categories, 1) AS p FROM r),
m AS (SELECT category, min(r * 100 + p) AS k FROM c GROUP BY 1 UNION ALL SELECT '全部', 0) SELECT category, (row_number() OVER (ORDER BY k) - 1)::INT AS place FROM m""")
def q_A21_categories(t: Tables) -> DataFrame:
    return serving.categories_seen(t.entities).withColumn("place", F.col("place").cast("int"))


@book.query("SELECT DISTINCT ticker FROM (SELECT unnest(tickers) AS ticker FROM entities WHERE market_validation IS NULL UNION ALL SELECT unnest(['2330', '0050', '2317'])) WHERE regexp_full_match(ticker, '[1-9][0-9]{3}')")
def q_A22_demand(t: Tables) -> DataFrame:
    return bars.demand(t.entities, ["2330", "0050", "2317"], F.col("market_validation").isNotNull())


@book.query(f"""WITH x AS (SELECT DISTINCT event_id, greatest(coalesce(source_count, 0), 1) AS w, industry FROM (SELECT *, unnest(tickers) AS ticker FROM entities WHERE {_READY}) JOIN tickers USING (ticker) WHERE industry IS NOT NULL),
a AS (SELECT industry, count(*) AS e, sum(w) AS s FROM x GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY s DESC, industry) AS r FROM a),
g AS (SELECT CASE WHEN r <= 3 THEN industry ELSE 'other' END AS industry, sum(e)::BIGINT AS events, sum(s)::BIGINT AS articles FROM k GROUP BY 1) SELECT *, round(100.0 * articles / sum(articles) OVER (), 6) AS share_pct FROM g""")
def q_A17_industry_heat(t: Tables) -> DataFrame:
    return serving.industry_heat(t.entities, t.tickers, 3).withColumn("share_pct", F.col("share_pct").cast("double"))


@book.query("SELECT stage, count(*) AS n, max(published) AS latest FROM articles GROUP BY stage")
def q_A08_stages(t: Tables) -> DataFrame:
    return t.articles.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.max("published").alias("latest"))


@book.query("SELECT title, count(*) AS n, string_agg(article_id, ',' ORDER BY article_id) AS ids, floor((max(published) - min(published)) / 86400)::BIGINT AS span FROM articles GROUP BY title HAVING count(*) > 1")
def q_A11_A12_same_title(t: Tables) -> DataFrame:
    g = t.articles.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("article_id")), ",").alias("ids"), F.floor((F.max("published") - F.min("published")) / 86400).cast("long").alias("span"))
    return g.filter("n > 1")


@book.query("SELECT c AS category, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM entities WHERE title IS NOT NULL), 6)::DOUBLE AS pct FROM (SELECT unnest(categories) AS c FROM entities WHERE title IS NOT NULL) GROUP BY c ORDER BY n DESC, c LIMIT 1")
def q_A14_top_category(t: Tables) -> DataFrame:
    e = t.entities.filter("title is not null")
    top = e.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(1)
    return top.crossJoin(e.agg(F.count(F.lit(1)).alias("t"))).select("category", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).cast("double").alias("pct"))


_OFFICIAL = "EXISTS (SELECT 1 FROM articles a WHERE a.event_id = e.event_id AND a.source_type IN ('official', 'gov'))"


@book.query(f"SELECT stars::BIGINT AS stars, count(*) AS n, round(avg((coalesce(source_count, 0) >= 4 OR {_OFFICIAL})::INT), 6) AS recall FROM entities e WHERE stars IS NOT NULL GROUP BY stars")
def q_A15_recall_by_star(t: Tables) -> DataFrame:
    official = t.articles.filter("source_type in ('official', 'gov')").select(F.col("event_id").alias("_o")).distinct()
    e = t.entities.filter("stars is not null").join(official, F.col("event_id") == F.col("_o"), "left")
    keep = (F.coalesce("source_count", F.lit(0)) >= 4) | F.col("_o").isNotNull()
    return e.groupBy(F.col("stars").cast("long").alias("stars")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(keep.cast("int")), 6).alias("recall"))


_WAITING = "title IS NULL AND EXISTS (SELECT 1 FROM articles a WHERE a.event_id = e.event_id AND a.stage = 'clustered')"
_ROUTINE = gates.ROUTINE


@book.query(f"SELECT event_id FROM entities e WHERE {_WAITING} AND (coalesce(source_count, 0) >= 4 OR ({_OFFICIAL} AND NOT regexp_matches(representative_title, '{_ROUTINE}')))")
def q_Q02_must_send(t: Tables) -> DataFrame:
    return gates.must_send(t.entities, t.articles, min_sources=4, min_members=99).select("event_id")


@book.query(f"""WITH s AS (SELECT event_id FROM entities e WHERE k % 10 = 4)
SELECT article_id FROM articles a WHERE stage = 'clustered' AND published < 1740000000 - 7 * 86400 AND EXISTS (SELECT 1 FROM entities e WHERE e.event_id = a.event_id AND e.title IS NULL) AND event_id NOT IN (SELECT event_id FROM s)""")
def q_Q03_expired(t: Tables) -> DataFrame:
    return gates.expired(t.articles, t.entities, 1740000000, t.entities.filter("k % 10 = 4")).select("article_id")


@book.query("SELECT CASE WHEN trim(coalesce(title, '')) = '' THEN '無標題' WHEN length(trim(content)) < 400 THEN '內文過短（<400 字）' END AS reason, count(*) AS n FROM articles WHERE stage = 'pending' GROUP BY 1")
def q_Q01_prescreen(t: Tables) -> DataFrame:
    rows = t.articles.filter("stage = 'pending'").withColumn("reason", gates.rejection(F.col("title"), F.col("content"), 400))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@book.query(f"SELECT event_id, CASE WHEN status = 'official_confirmed' AND NOT {_OFFICIAL} THEN 'developing' ELSE status END AS status FROM entities e")
def q_Q07_official_guard(t: Tables) -> DataFrame:
    return gates.guard_official(t.entities, t.articles).select("event_id", "status")


@book.query("SELECT e.event_id FROM entities e WHERE EXISTS (SELECT 1 FROM articles a WHERE a.event_id = e.event_id AND a.stage = 'clustered')")
def q_J07_semi(t: Tables) -> DataFrame:
    return t.entities.join(t.articles.filter("stage = 'clustered'"), "event_id", "left_semi").select("event_id")


@book.query("SELECT event_id, t AS ticker FROM (SELECT event_id, unnest(tickers) AS t FROM entities) x WHERE NOT EXISTS (SELECT 1 FROM tickers k WHERE k.ticker = x.t)")
def q_J08_anti(t: Tables) -> DataFrame:
    return t.entities.select("event_id", F.explode("tickers").alias("ticker")).join(t.tickers, "ticker", "left_anti").select("event_id", "ticker")


@book.query("""SELECT count(*) AS items, count(*) FILTER (WHERE p = 0) AS valid, count(DISTINCT url) AS distinct_urls, round(count(*) FILTER (WHERE p = 0) / count(*), 6) AS valid_rate, round(count(DISTINCT url) / count(*), 6) AS unique_rate
FROM (SELECT url, (length(trim(title)) < 4)::INT + (length(trim(content)) < 40)::INT + (n % 13 = 0)::INT AS p FROM articles)""")
def q_Q04_funnel(t: Tables) -> DataFrame:
    published = F.when(F.col("n") % 13 == 0, F.lit("")).otherwise(F.col("published").cast("string"))
    problems = gates.item_problems(F.col("title"), F.col("url"), F.col("content"), published, ["example.com"])
    return gates.funnel(t.articles, problems)


_BLOCKED = "|".join(gates.BLOCK_PAGES).replace("'", "''")
_ITEMS = "SELECT source, CASE WHEN source IN ('src1', 'src2') AND n % 2 = 0 THEN 'Just a Moment...' ELSE title END AS title, CASE WHEN source = 'src4' THEN 'Service' || chr(10) || 'Unavailable' WHEN source = 'src6' THEN ' ' ELSE content END AS content FROM articles"


@book.query(rf"""WITH i AS ({_ITEMS}), r AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE regexp_matches(coalesce(title, '') || ' ' || substr(coalesce(content, ''), 1, 800), '{_BLOCKED}', 'is')) AS hits,
  count(DISTINCT substr(content, 1, 200)) FILTER (WHERE trim(content) <> '') AS leads FROM i GROUP BY source),
a AS (SELECT *, n >= 3 AND leads > 0 AND leads <= greatest(1, n // 5) AS near_identical FROM r)
SELECT source, n, CASE WHEN hits / n >= 0.5 OR near_identical THEN 'block' ELSE 'content' END AS verdict, round(hits / n, 2) AS block_ratio, near_identical FROM a""")
def q_Q05_block_page(t: Tables) -> DataFrame:
    blocked = F.col("source").isin("src1", "src2") & (F.col("n") % 2 == 0)
    content = F.when(F.col("source") == "src4", "Service\nUnavailable").when(F.col("source") == "src6", " ").otherwise(F.col("content"))
    items = t.articles.select("source", F.when(blocked, "Just a Moment...").otherwise(F.col("title")).alias("title"), content.alias("content"))
    return gates.block_page(items, ["source"])


@book.query("SELECT article_id, CASE WHEN stage = 'clustered' AND n % 3 = 0 THEN 'summarized' ELSE stage END AS stage FROM articles")
def q_ST1_advance(t: Tables) -> DataFrame:
    ids = t.articles.filter("n % 3 = 0").select("article_id")
    return gates.advance(t.articles, ids, "clustered", "summarized").select("article_id", "stage")


@book.query(f"""WITH b AS (SELECT event_id AS anchor_id, tickers[1] AS ticker, categories AS mine FROM entities WHERE k % 10 = 0 AND len(tickers) > 0 AND len(categories) > 0)
SELECT anchor_id, make_timestamp(occurred * 1000000)::DATE AS date, title, event_id, event_id = anchor_id AS is_current FROM entities JOIN b ON list_contains(tickers, ticker) AND list_has_any(categories, mine) WHERE {_READY}""", days=("date",))
def q_E03_timelines(t: Tables) -> DataFrame:
    return reads.timelines_of(t.entities, t.entities.filter("k % 10 = 0")).select("anchor_id", "date", "title", "event_id", "is_current")


@book.query(f"""WITH r AS (SELECT *, make_timestamp(occurred * 1000000)::DATE AS day FROM entities WHERE {_READY} AND list_contains(tickers, '2330'))
SELECT 'week' AS kind, event_id FROM (SELECT * FROM r WHERE day >= DATE '2025-01-10' - 7 ORDER BY {_RANK} LIMIT 20) UNION ALL SELECT 'today', event_id FROM r WHERE day = DATE '2025-01-10'
UNION ALL SELECT 'all', event_id FROM (SELECT * FROM r ORDER BY {_RANK} LIMIT 20 OFFSET 1)""")
def q_E05_F09_ranges(t: Tables) -> DataFrame:
    part = lambda kind, keyword, **more: reads.in_range(t.entities, "2330", keyword, "2025-01-10", **more).select(F.lit(kind).alias("kind"), "event_id")
    return part("week", "week").unionByName(part("today", "no such range")).unionByName(part("all", "all", offset=1))


@book.query(f"SELECT event_id, row_number() OVER (ORDER BY {_RANK}) AS place FROM entities WHERE {_READY} AND make_timestamp(occurred * 1000000)::DATE = DATE '2025-01-03'")
def q_E07_day(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = reads.events_of(t.entities, "2025-01-03").limit(300)
    return rows.select("event_id", F.row_number().over(Window.orderBy(*serving.ranking())).cast("long").alias("place"))


_ANCHORS = "SELECT event_id AS id, tickers[1] AS ticker, DATE '1995-03-01' + ((k * 17) % 2200)::INT AS day FROM entities WHERE len(tickers) > 0"


@book.query(f"""WITH {_DERIVED}, xa AS ({_ANCHORS}), xj AS (SELECT xa.id, xa.day, c.* FROM xa JOIN chips c USING (ticker)),
xs AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date DESC) AS up FROM xj WHERE date <= day), xd AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) AS down FROM xj WHERE date > day),
xr AS (SELECT * EXCLUDE (up), 1 - up AS place FROM xs WHERE up <= 6 UNION ALL SELECT * EXCLUDE (down), down FROM xd WHERE down <= 5)
SELECT id, ticker, (count(*) FILTER (WHERE place < 0))::INT AS event_index, max(date) AS as_of, round(max(return_5d) FILTER (WHERE place = 0), 6) AS return_5d, round(coalesce(max(volume_ratio_vs_avg20) FILTER (WHERE place = 0), 1), 6) AS volume_ratio,
  coalesce(max(foreign_consecutive_days) FILTER (WHERE place = 0), 0)::INT AS run, string_agg(date::VARCHAR || ':' || foreign_net::VARCHAR, ',' ORDER BY date) AS series FROM xr GROUP BY id, ticker HAVING max(close) FILTER (WHERE place = 0) <> 0""", days=("as_of",))
def q_E14_reactions(t: Tables) -> DataFrame:
    day = F.date_add(F.lit("1995-03-01").cast("date"), ((F.col("k") * 17) % 2200).cast("int"))
    anchors = t.entities.select(F.col("event_id").alias("id"), F.get("tickers", F.lit(0)).alias("ticker"), day.alias("day"))
    r = reads.reactions(bars.derive(t.bars), anchors)
    series = F.array_join(F.transform("series", lambda x: F.concat_ws(":", x["date"].cast("string"), x["foreign_net"].cast("string"))), ",")
    return r.select("id", "ticker", "event_index", "as_of", F.round("return_5d", 6).alias("return_5d"), F.round("volume_ratio", 6).alias("volume_ratio"), F.col("foreign_consecutive_days").cast("int").alias("run"), series.alias("series"))


@book.query(f"""WITH {_DERIVED}, pd AS (SELECT DISTINCT make_timestamp(occurred * 1000000)::DATE AS day FROM entities WHERE {_READY} ORDER BY day DESC LIMIT 2), pe AS (SELECT * FROM entities WHERE {_READY} AND make_timestamp(occurred * 1000000)::DATE IN (SELECT day FROM pd) ORDER BY {_RANK} LIMIT 12),
pu AS (SELECT event_id, string_agg(url, ' ' ORDER BY published, article_id) AS urls, count(*) AS n FROM articles GROUP BY 1), pr AS (SELECT * FROM entities WHERE {_READY}),
pl AS (SELECT anchor_id AS event_id, string_agg(event_id || CASE WHEN is_current THEN '*' ELSE '' END, ' ' ORDER BY occurred, event_id) AS timeline FROM {_LINES.format(anchors="pe", events="pr")} WHERE place <= 6 GROUP BY 1),
xj AS (SELECT pe.event_id AS id, pe.day0 AS day, c.* FROM (SELECT *, (make_timestamp(occurred * 1000000)::DATE - 10957)::DATE AS day0 FROM pe) pe JOIN chips c ON c.ticker = pe.tickers[1]),
xr AS (SELECT *, 1 - row_number() OVER (PARTITION BY id ORDER BY date DESC) AS place FROM xj WHERE date <= day QUALIFY place > -6 UNION ALL SELECT *, row_number() OVER (PARTITION BY id ORDER BY date) AS place FROM xj WHERE date > day QUALIFY place <= 5),
xm AS (SELECT id AS event_id, ticker || ':' || (count(*) FILTER (WHERE place < 0))::VARCHAR || ':' || max(date)::VARCHAR || ':' || string_agg(date::VARCHAR, ',' ORDER BY date) AS reaction FROM xr GROUP BY id, ticker HAVING max(close) FILTER (WHERE place = 0) <> 0)
SELECT event_id, title, len(coalesce(tickers, []))::INT AS tickers, n::INT AS members, urls, timeline, reaction FROM pe JOIN pu USING (event_id) LEFT JOIN pl USING (event_id) LEFT JOIN xm USING (event_id)""")
def q_E06_E08_start_page(t: Tables) -> DataFrame:
    """The bars lie 30 years before the events: their dates are moved for reactions to meet them."""
    moved = bars.derive(t.bars).withColumn("date", F.date_add("date", 10957))
    p = reads.start_page(t.entities, t.articles, t.tickers, moved)
    back = lambda d: F.date_sub(d, 10957).cast("string")
    line = F.array_join(F.transform("timeline", lambda x: F.concat(x["id"], F.when(x["is_current"], "*").otherwise(""))), " ")
    r = F.col("reaction")
    market = F.when(r.isNotNull(), F.concat_ws(":", r["ticker"], r["event_index"].cast("string"), back(r["as_of"]), F.array_join(F.transform(r["series"], lambda x: back(x["date"])), ",")))
    return p.select("event_id", "title", F.size("named").alias("tickers"), F.size("members").alias("members"), F.array_join("urls", " ").alias("urls"), line.alias("timeline"), market.alias("reaction"))


_CATEGORIES = ("財報", "法說", "政策", "關稅", "AI/科技", "產業供需", "營收", "法人動向", "技術突破")
_OUTPUT = """SELECT event_id, k, title, CASE WHEN k % 13 = 0 THEN ' ' || chr(12288) ELSE 'text' END AS summary, CASE WHEN k % 17 = 3 THEN NULL ELSE 'then' END AS occurred_at_text, 'note' AS confidence_note, status, expected_direction, confidence AS direction_confidence,
  CASE WHEN k % 19 = 1 THEN CASE WHEN categories IS NOT NULL THEN list_concat(categories, categories) END WHEN k % 19 = 2 THEN [] ELSE categories END AS categories, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN '2025-01-0' || CAST(1 + k % 9 AS VARCHAR) WHEN 2 THEN '2025-01-03T04:05:06+08:00' WHEN 3 THEN 'soon' ELSE '2031-01-01T00:00:00Z' END AS occurred_at_iso,
  CASE WHEN k % 7 = 2 THEN ['x123'] ELSE tickers END AS related_tickers, CASE WHEN k % 3 = 0 THEN ['ASIA', 'ASIA'] WHEN k % 3 = 1 THEN ['MARS'] ELSE [] END AS industries FROM entities"""


def _generated(t: Tables) -> DataFrame:
    k, none = F.col("k"), F.array().cast("array<string>")
    iso = F.when(k % 5 == 1, F.concat(F.lit("2025-01-0"), 1 + k % 9)).when(k % 5 == 2, "2025-01-03T04:05:06+08:00").when(k % 5 == 3, "soon").when(k % 5 == 4, "2031-01-01T00:00:00Z")
    return t.entities.select(
        "event_id", "k", "title", F.when(k % 13 == 0, " \u3000").otherwise("text").alias("summary"), F.when(k % 17 != 3, "then").alias("occurred_at_text"), F.lit("note").alias("confidence_note"), "status", "expected_direction",
        F.col("confidence").alias("direction_confidence"), F.when(k % 19 == 1, F.concat("categories", "categories")).when(k % 19 == 2, none).otherwise(F.col("categories")).alias("categories"), iso.alias("occurred_at_iso"),
        F.when(k % 7 == 2, F.array(F.lit("x123"))).otherwise(F.col("tickers")).alias("related_tickers"), F.when(k % 3 == 0, F.array(F.lit("ASIA"), F.lit("ASIA"))).when(k % 3 == 1, F.array(F.lit("MARS"))).otherwise(none).alias("industries"),
    )


@book.query(f"""WITH g AS ({_OUTPUT}), m AS (SELECT event_id, list_filter([CASE WHEN title IS NULL THEN 'title: missing' END, CASE WHEN occurred_at_text IS NULL THEN 'occurred_at_text: missing' END, CASE WHEN categories IS NULL THEN 'categories: missing' END, CASE WHEN related_tickers IS NULL THEN 'related_tickers: missing' END], lambda x: x IS NOT NULL) AS missing,
  list_filter([CASE WHEN trim(title) = '' THEN 'title: empty' END, CASE WHEN k % 13 = 0 THEN 'summary: empty' END, CASE WHEN status NOT IN ('official_confirmed', 'rumor_unconfirmed', 'developing', 'market_reacting') THEN 'status: illegal' END, CASE WHEN len(categories) = 0 THEN 'categories: empty' END,
   CASE WHEN len(list_filter(categories, lambda x: x NOT IN {_CATEGORIES})) > 0 THEN 'categories: illegal' END, CASE WHEN len(list_distinct(categories)) < len(categories) THEN 'categories: repeated' END, CASE WHEN k % 3 = 1 THEN 'industries: illegal' END, CASE WHEN k % 3 = 0 THEN 'industries: repeated' END,
   CASE WHEN k % 5 = 3 THEN 'occurred_at_iso: unreadable' END, CASE WHEN k % 5 = 4 THEN 'occurred_at_iso: future' END, CASE WHEN len(list_filter(related_tickers, lambda x: NOT regexp_matches(x, '^[0-9]{{4}}'))) > 0 THEN 'related_tickers: illegal' END], lambda x: x IS NOT NULL) AS faults FROM g)
SELECT event_id, array_to_string(CASE WHEN len(missing) > 0 THEN missing ELSE faults END, ';') AS problems FROM m""")
def q_Q06_output_problems(t: Tables) -> DataFrame:
    problems = contracts.output_problems(_CATEGORIES, ("ASIA", "EUROPE"), 1767225600)
    return _generated(t).select("event_id", F.array_join(problems, ";").alias("problems"))


@book.query(f"""WITH g AS ({_OUTPUT}), c AS (SELECT event_id AS case_id, k, occurred_at_iso AS iso, related_tickers AS rt, status, expected_direction AS dir FROM g)
SELECT case_id, 'occurred_at_within_published' AS key, CASE k % 5 WHEN 0 THEN true WHEN 1 THEN CAST(iso AS DATE) <= DATE '2025-01-05' WHEN 2 THEN true ELSE false END AS passed FROM c WHERE k % 2 = 0
UNION ALL SELECT case_id, 'related_tickers_allowed', coalesce(len(list_filter(rt, lambda x: x NOT IN ('2330', '0050'))) = 0, false) FROM c UNION ALL SELECT case_id, 'status_not', status <> 'developing' FROM c UNION ALL SELECT case_id, 'expected_direction', dir = '利多' FROM c WHERE k % 3 <> 1""")
def q_Q15_D12_regression(t: Tables) -> DataFrame:
    k = F.col("k")
    cases = _generated(t).select(
        F.col("event_id").alias("case_id"), "occurred_at_iso", F.array(F.lit("2025-01-02T09:00:00"), F.lit("2025-01-03T17:30:00Z")).alias("published"), "related_tickers", "status", "expected_direction",
        (k % 2 == 0).alias("within_published"), F.array(F.lit("2330"), F.lit("0050")).alias("tickers_allowed"), F.lit("developing").alias("status_not"), F.when(k % 3 != 1, "利多").alias("direction_is"),
    )
    return contracts.regression_checks(cases)


_TAGGED = "SELECT *, CASE WHEN n % 5 = 0 THEN NULL WHEN n % 5 = 1 THEN [] ELSE [CAST(1100 + n % 7 AS VARCHAR), CAST(1100 + n % 3 AS VARCHAR)] END AS related_tickers FROM articles"


def _tagged(t: Tables) -> DataFrame:
    n = F.col("n")
    pair = F.array((1100 + n % 7).cast("string"), (1100 + n % 3).cast("string"))
    return t.articles.withColumn("related_tickers", F.when(n % 5 == 1, F.array().cast("array<string>")).when(n % 5 != 0, pair))


@book.query(f"WITH g AS (SELECT event_id, unnest(related_tickers) AS x FROM ({_TAGGED})) SELECT event_id, coalesce((SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM g WHERE g.event_id = e.event_id), '') AS tickers FROM entities e")
def q_J12_A13_member_tickers(t: Tables) -> DataFrame:
    return assemble.member_tickers(t.entities, _tagged(t)).select("event_id", F.array_join("tickers", ",").alias("tickers"))


@book.query(f"""WITH g AS (SELECT *, make_timestamp(published * 1000000)::DATE AS day FROM ({_TAGGED})), u AS (SELECT event_id, x, min(n * 10 + p) AS k FROM (SELECT event_id, n, unnest(related_tickers) AS x, generate_subscripts(related_tickers, 1) AS p FROM g) GROUP BY 1, 2),
a AS (SELECT event_id AS event, count(*)::INT AS members, count(DISTINCT source)::INT AS source_count, min(day) AS date_start, max(day) AS date_end, substr(sha1(string_agg(article_id, '' ORDER BY article_id)), 1, 8) AS h FROM g GROUP BY 1),
r AS (SELECT a.*, coalesce((SELECT string_agg(x, ',' ORDER BY k) FROM u WHERE u.event_id = event), '') AS related_tickers FROM a)
SELECT event, members, source_count, date_start, date_end, related_tickers, 'evt_' || strftime(date_start, '%Y%m%d') || '_' || CASE WHEN related_tickers = '' THEN 'NA' ELSE split_part(related_tickers, ',', 1) END || '_' || h AS event_id FROM r""", days=("date_start", "date_end"))
def q_A26_S04_event_objects(t: Tables) -> DataFrame:
    rows = _tagged(t).select(F.col("event_id").alias("event"), F.col("n").alias("place"), "article_id", "source", "title", "url", F.col("related_tickers").alias("tickers"), F.to_date(F.timestamp_seconds("published")).alias("day"))
    return assemble.event_objects(rows).select("event", F.size("members").alias("members"), "source_count", "date_start", "date_end", F.array_join("related_tickers", ",").alias("related_tickers"), "event_id")


@book.query("SELECT article_id, row_number() OVER (ORDER BY latest DESC, event_id, published, article_id) AS place FROM (SELECT *, max(published) OVER (PARTITION BY event_id) AS latest FROM articles)")
def q_W03_newest_first(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = assemble.newest_events_first(t.articles)
    return rows.select("article_id", F.row_number().over(Window.orderBy(F.desc("latest"), "event_id", "published", "article_id")).cast("long").alias("place"))


@book.query("SELECT event_id FROM entities ORDER BY market_validation DESC NULLS LAST, stars DESC NULLS LAST, event_id LIMIT 25")
def q_S07_by_score(t: Tables) -> DataFrame:
    return assemble.sorted_by(t.entities, "score").select("event_id").limit(25)


@book.query("WITH d AS (SELECT DISTINCT unnest(tickers) AS ticker FROM entities) SELECT ticker, 0 AS priority FROM d UNION ALL SELECT ticker, 1 FROM tickers WHERE ticker NOT IN (SELECT ticker FROM d)")
def q_S09_fetch_queue(t: Tables) -> DataFrame:
    return assemble.fetch_queue(t.entities.select(F.explode("tickers").alias("ticker")), t.tickers)


@book.query(f"SELECT article_id, {_FEATURE} AS feature FROM articles")
def q_X20_feature_text(t: Tables) -> DataFrame:
    return t.articles.select("article_id", text.feature_text(F.col("title"), F.col("content")).alias("feature"))


def _topics() -> list[topic.Classifier]:
    """Two made-up topics, so that the SQL can state them: coefficients by a rule, in 64ths."""
    return [
        topic.Classifier("finance", tuple(((k * 37) % 101 - 50) / 64 for k in range(topic.DIMENSIONS)), 0.25, 2.0, -0.5, 0.55, 0.35),
        topic.Classifier("public_policy", tuple(((k * 53) % 89 - 44) / 64 for k in range(topic.DIMENSIONS)), -0.5, 1.5, 0.25, 0.6, 0.4),
    ]


_TOPICS = f"""f AS (SELECT article_id, source, {_FEATURE} AS t FROM articles), g AS (SELECT *, list_distinct(list_transform(range(1, length(t) - 1), lambda i: ('0x' || substr(md5(substr(t, i, 3)), 1, 4))::INT % 128)) AS b FROM f),
raw AS (SELECT article_id, source, coalesce(list_sum(list_transform(b, lambda k: ((k * 37) % 101 - 50) / 64)) / sqrt(len(b)), 0) + 0.25 AS r1, coalesce(list_sum(list_transform(b, lambda k: ((k * 53) % 89 - 44) / 64)) / sqrt(len(b)), 0) - 0.5 AS r2 FROM g),
s AS (SELECT article_id, source, round(1 / (1 + exp(-(2.0::DOUBLE * r1 - 0.5::DOUBLE))), 6) AS finance, round(1 / (1 + exp(-(1.5::DOUBLE * r2 + 0.25::DOUBLE))), 6) AS policy FROM raw),
d AS (SELECT *, CASE WHEN finance >= 0.55 OR policy >= 0.6 THEN 'accept' WHEN finance <= 0.35 AND policy <= 0.4 THEN 'reject' ELSE 'review' END AS decision FROM s)"""


@book.query(f"WITH {_TOPICS} SELECT article_id, finance, policy, concat_ws(',', CASE WHEN finance >= 0.55 THEN 'finance' END, CASE WHEN policy >= 0.6 THEN 'public_policy' END) AS labels, decision FROM d")
def q_Q16_topics(t: Tables) -> DataFrame:
    found = topic.classify(t.articles, _topics())
    return found.select("article_id", F.col("score_finance").alias("finance"), F.col("score_public_policy").alias("policy"), F.array_join("labels", ",").alias("labels"), "decision")


@book.query(f"""WITH {_TOPICS}, c AS (SELECT source, count(*) FILTER (WHERE decision = 'accept') AS relevant_count, count(*) FILTER (WHERE decision = 'review') AS review_count, count(*) FILTER (WHERE decision = 'reject') AS reject_count, count(*) AS n FROM d GROUP BY source)
SELECT source, relevant_count, review_count, reject_count, round(relevant_count / n, 3) AS relevant_ratio, relevant_count >= 5 AND relevant_count / n >= 0.3 AS gate_pass, relevant_count >= 5 AND relevant_count / n >= 0.3 AS passes FROM c""")
def q_Q17_topic_gate(t: Tables) -> DataFrame:
    return topic.gate(topic.classify(t.articles, _topics()), ["source"], 5, 0.3)


@book.query()
def q_Q20_train_topics(t: Tables) -> DataFrame:
    """Two languages as topics of the documents, learnt, calibrated and measured on other documents."""
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    split = F.when(part < 6, "train").when(part < 8, "calibration").otherwise("test")
    rows = t.articles.join(t.documents.select("doc_id", "lang"), F.col("n") == F.col("doc_id")).select("title", "content", split.alias("split"), *((F.col("lang") == x).cast("int").alias(x) for x in ("en", "es")))
    _, metrics = topic.train(rows, ["en", "es"], min_precision=0.8, min_npv=0.8, least=5)
    return metrics


@book.query("""WITH r AS (SELECT user_id, event_id, month(ts) AS m FROM events), l AS (SELECT *, coalesce((m > lag(m) OVER (PARTITION BY user_id ORDER BY event_id))::INT, 0) AS up FROM r)
SELECT event_id, (2026 - sum(up) OVER (PARTITION BY user_id ORDER BY event_id))::INT AS year FROM l""")
def q_W16_years(t: Tables) -> DataFrame:
    return dates.years_of(t.events.withColumn("m", F.month("ts")), "user_id", "event_id", "m", 2026).select("event_id", "year")


@book.query("""SELECT event_id, strftime(ts, '%m/%d') AS shown, (ts::DATE - 1)::VARCHAR AS before, n, first FROM (SELECT *, 1 + event_id % 4 AS n, (date_diff('day', DATE '1970-01-01', ts::DATE) * 86400 - 28800)::BIGINT AS first FROM events)""")
def q_D13_D14_D16_days(t: Tables) -> DataFrame:
    day = F.to_date("ts")
    windows = dates.request_windows(day, F.date_add(day, (F.col("event_id") % 4).cast("int")))
    return t.events.select("event_id", dates.month_day(F.col("ts")).alias("shown"), dates.previous_day(day).cast("string").alias("before"), F.size(windows).cast("long").alias("n"), F.get(windows, F.lit(0))["first"].alias("first"))
