"""Merges, repairs, audits, evaluation, similarity: registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import bars, cluster, evaluate, merge, upkeep
from tidemark.plans.book import Book, Tables

book = Book()


@book.query("""WITH o AS (SELECT doc_id, source, n_chars FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, min(source) AS source, min(n_chars) AS n_chars FROM documents WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT * FROM o UNION ALL SELECT * FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)""")
def q_SNK1_insert_new(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "n_chars")
    return merge.insert_new(d.filter("doc_id % 3 <> 0"), d.filter("doc_id % 2 = 0"), ["doc_id"], "source")


@book.query("""WITH o AS (SELECT doc_id, source, n_chars, lang FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT doc_id, 'new' AS source, n_chars + 1 AS n_chars, 'xx' AS lang FROM documents WHERE doc_id % 2 = 0)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, coalesce(n.source, o.source) AS source, coalesce(n.n_chars, o.n_chars) AS n_chars, CASE WHEN o.doc_id IS NULL THEN n.lang ELSE o.lang END AS lang FROM o FULL JOIN n ON o.doc_id = n.doc_id""")
def q_SNK2_upsert(t: Tables) -> DataFrame:
    d = t.documents.select("doc_id", "source", "n_chars", "lang")
    new = d.filter("doc_id % 2 = 0").select("doc_id", F.lit("new").alias("source"), (F.col("n_chars") + 1).alias("n_chars"), F.lit("xx").alias("lang"))
    return merge.upsert(d.filter("doc_id % 3 <> 0"), new, ["doc_id"], ["source", "n_chars"])


@book.query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def q_W14_latest(t: Tables) -> DataFrame:
    return merge.latest(t.events, ["user_id"], "event_id").select("user_id", "event_id", "event_type")


_RUNS = """SELECT event_id AS seq, CASE user_id % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'p' || CAST(user_id AS VARCHAR) END AS source_prefix, CASE WHEN user_id % 7 = 1 THEN NULL ELSE 's' || CAST(user_id AS VARCHAR) END AS site_name,
  CASE event_id % 5 WHEN 0 THEN 'escalated' WHEN 1 THEN 'error' ELSE 'success' END AS status, CASE WHEN event_id % 6 = 5 THEN NULL ELSE event_id % 3 END AS retry_count, CASE WHEN event_id % 4 = 3 THEN NULL ELSE event_id % 8 END AS repair_count,
  CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS first_pass_success, CASE WHEN event_id % 9 = 8 THEN NULL ELSE event_id % 100 END AS coder_tokens FROM events"""


@book.query(f"""WITH r AS ({_RUNS}), l AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(source_prefix, ''), site_name, '?') ORDER BY seq DESC) = 1)
SELECT count(*) AS sites_distinct, count(*) FILTER (WHERE status = 'success') AS success, round(count(*) FILTER (WHERE status = 'success') / count(*), 4) AS success_rate, count(*) FILTER (WHERE status = 'escalated') AS escalated, count(*) FILTER (WHERE status = 'error') AS error,
  round(avg(retry_count) FILTER (WHERE status = 'success'), 2) AS avg_retries_on_success, count(*) FILTER (WHERE CASE WHEN first_pass_success IS NOT NULL THEN first_pass_success ELSE retry_count = 0 END) AS first_try_success,
  round(count(*) FILTER (WHERE CASE WHEN first_pass_success IS NOT NULL THEN first_pass_success ELSE retry_count = 0 END) / count(*), 4) AS first_pass_rate, sum(coalesce(repair_count, retry_count, 0))::BIGINT AS repairs_total, (SELECT count(*) FROM r) AS runs_total, (SELECT sum(coalesce(coder_tokens, 0))::BIGINT FROM r) AS coder_tokens_total FROM l""")
def q_A19_ledger(t: Tables) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    rows = t.events.select(
        e.alias("seq"), F.when(u % 5 == 0, "").when(u % 5 != 1, F.concat(F.lit("p"), u)).alias("source_prefix"), F.when(u % 7 != 1, F.concat(F.lit("s"), u)).alias("site_name"),
        F.when(e % 5 == 0, "escalated").when(e % 5 == 1, "error").otherwise("success").alias("status"), F.when(e % 6 != 5, e % 3).alias("retry_count"), F.when(e % 4 != 3, e % 8).alias("repair_count"),
        F.when(e % 3 != 0, e % 3 == 1).alias("first_pass_success"), F.when(e % 9 != 8, e % 100).alias("coder_tokens"),
    )
    return merge.ledger_summary(rows)


@book.query("SELECT 'articles' AS name, count(*) AS n, max(published) AS latest FROM articles UNION ALL SELECT 'entities', count(*), max(occurred) FROM entities UNION ALL SELECT 'bars', count(*), -1 FROM bars WHERE volume > 0 HAVING count(*) > 0")
def q_A25_tables(t: Tables) -> DataFrame:
    row = lambda df, name, c: df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"), c.cast("long").alias("latest"))
    return row(t.articles, "articles", F.max("published")).unionByName(row(t.entities, "entities", F.max("occurred"))).unionByName(row(t.bars.filter("volume > 0"), "bars", F.lit(-1)))


_STORIES = "SELECT event_id, 'story ' || CAST(k // 8 AS VARCHAR) || CASE WHEN k % 8 = 7 THEN 'b' ELSE '' END AS representative_title, title FROM entities"


@book.query(f"""WITH e AS ({_STORIES}), s AS (SELECT representative_title, floor((max(published) - min(published)) / 86400) AS span FROM e JOIN articles USING (event_id) GROUP BY 1),
g AS (SELECT representative_title, coalesce(min(event_id) FILTER (WHERE title IS NOT NULL), min(event_id)) AS keeper FROM e GROUP BY 1 HAVING count(*) > 1)
SELECT event_id, keeper FROM e JOIN g USING (representative_title) JOIN s USING (representative_title) WHERE span <= 3""")
def q_CL10_merge_titles(t: Tables) -> DataFrame:
    k = F.col("k")
    story = F.concat(F.lit("story "), F.floor(k / 8), F.when(k % 8 == 7, "b").otherwise(""))
    return upkeep.merge_same_title(t.entities.select("event_id", story.alias("representative_title"), "title"), t.articles.select("event_id", F.col("published").alias("at")))


@book.query("SELECT event_id, count(*) AS n FROM articles GROUP BY event_id HAVING avg(regexp_matches(title, '[Tt]h')::INT) >= 0.8")
def q_CL11_dissolve(t: Tables) -> DataFrame:
    return upkeep.dissolve(t.articles, "[Tt]h")


@book.query("""WITH m AS (SELECT event_id, article_id, 'kept' AS source, n % 5 = 0 AS u FROM articles WHERE n % 3 <> 0 UNION ALL SELECT event_id, 'gone_' || event_id, 'gone', false FROM entities WHERE k % 6 = 0),
c AS (SELECT event_id, count(*) AS had FROM m GROUP BY 1),
j AS (SELECT a.event_id, a.article_id, m.event_id IS NULL AS fresh, CASE WHEN m.event_id IS NULL THEN a.source ELSE m.source END AS source, coalesce(m.u, false) AS u FROM articles a LEFT JOIN m ON a.event_id = m.event_id AND a.article_id = m.article_id)
SELECT event_id, string_agg(article_id || ':' || source || ':' || u::VARCHAR || ':' || fresh::VARCHAR, ',' ORDER BY article_id) AS members, count(DISTINCT source) AS source_count, count(*) FILTER (WHERE fresh) AS added
FROM j GROUP BY event_id HAVING count(*) FILTER (WHERE fresh) > 0 AND count(*) > (SELECT coalesce(max(had), 0) FROM c WHERE c.event_id = j.event_id)""")
def q_CL12_rebuild_members(t: Tables) -> DataFrame:
    old = t.articles.filter("n % 3 <> 0").select("event_id", "article_id", F.lit("kept").alias("source"), "title", "url", (F.col("n") % 5 == 0).alias("has_unique_detail"))
    gone = t.entities.filter("k % 6 = 0").select("event_id", F.concat(F.lit("gone_"), "event_id").alias("article_id"), F.lit("gone").alias("source"), F.lit("").alias("title"), F.lit("").alias("url"), F.lit(False).alias("has_unique_detail"))
    members = old.unionByName(gone).groupBy("event_id").agg(F.collect_list(F.struct("article_id", "source", "title", "url", "has_unique_detail")).alias("members"))
    r = upkeep.rebuild_members(t.entities.select("event_id").join(members, "event_id", "left"), t.articles)
    entry = F.transform("members", lambda m: F.concat_ws(":", m["article_id"], m["source"], m["has_unique_detail"].cast("string"), m["restored"].cast("string")))
    return r.select("event_id", F.array_join(entry, ",").alias("members"), "source_count", "added")


@book.query("""WITH s AS (SELECT count(*) AS t, count(*) FILTER (WHERE length(title) > 25) AS a, count(*) FILTER (WHERE expected_direction = '中性') AS b, count(*) FILTER (WHERE len(tickers) > 2) AS c FROM entities WHERE title IS NOT NULL)
SELECT name, hits, round(100.0::DOUBLE * hits / t, 6) AS pct, 100.0 * hits / t > most AS alert FROM (SELECT t, unnest([{'name': 'long_title', 'hits': a, 'most': 5.0}, {'name': 'neutral', 'hits': b, 'most': 60.0}, {'name': 'many_tickers', 'hits': c, 'most': 3.0}], recursive := true) FROM s)""")
def q_Q09_audit(t: Tables) -> DataFrame:
    checks = {"long_title": (F.length("title") > 25, 5.0), "neutral": (F.col("expected_direction") == "中性", 60.0), "many_tickers": (F.size("tickers") > 2, 3.0)}
    return upkeep.audit(t.entities.filter("title is not null"), t.tickers, checks)


@book.query("""WITH v AS (SELECT 'pending' AS name, count(*) AS value, 800 AS most, 'WARN' AS bad FROM articles WHERE stage = 'pending' UNION ALL SELECT 'vectorized', count(*), 0, 'WARN' FROM articles WHERE stage = 'vectorized'
UNION ALL SELECT 'clustered', count(*), 4000, 'WARN' FROM articles WHERE stage = 'clustered' UNION ALL SELECT 'unscored', count(*), 0, 'ALARM' FROM entities WHERE title IS NOT NULL AND stars IS NULL UNION ALL SELECT 'stale', DATE '2001-11-20' - max(date), 4, 'WARN' FROM bars)
SELECT CASE WHEN value > most THEN bad ELSE 'OK' END AS level, name, value FROM v""")
def q_Q10_health(t: Tables) -> DataFrame:
    return upkeep.health(t.articles, t.entities, t.bars, "2001-11-20")


@book.query("SELECT ticker, count(*) AS days, max(date) AS last FROM bars WHERE foreign_net = 0 AND trust_net = 0 AND dealer_net = 0 AND volume > 0 GROUP BY ticker HAVING count(*) >= 3", days=("last",))
def q_Q11_fake_zeros(t: Tables) -> DataFrame:
    return upkeep.fake_zeros(t.bars)


@book.query("""WITH n AS (SELECT stock_id, date, sum(CASE WHEN name IN ('Foreign_Investor', 'Foreign_Dealer_Self') THEN buy - sell ELSE 0 END)::BIGINT AS f, sum(CASE WHEN name = 'Investment_Trust' THEN buy - sell ELSE 0 END)::BIGINT AS i, sum(CASE WHEN name IN ('Dealer_self', 'Dealer_Hedging') THEN buy - sell ELSE 0 END)::BIGINT AS d FROM flows_long GROUP BY 1, 2)
SELECT ticker, b.date, f - foreign_net AS d_foreign_net, i - trust_net AS d_trust_net, d - dealer_net AS d_dealer_net FROM bars b JOIN n ON ticker = stock_id AND b.date = n.date WHERE f <> foreign_net OR i <> trust_net OR d <> dealer_net""", days=("date",))
def q_R04_compare_nets(t: Tables) -> DataFrame:
    return upkeep.compare_nets(t.bars, bars.investor_nets(t.flows_long))


@book.query("""WITH b AS (SELECT event_id AS id, user_id % 40 AS g, (user_id % 40) * 2 + (event_id % 5 = 0)::INT AS p FROM events),
x AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM b GROUP BY g, p)) AS tp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM b GROUP BY g)) AS gp, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) AS n FROM b GROUP BY p)) AS pp)
SELECT tp::BIGINT AS tp, gp::BIGINT AS gold_pairs, pp::BIGINT AS predicted_pairs, round(tp / pp, 6) AS precision, round(tp / gp, 6) AS recall, round(2 * (tp / pp) * (tp / gp) / (tp / pp + tp / gp), 6) AS f1 FROM x""")
def q_Q12_pair_scores(t: Tables) -> DataFrame:
    gold = t.events.select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("grp"))
    predicted = t.events.select(F.col("event_id").alias("id"), ((F.col("user_id") % 40) * 2 + (F.col("event_id") % 5 == 0).cast("int")).alias("grp"))
    return evaluate.pair_scores(gold, predicted)


@book.query("""WITH t AS (SELECT count(*) AS t, count(*) FILTER (WHERE quality = toxic) AS same, (count(*) FILTER (WHERE quality = 0)) * (count(*) FILTER (WHERE toxic = 0)) + (count(*) FILTER (WHERE quality = 1)) * (count(*) FILTER (WHERE toxic = 1)) AS c FROM labels)
SELECT round((same / t - c / (t * t)) / (1 - c / (t * t)), 6) AS kappa, round(same / t, 6) AS agreement FROM t""")
def q_M19_kappa(t: Tables) -> DataFrame:
    return evaluate.kappa(t.labels, "quality", "toxic")


_SETS = "(SELECT k, coalesce(categories, []) AS g, CASE WHEN k % 4 = 0 THEN ['營收'] WHEN k % 4 = 1 THEN coalesce(categories, []) ELSE coalesce(categories, [])[1:1] END AS p FROM entities)"


def _sets(t: Tables) -> DataFrame:
    empty = F.array().cast("array<string>")
    c = F.coalesce("categories", empty)
    return t.entities.select("k", c.alias("g"), F.when(F.col("k") % 4 == 0, F.array(F.lit("營收"))).when(F.col("k") % 4 == 1, c).otherwise(F.slice(c, 1, 1)).alias("p"))


@book.query(f"SELECT round(avg((list_sort(g) = list_sort(p))::INT), 6) AS exact, round(avg(CASE WHEN len(list_distinct(list_concat(g, p))) = 0 THEN 1 ELSE len(list_intersect(g, p)) / len(list_distinct(list_concat(g, p))) END), 6) AS jaccard FROM {_SETS}")
def q_Q13_set_agreement(t: Tables) -> DataFrame:
    return evaluate.set_agreement(_sets(t), "g", "p")


@book.query(f"""WITH s AS (SELECT * FROM {_SETS}), l AS (SELECT label, count(*) FILTER (WHERE side = 'g' AND list_contains(p, label)) AS tp, count(*) FILTER (WHERE side = 'g') AS gold, count(*) FILTER (WHERE side = 'p') AS predicted
  FROM (SELECT unnest(g) AS label, 'g' AS side, p FROM s UNION ALL SELECT unnest(p), 'p', p FROM s) GROUP BY label), a AS (SELECT * FROM l UNION ALL SELECT '*', sum(tp), sum(gold), sum(predicted) FROM l)
SELECT label, tp::BIGINT AS tp, gold::BIGINT AS gold, predicted::BIGINT AS predicted, round(CASE WHEN predicted = 0 THEN 1 ELSE tp / predicted END, 6)::DOUBLE AS precision, round(CASE WHEN gold = 0 THEN 1 ELSE tp / gold END, 6)::DOUBLE AS recall FROM a""")
def q_Q14_multi_label(t: Tables) -> DataFrame:
    return evaluate.multi_label(_sets(t), "g", "p")


@book.query("""WITH s AS (SELECT (doc_id * 31) % 50 AS score, quality FROM labels), b AS (SELECT score, count(*) AS n, sum(quality) AS y FROM s GROUP BY 1), r AS (SELECT score, sum(n) OVER w AS n, sum(y) OVER w AS y FROM b WINDOW w AS (ORDER BY score DESC))
SELECT min(score) AS threshold, max(n)::BIGINT AS covered FROM r WHERE y / n >= 0.85 AND n >= 20""")
def q_Q18_threshold(t: Tables) -> DataFrame:
    return evaluate.threshold(t.labels.select(((F.col("doc_id") * 31) % 50).alias("score"), F.col("quality").alias("label")), 0.85, 20)


@book.query("""WITH r AS (SELECT user_id % 10 AS g, event_id % 97 AS a, round(value) AS b FROM events), k AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY g ORDER BY b) + (count(*) OVER (PARTITION BY g, b) - 1) / 2 AS rb FROM r WHERE b IS NOT NULL)
SELECT g, round(corr(ra, rb), 6) AS spearman, count(*) AS n FROM k GROUP BY g""")
def q_Q23_spearman(t: Tables) -> DataFrame:
    rows = t.events.select((F.col("user_id") % 10).alias("g"), (F.col("event_id") % 97).alias("a"), F.round("value").alias("b"))
    return evaluate.spearman(rows, "a", "b", "g")


@book.query("SELECT user_id, max(j) AS max_jump FROM (SELECT user_id, abs((event_id * 13) % 101 - lag((event_id * 13) % 101) OVER (PARTITION BY user_id ORDER BY event_id)) AS j FROM events) GROUP BY user_id HAVING max(j) IS NOT NULL")
def q_W17_smoothness(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", ((F.col("event_id") * 13) % 101).alias("s"))
    return evaluate.smoothness(rows, "user_id", "event_id", "s").filter("max_jump is not null")


@book.query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.3""")
def q_M18_similar_pairs(t: Tables) -> DataFrame:
    pairs = cluster.similar_pairs(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 0.3)
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine"))


_NEAR = """WITH v AS (SELECT *, vec_id % 9 AS day, vec_id % 61 AS updated FROM embeddings), q AS (SELECT * FROM v WHERE vec_id % 50 = 0), t AS (SELECT * FROM v WHERE vec_id % 50 <> 0 AND updated > 60 - 30),
d AS (SELECT q.vec_id AS id, t.vec_id AS target, abs(q.day - t.day) AS days, round(1 - list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 12) AS d FROM q, t),
n AS (SELECT id, target, d FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, target) = 1) WHERE d <= 0.7 AND days <= 3)"""


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    """New and existing events: the ids divisible by 50 are new, those by 100 come again."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 9).alias("day"), (F.col("vec_id") % 61).alias("updated"))
    return v.filter("id % 50 = 0"), v.filter("id % 100 <> 50")


@book.query(_NEAR + "SELECT id, target, round(d, 6) AS distance FROM n")
def q_J13_nearest(t: Tables) -> DataFrame:
    found = cluster.nearest(*_vectors(t), farthest=0.7, days=3, today=60, fresh=30)
    return found.select("id", "target", F.round("distance", 6).alias("distance"))


@book.query(_NEAR + """, m AS (SELECT vec_id AS event_id, unnest([vec_id * 10, vec_id * 10 + 1]) AS article_id, 's' || CAST((unnest([vec_id, vec_id + 1])) % 3 AS VARCHAR) AS source FROM v WHERE vec_id % 100 <> 50),
b AS (SELECT vec_id AS event_id, unnest([vec_id * 10, vec_id * 10 + 2, vec_id * 10 + 3]) AS article_id, 's' || CAST((unnest([vec_id, vec_id + 1, vec_id + 2])) % 3 AS VARCHAR) AS source FROM q),
alone AS (SELECT * FROM b WHERE event_id NOT IN (SELECT id FROM n)),
g AS (SELECT event_id, article_id, source, 0 AS added FROM m WHERE event_id NOT IN (SELECT event_id FROM alone) UNION SELECT target, article_id, source, 1 FROM n JOIN b ON b.event_id = n.id),
w AS (SELECT event_id, article_id, source, 2 + (event_id IN (SELECT event_id FROM m))::INT AS added FROM alone)
SELECT event_id, string_agg(article_id, ',' ORDER BY article_id) AS members, count(DISTINCT source) AS source_count, ['same', 'grown', 'new', 'replaced'][max(added) + 1] AS state FROM (SELECT * FROM g UNION ALL SELECT * FROM w) GROUP BY event_id""")
def q_J19_CL09_attach(t: Tables) -> DataFrame:
    batch, existing = (x.withColumn("event_id", F.col("id")) for x in _vectors(t))
    member = lambda *k: F.array(*(F.struct((F.col("id") * 10 + x).alias("article_id"), F.concat(F.lit("s"), (F.col("id") + y) % 3).alias("source")) for y, x in enumerate(k)))
    known = existing.withColumn("members", member(0, 1)).withColumnRenamed("day", "last_seen")
    got = cluster.attach(batch.withColumn("members", member(0, 2, 3)), known, today=60, farthest=0.7)
    ids = F.transform(F.array_sort(F.transform("members", lambda m: m["article_id"])), lambda x: x.cast("string"))
    return got.select("event_id", F.array_join(ids, ",").alias("members"), F.col("source_count").cast("long").alias("source_count"), "state")


@book.query("""WITH m AS (SELECT label AS event, p AS place, avg(x) AS x FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings) GROUP BY 1, 2)
SELECT event, place, round(x / sqrt(sum(x * x) OVER (PARTITION BY event)), 6) AS x FROM m""")
def q_A23_centroids(t: Tables) -> DataFrame:
    found = cluster.centroids(t.embeddings.select(F.col("label").alias("event"), F.col("embedding").alias("vector")))
    each = found.select("event", F.posexplode("centroid").alias("place", "x"))
    return each.select("event", F.col("place").cast("long").alias("place"), F.round("x", 6).alias("x"))


@book.query()
def q_CL01_cluster(t: Tables) -> DataFrame:
    return cluster.cluster(t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 0.62)


@book.query()
def q_CL03_segments(t: Tables) -> DataFrame:
    day = F.unix_date(F.to_date("ts")).cast("long")
    return cluster.date_segments(t.events.select(F.col("user_id").alias("cluster"), F.col("event_id").alias("id"), F.when(F.col("event_id") % 17 != 0, day).alias("day")), 1, 7)


@book.query()
def q_CL07_assemble(t: Tables) -> DataFrame:
    tickers = F.when(F.col("vec_id") % 3 != 0, F.array((F.col("vec_id") % 4).cast("string")))
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 9).cast("long").alias("day"), tickers.alias("tickers"), (F.col("vec_id") % 20 == 0).alias("periodic"))
    return cluster.assemble_events(rows, 0.62)


def _embedded(t: Tables) -> DataFrame:
    """Articles with vectors; titles and tickers of all kinds, some of a scheduled column."""
    n = F.col("n")
    title = F.when(n % 23 == 7, F.concat(F.lit("營收速報 - "), "title")).when(n % 4 == 1, F.concat("title", F.concat(F.lit(" (1103-TW) (2025) "), n.cast("string"), F.lit("億元 3% 7 張")))).otherwise(F.col("title"))
    declared = F.when(n % 5 == 0, F.array().cast("array<string>")).when(n % 5 > 2, F.array((n % 4).cast("string"), F.lit("2330")))
    return t.articles.join(t.embeddings, n == F.col("vec_id")).select(n.alias("id"), F.col("embedding").alias("vector"), title.alias("title"), "content", "url", "published", F.when(n % 11 != 3, F.col("source")).alias("source"), declared.alias("related_tickers"))


@book.query()
def q_CL07_records(t: Tables) -> DataFrame:
    from tidemark.operators import events

    found, filtered = events.records(_embedded(t), 0.75)
    one = F.transform("members", lambda m: F.concat_ws(":", m["article_id"].cast("string"), m["source"], F.when(m["has_unique_detail"], "*").otherwise("")))
    rows = found.select("event_id", "representative_title", "source_count", F.array_join(one, " ").alias("members"), F.array_join("related_tickers", ",").alias("tickers"), F.col("date_start").cast("string").alias("date_start"), F.col("date_end").cast("string").alias("date_end"))
    return rows.unionByName(filtered.select(F.concat(F.lit("filtered "), F.col("article_id").cast("string")).alias("event_id"), F.col("periodic_type").alias("representative_title")), allowMissingColumns=True)


@book.query("""WITH a AS (SELECT article_id, 'ASIA_ ' || title || ' (1103) (9999) ' || (SELECT min(name) FROM tickers) || ' NATION' AS title FROM articles),
h AS (SELECT article_id, '1103' AS ticker FROM a WHERE EXISTS (SELECT 1 FROM tickers WHERE ticker = '1103') UNION SELECT article_id, ticker FROM a JOIN tickers ON contains(a.title, name) AND NOT EXISTS (SELECT 1 FROM tickers x WHERE length(x.name) > length(tickers.name) AND contains(x.name, tickers.name) AND contains(a.title, x.name)))
SELECT article_id, coalesce((SELECT string_agg(ticker, ',' ORDER BY ticker) FROM h WHERE h.article_id = a.article_id), '') AS tickers FROM a""")
def q_X14_tag(t: Tables) -> DataFrame:
    """Whole titles, with codes and a name put to them that the generated words lack."""
    from tidemark.operators import tagging

    name = t.tickers.agg(F.min("name").alias("name"))
    titles = t.articles.crossJoin(F.broadcast(name)).select("article_id", F.concat(F.lit("ASIA_ "), "title", F.lit(" (1103) (9999) "), "name", F.lit(" NATION")).alias("title"))
    return tagging.tag(titles, t.tickers).select("article_id", F.array_join("related_tickers", ",").alias("tickers"))


@book.query("""WITH c AS (SELECT event_id, string_agg(title || chr(10) || content, chr(10)) || ' 1103 2330' AS corpus FROM articles GROUP BY 1), x AS (SELECT event_id, unnest(tickers) AS ticker, generate_subscripts(tickers, 1) AS p FROM entities),
k AS (SELECT event_id, string_agg(x.ticker, ',' ORDER BY p) AS tickers FROM x LEFT JOIN tickers d ON x.ticker = d.ticker JOIN c USING (event_id) WHERE NOT regexp_full_match(x.ticker, '[0-9]{5,}') AND (contains(corpus, x.ticker) OR coalesce(contains(corpus, name), false)) GROUP BY 1)
SELECT event_id, coalesce(k.tickers, '') AS tickers FROM entities LEFT JOIN k USING (event_id)""")
def q_X16_verified(t: Tables) -> DataFrame:
    from tidemark.operators import tagging

    text = F.array_join(F.sort_array(F.collect_list(F.concat(F.col("title"), F.lit("\n"), F.col("content")))), "\n")
    corpora = t.articles.groupBy("event_id").agg(F.concat(text, F.lit(" 1103 2330")).alias("corpus"))
    return tagging.verified(t.entities, t.tickers, corpora).select("event_id", F.array_join("tickers", ",").alias("tickers"))


@book.query(r"""WITH s AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?s)<(script|style)[ >].*?</(script|style)>', ' ', 'g') AS h FROM pages),
a AS (SELECT page_id, origin, regexp_extract_all(h, '(?s)<a href="([^"]*)">[^<]*</a>', 1) AS href, regexp_extract_all(h, '(?s)<a href="[^"]*">([^<]*)</a>', 1) AS text FROM s)
SELECT page_id, least(len(href), 40) AS links, md5(array_to_string(list_transform(href[1:40], lambda x: origin || x), ' ')) AS addresses, md5(array_to_string(list_transform(text[1:40], lambda x: trim(x)), ' ')) AS texts, NULL::VARCHAR AS canonical FROM a""")
def q_SRC11_links(t: Tables) -> DataFrame:
    from tidemark.sources import markup

    e = markup.page_links(t.pages)
    joined = lambda c: F.md5(F.array_join(F.transform("evidence.links", lambda x: x[c]), " ").cast("binary"))
    return e.select("page_id", F.size("evidence.links").cast("long").alias("links"), joined("url").alias("addresses"), joined("text").alias("texts"), "evidence.canonical")


@book.query("SELECT article_id, n, trim(title) AS title, url, published AS published_at FROM articles WHERE trim(title) <> ''")
def q_SRC10_feed(t: Tables) -> DataFrame:
    from tidemark.sources import markup

    plain = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(F.lit("<item><title>"), plain("title"), F.lit("</title><link>"), F.col("url"), F.lit("</link><pubDate>"), F.col("published"), F.lit("</pubDate><guid>"), F.col("article_id"), F.lit("</guid></item>"))
    feeds = t.articles.groupBy(F.floor(F.col("n") / 16).alias("f")).agg(F.concat(F.lit("<rss><channel><title>c</title>"), F.array_join(F.sort_array(F.collect_list(item)), ""), F.lit("</channel></rss>")).alias("xml"))
    i = markup.feed_items(feeds).select(F.explode("items").alias("i"))
    return i.select(F.col("i.source_record_id").alias("article_id"), F.substring("i.source_record_id", 5, 20).cast("long").alias("n"), "i.title", "i.url", F.col("i.published_at").cast("long").alias("published_at"))
