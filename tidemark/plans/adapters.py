"""The engine's tables, built from the driver's: the only module that knows their names.

Each table is one SQL text in the words both Spark and DuckDB know; `[[a, b]]` stands for an
array literal, which they write differently. Sums of money are taken in whole cents, so both
engines add the same integers.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidemark.runtime import workers_import

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

TABLES = {
    # daily bars: a nation's suppliers are one ticker
    "bars": """
SELECT CAST(1100 + s_nationkey AS STRING) AS ticker, CAST(l_shipdate AS DATE) AS date,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 / sum(l_quantity) AS close,
  CAST(sum(l_quantity) AS BIGINT) AS volume,
  CAST(sum(CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END ELSE 0 END) AS BIGINT) AS foreign_net,
  CAST(sum(CASE WHEN l_returnflag = 'N' THEN CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END ELSE 0 END) AS BIGINT) AS trust_net,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE -l_quantity END ELSE 0 END) AS BIGINT) AS dealer_net
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2""",
    "flows_long": """
SELECT CAST(1100 + s_nationkey AS STRING) AS stock_id, CAST(l_shipdate AS DATE) AS date,
  CASE l_returnflag WHEN 'A' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'Foreign_Investor' ELSE 'Foreign_Dealer_Self' END
    WHEN 'N' THEN 'Investment_Trust' ELSE CASE l_linenumber % 3 WHEN 0 THEN 'Dealer_self' WHEN 1 THEN 'Dealer_Hedging' ELSE 'Other' END END AS name,
  CAST(CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END AS BIGINT) AS buy,
  CAST(CASE WHEN l_linestatus = 'F' THEN 0 ELSE l_quantity END AS BIGINT) AS sell
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "tickers": """
SELECT CAST(1100 + n_nationkey AS STRING) AS ticker, n_name AS name, CASE WHEN n_nationkey % 12 = 11 THEN NULL ELSE r_name END AS industry
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey <> 24""",
    "index_daily": """
SELECT r_name AS index_code, CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 1e2 / count(*) AS close
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
    "articles": """
SELECT concat('doc_', CAST(doc_id AS STRING)) AS article_id, doc_id AS n, concat('evt_', CAST(CAST(floor(doc_id / 4e0) AS BIGINT) AS STRING)) AS event_id,
  source, CASE WHEN source IN ('src0', 'src7') THEN 'official' WHEN source IN ('src3', 'src11') THEN 'gov' WHEN source = 'src5' THEN 'analyst' ELSE 'media' END AS source_type,
  substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS content, concat('https://news.example.com/', source, '/', CAST(doc_id AS STRING)) AS url,
  CAST(1735689600 + doc_id * 5400 + CASE WHEN doc_id % 4 = 3 THEN 172800 ELSE 0 END AS BIGINT) AS published,
  CASE doc_id % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'vectorized' WHEN 2 THEN 'summarized' WHEN 3 THEN 'scored' ELSE 'clustered' END AS stage
FROM documents""",
    # an event is four articles in a row; its columns are plain functions of its number
    "entities": """
SELECT concat('evt_', CAST(k AS STRING)) AS event_id, k, source_count, n_members, first_published, CAST(first_published - 46800 + (k % 9) * 7200 AS BIGINT) AS occurred,
  representative_title, CASE WHEN k % 5 = 4 THEN NULL ELSE representative_title END AS title,
  CASE k % 4 WHEN 0 THEN 'official_confirmed' WHEN 1 THEN 'developing' WHEN 2 THEN 'rumor_unconfirmed' ELSE 'media_reported' END AS status,
  CASE k % 3 WHEN 0 THEN '利多' WHEN 1 THEN '利空' ELSE '中性' END AS expected_direction, CASE WHEN k % 7 = 6 THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN k % 11 = 10 THEN NULL ELSE 1 + (k * 7) % 5 END AS stars, CASE WHEN k % 6 = 5 THEN NULL ELSE (k * 37) % 101 END AS market_validation,
  CASE k % 10 WHEN 0 THEN [['政策', '財報']] WHEN 1 THEN [['產業供需']] WHEN 2 THEN [['營收', 'AI/科技']] WHEN 3 THEN [['法說']] WHEN 4 THEN [['關稅', '政策']]
    WHEN 5 THEN [['技術突破']] WHEN 6 THEN [['法人動向', '營收']] WHEN 7 THEN [['財報']] WHEN 8 THEN [['其他']] ELSE NULL END AS categories,
  CASE k % 5 WHEN 0 THEN [[concat('11', right(concat('0', CAST(k % 25 AS STRING)), 2))]]
    WHEN 1 THEN [[concat('11', right(concat('0', CAST(k % 25 AS STRING)), 2)), concat('11', right(concat('0', CAST((k + 7) % 25 AS STRING)), 2))]]
    WHEN 2 THEN [['2330']] WHEN 3 THEN [[concat('11', right(concat('0', CAST(k % 25 AS STRING)), 2)), '0050', concat('11', right(concat('0', CAST((k + 3) % 25 AS STRING)), 2))]] ELSE NULL END AS tickers
FROM (SELECT CAST(floor(doc_id / 4e0) AS BIGINT) AS k, count(DISTINCT source) AS source_count, count(*) AS n_members,
    min(CAST(1735689600 + doc_id * 5400 AS BIGINT)) AS first_published, min(substr(split_part(text, chr(10), 1), 1, 80)) AS representative_title
  FROM documents GROUP BY 1) e""",
}


def spark_sql(text: str) -> str:
    return re.sub(r"\[\[(.*?)\]\]", r"array(\1)", text, flags=re.DOTALL)


def duck_sql(text: str) -> str:
    return re.sub(r"\[\[(.*?)\]\]", r"[\1]", text, flags=re.DOTALL)


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the engine's tables over the driver's files."""
    if name in RAW:
        return raw(spark, sf_dir, name)
    text = spark_sql(TABLES[name])
    used = {t: raw(spark, sf_dir, t) for t in RAW if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    text = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], text)
    return spark.sql(text, **used)


def oracle(sql: str) -> str:
    """sql with the engine's tables it names, as DuckDB reads them."""
    used = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]
    parts = [f"{t} AS ({duck_sql(TABLES[t])})" for t in used]
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*parts, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:]])
    return (f"WITH {', '.join(parts)} " if parts else "") + body
