"""Bars, breadth, indices: registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import dates, scoring
from tidemark.operators import bars, market
from tidemark.plans.book import Book, Tables

book = Book()

DAY = "1997-06-16"

_PX = """
px AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM bars WHERE date <= DATE '{d}' AND date > DATE '{d}' - 20),
dc AS (SELECT *, close / nullif(prev, 0) - 1 AS change FROM px WHERE date = DATE '{d}')
""".format(d=DAY)

_LATEST = """
px AS (SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY date) AS prev FROM bars WHERE date > (SELECT max(date) FROM bars) - 20),
dc AS (SELECT *, close / nullif(prev, 0) - 1 AS change FROM px WHERE date = (SELECT max(date) FROM bars))
"""

_BREADTH = """SELECT count(*) FILTER (WHERE change > 0) AS advancers, count(*) FILTER (WHERE change < 0) AS decliners, count(*) FILTER (WHERE change = 0) AS unchanged,
  count(*) FILTER (WHERE change >= 0.095) AS limit_up, count(*) FILTER (WHERE change <= -0.095) AS limit_down, count(change) AS covered,
  round(sum(close * volume) / 1e8, 6) AS turnover, round(quantile_cont(change, 0.5), 6) AS median_change FROM dc"""


@book.query(f"WITH {_LATEST} {_BREADTH}")
def q_A02(t: Tables) -> DataFrame:
    return market.breadth(t.bars)


@book.query(f"WITH {_PX} {_BREADTH}")
def q_A01_breadth_day(t: Tables) -> DataFrame:
    return market.breadth(t.bars, day=DAY)


@book.query(f"WITH {_PX} SELECT round(quantile_cont(change, 0.5), 6) AS median, round(quantile_cont(change, 0.9), 6) AS p90 FROM dc")
def q_A03_median(t: Tables) -> DataFrame:
    d = market.day_changes(t.bars, DAY)
    return d.agg(F.round(F.percentile("change", 0.5), 6).alias("median"), F.round(F.percentile("change", 0.9), 6).alias("p90"))


@book.query(f"""WITH {_PX} SELECT industry, count(*) AS n, round(avg(change), 6) AS avg_change, count(*) FILTER (WHERE change > 0) AS up
FROM dc JOIN tickers USING (ticker) WHERE industry IS NOT NULL AND change IS NOT NULL GROUP BY industry HAVING count(*) >= 3""")
def q_A04_sectors(t: Tables) -> DataFrame:
    return market.sectors(t.bars, t.tickers, 3, DAY)


@book.query("""WITH d AS (SELECT date, sum(close * volume) AS x FROM bars WHERE date > (SELECT max(date) FROM bars) - 40 GROUP BY date ORDER BY date DESC LIMIT 20)
SELECT round(avg(x) / 1e8, 6) AS avg_turnover, count(*) AS days FROM d""")
def q_A05_average_turnover(t: Tables) -> DataFrame:
    return market.average_turnover(t.bars)


@book.query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM bars)
SELECT round(100.0 * count(*) FILTER (WHERE foreign_net = 0 AND trust_net = 0 AND dealer_net = 0) / nullif(count(*), 0), 1) AS zero_pct FROM bars WHERE date = (SELECT max(date) FROM bars)""")
def q_A09_zero_flows(t: Tables) -> DataFrame:
    return bars.zero_flow_share(t.bars)


@book.query("""SELECT stock_id, date, sum(CASE WHEN name IN ('Foreign_Investor', 'Foreign_Dealer_Self') THEN buy - sell ELSE 0 END)::BIGINT AS foreign_net,
  sum(CASE WHEN name = 'Investment_Trust' THEN buy - sell ELSE 0 END)::BIGINT AS trust_net,
  sum(CASE WHEN name IN ('Dealer_self', 'Dealer_Hedging') THEN buy - sell ELSE 0 END)::BIGINT AS dealer_net FROM flows_long GROUP BY stock_id, date""", days=("date",))
def q_A10_investor_nets(t: Tables) -> DataFrame:
    return bars.investor_nets(t.flows_long)


@book.query(f"WITH {_PX} SELECT ticker, round(close, 6) AS close, round(prev, 6) AS prev, round(change, 6) AS change FROM dc")
def q_W01_lag_in_slice(t: Tables) -> DataFrame:
    d = market.day_changes(t.bars, DAY)
    return d.select("ticker", F.round("close", 6).alias("close"), F.round("prev", 6).alias("prev"), F.round("change", 6).alias("change"))


@book.query("SELECT index_code, date, round(close, 6) AS close FROM index_daily QUALIFY row_number() OVER (PARTITION BY index_code ORDER BY date DESC) <= 21", days=("date",))
def q_W02_last_rows(t: Tables) -> DataFrame:
    return market.last_rows(t.index_daily, 21).select("index_code", "date", F.round("close", 6).alias("close"))


_RUNS = """
s AS (SELECT ticker, date, sign(foreign_net)::INT AS sg FROM bars),
i AS (SELECT *, CASE WHEN lag(sg) OVER (PARTITION BY ticker ORDER BY date) IS NOT DISTINCT FROM sg THEN 0 ELSE 1 END AS st FROM s),
g AS (SELECT *, sum(st) OVER (PARTITION BY ticker ORDER BY date) AS grp FROM i),
runs AS (SELECT ticker, date, grp, sg, (sg * row_number() OVER (PARTITION BY ticker, grp ORDER BY date))::INT AS days FROM g)
"""


@book.query(f"WITH {_RUNS} SELECT ticker, date, days AS foreign_consecutive_days FROM runs", days=("date",))
def q_W04_signed_runs(t: Tables) -> DataFrame:
    return bars.signed_runs(t.bars.select("ticker", "date", "foreign_net")).drop("foreign_net")


@book.query(f"WITH {_RUNS} SELECT ticker, date, (days + CASE WHEN grp = 1 AND sg = 1 THEN 3 ELSE 0 END)::INT AS days FROM runs", days=("date",))
def q_W04_seeded_runs(t: Tables) -> DataFrame:
    return bars.signed_runs(t.bars.select("ticker", "date", "foreign_net"), name="days", seed=F.lit(3)).drop("foreign_net")


_DERIVED = f"""
{_RUNS.rstrip()},
b AS (SELECT *, row_number() OVER w AS n, close / nullif(lag(close) OVER w, 0) - 1 AS ret, foreign_net + trust_net + dealer_net AS net,
    avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS avg20,
    lead(close, 1) OVER w AS c1, lead(close, 3) OVER w AS c3, lead(close, 5) OVER w AS c5 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
v AS (SELECT *, stddev_samp(ret) OVER r20 AS sd, count(ret) OVER r20 AS nr FROM b WINDOW r20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
chips AS (SELECT v.ticker, v.date, v.close, volume, foreign_net, trust_net, dealer_net, days AS foreign_consecutive_days,
    CASE WHEN n >= 20 THEN volume / nullif(avg20, 0) END AS volume_ratio_vs_avg20, CASE WHEN n >= 20 THEN net / nullif(avg20, 0) END AS net_vs_avg20_volume_pct,
    CASE WHEN n >= 21 AND nr >= 2 THEN sd END AS sigma_20d, c1 / nullif(close, 0) - 1 AS return_1d, c3 / nullif(close, 0) - 1 AS return_3d, c5 / nullif(close, 0) - 1 AS return_5d
  FROM v JOIN runs USING (ticker, date))
"""
_ROUNDED = ("volume_ratio_vs_avg20", "net_vs_avg20_volume_pct", "sigma_20d", "return_1d", "return_3d", "return_5d")


@book.query(f"WITH {_DERIVED} SELECT ticker, date, foreign_consecutive_days, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM chips", days=("date",))
def q_W05_derived_bars(t: Tables) -> DataFrame:
    d = bars.derive(t.bars)
    return d.select("ticker", "date", "foreign_consecutive_days", *[F.round(c, 6).alias(c) for c in _ROUNDED])


@book.query("SELECT index_code, date, round((close / nullif(lag(close) OVER (PARTITION BY index_code ORDER BY date), 0) - 1) * 100, 6) AS change_pct FROM index_daily", days=("date",))
def q_W09_index_changes(t: Tables) -> DataFrame:
    return market.index_changes(t.index_daily).select("index_code", "date", "change_pct")


@book.query("""WITH c AS (SELECT *, round((close / nullif(lag(close) OVER w, 0) - 1) * 100, 6) AS p FROM index_daily WINDOW w AS (PARTITION BY index_code ORDER BY date)),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY index_code ORDER BY date DESC) <= 21),
r AS (SELECT *, coalesce(close / lag(close, 5) OVER w - 1, 0) AS r5, coalesce(close / lag(close, 20) OVER w - 1, 0) AS r20, row_number() OVER (PARTITION BY index_code ORDER BY date DESC) AS n FROM l WINDOW w AS (PARTITION BY index_code ORDER BY date))
SELECT index_code, date AS as_of, round(close, 6) AS close, p AS change_1d, round(r5, 6) AS change_5d, round(r20, 6) AS change_20d FROM r WHERE n = 1""", days=("as_of",))
def q_E10_index_overview(t: Tables) -> DataFrame:
    return market.index_overview(t.index_daily).drop("series")


@book.query("""WITH l AS (SELECT * FROM index_daily QUALIFY row_number() OVER (PARTITION BY index_code ORDER BY date DESC) <= 20)
SELECT index_code, string_agg(date::VARCHAR, ';' ORDER BY date) AS dates, count(*) AS n FROM l GROUP BY index_code""")
def q_W12_series(t: Tables) -> DataFrame:
    last = market.last_rows(t.index_daily, 20)
    days = F.sort_array(F.collect_list(F.col("date").cast("string")))
    return last.groupBy("index_code").agg(F.array_join(days, ";").alias("dates"), F.count(F.lit(1)).alias("n"))


@book.query(f"""WITH {_PX} SELECT ticker, coalesce(name, ticker) AS name, round(close * volume / 1e8, 9) AS turnover, round(change, 6) AS change
FROM dc LEFT JOIN tickers USING (ticker) WHERE volume > 0 AND close > 0 AND prev IS NOT NULL ORDER BY round(close * volume / 1e8, 9) DESC, ticker LIMIT 12""")
def q_S02_top_turnover(t: Tables) -> DataFrame:
    return market.top_turnover(t.bars, t.tickers, 12, DAY)


@book.query(f"""WITH {_PX}, a AS (SELECT count(*) FILTER (WHERE change > 0) AS up, count(*) FILTER (WHERE change < 0) AS down, sum(close * volume) / 1e8 AS turnover FROM dc),
d AS (SELECT date, sum(close * volume) / 1e8 AS x FROM bars WHERE date <= DATE '{DAY}' AND date > DATE '{DAY}' - 40 GROUP BY date ORDER BY date DESC LIMIT 20)
SELECT up, down, round(CASE WHEN up + down = 0 THEN 0.5 ELSE up / (up + down) END, 6) AS advance_share, round(coalesce(turnover / nullif((SELECT avg(x) FROM d), 0), 1), 6) AS turnover_ratio FROM a""")
def q_E12_breadth_page(t: Tables) -> DataFrame:
    b = market.breadth(t.bars, day=DAY)
    day = market._slice(t.bars, 40, DAY).groupBy("date").agg((F.sum(F.col("close") * F.col("volume")) / 1e8).alias("x"))
    mean = day.orderBy(F.desc("date")).limit(20).agg(F.avg("x").alias("m"))
    today = market.day_changes(t.bars, DAY).agg((F.sum(F.col("close") * F.col("volume")) / 1e8).alias("x"))
    row = b.crossJoin(mean).crossJoin(today)
    return row.select(F.col("advancers").alias("up"), F.col("decliners").alias("down"), F.round(scoring.advance_share(F.col("advancers"), F.col("decliners")), 6).alias("advance_share"), F.round(F.coalesce(F.try_divide("x", "m"), F.lit(1.0)), 6).alias("turnover_ratio"))


@book.query(f"WITH {_DERIVED}, d AS (SELECT date, row_number() OVER (ORDER BY date DESC) AS k FROM (SELECT DISTINCT date FROM bars)) SELECT ticker, date, round(sigma_20d, 6) AS sigma_20d FROM chips JOIN d USING (date) WHERE k <= 12 AND (k <= 4 OR sigma_20d IS NOT NULL)", days=("date",))
def q_W15_backfill(t: Tables) -> DataFrame:
    return bars.backfill_rows(bars.derive(t.bars), 4, 8).select("ticker", "date", F.round("sigma_20d", 6).alias("sigma_20d"))


@book.query("SELECT date, count(*) AS n, avg(volume) AS v FROM bars JOIN tickers USING (ticker) WHERE volume > 0 GROUP BY date", days=("date",))
def q_J01_inner_dimension(t: Tables) -> DataFrame:
    return t.bars.filter("volume > 0").join(F.broadcast(t.tickers), "ticker").groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.avg("volume").alias("v"))


@book.query("SELECT ticker, coalesce(name, ticker) AS name, count(*) AS n FROM bars LEFT JOIN tickers USING (ticker) GROUP BY 1, 2")
def q_J02_left_dimension(t: Tables) -> DataFrame:
    j = t.bars.join(F.broadcast(t.tickers), "ticker", "left")
    return j.groupBy("ticker", F.coalesce("name", "ticker").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@book.query(f"SELECT ticker, date, volume FROM bars WHERE date <= DATE '{DAY}' AND date > DATE '{DAY}' - 20", days=("date",))
def q_F10_trailing_days(t: Tables) -> DataFrame:
    return market._slice(t.bars, 20, DAY).select("ticker", "date", "volume")


@book.query("SELECT s_suppkey AS id, CASE WHEN s_acctbal = 0 THEN NULL ELSE round(1 / s_acctbal, 9) END AS x, regexp_matches((1000 + s_suppkey)::VARCHAR, '^[1-9][0-9]{3}$') AS common FROM supplier")
def q_F12_F14_safe_divide(t: Tables) -> DataFrame:
    code = (1000 + F.col("s_suppkey")).cast("string")
    return t.supplier.select(F.col("s_suppkey").alias("id"), F.round(F.try_divide(F.lit(1.0), F.col("s_acctbal")), 9).alias("x"), bars.is_common_stock(code).alias("common"))


@book.query("""SELECT index_code, date, round((close - min(close) OVER w) / greatest(max(close) OVER w - min(close) OVER w, 0.001), 6) AS scaled FROM index_daily WINDOW w AS (PARTITION BY index_code)""", days=("date",))
def q_M21_sparkline(t: Tables) -> DataFrame:
    return market.sparkline(t.index_daily).select("index_code", "date", "scaled")


@book.query("""SELECT index_code, max(date) AS as_of, CASE WHEN DATE '2001-08-01' - max(date) <= 4 THEN 'ready' WHEN DATE '2001-08-01' - max(date) <= 10 THEN 'stale' ELSE 'unavailable' END AS status FROM index_daily WHERE date <= DATE '2001-08-01' GROUP BY index_code""", days=("as_of",))
def q_D06_freshness(t: Tables) -> DataFrame:
    day = F.lit("2001-08-01").cast("date")
    return t.index_daily.filter(F.col("date") <= day).groupBy("index_code").agg(F.max("date").alias("as_of")).withColumn("status", market.freshness(F.col("as_of"), day))


@book.query("""WITH l AS (SELECT event_id, ts, ts + INTERVAL 8 HOUR AS x FROM events)
SELECT event_id, CASE WHEN isodow(x) >= 6 THEN 'closed' WHEN hour(x) >= 9 AND hour(x) < 16 THEN 'open' WHEN hour(x) >= 7 AND hour(x) < 9 THEN 'preopen' ELSE 'closed' END AS state,
  CASE WHEN hour(x) * 60 + minute(x) >= 810 THEN x::DATE + 1 ELSE x::DATE END AS d0,
  CASE WHEN hour(x) < 16 THEN x::DATE - 1 ELSE x::DATE END - greatest(isodow(CASE WHEN hour(x) < 16 THEN x::DATE - 1 ELSE x::DATE END) - 5, 0)::INT AS bound FROM l""", days=("d0", "bound"))
def q_D02_D03_D05_clock(t: Tables) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return t.events.select("event_id", market.session_state(ts, F.lit("Asia/Taipei")).alias("state"), dates.resolve_d0(ts).alias("d0"), dates.calendar_bound(ts).alias("bound"))


@book.query("WITH t AS (SELECT ticker, max(date) AS a FROM bars GROUP BY ticker), f AS (SELECT stock_id, max(date) AS b FROM flows_long WHERE buy <> 0 OR sell <> 0 GROUP BY stock_id) SELECT ticker, least(a, b) AS last_day FROM t JOIN f ON ticker = stock_id", days=("last_day",))
def q_D04_last_trading_day(t: Tables) -> DataFrame:
    a = t.bars.groupBy("ticker").agg(F.max("date").alias("a"))
    b = t.flows_long.filter("buy <> 0 or sell <> 0").groupBy("stock_id").agg(F.max("date").alias("b"))
    return a.join(b, F.col("ticker") == F.col("stock_id")).select("ticker", F.least("a", "b").alias("last_day"))


@book.query("WITH l AS (SELECT * FROM index_daily QUALIFY row_number() OVER (PARTITION BY index_code ORDER BY date DESC) = 1) SELECT index_code, date, round(close, 6) AS close FROM l", days=("date",))
def q_S08_latest(t: Tables) -> DataFrame:
    return t.index_daily.groupBy("index_code").agg(F.max("date").alias("date"), F.round(F.max_by("close", "date"), 6).alias("close"))


@book.query("""WITH r AS (SELECT ticker, date, volume, rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2 AS rk FROM bars)
SELECT ticker, date, rk::DOUBLE AS rank FROM r""", days=("date",))
def q_W18_average_ranks(t: Tables) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("date").orderBy("volume"))
    ranked = t.bars.select("ticker", "date", "volume", n.alias("n"))
    return ranked.select("ticker", "date", F.avg("n").over(Window.partitionBy("date", "volume")).alias("rank"))
