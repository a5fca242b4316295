"""Studies of the scores' settings and checks of scraped items: registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import bars, contracts, sensitivity
from tidemark.plans.book import Book, Tables
from tidemark.plans.event_queries import _HEAT, _SCORED, _importance
from tidemark.plans.market_queries import _DERIVED

book = Book()


def _listed(base: dict, variants) -> str:
    """VALUES of (variant, settings); doubles as texts, so that no digit is lost."""
    number = lambda x: f"'{float(x)!r}'::DOUBLE"
    return ", ".join(f"('{name}', {', '.join(number(patch.get(k, v)) for k, v in base.items())})" for name, patch in variants)


_USUAL = ("usual", {})
_BY_LONGEST = "CASE WHEN sigma > 0 THEN coalesce(r5, r3, r1) / nullif(sigma * sqrt(CASE WHEN r5 IS NOT NULL THEN 5 WHEN r3 IS NOT NULL THEN 3 WHEN r1 IS NOT NULL THEN 1 ELSE 0 END), 0) END"
_ADDED = lambda what: " + ".join(["0.0::DOUBLE", *(f"CASE WHEN r{k} IS NOT NULL AND sigma > 0 THEN {what.format(k=k, w=w)} ELSE 0.0 END" for k, w in scoring.BLEND.items())])
_BY_ALL = f"({_ADDED('r{k} / (sigma * sqrt({k})) * {w}::DOUBLE')}) / nullif({_ADDED('{w}::DOUBLE')}, 0)"


def _judged(rows: str, z: str) -> str:
    """rows JOINed with cfg: score, opposed, z."""
    return f"""(SELECT *, CASE WHEN opposed THEN least(greatest(whole, gate_lo), gate_hi) ELSE least(greatest(whole, 0), 100) END::INT AS score FROM (
  SELECT *, si <> 0 AND si = -sp AS opposed, round_even(round(CASE WHEN raw > 85 THEN 85 + (raw - 85) * 0.3 WHEN raw < 15 THEN 15 - (15 - raw) * 0.3 ELSE raw END, 9), 0) AS whole FROM (
  SELECT *, 50 + (w_inst * fi * si + w_price * fp * sp) * amp AS raw FROM (
  SELECT *, CASE WHEN z IS NULL OR abs(z) < min_z THEN 0 WHEN z > 0 THEN 1 ELSE -1 END AS sp, coalesce(least(abs(z) / z_div, 1), 0) AS fp FROM (
  SELECT *, {z} AS z, CASE WHEN abs(coalesce(mean_pct, 0)) < min_pct THEN 0 WHEN mean_pct > 0 THEN 1 ELSE -1 END AS si,
    least(days_weight * least(abs(coalesce(cons, 0)), days_cap) / days_cap + (1 - days_weight) * least(abs(coalesce(mean_pct, 0)) / pct_cap, 1), 1) AS fi,
    CASE WHEN vr <= 0.7 THEN 0.8 WHEN vr <= 1 THEN 0.8 + (vr - 0.7) / (1 - 0.7) * 0.2 WHEN vr >= 2.5 THEN amp_hi ELSE 1 + (vr - 1) / 1.5 * (amp_hi - 1) END AS amp
  FROM (SELECT *, coalesce(ratio, 1) AS vr FROM {rows}))))))"""


def _frame(k: int) -> str:
    known = ", ".join(f"return_{d}d AS r{d}" if d <= k else f"NULL::DOUBLE AS r{d}" for d in (1, 3, 5))
    return f"""SELECT ticker, date, {k} AS k, {known}, sigma_20d AS sigma, avg(net_vs_avg20_volume_pct) OVER f AS mean_pct, last_value(foreign_consecutive_days) OVER f AS cons, max(volume_ratio_vs_avg20) OVER f AS ratio,
  count(*) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) = 6 AS full_ FROM chips WHERE close > 0 WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING)"""


_CFG = f"cfg(variant, {', '.join(scoring.VALIDATION)}) AS (VALUES {_listed(scoring.VALIDATION, [_USUAL, *sensitivity.VALIDATION_VARIANTS])})"
_BAND = "CASE WHEN {0} >= 80 THEN 4 WHEN {0} >= 60 THEN 3 WHEN {0} >= 45 THEN 2 WHEN {0} >= 20 THEN 1 ELSE 0 END"
_AGREED = f"""k AS (SELECT *, rank() OVER (PARTITION BY variant ORDER BY a) + (count(*) OVER (PARTITION BY variant, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY variant ORDER BY b) + (count(*) OVER (PARTITION BY variant, b) - 1) / 2 AS rb FROM pairs)
SELECT variant, count(*) AS n, round(corr(ra, rb), 6) AS spearman, round(100.0::DOUBLE * count(*) FILTER ({_BAND.format("a")} = {_BAND.format("b")}) / count(*), 4) AS same_band_pct, round(sum(abs(a - b))::DOUBLE / count(*), 4) AS mean_change, max(abs(a - b)) AS max_change,
  round(100.0::DOUBLE * count(*) FILTER (opposed) / count(*), 4) AS opposed_pct FROM k GROUP BY variant"""


@book.query(f"""WITH {_DERIVED}, {_CFG}, win AS ({_frame(5)}), judged AS (SELECT ticker, date, variant, score, opposed FROM {_judged("win, cfg", _BY_LONGEST)}),
pairs AS (SELECT x.variant, u.score AS a, x.score AS b, x.opposed FROM judged x JOIN judged u ON x.ticker = u.ticker AND x.date = u.date AND u.variant = 'usual' WHERE x.variant <> 'usual'), {_AGREED}""")
def q_Q23_validation_study(t: Tables) -> DataFrame:
    """Thirteen variants of the validation score's settings over every bar's window."""
    return sensitivity.validation_study(sensitivity.windows(bars.derive(t.bars)))


@book.query(f"""WITH {_DERIVED}, {_CFG}, win AS ({_frame(5)}), judged AS (SELECT * FROM {_judged("win, cfg", _BY_LONGEST)} WHERE variant = 'usual')
SELECT count(*) AS n, count(*) FILTER (opposed) AS opposed, count(*) FILTER (opposed AND score NOT BETWEEN 40 AND 55) AS outside_gate, count(*) FILTER (opposed AND abs(z) >= 1.5 AND abs(mean_pct) >= 0.10) AS strong FROM judged""")
def q_Q23_gate_checks(t: Tables) -> DataFrame:
    return sensitivity.gate_checks(sensitivity.windows(bars.derive(t.bars)))


_MATURING = f"""{_DERIVED}, {_CFG}, aged AS ({' UNION ALL '.join(_frame(k) for k in sensitivity.MATURED)}), usual AS (SELECT * FROM cfg WHERE variant = 'usual'),
judged AS ({' UNION ALL '.join(f"SELECT '{name}' AS price, ticker, date, k, score FROM {_judged('aged, usual', z)} WHERE full_" for name, z in (("longest", _BY_LONGEST), ("blended", _BY_ALL)))})"""


@book.query(f"""WITH {_MATURING}, d AS (SELECT price, ticker, date, abs(score - lag(score) OVER (PARTITION BY price, ticker, date ORDER BY k)) AS j FROM judged), m AS (SELECT price, ticker, date, max(j) AS j FROM d GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY price ORDER BY j) - 1 AS place, count(*) OVER (PARTITION BY price) AS c FROM m)
SELECT price, count(*) AS n, round(avg(j), 4) AS mean_jump, median(j) AS median_jump, max(j) FILTER (place = floor(c * 0.95)) AS p95_jump, round(100.0::DOUBLE * count(*) FILTER (j > 15) / count(*), 4) AS over_15_pct, round(100.0::DOUBLE * count(*) FILTER (j > 25) / count(*), 4) AS over_25_pct FROM o GROUP BY price""")
def q_Q23_jumps(t: Tables) -> DataFrame:
    """How a score moves while it matures, by the longest return and by all of them."""
    return sensitivity.jumps(bars.derive(t.bars))


@book.query(f"""WITH {_DERIVED}, {_CFG}, usual AS (SELECT * FROM cfg WHERE variant = 'usual'), win AS ({_frame(5)}),
pairs AS (SELECT 'blended' AS variant, x.score AS a, y.score AS b, y.opposed FROM {_judged("win, usual", _BY_LONGEST)} x JOIN {_judged("win, usual", _BY_ALL)} y USING (ticker, date)), {_AGREED}""")
def q_Q23_price_agreement(t: Tables) -> DataFrame:
    return sensitivity.price_agreement(bars.derive(t.bars))


_SETTINGS = {**scoring.WEIGHTS, **scoring.HEAT}
_TOTAL = "least(greatest((0.0::DOUBLE + breadth * w_breadth + authority * w_authority + impact * w_impact + category * w_category) * CASE WHEN h IS NULL THEN 1.0 WHEN r <= 0.5 THEN lo WHEN r <= 1 THEN round(lo + (r - 0.5) / 0.5 * (1 - lo), 3) WHEN r >= 2.5 THEN hi ELSE round(1 + (r - 1) / 1.5 * (hi - 1), 3) END::DOUBLE, 0), 100)"
_STARS = "CASE WHEN {0} >= 80 THEN 5 WHEN {0} >= 65 THEN 4 WHEN {0} >= 50 THEN 3 WHEN {0} >= 35 THEN 2 ELSE 1 END"


@book.query(f"""WITH {_HEAT}, {_SCORED}, cfg(variant, {', '.join(['w_' + k for k in scoring.WEIGHTS] + list(scoring.HEAT))}) AS (VALUES {_listed(_SETTINGS, [_USUAL, *sensitivity.importance_variants()])}),
x AS (SELECT event_id, variant, {_TOTAL} AS total FROM (SELECT *, h / baseline AS r FROM parts, cfg)),
p AS (SELECT v.variant, round(u.total, 6) AS a, round(v.total, 6) AS b, abs({_STARS.format("v.total")} - {_STARS.format("u.total")}) AS shift FROM x v JOIN x u ON u.event_id = v.event_id AND u.variant = 'usual' WHERE v.variant <> 'usual'),
q AS (SELECT *, rank() OVER (PARTITION BY variant ORDER BY a DESC) <= greatest(1, floor(count(*) OVER (PARTITION BY variant) * 0.05)) AS ta, rank() OVER (PARTITION BY variant ORDER BY b DESC) <= greatest(1, floor(count(*) OVER (PARTITION BY variant) * 0.05)) AS tb FROM p)
SELECT variant, count(*) AS n, round(100.0::DOUBLE * count(*) FILTER (shift = 0) / count(*), 4) AS same_stars_pct, max(shift)::INT AS max_shift, round(100.0::DOUBLE * count(*) FILTER (ta AND tb) / count(*) FILTER (ta), 4) AS top_kept_pct FROM q GROUP BY variant""")
def q_Q23_weight_grid(t: Tables) -> DataFrame:
    """Every event under shifted weights and amplifiers, against the usual ones."""
    scored = _importance(t).select("score.breadth", "score.authority", "score.impact", "score.category", F.col("heat_sources_24h").alias("heat_sources"))
    return sensitivity.importance_study(scored)


# Items made of the articles: times of all kinds, missing fields, and titles that are said again.
_ITEM = """SELECT n, CASE WHEN n % 7 = 3 THEN NULL ELSE title END AS title, CASE WHEN n % 11 = 5 THEN '' ELSE url END AS url, CASE WHEN n % 13 = 6 THEN concat(title, chr(10), title, ' ', content) ELSE content END AS content,
  CASE n % 10 WHEN 0 THEN '2026-01-02T03:04:05+08:00' WHEN 1 THEN '2026-01-02 03:04:05Z' WHEN 2 THEN '2026-01-02T03:04:05' WHEN 3 THEN 'two days ago' WHEN 4 THEN '2026-02-30T03:04:05Z' WHEN 5 THEN '2026-01-02' WHEN 6 THEN NULL ELSE '2026-01-02T23:59:59.25-0330' END AS published_at FROM {}"""
_GIVEN = ", ".join(f"CASE WHEN coalesce({k}, '') = '' THEN '''{k}''' END" for k in ("title", "url", "content", "published_at"))


@book.query(rf"""WITH i AS ({_ITEM.format("articles")}), w AS (SELECT *, list_filter(string_split_regex(content, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w, lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) AS head FROM i),
b AS (SELECT * EXCLUDE (w), array_to_string(w, ' ') AS body, len(w) AS words, list_transform(range(1, len(w) - 6), lambda k: array_to_string(w[k:k + 7], ' ')) AS grams FROM w),
f AS (SELECT *, CASE WHEN words < 24 THEN 1.0 ELSE len(list_distinct(grams)) / len(grams) END::DOUBLE AS share, list_filter([{_GIVEN}], lambda x: x IS NOT NULL) AS missing FROM b)
SELECT n, CASE WHEN len(missing) > 0 THEN 'missing_fields:[' || array_to_string(missing, ', ') || ']' WHEN n % 10 IN (3, 4) THEN 'published_at_invalid' WHEN n % 10 IN (2, 5) THEN 'published_at_missing_timezone'
  WHEN length(body) < 200 THEN 'content_too_short:' || length(body)::VARCHAR WHEN head <> '' AND starts_with(lower(body), head) AND contains(substr(lower(body), length(head)::INT + 1), head) THEN 'content_repeats_title'
  WHEN share < 0.55 THEN 'content_duplicate_ratio:' || printf('%.3f', share) END AS fault FROM f""")
def q_Q22_item_faults(t: Tables) -> DataFrame:
    items = t.spark.sql(_ITEM.format("{articles}"), articles=t.articles)
    return items.select("n", contracts.item_fault(F.col("title"), F.col("url"), F.col("content"), F.col("published_at")).alias("fault"))
