"""Importance and market-validation scores as column expressions.

Settings are keyword arguments that take numbers or columns, so that a table of variants can be
joined and scored at once.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the scoring rules, in their own order.
WEIGHTS = {"breadth": 0.30, "authority": 0.25, "impact": 0.30, "category": 0.15}
BREADTH = {1: 25, 2: 45, 3: 60, 4: 70, 5: 80, 6: 85, 7: 92}
TIERS = (
    (100, ("mops", "公開資訊觀測站", "證交所", "櫃買", "金管會", "央行")),
    (70, ("工商時報", "經濟日報", "中央社")),
    (55, ("鉅亨", "anue", "自由財經", "聯合", "yahoo")),
    (30, ("telegram", "分析師", "論壇", "ptt", "dcard")),
)
HEAVYWEIGHTS = ("2330", "2317", "2454", "2308", "2382", "2412", "2881", "2882", "2891", "3711", "2303", "2886", "2884", "1216", "2002")
CATEGORIES = {"法說": 90, "財報": 85, "政策": 85, "關稅": 80, "產業供需": 70, "AI/科技": 65, "營收": 60, "技術突破": 55, "法人動向": 40}
STAR_CUTS = ((80, 5), (65, 4), (50, 3), (35, 2))
VALIDATION = {"w_inst": 25.0, "w_price": 20.0, "days_cap": 5.0, "pct_cap": 0.20, "days_weight": 0.3, "z_div": 2.0, "min_pct": 0.01, "min_z": 0.3, "gate_lo": 40.0, "gate_hi": 55.0, "amp_hi": 1.15}
HEAT = {"baseline": 2.0, "lo": 0.90, "hi": 1.15}
BLEND = {1: 0.2, 3: 0.3, 5: 0.5}


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def breadth(n: Column) -> Column:
    n = F.greatest(F.coalesce(n, F.lit(1)), F.lit(1))
    out = F.when(n >= 8, 100)
    for k, s in BREADTH.items():
        out = out.when(n == k, s)
    return out.otherwise(25)


def _holds(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w.lower())
    return found


def source_tier(source: Column) -> Column:
    """The first tier with a keyword in the source's name; null if none has."""
    s, out = F.lower(source), F.lit(None).cast("int")
    for score, words in reversed(TIERS):
        out = F.when(_holds(s, words), F.lit(score)).otherwise(out)
    return out


def authority(sources: Column, status: Column) -> Column:
    """sources: array of the members' source names; null counts as empty."""
    sources = F.coalesce(sources, F.array().cast("array<string>"))
    joined = F.lower(F.array_join(sources, " "))
    official = F.when(_holds(joined, TIERS[0][1]), 100).when(_holds(joined, TIERS[1][1]), 85).otherwise(72)
    best = F.coalesce(F.array_max(F.transform(sources, source_tier)), F.lit(50))
    return F.when(status == "official_confirmed", official).when(status == "rumor_unconfirmed", F.least(best, F.lit(30))).otherwise(best)


# The impact of policy, of an industry, of several, two, one leading, one other and no ticker.
IMPACT = {"policy": 100, "industry": 75, "several": 70, "two": 60, "leader": 65, "one": 45, "none": 35}


def impact(tickers: Column, categories: Column) -> Column:
    cats = F.coalesce(categories, F.array().cast("array<string>"))
    tks = F.coalesce(tickers, F.array().cast("array<string>"))
    any_of = lambda *names: F.arrays_overlap(cats, F.array(*map(F.lit, names)))
    return (
        F.when(any_of("政策", "關稅"), IMPACT["policy"])
        .when(any_of("產業供需", "AI/科技"), IMPACT["industry"])
        .when(F.size(tks) >= 3, IMPACT["several"])
        .when(F.size(tks) == 2, IMPACT["two"])
        .when((F.size(tks) == 1) & F.get(tks, F.lit(0)).isin(*HEAVYWEIGHTS), IMPACT["leader"])
        .when(F.size(tks) == 1, IMPACT["one"])
        .otherwise(IMPACT["none"])
    )


def category(categories: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(categories, _category_score)), F.lit(50))


def piecewise(x: Column, lo, lo_y, mid, mid_y, hi, hi_y) -> Column:
    """lo_y up to lo, hi_y from hi, straight lines over mid in between."""
    lo, lo_y, mid, mid_y, hi, hi_y = map(_col, (lo, lo_y, mid, mid_y, hi, hi_y))
    return (
        F.when(x <= lo, lo_y)
        .when(x <= mid, lo_y + (x - lo) / (mid - lo) * (mid_y - lo_y))
        .when(x >= hi, hi_y)
        .otherwise(mid_y + (x - mid) / (hi - mid) * (hi_y - mid_y))
    )


def heat(sources_24h: Column, cfg: Mapping = HEAT) -> Column:
    """Amplifier, lo to hi, of the number of sources within a day; unknown: 1."""
    ratio = F.greatest(sources_24h.cast("double"), F.lit(0.0)) / _col(cfg["baseline"])
    return F.coalesce(F.round(piecewise(ratio, 0.5, cfg["lo"], 1.0, 1.0, 2.5, cfg["hi"]), 3), F.lit(1.0))


def importance(source_count: Column, sources: Column, status: Column, tickers: Column, categories: Column, heat_sources: Column, weights: Mapping = WEIGHTS) -> Column:
    """struct(breadth, authority, impact, category, amp, total, stars); stars are cut on the
    total before it is rounded."""
    parts = {"breadth": breadth(source_count), "authority": authority(sources, status), "impact": impact(tickers, categories), "category": category(categories)}
    amp = heat(heat_sources)
    sum_ = weighted(parts, amp, weights)
    return F.struct(*[s.cast("int").alias(k) for k, s in parts.items()], amp.alias("amp"), F.round(sum_, 6).alias("total"), star_count(sum_).cast("int").alias("stars"))


def weighted(parts: Mapping[str, Column], amp: Column, weights: Mapping = WEIGHTS) -> Column:
    """The dimensions' weighted sum, amplified, within 0 and 100.

    Doubles like 64.99999999999999 are what the weights' sum gives; both cuts and digits follow it.
    """
    total = F.lit(0.0)
    for k, s in parts.items():
        total = total + s * _col(weights[k])
    return F.least(F.greatest(total * amp, F.lit(0.0)), F.lit(100.0))


def star_count(total: Column) -> Column:
    stars = F.lit(1)
    for cut, star in reversed(STAR_CUTS):
        stars = F.when(total >= cut, star).otherwise(stars)
    return stars


# The texts that explain a score.
WHY = {
    "official_first": "第一手：官方來源在場（MOPS 等）",
    "official_second": "二手：主流媒體轉述官方",
    "official_other": "二手：一般媒體轉述官方",
    "rumor": "消息未經證實（謠言階段），權威性受限",
    "official": "含官方來源（%s）",
    "leading": "主流財經媒體（%s）",
    "financial": "一般財經媒體（%s）",
    "social": "僅社群/分析師來源，未經證實",
    "ordinary": "來源等級一般",
    "policy": "總經/政策層級，影響全市場",
    "industry": "產業層級，影響整條供應鏈",
    "several": "牽動 %d 檔個股",
    "two": "牽動 2 檔個股",
    "leader": "權值股 %s（單檔但足以牽動大盤）",
    "one": "單一個股 %s",
    "none": "無明確標的",
    "untyped": "類型未標",
    "type": "事件類型「%s」",
    "type_high": "（高影響類型）",
    "type_middle": "（中影響類型）",
    "type_routine": "（例行揭露類型）",
    "breadth": "%d 家獨立來源報導",
    "breadth_wide": "（廣泛關注）",
    "breadth_middle": "（多方報導）",
    "breadth_narrow": "（來源有限）",
    "heat_unknown": "熱度資料不足，不調整",
    "heat_fast": "24h 內 %d 家跟進（快速發酵）",
    "heat_slow": "24h 內僅 %d 家報導（乏人問津）",
    "heat_usual": "24h 內 %d 家跟進（一般熱度）",
}


def _first_best(items: Column, worth) -> Column:
    """The first of an array's items with the largest worth; null if none has any."""
    kind = "struct<w: int, s: string>"
    each = F.transform(items, lambda x: F.struct(worth(x).cast("int").alias("w"), x.alias("s")).cast(kind))
    return F.aggregate(each, F.lit(None).cast(kind), lambda acc, x: F.when(x["w"].isNotNull() & (acc["w"].isNull() | (x["w"] > acc["w"])), x).otherwise(acc))["s"]


def _category_score(c: Column) -> Column:
    out = F.lit(50)
    for name, s in CATEGORIES.items():
        out = F.when(c == name, F.lit(s)).otherwise(out)
    return out


def explanations(source_count: Column, sources: Column, status: Column, tickers: Column, categories: Column, heat_sources: Column) -> dict[str, Column]:
    """Why each dimension of importance() is what it is, and the amplifier."""
    text = lambda k, *args: F.format_string(WHY[k], *args) if args else F.lit(WHY[k])
    sources = F.coalesce(sources, F.array().cast("array<string>"))
    score, name = authority(sources, status), _first_best(sources, source_tier)
    joined = F.lower(F.array_join(sources, " "))
    by_status = F.when(_holds(joined, TIERS[0][1]), text("official_first")).when(_holds(joined, TIERS[1][1]), text("official_second")).otherwise(text("official_other"))
    label = F.coalesce(name, F.lit("一般來源"))
    graded = F.when(score >= 100, text("official", label)).when(score >= 70, text("leading", label)).when(score >= 55, text("financial", label)).when(score <= 30, text("social")).otherwise(text("ordinary"))
    cats, tks = F.coalesce(categories, F.array().cast("array<string>")), F.coalesce(tickers, F.array().cast("array<string>"))
    worth = impact(tks, cats)
    reach = (
        F.when(worth == IMPACT["policy"], text("policy")).when(worth == IMPACT["industry"], text("industry")).when(worth == IMPACT["several"], text("several", F.size(tks)))
        .when(worth == IMPACT["two"], text("two")).when(worth == IMPACT["leader"], text("leader", F.get(tks, F.lit(0)))).when(worth == IMPACT["one"], text("one", F.get(tks, F.lit(0)))).otherwise(text("none"))
    )
    best = category(cats)
    kind = F.concat(text("type", _first_best(cats, _category_score)), F.when(best >= 80, text("type_high")).when(best >= 60, text("type_middle")).otherwise(text("type_routine")))
    seen = breadth(source_count)
    width = F.when(seen >= 80, text("breadth_wide")).when(seen >= 60, text("breadth_middle")).otherwise(text("breadth_narrow"))
    amp = piecewise(F.greatest(heat_sources.cast("double"), F.lit(0.0)) / 2.0, 0.5, 0.90, 1.0, 1.0, 2.5, 1.15)
    heat_n = heat_sources.cast("int")
    warmth = F.when(heat_sources.isNull(), text("heat_unknown")).when(amp >= 1.10, text("heat_fast", heat_n)).when(amp <= 0.95, text("heat_slow", heat_n)).otherwise(text("heat_usual", heat_n))
    return {
        "breadth": F.concat(text("breadth", F.greatest(F.coalesce(source_count, F.lit(1)), F.lit(1)).cast("int")), width),
        "authority": F.when(status == "official_confirmed", by_status).when(status == "rumor_unconfirmed", text("rumor")).otherwise(graded),
        "impact": reach,
        "category": F.when(F.size(cats) == 0, text("untyped")).otherwise(kind),
        "heat": warmth,
    }


def reasons(score: Column, why: Mapping[str, Column]) -> Column:
    """One line a dimension, in their fixed order, and the amplifier's; why: explanations()."""
    labels = {"breadth": "來源廣度", "authority": "來源權威", "impact": "影響範圍", "category": "事件類型"}
    lines = [F.concat(F.format_string(f"[{name} %d分×{int(WEIGHTS[k] * 100)}%%] ", score[k]), why[k]) for k, name in labels.items()]
    short = F.regexp_replace(F.format_string("%.3f", score["amp"]), r"\.?0+$", "")
    return F.array(*lines, F.concat(F.lit("[熱度 ×"), short, F.lit("] "), why["heat"]))


def institution_signal(mean_pct: Column, consecutive: Column, cfg: Mapping = VALIDATION) -> tuple[Column, Column]:
    """(direction, strength 0..1) of institutional flows over an event's window."""
    mean = F.coalesce(mean_pct, F.lit(0.0))
    sign = F.when(F.abs(mean) < _col(cfg["min_pct"]), 0).when(mean > 0, 1).otherwise(-1)
    days = _col(cfg["days_weight"]) * F.least(F.abs(F.coalesce(consecutive, F.lit(0))).cast("double"), _col(cfg["days_cap"])) / _col(cfg["days_cap"])
    pct = (1 - _col(cfg["days_weight"])) * F.least(F.abs(mean) / _col(cfg["pct_cap"]), F.lit(1.0))
    return sign, F.least(days + pct, F.lit(1.0))


def price_signal(r1: Column, r3: Column, r5: Column, sigma: Column, cfg: Mapping = VALIDATION) -> tuple[Column, Column, Column]:
    """(direction, strength, days matured): the longest matured return over its volatility."""
    k = F.when(r5.isNotNull(), 5).when(r3.isNotNull(), 3).when(r1.isNotNull(), 1).otherwise(0)
    ret = F.coalesce(r5, r3, r1)
    z = F.when(sigma > 0, F.try_divide(ret, sigma * F.sqrt(k.cast("double"))))
    return _direction(z, cfg), F.coalesce(F.least(F.abs(z) / _col(cfg["z_div"]), F.lit(1.0)), F.lit(0.0)), k


def _direction(z: Column, cfg: Mapping) -> Column:
    return F.when(z.isNull() | (F.abs(z) < _col(cfg["min_z"])), 0).when(z > 0, 1).otherwise(-1)


def blended_price_signal(r1: Column, r3: Column, r5: Column, sigma: Column, cfg: Mapping = VALIDATION) -> tuple[Column, Column, Column]:
    """As price_signal, with all matured returns weighed together."""
    total, weight, k = F.lit(0.0), F.lit(0.0), F.lit(0)
    for days, r in ((1, r1), (3, r3), (5, r5)):
        there = r.isNotNull() & (sigma > 0)
        total = total + F.when(there, F.try_divide(r, sigma * (days**0.5)) * BLEND[days]).otherwise(0.0)
        weight = weight + F.when(there, BLEND[days]).otherwise(0.0)
        k = F.when(there, days).otherwise(k)
    z = F.try_divide(total, weight)
    return _direction(z, cfg), F.coalesce(F.least(F.abs(z) / _col(cfg["z_div"]), F.lit(1.0)), F.lit(0.0)), k


def volume_amplifier(max_ratio: Column, cfg: Mapping = VALIDATION) -> Column:
    return piecewise(F.coalesce(max_ratio, F.lit(1.0)), 0.7, 0.80, 1.0, 1.0, 2.5, cfg["amp_hi"])


def verify_state(k: Column) -> Column:
    return F.when(k >= 5, "verified").when(k >= 1, "preliminary").otherwise("observing")


def validation(i_sign: Column, i_strength: Column, p_sign: Column, p_strength: Column, amp: Column, direction: Column, confidence: Column, cfg: Mapping = VALIDATION) -> Column:
    """Score 0..100 rounded half to even; null for neutral or low-confidence events.

    Ends over 85 and under 15 are compressed to 0.3; signals that oppose one another hold the
    score within the gate.
    """
    e = F.when(direction == "利多", 1).otherwise(-1)
    raw = 50 + (_col(cfg["w_inst"]) * i_strength * (i_sign * e) + _col(cfg["w_price"]) * p_strength * (p_sign * e)) * amp
    soft = F.when(raw > 85, 85 + (raw - 85) * 0.3).when(raw < 15, 15 - (15 - raw) * 0.3).otherwise(raw)
    whole = F.bround(F.round(soft, 9), 0)
    opposed = (i_sign != 0) & (p_sign != 0) & (i_sign == -p_sign)
    held = F.when(opposed, F.least(F.greatest(whole, _col(cfg["gate_lo"])), _col(cfg["gate_hi"]))).otherwise(F.least(F.greatest(whole, F.lit(0.0)), F.lit(100.0)))
    return F.when((direction == "中性") | (confidence == "low"), F.lit(None)).otherwise(held).cast("int")


def band(score: Column) -> Column:
    return F.when(score >= 80, "strong").when(score >= 60, "supportive").when(score >= 45, "neutral").when(score >= 20, "weak").otherwise("contrary")


def reaction_label(score: Column) -> Column:
    return F.when(score < 45, "背離").when(score < 60, "中性").when(score >= 60, "支持")


def no_score_reason(direction: Column, tickers: Column, state: Column, score: Column) -> Column:
    first = F.get(F.coalesce(tickers, F.array().cast("array<string>")), F.lit(0))
    return F.when(score.isNotNull(), F.lit(None)).when(direction == "中性", "neutral").when(first.isNull(), "no_ticker").when(~first.rlike(r"^[1-9][0-9]{3}$"), "not_common_stock").when(state == "verified", "verified_unscored").otherwise("observing")


def wilson_lower(hits: Column, n: Column, z: float = 1.96) -> Column:
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p = hits.cast("double") / n
    root = F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)
    return F.when(p > 0, (p + z * z / (2 * n) - z * root) / (1 + z * z / n)).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(x, F.lit(-35.0)), F.lit(35.0))))


def advance_share(up: Column, down: Column) -> Column:
    """Share of advancers among those that moved; one half if none did."""
    return F.coalesce(F.try_divide(up.cast("double"), (up + down).cast("double")), F.lit(0.5))
