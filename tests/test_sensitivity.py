import random

from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import sensitivity


def _plain_spearman(a, b):
    def ranks(x):
        order = sorted(x)
        return [order.index(v) + (order.count(v) + 1) / 2 for v in x]

    ra, rb = ranks(a), ranks(b)
    m = (len(a) + 1) / 2
    cov, va, vb = sum((x - m) * (y - m) for x, y in zip(ra, rb, strict=True)), sum((x - m) ** 2 for x in ra), sum((y - m) ** 2 for y in rb)
    return round(cov / (va * vb) ** 0.5, 6) if va and vb else None


def test_agreement_of_counts_equals_that_of_rows(spark):
    rng = random.Random(5)
    pairs = [("x", a := rng.randint(0, 100), min(100, max(0, a + rng.randint(-9, 9)))) for _ in range(300)] + [("y", 50, rng.randint(0, 9)) for _ in range(20)]
    counts = spark.createDataFrame(pairs, "variant string, a int, b int").groupBy("variant", "a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") % 7 == 0).alias("opposed"))
    got = {r["variant"]: r for r in sensitivity.agreement(counts).collect()}
    a, b = zip(*[p[1:] for p in pairs if p[0] == "x"], strict=True)
    assert got["x"]["n"] == 300 and got["x"]["spearman"] == _plain_spearman(a, b) and got["y"]["spearman"] is None
    assert got["x"]["mean_change"] == round(sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 300, 4) and got["x"]["max_change"] == max(abs(x - y) for x, y in zip(a, b, strict=True))
    level = lambda v: sum(v >= c for c in (20, 45, 60, 80))
    assert got["x"]["same_band_pct"] == round(100 * sum(level(x) == level(y) for x, y in zip(a, b, strict=True)) / 300, 4)


def test_shifted_weights_sum_to_one():
    moved = dict(sensitivity.shifted_weights())
    assert len(moved) == 8 and all(abs(sum(w.values()) - 1) < 1e-12 for w in moved.values())
    assert abs(moved["breadth +0.05"]["breadth"] - 0.35) < 1e-12 and abs(moved["category -0.05"]["category"] - 0.10) < 1e-12
    assert abs(moved["breadth +0.05"]["impact"] / moved["breadth +0.05"]["authority"] - scoring.WEIGHTS["impact"] / scoring.WEIGHTS["authority"]) < 1e-12


SEEN = "ticker string, date string, r1 double, r3 double, r5 double, sigma double, mean_pct double, cons int, ratio double"


def test_settings_that_do_not_touch_a_row_leave_its_score(spark):
    rows = [("a", "1", 0.05, 0.1, 0.2, 0.02, 0.3, 4, 1.2), ("b", "1", -0.05, -0.1, -0.2, 0.02, 0.3, 4, 2.6), ("c", "1", None, None, None, None, None, None, None), ("d", "1", 0.0, None, None, 0.0, -0.15, -9, 0.1)]
    seen = spark.createDataFrame(rows, SEEN)
    base = {r["ticker"]: r for r in sensitivity.judge(seen, "s").collect()}
    assert base["c"]["s"] == 50 and base["b"]["s_opposed"] and 40 <= base["b"]["s"] <= 55 and not base["a"]["s_opposed"]
    study = {r["variant"]: r for r in sensitivity.validation_study(seen).collect()}
    assert len(study) == 13 and all(r["n"] == 4 for r in study.values())
    assert study["gate_lo 35"]["opposed_pct"] == 25.0
    checks = sensitivity.gate_checks(seen).first()
    assert (checks["n"], checks["opposed"], checks["outside_gate"], checks["strong"]) == (4, 1, 0, 1)
    empty = seen.limit(0)
    assert sensitivity.validation_study(empty).count() == 0 and sensitivity.gate_checks(empty).first()["n"] == 0


def test_equal_totals_stand_together_on_top(spark):
    parts = spark.createDataFrame([(100, 100, 100, 90, None)] * 3 + [(25, 50, 35, 50, 1)] * 17, "breadth int, authority int, impact int, category int, heat_sources long")
    got = {r["variant"]: r for r in sensitivity.importance_study(parts).collect()}
    assert len(got) == 13 and all(r["n"] == 20 and r["top_kept_pct"] == 100.0 for r in got.values())
    assert got["baseline 3"]["max_shift"] == 0 and got["hi 1.1"]["same_stars_pct"] == 100.0
