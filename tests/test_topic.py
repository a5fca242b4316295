"""Topic classifiers: features and decisions, training against a plain optimum, the gate."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import topic


def plain_features(title, content, dimensions):
    read = (" ".join((title or "").split()) + "\n" + " ".join((content or "").split())[:50]).strip()
    return sorted({int(hashlib.md5(read[i : i + 3].encode()).hexdigest()[:4], 16) % dimensions for i in range(len(read) - 2)})


ITEMS = [("央行升息", "利率 上升 " * 30), ("", ""), (None, None), ("ab", None), ("a  b\tc", "x\n y"), ("long", "word " * 50_000), ("twice", "same"), ("twice", "same")]


def test_features_and_decisions_against_a_plain_version(spark):
    rng = np.random.default_rng(1)
    model = [topic.Classifier(n, tuple(rng.normal(size=16).tolist()), 0.1, 2.0, -0.2, 0.6, 0.4) for n in ("finance", "policy")]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(ITEMS)], "n int, title string, content string")
    got = {r["n"]: r for r in topic.classify(df.withColumn("found", topic.features(F.col("title"), F.col("content"), 16)), model, F.col("found")).collect()}
    kinds = set()
    for i, item in enumerate(ITEMS):
        at = plain_features(*item, 16)
        assert sorted(got[i]["found"]) == at
        scores = []
        for c in model:
            raw = sum(c.coef[b] for b in at) / math.sqrt(len(at)) + c.intercept if at else c.intercept
            scores.append(1 / (1 + math.exp(-(2 * raw - 0.2))))
            assert got[i][f"score_{c.label}"] == pytest.approx(scores[-1], abs=2e-6)
        labels = [c.label for c, s in zip(model, scores, strict=True) if s >= 0.6]
        assert got[i]["labels"] == labels
        want = "accept" if labels else "reject" if max(scores) <= 0.4 else "review"
        kinds.add(want)
        assert got[i]["decision"] == want
    assert len(kinds) > 1 and topic.from_rows(topic.as_rows(spark, model)) == model
    assert topic.classify(df.limit(0), model).count() == 0
    with pytest.raises(ValueError, match="below the accept"):
        topic.Classifier("x", (), 0.0, 1.0, 0.0, 0.5, 0.5)


def test_features_are_made_once_and_read_the_beginning_only(spark, monkeypatch):
    import time

    from tidemark.functions import text

    body = ("ab \u3000\n" * 200_000, "\t" * 70_000 + "x y" + " " * 70_000 + "z", "界" * 90_000, "", None, "one  two")
    df = spark.createDataFrame([(i, "t", c) for i, c in enumerate(body)], "n int, title string, content string")
    got = {r["n"]: r["x"] for r in df.select("n", text.feature_text(F.col("title"), F.col("content")).alias("x")).collect()}
    assert got == {i: ("t\n" + " ".join((c or "").split())[:50]).strip() for i, c in enumerate(body)}
    many = spark.range(400).select(F.lit("a title of a text with some more words").alias("title"), F.concat(F.repeat(F.lit("ab cd\n"), 20_000), "id").alias("content"))
    began = time.time()
    assert many.select(F.max(F.size(topic.features(F.col("title"), F.col("content"))))).first()[0] > 20
    assert time.time() - began < 20  # 48 MB of text, read once: a second or two; for each run of characters: minutes
    plans = []
    monkeypatch.setattr(topic, "logistic", lambda rows, *a, own=topic.logistic, **k: plans.append(rows._jdf.queryExecution().toString()) or own(rows, *a, **k))
    rows = [(f"{'bank rate' if i % 2 else 'storm wind'} {i}", "", ["train", "calibration", "test"][i % 3], i % 2) for i in range(180)]
    topic.train(spark.createDataFrame(rows, "title string, content string, split string, money int"), ["money"], 0.8, 0.8)
    assert plans and not any("md5" in p for p in plans)


def test_regression_finds_the_optimum_under_any_partitioning(spark):
    rng = np.random.default_rng(2)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    y = (x @ np.array([2.0, -1.0, 0.5, 0, 0, 3.0]) + rng.normal(size=300) > 3).astype(int)
    rows = [(int(t), [int(k) for k in np.flatnonzero(r)], [1.0] * int(r.sum())) for r, t in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "y int, at array<int>, x array<double>")
    for balanced in (True, False):
        weight = np.where(y == 1, 300 / (2 * y.sum()), 300 / (2 * (1 - y).sum())) if balanced else np.ones(300)
        found = [topic.logistic(df.repartition(n), 6, balanced) for n in (1, 3)]
        w = np.append(*found[0])
        full = np.c_[x, np.ones(300)]
        gradient = full.T @ (weight * (1 / (1 + np.exp(-full @ w)) - y)) + w
        assert np.abs(gradient).max() < 1e-9
        assert np.allclose(w, np.append(*found[1]), atol=1e-10)
    with pytest.raises(ValueError, match="both labels"):
        topic.logistic(df.filter("y = 1"), 6, True)


def test_thresholds_against_a_plain_version(spark):
    rng = np.random.default_rng(3)
    s = np.round(rng.random(400), 2)
    y = (rng.random(400) < s).astype(int)
    accept, reject = topic.thresholds(spark.createDataFrame(list(zip(s.tolist(), y.tolist(), strict=True)), "score double, y int"), 0.8, 0.8, 12)
    fine = [t for t in set(s.tolist()) if (s >= t).sum() >= 12 and y[s >= t].mean() >= 0.8]
    low = [t for t in set(s.tolist()) if t < min(fine) and (s <= t).sum() >= 12 and 1 - y[s <= t].mean() >= 0.8]
    assert (accept, reject) == (min(fine), max(low))
    with pytest.raises(ValueError, match="precision"):
        topic.thresholds(spark.createDataFrame([(0.5, 0)] * 20, "score double, y int"), 0.9, 0.9, 5)


def test_training_measures_on_other_rows_and_the_gate_decides(spark):
    rng = np.random.default_rng(4)
    kinds = {"money": ["bank", "rate", "bond", "share"], "rain": ["cloud", "storm", "wind", "sleet"]}
    rows = []
    for i in range(360):
        of = list(kinds)[i % 2]
        rows.append((" ".join(rng.choice(kinds[of], 5)), "", ["train", "calibration", "test"][i % 3], int(of == "money"), i % 4))
    df = spark.createDataFrame(rows, "title string, content string, split string, money int, site int")
    model, metrics = topic.train(df, ["money"], 0.9, 0.9)
    m = metrics.first()
    assert (m["count"], m["positives"]) == (120, 60) and m["accept_precision"] > 0.8 and m["positive_recall"] > 0.9 and m["npv"] > 0.8
    assert m["accept_count"] + m["reject_count"] + m["review_count"] == 120
    decided = topic.classify(df.filter("split = 'test'"), model)
    for mode, verdict, passes in (("enforce", True, True), ("shadow", True, True), ("off", None, True)):
        assert {(r["gate_pass"], r["passes"]) for r in topic.gate(decided.filter("money = 1"), ["site"], 3, 0.6, mode).collect()} == {(verdict, passes)}
    assert {(r["gate_pass"], r["passes"]) for r in topic.gate(decided.filter("money = 0"), ["site"], 3, 0.6).collect()} == {(False, False)}
    with pytest.raises(ValueError, match="no mode"):
        topic.gate(decided, ["site"], mode="sometimes")
