"""Whitening, fill-in-the-middle and substring dedup against plain versions, with their edges."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import fill_in_middle, substring_dedup, whitening


def plain_cut(docs, least):
    """For each text, whether each word stands in a window that starts twice or more."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in docs]
    seen = {}
    for w in split:
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - least + 1):
            if seen[tuple(w[i : i + least])] > 1:
                gone.update(range(i, i + least))
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def texts():
    rng = np.random.default_rng(3)
    some = lambda n, k=400: rng.choice([f"w{i}" for i in range(k)], n).tolist()
    shared, twice = some(60), some(36)
    out = [None, "", " \n\t", "one two", " ".join(some(35)), " x y z"]
    out += [" ".join(some(30) + shared + some(25)) for _ in range(30)]  # a passage with its own margins everywhere
    out += [" ".join(some(10) + shared[5:40] + some(10)), " ".join(shared[5:39])]  # exactly a window, and one word less
    out += [" ".join(twice + some(7) + twice)]  # twice in one text
    out += ["a " * 36, "a " * 35, "b " * 34, "ab cd " * 40, "x y z " * 300]  # periodic
    copy = some(80)
    out += [" ".join(copy)] * 3 + ["\n".join(copy)]  # equal words, other blanks
    near = some(200)
    for i in range(25):
        v = list(near)
        for _ in range(i % 4):
            v[int(rng.integers(200))] = "edited"
        out.append(" ".join(v))
    out.append(" ".join(some(4000, 3)))  # a small alphabet
    out.append("é" * 2000 + " " + " ".join(shared) + " 😀")
    return out


@pytest.mark.parametrize("hot", [1000, 4])
@pytest.mark.parametrize("least", [35, 6])
def test_removed_words_match_brute_force(spark, hot, least):
    all_texts = texts()
    rows = [(i % 7 if i % 5 else None, t, i, "s") for i, t in enumerate(all_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, extra string")
    got = substring_dedup.dedup(docs.withColumn("at", F.col("n_words")), least=least, hot=hot)
    assert set(got.columns) == {"doc_id", "text", "extra", "at", "n_words", "n_removed"}
    have = {r["at"]: (r["n_words"], r["n_removed"], r["text"]) for r in got.collect()}
    assert [have[i] for i in range(len(all_texts))] == plain_cut(all_texts, least)


def test_no_rows_and_nothing_that_recurs(spark):
    kind = "doc_id long, text string"
    assert substring_dedup.dedup(spark.createDataFrame([], kind)).count() == 0
    lone = substring_dedup.dedup(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(90)))], kind)).first()
    assert (lone["n_words"], lone["n_removed"]) == (90, 0)


def test_automaton_counts_every_sequence():
    rng = np.random.default_rng(8)
    added = [rng.integers(0, 3, int(rng.integers(1, 14))).tolist() for _ in range(12)]
    automaton = substring_dedup.SuffixAutomaton()
    for i, s in enumerate(added):
        automaton.add(s, 1 + i % 2)
    for times in (2, 3, 5):
        best = automaton.recurring(times)
        strange = [*rng.integers(0, 3, 30).tolist(), 9, *rng.integers(0, 3, 30).tolist()]
        for s in [*added, strange]:
            want = set()
            for i in range(len(s)):
                for j in range(i + 4, len(s) + 1):
                    n = sum((1 + k % 2) * sum(t[p : p + j - i] == s[i:j] for p in range(len(t))) for k, t in enumerate(added))
                    if n >= times:
                        want.update(range(i, j))
            assert {p for a, b in automaton.spans(s, best, 4) for p in range(a, b)} == want


GRAMMARS = {
    r"[\s\S]": fill_in_middle.CHARACTERS,
    r"[A-Za-z]+|[^A-Za-z]": fill_in_middle.LETTER_RUNS,
    r"[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+": fill_in_middle.WORDS,
    r"[^\n]+|\n": fill_in_middle.LINES,
}
HARD = ["", "a", "7", "ab", "a1", "😀", "a😀b😀😀c", "퟿x", "ab  cd\n\n12é", "\x00a\x00", "ß<P", "é", "\n", "x\r\ny"]


@pytest.mark.parametrize("pattern", GRAMMARS)
def test_units_are_those_of_the_grammar(spark, pattern):
    df = spark.createDataFrame([(t,) for t in [*HARD, "word 12 " * 5000]], "text string")
    rows = df.select("text", fill_in_middle.units(F.col("text"), GRAMMARS[pattern]).alias("u")).collect()
    for r in rows:
        assert r["u"] == re.findall(pattern, r["text"])


def test_fill_in_middle_against_a_plain_version(spark):
    rows = [(i, t) for i, t in enumerate([*HARD, None, "has <S> inside", "<M>", "<P", "<<P>", "a<P b"] * 25)] + [(None, "no id at all"), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash"))
    got = fill_in_middle.transform(df).withColumn("back", fill_in_middle.restore(F.col("output"), F.col("form")))
    forms = set()
    for r in got.collect():
        text = r["text"] or ""
        u = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
        h = hashlib.sha256(f"1:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        plain = not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90
        form = "plain" if plain else "spm" if h4 % 100 < 20 else "psm"
        forms.add(form)
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r["n_units"], r["form"], r["output"], r["back"]) == (len(u), form, want, text)
        assert (r["prefix"], r["middle"], r["suffix"]) == ((None,) * 3 if plain else (p, m, s))
    assert forms == {"plain", "psm", "spm"}
    assert fill_in_middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def whitened(spark, rows, k=8):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string")
    return whitening.whiten(df, k).toPandas()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12)) @ rng.normal(size=(12, 12)) + 5
    bad = [(900, None, "z"), (901, [], "z"), (902, [1.0, None] + [0.0] * 10, "z"), (903, [float("nan")] * 12, "z"), (904, [float("inf")] * 12, "z"), (905, [1.0] * 11, "z")]
    got = whitened(spark, [(i if i else None, v.tolist(), "c") for i, v in enumerate(x)] + bad + [(7, x[7].tolist(), "again")])
    x = np.vstack([x, x[7]])
    assert len(got) == 301 * 8 and (got["n"] == 301).all() and list(got.columns).count("n") == 1
    whole = [[int(v) for v in row] for row in np.floor(1024 * x).astype(int) + 100_000]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    c = np.array(whole) - np.array(sums) / 301
    e, u = np.linalg.eigh(c.T @ c / 301)
    z = c @ u[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])
    for row in (1, 44, 299):
        mine = got[got["vec_id"] == row].sort_values("component")
        assert np.allclose(abs(mine["whitened"].to_numpy()), abs(z[row]), rtol=1e-9, atol=1e-11)
        assert set(mine["deviation"]) == {sum((301 * a - s) ** 2 for a, s in zip(whole[row], sums, strict=True))}
    assert np.allclose(got.groupby("component")["explained"].first(), e[::-1][:8] / e.sum(), rtol=1e-10)
    assert 0 <= got["identity_error"].iloc[0] < 1e-9
    assert len(got[got["vec_id"] == 7]) == 16  # a repeated row counts twice


def test_whitening_of_few_rows_and_flat_or_huge_values(spark):
    assert whitened(spark, []).empty and whitened(spark, [(1, None, "")]).empty
    one = whitened(spark, [(1, [1.0, 2.0], "")])
    assert len(one) == 2 and one["whitened"].isna().all() and one["explained"].isna().all() and set(one["deviation"]) == {0}
    flat = whitened(spark, [(i, [float(i), 3.0], "") for i in range(5)])
    assert flat[flat["component"] == 1]["whitened"].notna().all() and flat[flat["component"] == 2]["whitened"].isna().all()
    huge = whitened(spark, [(i, [1e300 * (i % 3 - 1), float(i)], "") for i in range(9)])
    assert huge[huge["vec_id"] % 3 != 1]["deviation"].isna().all() and huge["identity_error"].iloc[0] < 1e-9
