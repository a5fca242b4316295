"""SimHash, embeddings and line dedup against brute force."""

import numpy as np
import pytest
import xxhash

from tidemark.llm import embedding_dedup, line_dedup, simhash


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text, n):
    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [" ".join(rng.choice([f"w{i}" for i in range(500)], 120)) for _ in range(30)]
    rows = [(None, None), (3, ""), (4, " \n"), (5, "One two"), (6, "one TWO"), (7, "a b c d")]
    for i in range(160):
        w = base[i % 30].split()
        for _ in range(i // 60):
            w[int(rng.integers(len(w)))] = "changed"
        rows.append((100 + i, " ".join(w)))
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted(((r["doc_id"], r["text_hash"], r["fp"], r["component_id"]) for r in simhash.near_duplicates(d, n=4).collect()), key=lambda r: (r[0] is not None, r[0]))
    fps = [plain_fingerprint(t, 4) for _, t in rows]
    assert [g[2] & (2**64 - 1) for g in got] == fps
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4]
    parts = components(len(rows), links)
    least = {}
    for (i, _), p in zip(rows, parts, strict=True):
        if i is not None:
            least[p] = min(i, least.get(p, i))
    assert [g[3] for g in got] == [least.get(p) for p in parts]


@pytest.mark.parametrize("block", [8, 4096])
def test_links_keep_components_of_dense_groups(spark, monkeypatch, block):
    rng = np.random.default_rng(6)
    fps = {int(x) for x in rng.integers(-(2**63), 2**63 - 1, 300)}
    for center in (0, 2**40 + 5):
        for _ in range(200):
            x = center
            for b in rng.integers(0, 63, 2):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    d = spark.createDataFrame([(x,) for x in fps], "fp long")
    monkeypatch.setattr(simhash, "SHORT", 4)
    got = [(r["a"], r["b"]) for r in simhash.link_fingerprints(d, 4).collect()] if block == 4096 else _local_links(fps, block, monkeypatch)
    at = {x: i for i, x in enumerate(fps)}
    u = np.array(fps, np.int64).view(np.uint64)
    exact = [(i, j) for i in range(len(fps)) for j in np.nonzero(np.bitwise_count(u[i] ^ u[:i]) <= 4)[0]]
    assert all(((a ^ b) & (2**64 - 1)).bit_count() <= 64 for a, b in got)
    assert components(len(fps), [(at[a], at[b]) for a, b in got]) == components(len(fps), exact)


def _local_links(fps, block, monkeypatch):
    """The two kernels over small blocks, without Spark between them."""
    import pyarrow as pa

    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = []
    for number, (low, width) in enumerate(simhash._segments(4)):
        for bit in range(width):
            for x in fps:
                part = ((x & (2**64 - 1)) >> low) & ((1 << width) - 1) & ~(1 << bit)
                rows.append((part | (number * 64 + bit) << 40, x))
    rows.sort()
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows[i : i + 700]]), pa.array([x for _, x in rows[i : i + 700]])], ["key", "fp"]) for i in range(0, len(rows), 700)]
    out = [r for b in simhash._within(4)(iter(batches)) for r in b.to_pylist()]
    links = [(r["a"], r["b"]) for r in out if r["block"] < 0]
    blocks = {}
    for r in out:
        if r["block"] >= 0:
            blocks.setdefault(r["key"], {}).setdefault(r["block"], []).append(r["a"])
    assert any(len(b) > 2 for b in blocks.values())
    for key, by in blocks.items():
        for i in sorted(by):
            for j in sorted(by):
                if i < j:
                    got = [(key, i, j, k, x) for k in (i, j) for x in by[k]]
                    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got, strict=True)], ["key", "i", "j", "block", "fp"])
                    links += [(r["a"], r["b"]) for b in simhash._across(4)(iter([batch])) for r in b.to_pylist()]
    return links


def test_keep_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(2, text, "a"), (1, text, "b"), (1, text, "b"), (None, text, "c"), (3, "quite another text of its own", "d"), (4, None, "e"), (5, "", "f")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = simhash.keep_one(d).collect()
    assert sorted((r["doc_id"], r["source"]) for r in kept) == [(1, "b"), (3, "d"), (4, "e")]
    assert kept[0].asDict().keys() == {"doc_id", "text", "source"}
    assert simhash.keep_one(d.limit(0)).count() == 0


@pytest.mark.parametrize("width", [2048, 8, 3])
def test_embeddings_match_brute_force(spark, width):
    """With one level of lists, with two and with four."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(900):
        if i % 3 == 0 or not rows:
            v = rng.normal(size=16)
        else:
            v = np.array(rows[-1][1]) + rng.normal(size=16) * rng.choice([0.05, 0.12, 0.2])
        rows.append((i, [float(x) for x in v], int(i // 3 % 3)))
    rows += [(2000, rows[0][1], 0), (2001, rows[0][1], 0), (2002, rows[0][1], 1)]
    odd = [(3000, None, 0), (3001, [], 0), (3002, [0.0] * 16, 0), (3003, [None, *[1.0] * 15], 0), (3004, [float("nan")] * 16, 0), (3005, [float("inf")] * 16, 0), (3006, rows[0][1], None), (3007, rows[0][1][:8], 0), (None, rows[3][1], 1)]
    d = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows + odd], "vec_id long, embedding array<double>, label int, n_links string")
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(d, list_size=32, probes=8, width=width).collect()}
    everything = [*rows, odd[-1]]
    x = np.array([r[1] for r in everything])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in everything])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    exact, found = near.sum(axis=1), np.array([got[r[0]]["n_links"] for r in everything])
    assert (found <= exact).all() and found.sum() >= 0.97 * exact.sum()
    assert got[2000]["component_id"] == 0 and got[2000]["n_links"] >= 2 and not got[2000]["kept"] and got[0]["kept"]
    for k in range(3000, 3008):
        assert (got[k]["n_links"], got[k]["component_id"], got[k]["kept"]) == (0, k, True), k
    assert len(got) == len(rows) + len(odd)
    assert embedding_dedup.near_duplicates(d.limit(0)).count() == 0


def test_lists_follow_the_rows_at_any_size():
    """The levels of centroids multiply, their lists are found as by a full search, and their
    numbers give the centres back."""
    x = np.random.default_rng(3).normal(size=(600, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for lists, width, deep in ((20, 64, 1), (50, 16, 2), (300, 8, 3)):
        index = embedding_dedup.fit(x, lists, width=width)
        total = int(np.prod([len(level) for level in index.levels]))
        assert len(index.levels) == deep and lists <= total < 2 * lists + 1 and all(len(level) <= width for level in index.levels)
        centers = index.center(np.arange(total))
        far = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
        got = index.lists(x, 4)
        assert all(len(set(row)) == 4 for row in got.tolist())
        picked = np.take_along_axis(far, got, axis=1)
        assert (np.diff(picked, axis=1) >= -1e-9).all()
        assert (picked[:, 0] <= far.min(axis=1) + 1e-9).mean() > 0.97


def test_line_templates(spark):
    shared = "this passage stands in many documents and says the same each time"
    rows = [(i, f"own line {chr(97 + i)} of the text\n{shared}\nuser {i * 17} logged in from 10.0.0.{i} at noon today ok", "x") for i in range(6)]
    names = ["ann", "bob", "cy", "dee", "eve", "flo"]
    rows = [(i, t + f"\nthe quick order was sent to {names[i]} by the night mail", n) for i, t, n in rows]
    rows += [(None, None, "x"), (50, "", "x"), (51, "\n \n", "x"), (52, f"\n{shared}\n\nfresh words only here", "x"), (53, f"{shared}", "x"), (53, f"{shared}", "x"), (-1, "a line that nobody repeats at all, ever", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = {(r["doc_id"]): r for r in line_dedup.dedup(d).collect()}
    assert got[0]["text"] == rows[0][1] and (got[0]["n_lines"], got[0]["n_dropped"]) == (4, 0)
    for i in range(1, 6):
        assert got[i]["text"] == f"own line {chr(97 + i)} of the text" and got[i]["n_dropped"] == 3
    assert got[52]["text"] == "\n\nfresh words only here" and got[53]["text"] == ""
    assert got[None]["text"] is None and got[None]["n_lines"] == 0 and got[51]["text"] == "\n \n"
    assert got[-1]["n_dropped"] == 0
    assert line_dedup.dedup(d.limit(0)).count() == 0
    assert sum(r["doc_id"] == 53 for r in line_dedup.dedup(d).collect()) == 2


def test_line_variants_are_weighed_by_documents(spark):
    text = "the {} report of the {} office went out to every reader today"
    lines = [text.format("annual", "north")] * 4 + [text.format("annual", "south")]  # a verbatim line and one variant
    lines += ["our letter came on a cold night with news from {} at last".format(x) for x in ("ann", "ann", "bob", "bob")]  # two and two
    rows = [(i, f"{x}\nown") for i, x in enumerate(lines)]
    rows += [(20, "\n".join(f"we sold the old house by the {x} road for good money" for x in ("west", "east", "mill")))]  # three lines, one document
    rows += [(21 + i, f"he gave us the big map of the {x} river before he left") for i, x in enumerate(("dry", "wide"))]  # two documents
    rows += [(30, "the long road to town\n" + text.format("annual", "late"))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup(d).collect()}
    # own recurs verbatim in documents 0 to 8
    assert got == {0: 0, **{i: 2 for i in range(1, 5)}, 5: 1, 6: 2, 7: 2, 8: 2, 20: 0, 21: 0, 22: 0, 30: 1}
    assert line_dedup.dedup(d.limit(0)).count() == 0


def test_long_lines_recur_from_two_documents(spark):
    long, short = " ".join(["some", "word"] * 25 + ["more"]), " ".join(["some", "word"] * 25)
    rows = [(0, long), (1, f"{long}\nits own"), (2, short), (3, short), (5, f"{long} end\n{long} end")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup(d).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 5: 0}


def test_a_text_of_many_lines_is_cleared_in_time(spark):
    shared = [f"line of {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)} stock x" for i in range(100_000)]
    own = [f"own {x[3]}{x[8:12]} {x}" for x in shared]
    long = "\n".join(x for pair in zip(shared, own, strict=True) for x in pair)
    rows = [(1, "\n".join(shared)), (2, "\n".join(shared)), (3, shared[0]), (9, long)]
    got = {r["doc_id"]: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[9]["n_lines"], got[9]["n_dropped"], got[9]["text"]) == (200_000, 100_000, "\n".join(own))
    assert (got[1]["n_dropped"], got[2]["n_dropped"]) == (0, 100_000)


def test_lines_as_short_as_the_tree_is_deep_only_recur_verbatim(spark):
    rows = [(i, f"the end of {x}\nthe sad end of our {x}\nwith many thanks to our dear {x}") for i, x in enumerate(("ann", "bob", "cy"))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(d).collect()}
    assert got[0] == rows[0][1]
    assert all(got[i] == f"the end of {x}\nthe sad end of our {x}" for i, x in ((1, "bob"), (2, "cy")))
