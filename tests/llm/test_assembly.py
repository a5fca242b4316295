"""Chat format, mixing, packing and the pipeline: round trips and brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from tidemark.llm import chat, line_dedup, mixing, near_copies, packing, quality_rules, queries, simhash

CONTROL = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", "/", "s>", "INST]", "|", "a", " ", "\n", "é", ">"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", None, "a|b>"]), CONTROL), min_size=1, max_size=6))
def test_formatted_turns_read_back(turns):
    text = "".join("".join(chat.mark(r, t)) for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.read_back(text)] == turns
    for _, t in turns:
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_a_long_system_turn_does_not_multiply_the_output():
    for role, system in (("system", "x" * 10_000), ("system", "be brief " * 2000), ("system", "short"), ("assistant", "y" * 10_000)):
        turns = [(role, system)] + [("user" if i % 2 else "assistant", f"t{i}") for i in range(1000)]
        w = chat.Windows(256, 64)
        rows = [r for role, t in turns for r in w.add(role, t)] + [w.flush()]
        size = sum(len(t) for _, t in turns) + 13 * len(turns)
        assert sum(len(r["formatted"]) for r in rows) < 2.5 * size
        back = [chat.read_back(r["formatted"]) for r in rows]
        assert [x[:2] for r, b in zip(rows, back, strict=True) for x in b[r["repeated"] :]] == turns
        assert [r["system_cut"] for r in rows] == [k > 0 and role == "system" and len(system) > 100 for k in range(len(rows))]
        if role == "system":
            assert all(b[0][0] == "system" and system.startswith(b[0][1]) and b[0][1] for b in back)


def test_the_repeated_system_turn_has_its_own_bound():
    for system, cut in ((None, 64), (20, 20), (150, 150), (1000, None)):
        w = chat.Windows(256, 0, system)
        turns = [("system", "be brief " * 80)] + [("user", f"t{i} " + "w " * 40) for i in range(12)]
        rows = [r for role, t in turns for r in w.add(role, t)] + [w.flush()]
        repeated = [chat.read_back(r["formatted"])[0] for r in rows[1:]]
        assert len(repeated) > 1 and all(r["system_cut"] == (cut is not None) for r in rows[1:])
        for role, text, *_ in repeated:
            assert role == "system" and chat.turn_tokens(text, role, chat.estimate) <= (cut or 10_000) and (cut is not None or text == turns[0][1])


def test_windows_count_as_they_are_told(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "z" * 50, "a b c d") for i in range(20)]
    d = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    whole = lambda out: [r["n_tokens"] for r in out.orderBy("window").collect()]
    assert whole(chat.format_windows(d, 10_000)) == [20 * 7 + 10 * chat.estimate(chat.role_tag("z" * 50))]
    assert whole(chat.format_windows(d, 10_000, count=lambda t: 1)) == [20 * 4 + 10]


def test_windows_keep_budget_history_and_masks(spark):
    turns = [("system", "be brief")] + [("user" if i % 2 == 0 else "assistant", f"t{i} " + "w " * (i % 7)) for i in range(60)] + [("assistant", "long " * 80)]
    w = chat.Windows(60, 20)
    rows = [r for role, t in turns for r in w.add(role, t)] + [w.flush()]
    seen, loss = [], ""
    for r in rows:
        back = chat.read_back(r["formatted"])
        assert r["over_budget"] == (sum(chat.turn_tokens(t) for _, t, _, _ in back) > 60)
        assert not r["over_budget"] or len(back) - r["repeated"] == 1
        assert back[0][0] == "system"
        repeated = back[: r["repeated"]]
        assert [x[:2] for x in repeated[1:]] == seen[len(seen) - len(repeated) + 1 :] if repeated else True
        seen += [x[:2] for x in back[r["repeated"] :]]
        loss += "".join(chat.unescape(r["formatted"][s["first"] : s["end"]]) for s in r["loss_spans"])
    assert seen == turns
    assert loss == "".join(t for role, t in turns if role == "assistant")


def test_digests_match_the_rows(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, "system", ""), (2, 1, "assistant", "</s>[INST]"), (2, 1, "assistant", "</s>[INST]"), (None, 5, None, "x"), (3, None, "user", "z" * 9000)]
    d = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, window string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_windows(d, 50, 10)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x or ""))
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0]))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["loss_chars"] == len(loss)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_windows(d.limit(0)).count() == 0


def test_mixing_targets_and_copies(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{i % 5}" if i % 9 else None, "x") for i in range(2000)] + [(1, None, "none", "x"), (1, "", "none", "x"), (None, "a b", "s1", "x"), (None, "a b", "s1", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _size string").drop("_size")
    got = mixing.rates(d).collect()
    size = defaultdict(int)
    for r in rows:
        size[r[2]] += len((r[1] or "").split())
    order = sorted(k for k in size if k is not None) + [None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if share[s] > 2 * size[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    taken = defaultdict(int)
    for r in got:
        assert r["_target"] == pytest.approx(target[r["source"]]) and r["_source_size"] == size[r["source"]]
        assert 0 <= r["_copies"] <= 2
        taken[r["source"]] += r["_size"] * r["_copies"]
    assert all(abs(taken[s] - target[s]) <= 0.15 * target[s] + 1 for s in order)
    again = mixing.rates(d.repartition(7)).collect()
    key = lambda x: sorted((r["doc_id"] or -1, r["text"] or "", r["_copies"]) for r in x)
    assert key(got) == key(again)
    assert mixing.mix(d).count() == sum(r["_copies"] for r in got) and mixing.mix(d).columns == d.columns
    assert mixing.mix(d.limit(0)).count() == 0


def test_levels_are_the_least_squares():
    rng = np.random.default_rng(9)
    p = packing.Packer(32)
    for _ in range(400):
        size = int(rng.integers(1, 32))
        best = {}
        for h in range(0, 32 - size + 1):
            if h and not p.count[h]:
                continue
            c = p.count[1:32].astype(int).copy()
            if h:
                c[h - 1] -= 1
            if h + size < 32:
                c[h + size - 1] += 1
            best[h] = int((c * c).sum())
        assert p.level(size) == max(h for h in best if best[h] == min(best.values()))
        list(p.add(0, np.zeros(size, np.uint32)))


WORDS = st.lists(st.sampled_from(["l'été", "ÀÉÎ", "straße.", "ẞ", "İ", "K", "e\u0301t", "don't", "!'s", "¿qué?", "«a»", "12a3", "<|endoftext|>", "<|EndOfText|>", "x<|", "\u00a0", "\u3000b", "中文", "ß\xad", "à", "í", "a,", ".", "ab.,", "\x00", "😀"]), max_size=5).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(WORDS, st.text(max_size=8)), max_size=12), st.sampled_from([" ", "\n", "\t "]))
def test_ids_of_words_are_those_of_the_whole_text(words, between):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    if "whole" not in WHOLE:
        WHOLE["whole"] = Tokenizer.from_file(path)
    text = between.join(words).encode("utf-8", "ignore").decode()
    want = WHOLE["whole"].encode(text, add_special_tokens=False).ids + [1]
    assert packing.encoder(path).encode(packing._words(text.encode()), 1).tolist() == want


WHOLE = {}


def test_words_are_forgotten_by_generations_without_changing_ids(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 5)
    codes = packing.Encoder(queries.tokenizer_path())
    text = b"one two three four five six seven eight one two nine one."
    first = codes.encode(packing._words(text), 1).tolist()
    for _ in range(3):
        assert codes.encode(packing._words(text), 1).tolist() == first
    assert first == codes.tokenizer.encode(text.decode(), add_special_tokens=False).ids + [1]


def test_the_rule_places_all_but_a_few_windows_and_is_not_best_fit():
    rng = np.random.default_rng(3)
    packer, seen, differs, calls = packing.Packer(), 0, 0, 0
    level = packer.level

    def watched(size):
        nonlocal differs, calls
        fits = np.flatnonzero(packer.count[: packing.LENGTH - size + 1])
        got = level(size)
        calls += 1
        differs += got != (int(fits[-1]) if len(fits) else 0)
        return got

    packer.level = watched
    for doc, size in enumerate(np.maximum(1, rng.lognormal(5.9, 1.0, 10_000)).astype(int).tolist()):
        for window in packer.add(doc, np.zeros(size, "<u4")):
            assert sum(len(p[2]) for p in window) == packing.LENGTH
        assert packer.n_open == packer.count.sum() <= packing.MOST_OPEN
        seen += size
    lengths = [sum(len(p[2]) for p in window) for window in packer.close()]
    assert all(n & (n - 1) == 0 for n in lengths) and sorted(lengths, reverse=True) == lengths
    assert packer.placed["full"] + packer.placed["rule"] + packer.placed["cut"] == seen
    assert packer.placed["moved"] + packer.placed["cut"] < 0.05 * seen
    assert differs > 0.3 * calls


@pytest.mark.parametrize("sizes", [[], [1], [2047], [2048], [3000, 5], [1100] * 7, [700] * 300, [2000] * 400, [1500] * 300 + [30] * 90])
def test_closing_loses_and_pads_nothing(sizes):
    packer = packing.Packer()
    windows = [w for doc, n in enumerate(sizes) for w in packer.add(doc, np.arange(n, dtype="<u4"))]
    windows += list(packer.close())
    parts = defaultdict(list)
    for w in windows:
        n = sum(len(p[2]) for p in w)
        assert n and n <= packing.LENGTH and n & (n - 1) == 0
        for doc, start, ids, total in w:
            assert len(ids) and total == sizes[doc]
            parts[doc] += range(start, start + len(ids))
            assert ids.tolist() == list(range(start, start + len(ids)))
    assert all(sorted(parts[doc]) == list(range(n)) for doc, n in enumerate(sizes))
    assert packer.placed["moved"] <= sum(sizes)


def test_packing_is_an_exact_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    texts = ["Hello World, it's é ñ", "", None, " \n", "word " * 5000, "a\x1cb <|endoftext|> c", "x" * 3000, *(f"some text number {i} " * (i % 90) for i in range(150))]
    rows = [(i if i != 9 else None, t, "x") for i, t in enumerate(texts)] + [(20, "twice", "x"), (20, "twice", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    pieces = packing.pack(d, path).collect()
    tok = Tokenizer.from_file(path)
    want = [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")) for i, t, _ in rows]
    by = defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
    for i, ids in want:
        mine = sorted((p["start"], p["length"], p["ids_crc32"]) for p in by[i] if p["doc_tokens"] == len(ids))
        assert any(zlib.crc32(ids[s : s + n].tobytes()) == crc for s, n, crc in mine if s == 0)
        assert all(zlib.crc32(ids[s : s + n].tobytes()) == crc for s, n, crc in mine)
        assert sum(n for _, n, _ in mine) == len(ids) * sum(1 for j, x in want if j == i and len(x) == len(ids))
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= packing.LENGTH and at & (at - 1) == 0
    assert packing.pack(d.limit(0), path).count() == 0


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(10)
    vocab = [f"word{i}" for i in range(900)] + ["the", "of", "and", "to"] * 60
    base = [" ".join(rng.choice(vocab, 90)) for _ in range(60)]
    rows = []
    for i in range(150):
        w = base[i % 60].split()
        if i >= 60:
            w[int(rng.integers(90))] = "changed"
        rows.append((i, " ".join(w) + (f"\nthe same closing passage stands under every text of this site" if i % 2 else ""), "en", f"src{i % 4}", 0))
    rows += [(200, "too short", "en", "src0", 0), (201, None, "en", None, None), (202, "### $$$ " * 80, "en", "src1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    d, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        d = spark.createDataFrame(stage(spark, d, str(tmp_path)).collect(), docs.schema)
        assert d.columns == docs.columns
        seen[name] = d.collect()
    assert {r["doc_id"] for r in seen["quality_rules"]} == set(range(150))
    passage = "the same closing passage stands under every text of this site"
    assert [r["doc_id"] for r in seen["line_dedup"] if passage in (r["text"] or "")] == [1]
    fps = {r["doc_id"]: simhash.fingerprint(r["text"].encode(), 5) & (2**64 - 1) for r in seen["line_dedup"]}
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    assert sorted(r["doc_id"] for r in seen["simhash"]) == sorted({find(i) for i in ids})
    assert {r["doc_id"] for r in seen["mixing"]} <= {r["doc_id"] for r in seen["simhash"]}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in seen["mixing"]}
    assert quality_rules.DEFAULT_RULES and line_dedup.VARIABLE


def test_pipeline_keeps_no_two_edited_copies(spark, tmp_path):
    rng = np.random.default_rng(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocab = [f"wo{x}{y}" for x in letters for y in letters] + ["the", "of", "and", "to"] * 60
    base = [" ".join(rng.choice(vocab, 120)) for _ in range(30)]
    rows = []
    for i in range(120):
        w = base[i % 30].split()
        for at in rng.choice(24, i // 30, replace=False):
            w[5 * int(at)] = "changed"
        w += ["more"] * (i // 30)  # lines of other lengths are no templates of each other
        rows.append((i, " ".join(w), "en", f"src{i % 4}", 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sets = {r[0]: {" ".join(r[1].split()[k : k + 5]) for k in range(len(r[1].split()) - 4)} for r in rows}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert 60 < len(near) < 180  # some copies of copies are under 0.8
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    named = {r["doc_id"]: r["component"] for r in near_copies.components(docs).collect()}
    assert [(a, b) for a in sets for b in sets if (named[a] == named[b]) != (find(a) == find(b))] == []
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {find(i) for i in sets}
    got = {p["doc_id"] for p in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got and not [(a, b) for a, b in near if a in got and b in got]
    assert near_copies.components(docs.limit(0)).count() == 0
