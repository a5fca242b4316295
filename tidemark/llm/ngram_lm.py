"""N-gram scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark.

The model is a folder of sorted hash arrays, one file a range of hashes. Order 2 is what the
tables of a whole corpus leave room for: see the README for the figures of order 3.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import blobs
from tidemark.runtime import materialize, shared_path

CHUNK = 1_000_000  # tokens that are counted or scored at once
START, END = b"\n\n", b"\n"  # no word holds a line feed


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 0)


def _mix(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One well-mixed 64-bit key for a pair of word hashes."""
    with np.errstate(over="ignore"):
        x = v ^ (w * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15) + (v << np.uint64(6)) + (v >> np.uint64(2)))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    """Which of the ranges (a power of two) a hash is in, by its top bits."""
    return (h >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int64) if ranges > 1 else np.zeros(len(h), np.int64)


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1)) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


class _Words(dict):
    """Words to numbers, in the order first seen, with their hashes."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []
        for w in (START, END):
            self[w]

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.hashes)
        self.hashes.append(_hash(word))
        return n


Piece = tuple[int, bytes, bytes | None, bool]  # text's number, words, word before, text's last piece
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def _chunks(texts: list[bytes | None]) -> Iterator[list[Piece]]:
    """Texts in lists of about CHUNK tokens (six bytes to a token); a longer text comes in
    pieces, cut between words, each with the word before it."""
    most = 6 * CHUNK
    out: list[Piece] = []
    size = 0
    for k, text in enumerate(texts):
        text, at, before = text or b"", 0, None
        while True:
            found = _SPACE.search(text, at + most) if len(text) - at > most else None
            piece = (text[at : found.start()] if found else text[at:]).lower()
            out.append((k, piece, before, found is None))
            size += len(piece)
            if size >= most:
                yield out
                out, size = [], 0
            if found is None:
                break
            before = next(iter(piece.split()[-1:]), before)
            at = found.start()
    if out:
        yield out


def _tokens(pieces: list[Piece], words: _Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all tokens of pieces, each text with its end, those of the tokens before
    them, and tokens a piece."""
    ids: list[int] = []
    sizes, begin = [], []
    end, start = words[END], words[START]
    for _, text, before, last in pieces:
        got = text.split()
        begin.append(start if before is None else words[before])
        ids += map(words.__getitem__, got)
        if last:
            ids.append(end)
        sizes.append(len(got) + last)
    numbers, n = np.array(ids, np.int64), np.array(sizes, np.int64)
    context = np.empty_like(numbers)
    context[1:] = numbers[:-1]
    some = n > 0
    context[(np.cumsum(n) - n)[some]] = np.array(begin, np.int64)[some]
    return numbers, context, n


def _packed(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Counts as one byte each; those over 254 stand apart, whole."""
    big = np.nonzero(counts > 254)[0]
    small = np.minimum(counts, 255).astype(np.uint8)
    return {"count": small, "big_at": big.astype(np.int64), "big": counts[big].astype(np.int64)}


def _join(parts: list[np.ndarray]) -> bytes:
    return b"".join([np.array([len(p) for p in parts], "<i8").tobytes(), *[p.tobytes() for p in parts]])


def _split(raw: bytes, kinds: list[str]) -> list[np.ndarray]:
    sizes, at, out = np.frombuffer(raw, "<i8", len(kinds)), 8 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def _route(v: np.ndarray, w: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The hash by which a bigram goes to its range: that of its first word, or of the whole
    bigram if the first word is hot."""
    out = v.copy()
    there = _find(hot, v)[1]
    out[there] = _mix(v[there], w[there])
    return out


def _count(ranges: int, hot: np.ndarray):
    """Texts to one row a range: the distinct bigrams that are routed there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        keys, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        fold = lambda: _sum_by(np.concatenate([keys, *waiting]), np.concatenate([counts, np.ones(sum(map(len, waiting)), np.int64)]))
        for batch in batches:
            for pieces in _chunks(batch.column(0).to_pylist()):
                ids, before, _ = _tokens(pieces, words)
                waiting.append((before << 32) | ids)
                if sum(map(len, waiting)) > 2 * CHUNK:
                    keys, counts = fold()
                    waiting = []
        keys, counts = fold()
        if not len(keys):
            return
        hashes = np.array(words.hashes, np.uint64)
        first, second = hashes[keys >> 32], hashes[keys & 0xFFFFFFFF]
        where = _range(_route(first, second, hot), ranges)
        order = np.lexsort((first, where))
        first, second, counts = first[order], second[order], counts[order]
        cuts = np.searchsorted(where[order], np.arange(ranges + 1))
        for r in range(ranges):
            a, b = cuts[r], cuts[r + 1]
            if a == b:
                continue
            at = np.concatenate(([0], np.nonzero(first[a + 1 : b] != first[a : b - 1])[0] + 1, [b - a]))
            packed = _packed(counts[a:b])
            blob = _join([first[a:b][at[:-1]], np.diff(at).astype("<u4"), second[a:b], packed["count"], packed["big_at"], packed["big"]])
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([blob], pa.binary())], ["r", "blob"])

    return run


def _hot(rows: DataFrame, ranges: int, share: float = 0.01) -> np.ndarray:
    """Sorted hashes of the beginning of texts, which as many words follow as there are texts, and
    of the words that make up over a quarter of a range's part of the tokens of a sample: 4 *
    ranges at most. They only decide which task counts a bigram, never what
    is counted; missing one costs balance alone."""
    words = F.explode(F.split(F.lower(F.col("text").cast("string")), r"[\x20\x09-\x0D]+")).alias("w")
    by = rows.sample(share, 7).select(words).filter("w <> ''").groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n")).first()[0] or 0
    often = by.filter(F.col("n") * 4 * ranges > total).select("w").collect()
    return _hashes(r["w"].encode() for r in often)


def _hashes(words: Iterable[bytes]) -> np.ndarray:
    return np.sort(np.array([_hash(w) for w in {START, *words}], np.uint64))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of rows (r, blob) that are sorted by r."""
    now, blobs_ = None, []
    for batch in batches:
        for r, blob in zip(batch.column("r").to_pylist(), batch.column("blob").to_pylist(), strict=True):
            if r != now and blobs_:
                yield now, blobs_
                blobs_ = []
            now = r
            blobs_.append(blob)
    if blobs_:
        yield now, blobs_


_OUT = "kind string, r int, blob binary, n array<long>"


def _row(kind: str, r: int, blob: bytes | None, n: list[int] | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([r], pa.int32()), pa.array([blob], pa.binary()), pa.array([n], pa.list_(pa.int64()))], ["kind", "r", "blob", "n"])


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _bigrams(folder: str, ranges: int, hot: np.ndarray):
    """Merged ranges of bigrams to files, a row of sums each, continuation counts by range, and
    what a range adds to the sums of hot contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, got in _groups(batches):
            firsts, seconds, counts = [], [], []
            for blob in got:
                first, runs, second, small, big_at, big = _split(blob, ["<u8", "<u4", "<u8", "u1", "<i8", "<i8"])
                count = small.astype(np.int64)
                count[big_at] = big
                firsts.append(np.repeat(first, runs))
                seconds.append(second)
                counts.append(count)
            v, w, c = map(np.concatenate, (firsts, seconds, counts))
            order = np.lexsort((w, v))
            v, w, c = v[order], w[order], c[order]
            at = np.concatenate(([0], np.nonzero((v[1:] != v[:-1]) | (w[1:] != w[:-1]))[0] + 1))
            v, w, c = v[at], w[at], np.add.reduceat(c, at)
            at = np.concatenate(([0], np.nonzero(v[1:] != v[:-1])[0] + 1))
            by = {"context": v[at], "total": np.add.reduceat(c, at)}
            for k, here in (("n1", c == 1), ("n2", c == 2), ("n3", c >= 3)):
                by[k] = np.add.reduceat(here.astype(np.uint32), at)
            spread = _find(hot, by["context"])[1]
            for i in np.nonzero(spread)[0].tolist():
                yield _row("hot", int(np.searchsorted(hot, by["context"][i])), None, [int(by[k][i]) for k in ("total", "n1", "n2", "n3")])
            by = {k: x[~spread] for k, x in by.items()}
            keys = _mix(v, w)
            order = np.argsort(keys)
            blobs.put(f"{folder}/bigrams-{r}", by | {"key": keys[order]} | _packed(c[order]))
            yield _row("sums", r, None, [*_of_counts(c), len(c), int(c.sum())])
            tokens, types = _sum_by(w, np.ones(len(w), np.int64))
            cuts = np.searchsorted(_range(tokens, ranges), np.arange(ranges + 1))
            for q in range(ranges):
                a, b = cuts[q], cuts[q + 1]
                if a < b:
                    packed = _packed(types[a:b])
                    yield _row("types", q, _join([tokens[a:b], packed["count"], packed["big_at"], packed["big"]]), None)

    return run


def _unigrams(folder: str):
    """Merged ranges of continuation counts to files, and a row of sums each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, got in _groups(batches):
            keys, counts = [], []
            for blob in got:
                key, small, big_at, big = _split(blob, ["<u8", "u1", "<i8", "<i8"])
                count = small.astype(np.int64)
                count[big_at] = big
                keys.append(key)
                counts.append(count)
            key, count = _sum_by(np.concatenate(keys), np.concatenate(counts))
            blobs.put(f"{folder}/types-{r}", {"token": key} | _packed(count))
            yield _row("tokens", r, None, [*_of_counts(count), len(key), int((count >= 3).sum())])

    return run


def _discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts, each kept within 0 and its count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    each = [k - (k + 1) * y * (b / a) if a else float(k) / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(each, 1))


@dataclass(frozen=True)
class Model:
    """Where the files are, and the sums that belong to all of them."""

    folder: str
    ranges: int
    tokens: int
    vocabulary: int
    types: int
    d: tuple[float, float, float]
    d_low: tuple[float, float, float]
    n_low: tuple[int, int, int]


def train(texts: DataFrame, text_col: str = "text", folder: str | None = None, hot: Sequence[bytes] | None = None) -> Model:
    """Count the bigrams of all texts and write the model's files; returns where and what.

    A-Z are lower-cased; a text's tokens are its words and an end; null texts are empty. Each
    task counts its own texts first, then sends each range of hashes once, as sorted arrays: so
    a very frequent word costs one entry a task. Ranges are merged by one task each, which
    writes a file that nothing changes later. Bigrams that begin with a hot word are dealt over
    all ranges by both words, and the sums of these contexts added up (hot: such words, in lower
    case; None: found in a sample, see _hot). A text of any length is counted in chunks. Counts
    cover all rows, repeated ones too. An empty table gives a model without counts.
    """
    spark = texts.sparkSession
    folder = folder or shared_path(spark, "ngram-lm")
    rows = texts.select(F.col(f"`{text_col}`").cast("binary").alias("text"))
    ranges = 1 << (min(4096, max(16, rows.rdd.getNumPartitions())) - 1).bit_length()
    spread = _hot(rows, ranges) if hot is None else _hashes(hot)
    counted = rows.mapInArrow(_count(ranges, spread), "r int, blob binary")
    merged = materialize(counted.repartitionById(ranges, "r").sortWithinPartitions("r").mapInArrow(_bigrams(folder, ranges, spread), _OUT), "ngram-types")
    parts = merged.filter("kind = 'hot'").groupBy("r").agg(*[F.sum(F.get("n", F.lit(i))).alias(f"n{i}") for i in range(4)]).collect()
    parts = sorted(parts, key=lambda x: x["r"])
    blobs.put(f"{folder}/hot", {"context": spread[[x["r"] for x in parts]]} | {k: np.array([x[f"n{i}"] for x in parts], np.int64) for i, k in enumerate(("total", "n1", "n2", "n3"))})
    low = merged.filter("kind = 'types'").select("r", "blob").repartitionById(ranges, "r").sortWithinPartitions("r")
    low = low.mapInArrow(_unigrams(folder), _OUT)
    sums = lambda df, n: df.select(*[F.coalesce(F.sum(F.get("n", F.lit(i))), F.lit(0)) for i in range(n)]).first()
    a = sums(merged.filter("kind = 'sums'"), 6)
    b = sums(low, 6)
    return Model(folder, ranges, a[5], b[4], a[4], _discounts(*a[:4]), _discounts(*b[:4]), (b[0], b[1], b[5]))


@lru_cache(maxsize=8192)
def _file(uri: str) -> dict[str, np.ndarray] | None:
    try:
        return blobs.load(uri)
    except FileNotFoundError:
        return None


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys (sorted) in sorted_keys, and which are there."""
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)


def _counts_at(f: dict[str, np.ndarray], at: np.ndarray) -> np.ndarray:
    out = f["count"][at].astype(np.float64)
    over = np.nonzero(out == 255)[0]
    out[over] = f["big"][np.searchsorted(f["big_at"], at[over])]
    return out


class Scorer:
    """Probabilities from the mapped files. Word values are looked up once a task."""

    def __init__(self, model: Model) -> None:
        self.m = model
        self.words = _Words()
        self.known = 0
        self.hash = np.zeros(0, np.uint64)
        self.total, self.gamma, self.low = (np.zeros(0) for _ in range(3))
        self.ends = 0.0

    def _by_range(self, hashes: np.ndarray, ranges_of: np.ndarray, kind: str) -> Iterator[tuple[np.ndarray, dict]]:
        order = np.argsort(hashes)
        r = _range(ranges_of[order], self.m.ranges) if ranges_of is not hashes else _range(hashes[order], self.m.ranges)
        if ranges_of is not hashes:
            regroup = np.argsort(r, kind="stable")
            order, r = order[regroup], r[regroup]
        cuts = np.concatenate(([0], np.nonzero(r[1:] != r[:-1])[0] + 1, [len(r)]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            f = _file(f"{self.m.folder}/{kind}-{r[a]}") if b > a else None
            if f is not None:
                yield order[a:b], f

    def _learn(self) -> None:
        """Values of words that are new since the last time."""
        m, new = self.m, np.array(self.words.hashes[self.known :], np.uint64)
        if not len(new):
            return
        total, low = np.zeros(len(new)), np.zeros(len(new))
        n = np.zeros((3, len(new)))
        every = (np.arange(len(new)), _file(f"{m.folder}/hot"))
        for rows, f in [every, *self._by_range(new, new, "bigrams")]:
            at, there = _find(f["context"], new[rows])
            rows, at = rows[there], at[there]
            total[rows] = f["total"][at]
            for k in range(3):
                n[k, rows] = f[f"n{k + 1}"][at]
        types = np.zeros(len(new))
        for rows, f in self._by_range(new, new, "types"):
            at, there = _find(f["token"], new[rows])
            types[rows[there]] = _counts_at(f, at[there])
        uniform = 1.0 / (m.vocabulary + 1)
        if m.types:
            rest = sum(d * k for d, k in zip(m.d_low, m.n_low, strict=True)) / m.types
            low = np.maximum(types - self._discount(types, m.d_low), 0) / m.types + rest * uniform
        else:
            low[:] = uniform
        gamma = np.divide(sum(d * k for d, k in zip(m.d, n, strict=True)), total, out=np.ones(len(new)), where=total > 0)
        if not self.known:
            self.ends = float(total[0])  # every text begins once and ends once
        self.hash, self.total = np.concatenate([self.hash, new]), np.concatenate([self.total, total])
        self.gamma, self.low = np.concatenate([self.gamma, gamma]), np.concatenate([self.low, low])
        self.known = len(self.words.hashes)

    @staticmethod
    def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.array([0.0, *d])[np.minimum(c, 3).astype(np.int64)]

    def score(self, texts: list[bytes | None]) -> dict[str, np.ndarray]:
        """Per text: n_tokens, n_known, base_score and score."""
        out = {"n_tokens": np.zeros(len(texts), np.int64), "n_known": np.zeros(len(texts), np.int64), "base_score": np.zeros(len(texts)), "score": np.zeros(len(texts))}
        for pieces in _chunks(texts):
            ids, before, sizes = _tokens(pieces, self.words)
            self._learn()
            text = np.repeat([k for k, *_ in pieces], sizes)
            count, base, own = self._values(ids, before)
            for name, x in (("n_tokens", np.ones(len(ids))), ("n_known", count > 0), ("base_score", base), ("score", own)):
                out[name] += np.bincount(text, x, len(texts)).astype(out[name].dtype)
        return out

    def _values(self, ids: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: its count in training, its log10 base probability and the model's."""
        m = self.m
        pairs, back = np.unique((before << 32) | ids, return_inverse=True)
        v, w = self.hash[pairs >> 32], self.hash[pairs & 0xFFFFFFFF]
        keys, c = _mix(v, w), np.zeros(len(pairs))
        for rows, f in self._by_range(keys, _route(v, w, _file(f"{m.folder}/hot")["context"]), "bigrams"):
            at, there = _find(f["key"], keys[rows])
            c[rows[there]] = _counts_at(f, at[there])
        total = self.total[pairs >> 32]
        p = np.divide(np.maximum(c - self._discount(c, m.d), 0), total, out=np.zeros(len(pairs)), where=total > 0)
        p += self.gamma[pairs >> 32] * self.low[pairs & 0xFFFFFFFF]
        count = self.total.copy()
        count[1] = self.ends  # END is number 1 and never a context
        count = count[ids]
        return count, np.log10((count + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1))), np.log10(p)[back]


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' doc_id with n_tokens, n_known, train_tokens, base_score, score and perplexity.

    score: the text's log10 probability, its end included; base_score: that of an add-half
    unigram model on the same counts. An empty or null text is its end alone. A model of no
    texts spreads probability evenly. Rows that repeat score alike; a null doc_id stays null;
    other columns are not read. Empty table: no rows. Workers map the model's files, so memory
    beside the page cache is one chunk of tokens and the task's own words.
    """
    names = ("n_tokens", "n_known", "base_score", "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            got = scorer.score(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(got[n]) for n in names]], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long")).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def describe(model: Model) -> str:
    return json.dumps(asdict(model))
