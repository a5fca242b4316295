"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

All terms and stems of the examples count, those of both labels, by TF-IDF alone: (1 + log
occurrences) times log((1 + documents) / (1 + documents with it)) + 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.runtime import materialize

BLOCK = 32  # examples
STEMS = (3, 5, 7)  # characters
SHORT = 8  # postings; shorter lists are read whole, as their bounds would cost as much
PROBES = 4
TOGETHER = 64  # texts whose frequent features are multiplied at once

# Bytes between terms, beside white space.
PUNCTUATION = b"\"'()*,-./:;<>?![]_`{|}~#$%&+=@^\\"
_TO_TERMS = bytes.maketrans(PUNCTUATION, b" " * len(PUNCTUATION))


def terms(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs without white space and punctuation of a whole text."""
    return text.lower().translate(_TO_TERMS).split() if text else []


def features(term: bytes) -> list[bytes]:
    """A term, and those of its beginnings of STEMS characters that are shorter, marked with a
    star: stems, in languages that build their words from them."""
    if term.isascii():
        return [term, *[term[:n] + b"*" for n in STEMS if n < len(term)]]
    word = term.decode("utf-8", "replace")
    return [term, *[word[:n].encode() + b"*" for n in STEMS if n < len(word)]]


Vector = tuple[np.ndarray, np.ndarray]  # numbers of features, ascending, and their occurrences


class Lookup(dict):
    """Term to a row of `numbers`, which has the numbers of its features in the vocabulary, -1 for
    none; row 0 has none. Terms are remembered up to a bound, looked at before each text.

    A vocabulary holds the shorter stems of all its features, so a term whose stem is missing has
    no longer one in it.
    """

    def __init__(self, vocab: list[bytes], bound: int = 300_000) -> None:
        super().__init__()
        self.wanted, self.bound = {t: k for k, t in enumerate(vocab)}, bound
        self.rows: dict[tuple[int, ...], int] = {(): 0}
        self.numbers = np.full((1024, 1 + len(STEMS)), -1, np.int32)

    def __missing__(self, term: bytes) -> int:
        get, got = self.wanted.get, []
        word = term if term.isascii() else term.decode("utf-8", "replace")
        for n in STEMS:
            if n >= len(word):
                break
            stem = word[:n] if word is term else word[:n].encode()
            k = get(stem + b"*")
            if k is None:
                break
            got.append(k)
        else:
            n = 0
        if n == 0 or n >= len(word):
            k = get(term)
            if k is not None:
                got.append(k)
        key = tuple(got)
        at = self.rows.get(key)
        if at is None:
            at = self.rows[key] = len(self.rows)
            if at == len(self.numbers):
                self.numbers = np.concatenate([self.numbers, np.full_like(self.numbers, -1)])
            self.numbers[at, : len(got)] = got
        self[term] = at
        return at

    def vector(self, text: bytes | None) -> Vector:
        """The vocabulary features of a whole text and how often each occurs in it."""
        if len(self) > self.bound:
            self.clear()
        words = terms(text)
        at = np.fromiter(map(self.__getitem__, words), np.int32, len(words))
        all_of = self.numbers[at].ravel()
        return np.unique(all_of[all_of >= 0], return_counts=True)


def _binary(docs: DataFrame, text_col: str, *more: str) -> DataFrame:
    return docs.select(*more, F.col(f"`{text_col}`").cast("binary").alias("text"))


def sample(docs: DataFrame, labels: DataFrame, text_col: str, max_per_class: int) -> tuple[DataFrame, tuple[int, int]]:
    """(doc_id, label, features, times) of labelled documents, at most max_per_class for each
    label, and the number of labelled documents by label. The documents taken are the first by
    hash of doc_id; of several rows of one doc_id the smallest text is taken, of near-copies
    under one label, which would fill each other's votes, the smallest doc_id. Labels
    that contradict each other count as 1."""
    labels = labels.filter("label in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("label").cast("int").alias("label"))
    totals = labels.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    parts = [labels.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).withColumnRenamed("doc_id", "_id")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    rows = rows.filter("text is not null").groupBy("doc_id", "label").agg(F.min("text").cast("binary").alias("text")).mapInArrow(_examples, EXAMPLE)
    first = rows.groupBy("label", "sketch").agg(F.min(F.struct("doc_id", "features", "times")).alias("x"))
    return materialize(first.select("x.doc_id", "label", "x.features", "x.times"), "toxicity-sample"), (totals[0], totals[1])


EXAMPLE = "doc_id long, label int, sketch long, features array<binary>, times array<int>"


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with all their features and the least hash of their 5-word windows, which near-copies
    mostly share."""
    import xxhash

    def least(words: list[bytes]) -> int:
        windows = [words[i : i + 5] for i in range(max(1, len(words) - 4))]
        return min(xxhash.xxh64_intdigest(b" ".join(w)) for w in windows) >> 1

    kinds = {"features": pa.list_(pa.binary()), "times": pa.list_(pa.int32())}
    for batch in batches:
        rows: dict[str, list] = {"sketch": [], "features": [], "times": []}
        for text in batch.column(2).to_pylist():
            words = terms(text)
            found: Counter = Counter()
            for t, n in Counter(words).items():
                for f in features(t):
                    found[f] += n
            rows["sketch"].append(least(words))
            rows["features"].append(list(found))
            rows["times"].append(list(found.values()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(v, kinds.get(k, pa.int64())) for k, v in rows.items()]], ["doc_id", "label", *rows])


def document_frequencies(docs: DataFrame, text_col: str, vocab: list[bytes]) -> tuple[np.ndarray, int]:
    """Documents a vocabulary feature, and documents, over all of docs: a task sends one row for
    each feature that it saw."""

    shared = docs.sparkSession.sparkContext.broadcast(Lookup(vocab))  # lives as long as a worker

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, wanted = np.zeros(len(vocab), np.int64), 0, shared.value
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                df[wanted.vector(text)[0]] += 1
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*df[at].tolist(), n], pa.int64())], ["k", "n"])

    sums = _binary(docs, text_col).mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = sums["k"].to_numpy(), sums["n"].to_numpy()
    df = np.zeros(len(vocab))
    df[k[k >= 0]] = n[k >= 0]
    return df, int(n[k < 0].sum())


@dataclass
class Index:
    """The examples' vectors by feature, in blocks of examples that are alike.

    Features that an eighth of the examples have are rows of a matrix (row[f], else -1): their part
    of all cosines is one product for many texts. Lists of up to SHORT postings are read whole.
    The others (mid[f], else -1) have the largest weight in each block, block_max; postings
    slices[m, b] to slices[m, b + 1] are those of block b.
    """

    weight: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    row: np.ndarray
    dense: np.ndarray
    start: np.ndarray
    example: np.ndarray
    value: np.ndarray
    mid: np.ndarray
    slices: np.ndarray
    block_max: np.ndarray
    k: int
    prior: float
    weights: tuple[float, float]
    line: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def build(cls, weight: np.ndarray, rows: list[tuple[int, int, Vector]], k: int, prior: float, weights: tuple[float, float]) -> Index:
        """rows: (doc_id, label, vector); weight: what a feature's (1 + log occurrences) is
        multiplied by. Votes are calibrated on the examples, each judged by the others."""
        rows = sorted((r for r in rows if len(r[2][0])), key=lambda r: r[:2])
        index = cls._of(weight, rows, k, prior, weights)
        if not rows:
            return index
        cosine, shares = np.zeros((len(rows), len(rows)), np.float32), []
        for i, (_, _, v) in enumerate(rows):
            row = index.cosines(v)
            cosine[i] = row
            row[i] = -1.0
            near = np.flatnonzero((row >= _kth(row, k) - 1e-12) & (row > 0))
            shares.append(index._share(near, row[near]))
        out = cls._of(weight, [rows[i] for i in _arranged(cosine).tolist()], k, prior, weights)
        out.line = calibrated(np.array(shares), index.labels, np.array(weights)[index.labels], prior)
        return out

    @classmethod
    def _of(cls, weight: np.ndarray, rows: list, k: int, prior: float, weights: tuple[float, float]) -> Index:
        units = [cls._unit(v, weight) for _, _, v in rows]
        feature = np.concatenate([u[0] for u in units]) if units else np.zeros(0, np.int64)
        value = np.concatenate([u[1] for u in units]) if units else np.zeros(0)
        example = np.repeat(np.arange(len(units), dtype=np.int32), [len(u[0]) for u in units])
        order = np.lexsort((example, feature))
        feature, example, value = feature[order], example[order], value[order]
        count = np.bincount(feature, minlength=len(weight))
        often = count * 8 >= max(16, len(units))
        row = np.where(often, np.cumsum(often) - 1, -1)
        dense = np.zeros((int(often.sum()), len(units)))
        there = often[feature]
        dense[row[feature[there]], example[there]] = value[there]
        feature, example, value = feature[~there], example[~there], value[~there]
        start = np.searchsorted(feature, np.arange(len(weight) + 1))
        longer = ~often & (count > SHORT)
        mid = np.where(longer, np.cumsum(longer) - 1, -1)
        blocks = -(-len(units) // BLOCK)
        edges = np.nonzero(longer)[0][:, None] * blocks + np.arange(blocks + 1)[None, :]
        at = feature * blocks + example // BLOCK
        block_max = np.zeros((int(longer.sum()), blocks))
        of_mid = mid[feature] >= 0
        np.maximum.at(block_max, (mid[feature[of_mid]], example[of_mid] // BLOCK), value[of_mid])
        return cls(weight, np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), row.astype(np.int32), dense, start.astype(np.int32), example, value, mid.astype(np.int32), np.searchsorted(at, edges).astype(np.int32), block_max.astype(np.float32) * np.float32(1.000001), k, prior, weights)

    @staticmethod
    def _unit(v: Vector, weight: np.ndarray) -> Vector:
        """A vector's features with their weights, at length 1."""
        w = (1.0 + np.log(v[1])) * weight[v[0]]
        return v[0], w / np.sqrt((w * w).sum())

    def _listed(self, low: np.ndarray, high: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the postings low to high, weighed by w, add to every cosine."""
        n = high - low
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - n), n)
        return np.bincount(self.example[at], np.repeat(w, n) * self.value[at], len(self.ids))

    def _begun(self, vectors: list[Vector]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each vector, the part of the cosines that frequent features make, and the other
        features with their weights."""
        units = [self._unit(v, self.weight) for v in vectors]
        w, rest = np.zeros((len(units), len(self.dense))), []
        for i, (found, of) in enumerate(units):
            row = self.row[found]
            often = row >= 0
            w[i, row[often]] = of[often]
            rest.append((found[~often], of[~often]))
        for part, (found, of) in zip(w @ self.dense, rest, strict=True):
            yield part, found, of

    def _whole(self, found: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What whole lists add to all cosines."""
        return self._listed(self.start[found], self.start[found + 1], w)

    def _read(self, found: np.ndarray, w: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """What longer lists add to the cosines with the examples of those blocks."""
        slices = self.slices[self.mid[found]]
        low, high = slices[:, blocks].ravel(), slices[:, blocks + 1].ravel()
        some = high > low
        return self._listed(low[some], high[some], np.repeat(w, len(blocks))[some])

    def cosines(self, v: Vector) -> np.ndarray:
        """With all examples, from whole lists."""
        ((part, found, w),) = self._begun([v])
        return np.minimum(part + self._whole(found, w), 1.0)

    def nearest(self, vectors: list[Vector]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector the examples and cosines of the k nearest with a cosine over 0, and of
        all that tie with the last.

        What is known of the cosines bounds the k-th from below. The longer lists are read in the
        blocks with the highest upper bounds first, which raises it, then in those blocks alone
        whose upper bounds still reach it. Where that leaves over a fifth of the blocks to read for the
        first PROBES vectors, as among long texts, the others read whole lists, which is faster.
        """
        first = -(-self.k // BLOCK) + 1
        many, reached = self.block_max.shape[1], 0
        for at, (part, found, w) in enumerate(self._begun(vectors) if len(self.ids) else ()):
            if at >= PROBES and 5 * reached > many * PROBES:
                s = part + self._whole(found, w)
            else:
                longer = self.mid[found] >= 0
                part = part + self._whole(found[~longer], w[~longer])
                found, w = found[longer], w[longer]
                bound = np.maximum.reduceat(part, np.arange(0, len(part), BLOCK)) + w @ self.block_max[self.mid[found]]
                best = np.argpartition(-bound, first)[:first] if many > first else np.arange(many)
                s = part + self._read(found, w, best)
                bound[best] = -1.0
                rest = np.flatnonzero(bound >= _kth(s, self.k) - 1e-6)
                s = s + self._read(found, w, rest)
                if at < PROBES:
                    reached += len(best) + len(rest)
            s = np.minimum(s, 1.0)
            n = np.flatnonzero((s >= _kth(s, self.k) - 1e-12) & (s > 0))
            n = n[np.lexsort((self.ids[n], -np.round(s[n], 12)))]
            yield n, s[n]

    def _share(self, n: np.ndarray, s: np.ndarray) -> float:
        """Label 1's share of the votes: a vote weighs its cosine over the largest, times what its
        label is under-represented by in the sample; the prior has one vote."""
        if not len(n):
            return self.prior
        votes = s / s.max() * np.array(self.weights)[self.labels[n]]
        return float((votes[self.labels[n] == 1].sum() + self.prior) / (votes.sum() + 1.0))

    def votes(self, vectors: list[Vector]) -> list[tuple[float, list[int]]]:
        """The calibrated score of each vector, to 12 digits, and the first examples behind it."""
        out: list[tuple[float, list[int]]] = [(self.prior, [])] * len(vectors)
        some = [i for i, v in enumerate(vectors) if len(v[0])]
        slope, shift = self.line
        for i, (n, s) in zip(some, self.nearest([vectors[i] for i in some]), strict=False):
            if len(n):
                out[i] = round(float(1.0 / (1.0 + np.exp(-(slope * _logit(self._share(n, s)) + shift)))), 12), self.ids[n[:5]].tolist()
        return out


def _arranged(cosine: np.ndarray) -> np.ndarray:
    """Rows in an order that puts like ones into one block: halves of whole blocks, by which half's
    members a row is nearer to on average, a few times over, and again within each half."""
    order, parts = [], [np.arange(len(cosine))]
    while parts:
        part = parts.pop()
        if len(part) <= BLOCK:
            order.append(part)
            continue
        half = BLOCK * (-(-len(part) // BLOCK) // 2)
        one = int(cosine[np.ix_(part, part)].sum(axis=1).argmin())
        lean = cosine[part[one], part]
        for _ in range(6):
            by = np.argsort(-lean, kind="stable")
            lean = cosine[np.ix_(part, part[by[:half]])].mean(axis=1) - cosine[np.ix_(part, part[by[half:]])].mean(axis=1)
        by = np.argsort(-lean, kind="stable")
        parts += [part[by[half:]], part[by[:half]]]
    return np.concatenate(order)


def _kth(s: np.ndarray, k: int) -> float:
    """The k-th largest; 0 if there are no more than k."""
    return float(np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else 0.0


def _logit(share):
    inside = np.clip(share, 0.001, 0.999)
    return np.log(inside / (1.0 - inside))


def calibrated(shares: np.ndarray, labels: np.ndarray, weights: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and shift of the logistic line from vote shares to probabilities (Platt scaling),
    by Newton steps over weighted examples. One label only: the shares as they are."""
    if len(set(labels.tolist())) < 2:
        return 1.0, 0.0
    x = np.stack([_logit(shares), np.ones(len(shares))], axis=1)
    n1 = weights[labels == 1].sum()
    n0 = weights[labels == 0].sum()
    y = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    line = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-(x @ line)))
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weights * (y - p)))
        line = line + np.clip(step, -2.0, 2.0)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(line[0]), 0.0), float(line[1])


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", max_per_class: int = 1024, k: int = 30) -> tuple[list[bytes], Index]:
    """Vocabulary and index. labels: (doc_id, label), label 1 for toxic.

    The bound is max_per_class examples a label: their features are the vocabulary, which the
    driver and each worker hold. Document frequencies are over all of docs, null texts being
    documents without a term. Null doc_ids and labels, and examples without a text, are left
    out. Without examples of both labels every score is the share of label 1 (one half without
    labels). Empty tables are such a case.
    """
    rows, totals = sample(docs, labels, text_col, max_per_class)
    got = rows.toArrow().sort_by("doc_id").combine_chunks()
    prior = (totals[1] + 0.5) / (sum(totals) + 1.0)
    kinds = got["label"].to_pylist()
    if len(set(kinds)) < 2:
        return [], Index.build(np.zeros(0), [], k, prior, (1.0, 1.0))
    features_of = got["features"].combine_chunks()
    coded = features_of.flatten().dictionary_encode()
    ends, times = np.asarray(features_of.offsets), got["times"].combine_chunks().flatten().to_numpy().astype(float)
    vocab = coded.dictionary.to_pylist()
    at = coded.indices.to_numpy()
    order = [a + np.argsort(at[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    examples = [(doc_id, label, (at[o], times[o])) for doc_id, label, o in zip(got["doc_id"].to_pylist(), kinds, order, strict=True)]
    df, n = document_frequencies(docs, text_col, vocab)
    weight = np.log((1 + n) / (1 + df)) + 1
    taken = Counter(kinds)
    sizes = [totals[j] / taken[j] for j in (0, 1)]
    mean = (sizes[0] * taken[0] + sizes[1] * taken[1]) / len(kinds)
    return vocab, Index.build(weight, examples, k, prior, (sizes[0] / mean, sizes[1] / mean))


def score(docs: DataFrame, fitted: tuple[list[bytes], Index], text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold) and evidence (doc_ids of the
    nearest examples) of every row of docs.

    Whole texts are read; the cosine is over all features of the examples. Null, empty and other
    texts without such a feature score the share of label 1. Ties at the k-th neighbour all
    vote, so the order of examples never matters. Rows that repeat score alike, a null doc_id
    stays null, other columns are not read. Empty table: no rows. A task holds an Arrow batch, the
    index and the terms it remembers.
    """
    shared = docs.sparkSession.sparkContext.broadcast((Lookup(fitted[0]), fitted[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, index = shared.value
        for batch in batches:
            texts, found = batch.column(1), []
            for at in range(0, len(texts), TOGETHER):
                found += index.votes([wanted.vector(t) for t in texts.slice(at, TOGETHER).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    out = _binary(docs, text_col, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, score double, evidence array<long>")
    return out.select("doc_id", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")
