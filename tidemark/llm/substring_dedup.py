"""Removal of word sequences that recur anywhere in a corpus, by suffix automata of reference shards.

A window is `least` words in a row. Its key is the smallest hash of the short shingles inside it, so
equal windows have equal keys wherever they stand. Windows in a row with one key form a piece; every
window lies in exactly one. Pieces whose key occurs only once hold nothing that recurs and go no
further. The others are the reference: equal ones are merged with their number, and all pieces of a
key meet in one shard of bounded size. A shard's suffix automaton counts each word sequence of its
pieces, which are then streamed through it: where the longest sequence that ends at a word and
occurs twice or more (the matching statistic) has `least` words, it is removed.

So a document meets only the shards that can hold its sequences, where a broadcast of every shard
to every document would grow with their product. Hashes only choose candidates; the automata
compare words.

Cases. Null or empty text: no words, nothing removed, empty output. Fewer words than a window:
all kept. Documents with the same words: all of them lose every window, as each occurs in the other.
A key of over `hot` pieces is replaced by one key for each of its windows, so that no key brings
many different pieces to one task. Ids are not used, so null or repeated ones do no harm. Very long
texts are cut whole; a task holds the Arrow batch that they are in. An empty table gives no rows.
Other columns stay; `text`, n_words and n_removed are replaced, leading underscores are reserved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import words
from tidemark.runtime import materialize

SHINGLE = 8  # words; a window's key is the least hash of its shingles
HOT = 1000  # pieces of a key, beyond which each window gets a key of its own
SHARD = 2000  # pieces in a reference shard, about
_MIX = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """All contiguous sequences of the added ones, with the number of places where each ends."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.count = [0]

    def add(self, symbols: list[int], weight: int = 1) -> None:
        """Add a sequence that occurs `weight` times. States of earlier ones are shared."""
        nexts, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for s in symbols:
            p, target = last, nexts[last].get(s)
            if target is None:
                last = len(nexts)
                nexts.append({})
                length.append(length[p] + 1)
                link.append(0)
                count.append(weight)
                while p >= 0 and s not in nexts[p]:
                    nexts[p][s] = last
                    p = link[p]
                if p < 0:
                    continue
                target = nexts[p][s]
                if length[target] == length[p] + 1:
                    link[last] = target
                else:
                    link[last] = self._split(p, s, target)
            else:
                last = target if length[target] == length[p] + 1 else self._split(p, s, target)
                count[last] += weight

    def _split(self, p: int, s: int, target: int) -> int:
        """A state for those of target's sequences that also end elsewhere."""
        nexts, link = self.next, self.link
        part = len(nexts)
        nexts.append(dict(nexts[target]))
        self.length.append(self.length[p] + 1)
        link.append(link[target])
        self.count.append(0)
        link[target] = part
        while p >= 0 and nexts[p].get(s) == target:
            nexts[p][s] = part
            p = link[p]
        return part

    def recurring(self, times: int = 2) -> list[int]:
        """For each state, its longest suffix state that occurs so often; call once all is added."""
        link, count = self.link, list(self.count)
        order = sorted(range(1, len(link)), key=self.length.__getitem__)
        for v in reversed(order):
            if link[v] > 0:
                count[link[v]] += count[v]
        best = [0] * len(link)
        for v in order:
            best[v] = v if count[v] >= times else best[link[v]]
        return best

    def spans(self, symbols: list[int], best: list[int], least: int) -> list[tuple[int, int]]:
        """Maximal stretches of a sequence covered by matches of at least `least` symbols."""
        nexts, link, length = self.next, self.link, self.length
        out: list[tuple[int, int]] = []
        v = at = 0
        for i, s in enumerate(symbols, 1):
            while v and s not in nexts[v]:
                v = link[v]
                at = length[v]
            v = nexts[v].get(s, 0)
            at = at + 1 if v else 0
            found = best[v]
            n = at if found == v else length[found]
            if n >= least:
                if out and i - n <= out[-1][1]:
                    out[-1] = (out[-1][0], i)
                else:
                    out.append((i - n, i))
        return out


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """Of each `width` neighbours the least (or most), by doubling."""
    size = 1
    while 2 * size <= width:
        x = least(x[:-size], x[size:])
        size *= 2
    return least(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def outline(hashes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the pieces of a text of word hashes, the window each begins with, and whether the
    text has the key's shingle twice."""
    q = min(SHINGLE, least)
    grams = np.zeros(len(hashes) - q + 1, np.uint64)
    for i in range(q):
        grams = grams * _MIX + hashes[i : i + len(grams)]
    grams = (grams ^ (grams >> np.uint64(29))) * _MIX
    width = least - q + 1
    smallest = _sliding(grams, width, np.minimum)
    starts = np.flatnonzero(np.r_[True, smallest[1:] != smallest[:-1]])
    keys = smallest[starts]
    lowest = np.r_[np.zeros(width - 1, np.uint64), smallest, np.zeros(width - 1, np.uint64)]
    value, n = np.unique(grams[_sliding(lowest, width, np.maximum) == grams], return_counts=True)
    return keys, starts, n[np.searchsorted(value, keys)] > 1


_OUTLINE = "_k string, keys array<bigint>, starts array<int>, stops array<int>, twice array<boolean>"


def _outlines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h")
            flat, ends = h.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.asarray(h.offsets)
            ends = ends - ends[0]
            keys, starts, stops, twice = [], [], [], []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                k, s, t = outline(flat[a:b], least)
                keys.append(k.view(np.int64))
                starts.append(s.astype(np.int32))
                stops.append(np.r_[s[1:], b - a - least + 1].astype(np.int32))
                twice.append(t)
            at = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, np.concatenate(x)) if x else pa.array([], pa.list_(kind)) for x, kind in ((keys, pa.int64()), (starts, pa.int32()), (stops, pa.int32()), (twice, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("_k"), *lists], ["_k", "keys", "starts", "stops", "twice"])

    return run


def _id(text: bytes, seed: int) -> int:
    return int.from_bytes(xxhash.xxh64_digest(text, seed), "big", signed=True)


_PIECE = "_k string, start int, key bigint, id bigint, piece string, weight bigint"


def _pieces(least: int, text: str):
    """Texts with the pieces to look at, to those pieces. Of texts with equal words, one is cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            columns = (batch.column("_k").to_pylist(), batch.column(text).cast(pa.binary()).to_pylist(), batch.column("_todo").to_pylist(), batch.column("_copies").to_pylist())
            for k, value, todo, copies in zip(*columns, strict=True):
                if copies > 1:
                    if k in seen:
                        continue
                    seen.add(k)
                w = value.split()
                for p in todo:
                    if p["hot"]:
                        cuts = [(i, i + least) for i in range(p["start"], p["stop"])]
                    else:
                        cuts = [(p["start"], p["stop"] + least - 1)]
                    for a, b in cuts:
                        piece = b" ".join(w[a:b])
                        for column, x in zip(out, (k, a, _id(piece, 3) if p["hot"] else p["key"], _id(piece, 7), piece, copies), strict=True):
                            column.append(x)
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            arrays = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
            arrays[4] = arrays[4].cast(pa.string())
            yield pa.RecordBatch.from_arrays(arrays, ["_k", "start", "key", "id", "piece", "weight"])

    return run


def _matches(least: int):
    """Pieces of a shard to the stretches of each that recur."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        number: dict[str, int] = {}
        pieces = [[number.setdefault(w, len(number)) for w in p.split(" ")] for p in pdf["piece"]]
        automaton = SuffixAutomaton()
        for symbols, weight in zip(pieces, pdf["weight"].tolist(), strict=True):
            automaton.add(symbols, weight)
        best = automaton.recurring()
        found = [automaton.spans(symbols, best, least) for symbols in pieces]
        rows = [(k, _id(p.encode(), 7), [a for a, _ in f], [b for _, b in f]) for k, p, f in zip(pdf["key"], pdf["piece"], found, strict=True) if f]
        return pd.DataFrame(rows, columns=["key", "id", "starts", "stops"])

    return run


def _cut(text: Column, spans: Column) -> Column:
    """Struct of n_words, n_removed and the words outside all spans, joined by one space."""

    @F.pandas_udf("n_words bigint, n_removed bigint, text string")
    def run(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for value, gone in zip(texts, spans, strict=True):
            w = (value or "").encode().split()
            kept, at = w, 0
            if gone is not None and len(gone):
                kept = []
                for s in sorted((g["start"], g["stop"]) for g in gone):
                    kept += w[at : max(at, s[0])]
                    at = max(at, s[1])
                kept += w[at:]
            rows.append((len(w), len(w) - len(kept), b" ".join(kept).decode()))
        return pd.DataFrame(rows, columns=["n_words", "n_removed", "text"])

    return run(text, spans)


def dedup(docs: DataFrame, least: int = 35, text: str = "text", hot: int = HOT) -> DataFrame:
    """docs with n_words, n_removed and their text less every word of a window that occurs twice.

    Windows are judged on the texts as they come; all their occurrences go.
    """
    own = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    keyed = docs.select(*own).withColumn("_k", F.md5(F.concat_ws(" ", words(F.col(text))).cast("binary")))
    hashed = keyed.select("_k", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)).alias("h")).filter(F.size("h") >= least)
    each = hashed.mapInArrow(_outlines(least), _OUTLINE)
    same = each.groupBy("_k").agg(F.count(F.lit(1)).alias("copies"), F.first(F.struct("keys", "starts", "stops", "twice")).alias("o"))
    outlines = materialize(same.select("_k", "copies", "o.*"), "outlines")

    keys = outlines.select(F.explode(F.arrays_zip("keys", "twice")).alias("p")).select("p.keys", F.col("p.twice").cast("long").alias("more"))
    many = materialize(keys.groupBy(F.col("keys").alias("key")).agg((F.count(F.lit(1)) + F.sum("more")).alias("n")).filter("n > 1"), "keys")
    size = many.agg(F.sum(F.when(F.col("n") > hot, F.col("n") * least).otherwise(F.col("n")))).first()[0] or 0
    shards = int(size // SHARD) + 1

    spots = outlines.select("_k", "copies", F.explode(F.arrays_zip("keys", "starts", "stops")).alias("p")).select("_k", "copies", F.col("p.keys").alias("key"), F.col("p.starts").alias("start"), F.col("p.stops").alias("stop"))
    todo = spots.join(many, "key").groupBy("_k").agg(F.max("copies").alias("_copies"), F.collect_list(F.struct("start", "stop", "key", (F.col("n") > hot).alias("hot"))).alias("_todo"))
    pieces = keyed.join(todo, "_k").mapInArrow(_pieces(least, text), _PIECE)
    merged = pieces.groupBy("key", "piece").agg(F.sum("weight").alias("weight"))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards))
    matched = merged.groupBy(shard.alias("shard")).applyInPandas(_matches(least), "key bigint, id bigint, starts array<int>, stops array<int>")
    found = pieces.select("_k", "start", "key", "id").join(matched, ["key", "id"]).select("_k", "start", F.explode(F.arrays_zip("starts", "stops")).alias("s"))
    spans = found.select("_k", F.struct((F.col("start") + F.col("s.starts")).alias("start"), (F.col("start") + F.col("s.stops")).alias("stop")).alias("s"))
    whole = outlines.filter("copies > 1").select("_k", F.struct(F.lit(0).alias("start"), F.lit(2**31 - 1).alias("stop")).alias("s"))
    gone = spans.unionByName(whole).groupBy("_k").agg(F.collect_list("s").alias("_gone"))

    cut = keyed.join(gone, "_k", "left").withColumn("_cut", _cut(F.col(text), F.col("_gone")))
    return cut.select(*(F.col("_cut.text").alias(c) if c == text else F.col(f"`{c}`") for c in own), "_cut.n_words", "_cut.n_removed")
