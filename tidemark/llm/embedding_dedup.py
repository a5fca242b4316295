"""Embedding near-duplicates by product quantisation, with exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.simhash import _forest
from tidemark.operators.graph import connected_components
from tidemark.runtime import broadcast_if_small, materialize

BLOCK = 4096  # stored vectors that one group holds at most, on average
STEP = 512  # queries compared at once
SLICE = 64  # rows whose lists are sought at once


def usable(embedding: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, finite) & F.exists(embedding, lambda x: x != 0), F.lit(False))


@dataclass
class Index:
    """Coarse centroids by level, and codewords of residuals for each subspace (m x words x width).

    A list is one centroid of each level, and its centre their sum: the second level divides what
    the first leaves over, and so on. So the lists multiply while the centroids add up, and the
    index stays small at any number of lists.
    """

    levels: list[np.ndarray]
    words: np.ndarray

    def __post_init__(self) -> None:
        self.between = {(a, b): self.levels[a] @ self.levels[b].T for b in range(len(self.levels)) for a in range(b)}

    def center(self, lists: np.ndarray) -> np.ndarray:
        """The centres of lists; a list's number has its centroids as digits, first level first."""
        rest, out = np.asarray(lists, np.int64), 0
        for level in reversed(self.levels):
            rest, digit = np.divmod(rest, len(level))
            out = out + level[digit]
        return out

    def padded(self, x: np.ndarray) -> np.ndarray:
        width = self.words.shape[0] * self.words.shape[2]
        return np.pad(x, ((0, 0), (0, width - x.shape[1])))

    def lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The nearest lists of each row, nearest first; the first owns it.

        With several levels, each keeps four times as many candidates as are wanted in the end.
        """
        parts = [self._lists(part, probes) for part in np.array_split(x, max(1, -(-len(x) // SLICE)))]
        return np.concatenate(parts)

    def _lists(self, x: np.ndarray, probes: int) -> np.ndarray:
        n, last = len(x), len(self.levels) - 1
        row = np.arange(n)[:, None]
        number, digits, d = np.zeros((n, 1), np.int64), [], np.zeros((n, 1))
        for k, level in enumerate(self.levels):
            # |x - c1 - .. - ck|^2, less |x|^2, grows by |ck|^2 - 2 x.ck + 2 (c1 + .. ).ck
            step = ((level**2).sum(axis=1) - 2 * x @ level.T)[:, None, :]
            step = step + 2 * sum(self.between[j, k][digit] for j, digit in enumerate(digits)) if digits else step
            d = (d[:, :, None] + step).reshape(n, -1)
            keep = min(probes if k == last else 4 * probes, d.shape[1])
            near = np.argpartition(d, keep - 1, axis=1)[:, :keep]
            near = near[row, np.argsort(d[row, near], axis=1, kind="stable")]
            before, digit = np.divmod(near, len(level))
            number, d = number[row, before] * len(level) + digit, d[row, near]
            digits = [*(held[row, before] for held in digits), digit]
        return number

    def encode(self, residual: np.ndarray) -> np.ndarray:
        m, _, width = self.words.shape
        parts = self.padded(residual).reshape(len(residual), m, width)
        return np.stack([((self.words[k] ** 2).sum(axis=1) - 2 * parts[:, k] @ self.words[k].T).argmin(axis=1) for k in range(m)], axis=1).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self.words[k][codes[:, k]] for k in range(self.words.shape[0])], axis=1)

    def tables(self, residual: np.ndarray) -> np.ndarray:
        """Squared distances of each query's parts to each codeword: queries x m x words."""
        m, _, width = self.words.shape
        parts = self.padded(residual).reshape(len(residual), m, width)
        cross = np.einsum("qmw,mkw->qmk", parts, self.words)
        return (parts**2).sum(axis=2)[:, :, None] + (self.words**2).sum(axis=2)[None] - 2 * cross


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k-means by Lloyd's rounds; an empty cluster takes a random row."""
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = np.concatenate([((centers**2).sum(axis=1) - 2 * part @ centers.T).argmin(axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        n = np.bincount(at, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        centers = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(centers))])
    return centers


def fit(x: np.ndarray, lists: int, subspaces: int = 8, words: int = 256, seed: int = 11, width: int = 2048) -> Index:
    """An index from a sample of unit vectors, the same for the same rows.

    It has at least `lists` lists, by as few levels of at most `width` centroids as give them.
    """
    rng = np.random.default_rng(seed)
    deep = 1
    while width**deep < lists:
        deep += 1
    each = lists if deep == 1 else next(k for k in range(2, width + 1) if k**deep >= lists)
    index, residual = Index([], np.zeros((subspaces, 1, -(-x.shape[1] // subspaces)))), x
    for _ in range(deep):
        level = _means(residual, max(1, min(each, len(x))), 6, rng)
        residual = residual - level[Index([level], index.words).lists(residual, 1)[:, 0]]
        index.levels.append(level)
    index.__post_init__()
    parts = index.padded(x - index.center(index.lists(x, 1)[:, 0])).reshape(len(x), subspaces, -1)
    index.words = np.stack([_means(np.ascontiguousarray(parts[:, k]), min(words, len(x)), 6, rng) for k in range(subspaces)])
    return index


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of list values as doubles, shorter ones filled up with zeros."""
    values, at = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), column.offsets.to_numpy()
    at = at - at[0]
    size = np.diff(at)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(values)) - np.repeat(at[:-1], size)] = values
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


_FOUND = "a long, b long, links long"


def _place(index, probes: int, dim: int, names: list[str]):
    """Nodes with the lists they visit, nearest first, their residual codes and the codes' error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("embedding"), dim))
            near = ix.lists(x, probes)
            residual = x - ix.center(near[:, 0])
            codes = ix.encode(residual)
            error = np.sqrt(((ix.padded(residual) - ix.decode(codes)) ** 2).sum(axis=1))
            n, p = near.shape
            probed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * p), pa.array(near.reshape(-1)))
            raw = pa.array([row.tobytes() for row in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), probed, raw, pa.array(error)], [*names, "probes", "codes", "error"])

    return run


def _search(index, threshold: float, dim: int):
    """Groups (label, size, list, block), stored rows first, to links.

    Memory: one group's stored vectors and one Arrow batch of visitors. A row out is a link
    (a, b) that keeps components, or links found for node a (b null): a forest and counts, never
    all pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index.value
        reach = float(np.sqrt(2 - 2 * threshold))
        now, waiting, group = None, [], None

        def batch_of(a, b, n) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], ["a", "b", "links"])

        def close() -> Iterator[pa.RecordBatch]:
            if group is not None:
                hit = np.nonzero(group["links"])[0]
                if len(hit):
                    yield batch_of(group["node"][hit], [None] * len(hit), group["links"][hit])

        def visitors(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            here = now[2]
            x, node, copies, owner = _unit(_matrix(part.column("embedding"), dim)), *(part.column(c).to_numpy() for c in ("node", "copies", "owner"))
            g, stored = group, len(group["node"])
            tables = ix.tables(x - ix.center(here)).astype(np.float32)
            adc = np.zeros((len(x), stored), np.float32)
            for k in range(tables.shape[1]):
                adc += tables[:, k][:, g["codes"][:, k]]
            i, j = np.nonzero(np.sqrt(np.maximum(adc, 0)) <= reach + g["error"][None, :] + 1e-4)
            fine = node[i] != g["node"][j]
            i, j = i[fine], j[fine]
            cosine = np.concatenate([np.zeros(0), *[(x[i[k : k + 65536]] * g["x"][j[k : k + 65536]]).sum(axis=1) for k in range(0, len(i), 65536)]])
            near = cosine >= threshold
            i, j = i[near], j[near]
            if not len(i):
                return
            # A pair of two lists that visit each other meets twice: it counts in the lower list.
            cross = owner[i] != here
            twice = cross & (g["probes"][j] == owner[i][:, None]).any(axis=1)
            counted = ~twice | (here < owner[i])
            links = np.bincount(i[counted], g["copies"][j[counted]], len(x)).astype(np.int64)
            back = counted & cross
            np.add.at(g["links"], j[back], copies[i[back]])
            before = g["root"]
            after = _forest(stored + len(x), i + stored, j, np.concatenate([before, np.arange(stored, stored + len(x))]))
            all_nodes = np.concatenate([g["node"], node])
            moved = np.nonzero((after != np.arange(len(after))) & (np.concatenate([before, np.arange(stored, stored + len(x))]) == np.arange(len(after))))[0]
            group["root"] = after[:stored]
            hit = np.nonzero(links)[0]
            yield batch_of(np.concatenate([all_nodes[moved], node[hit]]), [*all_nodes[after[moved]].tolist(), *[None] * len(hit)], np.concatenate([np.zeros(len(moved), np.int64), links[hit]]))

        def settle() -> None:
            nonlocal group, waiting
            rows = pa.Table.from_batches(waiting)
            n = rows.num_rows
            probes = rows.column("probes").combine_chunks()
            group = {
                "x": _unit(_matrix(rows.column("embedding").combine_chunks(), dim)),
                "node": rows.column("node").to_numpy(),
                "copies": rows.column("copies").to_numpy(),
                "codes": np.frombuffer(b"".join(rows.column("codes").to_pylist()), np.uint8).reshape(n, -1),
                "error": rows.column("error").to_numpy().astype(np.float32),
                "probes": probes.flatten().to_numpy().reshape(n, -1),
                "links": np.zeros(n, np.int64),
                "root": np.arange(n),
            }
            waiting = []

        for batch in batches:
            if not batch.num_rows:
                continue
            names = ("label", "size", "list", "block", "visit")
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names], axis=1)
            cuts = [0, *(np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                key = tuple(keys[a, :4].tolist())
                if key != now:
                    yield from close()
                    now, waiting, group = key, [], None
                part = batch.slice(a, b - a)
                if not keys[a, 4]:
                    waiting.append(part)
                    continue
                if waiting:
                    settle()
                if group is not None:
                    for at in range(0, part.num_rows, STEP):
                        yield from visitors(part.slice(at, STEP))
        yield from close()

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, probes: int = 16, list_size: int = 128, width: int = 2048, sample: int = 20_000, subspaces: int = 8) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id, embedding, label).

    Rows link where labels are equal and not null, lengths are equal, and the cosine in double
    precision is at least threshold. A null, empty or zero vector, one with a null or non-finite
    component, and one without a label link with nothing. n_links: other rows linked directly,
    equal vectors included. component_id: smallest vec_id reachable, itself included; kept: the
    row is that one. Rows with a null vec_id take part and name no component. Other columns are
    not read. Empty table: no rows.

    Equal vectors of a label become one node, so a group of copies is one row from there on.
    Centroids and codewords are fitted on `sample` nodes, the first by hash; every node is
    indexed. A node is stored in its nearest list, with residual codes and their error, and
    visits the `probes` nearest; a pair is found if either visits the other's list. Table look-up
    distances less the stored error are a lower bound, so within a list nothing is lost before
    the exact rerank; how many links the lists themselves lose is measured in tests/llm. Lists
    number one for every list_size nodes at any size: beyond `width` of them the coarse quantiser
    has a second level of centroids, and so on. A list of a label with over BLOCK nodes is dealt
    over several groups, each of which sees all visitors.
    """
    emb = F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), emb.alias("embedding"))
    linked = usable(emb) & F.col("label").isNotNull()
    keyed = materialize(rows.withColumn("linked", linked), "vectors")
    same = keyed.filter("linked").groupBy("label", "embedding").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    # The numbers are only names: written once, they stay as they are.
    nodes = materialize(same.select("*", F.size("embedding").alias("size"), F.monotonically_increasing_id().alias("node")), "vector-nodes")
    count, dim = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max("size"), F.lit(1))).first()
    found = None
    if count:
        got = nodes.select("label", "embedding").orderBy(F.xxhash64("label", "embedding"), "label", "embedding").limit(sample).select("embedding").toArrow().column(0).combine_chunks()
        index = vectors.sparkSession.sparkContext.broadcast(fit(_unit(_matrix(got, dim)), max(1, round(count / list_size)), subspaces, width=width))
        names = ["label", "size", "node", "copies", "embedding"]
        kind = nodes.schema["embedding"].dataType.simpleString()
        placed = nodes.select(names).mapInArrow(_place(index, probes, dim, names), f"label int, size int, node long, copies long, embedding {kind}, probes array<long>, codes binary, error double")
        placed = materialize(placed, "placed").withColumn("owner", F.get("probes", F.lit(0)))
        groups = placed.groupBy("label", "size", F.col("owner").alias("list")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        # One row stores the node in its own list, one a probe visits; a visitor needs no codes.
        visits = F.transform("probes", lambda p: F.struct(p.alias("list"), F.lit(True).alias("visit")))
        posted = placed.select("*", F.explode(F.concat(F.array(F.struct(F.col("owner").alias("list"), F.lit(False).alias("visit"))), visits)).alias("at")).select("*", "at.*").drop("at")
        posted = posted.withColumns({c: F.when(~F.col("visit"), F.col(c)) for c in ("probes", "codes", "error")})
        where = ["label", "size", "list"]
        # Most lists are one block: only those of more are looked up, the rest need no join.
        long_lists = broadcast_if_small(materialize(groups.filter("blocks > 1"), "lists"))
        dealt = posted.join(long_lists, where, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        every = F.when(F.col("visit"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.col("node"), F.col("blocks")).cast("int")))
        dealt = dealt.withColumn("block", F.explode(every)).drop("blocks")
        sorted_ = dealt.repartition(*where, "block").sortWithinPartitions(*where, "block", "visit", "node")
        found = materialize(sorted_.mapInArrow(_search(index, threshold, dim), _FOUND), "vector-links")
    else:
        found = vectors.sparkSession.createDataFrame([], _FOUND)
    parts = connected_components(found.filter("b is not null").select("a", "b")).withColumnRenamed("node", "_n")
    counts = found.filter("b is null").groupBy(F.col("a").alias("_c")).agg(F.sum("links").alias("links"))
    info = nodes.select("node", "first_id", "copies").join(counts, F.col("node") == F.col("_c"), "left").join(parts, F.col("node") == F.col("_n"), "left")
    info = materialize(info.select("node", "first_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component")), "vector-components")
    least = info.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = info.join(least, "component").select(F.col("node").alias("_node"), "copies", "links", "component_id")
    named = nodes.select("node", F.col("label").alias("_label"), F.col("embedding").alias("_embedding")).join(named, F.col("node") == F.col("_node")).drop("node")
    alike = F.col("linked") & (F.col("label") == F.col("_label")) & (F.col("embedding") == F.col("_embedding"))
    out = keyed.join(named, alike, "left")
    component = F.when(F.col("_node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
