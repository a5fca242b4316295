"""Near copies by the Jaccard similarity of word shingles: MinHash bands, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.simhash import SEED
from tidemark.operators.graph import connected_components
from tidemark.runtime import broadcast_if_small, materialize, scratch

# A band is missed by a pair of similarity 0.8 with probability 1 - 0.8**4 = 0.59, all 32 with 5e-8.
BANDS, WIDTH = 32, 4
_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, (2, BANDS * WIDTH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles, by the words of simhash.fingerprint."""
    import xxhash

    words = text.lower().split() if text else []
    digest = xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([digest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    pairs = zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)
    return np.unique(np.array([digest(joined[i:j], SEED) for i, j in pairs], np.uint64))


def bands(hashes: np.ndarray) -> np.ndarray:
    """One key for each band of minima; sets of similarity s agree on a band with s**WIDTH."""
    least = np.full(BANDS * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * _FACTORS[0] + _FACTORS[1]
        x ^= x >> np.uint64(32)
        least = np.minimum(least, (x * _FACTORS[0]).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in least.reshape(BANDS, WIDTH).T:
        key = (key ^ part) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _hashes_of(texts: list[bytes | None], n: int) -> list[np.ndarray]:
    return [shingles(t, n) for t in texts]


def sketches(docs: DataFrame, text_col: str = "text", n: int = 5) -> DataFrame:
    """(doc_id, text_hash, node, n, bands) of the rows of docs that have a word: node stands for
    a set of shingles, n for its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = _hashes_of(batch.column(2).to_pylist(), n)
            has = pa.array([len(s) > 0 for s in sets], pa.bool_())
            sets = [s for s in sets if len(s)]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            keys = np.concatenate([bands(s) for s in sets]) if sets else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(has) for c in (0, 1)), pa.array(node), pa.array([len(s) for s in sets], pa.int32()), lists], ["doc_id", "text_hash", "node", "n", "bands"])

    return _texts(docs, text_col).mapInArrow(run, "doc_id long, text_hash long, node long, n int, bands array<long>")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def _sets(docs: DataFrame, text_col: str, n: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the texts that wanted (node, text_hash) names, read once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = _hashes_of(batch.column(1).to_pylist(), n)
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], ["node", "shingles"])

    texts = _texts(docs, text_col).join(broadcast_if_small(wanted), "text_hash").select("node", "text")
    return texts.mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those pairs (a, b) of nodes whose sets of shingles have that similarity, exactly."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(two, "b").filter(both >= similarity * (F.size("x") + F.size("y") - both)).select("a", "b")


ROUNDS = 3


def links(docs: DataFrame, rows: DataFrame, text_col: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """(a, b): pairs of nodes of that similarity that keep the components.

    Sets that agree on a band meet. In a round, the sets of a band are grouped by the components
    known so far, and all of them are compared with one centre: a set of the component whose turn
    it is, the set that meets most others over all bands. A group of n copies of one text so
    costs n pairs a band, not n squared, and is mostly one component after the first round, the
    original being its centre. Every round takes another component of each band for a centre; a
    band is done when its sets are in one component.
    What is then left in several components of a band is compared exactly, see _rest; so no pair
    that met is lost.
    """
    member = rows.dropDuplicates(["node"]).select("node", "n", "text_hash", F.explode(F.array_distinct("bands")).alias("band"))
    sizes = member.groupBy("band").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    met = materialize(member.join(sizes, "band"), "met")
    wanted = materialize(met.select("node", "text_hash").distinct(), "met-nodes")
    sets = materialize(_sets(docs, text_col, n, wanted), "met-sets")
    score = met.groupBy("node").agg(F.sum("size").alias("score"))
    met = materialize(met.join(score, "node").select("band", "node", "n", "score"), "met-scores")

    found = sets.sparkSession.createDataFrame([], "a long, b long")
    placed = met.withColumn("own", F.col("node"))
    for turn in range(ROUNDS + 1):
        if turn:
            parts = broadcast_if_small(materialize(connected_components(found), "near-components"))
            placed = met.join(parts.select("node", "component"), "node", "left").withColumn("own", F.coalesce("component", "node")).drop("component")
        if turn < ROUNDS:
            pairs = _to_centres(placed, turn, similarity)
        else:
            pairs = _rest(placed, sets, similarity)
        more = materialize(_verified(materialize(pairs, "near-pairs"), sets, similarity), "near-links")
        found = more if not turn else found.unionByName(more)
    return found


def _sized(a: str, b: str, similarity: float):
    return (F.col(a) >= similarity * F.col(b)) & (F.col(b) >= similarity * F.col(a))


def _to_centres(placed: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Pairs of each set with the centre of the turn of its band, if it is in another component.

    The components of a band are in the order of a hash that has the turn in it but for the
    first, where the one with the best connected set comes first.
    """
    best = F.max(F.struct("score", "node", "n")).alias("m")
    groups = placed.groupBy("band", "own").agg(best)
    order = F.struct(F.col("m.score"), F.col("m.node")) if not turn else F.struct(F.xxhash64("own", F.lit(turn)).alias("score"), F.col("m.node"))
    centre = groups.groupBy("band").agg(F.max(F.struct(order.alias("o"), F.col("own"), F.col("m"))).alias("c"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    centre = centre.select("band", F.col("c.own").alias("other"), F.col("c.m.node").alias("centre"), F.col("c.m.n").alias("size"))
    met = placed.join(centre, "band").filter((F.col("own") != F.col("other")) & _sized("n", "size", similarity))
    return met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()


def _rest(placed: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """All further pairs that may have that similarity, of sets whose bands still hold several
    components: by prefix filtering, which is exact.

    Two such sets agree on one at least of the n - similarity * n + 1 rarest shingles of each, in
    one order of all shingles by rarity. What many texts share is frequent, so it seldom stands
    in a prefix, and sets that have nothing but that in common do not meet.
    """
    several = placed.groupBy("band").agg(F.countDistinct("own").alias("parts")).filter("parts > 1").select("band")
    nodes = materialize(placed.join(several, "band", "left_semi").select("node", "own", "n").distinct(), "open-nodes")
    each = materialize(sets.join(nodes, "node").select("node", "own", "n", F.explode("shingles").alias("s")), "open-shingles")
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
    ranked = each.join(often, "s").groupBy("node", "own", "n").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("x"))
    prefix = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1 - (F.col("n") - F.size("x"))
    heads = ranked.withColumn("p", prefix.cast("int")).filter("p > 0").select("node", "own", "n", F.explode(F.transform(F.slice("x", F.lit(1), F.col("p")), lambda x: x["s"])).alias("s"))
    heads = materialize(heads, "rare-shingles")
    other = heads.select("s", F.col("node").alias("other_node"), F.col("own").alias("other"), F.col("n").alias("size"))
    met = heads.join(other, "s").filter((F.col("own") != F.col("other")) & (F.col("node") < F.col("other_node")) & _sized("n", "size", similarity))
    return met.select(F.col("node").alias("a"), F.col("other_node").alias("b")).distinct()


def components(docs: DataFrame, text_col: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text_hash, component) for the rows of docs that have a word.

    Rows are linked whose sets of n-word shingles have at least that Jaccard similarity.
    """
    rows = materialize(sketches(docs, text_col, n), "sketches")
    parts = connected_components(links(docs, rows, text_col, n, similarity))
    return rows.select("doc_id", "text_hash", "node").join(parts, "node", "left").select("doc_id", "text_hash", F.coalesce("component", "node").alias("component"))


def keep_one(docs: DataFrame, text_col: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs without the near copies of an earlier row: of each group the smallest (doc_id, text
    hash) stays, a null doc_id being the last. Rows without a word stay. Columns as in docs. The
    tables on the way are deleted once it is known which rows go."""
    with scratch() as tables:
        found = materialize(components(docs, text_col, n, similarity), "near-copies")
        key = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "text_hash")
        least = found.groupBy("component").agg(F.min(key).alias("k"), F.max(key).alias("l")).filter("k <> l").select("component", "k")
        gone = found.join(least, "component").filter(key != F.col("k")).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
        gone = tables.keep(materialize(gone, "gone"))
    match = F.col("_id").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("_hash") == F.xxhash64(F.col(f"`{text_col}`")))
    return docs.join(broadcast_if_small(gone), match, "left_anti")
