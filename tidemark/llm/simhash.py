"""SimHash near-duplicates: fingerprints, deletion-variant signatures, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.graph import connected_components
from tidemark.runtime import materialize

SEED = 42
BLOCK = 4096  # rows of one signature that are compared in one block
TASK = 8192  # fingerprints whose signatures one task writes
SHORT = 48  # runs up to this length are compared lag by lag, all at once


def fingerprint(text: bytes | None, n: int = 5) -> int:
    """The 64-bit SimHash of the n-word shingles of a text, repeats included, as a signed number.

    A-Z are lower-cased; a text of fewer than n words is one shingle; one of none, or null: 0.
    """
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    if len(words) <= n:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", n: int = 5) -> DataFrame:
    """(doc_id, text_hash, fp) for every row of docs; whole texts are read, in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, n) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_hash", "fp"])

    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _segments(distance: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments: so few that distance bits can't spoil all by two."""
    count = distance // 2 + 1
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _signatures(fp, distance: int):
    """Array of signatures: every segment with every one of its bits struck out."""
    out = []
    for number, (low, width) in enumerate(_segments(distance)):
        whole = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        for bit in range(width):
            tag = (number * 64 + bit) << 40
            out.append(whole.bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)).cast("long")).bitwiseOR(F.lit(tag).cast("long")))
    return F.array(*out)


def _own(key: np.ndarray, x: np.ndarray, distance: int) -> np.ndarray:
    """Whether pairs with the differing bits x are within distance and belong to signature key.

    A pair meets under several signatures; it belongs to the first segment with at most one
    differing bit, at that bit, or at the segment's first bit if none differs.
    """
    own = np.bitwise_count(x) <= distance
    if not own.any():
        return own
    tag = key >> np.uint64(40)
    number, bit = tag >> np.uint64(6), tag & np.uint64(63)
    for k, (low, width) in enumerate(_segments(distance)):
        part = (x >> np.uint64(low)) & np.uint64((1 << width) - 1)
        few = np.bitwise_count(part) <= 1
        here = number == np.uint64(k)
        own &= ~((number > np.uint64(k)) & few)
        own &= ~(here & (part != (np.uint64(1) << bit)) & ~((part == 0) & (bit == 0)))
    return own


def _forest(n: int, i: np.ndarray, j: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
    """Smallest member of each of n items' component under the links i-j (vectorised hooking)."""
    root = np.arange(n) if parent is None else parent
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return root
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _compare(key: int, left: np.ndarray, right: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that keep a block's (or two blocks') components: at most one a row."""
    same = right is None
    rows = left if same else np.concatenate([left, right])
    base, root = 0 if same else len(left), np.arange(len(rows))
    other = left if same else right
    step = max(1, 4_000_000 // max(1, len(other)))
    for at in range(0, len(left), step):
        x = left[at : at + step, None] ^ other[None, :]
        i, j = np.nonzero(np.bitwise_count(x) <= distance)
        keep = i + at < j if same else np.ones(len(i), bool)
        i, j = i[keep], j[keep]
        own = _own(np.full(len(i), key, np.uint64), left[i + at] ^ other[j], distance)
        root = _forest(len(rows), i[own] + at, j[own] + base, root)
    linked = np.nonzero(root != np.arange(len(rows)))[0]
    return rows[linked], rows[root[linked]]


_LINKS = "key long, block long, a long, b long"


def _batch(key, block, a, b) -> pa.RecordBatch:
    as_long = lambda x: pa.array(np.asarray(x).astype(np.int64, copy=False), pa.int64())
    return pa.RecordBatch.from_arrays([as_long(key), as_long(block), as_long(a), as_long(b)], ["key", "block", "a", "b"])


def _within(distance: int):
    """Sorted (key, fp) rows to links; a run over BLOCK rows also gives its rows, by block.

    Links have block -1. Memory: the rows of one Arrow batch and of one block.
    """

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1, [len(keys)]))
        lengths = np.diff(bounds)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        small = np.repeat(lengths <= SHORT, lengths)
        k, f = keys[small], fps[small]
        for lag in range(1, min(SHORT, int(lengths[lengths <= SHORT].max(initial=1)))):
            at = np.nonzero(k[:-lag] == k[lag:])[0]
            if not len(at):
                break
            own = _own(k[at], f[at] ^ f[at + lag], distance)
            found.append((f[at][own], f[at + lag][own]))
        for start, length in zip(bounds[:-1][lengths > SHORT].tolist(), lengths[lengths > SHORT].tolist(), strict=True):
            found.append(_compare(int(keys[start]), fps[start : start + length], None, distance))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 2
        if len(a):
            yield _batch(np.zeros(len(a)), np.full(len(a), -1), a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        block = 0  # of the run that keys begins with
        for batch in batches:
            k, f = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64) for c in (0, 1))
            keys, fps = np.concatenate([keys, k]), np.concatenate([fps, f])
            while len(keys):
                end = int(np.searchsorted(keys, keys[-1], "left")) if keys[0] <= keys[-1] else 0
                first = int(np.searchsorted(keys, keys[0], "right"))
                if first >= BLOCK or (block and end):  # a long run, or the end of one
                    take = min(first, BLOCK)
                    part, key = fps[:take], int(keys[0])
                    a, b = _compare(key, part, None, distance)
                    if len(a):
                        yield _batch(np.zeros(len(a)), np.full(len(a), -1), a, b)
                    yield _batch(np.full(take, key), np.full(take, block), part, part)
                    keys, fps, block = keys[take:], fps[take:], 0 if take == first and end else block + 1
                    continue
                if end and (end >= 50_000 or len(keys) >= 100_000):
                    yield from links(keys[:end], fps[:end])
                    keys, fps = keys[end:], fps[end:]
                break
        if len(keys) and block:
            cut = int(np.searchsorted(keys, keys[0], "right"))
            a, b = _compare(int(keys[0]), fps[:cut], None, distance)
            if len(a):
                yield _batch(np.zeros(len(a)), np.full(len(a), -1), a, b)
            yield _batch(np.full(cut, int(keys[0])), np.full(cut, block), fps[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield from links(keys, fps)

    return run


def _across(distance: int):
    """Rows of two blocks of one key, grouped and sorted, to links between the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[np.ndarray] = []
        now = None

        def links() -> Iterator[pa.RecordBatch]:
            got = np.concatenate(rows)
            left, right = got[got[:, 3] == got[:, 1]][:, 4], got[got[:, 3] == got[:, 2]][:, 4]
            a, b = _compare(int(now[0]), left.view(np.uint64), right.view(np.uint64), distance)
            if len(a):
                yield _batch(np.zeros(len(a)), np.full(len(a), -1), a, b)

        for batch in batches:
            got = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(5)], axis=1)  # key, i, j, block, fp
            cuts = np.nonzero((got[1:, :3] != got[:-1, :3]).any(axis=1))[0] + 1
            for part in np.split(got, cuts):
                if not len(part):
                    continue
                if now is not None and (part[0, :3] != now).any():
                    yield from links()
                    rows = []
                now = part[0, :3]
                rows.append(np.ascontiguousarray(part))
        if now is not None:
            yield from links()

    return run


def link_fingerprints(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that keep every component.

    Two fingerprints at most `distance` bits apart agree, but for one bit at most, on one of
    distance // 2 + 1 segments, so they share a signature: that segment with one bit struck
    out. Rows meet by equality of signatures and each pair is verified on all 64 bits. Within
    a signature links are cut to a forest, at most one a row, so a dense group of n costs n
    links, not n squared. A signature with over BLOCK rows is cut into blocks; pairs of blocks
    are dealt to tasks of their own.
    """
    signatures = fps.select("fp", F.explode(_signatures(F.col("fp"), distance)).alias("key"))
    dealt = signatures.select("key", "fp").repartition(F.col("key")).sortWithinPartitions("key", "fp")
    found = materialize(dealt.mapInArrow(_within(distance), _LINKS), "signature-links")
    links = found.filter("block = -1").select("a", "b")
    blocks = found.filter("block >= 0")
    last = blocks.groupBy("key").agg(F.max("block").alias("last")).filter("last > 0")
    pairs = (
        blocks.join(last, "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
        .filter("other <> block")
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", F.col("a").alias("fp"))
    )
    across = pairs.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j").mapInArrow(_across(distance), _LINKS)
    return links.unionByName(across.select("a", "b"))


def near_duplicates(docs: DataFrame, text_col: str = "text", n: int = 5, distance: int = 4) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for every row of docs.

    component_id: the smallest doc_id reachable over fingerprints at most `distance` bits apart.
    Equal fingerprints are one node, whatever the number of their rows. Null and blank texts
    have fingerprint 0 and are linked like any other; rows with a null doc_id take part and
    never name a component, unless all its doc_ids are null (then it is null). Repeated rows
    share their component. Other columns are not read. Empty table: no rows.
    """
    rows = materialize(fingerprints(docs, text_col, n), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprint-nodes")
    spread = nodes.select("fp").repartition(-(-max(1, nodes.count()) // TASK))
    parts = connected_components(link_fingerprints(spread, distance))
    named = nodes.join(parts, F.col("fp") == F.col("node"), "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "components")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return rows.join(named.join(least, "component").select("fp", "component_id"), "fp").select("doc_id", "text_hash", "fp", "component_id")


def keep_one(docs: DataFrame, text_col: str = "text", n: int = 5, distance: int = 4) -> DataFrame:
    """docs with one row of each group of near-duplicates: the smallest (doc_id, text hash).

    Rows that repeat as a whole text under one doc_id count as one. The columns are those of
    docs. Texts are shuffled once, to meet the decisions; groups themselves are never gathered.
    """
    found = near_duplicates(docs, text_col, n, distance)
    chosen = found.groupBy(F.coalesce("component_id", F.lit(-(2**63) + 1)).alias("c"), F.col("component_id").isNull().alias("n")).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("text_hash"))).alias("k")
    )
    chosen = chosen.select(F.col("k.doc_id").alias("_keep_id"), F.col("k.text_hash").alias("_keep_hash"))
    hashed = docs.withColumn("_hash", F.xxhash64(F.col(f"`{text_col}`")))
    hit = hashed.join(chosen, F.col("_keep_id").eqNullSafe(F.col("doc_id").cast("long")) & (F.col("_keep_hash") == F.col("_hash")), "left_semi")
    return hit.dropDuplicates(["doc_id", "_hash"]).select(*[F.col(f"`{c}`") for c in docs.columns])
