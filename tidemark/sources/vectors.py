"""Vector caches: a .npy matrix beside one JSON line a row."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

META = "article_id string, newsId string"


def _open(path: str) -> pa.NativeFile:
    store, inside = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return store.open_input_file(inside)


def _header(path: str) -> tuple[tuple[int, ...], np.dtype, int]:
    """(shape, type, where the numbers begin) of a .npy file."""
    with _open(path) as f:
        version = np.lib.format.read_magic(f)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_columns, kind = read(f)
        if by_columns and len(shape) > 1 or len(shape) != 2 or kind.kind != "f":
            raise ValueError(f"{path}: a matrix of floats by rows is wanted, this is {kind} {shape}")
        return shape, kind, f.tell()


class Rows(InputPartition):
    def __init__(self, first: int, end: int) -> None:
        self.first, self.end = first, end


class NpyReader(DataSourceReader):
    """Ranges of rows, each read on its own by seeking; no task reads the whole file."""

    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def partitions(self) -> list[InputPartition]:
        (n, _), _, _ = _header(self.path)
        return [Rows(a, min(n, a + self.rows)) for a in range(0, n, self.rows)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        (_, dim), kind, start = _header(self.path)
        step = max(1, 4_000_000 // max(1, dim * kind.itemsize))
        with _open(self.path) as f:
            for a in range(partition.first, partition.end, step):
                b = min(partition.end, a + step)
                f.seek(start + a * dim * kind.itemsize)
                values = np.frombuffer(f.read((b - a) * dim * kind.itemsize), kind).astype(np.float32)
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * dim), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b)), vectors], ["row", "vector"])


class Npy(DataSource):
    """spark.read.format("npy").load(path): row (long, from 0) and vector (array of float).

    Option rows: rows a partition. The path is one that driver and executors both open, with a
    scheme that pyarrow knows or none. Matrices by columns and of integers are refused.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row long, vector array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("rows", 65_536)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row, value): the lines of a text file that are not blank, numbered from 0 in file order.

    Lines are counted by the file's blocks, and only those counts, one a block, are put in order.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at")).filter(F.trim("value") != "")
    sizes = lines.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_block", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy("_at")) - 1
    return lines.withColumn("_place", place).join(starts, "_block").select((F.col("_start") + F.col("_place")).alias("row"), "value")


def read_cache(spark: SparkSession, folder: str, rows: int = 65_536) -> DataFrame:
    """(row, id, vector) of a cache: embeddings.npy, with the id in the same line of meta.jsonl:
    its article_id, or where that is empty its newsId; null where a line has neither.

    A cache whose two files differ in length raises.
    """
    spark.dataSource.register(Npy)
    vectors = spark.read.format("npy").option("rows", rows).load(f"{folder}/embeddings.npy")
    lines = numbered_lines(spark, f"{folder}/meta.jsonl")
    n, held = lines.count(), _header(f"{folder}/embeddings.npy")[0][0]
    if n != held:
        raise ValueError(f"{folder}: {n} lines for {held} vectors")
    m = F.from_json("value", META)
    named = lines.select("row", F.coalesce(F.nullif(m["article_id"], F.lit("")), m["newsId"]).alias("id"))
    return vectors.join(named, "row").select("row", "id", "vector")


def with_vectors(articles: DataFrame, folder: str, key: str = "article_id", rows: int = 65_536) -> DataFrame:
    """articles that the cache has a vector for, with `row` and `vector`.

    Lines of the cache that fit no article are skipped, so nothing is put beside another's
    vector; a key that is null fits nothing. Where none fits, the cache beside it with the suffix
    _subset is taken, if it has any; else this raises.
    """
    spark = articles.sparkSession
    found = articles.join(read_cache(spark, folder, rows).withColumnRenamed("id", key), key)
    if not found.isEmpty():
        return found
    try:
        spare = articles.join(read_cache(spark, f"{folder}_subset", rows).withColumnRenamed("id", key), key)
    except (FileNotFoundError, ValueError):
        spare = None
    if spare is None or spare.isEmpty():
        raise ValueError(f"{folder}: no vector for any article")
    warnings.warn(f"{folder}: no vector for any article, those of {folder}_subset are taken", stacklevel=2)
    return spare
