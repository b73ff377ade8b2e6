"""What the operators of this package share: scratch tables, byte-bounded batches, components."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from outlay.session import scratch_path

SLICE_BYTES = 1_000_000


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    On a cluster whose machines have no such folder the package is installed or sent along instead.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


class Scratch:
    """Tables that several steps of one operator read, in the folder all executors share.

    A written table cuts the lineage and survives the loss of executors. ``drop`` removes
    tables that no later step reads and lets the cleaner remove the shuffle files of finished
    steps, so that a long operator holds little more disk than its current step needs.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.name = spark, name
        workers_find_package(spark)
        self._paths: dict[int, str] = {}

    def write(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, self.name)
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            where = jvm.org.apache.hadoop.fs.Path(self._paths.pop(id(table)))
            where.getFileSystem(conf).delete(where, True)
        jvm.System.gc()


def text_slices(ids: pa.Array, texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Cut a batch into runs of rows with at most ``most`` bytes of text, one row at least."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(texts):
        stop = max(int(np.searchsorted(ends, ends[start] + most, "right")) - 1, start + 1)
        yield ids.slice(start, stop - start), texts.slice(start, stop - start)
        start = stop


def long_lists(parts: list[np.ndarray]) -> pa.Array:
    """An Arrow list column of 64-bit numbers."""
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.view(np.int64)))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of an undirected graph as ``(node, component)``.

    ``edges`` has the columns ``a`` and ``b`` of one orderable type. ``component`` is the
    smallest node of the component; nodes without an edge to another node are not returned.
    Large-star and small-star steps alternate until nothing changes: every node passes its
    least neighbour on, so the number of rounds grows with the logarithm of the longest path.
    Each round is written, and no component is ever held by one task: minima are combined
    before the shuffle, and the joins have one row per node on one side.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, name)
    now = scratch.write(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
        if seen.n == 0 or seen == before:
            break
        before = seen
        # large star: larger neighbours of a node move to the least node around it
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = scratch.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        large = scratch.write(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: a node and its smaller neighbours move to the least of them
        low = scratch.write(large.groupBy("a").agg(F.min("b").alias("m")))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = scratch.write(moved.union(low.select("a", F.col("m").alias("b"))).distinct())
        scratch.drop(now, least, large, low)
        now = after
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
