"""Tables that are looked up by an id: written in buckets of the id, so that a lookup reads one of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from outlay.session import scratch_path

BUCKET_ROWS = 500_000


def write_keyed(df: DataFrame, key: str, name: str | None = None, path: str | None = None, buckets: int | None = None) -> str:
    """Write ``df`` in buckets of ``key``, sorted by it, and return the table's name.

    The files lie below ``path``, or a new folder of the shared scratch folder. The number of buckets follows the rows.
    """
    buckets = buckets or max(df.count() // BUCKET_ROWS, 8)
    name = name or f"keyed_{uuid.uuid4().hex}"
    path = path or scratch_path(df.sparkSession, name)
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", path).saveAsTable(name)
    return name


def find(spark: SparkSession, name: str, key: str, value: str) -> DataFrame:
    """The rows of a keyed table with that key; other buckets are not read."""
    return spark.table(name).where(F.col(key) == F.lit(value))
