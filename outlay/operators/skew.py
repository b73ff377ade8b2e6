"""Building blocks that stay even when one key holds much of the data.

* ``running_before``: totals over the earlier rows of a key. A key's rows are cut
  into blocks of the global order, so that no task holds a whole key.
* ``row_index``: position of each row in a global order, without a single-task sort.
* ``lookup``: join a fact table with one row per key; heavy keys are salted.
* ``exact_percentile``: interpolated percentile without holding a group in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from outlay.session import materialize

BLOCK_ROWS = 1_000_000
MIN_BLOCKS = 16
HEAVY_ROWS = 200_000
BROADCAST_BYTES = 8_000_000


def with_block(df: DataFrame, order: str, blocks: int | None = None) -> DataFrame:
    """Add ``_block``: which range of ``order`` a row falls into. The rows are written once.

    Equal values share a block and blocks rise with the order; their sizes need not be exact. Without
    ``blocks`` their number follows the number of rows, without a limit.
    """
    if blocks is None:
        blocks = max(df.count() // BLOCK_ROWS, MIN_BLOCKS)
    ranged = df.drop("_block").repartitionByRange(blocks, order)
    return materialize(ranged.withColumn("_block", F.spark_partition_id()), "blocks")


def running_before(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column],
    extremes: dict[str, tuple[str, Column]] | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Add, per row, aggregates over the key's rows with a smaller ``order``.

    ``sums`` are 0 where no earlier row exists; ``extremes`` (``"min"`` or ``"max"`` and an
    expression) are null there. ``order`` must be unique within a key; keys and order must
    not be null. A ``_block`` column already present is used as it is.
    """
    kinds = {name: ("sum", col) for name, col in sums.items()} | (extremes or {})
    agg = {"sum": F.sum, "min": F.min, "max": F.max}
    merge = {"min": F.least, "max": F.greatest}
    rows = df.withColumns({f"_v_{name}": col for name, (_, col) in kinds.items()})
    if "_block" not in df.columns:
        rows = with_block(rows, order, blocks)
    per_block = rows.groupBy(*keys, "_block").agg(
        *[agg[kind](f"_v_{n}").alias(f"_p_{n}") for n, (kind, _) in kinds.items()]
    )
    parts = keys or [F.lit(0)]
    before = W.partitionBy(*parts).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = per_block.select(
        *keys,
        "_block",
        *[agg[kind](f"_p_{n}").over(before).alias(f"_o_{n}") for n, (kind, _) in kinds.items()],
    )
    inside = (
        W.partitionBy(*keys, "_block").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    )
    out = rows.join(offsets, [*keys, "_block"])

    def total(name: str, kind: str) -> Column:
        here, offset = agg[kind](f"_v_{name}").over(inside), F.col(f"_o_{name}")
        if kind == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(offset, F.lit(0))
        return merge[kind](here, offset)

    return out.select(
        *[F.col(c) for c in df.columns],
        *[total(n, kind).alias(n) for n, (kind, _) in kinds.items()],
    )


def row_index(df: DataFrame, order: str, name: str = "row_index", blocks: int | None = None) -> DataFrame:
    """Zero-based position of each row by ``order`` (unique, not null)."""
    return running_before(df, [], order, {name: F.lit(1).cast("long")}, blocks=blocks)


def lookup(
    fact: DataFrame,
    dim: DataFrame,
    keys: list[str],
    weight: str,
    spread: list[str],
    how: str = "inner",
    heavy_rows: int = HEAVY_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``fact`` with the usually much smaller ``dim``; ``weight`` = fact rows of the key.

    The dim is written once, because it is read for its size, for its heavy keys and for the
    join. A dim of few bytes is broadcast, and the fact rows are not shuffled. Else the fact rows of a
    key with more than ``heavy_rows`` are spread over salts, a fixed number of rows to each, by a
    hash of ``spread``, and its dim rows are repeated per salt. The list of heavy keys is
    broadcast as long as it is small, too.
    """
    dim = materialize(dim, "lookup")
    bytes_ = F.sum(F.length(F.to_json(F.struct(*dim.columns))))
    size = dim.agg(
        F.coalesce(bytes_, F.lit(0)).alias("bytes"), F.max(weight).alias("largest"), F.count_if(F.col(weight) > heavy_rows).alias("heavy")
    ).first()
    if size.bytes <= broadcast_bytes:
        return fact.join(F.broadcast(dim), keys, how)
    if size.largest <= heavy_rows:
        return fact.join(dim, keys, how)
    salts = F.when(F.col(weight) > heavy_rows, F.ceil(F.col(weight) / heavy_rows)).otherwise(1).cast("int")
    salted = dim.withColumn("_salts", salts)
    heavy = salted.where("_salts > 1").groupBy(*keys).agg(F.max("_salts").alias("_n"))
    heavy = F.broadcast(heavy) if size.heavy * 100 <= BROADCAST_BYTES else heavy
    left = (
        fact.join(heavy, keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread), F.coalesce("_n", F.lit(1))).cast("int"))
        .drop("_n")
    )
    right = salted.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    ).drop("_salts")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def exact_percentile(df: DataFrame, key: str, value: str, p: float, buckets: int = 4096) -> DataFrame:
    """Linear-interpolated percentile per key as ``(key, rows, percentile)``; null values do not count.

    Selection by repeated histograms: a key's rows are counted in ``buckets`` equal steps between its least and greatest
    value, the bucket that holds the wanted rank is kept, with its own least and greatest value, and counted again, until
    one value is left. Counts are summed before the shuffle and only they are ordered, so no task holds a key's rows.
    """
    vals = df.where(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"))
    n = F.count("*").alias("rows")
    state = vals.groupBy(key).agg(n, F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn("_below", F.lit(0).cast("long"))
    state = materialize(state.withColumn("_n", F.col("rows")), "percentile")
    rank = (F.col("rows") - 1) * F.lit(p)
    low_at = F.floor(rank)
    high_at = F.least(low_at + 1, F.col("rows") - 1)
    done = state.where("_lo = _hi").select(key, "rows", F.col("_lo").alias("_a"), F.col("_hi").alias("_b"))
    while True:
        state = state.where("_lo < _hi")
        if state.isEmpty():
            break
        near = lookup(vals, state, [key], "_n", ["_v"]).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        # halves, as the difference of two doubles may be too large for one
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        at = F.least(F.floor(share * buckets), F.lit(buckets - 1))
        counted = near.groupBy(key, at.alias("_at")).agg(
            F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.first("rows").alias("rows"), F.first("_below").alias("_below")
        )
        upto = W.partitionBy(key).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)  # at most so many buckets
        placed = counted.withColumn("_below", F.col("_below") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        holds = lambda at: (F.col("_below") <= at) & (at < F.col("_below") + F.col("_n"))
        found = materialize(placed.where(holds(low_at) | holds(high_at)).withColumn("_first", holds(low_at)).withColumn("_last", holds(high_at)), "percentile")
        # ranks in two buckets are the last of one and the first of the other
        ends = found.where("_first <> _last or _lo = _hi").groupBy(key).agg(
            F.first("rows").alias("rows"), F.max(F.when(F.col("_first"), F.col("_hi"))).alias("_a"), F.min(F.when(F.col("_last"), F.col("_lo"))).alias("_b")
        )
        done = done.union(ends)
        state = found.where("_first and _last").select(*state.columns)
        kept = near.join(state.select(key, F.col("_lo").alias("_from"), F.col("_hi").alias("_to")), key)
        vals = materialize(kept.where(F.col("_v").between(F.col("_from"), F.col("_to"))).select(key, "_v"), "percentile")
    return done.select(key, "rows", (F.col("_a") + (F.col("_b") - F.col("_a")) * (rank - F.floor(rank))).alias("percentile"))
