"""Hard-negative mining by angular triangle filtering.

Components become whole numbers (256 times the value, rounded down), scores are whole inner products.
Every row stores its norm and its angles to a fixed number of reference directions. By the triangle
inequality the angle between an anchor and a row lies, for each reference, between the difference and the sum of
their angles to it; the cosines of the narrowest such interval, times both norms, bound the score. The
bounds are widened by more than rounding can cost. Only rows whose bounds overlap a window of scores that an
anchor still asks for are scored, in whole numbers.

Rows lie in blocks by nearest reference and angle to it, so blocks have bounds, too, and a block is sent
only to the groups of anchors that may find something there. Hashed samples of the rows, each sixteen times the
one before, raise the least score of interest first, so that few rows remain to be merged in the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from outlay.llm.ann import vectors
from outlay.llm.common import Scratch

#: Reference directions, and the most rows (chosen by hash) that they are fitted on.
REFERENCES = 16
SAMPLE_ROWS = 20_000
#: About the rows of a block and the anchors of a group, and rows bounded at a time.
BLOCK, GROUP, TILE = 8192, 2048, 512
#: Each sample of the rows is so many times the one before.
STEP = 16
#: A component counts as at most this (131,072 before scaling), so that products of 4,096 components fit in 64 bits.
MOST = 1 << 25
#: What stored angles may be off, together: arc cosine near its ends, and storing as 32-bit numbers.
ANGLE_ROOM, SCORE_ROOM = 4e-6, 1e-9
_FEW = 100_000
_ALL = 1 << 62
_KEPT = 1 << 20
FOUND = "rid long, wid int, vec_id long, score long"


def fit_references(x: np.ndarray, k: int = REFERENCES) -> np.ndarray:
    """Up to ``k`` unit directions: centres of the directions of ``x`` by k-means, all-zero rows left out."""
    length = np.linalg.norm(x, axis=1)
    x = x[length > 0] / length[length > 0, None]
    if not len(x):
        return np.eye(1, max(x.shape[1], 1))
    rng = np.random.default_rng(3)
    spread = np.unique(x, axis=0)
    centres = spread[rng.choice(len(spread), min(k, len(spread)), replace=False)]
    for _ in range(10):
        own = (x @ centres.T).argmax(1)
        sums = np.stack([x[own == c].sum(0) for c in np.unique(own)])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = (sums / np.where(size > 0, size, 1))[size[:, 0] > 0]
    return centres


def angles(x: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and angles to the references; a zero row is at a right angle to all."""
    norm = np.linalg.norm(x, axis=1)
    with np.errstate(all="ignore"):
        cosine = np.where(norm[:, None] > 0, x @ references.T / norm[:, None], 0.0)
    return norm, np.arccos(np.clip(cosine, -1, 1))


def score_bounds(a: np.ndarray, a_norm: np.ndarray, b: np.ndarray, b_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of every row of ``a`` with every row of ``b``, from angles and norms."""
    near, far = np.zeros((len(a), len(b))), np.full((len(a), len(b)), np.pi)
    for j in range(a.shape[1]):
        x, y = a[:, j, None].astype(float), b[None, :, j].astype(float)
        np.maximum(near, np.abs(x - y), out=near)
        both = x + y
        np.minimum(far, np.minimum(both, 2 * np.pi - both), out=far)
    length = a_norm[:, None] * b_norm[None, :]
    room = SCORE_ROOM * length
    low = np.cos(np.minimum(far + ANGLE_ROOM, np.pi)) * length - room
    high = np.cos(np.maximum(near - ANGLE_ROOM, 0)) * length + room
    return np.ceil(low), np.floor(high)


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1) < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _best(window: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the ``k`` best entries of each window: greatest scores, ties to smaller ids."""
    order = np.lexsort((ids, -score, window))
    run = window[order]
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    place = np.arange(len(run)) - np.repeat(starts, np.diff(np.r_[starts, len(run)]))
    return order[place < k]


def _met(block: pa.Table, asking: pa.Table, wide: int, same: bool, k: int) -> pa.Table:
    """Per window of the anchors in ``asking`` the ``k`` best rows of ``block`` in it."""
    own, score, ids = (np.empty(0, np.int64) for _ in range(3))
    sizes, flat = np.zeros(0, int), None
    if len(block) and len(asking):
        listed = asking["windows"].combine_chunks()
        sizes, flat = np.diff(listed.offsets.to_numpy()), listed.flatten()
        low, high = flat.field("low").to_numpy().copy(), flat.field("high").to_numpy()
        anchor = np.repeat(np.arange(len(asking)), sizes)
        turn = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        a_label, a_id, a_norm = (asking[c].to_numpy() for c in ("label", "vec_id", "norm"))
        b_label, b_id, b_norm = (block[c].to_numpy() for c in ("label", "vec_id", "norm"))
        aq, bq = (vectors(t["q"], wide)[0] for t in (asking, block))
        a_angle, b_angle = (vectors(t["angles"])[0] for t in (asking, block))
        for at in range(0, len(block), TILE):
            t = slice(at, at + TILE)
            least, most = np.full(len(asking), _ALL), np.full(len(asking), -_ALL)
            np.minimum.at(least, anchor, low)
            np.maximum.at(most, anchor, high)
            under, over = score_bounds(a_angle, a_norm, b_angle[t], b_norm[t])
            fits = ((a_label[:, None] == b_label[None, t]) == same) & (a_id[:, None] != b_id[None, t])
            fits &= (over >= least[:, None]) & (under <= most[:, None])
            x, y = np.flatnonzero(fits.any(1)), np.flatnonzero(fits.any(0))
            if not len(x):
                continue
            value, fits = whole_products(aq[x], bq[t][y]), fits[np.ix_(x, y)]
            for n in range(int(sizes.max())):
                w = np.full(len(asking), -1)
                w[anchor[turn == n]] = np.flatnonzero(turn == n)
                w = w[x]
                inside = fits & (w >= 0)[:, None] & (value >= low[w][:, None]) & (value <= high[w][:, None])
                i, j = np.nonzero(inside)
                own, score, ids = np.append(own, w[i]), np.append(score, value[i, j]), np.append(ids, b_id[t][y[j]])
            if len(own) > _KEPT:
                kept = _best(own, score, ids, k)
                own, score, ids = own[kept], score[kept], ids[kept]
                full = np.flatnonzero(np.bincount(own, minlength=len(low)) == k)
                worst = np.full(len(low), _ALL)
                np.minimum.at(worst, own, score)
                low[full] = np.maximum(low[full], worst[full])
        if len(own):
            kept = _best(own, score, ids, k)
            own, score, ids = own[kept], score[kept], ids[kept]
    rid = asking["rid"].to_numpy()[anchor[own]] if flat is not None else own
    wid = flat.field("wid").to_numpy()[own] if flat is not None else own
    return pa.table({"rid": pa.array(rid, pa.int64()), "wid": pa.array(wid, pa.int32()), "vec_id": ids, "score": score})


def _ranges(df: DataFrame, key: str, n: int, more: list[Column]) -> DataFrame:
    """Per ``key`` the least and greatest norm and angle to each reference."""
    angle = [f(F.col("angles")[j]).alias(f"{name}{j}") for j in range(n) for name, f in (("from", F.min), ("to", F.max))]
    return df.groupBy(key).agg(F.min("norm").alias("norm0"), F.max("norm").alias("norm1"), *angle, *more)


def _top(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("rid", "wid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("place", place).where(F.col("place") <= k)


class _Search:
    """Rows in blocks and anchors in groups, both by nearest reference and the angle to it."""

    def __init__(self, scratch: Scratch, coded: DataFrame, n: int, wide: int, references: int) -> None:
        self.scratch, self.wide, self.references = scratch, wide, references
        drawn = coded.withColumn("draw", F.expr("pmod(xxhash64(rid, 'draw'), 1073741824)"))
        self.rows = self._dealt(drawn, "block", -(-n // BLOCK))
        anchors = self.rows.where("anchor").drop("block")
        self.anchors = self._dealt(anchors, "chunk", max(-(-anchors.count() // GROUP), 1))
        self.shares = [1]
        while n > BLOCK * self.shares[-1]:
            self.shares.append(self.shares[-1] * STEP)

    def _dealt(self, df: DataFrame, name: str, parts: int) -> DataFrame:
        """Rows with ``name``, one of ``parts`` ranges of their order, in as many partitions as the cluster likes."""
        ranged = df.repartitionByRange(parts, "cell", "own", "rid").withColumn("part", F.spark_partition_id().cast("long"))
        ranged = self.scratch.write(ranged)
        last = ranged.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0]
        return ranged.withColumn(name, F.expr(f"part * {parts} div {last + 1}")).drop("part")

    def best(self, windows: DataFrame, same: bool, k: int) -> DataFrame:
        """``(rid, wid, vec_id, score, place)``: the ``k`` best rows of equal (``same``) or other label in each window
        ``(rid, wid, low, high)`` of scores."""
        windows = windows.select("rid", "wid", "low", "high")
        for share in reversed(self.shares[1:]):
            kth = _top(self._pass(windows, same, k, share), k).where(F.col("place") == k)
            kth = kth.select("rid", "wid", F.col("score").alias("kth"))
            raised = windows.join(kth, ["rid", "wid"], "left").withColumn("low", F.greatest("low", "kth")).drop("kth")
            windows = self.scratch.write(raised)
        return self.scratch.write(_top(self._pass(windows, same, k, 1), k))

    def _pass(self, windows: DataFrame, same: bool, k: int, share: int) -> DataFrame:
        """The best rows per window and block, among one of ``share`` rows."""
        rows = self.rows.where(F.col("draw") < (1 << 30) // share).withColumn("block", F.expr(f"block div {share}"))
        listed = windows.groupBy("rid").agg(F.collect_list(F.struct("wid", "low", "high")).alias("windows"))
        asking = self.anchors.join(listed, "rid")
        n = self.references
        low, high = F.array_min(F.col("windows")["low"]), F.array_max(F.col("windows")["high"])
        blocks = self.scratch.write(_ranges(rows, "block", n, []))
        groups = _ranges(asking, "chunk", n, [F.min(low).alias("low"), F.max(high).alias("high")])
        most = blocks.agg(F.coalesce(F.max("block"), F.lit(-1)).alias("m")).first().m
        a, b = groups.alias("a").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(most, 0))))), blocks.alias("b")
        # what the triangle inequality leaves for any anchor of the group with any row of the block
        apart = [F.greatest(F.col(f"a.from{j}") - F.col(f"b.to{j}"), F.col(f"b.from{j}") - F.col(f"a.to{j}")) for j in range(n)]
        near = F.greatest(F.lit(0.0), F.lit(0.0), *apart)
        sums = [F.least(F.col(f"a.to{j}") + F.col(f"b.to{j}"), 2 * np.pi - F.col(f"a.from{j}") - F.col(f"b.from{j}")) for j in range(n)]
        far = F.least(F.lit(np.pi), F.lit(np.pi), *sums)
        longest, shortest = F.col("a.norm1") * F.col("b.norm1"), F.col("a.norm0") * F.col("b.norm0")

        def score(angle: Column, upper: bool) -> Column:
            cosine = F.cos(angle)
            large, small = (longest, shortest) if upper else (shortest, longest)
            room = SCORE_ROOM * 2 * longest + 1
            return F.when(cosine > 0, cosine * large).otherwise(cosine * small) + (room if upper else -room)

        near, far = F.greatest(near - 2 * ANGLE_ROOM, F.lit(0.0)), F.least(far + 2 * ANGLE_ROOM, F.lit(np.pi))
        met = a.join(b, "block").where((score(near, True) >= F.col("low")) & (score(far, False) <= F.col("high")))
        met = self.scratch.write(met.select("block", "chunk"))
        met = F.broadcast(met) if met.count() <= _FEW else met
        columns = ("block", "chunk", "vec_id", "label", "q", "norm", "angles")
        left = rows.join(met, "block").select(*columns).groupBy("block", "chunk")
        right = asking.join(met, "chunk").select(*columns, "rid", "windows").groupBy("block", "chunk")
        wide = self.wide
        return left.cogroup(right).applyInArrow(lambda x, y: _met(x, y, wide, same, k), FOUND)


def mine_hard_negatives(
    embeddings: DataFrame, anchor: str, positives: int = 5, negatives: int = 5, references: int = REFERENCES, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``embeddings`` has ``vec_id``, ``embedding`` and ``label``; ``anchor`` is a condition on these that chooses
    the anchors. An anchor's positives are its best ``positives`` rows of the same label with another id; for each of
    them the best ``negatives`` rows of another label come out whose score is at least 80 % of the positive's and not above
    it. Best means the greatest score, ties to the smaller id. Nothing fits below a negative positive score.

    Rows without id or label and rows whose vector is null or holds null or non-finite components take no part;
    zero and empty vectors do, with scores of 0. Shorter vectors count as padded with zeros, components beyond
    ``MOST`` as that. Rows that repeat id, label and vector are one row; rows that only share an id are rows of
    their own, but not each other's positives or negatives. Other columns are not read. The references
    are fitted on about ``sample_rows`` rows; they change the work, never the result.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    scaled = F.transform("embedding", lambda v: F.floor(F.least(F.greatest(v * 256, F.lit(-float(MOST))), F.lit(float(MOST)))).cast("int"))
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(F.expr(anchor), F.lit(False)).alias("anchor"),
    )
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    rows = rows.select("vec_id", "label", scaled.alias("q"), "anchor").groupBy("vec_id", "label", "q").agg(F.max("anchor").alias("anchor"))
    rows = scratch.write(rows.withColumn("rid", F.xxhash64("vec_id", "label", "q")))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width"), F.count_if("anchor").alias("anchors")).first()
    names = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not facts.n or not facts.anchors:
        return spark.createDataFrame([], names)
    wide = max(facts.width, 1)
    share = max(1, min(1.0, sample_rows / facts.n) * (1 << 30))
    some = rows.where(F.pmod(F.xxhash64("rid", F.lit("fit")), F.lit(1 << 30)) < share).select("rid", "q").orderBy("rid").toArrow()
    centres = fit_references(vectors(some["q"], wide)[0], references)

    def coded(batches):
        for batch in batches:
            if len(batch):
                norm, angle = angles(vectors(batch.column(0), wide)[0], centres)
                cell = angle.argmin(1)
                own = angle[np.arange(len(angle)), cell]
                stored = pa.FixedSizeListArray.from_arrays(pa.array(angle.astype(np.float32).ravel()), angle.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(norm), stored, pa.array(cell.astype(np.int32)), pa.array(own)],
                    names=["q", "rid", "vec_id", "label", "anchor", "norm", "angles", "cell", "own"],
                )

    schema = "q array<int>, rid long, vec_id long, label long, anchor boolean, norm double, angles array<float>, cell int, own double"
    table = scratch.write(rows.select("q", "rid", "vec_id", "label", "anchor").mapInArrow(coded, schema))
    scratch.drop(rows)
    search = _Search(scratch, table, facts.n, wide, len(centres))
    scratch.drop(table)
    every = search.anchors.select("rid", F.lit(0).alias("wid"), F.lit(-_ALL).alias("low"), F.lit(_ALL).alias("high"))
    near = search.best(every, True, positives)
    score = F.col("score")
    windows = near.where("score >= 0").select(
        "rid", F.col("place").alias("wid"), (score - F.expr("score div 5")).alias("low"), score.alias("high"), F.col("vec_id").alias("positive_id")
    )
    hard = search.best(windows, False, negatives)
    return (
        hard.select("rid", "wid", F.col("place").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
        .join(windows.select("rid", "wid", "positive_id", F.col("high").alias("positive_score")), ["rid", "wid"])
        .join(search.anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid")
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
