"""Nearest neighbours by inner product with a hierarchical k-means tree.

A component that completes all vectors to one length turns the largest inner product into the
smallest distance, and the tree is built in that space. Its top is fitted on a bounded sample; leaves that hold too
many vectors are split again, level by level, each on a bounded sample of its own, so that leaves stay as small
however many vectors there are. Every vector is indexed under one leaf. A query walks the tree best bin first: a priority queue
of nodes by distance yields leaves, the nearest first. How many leaves are visited is
calibrated: sample queries are answered exactly, and visits widen until the leaves that hold their
true neighbours are among those visited. Queries that begin at the same leaves form a part, and a leaf is sent, in blocks of
bounded size, only to the parts that visit it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from outlay.llm.common import Scratch

#: Rows that the tree is fitted on, and queries that are answered exactly to calibrate the visits.
SAMPLE_ROWS = 20_000
CALIBRATION = 128
BRANCHES, LEAF_ROWS = 8, 1000
TARGET = 0.96
#: Rows of a leaf above which it is split again, the rows it is split by, and leaves beyond which they grow instead (the tree
#: is held by the driver and every task).
SPLIT_ROWS, SPLIT_SAMPLE, MOST_LEAVES = 4000, 2000, 50_000
#: Most rows, and most queries, of one block.
BLOCK = 2048
_FAR, _FEW = 1 << 22, 200_000
_LISTED = pa.list_(pa.struct([("s", pa.float64()), ("id", pa.int64()), ("leaf", pa.int64())]))


def vectors(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lists as a double matrix padded with zeros, and which rows can take part.

    Rows that are null, zero, or hold null or non-finite components cannot.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.list_(pa.float64()))
    sizes = np.diff(column.offsets.to_numpy())
    if column.null_count:
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = int(sizes.max(initial=0)) if width is None else width
    x = np.zeros((len(column), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = place < width
    x[row[keep], place[keep]] = flat[keep]
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return x, good


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector can take part."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return df.where(F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda v: v != 0))


@dataclass
class Tree:
    """Centres of all nodes but the root, their children, and the leaf number of leaves (-1 else)."""

    centres: list[np.ndarray] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    leaf: list[int] = field(default_factory=list)
    roots: list[int] = field(default_factory=list)
    leaves: int = 0

    def matrix(self) -> np.ndarray:
        return np.stack(self.centres)

    def split(self, leaf: int, centres: np.ndarray) -> None:
        """Make a leaf a node with new leaves."""
        node = self.leaf.index(leaf)
        self.leaf[node] = -1
        for centre in centres:
            self.children[node].append(len(self.centres))
            self.centres.append(centre)
            self.children.append([])
            self.leaf.append(self.leaves)
            self.leaves += 1

    def in_order(self) -> list[int]:
        """Leaves from left to right."""
        out, todo = [], list(self.roots[::-1])
        while todo:
            node = todo.pop()
            if self.leaf[node] >= 0:
                out.append(self.leaf[node])
            todo += self.children[node][::-1]
        return out


def _split(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray | None:
    """Lloyd's k-means: the group of each row, or None if the rows cannot be told apart."""
    spread = np.unique(x, axis=0)
    if len(spread) < 2:
        return None
    centres = spread[rng.choice(len(spread), min(k, len(spread)), replace=False)]
    own = np.zeros(len(x), int)
    for _ in range(10):
        own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        alive = np.unique(own)
        centres = np.stack([x[own == c].mean(0) for c in alive])
    own = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
    return own if len(np.unique(own)) > 1 else None


def fit_tree(x: np.ndarray) -> Tree:
    rng, tree = np.random.default_rng(5), Tree()

    def add(rows: np.ndarray) -> int:
        node = len(tree.centres)
        tree.centres.append(rows.mean(0))
        tree.children.append([])
        tree.leaf.append(-1)
        own = _split(rows, BRANCHES, rng) if len(rows) > LEAF_ROWS else None
        if own is None:
            tree.leaf[node] = tree.leaves
            tree.leaves += 1
        else:
            tree.children[node] = [add(rows[own == c]) for c in np.unique(own)]
        return node

    tree.roots = [add(x)]
    return tree


def assign(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row: down the tree by the nearest centre."""
    centres, out = tree.matrix(), np.empty(len(x), np.int64)
    todo = [(tree.roots[0], np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if tree.leaf[node] >= 0:
            out[rows] = tree.leaf[node]
            continue
        below = np.array(tree.children[node])
        c = centres[below]
        near = ((c**2).sum(1) - 2 * x[rows] @ c.T).argmin(1)
        todo += [(int(below[k]), rows[near == k]) for k in np.unique(near)]
    return out


def best_bins(tree: Tree, queries: np.ndarray) -> Iterator[Iterator[int]]:
    """Per query its leaves, best first, lazily: the queue pops the nearest node met so far."""
    centres = tree.matrix()
    square = (centres**2).sum(1)
    step = max(1, _FAR // len(centres))

    def walk(d: np.ndarray) -> Iterator[int]:
        heap = [(d[n], n) for n in tree.roots]
        while heap:
            _, node = heapq.heappop(heap)
            if tree.leaf[node] >= 0:
                yield tree.leaf[node]
            for child in tree.children[node]:
                heapq.heappush(heap, (d[child], child))

    return (walk(d) for at in range(0, len(queries), step) for d in square - 2 * queries[at : at + step] @ centres.T)


def _products(x: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``at`` (a row of indexes per query), added up component by component,
    so that equal rows give equal sums."""
    total = np.zeros(at.shape)
    for d in range(x.shape[1]):
        total += x[at, d] * q[:, d : d + 1]
    return total


def _nearest(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per query the ids and inner products of its ``k`` best rows, ties to smaller ids.

    A matrix product finds the best rows; these are scored again one by one. Where more than ``k``
    rows come near the k-th best, all of them are.
    """
    rough = q @ x.T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    room = 1e-9 * (1 + np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1])
    plain, top = np.zeros(len(q), bool), np.zeros((len(q), 0), np.int64)
    score = np.zeros(top.shape)
    if len(x) > k:
        top = np.argpartition(rough, len(x) - k, axis=1)[:, len(x) - k :]
        kth = np.take_along_axis(rough, top, 1).min(1)
        plain = (kth > -np.inf) & ((rough >= kth[:, None] - room).sum(1) == k)
        score = _products(x, top, q)
        best = np.lexsort((ids[top], -score))
        top, score = np.take_along_axis(top, best, 1), np.take_along_axis(score, best, 1)
    for i in range(len(q)):
        if plain[i]:
            yield ids[top[i]], score[i]
            continue
        r = rough[i]
        have = int((r > -np.inf).sum())
        at = np.flatnonzero(r > -np.inf) if have <= k else np.flatnonzero(r >= np.partition(r, len(r) - k)[len(r) - k] - room)
        own = _products(x, at[None, :], q[i : i + 1])[0]
        best = np.lexsort((ids[at], -own))[:k]
        yield ids[at][best], own[best]


def nearest(embeddings: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: per query its ``k`` best rows found, best first.

    Both tables have ``vec_id`` and ``embedding``; a query is never its own neighbour. Shorter vectors
    count as padded with zeros. Rows without id and vectors that are null, zero or not finite take
    no part. Rows that repeat an id are one vector. Every query gets ``k`` rows where there are so
    many, whatever the visits. Other columns are not read.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "ann")
    answer = "query_id long, rank int, vec_id long, score double"

    def clean(df: DataFrame) -> DataFrame:
        one = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return usable(one.where("vec_id is not null"), "embedding").groupBy("vec_id").agg(F.min("embedding").alias("embedding"))

    rows, asked = scratch.write(clean(embeddings)), scratch.write(clean(queries))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v * v)
    width = F.max(F.size("embedding"))
    facts = rows.agg(F.count("*").alias("n"), F.max(square).alias("square"), width.alias("width")).first()
    wanted = asked.agg(F.count("*").alias("n"), width.alias("width")).first()
    if not facts.n or not wanted.n:
        return spark.createDataFrame([], answer)
    wide, top = max(facts.width, wanted.width), facts.square

    def some(df: DataFrame, most: int, n: int) -> np.ndarray:
        """About ``most`` rows chosen by a hash of the id, the vector first and the id last."""
        chosen = df.where(F.pmod(F.xxhash64("vec_id", F.lit("ann")), F.lit(1 << 30)) < max(1, min(1.0, most / n) * (1 << 30)))
        table = chosen.orderBy("vec_id").toArrow()
        return np.column_stack([vectors(table["embedding"], wide)[0], table["vec_id"].to_numpy()])

    def lifted(x: np.ndarray) -> np.ndarray:
        """Rows with the component that completes them to the greatest length."""
        return np.column_stack([x, np.sqrt(np.maximum(top - (x**2).sum(1), 0))])

    def flat(q: np.ndarray) -> np.ndarray:
        return np.column_stack([q, np.zeros(len(q))])

    sample = some(rows, SAMPLE_ROWS, facts.n)[:, :-1]
    tree = fit_tree(lifted(sample) if len(sample) else np.zeros((1, wide + 1)))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                leaf = assign(tree, lifted(vectors(batch.column(1), wide)[0]))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf)], names=["vec_id", "embedding", "leaf"])

    def index_by_tree() -> DataFrame:
        return rows.mapInArrow(indexed, "vec_id long, embedding array<double>, leaf long")

    def split(table: pa.Table) -> pa.Table:
        x = lifted(vectors(table["embedding"], wide)[0])
        own = _split(x[np.argsort(table["vec_id"].to_numpy())], BRANCHES, np.random.default_rng(5))
        centres = [] if own is None else [x[np.argsort(table["vec_id"].to_numpy())][own == c].mean(0).tolist() for c in np.unique(own)]
        return pa.table({"leaf": table["leaf"].slice(0, len(centres)), "centre": pa.array(centres, pa.list_(pa.float64()))})

    settled: set[int] = set()
    while True:
        # one number per leaf, of which there are at most about MOST_LEAVES
        held = {r.leaf: r.n for r in index_by_tree().groupBy("leaf").agg(F.count("*").alias("n")).collect()}
        large = [(leaf, n) for leaf, n in held.items() if n > SPLIT_ROWS and leaf not in settled]
        if not large or tree.leaves + BRANCHES * len(large) > MOST_LEAVES:
            break
        rates = spark.createDataFrame([(leaf, max(1, int(min(1.0, SPLIT_SAMPLE / n) * (1 << 30)))) for leaf, n in large], "leaf long, rate long")
        own = index_by_tree().join(F.broadcast(rates), "leaf").where(F.pmod(F.xxhash64("vec_id", F.lit("split")), F.lit(1 << 30)) < F.col("rate"))
        found: dict[int, list] = {}
        for r in own.select("leaf", "vec_id", "embedding").groupBy("leaf").applyInArrow(split, "leaf long, centre array<double>").collect():
            found.setdefault(r.leaf, []).append(r.centre)
        for leaf, _ in large:
            if len(found.get(leaf, [])) > 1:
                tree.split(leaf, np.array(sorted(found[leaf])))
            else:
                settled.add(leaf)  # its rows cannot be told apart
    index = scratch.write(index_by_tree())

    # calibration: exact answers of a few queries, and at which visit their leaves come up
    probe = some(asked, CALIBRATION, wanted.n)
    probe_ids, probe = probe[:, -1].astype(np.int64), probe[:, :-1]

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch) and len(probe):
                ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                where = dict(zip(ids.tolist(), leaf.tolist(), strict=True))
                for q, (near, score) in zip(probe_ids.tolist(), _nearest(vectors(batch.column(1), wide)[0], ids, probe, probe_ids, k), strict=True):
                    listed = [{"s": -s, "id": v, "leaf": where[v]} for v, s in zip(near.tolist(), score.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([q]), pa.array([listed], _LISTED)], names=["q", "near"])

    listed = index.mapInArrow(exact, "q long, near array<struct<s: double, id: long, leaf: long>>")
    truth = listed.groupBy("q").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k)["leaf"].alias("leaves")).collect()
    order = {int(q): list(walk) for q, walk in zip(probe_ids, best_bins(tree, flat(probe)), strict=True)}
    visit = sorted(order[r.q].index(leaf) for r in truth for leaf in r.leaves)
    visits = visit[min(len(visit) - 1, int(np.ceil(TARGET * len(visit))))] + 1 if visit else tree.leaves

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per query the leaves it visits: the calibrated number, and on until they hold ``k`` others."""
        for batch in batches:
            if len(batch):
                plans = []
                for walk in best_bins(tree, flat(vectors(batch.column(1), wide)[0])):
                    plan, rows_met = [], 0
                    for leaf in walk:
                        if len(plan) >= visits and rows_met > k:
                            break
                        plan.append(leaf)
                        rows_met += held.get(leaf, 0)
                    plans.append(plan)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(plans, pa.list_(pa.int64()))], names=["vec_id", "embedding", "leaves"])

    plans = scratch.write(asked.mapInArrow(walked, "vec_id long, embedding array<double>, leaves array<long>"))
    begun = {r.leaf: r.n for r in plans.groupBy(F.col("leaves")[0].alias("leaf")).agg(F.count("*").alias("n")).collect()}
    # neighbouring first leaves share a part until it has a block of queries; a crowded one has several parts
    groups, filled = [], BLOCK
    part = -1
    for leaf in tree.in_order():
        n = begun.get(leaf, 0)
        if n:
            if filled + n > BLOCK:
                part, filled = part + 1, 0
            several = -(-n // BLOCK)
            groups.append((leaf, part, several))
            part, filled = part + several - 1, filled + n if several == 1 else BLOCK
    groups = spark.createDataFrame(groups, "leaf long, q_from long, q_several long")
    sizes = spark.createDataFrame([(leaf, -(-n // BLOCK)) for leaf, n in held.items()], "leaf long, parts long")
    plans = plans.withColumn("leaf", F.col("leaves")[0]).join(F.broadcast(groups), "leaf")
    q_part = F.col("q_from") + F.pmod(F.xxhash64("vec_id"), F.col("q_several"))
    plans = plans.select("vec_id", "embedding", q_part.alias("q_part"), F.explode("leaves").alias("leaf"))
    visited = scratch.write(plans.select("leaf", "q_part").distinct().join(F.broadcast(sizes), "leaf"))
    plans = plans.join(F.broadcast(sizes), "leaf").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    few = F.broadcast if visited.count() <= _FEW else (lambda df: df)
    blocks = index.join(few(visited), "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))

    def met(block: pa.Table, asking: pa.Table) -> pa.Table:
        ids, scores = [], []
        q_ids = asking["vec_id"].to_numpy()
        if len(block) and len(asking):
            x, q = vectors(block["embedding"], wide)[0], vectors(asking["embedding"], wide)[0]
            for near, score in _nearest(x, block["vec_id"].to_numpy(), q, q_ids, k):
                ids.append(near.tolist())
                scores.append(score.tolist())
        else:
            q_ids = q_ids[:0]
        return pa.table({"query_id": pa.array(q_ids), "ids": pa.array(ids, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float64()))})

    keys = ("leaf", "part", "q_part")
    found = (
        blocks.select(*keys, "vec_id", "embedding").groupBy(*keys)
        .cogroup(plans.select(*keys, "vec_id", "embedding").groupBy(*keys))
        .applyInArrow(met, "query_id long, ids array<long>, scores array<double>")
    )
    pair = F.transform(F.arrays_zip("ids", "scores"), lambda p: F.struct((0.0 - p["scores"]).alias("s"), p["ids"].alias("id")))
    best = found.select("query_id", pair.alias("near")).groupBy("query_id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return best.select("query_id", F.posexplode("near").alias("at", "n")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("n.id").alias("vec_id"), (0.0 - F.col("n.s")).alias("score")
    )
