"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables, without a loss.

Unit vectors are centred, rotated and cut at the sample median of each axis into 64-bit codes; the
rotation is learned so that the cut loses least. The code's four 16-bit parts index four
tables. A vector is filed under its parts and asks for every part that a vector near enough can have:
where two codes differ, the distances of both vectors from the cut add up to no more than their
projections are apart. The squares of these gaps have a bound T that follows from the cosine, so in
one of the parts they have T / 4, and there the own distances of one of the two vectors have T / 8
at most. That one flips the bits, in every way within T / 8, and finds the other, whatever the data.
Vectors with more than ``ASKED`` ways in a part are near too many cuts for the tables; they are
compared with all vectors of their label in blocks. Pairs are kept by the cosine of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from outlay.llm.ann import usable, vectors
from outlay.llm.common import Scratch, components

#: Rows that the rotation is fitted on.
SAMPLE_ROWS = 20_000
COSINE = 0.98
BITS, PARTS = 64, 4
#: Keys of a table that one vector asks for at most; vectors with more are compared in blocks of about ``BLOCK`` rows.
ASKED, BLOCK = 512, 512
_ROUNDS = 40
#: Rows of a lookup table up to which it is broadcast, and pairs whose cosines are worked out at once.
_FEW, _STEP = 100_000, 65_536


def learn_rotation(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Projection (width by ``BITS``) and cut points, from unit rows.

    Principal axes, completed by random directions where there are fewer than ``BITS``, are
    rotated in turns: codes are the signs, then the rotation is the one that brings the axes
    nearest to the codes.
    """
    rng = np.random.default_rng(11)
    centre = x.mean(0)
    _, _, axes = np.linalg.svd(x - centre, full_matrices=False) if len(x) else (0, 0, np.eye(x.shape[1]))
    axes = axes[:BITS].T
    if axes.shape[1] < BITS:
        axes = np.column_stack([axes, rng.normal(size=(x.shape[1], BITS - axes.shape[1])) / np.sqrt(x.shape[1])])
    v = (x - centre) @ axes
    turn, _ = np.linalg.qr(rng.normal(size=(BITS, BITS)))
    for _ in range(_ROUNDS if len(x) else 0):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    projection = axes @ turn
    return projection, np.median(x @ projection, axis=0) if len(x) else np.zeros(BITS)


def _codes(gaps: np.ndarray) -> np.ndarray:
    bits = (gaps >= 0).astype(np.uint64)
    return (bits << np.arange(BITS, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)


def codes(x: np.ndarray, projection: np.ndarray, cut: np.ndarray) -> np.ndarray:
    return _codes(x @ projection - cut)


def asked_flips(gaps: np.ndarray, limit: float) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Per row how many bits a near vector's code may differ in, and the flips to ask for.

    ``gaps`` are the signed distances from the cuts, ``limit`` bounds the squared distance of the
    projections of a near pair. Of two near rows one at least has the other within its number, and
    among its flips, which are ``part << 16 | bits``. A row has None where a part has too many.
    """
    square = gaps**2
    reach = (np.sort(square, axis=1).cumsum(1) <= limit / 2).sum(1)
    crowded, rows, flips = np.zeros(len(gaps), bool), [], []
    width = BITS // PARTS
    for part in range(PARTS):
        own = square[:, part * width : (part + 1) * width]
        row, mask, load = np.arange(len(gaps)), np.full(len(gaps), part << width), np.zeros(len(gaps))
        for bit in range(width):
            more = load + own[row, bit]
            fits = more <= limit / (2 * PARTS)
            row, mask, load = np.append(row, row[fits]), np.append(mask, mask[fits] | 1 << bit), np.append(load, more[fits])
            full = np.bincount(row, minlength=len(gaps)) > ASKED
            if full.any():
                crowded |= full
                row, mask, load = row[~full[row]], mask[~full[row]], load[~full[row]]
        rows.append(row)
        flips.append(mask)
    rows, flips = np.concatenate(rows), np.concatenate(flips).astype(np.int32)
    flips = np.split(flips[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=len(gaps)).cumsum()[:-1])
    return reach, [None if c else f for c, f in zip(crowded, flips, strict=True)]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row, added up component by component."""
    xy, xx, yy = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    for d in range(x.shape[1]):
        xy += x[:, d] * y[:, d]
        xx += x[:, d] * x[:, d]
        yy += y[:, d] * y[:, d]
    with np.errstate(all="ignore"):
        return xy / (np.sqrt(xx) * np.sqrt(yy))


def _part(code: str, part: str) -> str:
    return f"(shiftrightunsigned({code}, 16 * {part}) & 65535)"


def candidate_pairs(coded: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of ``coded`` (``cid``, ``label``, ``code``, ``reach``, ``flips``) with equal labels that meet in a table.

    Every near pair is among them but those of rows without ``flips``.
    """
    here = coded.where("flips is not null")
    place = F.expr(f"part << 16 | {_part('code', 'part')}").alias("place")
    filed = here.select("cid", "label", "code", "reach", F.explode(F.array(*map(F.lit, range(PARTS)))).alias("part")).select("cid", "label", "code", "reach", place)
    asks = here.select("cid", "label", "code", "reach", F.explode("flips").alias("flip")).withColumn("part", F.expr("shiftright(flip, 16)"))
    asks = asks.select("cid", "label", "code", "reach", F.expr("flip & 65535 <> 0").alias("other"), F.expr(f"cast((part << 16 | {_part('code', 'part')}) ^ (flip & 65535) as long)").alias("place"))
    both = asks.alias("x").join(filed.alias("y"), F.expr(
        "x.label = y.label and x.place = y.place and x.cid <> y.cid and bit_count(x.code ^ y.code) <= greatest(x.reach, y.reach)"
    ))
    # codes with an equal part meet in the first one, once; others may meet several times
    same = [f"({_part('(x.code ^ y.code)', str(p))} = 0)" for p in range(PARTS)]
    at = f"case {' '.join(f'when {s} then {p}' for p, s in enumerate(same))} else -1 end"
    both = both.where(f"if(x.other, {at} = -1, x.cid < y.cid and shiftright(x.place, 16) = {at})")
    return both.select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()


def crowded_links(crowded: DataFrame, classes: DataFrame, wide: int, cosine: float) -> DataFrame:
    """Links ``(a, b)`` of the ``crowded`` rows (``cid``, ``label``) with all of ``classes``, compared block by block."""
    per = classes.groupBy("label").agg(F.count("*").alias("n")).join(crowded.groupBy("label").agg(F.count("*").alias("k")), "label")
    per = Scratch(classes.sparkSession, "hamming-labels").write(per.select("label", F.expr(f"ceil(n / {BLOCK})").alias("ys"), F.expr(f"ceil(k / {BLOCK})").alias("xs")))
    per = F.broadcast(per) if per.count() <= _FEW else per
    every = classes.select("cid", "label", "embedding").join(crowded.select("cid", F.lit(True).alias("crowd")), "cid", "left")
    every = every.join(per, "label").withColumn("crowd", F.expr("crowd is not null"))

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        df = df.withColumn(own, F.expr(f"pmod(xxhash64(cid), {own}s)"))
        df = df.select("label", own, F.explode(F.expr(f"sequence(0l, {other}s - 1)")).alias(other), "cid", "crowd", "embedding")
        return df.toDF(*df.columns).groupBy("label", "x", "y")

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(left) and len(right):
            x, y = vectors(left["embedding"], wide)[0], vectors(right["embedding"], wide)[0]
            x_ids, y_ids, crowd = left["cid"].to_numpy(), right["cid"].to_numpy(), right["crowd"].to_numpy()
            # a pair of two crowded rows comes from both sides
            i, j = np.nonzero((_unit(x) @ _unit(y).T >= cosine - 1e-9) & (~crowd[None, :] | (x_ids[:, None] < y_ids[None, :])))
            for at in range(0, len(i), _STEP):
                p, q = i[at : at + _STEP], j[at : at + _STEP]
                near = cosines(x[p], y[q]) >= cosine
                a.append(np.minimum(x_ids[p], y_ids[q])[near])
                b.append(np.maximum(x_ids[p], y_ids[q])[near])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return dealt(every.where("crowd"), "x", "y").cogroup(dealt(every, "y", "x")).applyInArrow(met, "a long, b long")


def dedup_embeddings(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``embeddings`` (``vec_id``, ``embedding``, ``label``).

    Vectors link where labels are equal and not null and the cosine reaches ``cosine``; all links are found. Equal vectors
    are compared once and counted as often as they have ids. Vectors that are null, zero or hold null
    or non-finite components, vectors without label, and rows without id link with nothing.
    Shorter vectors count as padded with zeros. Rows that repeat an id, label and vector are one vector and
    come back as often. Rows that share only the id are vectors of their own, whose links to each other are not counted.
    Other columns are not read.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "hamming-dedup")
    rows = embeddings.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding")
    )
    good = usable(rows.where("vec_id is not null and label is not null"), "embedding")
    # trailing zeros are padding
    last = F.size("embedding") - F.coalesce(F.nullif(F.array_position(F.transform(F.reverse("embedding"), lambda v: v != 0), True), F.lit(0)) - 1, F.lit(0))
    good = good.withColumn("embedding", F.transform(F.slice("embedding", F.lit(1), last.cast("int")), lambda v: v + 0.0))
    named = scratch.write(good.select("vec_id", "label", "embedding", F.xxhash64("label", "embedding").alias("cid")))
    classes = scratch.write(
        named.groupBy("cid", "label").agg(F.first("embedding").alias("embedding"), F.countDistinct("vec_id").alias("w"), F.min("vec_id").alias("least"))
    )
    facts = classes.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("width")).first()
    lone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if not facts.n:
        return lone
    wide = facts.width
    chosen = classes.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < max(1, min(1.0, SAMPLE_ROWS / facts.n) * (1 << 30)))
    sample = vectors(chosen.select("cid", "embedding").orderBy("cid").toArrow()["embedding"], wide)[0]
    projection, cut = learn_rotation(_unit(sample) if len(sample) else np.zeros((0, wide)))

    # squared distance of unit vectors at the cosine, stretched by the projection; the rest is rounding
    limit = (2 - 2 * cosine) * np.linalg.norm(projection, 2) ** 2 * (1 + 1e-9) + 1e-12

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                gaps = _unit(vectors(batch.column(2), wide)[0]) @ projection - cut
                reach, flips = asked_flips(gaps, limit)
                found = [pa.array(_codes(gaps)), pa.array(reach, pa.int32()), pa.array(flips, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["cid", "label", "code", "reach", "flips"])

    code = classes.select("cid", "label", "embedding")
    code = scratch.write(code.mapInArrow(coded, f"cid long, label {code.schema['label'].dataType.simpleString()}, code long, reach int, flips array<int>"))
    pairs = scratch.write(candidate_pairs(code))
    crowded = scratch.write(code.where("flips is null").select("cid", "label"))
    scratch.drop(code)
    sides = pairs.join(classes.select(F.col("cid").alias("a"), F.col("embedding").alias("x")), "a")
    sides = sides.join(classes.select(F.col("cid").alias("b"), F.col("embedding").alias("y")), "b").select("a", "b", "x", "y")

    def reranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = cosines(vectors(batch.column(2), wide)[0], vectors(batch.column(3), wide)[0]) >= cosine
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(near)), batch.column(1).filter(pa.array(near))], names=["a", "b"])

    links = sides.mapInArrow(reranked, "a long, b long")
    if not crowded.isEmpty():
        links = links.union(crowded_links(crowded, classes, wide, cosine))
    links = scratch.write(links)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    weight = classes.select(F.col("cid").alias("b"), "w")
    linked = scratch.write(both.join(weight, "b").groupBy("a").agg(F.sum("w").alias("k")))
    part = components(links)
    part = scratch.write(part.join(classes.select(F.col("cid").alias("node"), "least"), "node"))
    least = scratch.write(part.groupBy("component").agg(F.min("least").alias("top")))
    found = classes.select("cid", "w", "least").join(linked, F.col("cid") == F.col("a"), "left")
    found = found.join(part.join(least, "component").select(F.col("node").alias("cid"), "top"), "cid", "left")
    found = scratch.write(found.select("cid", (F.col("w") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("top", "least").alias("component_id")))
    own = named.select("vec_id", "cid").join(found, "cid")
    several = named.groupBy("vec_id").agg(F.countDistinct("cid").alias("n")).where("n > 1").select("vec_id")
    several = scratch.write(named.join(several, "vec_id", "left_semi").select("vec_id", "cid").distinct())
    if not several.isEmpty():
        # links between vectors of one id, per link and never per pair of rows
        met = both.join(several.select("vec_id", F.col("cid").alias("a")), "a").join(several.select("vec_id", F.col("cid").alias("b")), ["vec_id", "b"])
        same = met.groupBy("vec_id", F.col("a").alias("cid")).agg(F.count("*").alias("same"))
        own = own.join(same, ["vec_id", "cid"], "left").withColumn("n_links", F.col("n_links") - F.coalesce("same", F.lit(0)))
    own = own.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    usable_row = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
        & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("embedding", lambda v: v != 0),
        F.lit(False),
    )
    return own.union(rows.where(~usable_row).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))
