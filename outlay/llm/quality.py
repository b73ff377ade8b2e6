"""Quality of documents: a kernel ridge model over document statistics, calibrated.

Statistics of the whole text are mapped by random Fourier features, whose inner products
approximate a Gaussian kernel. The ridge solution needs only the normal equations, which are sums
over rows: each partition adds its own, Spark adds them up. Isotonic regression on labelled rows
that the ridge did not see turns raw scores into probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from outlay.llm.common import Scratch, text_slices
from outlay.llm.shingles import WORDS, shingle_sets, text_bytes, word_hashes

#: Labelled rows that the model is fitted on, about; beyond it a hash of doc_id chooses.
TRAIN_ROWS = 50_000
FEATURES = 256
RIDGE = 1e-3
#: A document is kept from this score on.
KEEP_FROM = 0.3
_BINS = 2000
_CLIP = 5.0

# classes of bytes
_LOWER, _UPPER, _DIGIT, _BLANK, _LINE, _STOP, _COMMA, _SHOUT, _BAR, _SIGN, _HIGH = range(11)
_CLASS = np.full(256, _SIGN, np.int64)
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("A") : ord("Z") + 1] = _UPPER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _BLANK
_CLASS[0x0A] = _LINE
_CLASS[[ord(".")]] = _STOP
_CLASS[[ord(c) for c in ",;:'\"-()"]] = _COMMA
_CLASS[[ord("!"), ord("?")]] = _SHOUT
_CLASS[ord("|")] = _BAR
_CLASS[128:] = _HIGH
_N = 11


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text; a null text counts as empty, an empty one has zeros."""
    data, at = text_bytes(texts)
    rows = len(at) - 1
    owner = np.repeat(np.arange(rows), np.diff(at))
    count = np.bincount(owner * _N + _CLASS[data], minlength=rows * _N).reshape(rows, _N).astype(float)
    hashes, first = word_hashes(texts)
    words = np.diff(first).astype(float)
    word_owner = np.repeat(np.arange(rows), np.diff(first))

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(word_owner[mask], minlength=rows) / np.maximum(words, 1)

    again = np.zeros(len(hashes), bool)
    next_to = again
    for back in range(1, 9):
        same = np.zeros(len(hashes), bool)
        same[back:] = (hashes[back:] == hashes[:-back]) & (word_owner[back:] == word_owner[:-back])
        again = again | same
        if back == 1:
            next_to = same
    fresh = np.array([len(s) for s in shingle_sets(texts)], float)
    windows = np.maximum(words - WORDS + 1, np.minimum(words, 1))
    distinct = np.zeros(rows)
    for i, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        distinct[i] = len(np.unique(hashes[a:b])) if b > a else 0
    size = np.maximum(count.sum(1), 1)
    letters = np.maximum(count[:, _LOWER] + count[:, _UPPER], 1)
    some = np.maximum(words, 1)
    return np.column_stack(
        [
            np.log1p(words),
            np.minimum((size - count[:, _BLANK] - count[:, _LINE]) / some, 40),
            count[:, _UPPER] / letters,
            count[:, _DIGIT] / size,
            count[:, _SIGN] / size,
            np.minimum(count[:, _SIGN] / some, 4),
            np.minimum(count[:, _SHOUT] / some, 4),
            np.minimum(count[:, _BAR] / some, 2),
            np.minimum(count[:, _STOP] / some, 2),
            np.minimum(count[:, _COMMA] / some, 2),
            np.minimum(count[:, _LINE] / some, 2),
            share(next_to),
            share(again),
            distinct / some,
            1 - fresh / np.maximum(windows, 1),
            count[:, _HIGH] / size,
        ]
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts in text_slices(batch.column(0), batch.column(1).fill_null("")):
            found = statistics(texts)
            ends = np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel()))], names=["doc_id", "f"])


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


@dataclass(frozen=True)
class QualityModel:
    """Scaling, random features, ridge weights and the calibration curve (``x``, ``y``)."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def features(self, f: np.ndarray) -> np.ndarray:
        z = np.clip((f - self.mean) / self.scale, -_CLIP, _CLIP)
        out = np.empty((len(z), len(self.phase) + 1))
        out[:, :-1] = np.cos(z @ self.waves + self.phase) * np.sqrt(2 / len(self.phase))
        out[:, -1] = 1
        return out

    def raw(self, f: np.ndarray) -> np.ndarray:
        return np.clip(self.features(f) @ self.weights, -0.5, 1.5)

    def score(self, f: np.ndarray) -> np.ndarray:
        """Calibrated; a thousandth of the raw score orders rows on the flat parts of the curve."""
        raw = self.raw(f)
        return np.clip(0.999 * np.interp(raw, self.x, self.y) + 0.001 * (raw + 0.5) / 2, 0, 1)


def isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``value`` by weighted squares (pool adjacent violators)."""
    pools: list[list[float]] = []
    for v, w in zip(value.tolist(), weight.tolist(), strict=True):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            pools.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in pools])


def fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5


def label_per_document(labels: DataFrame, column: str) -> DataFrame:
    """``(doc_id, y)``: one row per document with a label 0 or 1; repeated labels count once, documents with both labels not at all."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("y"))
    both = known.where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z"))
    return both.where("y = z").select("doc_id", "y")


def _sampled(labels: DataFrame, train_rows: int) -> DataFrame:
    """``(doc_id, y, fold)`` of the labels to learn from: about ``train_rows`` of those outside of fold 0."""
    known = label_per_document(labels, "quality").select("doc_id", F.col("y").cast("double").alias("y"), fold("doc_id").alias("fold")).where("fold <> 0")
    total = known.count()
    if total > train_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (train_rows << 30) // total)
    return known


def fit_quality(measured: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> QualityModel | None:
    """Fit on labelled rows outside of fold 0; None if these rows do not hold both labels.

    ``measured`` has ``doc_id`` and ``f``, ``labels`` has ``doc_id`` and ``quality``. Folds 1 to 3 fit the
    ridge, fold 4 the calibration (or the same rows, if either has too few). Null labels do not count.
    """
    scratch = Scratch(measured.sparkSession, "quality-fit")
    # at most about train_rows ids with a label
    rows = scratch.write(measured.join(F.broadcast(_sampled(labels, train_rows)), "doc_id"))
    seen = {(r.fold, r.y): r.n for r in rows.groupBy("fold", "y").agg(F.count("*").alias("n")).collect()}
    if {y for _, y in seen} != {0.0, 1.0}:
        return None
    apart = all(sum(n for (k, v), n in seen.items() if v == y and (k == 4) == last) >= 20 for y in (0.0, 1.0) for last in (False, True))
    fitted, tuned = (rows.where("fold <> 4"), rows.where("fold = 4")) if apart else (rows, rows)
    width = len(rows.select("f").first().f)
    each = fitted.select(*[F.col("f")[i].alias(f"f{i}") for i in range(width)])
    moments = each.agg(*[g(f"f{i}").alias(f"{n}{i}") for i in range(width) for n, g in (("m", F.avg), ("s", F.stddev_pop))]).first()
    mean = np.array([moments[f"m{i}"] for i in range(width)])
    scale = np.array([max(moments[f"s{i}"], 1e-6) for i in range(width)])
    rng = np.random.default_rng(7)
    waves = rng.normal(size=(width, FEATURES)) / np.sqrt(width)
    none = np.empty(0)
    bare = QualityModel(mean, scale, waves, rng.uniform(0, 2 * np.pi, FEATURES), none, none, none)

    def equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The partition's sums: one row per cell of the matrix [Z'Z, Z'y]."""
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if len(batch):
                z = bare.features(matrix(batch.column(0)))
                total[:, :-1] += z.T @ z
                total[:, -1] += z.T @ batch.column(1).to_numpy()
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    few = fitted.select("f", "y").coalesce(16)
    cells = few.mapInArrow(equations, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    system = np.zeros((FEATURES + 1, FEATURES + 2))
    system[cells["i"].to_numpy(), cells["j"].to_numpy()] = cells["v"].to_numpy()
    gram, right = system[:, :-1], system[:, -1]
    weights = np.linalg.solve(gram + RIDGE * gram[-1, -1] / FEATURES * np.eye(FEATURES + 1), right)
    ridge = QualityModel(mean, scale, waves, bare.phase, weights, none, none)

    def raws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                slot = np.minimum((ridge.raw(matrix(batch.column(0))) + 0.5) / 2 * _BINS, _BINS - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slot), batch.column(1)], names=["slot", "y"])

    curve = tuned.select("f", "y").mapInArrow(raws, "slot long, y double").groupBy("slot").agg(F.avg("y").alias("v"), F.count("*").cast("double").alias("n"))
    curve = curve.orderBy("slot").toPandas()
    x = (curve.slot.to_numpy() + 0.5) / _BINS * 2 - 0.5
    return QualityModel(mean, scale, waves, bare.phase, weights, x, isotonic(curve.v.to_numpy(), curve.n.to_numpy()))


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs`` (``doc_id``, ``text``).

    ``labels`` (``doc_id``, ``quality``) teaches through rows outside of fold 0, about ``train_rows`` of them chosen by hash; repeated
    labels count once, documents with both labels not at all. Scores use nothing but the text. Null and empty texts have zero statistics and get the score of these. Without both labels
    to learn from all scores are 0.5. Repeated rows come back as often; a row without ``doc_id`` is not
    held out. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measured = scratch.write(docs.mapInArrow(_measured, "doc_id long, f array<double>"))
    model = fit_quality(measured, labels, train_rows)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.full(len(batch), 0.5)
            if model is not None and len(batch):
                score = model.score(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    out = measured.mapInArrow(scored, "doc_id long, score double")
    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that are scored ``KEEP_FROM`` or more, with all their columns.

    Texts are measured once to fit the model and once more to decide, so they are never shuffled.
    Without both labels to learn from all rows stay.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    measured = scratch.write(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .join(F.broadcast(_sampled(labels, train_rows)), "doc_id", "left_semi")
        .mapInArrow(_measured, "doc_id long, f array<double>")
    )
    model = fit_quality(measured, labels, train_rows)
    if model is None:
        return docs
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.string()).fill_null("")
            rows = pa.array(range(len(batch)))
            good = [model.score(statistics(part)) >= KEEP_FROM for _, part in text_slices(rows, texts)]
            yield batch.filter(pa.array(np.concatenate(good) if good else np.empty(0, bool)))

    return docs.mapInArrow(kept, docs.schema)
