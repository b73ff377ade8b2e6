"""Quality and toxicity: held-out accuracy on planted texts, and odd tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from outlay.llm import quality, toxicity

DOCS = "doc_id long, text string, score double, f string, y int, fold int, held_out string"
SYLLABLES = "an er th re on in st nd at en ti or es ing ble tion ou ha the of".split()
INSULTS = ("idiot", "moron", "filth")


def sentence(rng: random.Random) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 14))).capitalize() + "."


def good(rng: random.Random) -> str:
    return "\n".join(" ".join(sentence(rng) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4)))


def junk(rng: random.Random) -> str:
    words = good(rng).split()
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " | ".join(words)
    return " ".join(" ".join([w] * 8) for w in words)


def toxic(rng: random.Random) -> str:
    words = good(rng).split()
    for _ in range(rng.randrange(2, 4)):
        words.insert(rng.randrange(len(words)), rng.choice([*INSULTS, "zwk" + rng.choice(SYLLABLES) + rng.choice(SYLLABLES)]))
    return " ".join(words)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, 0.1, "f", 1, 2, "h") for i, t in texts], DOCS)


def held(i: int) -> bool:
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def rated():
    rng = random.Random(8)
    texts = [(i, junk(rng) if i % 5 == 0 else good(rng)) for i in range(900)]
    return texts, {i: int(i % 5 != 0) for i, _ in texts}


def test_quality_on_held_out_documents(spark, rated):
    texts, truth = rated
    labels = spark.createDataFrame([(i, y, "x") for i, y in truth.items() if i % 3] + [(None, 1, "x"), (1, None, "x"), (10**6, 0, "x")], "doc_id long, quality int, text string")
    rows = [*texts, (5000, None), (5001, ""), (5002, "x " * 50_000), (None, "no id"), (0, texts[0][1])]
    out = quality.score_quality(frame(spark, rows), labels).collect()
    assert len(out) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    test = [r for r in out if r.doc_id in truth and (r.held_out or r.doc_id % 3 == 0)]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.97
    kept = quality.keep_quality(frame(spark, rows), labels)
    assert kept.columns == DOCS.replace(",", "").split()[::2]
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
        (str(i), str(t)) for (i, t), p in zip(rows, _scores(out, rows), strict=True) if p >= 0.3
    )


def _scores(out, rows):
    """Scores by text; equal texts have equal scores."""
    by_id = {}
    for r in out:
        by_id.setdefault(r.doc_id, r.score)
    return [by_id[i] for i, _ in rows]


def test_quality_without_both_labels(spark, rated):
    some = frame(spark, rated[0][:20])
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(some, one).collect()} == {0.5}
    assert quality.keep_quality(some, one).count() == 20
    assert quality.score_quality(frame(spark, []), one.where("false")).collect() == []


def test_isotonic_is_the_nearest_rising_curve():
    rng = np.random.default_rng(1)
    for _ in range(20):
        v, w = rng.normal(size=8), rng.uniform(0.5, 2, 8)
        fit = quality.isotonic(v, w)
        assert (np.diff(fit) >= -1e-12).all()
        for _ in range(200):
            other = np.sort(rng.choice(v, 8))
            assert (w * (fit - v) ** 2).sum() <= (w * (other - v) ** 2).sum() + 1e-9


def test_statistics_of_slices_and_odd_texts():
    texts = pa.array(["", None, " \n", "One two. Two one!", "a a a a a a", "é|è é|è"])
    found = quality.statistics(texts)
    assert np.isfinite(found).all() and (found[0] == found[1]).all()
    assert (quality.statistics(texts.slice(3, 2)) == found[3:5]).all()


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x, width = rng.normal(size=(40, 6)), 6
    none = np.empty(0)
    waves = rng.normal(size=(width, 4000)) / np.sqrt(width)
    model = quality.QualityModel(np.zeros(width), np.ones(width), waves, rng.uniform(0, 2 * np.pi, 4000), none, none, none)
    z = model.features(x)[:, :-1]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * width))
    assert np.abs(z @ z.T - kernel).max() < 0.1


def test_toxicity_on_held_out_documents(spark):
    rng = random.Random(9)
    texts = [(i, toxic(rng) if i % 4 == 0 else good(rng)) for i in range(800)]
    truth = {i: int(i % 4 == 0) for i, _ in texts}
    labels = spark.createDataFrame([(i, y, "x") for i, y in truth.items()] + [(None, 1, "x"), (1, None, "x")], "doc_id long, toxic int, text string")
    rows = [*texts, (5000, None), (5001, ""), (5002, "an er. " * 20_000), (None, "you idiot"), (1, texts[1][1])]
    out = toxicity.score_toxicity(frame(spark, rows), labels).collect()
    assert len(out) == len(rows)
    assert all(r.held_out == (r.doc_id is not None and held(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    test = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.98
    known = dict(texts)
    for r in test:
        for part in filter(None, r.spans.split(",")):
            a, b = map(int, part.split(":"))
            assert any(word in known[r.doc_id][a:b] for word in (*INSULTS, "zwk"))
    assert {r.predicted for r in out if r.doc_id in (5000, 5001, 5002)} == {0}


def test_toxicity_without_both_labels(spark):
    some = frame(spark, [(i, "an er in") for i in range(5)])
    one = spark.createDataFrame([(i, 0) for i in range(5)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(some, one).collect()} == {0.0}
    assert toxicity.score_toxicity(frame(spark, []), one).collect() == []


def test_contradicting_and_repeated_labels(spark):
    rows = [(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (3, None), (None, 1), (4, 7)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    assert sorted(map(tuple, quality.label_per_document(labels, "quality").collect())) == [(1, 1), (3, 0)]


def test_ridge_scores_equal_a_dense_solution(spark, rated):
    texts, truth = rated
    labels = spark.createDataFrame(list(truth.items()), "doc_id long, quality int")
    measured = frame(spark, texts).select("doc_id", "text").mapInArrow(quality._measured, "doc_id long, f array<double>")
    model = quality.fit_quality(measured, labels)
    x = quality.statistics(pa.array([t for _, t in texts]))
    folds = [zlib.crc32(str(i).encode()) % 5 for i in range(900)]
    first = [i for i in range(900) if folds[i] in (1, 2, 3)]
    assert np.allclose(model.mean, x[first].mean(0)) and np.allclose(model.scale, np.maximum(x[first].std(0), 1e-6))
    z, y = model.features(x[first]), np.array([truth[i] for i in first], float)
    penalty = quality.RIDGE * len(first) / quality.FEATURES
    dense = np.linalg.lstsq(np.vstack([z, np.sqrt(penalty) * np.eye(z.shape[1])]), np.r_[y, np.zeros(z.shape[1])], rcond=None)[0]
    assert np.abs(z @ dense - model.raw(x[first])).max() < 1e-5


def test_toxic_scores_equal_a_sum_over_all_paths(spark):
    rng = random.Random(4)
    model = toxicity.fit_toxicity([toxic(rng) for _ in range(40)], [good(rng) for _ in range(60)])
    texts = ["", "an er th", "an idiot er. moron", "re! idiot idiot in on st nd", "filth", "an er th re on in st nd at"]
    got = toxicity.token_chances(model, texts, toxicity._Words(model.weights))
    for text, chances in zip(texts, got, strict=True):
        want, sentence_ = [], []
        for token in text.split():
            sentence_.append(token)
            if token[-1] in ".!?" or token is text.split()[-1]:
                want += _all_paths(model, sentence_)
                sentence_ = []
        if sentence_:
            want += _all_paths(model, sentence_)
        assert chances.tolist() == pytest.approx(want, abs=1e-9), text


def _all_paths(model, tokens):
    import itertools

    emit = [float(model.weights[toxicity.hashed(toxicity.token_features(t))].sum()) for t in tokens]
    total, each = 0.0, np.zeros(len(tokens))
    for path in itertools.product((0, 1), repeat=len(tokens)):
        score = model.chain.first[path[0]] + model.chain.last[path[-1]] + sum(e for e, s in zip(emit, path, strict=True) if s)
        weight = np.exp(score + sum(model.chain.move[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += weight
        each += weight * np.array(path)
    return (each / total).tolist()


def test_long_texts_teach_by_chosen_sentences():
    rng = random.Random(6)
    text = " ".join(sentence(rng) for _ in range(3000)) + " word" * 3000
    short = toxicity.sentences_chosen(text, 5000)
    assert 4000 < len(short) <= 5000 and short == toxicity.sentences_chosen(text, 5000)
    assert toxicity.sentences_chosen("a b.", 5000) == "a b." and toxicity.sentences_chosen("", 10) == ""
