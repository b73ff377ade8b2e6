"""Nearest neighbours and embedding near-duplicates against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from outlay.llm.ann import assign, best_bins, fit_tree, nearest
from outlay.llm import hard_negatives
from outlay.llm.hamming_dedup import codes, dedup_embeddings, learn_rotation

SCHEMA = "vec_id long, embedding array<float>, label int, score double, leaf long, rank int, w long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 0.5, 1, 2, 3) for i, v, label in rows], SCHEMA)


def clustered(n: int, d: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return (centres[rng.integers(0, 12, n)] + rng.normal(size=(n, d)) * 0.6).astype(np.float32)


def exact(rows, q, k):
    score = {i: float(np.dot(np.array(v, float), np.array(q[1], float))) for i, v, _ in rows if i != q[0]}
    return sorted(score.items(), key=lambda s: (-s[1], s[0]))[:k]


def test_recall_order_and_scores(spark):
    x = clustered(4000, 24, 1)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    rows += [(5000 + i, x[40].tolist(), 0) for i in range(60)]  # equal vectors
    df = frame(spark, rows)
    found: dict[int, list] = {}
    for r in nearest(df, df.where("vec_id % 50 = 0")).collect():
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, answer in found.items():
        answer.sort(key=lambda r: r.rank)
        assert [r.rank for r in answer] == list(range(1, 21))
        want = exact(rows, rows[q] if q < 4000 else (q, x[40].tolist()), 20)
        value = dict(exact(rows, rows[q] if q < 4000 else (q, x[40].tolist()), len(rows)))
        assert all(r.vec_id != q and abs(r.score - value[r.vec_id]) < 1e-9 for r in answer)
        assert [(-r.score, r.vec_id) for r in answer] == sorted((-r.score, r.vec_id) for r in answer)
        hits += len({r.vec_id for r in answer} & {i for i, _ in want})
        total += 20
    assert len(found) == len([r for r in rows if r[0] % 50 == 0])
    assert hits / total >= 0.9


def test_few_rows_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 0), (1, [0.5, 0.5], 0), (2, [-1.0, 0.0], None), (3, None, 0), (4, [0.0, 0.0], 0), (5, [nan, 1.0], 0),
        (6, [inf, 1.0], 0), (7, [None, 1.0], 0), (8, [], 0), (20, [1.0], 0), (20, [1.0], 0), (None, [1.0, 1.0], 0), (40, [0.0, 0.0], 0),
    ]
    df = frame(spark, rows)
    found = nearest(df, df.where("vec_id % 20 = 0")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == [
        (0, 1, 20, 1.0), (0, 2, 1, 0.5), (0, 3, 2, -1.0), (20, 1, 0, 1.0), (20, 2, 1, 0.5), (20, 3, 2, -1.0),
    ]
    empty = frame(spark, [])
    assert nearest(empty, empty).collect() == [] and nearest(df, empty).collect() == []


def test_tree_walk_meets_every_leaf_once():
    x = clustered(3000, 8, 3).astype(float)
    tree = fit_tree(x)
    leaves = assign(tree, x)
    assert tree.leaves > 3 and set(leaves.tolist()) == set(range(tree.leaves))
    walk = list(next(iter(best_bins(tree, x[:1]))))
    assert sorted(walk) == list(range(tree.leaves)) and walk.index(leaves[0]) <= 3
    assert fit_tree(np.ones((2000, 4))).leaves == 1


def plain_links(rows, bound=0.98):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None:
            v = [0.0 if c is None else c for c in v] if None not in v else [np.nan]
            if np.isfinite(v).all() and np.any(v):
                good[i] = (np.pad(np.array(v, float), (0, 64 - len(v))), label)
    parent = {i: i for i, _, _ in rows}
    links = dict.fromkeys(parent, 0)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(good)
    for a in ids:
        for b in ids:
            (x, p), (y, q) = good[a], good[b]
            if a < b and p == q and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= bound:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((i, links[i], root(i), root(i) == i) for i in parent)


@pytest.mark.parametrize("d", [64, 10])
def test_near_duplicates_equal_brute_force(spark, d):
    rng = np.random.default_rng(d)
    base = rng.normal(size=(60, d))
    rows = []
    for i in range(500):
        v = base[i % 60] + rng.normal(size=d) * rng.choice([0.02, 0.1, 0.15, 0.6])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(0, 2))))
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(40)]
    rows += [(2000, None, 1), (2001, [0.0] * d, 1), (2002, [float("nan")] * d, 1), (2003, rows[7][1], None), (2004, [], 0), (2005, [None, 1.0], 0)]
    rows += [(2006, (np.array(rows[7][1]) * 3).astype(np.float32).tolist(), rows[7][2])]
    found = dedup_embeddings(frame(spark, rows)).collect()
    assert sorted(map(tuple, found)) == plain_links(rows)


def test_repeated_and_missing_rows(spark):
    found = dedup_embeddings(frame(spark, [(3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (4, [2.0, 4.0], 1), (None, [1.0, 2.0], 1)])).collect()
    assert sorted(map(str, map(tuple, found))) == ["(3, 1, 3, True)", "(3, 1, 3, True)", "(4, 1, 3, False)", "(None, 0, None, True)"]
    assert dedup_embeddings(frame(spark, [])).collect() == []
    # links between vectors of one id do not count
    found = dedup_embeddings(frame(spark, [(3, [1.0, 2.0], 1), (3, [1.0, 2.01], 1), (5, [1.0, 2.02], 1), (6, [-1.0, 0.0], 1), (6, [0.0, 1.0], 1)])).collect()
    assert sorted(map(tuple, found)) == [(3, 1, 3, True), (3, 1, 3, True), (5, 2, 3, False), (6, 0, 6, True), (6, 0, 6, True)]


def test_codes_are_balanced_and_near_for_near_vectors():
    x = clustered(3000, 64, 5).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    projection, cut = learn_rotation(x)
    bits = ((codes(x, projection, cut)[:, None] >> np.arange(64)) & 1).mean(0)
    assert np.abs(bits - 0.5).max() < 0.01
    y = x + np.random.default_rng(6).normal(size=x.shape) * 0.02
    apart = [int(a ^ b).bit_count() if (a ^ b) >= 0 else 64 - int(~(a ^ b)).bit_count() for a, b in zip(codes(x, projection, cut).tolist(), codes(y, projection, cut).tolist(), strict=True)]
    assert np.mean(apart) < 8


def offset_pairs(d: int) -> np.ndarray:
    """Vectors around a common direction and in one hot cluster, each with a partner at cosine just over 0.98."""
    rng = np.random.default_rng(d)
    x = rng.normal(size=(500, d))
    x[:250] += 2.0
    x[250:350] = x[250] + rng.normal(size=(100, d)) * 0.4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    return np.concatenate([x, 0.9801 * x + np.sqrt(1 - 0.9801**2) * off])


@pytest.mark.parametrize(("d", "asked"), [(64, 512), (64, 40), (10, 512)])
def test_no_link_is_lost_at_the_bound(spark, monkeypatch, d, asked):
    from outlay.llm import hamming_dedup

    monkeypatch.setattr(hamming_dedup, "ASKED", asked)
    monkeypatch.setattr(hamming_dedup, "BLOCK", 100)
    rows = [(i, v.astype(np.float32).tolist(), i % 500 // 400) for i, v in enumerate(offset_pairs(d))]
    assert sorted(map(tuple, dedup_embeddings(frame(spark, rows)).collect())) == plain_links(rows)


def plain_negatives(rows, every):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all():
            good[i, label, tuple(np.floor(256 * np.array(v, float)).astype(int).tolist())] = None
    good = [(i, label, list(q) + [0] * (64 - len(q))) for i, label, q in good]
    out = []
    for a, own, q in good:
        if a % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(q, r, strict=True)), i, label) for i, label, r in good if i != a)
            for p, positive, _ in [s for s in scored if s[2] == own][:5]:
                hard = [s for s in scored if s[2] != own and 80 * -p <= 100 * -s[0] <= 100 * -p][:5]
                out += [(a, positive, n, i, -p, -s) for n, (s, i, _) in enumerate(hard, 1)]
    return sorted(out)


@pytest.mark.parametrize(("block", "group"), [(8192, 2048), (150, 20)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, group):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "GROUP", group)
    monkeypatch.setattr(hard_negatives, "STEP", 3)
    x = clustered(900, 12, 4)
    labels = np.random.default_rng(1).integers(0, 4, 900).tolist()
    rows = [(i, v.tolist(), label) for i, (v, label) in enumerate(zip(x, labels, strict=True))]
    rows += [(1000 + i, rows[10][1], i % 3) for i in range(90)]  # ties
    rows += [(2000, None, 1), (2010, [float("nan")], 1), (2020, [None, 1.0], 1), (2030, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(2040, [], 1), (2050, [0.0] * 12, 1), (2060, [0.5], 2), (2070, [1e-30, float("inf")], 2), (10, rows[10][1], rows[10][2]), (20, rows[30][1], 0)]
    found = hard_negatives.mine_hard_negatives(frame(spark, rows), "vec_id % 10 = 0").collect()
    want = plain_negatives(rows, 10)
    assert sorted(map(tuple, found)) == want and len(want) > 1000


def test_hard_negatives_of_odd_tables(spark):
    def mined(rows):
        return sorted(map(tuple, hard_negatives.mine_hard_negatives(frame(spark, rows), "vec_id % 10 = 0").collect()))

    assert mined([]) == [] and mined([(10, [1.0], 1)]) == [] and mined([(11, [1.0], 1), (12, [1.0], 2)]) == []
    assert mined([(10, [1.0], 1), (11, [-1.0], 1), (12, [-0.9], 2)]) == []  # nothing fits below a negative score
    assert mined([(10, [0.0], 1), (11, [1.0], 1), (12, [3.0], 2)]) == [(10, 11, 1, 12, 0, 0)]
    big = mined([(10, [1e30, 1.0], 1), (11, [1e5], 1), (12, [9e4], 2)])
    assert big == [(10, 11, 1, 12, (1 << 25) * 25_600_000, (1 << 25) * 23_040_000)]


def test_score_bounds_hold():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.integers(-300, 300, (300, 9)), np.zeros((1, 9), int), rng.integers(-1, 2, (100, 9)), np.eye(9, dtype=int) * (1 << 25)])
    x = np.concatenate([x, x[:50], -x[:50], 2 * x[:50]])
    norm, angle = hard_negatives.angles(x, hard_negatives.fit_references(x.astype(float)))
    angle = angle.astype(np.float32)
    low, high = hard_negatives.score_bounds(angle, norm, angle, norm)
    exact = hard_negatives.whole_products(x, x)
    assert (low <= exact).all() and (exact <= high).all()
    assert (hard_negatives.whole_products(x * 64, x * 64) == (x * 64).astype(object) @ (x * 64).astype(object).T).all()
