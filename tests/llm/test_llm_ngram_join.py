"""The n-gram join against a plain comparison of all pairs."""

from __future__ import annotations

import random
import re

import pyarrow as pa
import pytest

from outlay.llm.common import components
from outlay.llm.ngram_join import ngram_jaccard_join
from outlay.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, cid string, n string, shingle string, component_id string"


def shingles(text: str | None) -> set[tuple[str, ...]]:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def plain(docs: list[tuple[int | None, str | None]]) -> list[tuple[int | None, int, int | None]]:
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))]


def got(spark, docs):
    rows = [(d, t, "x", "y", "z", "w") for d, t in docs]
    out = ngram_jaccard_join(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return out.collect()


def key(row):
    return tuple((v is None, v) for v in row)


def words(rng: random.Random, n: int, vocabulary: int = 500) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near(rng: random.Random, base: list[str], edits: int) -> list[str]:
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def corpus(seed: int) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    docs: list[list[str]] = []
    passage = words(rng, 40)
    for _ in range(12):
        base = words(rng, rng.randrange(6, 160))
        docs.append(base)
        docs += [near(rng, base, rng.randrange(0, 4)) for _ in range(rng.randrange(0, 6))]
    docs += [words(rng, rng.randrange(1, 30)) + passage + words(rng, rng.randrange(1, 30)) for _ in range(15)]
    chain = words(rng, 100)
    for _ in range(12):  # neighbours are near, the ends are not
        chain = [*chain[4:], *words(rng, 4)]
        docs.append(chain)
    texts: list[str | None] = [" ".join(d) for d in docs]
    texts += ["", None, "   \n\t ", "One two", "one TWO", "one two three four", "a b c d e", "A b\tc\nd  e", "ÄB c d e f", "äb c d e f"]
    texts += [texts[3], texts[3], " ".join(words(rng, 30_000, 10**6))]
    rng.shuffle(texts)
    return [(i * 7 % 1000, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_those_of_all_pairs(spark, seed):
    docs = corpus(seed)
    assert sorted(map(tuple, got(spark, docs))) == sorted(plain(docs))


def test_large_group_of_near_copies_in_one_component(spark):
    rng = random.Random(3)
    base = words(rng, 200)
    docs = [(i, " ".join(near(rng, base, i % 7))) for i in range(150)]
    assert sorted(map(tuple, got(spark, docs))) == sorted(plain(docs))


def test_repeated_rows_and_rows_without_id(spark):
    docs = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f"), (None, "x y z"), (None, None), (7, None)]
    want = [(5, 2, 5), (5, 2, 5), (None, 2, 5), (9, 2, 5), (None, 1, None), (None, 0, None), (7, 0, 7)]
    assert sorted(map(key, got(spark, docs))) == sorted(map(key, want))


def test_empty_table(spark):
    assert got(spark, []) == []


def test_shingle_sets_count_like_words():
    texts = ["", None, "a", "A a a a a a a", "é É é É é É", "x" * 100_000 + " b c d e f", "a\x0bb\x0cc\x1cd e f g"]
    assert [len(s) for s in shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]
    one, two = shingle_sets(pa.array(["The QUICK brown fox jumps", "the quick brown fox jumps"]))
    assert one.tolist() == two.tolist()


def test_components_of_a_long_path_and_of_strings(spark):
    path = [(i, i + 1) for i in range(200)] + [(500, 501), (502, 501), (9, 9), (700, 700)]
    random.Random(1).shuffle(path)
    found = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500}
    names = components(spark.createDataFrame([("b", "c"), ("c", "a")], "a string, b string"))
    assert {tuple(r) for r in names.collect()} == {("a", "a"), ("b", "a"), ("c", "a")}
