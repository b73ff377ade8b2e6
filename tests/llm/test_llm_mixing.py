"""Mixing against plain targets, a plain mix of texts, and the SQL."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from outlay.llm.mixing import mix_sources, mixed_texts
from outlay.llm.queries import OP10_SQL

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, sid int, target int"


def size_of(text: str | None) -> int:
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def corpus(seed: int, sources: list[str | None], n: int = 400) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = sources[0] if rng.random() < 0.35 else rng.choice(sources)
        text = "".join(f"w{rng.randrange(99)}" + rng.choice([" ", "  ", "\n", " \t"]) for _ in range(rng.randrange(0, 600)))
        rows.append((i, text, "en", source, len(text), 1, 2, 3))
    rows += [(1000, None, "en", sources[0], None, 1, 2, 3), (1001, "", None, sources[-1], 0, 1, 2, 3), (1002, " \n", "x", "only blank", 2, 1, 2, 3)]
    rows += [rows[5], (None, rows[7][1], "fr", rows[7][3], 5, 1, 2, 3), (1003, "word " * 9000, "en", sources[1], 45_000, 1, 2, 3)]
    return rows


def targets(rows: list[tuple]) -> dict[str | None, float]:
    sizes: dict[str | None, int] = {}
    for row in rows:
        sizes[row[3]] = sizes.get(row[3], 0) + size_of(row[1])
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full: set[str | None] = set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        now = {s: 2.0 * sizes[s] if s in full else left * weight[s] / share for s in order}
        above = {s for s in order if s not in full and now[s] > 2 * sizes[s]}
        if not above:
            return now
        full |= above


@pytest.mark.parametrize("sources", [["b", "a", "c", None, "é", "B"], ["one", "two"]])
def test_targets_and_taken_words(spark, sources):
    rows = corpus(len(sources), sources)
    docs = spark.createDataFrame(rows, DOCS)
    out = mix_sources(docs).collect()
    assert out[0].__fields__ == ["doc_id", "size", "source_size", "target", "taken"] and len(out) == len(rows)
    want = targets(rows)
    by_id = {row[0]: row for row in rows}
    words = {s: sum(size_of(r[1]) for r in rows if r[3] == s) for s in want}
    taken = dict.fromkeys(want, 0)
    for r in out:
        text, source = by_id[r.doc_id][1], by_id[r.doc_id][3]
        assert r["size"] == size_of(text) and r.source_size == words[source] and r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(want[source])
        taken[source] += r.taken
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.05, abs=256)
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, map(tuple, out)))


def test_sql_says_the_same(spark, tmp_path):
    docs = spark.createDataFrame([r for r in corpus(5, ["x", "y", None, "z"]) if r[0] is not None], DOCS)
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = con.execute(OP10_SQL).fetchall()
    got = [tuple(r) for r in mix_sources(docs).collect()]
    assert sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in got) == sorted((a, b, c, round(d, 6), e) for a, b, c, d, e in want)


def test_mixed_texts_are_the_taken_words(spark):
    rows = [r[:5] for r in corpus(6, ["p", "q", "r"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixed_texts(docs).collect()
    assert out[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]
    taken: dict[int | None, int] = {}
    for r in mix_sources(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    seen: dict[int | None, int] = {}
    whole = {row[0]: row[1] for row in rows}
    for r in out:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + size_of(r.text)
        assert r.n_chars == len(r.text)
        words, place = whole[r.doc_id].split(), 0
        for word in r.text.split():  # in the order of the document
            place = words.index(word, place) + 1
    want = targets([(*r, 1, 2, 3) for r in rows])
    for s, t in want.items():
        assert sum(size_of(r.text) for r in out if r.source == s) == pytest.approx(t, rel=0.05, abs=256)
    # the order of a source's words differs between the two calls only by how rows are told apart
    assert sum(seen.values()) == pytest.approx(sum(taken.values()), rel=0.02)


def test_empty_and_wordless_tables(spark):
    none = spark.createDataFrame([], DOCS)
    assert mix_sources(none).collect() == [] and mixed_texts(none).collect() == []
    blank = spark.createDataFrame([(1, "", "x", "s", 0, 1, 2, 3), (2, None, "x", None, 0, 1, 2, 3)], DOCS)
    assert sorted(map(tuple, mix_sources(blank).collect())) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixed_texts(blank).collect() == []
