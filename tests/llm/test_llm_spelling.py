"""Spelling variants against all pairs of words, and the words as counted one by one."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from outlay.llm import spelling

DOCS = "doc_id long, text string, word string, n int, run string"


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts: dict[str, int]) -> list[tuple]:
    best, out = {}, []
    for word in counts:
        around = [w for w in counts if near(word, w)]
        first = min(around, key=lambda w: (-counts[w], w), default=None)
        best[word] = (first if first and counts[first] >= 2 * counts[word] else None, len(around))
    for word, n in counts.items():
        root = word
        while best[root][0]:
            root = best[root][0]
        form, around = best[word]
        out.append((word, form, root, n, around, counts[form] if form else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("levels", "few", "heavy"), [(48, 100_000, 200_000), (6, 100_000, 200_000), (48, 0, 20)])
def test_near_words_equal_all_pairs(spark, monkeypatch, levels, few, heavy):
    for name, value in (("LEVELS", levels), ("_FEW", few), ("_HEAVY", heavy)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(3)
    words = {"".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) for _ in range(300)}
    for _ in range(30 if levels == 6 else 0):
        word = list("abé" * 5)[: rng.randrange(5, 15)]
        word[rng.randrange(len(word))] = rng.choice("abé")
        words.add("".join(word))
    want = sorted((a, b) for a in words for b in words if near(a, b))
    found = spelling.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert sorted(map(tuple, found)) == want


def test_variants_of_documents(spark):
    rng = random.Random(5)
    stems = ["réception", "letters", "letter", "letterss", "summary", "summery", "aaaaa", "aaaaaa", "naïve÷x"]
    texts = [" ".join(rng.choice(stems) if rng.random() < 0.8 else rng.choice(stems)[1:] for _ in range(200)) for _ in range(40)]
    long = "qu" * 40_000
    rows = [*enumerate(texts), (100, None), (101, ""), (None, "LETTERS Letters9letters"), (102, f"{long} {long}a {long[:-1]}"), (3, texts[3]), (103, "12 34 — 漢字")]
    rows += [(104 + i, f"{long} {long}a {long}") for i in range(6)]
    docs = spark.createDataFrame([(i, t, "w", 1, "r") for i, t in rows], DOCS)
    counts: Counter[str] = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    known = {w: n for w, n in counts.items() if n >= 3}
    found = spelling.spelling_variants(spelling.with_slips(spelling.words_of(docs), 97)).collect()
    assert sorted(map(tuple, found), key=str) == plain_variants(known)
    assert long in known and long + "a" in known
    assert spelling.spelling_variants(spelling.with_slips(spelling.words_of(docs.where("false")), 97)).collect() == []


def test_forms_lead_to_the_last_one(spark):
    counts = {"aaaaa": 3, "aaaab": 6, "aaabb": 12, "aabbb": 24, "abbbb": 48, "bbbbb": 96, "zzzzz": 3, "zzzzy": 5, "ccccd": 6, "cccce": 6, "ccccc": 3}
    words = spark.createDataFrame([(w,) for w, n in counts.items() for _ in range(n)] + [(None,), ("",)], "word string")
    found = sorted(map(tuple, spelling.spelling_variants(words).collect()), key=str)
    assert found == plain_variants(counts)
    assert {r[0]: r[2] for r in found}["aaaaa"] == "bbbbb"
