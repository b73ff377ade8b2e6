"""Piece encoding against the sentencepiece library, and exact round trips."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import pytest

from outlay.llm.pieces import MODEL, Encoder, decode, decode_pieces, edges, encode_pieces, read_vocabulary, round_trip

pytestmark = pytest.mark.skipif(not os.path.exists(MODEL), reason="no public tokenizers")

ODD = [
    "", " ", "  a  b ", "a\nb", "a\tb", " \n x", "ﬁ①Å é", "　y", "<s>hello</s>", "日本𝄞", "a" * 400, "\x00b", "x\x00y z", "   ", "\n\n",
    "a" * 97 + " b", " " * 50 + "x", "é" * 200, "thththth", "The quick brown fox.\r\nJumps  over", "emoji 👩‍👩‍👧 ok", "1234567890 3.14", "ab" * 60 + "\n" + "cd" * 70,
]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(n: int) -> list[str]:
    rng = random.Random(4)
    letters = "etaoinshrdlu ETAOIN  \n\téèñß.,!0189日本𝄞\x01▁"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(200))) for _ in range(n)]


def test_ids_equal_the_library(library):
    vocabulary = read_vocabulary()
    encoder = Encoder(vocabulary)
    for batch in (ODD, random_texts(300), ODD[::-1], ["▁x", "a▁b"]):
        flat, counts = encoder.encode(batch)
        for text, ids in zip(batch, np.split(flat, np.cumsum(counts)[:-1]), strict=True):
            assert ids.tolist() == library.encode(text), repr(text)
            assert decode(vocabulary, ids.tolist()) == library.decode(ids.tolist()) == text.replace("▁", " ")


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr("outlay.llm.pieces._WORDS_KEPT", 20)
    encoder = Encoder(read_vocabulary())
    for text in random_texts(40):
        assert encoder.encode([text])[0].tolist() == library.encode(text)


def test_edges_are_all_occurrences():
    vocabulary = read_vocabulary()
    text = "▁the▁them▁thththe"
    code, piece = edges(vocabulary, vocabulary.alphabet[[ord(c) for c in text]])
    found = {(int(c) // 32, int(c) % 32, vocabulary.pieces[p]) for c, p in zip(code, piece, strict=True)}
    pieces = {vocabulary.pieces[i] for i in vocabulary.normal.tolist()}
    want = {(a, b - a, text[a:b]) for a in range(len(text)) for b in range(a + 1, min(a + 17, len(text) + 1)) if text[a:b] in pieces}
    assert found == want and (np.diff(code) >= 0).all()


def test_tables(spark, library):
    rows = [(i, t, "x", 1) for i, t in enumerate([*ODD, None])] + [(0, ODD[3], "y", 2), (None, "null id", "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_ids int")
    encoded = encode_pieces(docs)
    texts = {str((r.doc_id, r.ids)) for r in encoded.collect()}
    assert texts == {str((i, library.encode(t or ""))) for i, t, _, _ in rows}
    back = decode_pieces(encoded).collect()
    assert sorted(map(str, map(tuple, back))) == sorted(str((i, t or "")) for i, t, _, _ in rows)
    for r in round_trip(docs).collect():
        options = [library.encode(t or "") for i, t, _, _ in rows if i == r.doc_id]
        assert r.same and r.ids_sha256 in {hashlib.sha256(np.array(o, "<u4").tobytes()).hexdigest() for o in options}
    assert decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text is None
    assert round_trip(docs.where("false")).collect() == []
