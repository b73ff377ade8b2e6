"""Toxic spans by a conditional random field, added up to a score per document.

Labels are per document, so tokens are labelled first: the fewest words and word beginnings that cover
the toxic training documents and are all but absent from the others mark their tokens. A
two-state chain learns from these tokens by hashed features of the word. Over a whole text,
forward-backward gives each token the probability of being toxic; the probabilities that count add up
to the document's score, and runs of likely tokens are the offending offsets.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from outlay.llm.common import Scratch, text_slices
from outlay.llm.crf import Chain, hashed, train
from outlay.llm.quality import fold, label_per_document

#: Labelled documents that the model is fitted on, with the label and without, and the characters of each that it reads.
TOXIC_DOCS, CLEAN_DOCS, TRAIN_CHARS = 1000, 2400, 20_000
#: Most words of a sentence that is chosen to learn from.
_WORDS_CHOSEN = 200
_ROUNDS, _PENALTY = 45, 0.05
#: A key in so large a share of the toxic texts, and in no clean one, marks whether it is needed or not.
_PLAIN_SHARE = 0.08
#: Token probabilities below do not add to a document.
_FLOOR = 0.02
_WORDS_KEPT = 400_000
_SLICE = 4_000_000
_TOKEN = re.compile(r"\S+")


def core(token: str) -> str:
    return token.lower().strip(".,;:!?\"'()[]{}|*#%$&")


def token_features(token: str) -> list[str]:
    word = core(token)
    return ["b", f"w{word}", *[f"p{word[:n]}" for n in range(3, 7) if len(word) >= n], *[f"g{word[i : i + 4]}" for i in range(len(word) - 3)]]


def sentences_chosen(text: str, most: int) -> str:
    """The text, or, if it has more than ``most`` characters, sentences chosen by hash that have about as many, in order."""
    if len(text) <= most:
        return text
    parts: list[list[str]] = [[]]
    for token in _TOKEN.finditer(text):
        parts[-1].append(token[0])
        if token[0][-1] in ".!?" or len(parts[-1]) == _WORDS_CHOSEN:
            parts.append([])
    sentences = [" ".join(p) for p in parts if p]
    order = sorted(range(len(sentences)), key=lambda i: zlib.crc32(f"{i} {sentences[i]}".encode("utf-8", "surrogatepass")))
    chosen, room = [], most
    for i in order:
        if len(sentences[i]) <= room:
            chosen.append(i)
            room -= len(sentences[i]) + 1
    return " ".join(sentences[i] for i in sorted(chosen))


def _keys(text: str) -> set[str]:
    """What may mark a token: the whole word or how it begins."""
    out = set()
    for word in {core(t) for t in text.split()}:
        if word:
            out.add(f"={word}")
            out.update(f"^{word[:n]}" for n in range(4, 7) if len(word) >= n)
    return out


def _print(text: str) -> int:
    """Near copies mostly share it: the least hash of three words in a row."""
    words = text.split()
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(len(words) - 2, 1))), default=0)


def find_markers(toxic: list[str], clean: list[str]) -> set[str]:
    """Keys that cover the toxic texts: each time the key of most texts not yet covered.

    Copies count once. A key must be thirty times as frequent as in the clean texts.
    """
    texts = {_print(t): t for t in toxic}
    holders: dict[str, set[int]] = defaultdict(set)
    for p, text in texts.items():
        for key in _keys(text):
            holders[key].add(p)
    common: dict[str, set[int]] = defaultdict(set)
    for text in clean:
        p = _print(text)
        for key in _keys(text):
            if key in holders:
                common[key].add(p)
    least = max(3, int(0.004 * len(texts)))
    others = max(len({_print(t) for t in clean}), 1)
    good = {
        key: held
        for key, held in holders.items()
        if len(held) >= least and len(held) / len(texts) >= 30 * (len(common[key]) + 0.3) / others
    }
    if not good:  # few texts: what no clean text has
        good = {key: held for key, held in holders.items() if len(held) >= 2 and not common[key]}
    markers = {key for key, held in good.items() if key[0] == "=" and len(held) >= _PLAIN_SHARE * len(texts) and not common[key]}
    left = set(texts) - set().union(*(good[key] for key in markers))
    while left and good:
        key = max(good, key=lambda k: (len(good[k] & left), k[0] == "=", len(k), k))
        gain = good.pop(key) & left
        if len(gain) < max(2, least // 2):
            break
        markers.add(key)
        left -= gain
    return markers


def is_marked(token: str, markers: set[str]) -> bool:
    word = core(token)
    return f"={word}" in markers or any(f"^{word[:n]}" in markers for n in range(4, 7))


def sentence_ends(tokens: list[str]) -> np.ndarray:
    return np.array([t[-1] in ".!?" for t in tokens], bool)


def cut(ends: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Lengths of the sequences: a sequence ends with a sentence or a text."""
    stops = np.flatnonzero(ends | last) + 1
    return np.diff(np.concatenate([[0], stops]))


@dataclass(frozen=True)
class ToxicModel:
    """Emission weight of the toxic state per feature, the chain, and the document curve (slope, offset)."""

    weights: np.ndarray
    chain: Chain
    slope: float = 1.0
    offset: float = 0.0


class _Words(dict):
    """Number of each word met, with its emission odds and whether it ends a sentence."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights, self.odds, self.ends = weights, [], []

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self.odds)
        # beyond such weights a chance is 0 or 1 in any sum of doubles
        self.odds.append(math.exp(min(max(float(self.weights[hashed(token_features(token))].sum()), -80.0), 80.0)))
        self.ends.append(token[-1] in ".!?")
        return number


def token_chances(model: ToxicModel, texts: list[str], words: _Words) -> list[np.ndarray]:
    """Per text the probability of each of its tokens to be toxic."""
    tokens = [t.split() for t in texts]
    sizes = np.array([len(t) for t in tokens], np.int64)
    total = int(sizes.sum())
    if not total:
        return [np.empty(0) for _ in texts]
    number = np.fromiter((n for t in tokens for n in map(words.__getitem__, t)), np.int64, total)
    last = np.zeros(total, bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    chance = model.chain.second_state(np.array(words.odds)[number], cut(np.array(words.ends)[number], last))
    return np.split(chance, np.cumsum(sizes)[:-1])


def evidence(chances: list[np.ndarray]) -> np.ndarray:
    """Log odds that some token is toxic, from the tokens above the floor; else from the likeliest."""
    out = []
    for p in chances:
        high = p[p >= _FLOOR]
        any_ = 1 - np.prod(1 - high) if len(high) else p.max(initial=0)
        any_ = min(max(any_, 1e-6), 1 - 1e-6)
        out.append(np.log(any_ / (1 - any_)))
    return np.array(out)


def _sentences(texts: list[str], markers: set[str]) -> Iterator[tuple[list[str], list[bool]]]:
    """Token sequences as they are decoded, with the marked tokens."""
    for text in texts:
        tokens = text.split()
        if tokens:
            last = np.zeros(len(tokens), bool)
            last[-1] = True
            where = 0
            for n in cut(sentence_ends(tokens), last).tolist():
                part = tokens[where : where + n]
                yield part, [is_marked(t, markers) for t in part] if markers else [False] * n
                where += n


def _fit_chain(sentences: list[tuple[list[str], list[bool]]]) -> ToxicModel:
    kinds: dict[str, int] = {}
    number = np.array([kinds.setdefault(t, len(kinds)) for tokens, _ in sentences for t in tokens])
    state = np.array([s for _, marks in sentences for s in marks], np.int64)
    lengths = np.array([len(tokens) for tokens, _ in sentences])
    features = [hashed(token_features(t)) for t in kinds]
    weights, chain = train(features, number, state, lengths, 2, _ROUNDS, _PENALTY)
    return ToxicModel(weights[:, 1] - weights[:, 0], chain)  # only differences between the states count


def fit_toxicity(toxic: list[str], clean: list[str]) -> ToxicModel | None:
    markers = find_markers(toxic, clean)
    if not markers:
        return None
    sentences = list(_sentences(toxic, markers)) + list(_sentences(clean, set()))
    # sentences without a marked token say little; some are enough, and those that mislead a first model
    first = [s for i, s in enumerate(sentences) if any(s[1]) or i % 24 == 0]
    model = _fit_chain(first)
    words = _Words(model.weights)
    misled = [s for s, p in zip(sentences, token_chances(model, [" ".join(t) for t, _ in sentences], words), strict=True) if not any(s[1]) and p.max() > 0.02]
    if misled:
        model = _fit_chain(first + misled)
    words = _Words(model.weights)
    x = np.concatenate([evidence(token_chances(model, t, words)) for t in (toxic, clean)])
    y = np.concatenate([np.ones(len(toxic)), np.zeros(len(clean))])
    weight = np.where(y == 1, 1 / max(len(toxic), 1), 1 / max(len(clean), 1))
    slope, offset = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic curve with a small penalty
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        g = np.array([(weight * (y - p) * x).sum() - 0.02 * (slope - 1), (weight * (y - p)).sum() - 0.02 * offset])
        h = weight * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 0.02, (h * x).sum()], [(h * x).sum(), h.sum() + 0.02]])
        step = np.linalg.solve(hess, g)
        slope, offset = slope + step[0], offset + step[1]
    return ToxicModel(model.weights, model.chain, max(float(slope), 0.05), float(offset))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS, train_chars: int = TRAIN_CHARS
) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)`` per row of ``docs`` (``doc_id``, ``text``).

    ``labels`` (``doc_id``, ``toxic``) teaches through rows outside of fold 0: about ``toxic_docs`` with the label and
    ``clean_docs`` without, chosen by hash, and of longer texts than ``train_chars`` sentences of that length in total, chosen by hash.
    Repeated labels count once, documents with both labels not at all. Scores read whole texts.
    ``spans`` joins ``start:end`` of runs of tokens that are more likely toxic than not. Null and
    empty texts have no token and score as the least evidence does. Without both labels, or without
    anything that tells them apart, all scores are 0. Repeated rows come back as often; a row without
    ``doc_id`` is not held out. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = scratch.write(label_per_document(labels, "toxic").where(fold("doc_id") != 0))
    seen = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    rate = F.when(F.col("y") == 1, min(1.0, toxic_docs / max(seen.get(1, 0), 1))).otherwise(min(1.0, clean_docs / max(seen.get(0, 0), 1)))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < rate * (1 << 30))

    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([None if t is None else sentences_chosen(t, train_chars) for t in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2)], names=["doc_id", "text", "y"])

    # at most about toxic_docs + clean_docs ids, each with train_chars of text
    taught = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y").mapInArrow(shortened, "doc_id long, text string, y int")
    taught = taught.where("text is not null").orderBy("doc_id", "text").toArrow()
    pairs = list(zip(taught["text"].to_pylist(), taught["y"].to_pylist(), strict=True))
    model = fit_toxicity([t for t, y in pairs if y == 1], [t for t, y in pairs if y == 0])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None if model is None else _Words(model.weights)
        for batch in batches:
            for ids, texts in text_slices(batch.column(0), batch.column(1).fill_null(""), _SLICE):
                texts = texts.to_pylist()
                score, spans = np.zeros(len(texts)), [""] * len(texts)
                if model is not None:
                    if len(words) > _WORDS_KEPT:
                        words = _Words(model.weights)
                    chances = token_chances(model, texts, words)
                    score = 1 / (1 + np.exp(-np.clip(model.slope * evidence(chances) + model.offset, -30, 30)))
                    for i, p in enumerate(chances):
                        if len(p) and p.max() >= 0.5:
                            spans[i] = ",".join(f"{a}:{b}" for a, b in _offsets(texts[i], p >= 0.5))
                yield pa.RecordBatch.from_arrays([ids, pa.array(score), pa.array(spans)], names=["doc_id", "score", "spans"])

    out = docs.mapInArrow(scored, "doc_id long, score double, spans string")
    held = F.coalesce(fold("doc_id") == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


def _offsets(text: str, hit: np.ndarray) -> Iterator[tuple[int, int]]:
    """Code-point spans of runs of tokens that are hit."""
    start = end = None
    for match, h in zip(_TOKEN.finditer(text), hit.tolist(), strict=True):
        if h:
            start, end = match.start() if start is None else start, match.end()
        elif start is not None:
            yield start, end
            start = None
    if start is not None:
        yield start, end
