"""SentencePiece encoding and decoding by suffix-array matching.

The distinct words of a batch are laid out as one text. A suffix array over it, as deep as the
longest piece, answers where a piece occurs: a binary search per piece, all pieces at once, gives
its range of suffixes. Every occurrence is an edge (position, length, piece); the edges are
sorted by position and then relaxed. The public model is a byte-pair vocabulary, so relaxing
follows its merge order: a word starts as single characters, and as long as an edge joins two
neighbours, the word's edge of best score, the leftmost of equals, replaces them. Characters
without a piece become byte pieces.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from outlay.llm.common import text_slices, workers_find_package

MODEL = "/opt/tokenizers/piece_bpe_32k.model"

_SPACE = "▁"
#: No piece has a space after another character or holds a line end, so texts fall apart here.
_WORD = re.compile(r" *[^ \n]+| +|\n")
#: Words that a task remembers with their ids, and characters up to which words are relaxed together.
_WORDS_KEPT = 200_000
#: Bytes of text encoded at a time; more of them share the search for pieces.
_SLICE = 2_000_000
_LONG = 96
_GAP, _OTHER = 1, 2


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores, the ids of byte pieces, and the ids that are neither."""

    pieces: list[str]
    scores: np.ndarray
    normal: np.ndarray
    byte_ids: np.ndarray

    @cached_property
    def ids(self) -> dict[str, int]:
        return {self.pieces[i]: i for i in self.normal.tolist()}

    @cached_property
    def alphabet(self) -> np.ndarray:
        """A small number per character: 0 before all, then the gap, unknown ones, and those of pieces."""
        known = sorted({ord(c) for i in self.normal.tolist() for c in self.pieces[i]})
        table = np.full(0x110000, _OTHER, np.uint16)
        table[known] = np.arange(3, 3 + len(known))
        return table

    @cached_property
    def depth(self) -> int:
        return max(len(self.pieces[i]) for i in self.normal.tolist())

    @cached_property
    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """Per piece its characters as numbers of the alphabet, padded with 0, and its length."""
        width = -(-self.depth // 8) * 8
        rows = np.zeros((len(self.normal), width), np.uint16)
        length = np.array([len(self.pieces[i]) for i in self.normal.tolist()])
        for row, i in enumerate(self.normal.tolist()):
            rows[row, : length[row]] = self.alphabet[[ord(c) for c in self.pieces[i]]]
        return rows, length

    @cached_property
    def surface(self) -> list[bytes]:
        """The bytes that decoding writes for each id."""
        out = [p.replace(_SPACE, " ").encode() for p in self.pieces]
        for i in set(range(len(self.pieces))) - set(self.normal.tolist()):
            out[i] = b""
        for value, i in enumerate(self.byte_ids.tolist()):
            out[i] = bytes([value])
        return out


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """The vocabulary of a byte-pair model with byte fallback, without other normalisation than spaces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    scores = np.array([model.get_score(i) for i in range(n)])
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
    byte_ids = np.array([model.piece_to_id(f"<0x{v:02X}>") for v in range(256)])
    normal = np.flatnonzero(~np.array(special))
    if any(_SPACE in pieces[i].lstrip(_SPACE) or "\n" in pieces[i] for i in normal.tolist()):
        raise ValueError("a piece reaches over the start of a word")
    return Vocabulary(pieces, scores, normal, byte_ids)


def _keys(rows: np.ndarray, bits: int) -> np.ndarray:
    """Characters of 8 or 16 bits packed to numbers, so that rows compare as they do character by character."""
    each = 64 // bits
    parts = rows.reshape(len(rows), -1, each)
    out = parts[:, :, 0].astype(np.uint64)
    for k in range(1, each):
        out = (out << np.uint64(bits)) | parts[:, :, k].astype(np.uint64)
    return out


def _sorted_order(keys: np.ndarray) -> np.ndarray:
    """Order of the rows: by the first number, and only rows that tie there by the others."""
    order = np.argsort(keys[:, 0])
    first = keys[order, 0]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = first[1:] == first[:-1]
    tied = np.flatnonzero(same[:-1] | same[1:])
    if len(tied) and keys.shape[1] > 1:
        rows = order[tied]
        order[tied] = rows[np.lexsort([*keys[rows, :0:-1].T, keys[rows, 0]])]
    return order


def _less(a: np.ndarray, b: np.ndarray, equal: bool) -> np.ndarray:
    """Row-wise ``a < b`` (or ``a <= b``) of multi-number keys."""
    out = np.full(len(a), equal)
    for k in range(a.shape[1] - 1, -1, -1):
        out = (a[:, k] < b[:, k]) | ((a[:, k] == b[:, k]) & out)
    return out


def _search(keys: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of every wanted key among the sorted keys, all in step."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
    while True:
        open_ = low < high
        if not open_.any():
            return low
        middle = (low + high) >> 1
        before = _less(keys[np.minimum(middle, len(keys) - 1)], wanted, right) & open_
        low = np.where(before, middle + 1, low)
        high = np.where(open_ & ~before, middle, high)


def edges(vocabulary: Vocabulary, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of pieces in ``text`` (numbers of the alphabet), sorted by position and length.

    Returns ``32 * position + length`` and the piece id of each.
    """
    pieces, length = vocabulary.spelled
    width, normal = pieces.shape[1], vocabulary.normal
    used = np.unique(text)
    bits = 8 if len(used) < 255 else 16
    if bits == 8:  # numbers of the characters in this text; pieces with others do not occur
        local = np.zeros(1 << 16, np.uint8)
        local[used] = np.arange(1, len(used) + 1)
        here = np.zeros(1 << 16, bool)
        here[used] = here[0] = True
        there = here[pieces].all(1)
        text, pieces, length, normal = local[text], local[pieces[there]], length[there], normal[there]
    high = np.where(np.arange(width) < length[:, None], pieces, (1 << bits) - 1).astype(pieces.dtype)
    padded = np.concatenate([text, np.zeros(width, text.dtype)])
    suffixes = _keys(np.lib.stride_tricks.sliding_window_view(padded, width)[: len(text)], bits)
    order = _sorted_order(suffixes)
    suffixes = suffixes[order]
    first, stop = _search(suffixes, _keys(pieces, bits), False), _search(suffixes, _keys(high, bits), True)
    many = stop - first
    piece = np.repeat(np.arange(len(many)), many)
    rank = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    code = order[rank] * 32 + length[piece]
    by_position = np.argsort(code)
    return code[by_position], normal[piece[by_position]]


def relax(vocabulary: Vocabulary, code: np.ndarray, piece: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols left of every word when no edge joins two neighbours: word, position, length; in order."""
    score = vocabulary.scores

    def joins(position: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Score of the edge over ``size`` characters, or -inf where there is none."""
        wanted = np.where(size < 32, position * 32 + size, -1)
        at = np.minimum(np.searchsorted(code, wanted), max(len(code) - 1, 0))
        if not len(code):
            return np.full(len(wanted), -np.inf)
        return np.where(code[at] == wanted, score[piece[at]], -np.inf)

    word = np.repeat(np.arange(len(lengths)), lengths)
    begin = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(starts, lengths)
    size = np.ones(len(word), np.int64)
    done = []
    pair = np.full(len(word), -np.inf)
    if len(word) > 1:
        same = word[1:] == word[:-1]
        pair[:-1] = np.where(same, joins(begin[:-1], size[:-1] + size[1:]), -np.inf)
    while len(word):
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.maximum.reduceat(pair, heads)
        span = np.diff(np.concatenate([heads, [len(word)]]))
        each = np.repeat(best, span)
        still = each > -np.inf
        if not still.all():
            out = ~still
            done.append((word[out], begin[out], size[out]))
            word, begin, size, pair, each = word[still], begin[still], size[still], pair[still], each[still]
            if not len(word):
                break
        hit = np.flatnonzero(pair == each)
        hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]  # the leftmost of each word
        size[hit] += size[hit + 1]
        keep = np.ones(len(word), bool)
        keep[hit + 1] = False
        hit = hit - np.arange(len(hit))  # one symbol went before each later hit
        word, begin, size, pair = word[keep], begin[keep], size[keep], pair[keep]
        changed = np.concatenate([hit, hit[hit > 0] - 1])
        follow = np.minimum(changed + 1, len(word) - 1)
        fits = (follow > changed) & (word[follow] == word[changed])
        pair[changed] = np.where(fits, joins(begin[changed], size[changed] + size[follow]), -np.inf)
    if not done:
        return word, begin, size
    word, begin, size = (np.concatenate(x) for x in zip(*done, strict=True))
    by_place = np.lexsort((begin, word))
    return word[by_place], begin[by_place], size[by_place]


def _relax_long(vocabulary: Vocabulary, word: str) -> list[str]:
    """The same for one long word, with a queue of its edges by score and place."""
    ids, scores = vocabulary.ids, vocabulary.scores
    part: list[str | None] = list(word)
    left, right = list(range(-1, len(part) - 1)), [*range(1, len(part)), -1]
    queue: list[tuple[float, int, str]] = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] >= 0:
            text = part[i] + part[right[i]]
            if len(text) <= vocabulary.depth and text in ids:
                heapq.heappush(queue, (-scores[ids[text]], i, text))

    for i in range(len(part) - 1):
        offer(i)
    while queue:
        _, i, text = heapq.heappop(queue)
        if part[i] is None or right[i] < 0 or part[i] + part[right[i]] != text:
            continue
        j = right[i]
        part[i], part[j] = text, None
        right[i] = right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    return [p for p in part if p is not None]


class Encoder:
    """Encodes texts; words met are remembered, up to a bound, with their ids."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.start, self.size = [], np.empty(0, np.int64), np.empty(0, np.int64)
        self.filled = 0

    def _ids_of(self, symbol: str) -> list[int]:
        found = self.vocabulary.ids.get(symbol)
        return [found] if found is not None else self.vocabulary.byte_ids[list(symbol.encode("utf-8", "replace"))].tolist()

    def _learn(self, words: list[str]) -> None:
        """Add words, with spaces as in the text, to those remembered: their ids go to the end of ``flat``."""
        vocabulary = self.vocabulary
        short = [w for w in words if len(w) <= _LONG]
        found = {w: np.array([i for p in _relax_long(vocabulary, w.replace(" ", _SPACE)) for i in self._ids_of(p)]) for w in words if len(w) > _LONG}
        if short:
            text = "\x00".join(short).replace(" ", _SPACE)
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            lengths = np.array([len(w) for w in short])
            starts = np.cumsum(lengths + 1) - lengths - 1
            numbers = vocabulary.alphabet[points]
            numbers[starts[1:] - 1] = _GAP
            code, piece = edges(vocabulary, numbers)
            word, begin, size = relax(vocabulary, code, piece, starts, lengths)
            at = np.minimum(np.searchsorted(code, begin * 32 + size), max(len(code) - 1, 0))
            known = code[at] == begin * 32 + size if len(code) else np.zeros(len(begin), bool)
            one = np.where(known, piece[at] if len(code) else 0, -1)
            count = np.where(known, 1, 0)
            spelled = {}
            for k in np.flatnonzero(~known).tolist():
                spelled[k] = self._ids_of(text[begin[k]])
                count[k] = len(spelled[k])
            flat = np.repeat(one, count)
            first = np.cumsum(count) - count
            for k, ids in spelled.items():
                flat[first[k] : first[k] + len(ids)] = ids
            sizes = np.bincount(word, count, len(short)).astype(np.int64)
            ends = np.cumsum(sizes)
        else:
            flat, sizes, ends = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        long = list(found)
        for w in [*short, *long]:
            self.number[w] = len(self.number)
        all_sizes = np.concatenate([sizes, np.array([len(found[w]) for w in long], np.int64)])
        self.flat.append(np.concatenate([flat, *[found[w] for w in long]]).astype(np.int32))
        self.start = np.concatenate([self.start, self.filled + np.cumsum(all_sizes) - all_sizes])
        self.size = np.concatenate([self.size, all_sizes])
        self.filled += int(all_sizes.sum())

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        if len(self.number) > _WORDS_KEPT:
            self._forget()
        words = [_WORD.findall(" " + t.replace(_SPACE, " ")) if t else [] for t in texts]
        met = set().union(*words) if words else set()
        new = list(met.difference(self.number))
        if new:
            self._learn(new)
        flat = np.concatenate(self.flat) if self.flat else np.empty(0, np.int32)
        self.flat = [flat]
        counts = np.array([len(w) for w in words], np.int64)
        number = np.fromiter(map(self.number.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum()))
        size = self.size[number]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[number], size)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return flat[place], np.diff(ends)


_encoders: dict[str, Encoder] = {}


def encoder_of(key: str, vocabulary: Vocabulary) -> Encoder:
    """The encoder of a vocabulary that the tasks of one worker process share, one after the other."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def decode(vocabulary: Vocabulary, ids: list[int]) -> str:
    """The text of ids: pieces with spaces, bytes put together, without the space that encoding puts first."""
    return b"".join(map(vocabulary.surface.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, ids)`` per row of ``docs`` (``doc_id``, ``text``).

    The model's file is read where the job is planned and need not exist on executors. Null and empty
    texts have no ids. Repeated rows come back as often; other columns are not read. Rows are encoded
    on their own, without a shuffle.
    """
    vocabulary = read_vocabulary(model)
    workers_find_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the pieces of one model

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model, shared.value)
        for batch in batches:
            for ids, texts in text_slices(batch.column(0), batch.column(1).fill_null(""), _SLICE):
                flat, counts = encoder.encode(texts.to_pylist())
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(encoded, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, text)`` per row of ``encoded`` (``doc_id``, ``ids``); null ids give a null text."""
    workers_find_package(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                texts = [None if ids is None else decode(vocabulary, ids) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """``(doc_id, n_ids, ids_sha256, same)`` per row: the number of ids, the sha256 of the ids as
    little-endian 32-bit numbers, and whether decoding them gives the text back, with null as empty
    and the model's space sign read as a space."""
    workers_find_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        vocabulary = shared.value
        encoder = encoder_of(model, vocabulary)
        for batch in batches:
            for ids, texts in text_slices(batch.column(0), batch.column(1).fill_null(""), _SLICE):
                texts = texts.to_pylist()
                flat, counts = encoder.encode(texts)
                parts = np.split(flat, np.cumsum(counts)[:-1])
                same = [decode(vocabulary, p.tolist()) == t.replace(_SPACE, " ") for p, t in zip(parts, texts, strict=True)]
                digest = [hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts]
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts), pa.array(digest), pa.array(same)], names=["doc_id", "n_ids", "ids_sha256", "same"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(passed, "doc_id long, n_ids long, ids_sha256 string, same boolean")
