"""Secrets in texts: known forms, and strings of high entropy.

Besides three base patterns, candidate strings are scanned with a sliding window. Per class of
characters the window's Shannon entropy follows from counts that change by one character in and one
out. Runs of windows above the class's bound are spans, unless the allow-list knows the string.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from outlay.llm.common import text_slices, workers_find_package
from outlay.llm.spans import DDL, Span, covered, ordered, outside, span_lists

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "entropy")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

#: Characters of a window, and per class of characters the entropy in bits from which it tells.
WINDOW = 20
CLASSES = (("hex", re.compile(r"[0-9A-Fa-f]{20,}"), 2.8), ("base64", re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 3.75))
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")

_PIECE = r"(?:[a-z]{1,12}|[A-Z][a-z]{1,11}|[A-Za-z][a-z]{2,11}[0-9]{1,4}|[0-9]{1,12})"
#: Strings that look random and are no secrets: whole candidates that one of these matches.
ALLOWED = (
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9_=+/-]+",
    r"[A-Za-z][a-z]*([_/+=-]+[A-Za-z][a-z]*)*[_/+=-]*",
    rf"(?:{_PIECE}[_/=+-]++)+{_PIECE}?",  # words, numbered words, numbers and dates
    r"sha(?:1|256|384|512)-[A-Za-z0-9+/=]+",
    r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY",  # the sample key of manuals
)
#: What samples in manuals end in, with the characters of a key before it: cut out of a candidate like a base span, the rest is scanned.
_SAMPLE = re.compile(r"[A-Za-z0-9]{0,13}EXAMPLE(?:KEY)?")

_TERM = [0.0, *(c * math.log2(c) for c in range(1, WINDOW + 1))]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind; matches that are too short are dropped."""
    found: list[Span] = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    return found + [("hex", *m.span()) for m in _HEX.finditer(text)]


def entropy_runs(run: str, bound: float) -> Iterator[tuple[int, int]]:
    """Stretches of ``run`` covered by windows whose entropy reaches ``bound``.

    The entropy of a window of n characters is log2 n - (sum of c log2 c over its counts) / n.
    """
    counts: dict[str, int] = {}
    load, limit = 0.0, (math.log2(WINDOW) - bound) * WINDOW + 1e-9
    start = end = -1
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        load += _TERM[n + 1] - _TERM[n]
        counts[c] = n + 1
        if i >= WINDOW:
            old = run[i - WINDOW]
            n = counts[old]
            load += _TERM[n - 1] - _TERM[n]
            counts[old] = n - 1
        if i >= WINDOW - 1 and load <= limit:
            if end >= i + 1 - WINDOW and end >= 0:
                end = i + 1
            else:
                if end >= 0:
                    yield start, end
                start, end = i + 1 - WINDOW, i + 1
    if end >= 0:
        yield start, end


def _varied(run: str) -> bool:
    """Random strings mix digits with letters, or capitals with small letters in no order."""
    digits = sum(c.isdigit() for c in run)
    if 2 <= digits < len(run):
        return True
    turns = sum(a.islower() and b.isupper() for a, b in zip(run, run[1:], strict=False))
    return turns >= 4


def entropy_spans(text: str, known: list[Span], allowed: re.Pattern[str]) -> list[Span]:
    """Spans of high entropy outside of the ``known`` ones: what is left of a candidate there is scanned on its own."""
    found: list[tuple[int, int]] = []
    at = covered(known)
    for match in _CANDIDATE.finditer(text):
        word = match[0]
        if not _varied(word) or allowed.fullmatch(word):
            continue
        here = at
        if "EXAMPLE" in word:
            here = covered([*known, *(("", match.start() + m.start(), match.start() + m.end()) for m in _SAMPLE.finditer(word))])
        for start, end in outside(*match.span(), *here):
            rest = text[start:end]
            # a cut part begins or ends with the mark that joined it
            if rest != word and (not _varied(rest) or allowed.fullmatch(rest.strip("+/_=-"))):
                continue
            for _, letters, bound in CLASSES:
                for run in letters.finditer(rest):
                    if _varied(run[0]):
                        found += [(start + run.start() + a, start + run.start() + b) for a, b in entropy_runs(run[0], bound)]
    merged: list[list[int]] = []
    for a, b in sorted(found):
        # stretches on both sides of a known span never touch
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [("entropy", a, b) for a, b in merged]


def secret_spans(text: str, allowed: re.Pattern[str]) -> list[Span]:
    base = base_spans(text)
    return ordered(base + entropy_spans(text, base, allowed), KINDS)


def scan_secrets(docs: DataFrame, allow: Sequence[str] = ALLOWED) -> DataFrame:
    """``(doc_id, spans)`` per row of ``docs`` (``doc_id``, ``text``): ``(kind, start, end)`` by start, then kind.

    ``allow`` lists patterns of whole candidate strings that are no secrets; they never suppress base
    spans. Null and empty texts have no spans. Repeated rows come back as often; other columns are
    not read. Rows are scanned on their own, without a shuffle.
    """
    pattern = "|".join(f"(?:{a})" for a in allow) or r"(?!)"

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile(pattern)
        for batch in batches:
            for ids, texts in text_slices(batch.column(0), batch.column(1).fill_null("")):
                rows = [secret_spans(t, allowed) for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, span_lists(rows)], names=["doc_id", "spans"])

    workers_find_package(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(scanned, f"doc_id long, spans {DDL}")
