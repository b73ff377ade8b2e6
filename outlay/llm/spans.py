"""Spans in texts: base patterns' digests and Arrow columns, in code points with the end exclusive."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, functions as F

Span = tuple[str, int, int]

TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
DDL = "array<struct<kind: string, start: long, end: long>>"


def ordered(spans: list[Span], kinds: tuple[str, ...]) -> list[Span]:
    """By start, then by the order of ``kinds``, then by end."""
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def span_lists(rows: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in rows], TYPE)


def covered(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover together, in order."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def outside(a: int, b: int, starts: list[int], ends: list[int]) -> Iterator[tuple[int, int]]:
    """The parts of ``a`` to ``b`` outside of the ``covered`` stretches."""
    i = bisect_right(ends, a)
    while i < len(starts) and starts[i] < b:
        if a < starts[i]:
            yield a, starts[i]
        a = ends[i]
        i += 1
    if a < b:
        yield a, b


def joined(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: str, kinds: tuple[str, ...]) -> dict[str, Column]:
    """Counts of the base kinds, the sha256 of the base spans, and all spans as one string."""
    base = F.filter(spans, lambda s: s["kind"].isin(*kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return {f"n_{k}": count(k) for k in kinds} | {"base_sha256": F.sha2(joined(base), 256), "spans": joined(F.col(spans))}
