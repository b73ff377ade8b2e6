"""Chat formatting: conversations through a compiled template, with the ranges that a model is to learn.

Rows of a conversation are shuffled to one task and rendered as they come, sorted, in pieces of bounded
size. A conversation of very many rows is first cut into stretches of its order, which are rendered by
different tasks; a template sees the place of each turn in the whole conversation. The pieces of a conversation,
in order, are its output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from outlay.llm.common import workers_find_package
from outlay.llm.templates import Stretch, compile_chat, unescaped
from outlay.operators.skew import with_block
from outlay.session import materialize

#: What begins a turn, ends its role, and ends its text; texts hold them with a backslash before.
START, COLON, END = "###", ": ", "</turn>"
CONTROL = (START, END)
TEMPLATE = (
    "{% for turn in turns %}### {{ turn.role | escape(': ') }}: {% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}"
    "{% endgeneration %}{% else %}{{ turn.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
#: Characters of a conversation above which it is cut, and about how many a stretch has.
STRETCH_CHARS = 1_000_000
#: Characters and turns of a piece; a turn is never cut.
PIECE_CHARS, PIECE_TURNS = 500_000, 2_000
_ORDER = ("turn", "role", "text")
PIECE = "conv_id long, stretch long, piece long, n_turns long, formatted string, learned array<struct<start: long, end: long>>"
_LEARNED = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _clean(conversations: DataFrame) -> DataFrame:
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *texts)


def _in_stretches(conversations: DataFrame, stretch_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows with their ``stretch``, the number of rows ``before`` it and whether there are ``more`` after it: of ordinary
    conversations, and of long ones (None where there are none)."""
    rows = _clean(conversations)
    sizes = rows.groupBy("conv_id").agg(F.sum(F.length("text") + F.length("role") + 1).alias("chars"))
    long = materialize(sizes.where(F.col("chars") > stretch_chars).select(F.col("conv_id").alias("id"), "chars"), "long-conversations")
    facts = long.agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).first()
    as_one = ("conv_id", "0L as stretch", "turn", "role", "text", "0L as before", "false as more")
    if not facts.n:
        return rows.selectExpr(*as_one), None
    # there is at most one long conversation per stretch_chars of text; beyond a counted number the planner joins them
    few = F.broadcast if facts.n <= 100_000 else (lambda df: df)
    same = F.col("conv_id").eqNullSafe(F.col("id"))
    plain = rows.join(few(long.select("id")), same, "left_anti").selectExpr(*as_one)
    order = F.struct("conv_id", "turn", "role", F.md5("text"), F.monotonically_increasing_id())
    ordered = rows.join(few(long.select("id")), same, "left_semi").withColumn("_order", order)
    cut = with_block(ordered, "_order", max(-(-facts.chars // stretch_chars), 2)).withColumnRenamed("_block", "stretch")
    # a row per conversation and stretch that share rows
    counts = materialize(cut.groupBy("conv_id", "stretch").agg(F.count("*").alias("n")), "conversation-stretches")
    own = W.partitionBy("conv_id").orderBy("stretch")
    ahead = counts.select(
        F.col("conv_id").alias("id"), F.col("stretch").alias("s"), F.coalesce(F.sum("n").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.lead("n").over(own).isNotNull().alias("more"),
    )
    placed = cut.join(few(ahead), same & (F.col("stretch") == F.col("s")))
    return plain, placed.selectExpr("conv_id", "cast(stretch as long) as stretch", "turn", "role", "text", "before", "more")


def _rendered(batches: Iterator[pa.RecordBatch], render: Callable[[Stretch], Any]) -> Iterator[pa.RecordBatch]:
    """Pieces of rows that come sorted by conversation, stretch and turn."""
    key, turns, chars, held, piece, before, more = None, [], 0, 0, 0, 0, False
    made: list[tuple] = []

    def finish(ends: bool) -> None:
        nonlocal turns, chars, piece, before
        out = render(Stretch(turns, before, ends))
        made.append((*key, piece, len(turns), out.text(), [{"start": a, "end": b} for a, b in out.spans]))
        before, piece, turns, chars = before + len(turns), piece + 1, [], 0

    def batch() -> pa.RecordBatch:
        kinds = (*[pa.int64()] * 4, pa.string(), _LEARNED)
        arrays = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
        made.clear()
        return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "stretch", "piece", "n_turns", "formatted", "learned"])

    for rows in batches:
        conv, stretch, ahead, after = (rows.column(c).to_pylist() for c in ("conv_id", "stretch", "before", "more"))
        roles, texts = rows.column("role"), rows.column("text")
        for i in range(len(rows)):
            here = conv[i], stretch[i]
            if here != key:
                if turns:
                    finish(not more)
                key, piece, before, more = here, 0, ahead[i], after[i]
            elif chars >= PIECE_CHARS or len(turns) >= PIECE_TURNS:
                finish(False)
            turns.append({"role": roles[i].as_py(), "text": texts[i].as_py()})
            chars += len(turns[-1]["text"]) + len(turns[-1]["role"])
            held += len(turns[-1]["text"])
            if held >= 4 * PIECE_CHARS and made:
                yield batch()
                held = 0
    if turns:
        finish(not more)
    if made:
        yield batch()


def _pieces(rows: DataFrame, template: str, control: tuple[str, ...], known: dict[str, Any]) -> DataFrame:
    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rendered(batches, compile_chat(template, control, known))

    together = rows.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", *_ORDER)
    return together.mapInArrow(rendered, PIECE)


def format_chats(
    conversations: DataFrame,
    template: str = TEMPLATE,
    control: tuple[str, ...] = CONTROL,
    known: dict[str, Any] | None = None,
    stretch_chars: int = STRETCH_CHARS,
) -> tuple[DataFrame, DataFrame | None]:
    """Formatted conversations as pieces ``(conv_id, stretch, piece, n_turns, formatted, learned)``.

    ``conversations`` has ``conv_id``, ``turn``, ``role`` and ``text``. The first table holds the ordinary conversations, the
    second one those of more than ``stretch_chars`` characters, if there are any; ordered by stretch and piece the texts of a
    conversation follow each other. ``learned`` are the ranges of ``formatted`` inside of the template's generation tags, in
    code points, the end exclusive. ``known`` names are constants of the template (see ``templates``).

    Turns come by ``turn``, null first, ties by role, then text; repeated rows are turns of their own. Null roles and texts
    are empty. Rows without ``conv_id`` are one conversation. Empty tables have none. Other columns are not read.
    """
    compile_chat(template, control, known)  # errors come here, not from a worker
    workers_find_package(conversations.sparkSession)
    plain, long = _in_stretches(conversations, stretch_chars)
    known = dict(known or {})
    return _pieces(plain, template, control, known), None if long is None else _pieces(long, template, control, known)


_TURN = re.compile(r"### ((?:[^\\:]|\\.|:(?! ))*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from what ``TEMPLATE`` made of whole turns."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at character {at}")
        turns.append((unescaped(m[1]), unescaped(m[2])))
        at = m.end()
    return turns


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per conversation of pieces that come in order; nothing but digests is kept of a piece."""
    key, started, out = None, False, []

    def row() -> tuple:
        return key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for rows in batches:
        for conv, formatted, learned in zip(*(rows.column(c) for c in ("conv_id", "formatted", "learned")), strict=True):
            conv, formatted, learned = conv.as_py(), formatted.as_py(), learned.as_py()
            if not started or conv != key:
                if started:
                    out.append(row())
                key, started, n, loss_chars, chars = conv, True, 0, 0, 0
                turns, loss = hashlib.sha256(), hashlib.sha256()
            for role, text in read_turns(formatted):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            for span in learned:
                text = unescaped(formatted[span["start"] : span["end"]])
                loss_chars += len(text)
                loss.update(text.encode())
            chars += len(formatted)
        if out:
            yield batch()
    if started:
        out.append(row())
        yield batch()


def digests(plain: DataFrame, long: DataFrame | None) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, read back from the pieces that ``format_chats``
    made with ``TEMPLATE``. The pieces of a long conversation are read one after the other, as its digest needs them."""
    found = plain.mapInArrow(_digested, _DIGEST)
    if long is not None:
        found = found.union(long.repartition("conv_id").sortWithinPartitions("conv_id", "stretch", "piece").mapInArrow(_digested, _DIGEST))
    return found
