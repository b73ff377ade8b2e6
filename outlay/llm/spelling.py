"""Spelling variants by walking a relational trie level by level.

The trie is a table of edges (depth, node, character, child); a node is the 64-bit hash of a prefix. Each
word is filed twice, as it reads and reversed, and an edit is looked for in the second half of either
reading only: up to the middle a word follows its own path, so that walks start where nodes have few
children. The frontier holds states (word, position, node) that have spent their edit. At each level it
takes one edge, and the words that are that deep add states: one per other child (a replaced
character) and one that skips a character (a deleted one). Insertions are deletions seen from the
other word. An edge knows which characters follow and whether a word ends there, so hopeless states are never made.
States that end where a word ends are neighbours, compared once more as texts, so that hashes cannot err.

A level is a job. Words of more than ``LEVELS`` characters, of which a table holds few, are not walked but
take two long edges instead of many short ones: their first half, then a tail within one edit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from outlay.llm.common import Scratch
from outlay.session import scratch_path

#: Longest words that are walked character by character.
LEVELS = 48
#: Edges of a level up to which they are broadcast, and words through a node above which its states are salted.
_FEW, _HEAVY = 50_000, 200_000
RUN = r"[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(documents: DataFrame) -> DataFrame:
    """``(doc_id, run)``: every maximal run of letters of every whole text, A-Z lower-cased. Null texts have none."""
    runs = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(RUN), F.lit(0))
    return documents.select("doc_id", F.explode(runs).alias("run"))


def with_slips(runs: DataFrame, every: int) -> DataFrame:
    """``word``: the run, or, where the crc32 of ``<doc_id>:<run>`` is a multiple of ``every``, the run without
    one character, chosen by the same number. A null ``doc_id`` counts as empty."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    runs = runs.withColumn("h", h)
    at = F.expr("cast(h % char_length(run) as int)")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def _shift(char: str) -> str:
    """One of 62 bits for a character."""
    return f"shiftleft(1L, cast(ascii({char}) % 62 as int))"


def _node(side: str, text: str, length: str) -> str:
    return f"xxhash64({side}, substr({text}, 1, {length}))"


def _edges(sides: DataFrame) -> DataFrame:
    """The trie's edges as deep as walks go: ``after`` has the bits of the characters that follow, ``ends`` whether a word does."""
    steps = sides.withColumn("depth", F.expr("explode(sequence(if(side = 0, n div 2, n - n div 2), n - 1))"))
    steps = steps.selectExpr(
        "depth", f"{_node('side', 'text', 'depth')} as node", "substr(text, depth + 1, 1) as ch", f"{_node('side', 'text', 'depth + 1')} as child",
        f"if(depth + 2 <= n, {_shift('substr(text, depth + 2, 1)')}, 0L) as next", "depth + 1 = n as ends",
    )
    return steps.groupBy("depth", "node", "ch", "child").agg(F.bit_or("next").alias("after"), F.max("ends").alias("ends"), F.count("*").alias("through"))


def _step(states: DataFrame, edges: DataFrame, few: bool, heavy: DataFrame | None) -> DataFrame:
    """States one edge on. A state asks for the child by ``want``, or with ``other`` for all but that."""
    keys = ["node"]
    if few:
        edges = F.broadcast(edges)
    elif heavy is not None:
        salts = heavy.select("node", "salts")
        states = states.join(salts, "node", "left").withColumn("salt", F.expr("pmod(xxhash64(text), coalesce(salts, 1))")).drop("salts")
        edges = edges.join(salts, "node", "left").withColumn("salt", F.expr("explode(sequence(0L, coalesce(salts, 1) - 1))")).drop("salts")
        keys = ["node", "salt"]
    met = states.join(edges, keys).where(
        "if(other, ch <> want, ch = want) and if(position = n, ends, after & " + _shift("substr(text, position + 1, 1)") + " <> 0)"
    )
    return met.select("side", "text", "n", "position", F.col("child").alias("node"))


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near)`` in both orders: words of the table (``word``, distinct, not null) that differ by exactly one
    inserted, deleted or replaced character. All such pairs come out, once each."""
    scratch = Scratch(words.sparkSession, "spelling")
    plain = words.selectExpr("0 as side", "word as text", "char_length(word) as n").where("n > 0")
    both = plain.union(plain.selectExpr("1", "reverse(text)", "n"))
    sides = scratch.write(both.where(f"n <= {LEVELS}"))
    trie = scratch.write(_edges(sides).repartition("depth", "node"))
    sizes = {r.depth: r.n for r in trie.groupBy("depth").agg(F.count("*").alias("n")).collect()}  # at most LEVELS rows
    through = trie.groupBy("depth", "node").agg(F.sum("through").alias("w")).where(F.col("w") > _HEAVY)
    heavy = scratch.write(through.withColumn("salts", F.expr(f"cast(ceil(w / {_HEAVY}) as long)")))
    salted = {r.depth for r in heavy.select("depth").distinct().collect()}
    root, walk = scratch_path(words.sparkSession, "spelling-walk"), "side int, text string, n int, position int, node long"
    read = words.sparkSession.read
    frontier = None
    for level in sorted(sizes):
        # words at this depth spend their edit here: character number `level` is replaced, or left out once per run of equal ones
        here = sides.where(f"if(side = 0, n div 2, n - n div 2) <= {level} and {level} < n").selectExpr(
            "side", "text", "n", f"{_node('side', 'text', str(level))} as node", f"substr(text, {level} + 1, 1) as own", f"substr(text, {level} + 2, 1) as then"
        )
        replaced = here.selectExpr("side", "text", "n", f"{level} + 1 as position", "node", "own as want", "true as other")
        skipped = here.where(f"{level} + 1 < n and own <> then").selectExpr("side", "text", "n", f"{level} + 2 as position", "node", "then as want", "false as other")
        states = replaced.union(skipped)
        if frontier is not None:
            moved = frontier.selectExpr("side", "text", "n", "position + 1 as position", "node", "substr(text, position + 1, 1) as want", "false as other")
            states = states.union(moved)
        edges = trie.where(f"depth = {level}").select("node", "ch", "child", "after", "ends")
        path = f"{root}/level={level}"
        _step(states, edges, sizes[level] <= _FEW, heavy.where(f"depth = {level}") if level in salted else None).write.parquet(path)
        frontier = read.schema(walk).parquet(path).where("position < n")
    # states at the end of their word, and words without their last character
    ended = sides.selectExpr("side", "text", _node("side", "text", "n - 1") + " as node")
    if sizes:
        ended = ended.union(read.schema(walk + ", level int").parquet(root).where("position = n").select("side", "text", "node"))
    ends = sides.selectExpr("side", "text as other", "xxhash64(side, text) as node")
    pairs = ended.join(ends, ["side", "node"]).select("side", "text", "other").union(_long_pairs(both))
    pairs = pairs.where("levenshtein(text, other, 1) = 1").selectExpr(
        "if(side = 0, text, reverse(text)) as word", "if(side = 0, other, reverse(other)) as near"
    )
    pairs = scratch.write(pairs)
    shorter = pairs.where("char_length(near) < char_length(word)").select(F.col("near").alias("word"), F.col("word").alias("near"))
    return pairs.union(shorter).distinct()


def _long_pairs(both: DataFrame) -> DataFrame:
    """``(side, text, other)`` where ``text`` has more than ``LEVELS`` characters: it and a word as long, or one shorter,
    share the first half of ``text`` in one of the readings."""
    half = "if(side = 0, {n} div 2, {n} - {n} div 2)"
    asking = both.where(f"n > {LEVELS}").selectExpr("side", "text", "n", f"xxhash64(substr(text, 1, {half.format(n='n')})) as start")
    filed = both.where(f"n >= {LEVELS}").selectExpr("side", "text as other", "explode(array(n, n + 1)) as n")
    filed = filed.selectExpr("side", "other", "n", f"xxhash64(substr(other, 1, {half.format(n='n')})) as start")
    return asking.join(filed, ["side", "n", "start"]).where("text <> other").select("side", "text", "other")


def spelling_variants(words: DataFrame, min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` per distinct word of ``words`` (``word``, one row per occurrence).

    Words have at least ``min_length`` characters and ``min_count`` occurrences (``n``). A word's form is its near word
    of the largest ``n`` (ties: the smallest word by code points), if that is at least ``ratio`` times its own, else
    null; ``root`` follows forms to the last, and is the word itself without a form. ``n_near`` counts near words.
    Null and empty words are left out; an empty table has no words. Other columns are not read.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    counts = words.where(F.char_length("word") >= max(min_length, 1)).groupBy("word").agg(F.count("*").alias("n"))
    counts = scratch.write(counts.where(F.col("n") >= min_count))
    pairs = near_words(counts.select("word"))
    ranked = pairs.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    first = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first")
    best = ranked.groupBy("word").agg(F.count("*").alias("n_near"), first)
    known = counts.join(best, "word", "left")
    known = known.withColumn("follows", F.coalesce(-F.col("first.less") >= ratio * F.col("n"), F.lit(False)))
    known = scratch.write(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("follows"), F.col("first.near")).alias("form"), F.when(F.col("follows"), -F.col("first.less")).alias("form_n"),
        )
    )
    # forms grow by the ratio at each step, so chains are short, and each round doubles the steps taken
    up = scratch.write(known.where("form is not null").select("word", F.col("form").alias("top")))
    while True:
        on = up.alias("a").join(up.alias("b"), F.expr("a.top = b.word"), "left")
        moved = scratch.write(on.select("a.word", F.coalesce("b.top", "a.top").alias("top"), F.expr("b.top is not null").alias("more")))
        scratch.drop(up)
        if moved.where("more").isEmpty():
            break
        up = moved
    rooted = known.join(moved.select("word", "top"), "word", "left")
    return rooted.select("word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", "form_n")
