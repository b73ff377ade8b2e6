"""Near-duplicate documents by a grouped prefix join on word shingles.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold. A
set can only reach it with a set that shares one of its first ``n - ceil(t n) + 1`` shingles in
any order of all shingles, its prefix. The steps:

1. Sets are built in numpy; documents with the same set become one class.
2. Screen: the order by hash needs no corpus counts. A prefix that is ``SLACK`` longer must share
   a matching number of shingles, so classes whose longer prefix is mostly their own go.
3. The other classes are ordered by how many classes hold a shingle, rarest first. Shingles of a
   single class cannot match and take up the start of the prefix; what passages shared by
   very many documents add is at the end and outside of it.
4. Classes with the same size and the same prefix form a group. Group pairs are filtered by size
   and by what can still match after a shared position, then expanded and verified on whole sets.

Near copies of one text are many; their pairs are never all made. Two rounds compare each
group only with the most central group it meets, and link what passes. A last round makes all
pairs that are still in different components, so no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from outlay.llm.common import Scratch, components, long_lists, text_slices
from outlay.llm.shingles import shingle_sets
from outlay.session import materialize

#: Share of a set by which the prefixes of the screen are longer than they have to be.
SLACK = 0.08
#: Similarity in hundredths.
PERCENT = 80
#: So many ids at most are broadcast, to fetch their texts without shuffling all texts.
BROADCAST_IDS = 1_000_000


def least_overlap(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares at least with any similar set."""
    return -(-percent * n // 100)


def least_shared(n: int, percent: int) -> int:
    """Shingles that the screen's prefix shares at least with that of any similar set."""
    return max(1, int(SLACK * least_overlap(n, percent)))


def screen_length(n: int, percent: int) -> int:
    return n - least_overlap(n, percent) + max(1, int(SLACK * n))


def _class_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batches: Iterator[pa.RecordBatch], percent: int | None) -> Iterator[pa.RecordBatch]:
    """Id, size, class and either the screen's prefix or, without ``percent``, the whole set."""
    for batch in batches:
        for ids, texts in text_slices(batch.column(0), batch.column(1)):
            sets = list(shingle_sets(texts))
            kept = sets if percent is None else [s[: screen_length(len(s), percent)] for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class_id(s) if len(s) else None for s in sets], pa.int64()),
                    long_lists(kept),
                ],
                names=["doc_id", "n", "cid", "shingles"],
            )


_SETS = "doc_id long, n long, cid long, shingles array<long>"


def _overlap(n: str | Column, percent: int) -> Column:
    """``least_overlap`` of a column."""
    n = F.col(n) if isinstance(n, str) else n
    return F.floor((n * percent + 99) / 100)


def _shared_by_two(rows: DataFrame) -> DataFrame:
    return rows.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")


def _verified(pairs: DataFrame, shared: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Those pairs of classes ``(a, b)`` whose whole sets are similar.

    ``shared`` has the size of each set and its shingles that some other class has; no others can be
    common. Pairs are written first: mostly they are few, and the sets need not move to meet them.
    """
    sides = scratch.write(pairs).withColumn("cid", F.explode(F.array("a", "b")))
    both = sides.join(shared.select("cid", "n", "shingles"), "cid").groupBy("a", "b").agg(F.sum("n").alias("n"), F.collect_list("shingles").alias("s"))
    overlap = F.size(F.array_intersect(F.get("s", F.lit(0)), F.get("s", F.lit(1))))
    return both.where(overlap * (100 + percent) >= F.col("n") * percent).select("a", "b")


def _can_reach(percent: int) -> Column:
    """A pair of index rows ``x`` and ``y`` passes by size and by what follows the shared place."""
    smaller, larger = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    rest = F.least(F.col("x.m") - F.col("x.pos"), F.col("y.m") - F.col("y.pos"))
    return (smaller * 100 >= larger * percent) & (rest * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent)


def _links(sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Links ``(a, b)`` between classes that connect all similar classes."""
    rows = sets.select("cid", "n", F.explode("shingles").alias("shingle"))
    shared = scratch.write(_shared_by_two(rows))
    per_class = (
        rows.join(shared, "shingle")
        .groupBy("cid", "n")
        .agg(F.sort_array(F.collect_list(F.struct("df", "shingle"))).alias("s"))
        .withColumn("m", F.size("s").cast("long"))
        .where(F.col("m") >= _overlap("n", percent))
    )
    held = scratch.write(per_class.select("cid", "n", "m", F.col("s")["shingle"].alias("shingles")))
    length = (F.col("m") - _overlap("n", percent) + 1).cast("int")
    prefixes = held.select("cid", "n", "m", F.slice("shingles", F.lit(1), length).alias("prefix"))
    central = F.min(F.struct((1 - F.col("m") / F.col("n")).alias("own"), "cid"))
    groups = scratch.write(
        prefixes.groupBy("n", "prefix").agg(F.min("cid").alias("gid"), F.max("m").alias("m"), central.alias("c"))
    )
    members = scratch.write(prefixes.join(groups.select("n", "prefix", "gid"), ["n", "prefix"]).select("cid", "gid"))
    index = scratch.write(
        groups.select("gid", "n", "m", F.col("c.own").alias("own"), F.col("c.cid").alias("lead"), F.posexplode("prefix").alias("pos", "shingle"))
    )
    reach = _can_reach(percent)

    def central_of(entries: DataFrame, at: str) -> DataFrame:
        best = F.min(F.struct("own", "gid", "lead", "n", "m", "pos", "part")).alias(at)
        return entries.groupBy("shingle").agg(best)

    # first round: each group with the central group it meets most often, and with its own lead
    start = index.withColumn("part", F.col("gid"))
    met = scratch.write(start.groupBy("shingle").agg(F.count("*").alias("k"), F.min(F.struct("own", "gid", "lead", "n", "m", "pos")).alias("y")).where("k > 1"))
    votes = (
        start.alias("x").join(met, "shingle").where(reach & F.expr("x.gid <> y.gid"))
        .groupBy("x.gid", F.col("y.lead").alias("b")).agg(F.count("*").alias("k"))
        .groupBy("gid").agg(F.max_by("b", F.struct("k", "b")).alias("b"))
    )
    own = groups.select("gid", F.col("c.cid").alias("b"))
    pairs = members.join(votes.union(own), "gid").where("cid <> b").select(F.col("cid").alias("a"), "b").distinct()
    links = [scratch.write(_verified(pairs, held, scratch, percent))]

    def state() -> tuple[DataFrame, DataFrame]:
        """Members with their component so far, and index rows of groups with the range of it."""
        union = links[0]
        for more in links[1:]:
            union = union.union(more)
        part = components(union).withColumnRenamed("node", "cid")
        own = scratch.write(members.join(part, "cid", "left").select("cid", "gid", F.coalesce("component", "cid").alias("part")))
        span = scratch.write(own.groupBy("gid").agg(F.min("part").alias("part"), F.max("part").alias("top")))
        return own, scratch.write(index.join(span, "gid"))

    # second round: each group with the central one of another component, by every shingle
    own, entries = state()
    first = scratch.write(central_of(entries, "y"))
    others = entries.join(first, "shingle").where(F.col("part") != F.col("y.part"))
    second = scratch.write(central_of(others.drop("y"), "z"))
    near = entries.alias("x").join(first.join(second, "shingle"), "shingle")
    near = near.withColumn("y", F.when(F.col("x.part") == F.col("y.part"), F.col("z")).otherwise(F.col("y")))
    pairs = near.where(reach & F.expr("x.gid <> y.gid")).select("gid", F.col("y.lead").alias("b"), F.col("y.part").alias("other")).distinct()
    pairs = own.join(pairs, "gid").where("part <> other").select(F.col("cid").alias("a"), "b").distinct()
    links.append(scratch.write(_verified(pairs, held, scratch, percent)))

    # last round: all pairs that are still apart; one of both is outside the shingle's most common part
    own, entries = state()
    sizes = entries.groupBy("shingle", "part").agg(F.count("*").alias("k"), F.max(F.col("part") != F.col("top")).alias("mixed"))
    common = scratch.write(
        sizes.groupBy("shingle").agg(F.max_by("part", F.struct("k", "part")).alias("common"), F.count("*").alias("parts"), F.max("mixed").alias("mixed"))
        .where("parts > 1 or mixed").select("shingle", "common")
    )
    open_rows = scratch.write(entries.join(common, "shingle").withColumn("outside", F.expr("part <> common or part <> top")))
    x, y = open_rows.where("outside").alias("x"), open_rows.alias("y")
    apart = F.expr("x.part <> y.part or x.part <> x.top or y.part <> y.top")
    once = F.expr("x.gid < y.gid or not y.outside")
    group_pairs = x.join(y, F.expr("x.shingle = y.shingle")).where(reach & apart & once).select(F.col("x.gid").alias("ga"), F.col("y.gid").alias("gb")).distinct()
    inside = entries.where("part <> top").select(F.col("gid").alias("ga"), F.col("gid").alias("gb")).distinct()
    a = own.select(F.col("gid").alias("ga"), F.col("cid").alias("a"), F.col("part").alias("pa"))
    b = own.select(F.col("gid").alias("gb"), F.col("cid").alias("b"), F.col("part").alias("pb"))
    pairs = group_pairs.union(inside).distinct().join(a, "ga").join(b, "gb").where("pa <> pb")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links.append(scratch.write(_verified(pairs, held, scratch, percent)))
    return links[0].union(links[1]).union(links[2])


def ngram_jaccard_join(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` per row of ``docs`` (``doc_id``, ``text``).

    ``component_id`` is the smallest ``doc_id`` reachable by links of at least ``percent``
    hundredths. Null and wordless texts have no shingles and link with nothing. Every row is a
    document of its own, so repeated rows come back as often and in one component. A row without
    ``doc_id`` takes the component of its class but never names it. Other columns of ``docs`` are
    not read. Classes are 64-bit hashes of sets, shingles are 64-bit hashes of words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketch = scratch.write(docs.mapInArrow(lambda it: _sets(it, percent), _SETS))
    rows = scratch.write(sketch.select("doc_id", "n", "cid"))
    classes = scratch.write(
        sketch.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("shingles").alias("shingles"))
    )
    scratch.drop(sketch)
    tokens = classes.where("rep is not null").select("cid", "n", F.explode("shingles").alias("shingle"))
    shared = scratch.write(_shared_by_two(tokens).select("shingle"))
    enough = F.greatest(F.lit(1), F.floor(_overlap("n", percent) * SLACK))
    alive = tokens.join(shared, "shingle").groupBy("cid", "n").agg(F.count("*").alias("k")).where(F.col("k") >= enough)
    alive = scratch.write(alive.select("cid").join(classes.select("cid", "rep"), "cid"))
    names = scratch.write(classes.select("cid", "rep"))
    scratch.drop(shared, classes)
    # whole sets of the classes left, from the text of one document each
    few = F.broadcast if alive.count() <= BROADCAST_IDS else (lambda df: df)
    wanted = alive.select(F.col("rep").alias("doc_id"))
    whole = docs.join(few(wanted.distinct()), "doc_id", "left_semi").mapInArrow(lambda it: _sets(it, None), _SETS)
    whole = whole.join(few(alive.select("cid")), "cid", "left_semi")
    often = rows.join(few(wanted.distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not often.isEmpty():  # rows that repeat an id may bring a set twice
        whole = whole.dropDuplicates(["cid"])
    sets = scratch.write(whole.select("cid", "n", "shingles"))
    part = components(_links(sets, scratch, percent)).withColumnRenamed("node", "cid")
    linked = scratch.write(part.join(names, "cid"))
    least = scratch.write(linked.groupBy("component").agg(F.min("rep").alias("least")))
    found = scratch.write(names.join(linked.join(least, "component").select("cid", "least"), "cid", "left").select("cid", F.coalesce("least", "rep").alias("component_id")))
    with_words = rows.where("cid is not null").join(found, "cid").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    without = rows.where("cid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_words.union(without)


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest ``doc_id``, with all columns.

    A document is a ``doc_id`` with a text (by a 64-bit hash of both): rows that share a ``doc_id`` but not the text
    are documents of their own, of which one per component stays. Of rows that repeat both the first one by
    the md5 of all its columns stays, however the rows are dealt out. Rows without ``doc_id`` stay.
    """
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", "text"))
    part = ngram_jaccard_join(docs.select(key.alias("doc_id"), "text")).where("doc_id is not null")
    part = part.groupBy(F.col("doc_id").alias("key")).agg(F.first("component_id").alias("component"), F.count("*").alias("n"))
    named = part.join(docs.select(key.alias("key"), F.col("doc_id").alias("id")), "key")
    found = named.groupBy("component").agg(F.min(F.struct("id", "key", "n")).alias("least"))
    found = materialize(found.select("least.key", "least.n"), "kept")
    few = F.broadcast if found.count() <= BROADCAST_IDS else (lambda df: df)  # else the texts move to meet the ids
    print_ = F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(docs.columns)]), {"ignoreNullFields": "false"}))
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("key"), print_.alias("print"))
    once = keyed.join(few(found.where("n = 1").select("key")), "key", "left_semi")
    often = keyed.join(few(found.where("n > 1").select("key")), "key", "left_semi")
    first = often.groupBy("key").agg(F.min("print").alias("print"))
    # rows that are equal in every column are one
    first = often.join(first, ["key", "print"], "left_semi").dropDuplicates(["key"])
    return once.select("doc.*").union(first.select("doc.*")).union(docs.where("doc_id is null").select(*docs.columns))
