"""Mix sources to target weights by drawing fixed-length blocks of words.

The words of a source, document after document in a pseudorandom order, are cut into blocks of
``BLOCK_WORDS``. Output shards draw how many of their slots each source fills: the whole part
of the expected number is given, the rest is a multinomial draw over the fractions. A source's
slots are numbered through all shards, and number ``i`` takes the block at place ``i mod N`` of the
source's pseudorandom permutation, so every block comes up once before any comes up again.

Only DataFrame functions. A source may hold any share of the words: running sums and places come
from range partitions of one global order, never from a window over a source. All draws hash
keys, and all weights are whole numbers, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from outlay.llm.common import Scratch

BLOCK_WORDS = 128
SHARD_SLOTS = 1024
WEIGHTS = (3, 1, 2)
#: Words of the mix in hundredths of the words there are, and how often a word may come up.
SHARE, MOST = 150, 2
_CELLS = 1024
_UNITS = 1000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def running(df: DataFrame, order: list[str], sums: dict[str, Column], scratch: Scratch) -> DataFrame:
    """Add, per row, sums over the rows before it in ``order``, which must not tie on unequal rows.

    Rows are dealt to ranges of the order; a range adds what all ranges before it hold.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = scratch.write(df.repartitionByRange(parts, *order).withColumns({f"_{k}": v for k, v in sums.items()}).withColumn("_part", F.spark_partition_id()))
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy("_part").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    # one row per range, of which there are as many as shuffle partitions
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in sums])
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = cut.join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, *[(F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) + F.col(f"_o_{k}")).alias(k) for k in sums])


def drawn(*key: Column) -> Column:
    """A pseudorandom hex string of a key."""
    return F.md5(F.concat_ws("|", *key))


def source_targets(sizes: DataFrame, scratch: Scratch) -> DataFrame:
    """``(source, sid, words, target)`` of the sources of ``sizes`` (``source``, ``size``).

    Sources by code point, null last, weigh ``WEIGHTS`` in turn and share ``SHARE`` hundredths of all
    words by weight. A target stops at ``MOST`` times its source's words; what is over is shared
    again by weight among the rest until no target is above.
    """
    found = sizes.groupBy("source").agg(F.sum("size").alias("words")).withColumn("last", F.col("source").isNull())
    ranked = running(found, ["last", "source"], {"sid": F.lit(1)}, scratch)
    turn = F.pmod(F.col("sid"), F.lit(len(WEIGHTS))).cast("int")
    ranked = scratch.write(ranked.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), turn).cast("long")))
    cap, level = F.col("words") * float(MOST), None
    while True:
        above = F.lit(False) if level is None else F.col("weight") * F.lit(level) > cap
        now = ranked.agg(
            F.coalesce(F.sum("words"), F.lit(0)).alias("all"),
            F.coalesce(F.sum(F.when(above, F.col("words"))), F.lit(0)).alias("full"),
            F.sum(F.when(~above, F.col("weight"))).alias("weights"),
        ).first()
        if not now.weights:
            break
        new = (now["all"] * SHARE / 100 - now.full * float(MOST)) / now.weights
        if new == level:
            break
        level = new
    return ranked.select("source", "sid", "words", F.least(cap, F.col("weight") * F.lit(float(level or 0))).alias("target"))


def mix_blocks(docs: DataFrame, key: list[str], scratch: Scratch, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` (``source``, ``size`` and the columns ``key`` that tell rows apart).

    Returns the rows with ``sid``, ``words`` and ``target`` of their source and ``start``, the number of
    words before them in it; and the mix: per slot ``(shard, slot)`` the pieces of its block, as words
    ``lo`` up to ``hi`` of the row ``(sid, start)``, with ``turn``, 0 where the block comes up first.
    Rows without words have no ``start`` and no piece.
    """
    spark = docs.sparkSession
    sources = scratch.write(source_targets(docs, scratch))
    blocks_of = F.ceil(F.col("words") / block_words)
    share = F.when(F.col("words") > 0, F.round(F.col("target") * blocks_of / F.col("words") * _UNITS)).otherwise(0).cast("long")
    sources = scratch.write(running(sources.withColumns({"blocks": blocks_of, "units": share}), ["sid"], {"words_before": F.col("words"), "blocks_before": F.col("blocks")}, scratch))

    placed = docs.join(sources.select("source", "sid", "words", "target", "words_before"), docs["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    laid = placed.where("size > 0").withColumn("_at", drawn(F.lit("document"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key]))
    laid = running(laid, ["sid", "_at", *key, "size"], {"start": F.col("size")}, scratch)
    laid = scratch.write(laid.withColumn("start", F.col("start") - F.col("words_before")).drop("_at", "words_before"))
    none = placed.where("size = 0").withColumn("start", F.lit(None).cast("long")).drop("words_before")
    rows = laid.unionByName(none)

    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = laid.select("sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo = F.greatest(F.col("block") * block_words - F.col("start"), F.lit(0))
    hi = F.least((F.col("block") + 1) * block_words - F.col("start"), F.col("size"))
    pieces = scratch.write(pieces.select("sid", "block", "start", lo.alias("lo"), hi.alias("hi")))
    begun = pieces.where(F.col("start") + F.col("lo") == F.col("block") * block_words).select("sid", "block")
    begun = begun.withColumn("_at", drawn(F.lit("block"), F.col("sid"), F.col("block")))
    order = running(begun, ["sid", "_at", "block"], {"place": F.lit(1)}, scratch).join(sources.select("sid", "blocks_before", "blocks"), "sid")
    order = scratch.write(order.select("sid", "block", "blocks", (F.col("place") - F.col("blocks_before")).alias("place")))

    total = sources.agg(F.coalesce(F.sum("units"), F.lit(0))).first()[0]
    shards = max(1, round(total / _UNITS / shard_slots))
    slots = round(total / _UNITS / shards)
    exact = F.col("units") * slots
    given = F.when(F.lit(total) > 0, F.floor(exact / F.lit(max(total, 1)))).otherwise(0).cast("long")
    given = sources.select("sid", "units", given.alias("given"))
    given = given.withColumn("given", F.when(F.col("given") * total > F.col("units") * slots, F.col("given") - 1).otherwise(F.col("given")))
    given = given.withColumn("rest", F.col("units") * slots - F.col("given") * total)
    given = scratch.write(running(given, ["sid"], {"from_slot": F.col("given"), "from_rest": F.col("rest")}, scratch))
    sure = int(given.agg(F.coalesce(F.sum("given"), F.lit(0))).first()[0])
    rest = int(given.agg(F.coalesce(F.sum("rest"), F.lit(0))).first()[0])

    every = spark.range(shards * slots).select(F.floor(F.col("id") / max(slots, 1)).alias("shard"), (F.col("id") % max(slots, 1)).alias("slot"))
    # the given slots of a shard: fewer than its slots, the same for all shards
    fixed = given.where("given > 0").select("sid", "given", "from_slot", F.explode(F.sequence(F.lit(0), F.col("given") - 1)).alias("j"))
    fixed = F.broadcast(fixed.select("sid", "given", "j", (F.col("from_slot") + F.col("j")).alias("slot")))
    by_plan = every.where(F.col("slot") < sure).join(fixed, "slot").select("shard", "slot", "sid", (F.col("shard") * F.col("given") + F.col("j")).alias("i"))
    # the drawn ones: a point of the line on which every source has its rest
    point = F.conv(F.substring(drawn(F.lit("slot"), F.col("shard"), F.col("slot")), 1, 13), 16, 10).cast("double") / float(1 << 52)
    open_slots = every.where(F.col("slot") >= sure).withColumn("point", point)
    open_slots = open_slots.withColumn("cell", F.floor(F.col("point") * _CELLS)).withColumn("x", F.col("point") * float(rest))
    lines = given.where("rest > 0").select("sid", "given", F.col("from_rest").cast("double").alias("left"), (F.col("from_rest") + F.col("rest")).cast("double").alias("right"))
    scale = _CELLS / max(rest, 1)
    lines = lines.withColumn("cell", F.explode(F.sequence(F.floor(F.col("left") * scale) - 1, F.floor(F.col("right") * scale) + 1)))
    by_draw = open_slots.join(lines, "cell").where("x >= left and x < right").select("shard", "slot", "sid", "given")
    by_draw = running(by_draw, ["sid", "shard", "slot"], {"n": F.lit(1)}, scratch)
    least = scratch.write(by_draw.groupBy("sid").agg(F.min("n").alias("least")))
    by_draw = by_draw.join(least, "sid").select("shard", "slot", "sid", (F.col("given") * shards + F.col("n") - F.col("least")).alias("i"))
    taken = by_plan.union(by_draw).join(sources.select("sid", "blocks"), "sid")
    turn = F.floor(F.col("i") / F.col("blocks"))
    taken = taken.select("shard", "slot", "sid", turn.alias("turn"), (F.col("i") % F.col("blocks")).alias("place")).where(F.col("turn") < MOST)
    pieces = scratch.write(pieces.join(order, ["sid", "block"]).select("sid", "place", "start", "lo", "hi"))
    return rows, scratch.write(taken.join(pieces, ["sid", "place"]).select("shard", "slot", "sid", "turn", "start", "lo", "hi"))


def mix_sources(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` per row of ``docs`` (``doc_id``, ``text``, ``source``).

    ``size`` counts words, ``taken`` the words of the row that the mix takes, repeats counted. Null
    texts count as empty; rows without words take nothing. Null is a source of its own. Repeated
    rows are documents of their own. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.md5(F.coalesce(text, F.lit(""))).alias("print"), text.alias("text"))
    rows = scratch.write(rows.select("doc_id", "source", "print", word_count("text").alias("size")))
    laid, mix = mix_blocks(rows, ["doc_id", "print"], scratch, block_words)
    taken = scratch.write(mix.groupBy("sid", "start").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken")))
    out = ["doc_id", "size", F.col("words").alias("source_size"), "target"]
    with_words = laid.where("start is not null").join(taken, ["sid", "start"], "left").select(*out, F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return with_words.union(laid.where("start is null").select(*out, F.lit(0).cast("long").alias("taken")))


def mixed_texts(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix as documents with the columns of ``docs``: per turn one row of each document that it takes from.

    A row's ``text`` is the whole text where the turn takes all of its words, else the taken runs of
    words, each with the white space that follows it; ``n_chars`` follows the text.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    print_ = F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(docs.columns)]), {"ignoreNullFields": "false"}))
    packed = docs.select(print_.alias("print"), F.struct(*docs.columns).alias("doc"))
    rows = scratch.write(docs.select(F.col("source").cast("string").alias("source"), print_.alias("print"), word_count("text").alias("size")))
    laid, mix = mix_blocks(rows, ["print"], scratch, block_words)
    runs = mix.groupBy("sid", "start", "turn").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))
    runs = laid.where("start is not null").join(runs, ["sid", "start"]).select("print", "size", "turn", "runs")
    runs = scratch.write(runs)
    texts = packed.dropDuplicates(["print"]).join(runs, "print")
    words = F.regexp_extract_all("doc.text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), F.lit(1))
    run = F.transform("runs", lambda r: F.array_join(F.slice(words, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")), ""))
    whole = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["hi"] - r["lo"]) == F.col("size")
    texts = texts.select("doc", F.when(whole, F.col("doc.text")).otherwise(F.array_join(run, "")).alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return texts.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in docs.columns])
