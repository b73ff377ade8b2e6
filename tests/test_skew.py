from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from outlay.operators import skew


def test_running_before_equals_a_loop(spark):
    rnd = random.Random(5)
    seqs = rnd.sample(range(10**9), 400)
    rows = [("hot" if i % 3 else f"k{i % 7}", seqs[i], float(rnd.randrange(100))) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, seq long, x double")
    got = skew.running_before(
        df, ["k"], "seq", {"n": F.lit(1).cast("long"), "s": F.col("x")}, {"lo": ("min", F.col("x"))}, blocks=16
    )
    for r in got.collect():
        before = [x for k, s, x in rows if k == r.k and s < r.seq]
        assert (r.n, r.s, r.lo) == (len(before), sum(before), min(before) if before else None)


def test_row_index_follows_the_order(spark):
    rows = [(x,) for x in random.Random(1).sample(range(10**6), 300)]
    got = {r.v: r.row_index for r in skew.row_index(spark.createDataFrame(rows, "v long"), "v", blocks=8).collect()}
    assert got == {v: i for i, (v,) in enumerate(sorted(rows))}


def test_lookup_salts_heavy_keys_without_losing_rows(spark):
    fact = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"), "id")
    dim = fact.groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.length("k"))
    out = skew.lookup(fact, dim, ["k"], "n", ["id"], heavy_rows=100, broadcast_bytes=-1)
    assert out.count() == 3000 and out.select("id").distinct().count() == 3000
    assert out.where("v <> length(k)").count() == 0
    small = skew.lookup(fact, dim, ["k"], "n", ["id"])
    assert small.exceptAll(out.select(small.columns)).count() == 0
    few = skew.lookup(fact, dim.where("k <> 'hot'"), ["k"], "n", ["id"], heavy_rows=100, broadcast_bytes=-1, how="left")
    assert few.count() == 3000 and few.where("v is null").count() == 2000


def test_exact_percentile_interpolates(spark):
    rnd = random.Random(9)
    groups = {f"g{n}": [round(rnd.random() * 100, 1) for _ in range(n)] for n in (1, 2, 3, 4, 5, 10, 11, 997)}
    groups["flat"] = [5.0] * 40
    groups["wide"] = [10.0 ** rnd.randrange(-30, 30) * rnd.choice([-1, 1]) for _ in range(101)]
    groups["huge"] = [-1.7e308, 1.7e308, 0.0, 1.0, 1.0, 2.0]
    groups["steps"] = [float(i // 7) for i in range(200)]
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    for p in (0.25, 0.5):
        got = {r.g: r.percentile for r in skew.exact_percentile(df, "g", "v", p).collect()}
        assert got.keys() == groups.keys()
        for g, vs in groups.items():
            want = np.percentile(vs, p * 100)
            assert abs(got[g] - want) <= 1e-9 * max(1, abs(want)), (g, p)
