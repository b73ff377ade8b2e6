"""Five anomaly rules over transactions, and the score that joins them.

Input columns: ``id, seq, vendor, category, amount, d`` with ``seq`` the unique input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from outlay.config import AnomalyConfig
from outlay.functions.text import fixed
from outlay.operators.skew import lookup
from outlay.session import materialize

# Amounts in one cell differ by less than five per cent whichever comes first, and
# amounts more than two cells apart never do (ln(1/0.95) < 2 * 0.048 and 0.048 < ln 1.05).
CELL = 0.048
NO_DATE = "0001-01-01"


def _cell(amount: Column) -> Column:
    return F.floor(F.ln(amount) / CELL)


def global_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("amount").alias("n"),
        F.avg("amount").alias("mean_amount"),
        F.greatest(F.stddev_samp("amount"), F.lit(1e-6)).alias("std_amount"),
    )


def category_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(
        F.count("amount").alias("cat_n"),
        F.avg("amount").alias("cat_mean"),
        F.stddev_samp("amount").alias("cat_std"),
    )


def vendor_daily_counts(df: DataFrame) -> DataFrame:
    """Per vendor: on how many days it charged and its mean charges on such a day."""
    daily = df.where("d is not null").groupBy("vendor", "d").agg(F.count("*").alias("n"))
    return daily.groupBy("vendor").agg(
        F.count("*").alias("n_days"), F.avg("n").alias("avg_daily"), F.max("n").alias("max_daily")
    )


def with_global_z(df: DataFrame) -> DataFrame:
    stats = df.agg(
        F.struct(
            F.avg("amount").alias("mean"),
            F.greatest(F.stddev_samp("amount"), F.lit(1e-6)).alias("std"),
        )
    ).scalar()
    return (
        df.withColumn("_g", stats)
        .withColumn("global_z", (F.col("amount") - F.col("_g.mean")) / F.col("_g.std"))
        .drop("_g")
    )


def with_category_z(df: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """Null where the category is too small; 0 where all its amounts are equal."""
    stats = category_stats(df).where(F.col("category").isNotNull())
    joined = lookup(df, stats, ["category"], "cat_n", ["seq"], "left")
    z = F.when(F.col("cat_std") == 0, 0.0).otherwise(
        (F.col("amount") - F.col("cat_mean")) / F.col("cat_std")
    )
    return joined.withColumn(
        "category_z", F.when(F.col("cat_n") >= cfg.category_min_rows, z)
    ).drop("cat_n", "cat_mean", "cat_std")


def _cells(df: DataFrame) -> DataFrame:
    """Per vendor, day and amount cell: rows and extremes. At most some ten thousand cells
    of doubles exist per vendor and day, however many rows there are. Written, as all the
    vendor rules start from here instead of the rows."""
    cells = df.groupBy("vendor", "_day", "_cell").agg(
        F.count("*").alias("cell_n"),
        F.sum("amount").alias("cell_sum"),
        F.min("amount").alias("a_min"),
        F.max("amount").alias("a_max"),
        F.min("seq").alias("s_min"),
        F.max("seq").alias("s_max"),
    )
    return materialize(cells, "cells")


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_day", F.coalesce("d", F.lit(NO_DATE).cast("date"))).withColumn(
        "_cell", _cell(F.col("amount"))
    )


def _duplicate_cells(keyed: DataFrame, cells: DataFrame, cfg: AnomalyConfig) -> DataFrame:
    """Cells plus ``cell_dup``: whether their rows have a near-equal charge on the same day.

    All rows of a cell with two or more rows do. A cell with one row is decided by the
    nearest amounts above and below it; only where the order of the two charges matters
    and the neighbour cell holds several rows are those rows themselves looked at.
    """
    tol = cfg.duplicate_tolerance
    dated = (F.col("_day") != F.lit(NO_DATE).cast("date")) & (F.col("a_max") < float("inf"))
    near = W.partitionBy("vendor", "_day").orderBy("_cell")
    up, down = near.rangeBetween(1, 2), near.rangeBetween(-2, -1)
    a, s = F.col("a_min"), F.col("s_min")
    over, under = F.col("_over"), F.col("_under")
    around = (
        cells.withColumn("_over", F.min("a_min").over(up))
        .withColumn("_over_s", F.min("s_min").over(up))
        .withColumn("_under", F.max("a_max").over(down))
        .withColumn("_under_s", F.max("s_max").over(down))
        .withColumn(
            "_sure",
            dated
            & (
                (F.col("cell_n") > 1)
                | F.coalesce((over - a) / a < tol, F.lit(False))
                | F.coalesce((a - under) / under < tol, F.lit(False))
            ),
        )
        .withColumn(
            "_open",
            dated
            & ~F.col("_sure")
            & (
                F.coalesce(((over - a) / over < tol) & (F.col("_over_s") < s), F.lit(False))
                | F.coalesce(((a - under) / a < tol) & (F.col("_under_s") > s), F.lit(False))
            ),
        )
        .drop("_over", "_over_s", "_under", "_under_s")
    )
    # Each row meets at most the four single-row cells around it, so this stays linear.
    asking = around.where("_open").select(
        "vendor",
        "_day",
        F.col("_cell").alias("_home"),
        F.col("a_min").alias("_a"),
        F.col("s_min").alias("_s"),
        F.explode(F.array(*[F.col("_cell") + i for i in (-2, -1, 1, 2)])).alias("_cell"),
    )
    asking = materialize(asking, "open-cells")
    if asking.isEmpty():
        return around.withColumn("cell_dup", F.col("_sure")).drop("_sure", "_open")
    first = F.when(F.col("seq") < F.col("_s"), F.col("amount")).otherwise(F.col("_a"))
    found = (
        keyed.select("vendor", "_day", "_cell", "amount", "seq")
        .join(asking, ["vendor", "_day", "_cell"])
        .where(F.abs(F.col("amount") - F.col("_a")) / first < tol)
        .groupBy("vendor", "_day", F.col("_home").alias("_cell"))
        .agg(F.lit(True).alias("_hit"))
    )
    return (
        around.join(found, ["vendor", "_day", "_cell"], "left")
        .withColumn("cell_dup", F.col("_sure") | F.coalesce("_hit", F.lit(False)))
        .drop("_sure", "_open", "_hit")
    )


def with_vendor_facts(
    df: DataFrame,
    cfg: AnomalyConfig = AnomalyConfig(),
    duplicates: bool = True,
) -> DataFrame:
    """Add ``others_mean``, ``cell_dup`` and ``frequent`` with one shuffle of the rows.

    Everything is first reduced to cells, completed there, and then looked up per row.
    """
    keyed = _keyed(df)
    cells = _cells(keyed)
    if duplicates:
        cells = _duplicate_cells(keyed, cells, cfg)
    else:
        cells = cells.withColumn("cell_dup", F.lit(False))
    daily = cells.groupBy("vendor", "_day").agg(
        F.sum("cell_n").alias("day_n"), F.sum("cell_sum").alias("day_sum")
    )
    real_day = F.when(F.col("_day") != F.lit(NO_DATE).cast("date"), F.col("day_n"))
    vendors = daily.groupBy("vendor").agg(
        F.sum("day_n").alias("vendor_n"),
        F.sum("day_sum").alias("vendor_sum"),
        F.count(real_day).alias("n_days"),
        F.avg(real_day).alias("avg_daily"),
    )
    days = daily.join(vendors, "vendor").select(
        "vendor",
        "_day",
        "vendor_n",
        "vendor_sum",
        (
            (F.col("_day") != F.lit(NO_DATE).cast("date"))
            & (F.col("n_days") > 1)
            & (F.col("day_n") > F.col("avg_daily") * cfg.frequency_factor)
        ).alias("frequent"),
    )
    facts = cells.join(days, ["vendor", "_day"]).select(
        "vendor", "_day", "_cell", "cell_n", "cell_dup", "vendor_n", "vendor_sum", "frequent"
    )
    return (
        lookup(keyed, facts, ["vendor", "_day", "_cell"], "cell_n", ["seq"])
        .withColumn(
            "others_mean",
            F.when(
                F.col("vendor_n") > 1,
                (F.col("vendor_sum") - F.col("amount")) / (F.col("vendor_n") - 1),
            ),
        )
        .drop("_day", "_cell", "cell_n", "vendor_n", "vendor_sum")
    )


def global_outliers(df: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    return with_global_z(df).where(F.col("global_z") > cfg.global_z)


def category_outliers(df: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    return with_category_z(df, cfg).where(F.col("category_z") > cfg.category_z)


def historical_outliers(df: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    vendors = df.groupBy("vendor").agg(
        F.count("*").alias("vendor_n"), F.sum("amount").alias("vendor_sum")
    )
    mean = (F.col("vendor_sum") - F.col("amount")) / (F.col("vendor_n") - 1)
    return (
        lookup(df, vendors.where("vendor_n > 1"), ["vendor"], "vendor_n", ["seq"])
        .withColumn("others_mean", mean)
        .where(F.col("amount") > F.col("others_mean") * cfg.historical_factor)
        .drop("vendor_n", "vendor_sum")
    )


def duplicates(df: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    keyed = _keyed(df)
    cells = _duplicate_cells(keyed, _cells(keyed), cfg).where("cell_dup")
    facts = cells.select("vendor", "_day", "_cell", "cell_n")
    return lookup(keyed, facts, ["vendor", "_day", "_cell"], "cell_n", ["seq"]).drop(
        "_day", "_cell", "cell_n"
    )


def frequency_spikes(df: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    daily = df.where("d is not null").groupBy("vendor", "d").agg(F.count("*").alias("day_n"))
    vendors = daily.groupBy("vendor").agg(
        F.count("*").alias("n_days"), F.avg("day_n").alias("avg_daily")
    )
    spiky = (
        daily.join(vendors.where("n_days > 1"), "vendor")
        .where(F.col("day_n") > F.col("avg_daily") * cfg.frequency_factor)
        .select("vendor", "d", "day_n", "avg_daily")
    )
    return lookup(df.where("d is not null"), spiky, ["vendor", "d"], "day_n", ["seq"])


# Flag names and points, in the order of the flags array.
POINTS = {
    "global_outlier": 4,
    "category_outlier": 3,
    "historical_outlier": 3,
    "duplicate": 3,
    "frequency_spike": 3,
}


def score(df: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    """All rules together: ``flags, anomaly_reasons, anomaly_score, is_anomaly, confidence``."""
    return _judge(with_vendor_facts(with_category_z(with_global_z(df), cfg), cfg), cfg)


def _judge(df: DataFrame, cfg: AnomalyConfig) -> DataFrame:
    def yes(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False))

    hits = {
        "global_outlier": yes(F.col("global_z") > cfg.global_z),
        "category_outlier": yes(F.col("category_z") > cfg.category_z),
        "historical_outlier": yes(F.col("amount") > F.col("others_mean") * cfg.historical_factor),
        "duplicate": F.col("cell_dup"),
        "frequency_spike": F.col("frequent"),
    }
    reasons = {
        "global_outlier": F.concat(
            fixed("global_z", 1), F.lit(" deviations above all charges")
        ),
        "category_outlier": F.concat(
            fixed("category_z", 1), F.lit(" deviations above its category")
        ),
        "historical_outlier": F.lit(f"More than {cfg.historical_factor:g} times what the vendor usually charges"),
        "duplicate": F.lit("Nearly the same charge on the same day"),
        "frequency_spike": F.lit("Many more charges on this day than usual"),
    }
    points = sum((F.when(hit, POINTS[name]).otherwise(0) for name, hit in hits.items()), F.lit(0))
    flags = F.array_compact(F.array(*[F.when(hit, F.lit(name)) for name, hit in hits.items()]))
    texts = F.array_compact(F.array(*[F.when(hit, reasons[name]) for name, hit in hits.items()]))
    return (
        df.withColumn("flags", flags)
        .withColumn("anomaly_score", F.least(points, F.lit(cfg.score_cap)))
        .withColumn("is_anomaly", F.col("anomaly_score") >= cfg.medium_score)
        .withColumn("anomaly_reasons", texts)
        .withColumn(
            "confidence",
            F.when(F.col("anomaly_score") >= cfg.high_score, "High")
            .when(F.col("anomaly_score") >= cfg.medium_score, "Medium")
            .otherwise(""),
        )
        .drop("global_z", "category_z", "others_mean", "cell_dup", "frequent")
    )

