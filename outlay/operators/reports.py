"""Dashboard aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from outlay.config import AnomalyConfig
from outlay.operators.transactions import REVIEW_BELOW


def dashboard_summary(scored: DataFrame, cfg: AnomalyConfig = AnomalyConfig()) -> DataFrame:
    return scored.agg(
        F.count("*").alias("total_transactions"),
        F.sum("amount").alias("total_spend"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.round(F.try_divide(F.count_if("is_anomaly"), F.count("*")) * 100, 1).alias("anomaly_percentage"),
        F.count_distinct("category").alias("categories_tracked"),
        F.count_if(F.col("anomaly_score") >= cfg.high_score).alias("high_risk_count"),
    )


def category_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.sum("amount").alias("spend"), F.count("*").alias("n"))


def top_vendors(df: DataFrame, top: int = 10) -> DataFrame:
    return (
        df.groupBy("vendor")
        .agg(F.sum("amount").alias("spend"), F.count("*").alias("n"))
        .orderBy(F.col("spend").desc(), "vendor")
        .limit(top)
    )


def load_metadata(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count("*").alias("row_count"),
        F.sum("amount").alias("total_spend"),
        F.min("d").alias("first_date"),
        F.max("d").alias("last_date"),
    )


def confidence_stats(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg("category_confidence").alias("avg_confidence"),
        F.min("category_confidence").alias("min_confidence"),
        F.max("category_confidence").alias("max_confidence"),
        F.count_if(F.col("category_confidence") < REVIEW_BELOW).alias("low_confidence_count"),
        F.count("*").alias("total_transactions"),
    )
