"""Queries for the category model. Labels are the keyword rule, so scores say how well the
model agrees with it. SQL tells the rows of each side and what every good model has in common."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from outlay.operators import ml as L, transactions as T
from outlay.plans.catalog.transactions import PART_KEYWORDS, keyword_sql, part_rows
from outlay.plans.registry import query
from outlay.session import materialize, scratch_path


def labelled(spark, sf):
    rows = T.categorize_keywords(part_rows(spark, sf), PART_KEYWORDS)
    return materialize(rows.select("part_id", "vendor", "description", "amount", "category"), "labelled")


def trained(spark, sf):
    train, test = L.split(labelled(spark, sf), "part_id")
    return L.train(train), train, test


@query()
def ml_features(spark, sf):
    rows = labelled(spark, sf)
    out = L.fit_features(rows).transform(L.with_text(rows))
    values = vector_to_array(F.col("features"))
    return out.select(
        "part_id",
        F.size(F.filter(values, lambda v: v != 0)).alias("n_nonzero"),
        F.round(F.element_at(values, -1), 6).alias("amount_z"),
    )


PLACED = f"""placed as (select *, ('0x' || substr(md5('42|' || category || '|' || part_id), 1, 8))::bigint / 4294967296.0 as place
 from ({keyword_sql(PART_KEYWORDS)}))"""


@query(
    f"""with {PLACED} select count(*) filter (place < 0.2) as test_size, count(*) filter (place >= 0.2) as train_size,
 true as accurate from placed"""
)
def ml_train(spark, sf):
    model, train, test = trained(spark, sf)
    found = L.accuracy(L.predict(model, test)).withColumn("train_size", train.agg(F.count("*")).scalar())
    return found.select("test_size", "train_size", (F.col("accuracy") >= 0.95).alias("accurate"))


@query(
    f"""with {PLACED} select category, count(*) as support, true as as_counted from placed where place < 0.2 group by category
union all select 'all', count(*), true from placed where place < 0.2"""
)
def ml_metrics(spark, sf):
    """Per category its rows, and whether precision, recall and F1 are those of a plain count; over all, whether 95 % are right."""
    model, _, test = trained(spark, sf)
    told = materialize(L.predict(model, test).select("category", "category_ml"), "predicted")
    right = (F.col("category") == F.col("category_ml")).cast("double")
    plain = told.groupBy(F.col("category").alias("c")).agg(F.avg(right).alias("r")).join(
        told.groupBy(F.col("category_ml").alias("c")).agg(F.avg(right).alias("p")), "c", "left"
    )
    p, r = F.coalesce("p", F.lit(0.0)), F.coalesce("r", F.lit(0.0))
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    close = (F.abs(F.col("precision") - p) < 1e-9) & (F.abs(F.col("recall") - r) < 1e-9) & (F.abs(F.col("f1") - f1) < 1e-9)
    rows = L.metrics(told).where("support > 0").join(plain, F.col("category") == F.col("c")).select("category", "support", close.alias("as_counted"))
    every = L.accuracy(told).select(F.lit("all"), F.col("test_size"), F.col("accuracy") >= 0.95)
    return rows.union(every)


@query(
    f"""with {PLACED} select part_id, true as known, true as sure, true as review_below, 'ML-based' as method from placed
union all select -1, true, true, true, 'right in 95 of 100' from (select 1)"""
)
def ml_predict(spark, sf):
    model, _, _ = trained(spark, sf)
    path = scratch_path(spark, "model")
    L.save(model, path)
    names = [*PART_KEYWORDS, T.DEFAULT_CATEGORY, T.LARGE_AMOUNT_CATEGORY]
    sure = (F.col("category_confidence") > 0) & (F.col("category_confidence") <= 1)
    rows = materialize(L.categorize(part_rows(spark, sf), path), "categorized")
    told = rows.select(
        "part_id", F.col("category").isin(*names).alias("known"), sure.alias("sure"),
        (F.col("needs_review") == (F.col("category_confidence") < T.REVIEW_BELOW)).alias("review_below"), "method",
    )
    truth = labelled(spark, sf).select("part_id", F.col("category").alias("true_category"))
    share = rows.join(truth, "part_id").agg(F.avg((F.col("category") == F.col("true_category")).cast("double")).alias("share"))
    yes = F.col("share") >= 0.95
    return told.union(share.select(F.lit(-1).cast("long"), yes, yes, yes, F.lit("right in 95 of 100")))


@query(f"select part_id, category, 'Keyword-based' as method from ({keyword_sql(PART_KEYWORDS)})")
def categorize(spark, sf):
    return L.categorize(part_rows(spark, sf), scratch_path(spark, "no-model"), PART_KEYWORDS).select(
        "part_id", "category", "method"
    )
