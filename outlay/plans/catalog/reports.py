"""Queries for insights, actions and the dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.operators import actions as C, insights as I, reports as R, transactions as T
from outlay.plans.catalog.transactions import PART_KEYWORDS, SCORED, part_rows, scored, scored_table
from outlay.plans.fixtures import view, with_views
from outlay.plans.registry import query

SPIKES = """spikes as (
 select 'cost_spike' as type, case when impact / total > 0.15 then 'high' else 'medium' end as severity, category as subject,
  impact as impact_amount, impact / total as importance_score, 1 as kind_rank, impact / expected * 100 as unit_amount from (
  select category, sum(amount) - quantile_cont(amount, 0.25) * count(*) as impact, quantile_cont(amount, 0.25) * count(*) as expected,
   sum(amount) as actual, count(*) as n, (select sum(amount) from v_txn) as total from v_txn group by category)
 where n >= 10 and actual > 1.35 * expected)"""


def subs_sql(table: str) -> str:
    return f"""subs as (
 select 'subscription' as type, 'medium' as severity, vendor as subject, mean * 12 as impact_amount,
  mean * 12 / (select sum(amount) from {table}) as importance_score, 2 as kind_rank, mean as unit_amount from (
  select vendor, count(*) as n, avg(amount) as mean, stddev_pop(amount) as sd, min(gap) as lo, max(gap) as hi from (
   select *, date_diff('day', lag(d) over (partition by vendor order by d), d) as gap from {table}) group by vendor)
 where n >= 3 and sd / mean < 0.05 and lo >= 25 and hi <= 35)"""


SUMMARY = """summary as (
 select 'anomaly_summary' as type, case when 100.0 * n / t > 5 then 'high' else 'info' end as severity,
  'all transactions' as subject, impact as impact_amount, impact / total as importance_score, 3 as kind_rank, 100.0 * n / t as unit_amount from (
  select count(*) filter (anomaly_score >= 8) as n, count(*) as t, sum(amount) filter (anomaly_score >= 8) as impact,
   sum(amount) as total from scored) where n > 0)"""

INSIGHTS = f"""{SCORED}, {SPIKES}, {subs_sql('v_txn')}, {SUMMARY},
insights as (select *, row_number() over (order by importance_score desc, kind_rank, subject) as rank
 from (select * from spikes union all select * from subs union all select * from summary)
 order by importance_score desc, kind_rank, subject limit 10)"""

# Impacts often end in exactly half a cent; a shift keeps both engines off that tie.
SHOWN = "type, severity, subject, round(impact_amount + 0.0001, 2) as impact_amount, round(importance_score, 6) as importance_score"


def _shown(df, *more):
    return df.select(
        "type",
        "severity",
        "subject",
        F.round(F.col("impact_amount") + 0.0001, 2).alias("impact_amount"),
        F.round("importance_score", 6).alias("importance_score"),
        *more,
    )


@query(with_views(f"with {SPIKES} select {SHOWN} from spikes", "v_txn"))
def cost_spikes(spark, sf):
    return _shown(I.cost_spikes(view(spark, sf, "v_txn")))


TITLE = "upper(subject[1:1]) || subject[2:] || ' takes $' || printf('%.2f', unit_amount) || ' a month'"


@query(with_views(f"with {subs_sql('v_charges')} select {SHOWN}, {TITLE} as title from subs", "v_charges"))
def subscriptions(spark, sf):
    found = I.subscriptions(view(spark, sf, "v_charges"))
    return _shown(found, "title")


@query(with_views(f"with {SCORED}, {SUMMARY} select {SHOWN}, round(unit_amount, 4) as pct from summary", "v_txn"))
def anomaly_summary(spark, sf):
    found = I.anomaly_summary(scored(spark, sf))
    return found.select(
        "type",
        "severity",
        "subject",
        F.round(F.col("impact_amount") + 0.0001, 2).alias("impact_amount"),
        F.round("importance_score", 6).alias("importance_score"),
        F.round("unit_amount", 4).alias("pct"),
    )


@query(with_views(f"with {INSIGHTS} select rank, {SHOWN} from insights", "v_txn"))
def insights(spark, sf):
    found = I.insights(scored_table(spark, sf))
    return found.select(
        "rank",
        "type",
        "severity",
        "subject",
        F.round(F.col("impact_amount") + 0.0001, 2).alias("impact_amount"),
        F.round("importance_score", 6).alias("importance_score"),
    )


ACTIONS = f"""{INSIGHTS}, risky as (select *, row_number() over (order by seq) as pos from scored where anomaly_score >= 8),
acts as (
 select pos, 'review' as type, 'high' as priority, id as target, 'transaction' as target_type, true as auto_executable, amount as impact from risky
 union all select (select count(*) from risky) + row_number() over (order by rank), case when type = 'cost_spike' then 'optimize' else 'control' end,
  case when type = 'cost_spike' and severity = 'high' then 'high' else 'medium' end, subject,
  case when type = 'cost_spike' then 'category' else 'vendor' end, false, impact_amount from insights where type <> 'anomaly_summary'),
top_acts as (select *, 'act_' || case when pos < 1000 then lpad(cast(pos as varchar), 3, '0') else cast(pos as varchar) end as id from acts
 order by case priority when 'high' then 3 else 2 end desc, impact desc, pos limit 10)"""


def _actions(spark, sf):
    rows = scored_table(spark, sf)
    return C.actions(rows, I.insights(rows))


@query(
    with_views(
        f"with {ACTIONS} select id, type, priority, target, target_type, auto_executable, 'pending' as status, round(impact, 2) as impact from top_acts",
        "v_txn",
    )
)
def actions(spark, sf):
    return _actions(spark, sf).select(
        "id", "type", "priority", "target", "target_type", "auto_executable", "status",
        F.round("impact", 2).alias("impact"),
    )


REVIEWS = """reviews as (select seq, id as target, 'act_' || id as id, anomaly_score >= 8 as auto_executable from scored where anomaly_score >= 5),
decisions as (select id, case when seq % 3 = 0 then 'execute' else 'dismiss' end as decision, 1 as decided_at from reviews where seq % 2 = 0
 union all select id, 'execute', 2 from reviews where seq % 4 = 0),
valid as (select r.id, r.target, r.auto_executable, d.decision, d.decided_at, d.decision = 'dismiss' or r.auto_executable as ok
 from reviews r left join decisions d on d.id = r.id)"""


@query(
    with_views(
        f"""with {SCORED}, {REVIEWS}
select id, target, case when count(*) filter (decision is not null and ok) = 0 then 'pending'
  when arg_min(decision, decided_at) filter (ok) = 'execute' then 'executed' else 'dismissed' end as status,
 case when count(decision) > 0 and count(*) filter (decision is not null and ok) = 0 then 'not auto-executable' end as rejected,
 count(decision) - least(1, count(*) filter (decision is not null and ok)) as n_rejected
from valid group by id, target""",
        "v_txn",
    )
)
def apply_action_decisions(spark, sf):
    reviews = scored(spark, sf).where("is_anomaly").select(
        "seq",
        F.col("id").alias("target"),
        F.concat(F.lit("act_"), "id").alias("id"),
        (F.col("anomaly_score") >= 8).alias("auto_executable"),
        F.lit("transaction").alias("target_type"),
        F.lit("pending").alias("status"),
    )
    decisions = reviews.where("seq % 2 = 0").select(
        "id",
        F.when(F.col("seq") % 3 == 0, "execute").otherwise("dismiss").alias("decision"),
        F.lit(1).alias("decided_at"),
    ).unionByName(
        reviews.where("seq % 4 = 0").select(
            "id", F.lit("execute").alias("decision"), F.lit(2).alias("decided_at")
        )
    )
    return C.apply_decisions(reviews, decisions).select("id", "target", "status", "rejected", "n_rejected")


@query(
    with_views(
        f"""with {ACTIONS}, top_reviews as (select target from top_acts where type = 'review')
select s.id, s.anomaly_score, case when t.target is not null then 'NEEDS_REVIEW' else '' end as tags
from scored s left join top_reviews t on t.target = s.id""",
        "v_txn",
    )
)
def tag_transactions(spark, sf):
    rows = scored_table(spark, sf)
    acts = C.actions(rows, I.insights(rows))
    decisions = acts.select("id", F.lit("execute").alias("decision"), F.lit(1).alias("decided_at"))
    decided = C.apply_decisions(acts, decisions)
    return C.tag_transactions(rows, decided).select(
        "id", "anomaly_score", F.array_join("tags", ",").alias("tags")
    )


@query(
    with_views(
        f"""with {INSIGHTS}, top_spike as (select subject from insights where type = 'cost_spike' order by rank limit 1)
select id, category, anomaly_score from scored where anomaly_score >= 5 and category in (select subject from top_spike)""",
        "v_txn",
    )
)
def anomalies_for_insight(spark, sf):
    rows = scored_table(spark, sf)
    chosen = I.insights(rows).where("type = 'cost_spike'").orderBy("rank").limit(1)
    return I.anomalies_for_insight(rows, chosen).select("id", "category", "anomaly_score")


@query(
    with_views(
        f"""with {SCORED} select count(*) as total_transactions, round(sum(amount), 2) as total_spend,
 count(*) filter (anomaly_score >= 5) as anomaly_count, round(100.0 * count(*) filter (anomaly_score >= 5) / count(*), 1) as anomaly_percentage,
 count(distinct category) as categories_tracked, count(*) filter (anomaly_score >= 8) as high_risk_count from scored""",
        "v_txn",
    )
)
def dashboard_summary(spark, sf):
    return R.dashboard_summary(scored(spark, sf)).withColumn("total_spend", F.round("total_spend", 2))


@query(with_views("select category, round(sum(amount), 2) as spend, count(*) as n from v_txn group by category", "v_txn"))
def category_breakdown(spark, sf):
    return R.category_breakdown(view(spark, sf, "v_txn")).withColumn("spend", F.round("spend", 2))


@query(with_views("select vendor, round(sum(amount), 2) as spend, count(*) as n from v_txn group by vendor order by sum(amount) desc, vendor limit 10", "v_txn"))
def top_vendors(spark, sf):
    return R.top_vendors(view(spark, sf, "v_txn")).withColumn("spend", F.round("spend", 2))


@query(with_views("select count(*) as row_count, round(sum(amount), 2) as total_spend, min(d) as first_date, max(d) as last_date from v_txn", "v_txn"))
def load_metadata(spark, sf):
    return R.load_metadata(view(spark, sf, "v_txn")).withColumn("total_spend", F.round("total_spend", 2))


@query("select 0.85 as avg_confidence, 0.85 as min_confidence, 0.85 as max_confidence, 0 as low_confidence_count, count(*) as total_transactions from part")
def confidence_stats(spark, sf):
    rows = T.categorize_keywords(part_rows(spark, sf), PART_KEYWORDS)
    return R.confidence_stats(rows).withColumn("avg_confidence", F.round("avg_confidence", 6))
