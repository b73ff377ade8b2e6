"""Queries on transactions: cleaning, features, categories, anomalies."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.operators import anomalies as A, transactions as T
from outlay.plans.fixtures import load, view, with_views
from outlay.plans.registry import query
from outlay.session import materialize

RAW_CLEAN = """raw_clean as (
 select seq, date, lower(trim(merchant)) as vendor, try_cast(amount as double) as amount,
  coalesce("desc", '') as description
 from v_raw where try_cast(amount as double) > 0)"""


@query(
    with_views(
        """select
 count(*) as n_raw, count(*) filter (amount is null) as n_null_amount,
 count(*) filter (amount is not null and try_cast(amount as double) is null) as n_bad_amount,
 count(*) filter (try_cast(amount as double) <= 0) as n_not_positive,
 count(*) filter (try_cast(amount as double) > 0) as n_clean,
 count(*) >= 10 and count(*) filter (try_cast(amount as double) > 0) >= 10 as accepted from v_raw""",
        "v_raw",
    )
)
def validate_input(spark, sf):
    return T.input_report(T.alias_columns(view(spark, sf, "v_raw")))


@query(with_views("select seq, date, merchant as vendor, \"desc\" as description from v_raw", "v_raw"))
def alias_columns(spark, sf):
    return T.alias_columns(view(spark, sf, "v_raw")).select("seq", "date", "vendor", "description")


@query(with_views(f"with {RAW_CLEAN} select seq, vendor, round(amount, 2) as amount, description from raw_clean", "v_raw"))
def clean_transactions(spark, sf):
    return T.clean(view(spark, sf, "v_raw")).select(
        "seq", "vendor", F.round("amount", 2).alias("amount"), "description"
    )


@query(
    with_views(
        f"""with {RAW_CLEAN}, n as (select seq, vendor, row_number() over (order by seq) - 1 as i from raw_clean)
select seq, vendor, 'txn_' || case when i < 1000 then lpad(cast(i as varchar), 3, '0') else cast(i as varchar) end as id from n""",
        "v_raw",
    )
)
def assign_ids(spark, sf):
    return T.assign_ids(T.clean(view(spark, sf, "v_raw")), "seq").select("seq", "vendor", "id")


@query(with_views("select max(cast(regexp_extract(id, 'txn_(\\d+)', 1) as bigint)) + 1 as next_index from v_txn", "v_txn"))
def next_index(spark, sf):
    return T.next_index(view(spark, sf, "v_txn"))


@query(
    with_views(
        f"""with {RAW_CLEAN} select seq, try_cast(date as date) as d, isodow(try_cast(date as date)) - 1 as day_of_week,
 coalesce(hour(try_cast(date as timestamp)), -1) as hour, round(amount, 2) as amount_float from raw_clean""",
        "v_raw",
    )
)
def engineer_features(spark, sf):
    return T.engineer_features(T.clean(view(spark, sf, "v_raw"))).select(
        "seq",
        "d",
        F.col("day_of_week").cast("long").alias("day_of_week"),
        F.col("hour").cast("long").alias("hour"),
        F.round("amount_float", 2).alias("amount_float"),
    )


PART_KEYWORDS = {
    "Hardware": ["bolt", "ring", "rod"],
    "Goods": ["widget", "plate"],
    "Colour": ["red", "blue"],
}


PART_TEXTS = "select p_partkey as part_id, p_retailprice as amount, lower(p_name || ' ' || p_type) as txt from part"


def keyword_sql(dictionary: dict[str, list[str]], texts: str = PART_TEXTS) -> str:
    scores = ", ".join(
        " + ".join(f"cast(contains(txt, '{w}') as int)" for w in words) + f' as "{cat}"'
        for cat, words in dictionary.items()
    )
    cols = [f'"{c}"' for c in dictionary]
    best = f"greatest({', '.join(cols)})"
    ties = " + ".join(f"cast({c} = best as int)" for c in cols)
    pick = " ".join(f"when {c} = best then '{name}'" for c, name in zip(cols, dictionary))
    return f"""with t as ({texts}),
 s as (select *, {scores} from t), b as (select *, {best} as best from s)
select part_id, case when best = 0 then case when amount > 5000 then 'Operations' else 'Miscellaneous' end
 when {ties} > 1 then 'Miscellaneous' {pick} end as category from b"""


def part_rows(spark, sf):
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"),
        F.col("p_name").alias("vendor"),
        F.col("p_type").alias("description"),
        F.col("p_retailprice").alias("amount"),
    )


@query(keyword_sql(PART_KEYWORDS))
def categorize_keywords(spark, sf):
    return T.categorize_keywords(part_rows(spark, sf), PART_KEYWORDS).select("part_id", "category")


# Descriptions that name a keyword of the default dictionary, three of them no word at all.
WORDS = [w for words in T.CATEGORY_KEYWORDS.values() for w in words]
WORD_LIST = ", ".join(f"'{w}'" for w in WORDS)
NAMED_TEXTS = f"""select p_partkey as part_id, p_retailprice * (p_partkey % 10) as amount,
 lower(p_brand || ' Paid for ' || coalesce(([{WORD_LIST}])[(p_partkey * 7 % {len(WORDS) + 3}) + 1], 'nothing')) as txt from part"""


@query(keyword_sql(T.CATEGORY_KEYWORDS, NAMED_TEXTS))
def categorize_default(spark, sf):
    at = (F.col("p_partkey") * 7 % (len(WORDS) + 3)).cast("int")
    word = F.coalesce(F.get(F.array(*map(F.lit, WORDS)), at), F.lit("nothing"))
    rows = load(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"),
        F.col("p_brand").alias("vendor"),
        F.concat(F.lit("Paid for "), word).alias("description"),
        (F.col("p_retailprice") * (F.col("p_partkey") % 10)).alias("amount"),
    )
    return T.categorize_keywords(rows).select("part_id", "category")


@query(with_views("select avg(amount) as mean_amount, greatest(stddev_samp(amount), 1e-6) as std_amount, count(*) as n from v_txn", "v_txn").replace("avg(amount) as", "round(avg(amount), 4) as").replace("greatest(stddev_samp(amount), 1e-6)", "round(greatest(stddev_samp(amount), 1e-6), 4)"))
def global_stats(spark, sf):
    return A.global_stats(view(spark, sf, "v_txn")).select(
        "n", F.round("mean_amount", 4).alias("mean_amount"), F.round("std_amount", 4).alias("std_amount")
    )


@query(with_views("select category, count(*) as cat_n, round(avg(amount), 4) as cat_mean, round(stddev_samp(amount), 4) as cat_std from v_txn group by category", "v_txn"))
def category_stats(spark, sf):
    return A.category_stats(view(spark, sf, "v_txn")).select(
        "category", "cat_n", F.round("cat_mean", 4).alias("cat_mean"), F.round("cat_std", 4).alias("cat_std")
    )


@query(with_views("select vendor, count(*) as n_days, round(avg(n), 4) as avg_daily, max(n) as max_daily from (select vendor, d, count(*) as n from v_txn group by vendor, d) group by vendor", "v_txn"))
def vendor_daily_counts(spark, sf):
    return A.vendor_daily_counts(view(spark, sf, "v_txn")).withColumn("avg_daily", F.round("avg_daily", 4))


GLOBAL_SQL = "select t.* from v_txn t, (select avg(amount) as m, greatest(stddev_samp(amount), 1e-6) as s from v_txn) where (amount - m) / s > 2.5"
CATEGORY_SQL = """select t.* from v_txn t join (select category, avg(amount) as m, stddev_samp(amount) as s, count(*) as n
 from v_txn group by category) c on c.category = t.category where n >= 5 and s > 0 and (amount - m) / s > 2.0"""
HISTORICAL_SQL = """select t.* from v_txn t join (select vendor, sum(amount) as vs, count(*) as vn from v_txn group by vendor) v
 on v.vendor = t.vendor where vn > 1 and amount > 3 * (vs - amount) / (vn - 1)"""
DUPLICATE_SQL = """select t.* from v_txn t where exists (select 1 from v_txn o where o.vendor = t.vendor and o.d = t.d and o.seq <> t.seq
 and abs(o.amount - t.amount) / (case when o.seq < t.seq then o.amount else t.amount end) < 0.05)"""
FREQUENCY_SQL = """select t.* from v_txn t join (select vendor, d, count(*) as n from v_txn group by vendor, d) c on c.vendor = t.vendor and c.d = t.d
 join (select vendor, count(*) as days, avg(n) as a from (select vendor, d, count(*) as n from v_txn group by vendor, d) group by vendor) v
 on v.vendor = t.vendor where days > 1 and n > 2 * a"""


def _flagged(rows):
    return rows.select("id", "vendor", "category", F.round("amount", 2).alias("amount"))


def _flagged_sql(sql):
    return with_views(f"select id, vendor, category, round(amount, 2) as amount from ({sql})", "v_txn")


@query(_flagged_sql(GLOBAL_SQL))
def anomaly_global(spark, sf):
    return _flagged(A.global_outliers(view(spark, sf, "v_txn")))


@query(_flagged_sql(CATEGORY_SQL))
def anomaly_category(spark, sf):
    return _flagged(A.category_outliers(view(spark, sf, "v_txn")))


@query(_flagged_sql(HISTORICAL_SQL))
def anomaly_historical(spark, sf):
    return _flagged(A.historical_outliers(view(spark, sf, "v_txn")))


@query(_flagged_sql(DUPLICATE_SQL))
def anomaly_duplicate(spark, sf):
    return _flagged(A.duplicates(view(spark, sf, "v_txn")))


@query(_flagged_sql(FREQUENCY_SQL))
def anomaly_frequency(spark, sf):
    return _flagged(A.frequency_spikes(view(spark, sf, "v_txn")))


SCORED = f"""g as ({GLOBAL_SQL}), c as ({CATEGORY_SQL}), h as ({HISTORICAL_SQL}), u as ({DUPLICATE_SQL}), f as ({FREQUENCY_SQL}),
flagged as (
 select t.*, g.id is not null as fg, c.id is not null as fc, h.id is not null as fh, u.id is not null as fu, f.id is not null as ff
 from v_txn t left join g on g.id = t.id left join c on c.id = t.id left join h on h.id = t.id
 left join u on u.id = t.id left join f on f.id = t.id),
scored as (
 select *, least(10, 4 * fg::int + 3 * fc::int + 3 * fh::int + 3 * fu::int + 3 * ff::int) as anomaly_score,
 concat_ws(',', case when fg then 'global_outlier' end, case when fc then 'category_outlier' end,
  case when fh then 'historical_outlier' end, case when fu then 'duplicate' end, case when ff then 'frequency_spike' end) as flags
 from flagged)"""


def scored(spark, sf):
    return A.score(view(spark, sf, "v_txn"))


def scored_table(spark, sf):
    """The scored transactions as a written table, for queries that read them several times."""
    return materialize(scored(spark, sf), "scored")


@query(
    with_views(
        f"""with {SCORED} select id, vendor, category, round(amount, 2) as amount, anomaly_score, flags,
 case when flags = '' then 0 else length(flags) - length(replace(flags, ',', '')) + 1 end as n_reasons,
 anomaly_score >= 5 as is_anomaly,
 case when anomaly_score >= 8 then 'High' when anomaly_score >= 5 then 'Medium' else '' end as confidence from scored""",
        "v_txn",
    )
)
def anomaly_scores(spark, sf):
    return scored(spark, sf).select(
        "id",
        "vendor",
        "category",
        F.round("amount", 2).alias("amount"),
        "anomaly_score",
        F.array_join("flags", ",").alias("flags"),
        F.size("anomaly_reasons").alias("n_reasons"),
        "is_anomaly",
        "confidence",
    )


@query(with_views(f"with {SCORED} select id, anomaly_score from scored where anomaly_score >= 5", "v_txn"))
def anomalies(spark, sf):
    return scored(spark, sf).where("is_anomaly").select("id", "anomaly_score")


@query(
    with_views(
        f"""with {SCORED}, f as (select * replace ('txn_' || case when n < 1000 then lpad(cast(n as varchar), 3, '0') else cast(n as varchar) end as id)
  from (select *, row_number() over (order by seq) - 1 as n from scored) where category = 'purchase' and anomaly_score >= 5)
select id, vendor, round(amount, 2) as amount, anomaly_score, (select count(*) from f) as total_count,
 ceil((select count(*) from f) / 20.0) as total_pages from (select * from f order by seq limit 20 offset 20)""".replace(", f as (select * replace", ", pf as (select * replace").replace("from f)", "from pf)").replace("from f order", "from pf order"),
        "v_txn",
    )
)
def transactions_page(spark, sf):
    rows = T.assign_ids(scored_table(spark, sf).drop("id"), "seq")
    return T.page(rows, page_no=2, limit=20, category="purchase", anomaly=True).select(
        "id",
        "vendor",
        F.round("amount", 2).alias("amount"),
        "anomaly_score",
        "total_count",
        F.col("total_pages").cast("double").alias("total_pages"),
    )


@query(
    with_views(
        """select seq, vendor, (select count(*) from v_txn) as total_count from (select * from v_txn order by seq)
 offset (select (count(*) - 1) // 50 * 50 from v_txn)""",
        "v_txn",
    )
)
def transactions_last_page(spark, sf):
    """The last page of all transactions, read from the ranges that hold it."""
    rows = view(spark, sf, "v_txn")
    blocks = T.page_blocks(rows, 1_000)
    last = (sum(n for _, _, n in blocks) + 49) // 50
    return T.page(rows, page_no=last, blocks=blocks).select("seq", "vendor", "total_count")


@query(
    with_views(
        """select id, vendor, strftime(d, '%Y-%m-%d') as date, hour, round(amount, 2) as amount,
 case when seq % 3 = 0 then null else round(amount, 2) end as nested, strftime(d, '%Y-%m-%d') as nested_date from v_txn""",
        "v_txn",
    )
)
def serialize_records(spark, sf):
    odd = F.when(F.col("seq") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("amount"))
    parts = F.array(F.struct(odd.alias("x"), F.col("d").alias("on")))
    out = T.records(view(spark, sf, "v_txn").select("id", "vendor", "d", "hour", "amount", parts.alias("parts")))
    return out.select(
        F.round(F.get_json_object("record", "$.parts[0].x").cast("double"), 2).alias("nested"),
        F.get_json_object("record", "$.parts[0].on").alias("nested_date"),
        F.get_json_object("record", "$.id").alias("id"),
        F.get_json_object("record", "$.vendor").alias("vendor"),
        F.get_json_object("record", "$.d").alias("date"),
        F.get_json_object("record", "$.hour").cast("long").alias("hour"),
        F.round(F.get_json_object("record", "$.amount").cast("double"), 2).alias("amount"),
    )
