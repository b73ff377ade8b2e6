"""Queries for the invoice fraud rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.config import FraudConfig
from outlay.operators import fraud as R, transactions as T
from outlay.plans.fixtures import view, with_views
from outlay.plans.registry import query
from outlay.session import materialize


# Payments are looked for by the first ten characters of the vendor.
TEN = FraudConfig(vendor_chars=10)


def invoices(spark, sf):
    return view(spark, sf, "v_inv")


def _ids(alerts):
    return alerts.select("invoice_id", "alert_type", "severity", "confidence", "occurrences")


def _alert_sql(kind: str, where: str, n: str = "1") -> str:
    severity, confidence, _, _ = R.ALERTS[kind]
    return f"""select invoice_id, '{kind}' as alert_type, '{severity}' as severity, {confidence} as confidence,
 {n} as occurrences from {where}"""


DUP = _alert_sql(
    "duplicate_invoice",
    """(select a.invoice_id, count(*) as n from v_inv a join v_inv b on a.vendor = b.vendor
 and a.invoice_number = b.invoice_number and b.seq < a.seq group by a.invoice_id)""",
    "n",
)
NEAR = _alert_sql(
    "near_duplicate",
    """(select a.invoice_id, count(*) as n from v_inv a join v_inv b on a.vendor = b.vendor and b.seq < a.seq
 and abs(a.total - b.total) < 0.01 and abs(date_diff('day', a.d, b.d)) <= 7 where a.total <> 0 and b.total <> 0 group by a.invoice_id)""",
    "n",
)
ROUND = _alert_sql("suspicious_round_amount", "v_inv where total >= 1000 and total % 100 = 0")
CALC = _alert_sql(
    "calculation_mismatch",
    "v_inv where subtotal <> 0 and tax <> 0 and total > 0 and abs(subtotal + tax - total) / total > 0.02",
)
ITEMS = _alert_sql("line_items_mismatch", "v_inv where subtotal > 0 and abs(items_sum - subtotal) / subtotal > 0.05")
LOWC = _alert_sql("low_ocr_confidence", "v_inv where confidence < 0.5")
MISSING = _alert_sql(
    "missing_critical_fields",
    "v_inv where coalesce(vendor, '') = '' or coalesce(invoice_number, '') = '' or d is null or coalesce(total, 0) = 0",
)
SHAPE = "regexp_replace(regexp_replace({}, '[a-zA-Z]', 'A', 'g'), '\\d', 'N', 'g')"


def format_sql(table: str) -> str:
    return _alert_sql(
        "inconsistent_invoice_format",
        f"""{table} a where coalesce(invoice_number, '') <> ''
 and (select count(*) from {table} b where b.vendor = a.vendor and b.seq < a.seq) >= 3
 and exists (select 1 from {table} b where b.vendor = a.vendor and b.seq < a.seq and coalesce(b.invoice_number, '') <> '')
 and not exists (select 1 from {table} b where b.vendor = a.vendor and b.seq < a.seq and coalesce(b.invoice_number, '') <> ''
  and {SHAPE.format('b.invoice_number')} = {SHAPE.format('a.invoice_number')})""",
    )


AMOUNT = _alert_sql(
    "amount_anomaly",
    """(select *, count(total) over w as n, avg(total) over w as m, stddev_pop(total) over w as s from v_inv
 window w as (partition by vendor order by seq rows between unbounded preceding and 1 preceding))
 where n >= 3 and s > 0 and abs(total - m) / s > 3""",
)
UNPAID = _alert_sql(
    "no_matching_transaction",
    """v_inv i where total <> 0 and vendor <> '' and not exists (select 1 from v_bank t
 where t.d between i.d - 30 and i.d + 30 and contains(lower(t.vendor), substring(i.vendor, 1, 10)))""",
)
COLS = "invoice_id, alert_type, severity, cast(confidence as double) as confidence, occurrences"


def _sql(*parts: str) -> str:
    body = " union all ".join(f"select {COLS} from ({p})" for p in parts)
    return with_views(body, "v_inv", "v_bank")


def _kind(spark, sf, kind):
    return _ids(R.document_alerts(invoices(spark, sf))).where(F.col("alert_type") == kind)


@query(_sql(ROUND))
def fraud_round_amount(spark, sf):
    return _kind(spark, sf, "suspicious_round_amount")


@query(_sql(CALC))
def fraud_calc_mismatch(spark, sf):
    return _kind(spark, sf, "calculation_mismatch")


@query(_sql(ITEMS))
def fraud_line_items_mismatch(spark, sf):
    return _kind(spark, sf, "line_items_mismatch")


@query(_sql(LOWC))
def fraud_low_confidence(spark, sf):
    return _kind(spark, sf, "low_ocr_confidence")


@query(_sql(MISSING))
def fraud_missing_fields(spark, sf):
    return _kind(spark, sf, "missing_critical_fields")


# No vendor of the tables looks made up, so every third vendor gets a name that does.
ODD_NAME = """case when k % 3 = 0 then concat(vendor, ' sample test') when k % 3 = 1 then concat('vendor ', cast(k as string)) else vendor end"""


@query(
    with_views(
        "select invoice_id, pattern from (select invoice_id, " + ODD_NAME + " as vendor from v_inv) i, (values "
        + ", ".join(f"('{p}')" for p in R.SUSPICIOUS_NAMES)
        + ") as p(pattern) where regexp_matches(vendor, pattern, 'i')",
        "v_inv",
    )
)
def fraud_vendor_name(spark, sf):
    odd = invoices(spark, sf).withColumn("vendor", F.expr(ODD_NAME))
    found = R.document_alerts(odd).where("alert_type = 'suspicious_vendor_name'")
    return found.select(
        "invoice_id", F.substring_index(F.element_at("evidence", 2), "Matches pattern: ", -1).alias("pattern")
    )


@query(_sql(DUP))
def fraud_duplicate(spark, sf):
    return _ids(R.duplicate_alerts(invoices(spark, sf)))


@query(_sql(NEAR))
def fraud_near_duplicate(spark, sf):
    return _ids(R.near_duplicate_alerts(invoices(spark, sf)))


# Every 53rd number is written in another shape, so that shapes differ within vendors.
ODD_NUMBER = "case when k % 53 = 0 then concat('R', cast(k as string)) else invoice_number end"


@query(
    with_views(
        f"with odd as (select * replace ({ODD_NUMBER} as invoice_number) from v_inv) select {COLS} from ({format_sql('odd')})",
        "v_inv",
    )
)
def fraud_format(spark, sf):
    odd = invoices(spark, sf).withColumn("invoice_number", F.expr(ODD_NUMBER))
    return _ids(R.format_alerts(odd))


@query(with_views(f"select invoice_id, {SHAPE.format('invoice_number')} as format from v_inv where invoice_number is not null", "v_inv"))
def invoice_format(spark, sf):
    return invoices(spark, sf).where("invoice_number is not null").select(
        "invoice_id", R.invoice_format("invoice_number").alias("format")
    )


@query(_sql(AMOUNT))
def fraud_amount_anomaly(spark, sf):
    return _ids(R.amount_alerts(invoices(spark, sf)))


@query(_sql(UNPAID))
def fraud_no_transaction(spark, sf):
    return _ids(R.unpaid_alerts(invoices(spark, sf), view(spark, sf, "v_bank"), TEN))


ALL = (DUP, NEAR, ROUND, CALC, ITEMS, format_sql("v_inv"), AMOUNT, LOWC, MISSING, UNPAID)


def alert_table(spark, sf):
    return R.alerts(materialize(invoices(spark, sf), "invoices"), view(spark, sf, "v_bank"), TEN)


@query(_sql(*ALL))
def fraud_alerts(spark, sf):
    return _ids(alert_table(spark, sf))


def alert_cte(*parts: str) -> str:
    return "al as (" + " union all ".join(f"select {COLS} from ({p})" for p in parts) + ")"


ALERT_CTE = alert_cte(*ALL)
RISK = f"""{ALERT_CTE}, per as (select invoice_id, sum(case severity when 'critical' then 40 when 'high' then 25 else 10 end * confidence * occurrences) as points,
 sum(occurrences) as n, sum(occurrences) filter (severity = 'critical') as nc, sum(occurrences) filter (severity = 'high') as nh from al group by invoice_id),
risk as (select i.invoice_id, i.vendor, i.total, round(least(coalesce(points, 0), 100), 4) as risk_score, coalesce(n, 0) as alert_count,
 coalesce(nc, 0) as critical_alerts, coalesce(nh, 0) as high_alerts from v_inv i left join per p on p.invoice_id = i.invoice_id)"""


@query(
    with_views(
        f"""with {RISK} select invoice_id, cast(risk_score as double) as risk_score, cast(alert_count as bigint) as alert_count,
 cast(critical_alerts as bigint) as critical_alerts, cast(high_alerts as bigint) as high_alerts,
 case when risk_score >= 75 then 'critical' when risk_score >= 50 then 'high' when risk_score >= 25 then 'medium' else 'low' end as risk_level
from risk""",
        "v_inv",
        "v_bank",
    )
)
def fraud_risk(spark, sf):
    table = materialize(invoices(spark, sf), "invoices")
    return R.risk(table, R.alerts(table, view(spark, sf, "v_bank"), TEN)).select(
        "invoice_id",
        F.round("risk_score", 4).alias("risk_score"),
        "alert_count",
        "critical_alerts",
        "high_alerts",
        "risk_level",
    )


@query(
    with_views(
        f"""with {RISK} select invoice_id, cast(risk_score as double) as risk_score, cast(alert_count as bigint) as alert_count
from risk where invoice_id in ('inv7r', 'inv40')""",
        "v_inv",
        "v_bank",
    )
)
def lookup_fraud(spark, sf):
    table = materialize(invoices(spark, sf), "invoices")
    kept = R.keep_results(R.risk(table, R.alerts(table, view(spark, sf, "v_bank"), TEN)))
    found = R.result_of(spark, kept, "inv7r").unionByName(R.result_of(spark, kept, "inv40"))
    return found.select("invoice_id", F.round("risk_score", 4).alias("risk_score"), "alert_count")


@query(
    with_views(
        f"""with {ALERT_CTE} select cast(sum(occurrences) as bigint) as total_alerts,
 cast(sum(occurrences) filter (severity = 'critical') as bigint) as critical_alerts,
 cast(sum(occurrences) filter (severity = 'high') as bigint) as high_alerts from al""",
        "v_inv",
        "v_bank",
    )
)
def fraud_alert_counts(spark, sf):
    return R.alert_counts(alert_table(spark, sf))


@query(with_views("select invoice_id, vendor, invoice_number, d, round(total, 2) as total from v_inv where invoice_id = 'inv7r'", "v_inv"))
def lookup_invoice(spark, sf):
    return invoices(spark, sf).where(F.col("invoice_id") == "inv7r").select(
        "invoice_id", "vendor", "invoice_number", "d", F.round("total", 2).alias("total")
    )


@query(
    with_views(
        """select d, vendor, round(total, 0) as amount, 'Invoice ' || coalesce(invoice_number, 'N/A') as description,
 'invoice_ocr' as source, invoice_id from v_inv where total > 0
union all select d, vendor, round(amount, 0), null, null, null from v_bank""",
        "v_inv",
        "v_bank",
    )
)
def txn_from_invoices(spark, sf):
    bank = view(spark, sf, "v_bank").select("d", "vendor", "amount")
    rows = T.from_invoices(invoices(spark, sf))
    return T.append(bank, rows).select(
        "d", "vendor", F.round("amount", 0).alias("amount"), "description", "source", "invoice_id"
    )
