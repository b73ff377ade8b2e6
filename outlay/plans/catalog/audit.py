"""Queries for file sources, the audit log and compliance."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.operators import audit as U, fraud as R, transactions as T
from outlay.plans.catalog.fraud import ALERT_CTE, CALC, COLS, ITEMS, LOWC, MISSING, ROUND, TEN, alert_table, invoices
from outlay.plans.catalog.matching import MATCHED, matches_of, sides
from outlay.plans.fixtures import load, view, with_views
from outlay.plans.registry import query
from outlay.session import materialize, scratch_path
from outlay.sources import files, sinks

START, END = "2024-01-05", "2024-01-20"
DAYS = f"event_date between date '{START}' and date '{END}'"
#: Files that one task writes, where each document is one.
TEXTS_PER_TASK = 500
SHOWN = ["entry_id", "event_type", "user_id", "invoice_id", "status"]
SHOWN_SQL = ", ".join(SHOWN)


def audit_log(spark, sf):
    return view(spark, sf, "v_audit").withColumn("timestamp", F.col("timestamp").cast("timestamp")).withColumn(
        "action", F.concat(F.lit("Did "), "event_type")
    )


def written_log(spark, sf):
    path = scratch_path(spark, "audit-log")
    sinks.append_audit(audit_log(spark, sf), path)
    return files.read_audit(spark, path)


@query(
    with_views(
        """select date, merchant as vendor, case when try_cast(amount as double) is not null then round(cast(amount as double), 2) end as amount,
 coalesce(amount = 'n/a', false) as is_text, "desc" as description from v_raw""",
        "v_raw",
    )
)
def scan_transactions(spark, sf):
    path = scratch_path(spark, "csv")
    rows = view(spark, sf, "v_raw")
    for odd in (False, True):  # files with two orders of the columns
        names = [c for c in rows.columns if c != "seq"]
        part = rows.where((F.col("seq") % 2 == 1) == odd).select(*(names[::-1] if odd else names))
        part.write.mode("append").option("header", True).option("ignoreTrailingWhiteSpace", False).option(
            "ignoreLeadingWhiteSpace", False
        ).csv(path)
    rows = files.read_transactions(spark, path)
    return rows.select(
        "date", "vendor", F.round(T.number("amount"), 2).alias("amount"), F.coalesce(F.col("amount") == "n/a", F.lit(False)).alias("is_text"), "description"
    )


@query("select length(text) + 1 as n_chars, sha256(text || chr(10)) as file_hash from documents")
def scan_invoice_text(spark, sf):
    # One file per document, named by Spark and ended by a line feed; few files of the table must not mean few tasks here.
    path = scratch_path(spark, "texts")
    docs = load(spark, sf, "documents").select("text")
    parts = max(-(-docs.count() // TEXTS_PER_TASK), 1)
    docs.repartition(parts).write.option("maxRecordsPerFile", 1).text(path)
    texts = files.read_invoice_texts(spark, path)
    return texts.select(F.length("text").alias("n_chars"), "file_hash")


@query(
    """with h as (select doc_id, sha256(text) as file_hash from documents),
known as (select distinct file_hash from h where doc_id % 3 = 0)
select file_hash, min(doc_id) as doc_id, count(*) as copies from h where file_hash not in (select file_hash from known) group by file_hash"""
)
def dedupe_by_content(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    known = docs.where("doc_id % 3 = 0").select(F.sha2("content", 256).alias("file_hash")).distinct()
    return T.new_documents(docs, known)


@query(with_views(f"select {SHOWN_SQL}, details from v_audit where {DAYS}", "v_audit"))
def audit_scan(spark, sf):
    return U.search(written_log(spark, sf), START, END).select(*SHOWN, "details")


@query(with_views("select event_date, count(*) as n, count(distinct entry_id) as n_ids, min(timestamp) as first_at from v_audit group by event_date", "v_audit"))
def audit_roundtrip(spark, sf):
    return (
        written_log(spark, sf)
        .groupBy("event_date")
        .agg(
            F.count("*").alias("n"),
            F.count_distinct("entry_id").alias("n_ids"),
            F.min(F.col("timestamp").cast("timestamp_ntz")).alias("first_at"),
        )
    )


@query(with_views(f"select entry_id, event_type, details, status, timestamp from v_audit where {DAYS} union all select 'export', 'export', '', 'success', null", "v_audit"))
def audit_export(spark, sf):
    path = scratch_path(spark, "export")
    done = sinks.export_audit(U.search(audit_log(spark, sf), START, END), path, "csv")
    back = spark.read.option("header", True).option("escape", '"').csv(path)
    at = F.to_timestamp("timestamp", files.TIME_FORMAT).cast("timestamp_ntz").alias("timestamp")
    none = F.lit(None).cast("timestamp_ntz").alias("timestamp")
    return back.select("entry_id", "event_type", "details", "status", at).unionByName(
        done.select(F.lit("export").alias("entry_id"), "event_type", F.lit("").alias("details"), "status", none)
    )


# The history of the invoice an event id ends in; the log is read twice as cache and file.
@query(with_views(f"select distinct {SHOWN_SQL} from v_audit where invoice_id = 'inv42'", "v_audit"))
def invoice_history(spark, sf):
    log = audit_log(spark, sf)
    return U.invoice_history("inv42", log, log).select(*SHOWN)


@query(with_views(f"select {SHOWN_SQL} from v_audit where user_id = 'user8' and {DAYS}", "v_audit"))
def user_activity(spark, sf):
    return U.user_activity(audit_log(spark, sf), "user8", START, END).select(*SHOWN)


@query(
    with_views(
        f"""select count(*) as total_events, count(distinct user_id) as unique_users,
 count(*) filter (status = 'failure') as failed_events, count(*) filter (event_type = 'error') as fraud_alerts from v_audit where {DAYS}""",
        "v_audit",
    )
)
def compliance_summary(spark, sf):
    # counted from the parts of two halves of the log, each event once
    log = audit_log(spark, sf)
    half = F.pmod(F.xxhash64("entry_id"), F.lit(2))
    parts = [materialize(U.activity(log.where(half == h)), "activity") for h in (0, 1)]
    return U.compliance_of(parts[0].unionByName(parts[1]), START, END, alert_type="error")


LABELLED = "case event_type when 'error' then 'fraud_alert' when 'purchase' then 'invoice_approved' else event_type end"


@query(
    with_views(
        f"""select {LABELLED} as event_type, case event_type when 'error' then 'Fraud alert triggered' when 'purchase' then 'Invoice approved for payment'
 else event_type end as label, count(*) as n from v_audit where {DAYS} group by all""",
        "v_audit",
    )
)
def events_by_type(spark, sf):
    return U.events_by_type(audit_log(spark, sf).withColumn("event_type", F.expr(LABELLED)), START, END)


@query(with_views(f"select user_id, count(*) as n from v_audit where {DAYS} group by user_id", "v_audit"))
def events_by_user(spark, sf):
    return U.events_by_user(audit_log(spark, sf), START, END)


@query(with_views(f"select user_id, count(*) as n from v_audit where {DAYS} group by user_id order by n desc, user_id limit 10", "v_audit"))
def top_users(spark, sf):
    return U.top_users(audit_log(spark, sf), START, END)


@query(with_views(f"select {SHOWN_SQL} from v_audit where status = 'failure' and {DAYS} order by timestamp, entry_id limit 50", "v_audit"))
def failed_events(spark, sf):
    return U.failed_events(audit_log(spark, sf), START, END).select(*SHOWN)


@query(with_views(f"with {ALERT_CTE} select invoice_id, alert_type from al where severity = 'critical'", "v_inv", "v_bank"))
def audit_fraud_alerts(spark, sf):
    log = U.alert_events(alert_table(spark, sf), F.lit("2024-02-01"))
    found = U.fraud_alert_events(log, "critical", "2024-01-01")
    return found.select("invoice_id", F.get_json_object("details", "$.alert_type").alias("alert_type"))


@query(
    with_views(
        """select invoice_id, 'subtotal' as field_name from v_inv where subtotal is distinct from round(subtotal, 0)
union all select invoice_id, 'invoice_number' from v_inv where invoice_number is null""",
        "v_inv",
    )
)
def audit_modifications(spark, sf):
    old = invoices(spark, sf)
    new = old.withColumn("subtotal", F.round("subtotal", 0)).withColumn(
        "invoice_number", F.coalesce("invoice_number", F.lit("UNKNOWN"))
    )
    log = U.modification_events(old, new, "invoice_id", ["vendor", "invoice_number", "subtotal"], F.lit("2024-02-01"))
    return log.select("invoice_id", F.get_json_object("details", "$.field_name").alias("field_name"))


DOCUMENT_RISK = f"""dal as ({' union all '.join(f'select {COLS} from ({p})' for p in (ROUND, CALC, ITEMS, LOWC, MISSING))}),
decided as (select i.invoice_id, least(coalesce(sum(case severity when 'critical' then 40 when 'high' then 25 else 10 end * dal.confidence * occurrences), 0), 100) as risk
 from v_inv i left join dal using (invoice_id) group by i.invoice_id)"""


@query(
    with_views(
        f"""with recursive {MATCHED}, {ALERT_CTE}, {DOCUMENT_RISK}
select 'invoice_upload' as event_type, invoice_id, null as transaction_id, 'system' as user_id, 'Uploaded invoice: ' || invoice_id || '.txt' as action, 'success' as status, 64 as id_length from v_inv
union all select 'invoice_processed', invoice_id, null, 'system', 'Invoice processed by OCR', 'success', 64 from v_inv
union all select 'invoice_matched', invoice_id, transaction_id, 'system', printf('Invoice matched to transaction (score: %.2f%%)', score * 100), 'success', 64 from m
union all select 'fraud_alert', invoice_id, null, 'system', 'Fraud alert: ' || alert_type, 'pending', 64 from al
union all select case when risk < 75 then 'invoice_approved' else 'invoice_rejected' end, invoice_id, null, 'auditor',
 case when risk < 75 then 'Invoice approved' else 'Invoice rejected' end, 'success', 64 from decided""",
        "v_inv",
        "v_bank",
    )
)
def audit_events(spark, sf):
    inv, bank = sides(spark, sf)
    at = F.lit("2024-02-01 12:00:00")
    risk = R.risk(inv, R.document_alerts(inv))
    decided = risk.select(
        "invoice_id",
        F.lit("auditor").alias("user_id"),
        (F.col("risk_score") < 75).alias("approved"),
        F.col("recommendation").alias("reason"),
    )
    files_ = inv.select(
        F.col("invoice_id").alias("file_hash"),
        F.concat("invoice_id", F.lit(".txt")).alias("file_name"),
        F.length("vendor").alias("file_size"),
    )
    log = U.upload_events(files_, at)
    for more in (
        U.processing_events(inv.withColumn("parser_used", F.lit("intelligent")), at),
        U.match_events(matches_of(inv, bank), at),
        U.alert_events(R.alerts(inv, bank, TEN), at),
        U.approval_events(decided, at),
    ):
        log = log.unionByName(more)
    return log.select(
        "event_type", "invoice_id", "transaction_id", "user_id", "action", "status", F.length("entry_id").alias("id_length")
    )


@query(with_views("select invoice_id, count(*) as n_events, count(distinct event_type) as n_types from v_audit group by invoice_id", "v_audit"))
def events_per_invoice(spark, sf):
    return U.events_per_invoice(audit_log(spark, sf))
