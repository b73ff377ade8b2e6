"""Audit events, histories and compliance reports.

Audit rows: ``entry_id, timestamp, event_date, event_type, user_id, invoice_id,
transaction_id, action, details (JSON text), ip_address, user_agent, status, error_message``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from outlay.functions.text import fixed

# Event codes and their labels.
EVENT_TYPES = {
    "invoice_upload": "Invoice uploaded",
    "invoice_processed": "Invoice processed by OCR",
    "invoice_matched": "Invoice matched to transaction",
    "invoice_approved": "Invoice approved for payment",
    "invoice_rejected": "Invoice rejected",
    "invoice_modified": "Invoice data modified",
    "invoice_deleted": "Invoice deleted",
    "fraud_alert": "Fraud alert triggered",
    "transaction_created": "Transaction created from invoice",
    "transaction_modified": "Transaction modified",
    "user_access": "User accessed invoice",
    "system_action": "Automated system action",
    "export": "Data exported",
    "settings_changed": "System settings changed",
}
SYSTEM = "system"
TEXT = ("event_type", "user_id", "invoice_id", "transaction_id", "action", "details", "ip_address", "user_agent", "status", "error_message")


def events(
    rows: DataFrame,
    event_type: str | Column,
    action: Column,
    at: Column,
    details: dict[str, Column],
    user: Column | None = None,
    invoice: Column | None = None,
    transaction: Column | None = None,
    status: str = "success",
) -> DataFrame:
    """Audit rows from any table; the id is a hash of the whole content."""
    none = F.lit(None).cast("string")
    values = {
        "event_type": F.lit(event_type) if isinstance(event_type, str) else event_type,
        "user_id": user if user is not None else F.lit(SYSTEM),
        "invoice_id": invoice if invoice is not None else none,
        "transaction_id": transaction if transaction is not None else none,
        "action": action,
        "details": F.to_json(F.struct(*[c.alias(n) for n, c in details.items()])),
        "ip_address": none,
        "user_agent": none,
        "status": F.lit(status),
        "error_message": none,
    }
    out = rows.select(at.cast("timestamp").alias("timestamp"), *[values[n].alias(n) for n in TEXT])
    content = F.concat_ws("|", F.col("timestamp").cast("string"), *[F.coalesce(n, F.lit("")) for n in TEXT])
    return out.withColumn("event_date", F.to_date("timestamp")).withColumn("entry_id", F.sha2(content, 256))


def upload_events(files: DataFrame, at: Column) -> DataFrame:
    """From ``(file_hash, file_name, file_size)``."""
    return events(
        files, "invoice_upload", F.concat(F.lit("Uploaded invoice: "), "file_name"), at,
        {n: F.col(n) for n in ("file_name", "file_size", "file_hash")}, invoice=F.col("file_hash"),
    )


def processing_events(invoices: DataFrame, at: Column) -> DataFrame:
    """From ``(invoice_id, vendor, total, confidence, parser_used)``."""
    return events(
        invoices, "invoice_processed", F.lit("Invoice processed by OCR"), at,
        {"vendor": F.col("vendor"), "amount": F.col("total"), "confidence": F.col("confidence"), "parser_used": F.col("parser_used")},
        invoice=F.col("invoice_id"),
    )


def match_events(matches: DataFrame, at: Column) -> DataFrame:
    pct = fixed(F.col("match_score") * 100, 2)
    return events(
        matches, "invoice_matched",
        F.concat(F.lit("Invoice matched to transaction (score: "), pct, F.lit("%)")), at,
        {"match_score": F.col("match_score"), "match_type": F.col("match_type")},
        invoice=F.col("invoice_id"), transaction=F.col("transaction_id"),
    )


def alert_events(alerts: DataFrame, at: Column) -> DataFrame:
    return events(
        alerts, "fraud_alert", F.concat(F.lit("Fraud alert: "), "alert_type"), at,
        {n: F.col(n) for n in ("alert_type", "severity", "confidence", "description")},
        invoice=F.col("invoice_id"), status="pending",
    )


def approval_events(decisions: DataFrame, at: Column) -> DataFrame:
    """From ``(invoice_id, user_id, approved, reason)``."""
    ok = F.col("approved")
    return events(
        decisions, F.when(ok, "invoice_approved").otherwise("invoice_rejected"),
        F.when(ok, "Invoice approved").otherwise("Invoice rejected"), at,
        {"approved": ok, "reason": F.col("reason")}, user=F.col("user_id"), invoice=F.col("invoice_id"),
    )


def modification_events(old: DataFrame, new: DataFrame, key: str, fields: list[str], at: Column, user: Column | None = None) -> DataFrame:
    """One event per field that differs between two snapshots of a table."""
    a, b = old.select(key, *[F.col(f).alias(f"_old_{f}") for f in fields]), new.select(key, *fields)
    changed = F.array(
        *[
            F.when(
                ~F.col(f"_old_{f}").eqNullSafe(F.col(f)),
                F.struct(
                    F.lit(f).alias("field_name"),
                    F.coalesce(F.col(f"_old_{f}").cast("string"), F.lit("None")).alias("old_value"),
                    F.coalesce(F.col(f).cast("string"), F.lit("None")).alias("new_value"),
                ),
            )
            for f in fields
        ]
    )
    rows = a.join(b, key).select(key, F.inline(F.array_compact(changed)))
    return events(
        rows, "invoice_modified", F.concat(F.lit("Modified field: "), "field_name"), at,
        {"field_name": F.col("field_name"), "old_value": F.col("old_value"), "new_value": F.col("new_value")},
        user=user, invoice=F.col(key),
    )


def search(
    log: DataFrame, start: str | None = None, end: str | None = None, **equal: str | None
) -> DataFrame:
    """Whole days between ``start`` and ``end`` (inclusive) and equality filters. The day
    filter is on the partition column, so only those days are read."""
    conds = [F.col(name) == value for name, value in equal.items() if value is not None]
    if start is not None:
        conds.append(F.col("event_date") >= F.lit(start[:10]).cast("date"))
    if end is not None:
        conds.append(F.col("event_date") <= F.lit(end[:10]).cast("date"))
    return log.where(reduce(lambda x, y: x & y, conds)) if conds else log


def distinct_events(*logs: DataFrame) -> DataFrame:
    """One row per event of several logs; ids alone may collide, so type and action count."""
    both = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), logs)
    return both.dropDuplicates([c for c in ("entry_id", "event_type", "action") if c in both.columns])


def invoice_history(invoice_id: str, *logs: DataFrame) -> DataFrame:
    return distinct_events(*[search(log, invoice_id=invoice_id) for log in logs]).orderBy(
        F.col("timestamp").desc(), "entry_id"
    )


def events_per_invoice(log: DataFrame) -> DataFrame:
    """How many events, and of how many types, each invoice has."""
    return log.where("invoice_id is not null").groupBy("invoice_id").agg(
        F.count("*").alias("n_events"), F.count_distinct("event_type").alias("n_types")
    )


def user_activity(log: DataFrame, user_id: str, start: str | None = None, end: str | None = None) -> DataFrame:
    return search(log, start, end, user_id=user_id)


def fraud_alert_events(log: DataFrame, severity: str | None = None, start: str | None = None) -> DataFrame:
    found = search(log, start, event_type="fraud_alert")
    if severity is not None:
        found = found.where(F.get_json_object("details", "$.severity") == severity)
    return found


def activity(log: DataFrame) -> DataFrame:
    """``(event_date, user_id, event_type, status, n)``: the part of the log that reports count from. Parts of several logs, or of
    the batches of an ingest, add up: a report merges them and reads no event again."""
    unknown = F.lit("unknown")
    return log.groupBy(
        "event_date", F.coalesce("user_id", unknown).alias("user_id"), F.coalesce("event_type", unknown).alias("event_type"), "status"
    ).agg(F.count("*").alias("n"))


def compliance_of(parts: DataFrame, start: str, end: str, alert_type: str = "fraud_alert") -> DataFrame:
    """One row from ``activity`` parts; users are counted from one row per user."""
    n = F.col("n")
    per_user = search(parts, start, end).groupBy("user_id").agg(
        F.sum(n).alias("n"),
        F.sum(F.when(F.col("status") == "failure", n).otherwise(0)).alias("failed"),
        F.sum(F.when(F.col("event_type") == alert_type, n).otherwise(0)).alias("alerts"),
    )
    return per_user.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.count("*").alias("unique_users"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_events"),
        F.coalesce(F.sum("alerts"), F.lit(0)).alias("fraud_alerts"),
    )


def compliance_summary(log: DataFrame, start: str, end: str, alert_type: str = "fraud_alert") -> DataFrame:
    """One row of counts over whole days."""
    return compliance_of(activity(search(log, start, end)), start, end, alert_type)


def event_labels(spark) -> DataFrame:
    return spark.createDataFrame(list(EVENT_TYPES.items()), "event_type string, label string")


def events_by_type(log: DataFrame, start: str, end: str) -> DataFrame:
    """Counts per type with its label; the label list is a fixed 14 rows and broadcast."""
    counts = search(log, start, end).groupBy(F.coalesce("event_type", F.lit("unknown")).alias("event_type")).agg(
        F.count("*").alias("n")
    )
    labels = event_labels(log.sparkSession)
    return counts.join(F.broadcast(labels), "event_type", "left").withColumn(
        "label", F.coalesce("label", "event_type")
    )


def events_by_user(log: DataFrame, start: str, end: str) -> DataFrame:
    return search(log, start, end).groupBy(F.coalesce("user_id", F.lit("unknown")).alias("user_id")).agg(
        F.count("*").alias("n")
    )


def top_users(log: DataFrame, start: str, end: str, top: int = 10) -> DataFrame:
    return events_by_user(log, start, end).orderBy(F.col("n").desc(), "user_id").limit(top)


def failed_events(log: DataFrame, start: str, end: str, top: int = 50) -> DataFrame:
    return search(log, start, end, status="failure").orderBy("timestamp", "entry_id").limit(top)
