"""Structured Streaming forms of the incremental jobs. Each takes a checkpoint folder and
shares its logic with the batch operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from outlay.config import FraudConfig
from outlay.operators import fraud as R
from outlay.operators.audit import activity
from outlay.session import materialize, workers_find_package
from outlay.sources.files import TIME_FORMAT
from outlay.streaming.fraud_state import answers, asks


def _start(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def batch_path(path: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/batch={batch_id}"


def ingest_audit(stream: DataFrame, path: str, checkpoint: str, activity_path: str | None = None) -> StreamingQuery:
    """Append arriving audit rows. A batch writes its own folder anew, so that a batch that
    is repeated after a failure leaves no row twice. With ``activity_path`` each batch also leaves what reports
    count from (``audit.activity``), so that they need not read the log."""

    def write(rows: DataFrame, batch_id: int) -> None:
        if activity_path is not None:
            activity(rows).write.mode("overwrite").parquet(batch_path(activity_path, batch_id))
        rows.hint("rebalance", "event_date").write.mode("overwrite").partitionBy("event_date").option(
            "timestampFormat", TIME_FORMAT
        ).json(batch_path(path, batch_id))

    return _start(stream, checkpoint, write)


def new_contents(stream: DataFrame, hash_col: str, time_col: str, delay: str) -> DataFrame:
    """The first row of each content hash; state older than the delay is dropped."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([hash_col])


def daily_counts(stream: DataFrame, time_col: str, delay: str) -> DataFrame:
    """Charges per vendor and day, given out once a day is past the delay. Rows that come
    later than that are dropped."""
    return (
        stream.withWatermark(time_col, delay)
        .groupBy(F.window(time_col, "1 day").alias("w"), "vendor")
        .agg(F.count("*").alias("n"))
        .select(F.to_date("w.start").alias("d"), "vendor", "n")
    )


def write_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def score_invoices(
    stream: DataFrame,
    alerts_path: str,
    checkpoint: str,
    transactions: DataFrame | None = None,
    cfg: FraudConfig = FraudConfig(),
) -> StreamingQuery:
    """Score arriving invoices against all earlier ones, whose traces are kept in keyed state.

    A batch reads and shuffles its own invoices only; earlier ones are never read again. Arriving invoices must have
    larger ``seq`` than those of batches before. Alerts of a batch are written to its own folder, so that a repeated
    batch leaves none twice. States keep counts per number, shape, and amount and day, never an invoice.
    """
    schema = stream.schema
    workers_find_package(stream.sparkSession)
    found = answers(asks(stream, cfg), cfg)

    def write(rows: DataFrame, batch_id: int) -> None:
        rows = materialize(rows, "fraud-answers")  # the answers change the state: they are worked out once
        docs = rows.where("rule = 'number'").select("n_before", F.from_json("doc", schema).alias("doc"))
        fresh = materialize(docs.select("doc.*", "n_before"), "fraud-arrived")
        bare = fresh.select(*schema.names)

        def told(rule: str, *more: str) -> DataFrame:
            own = rows.where(F.col("rule") == rule).select("invoice_id", "n_before", *more)
            if rule == "near":  # an invoice asks several cells
                own = own.groupBy("invoice_id").agg(F.sum("n_before").alias("n_before"))
            return R.prepare(bare).join(own, "invoice_id")

        alerts = R.document_alerts(bare, cfg)
        for part in (
            R.duplicate_rows(R.prepare(fresh).where("n_before > 0")),
            R.near_duplicate_rows(told("near"), cfg),
            R.format_rows(told("format", "format")),
            R.amount_rows(told("amount", "mean_before", "std_before", "z")),
        ):
            alerts = alerts.unionByName(part)
        if transactions is not None:
            alerts = alerts.unionByName(R.unpaid_alerts(bare, transactions, cfg))
        R.with_alert_id(alerts).write.mode("overwrite").parquet(batch_path(alerts_path, batch_id))

    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE)
    conf.set(STATE_STORE, ROCKS)
    try:
        return _start(found, checkpoint, write)
    finally:
        conf.set(STATE_STORE, before)
