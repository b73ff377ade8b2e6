"""Writing audit logs and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from outlay.operators.audit import events
from outlay.sources.files import TIME_FORMAT

EXPORT_FORMATS = ("csv", "json")


def append_audit(rows: DataFrame, path: str) -> None:
    """Append audit rows below ``event_date=...``. Rebalancing gathers a day into few files
    and, unlike a repartition by day, splits a day that holds much of the data."""
    rows.hint("rebalance", "event_date").write.mode("append").partitionBy("event_date").option("timestampFormat", TIME_FORMAT).json(path)


def export_audit(log: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """Write the log as ``csv`` or ``json`` and return the audit row of the export itself."""
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"Unsupported format: {fmt}")
    if fmt == "csv":
        log.write.option("header", True).option("escape", '"').option("timestampFormat", TIME_FORMAT).csv(path)
    else:
        log.write.option("timestampFormat", TIME_FORMAT).json(path)
    n = log.agg(F.count("*").alias("entry_count"))
    return events(
        n,
        "export",
        F.concat(F.lit("Exported audit log ("), F.col("entry_count").cast("string"), F.lit(" entries)")),
        F.current_timestamp(),
        {"output_path": F.lit(path), "format": F.lit(fmt), "entry_count": F.col("entry_count")},
    )
