from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from outlay.operators import audit as U, fraud as R, ml as L
from outlay.sources import files, sinks
from outlay.streaming import jobs as S

LOG = [
    ("e1", "2024-01-01 10:00:00", "invoice_upload", "ann", "i1", "Uploaded", '{"a":1}', "success"),
    ("e1", "2024-01-01 10:00:00", "invoice_processed", "ann", "i1", "Processed", '{"a":2}', "success"),
    ("e2", "2024-01-02 10:00:00", "fraud_alert", "bob", "i1", "Alert", '{"severity":"high"}', "pending"),
    ("e3", "2024-01-03 10:00:00", "odd_type", "bob", "i2", "Other", "{}", "failure"),
]


@pytest.fixture(scope="module")
def log(spark):
    df = spark.createDataFrame(LOG, "entry_id string, t string, event_type string, user_id string, invoice_id string, action string, details string, status string")
    return df.withColumn("timestamp", F.to_timestamp("t")).withColumn("event_date", F.to_date("timestamp")).drop("t")


def test_history_keeps_events_with_colliding_ids(log):
    rows = U.invoice_history("i1", log, log).collect()
    assert [r.event_type for r in rows][0] == "fraud_alert" and len(rows) == 3


def test_reports(log):
    total = U.compliance_summary(log, "2024-01-01T23:00:00", "2024-01-03").first()
    assert tuple(total) == (4, 2, 1, 1)
    labels = {r.event_type: r.label for r in U.events_by_type(log, "2024-01-01", "2024-01-03").collect()}
    assert labels["fraud_alert"] == "Fraud alert triggered" and labels["odd_type"] == "odd_type"
    assert U.user_activity(log, "bob", end="2024-01-02").count() == 1
    assert U.fraud_alert_events(log, "high").count() == 1 and U.fraud_alert_events(log, "low").count() == 0


def test_log_files_round_trip_and_skip_bad_lines(spark, log, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_audit(log, path)
    sinks.append_audit(log.limit(1), path)
    (tmp_path / "log" / "event_date=2024-01-01" / "bad.json").write_text('{"entry_id": "x"\nnot json\n')
    back = files.read_audit(spark, path)
    assert back.count() == 5 and back.where("event_date = date'2024-01-02'").count() == 1


def test_export(spark, log, tmp_path):
    row = sinks.export_audit(log, str(tmp_path / "json"), "json").first()
    assert row.event_type == "export" and '"entry_count":4' in row.details
    assert spark.read.json(str(tmp_path / "json")).count() == 4
    with pytest.raises(ValueError):
        sinks.export_audit(log, str(tmp_path / "x"), "xml")


def test_events_have_stable_content_ids(spark):
    old = spark.createDataFrame([("i1", "a", 1.0), ("i2", "b", 2.0)], "invoice_id string, vendor string, total double")
    new = spark.createDataFrame([("i1", "a", 3.0), ("i2", None, 2.0)], "invoice_id string, vendor string, total double")
    rows = U.modification_events(old, new, "invoice_id", ["vendor", "total"], F.lit("2024-01-01")).collect()
    assert {(r.invoice_id, r.action) for r in rows} == {("i1", "Modified field: total"), ("i2", "Modified field: vendor")}
    assert len({r.entry_id for r in rows}) == 2


def test_csv_scan_finds_missing_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,merchant,amount,desc\n2024-01-01,x,5,hi\n2024-01-01,y,oops,\n")
    assert files.read_transactions(spark, str(tmp_path / "a.csv")).columns == ["date", "vendor", "amount", "description"]
    (tmp_path / "b.csv").write_text("date,amount\n2024-01-01,5\n")
    with pytest.raises(ValueError):
        files.read_transactions(spark, str(tmp_path / "b.csv"))


def test_csv_files_with_other_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,vendor,amount\n2024-01-01,x,5\n")
    (tmp_path / "b.csv").write_text('"amount","date","merchant"\n7,2024-02-02,y\n')
    rows = files.read_transactions(spark, str(tmp_path)).select("date", "vendor", "amount").collect()
    assert sorted(map(tuple, rows)) == [("2024-01-01", "x", "5"), ("2024-02-02", "y", "7")]


def test_csv_headers_are_first_lines(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "a.csv").write_text('\ufeffdate,vendor,amount,note\n2024-01-01,"x, y",5,"say ""hi"""\n\nvendor,date,amount,odd\n2024-01-02,z\n')
    (tmp_path / "b.csv").write_text("amount,desc,merchant,date\r\n7,d,y,2024-02-02,extra\r\n")
    got = files.read_transactions(spark, str(tmp_path))
    assert got.columns == ["amount", "description", "vendor", "date", "note"]
    rows = sorted(map(tuple, got.select("date", "vendor", "amount", "note", "description").collect()), key=str)
    assert rows == [
        ("2024-01-01", "x, y", "5", 'say "hi"', None), ("2024-01-02", "z", None, None, None), ("2024-02-02", "y", "7", None, "d"), ("vendor", "date", "amount", "odd", None),
    ]
    only = tmp_path / "only"
    only.mkdir()
    (only / "e.csv").write_text("")
    assert files.read_transactions(spark, str(only)).count() == 0


def test_audit_files_keep_microseconds(spark, log, tmp_path):
    exact = log.withColumn("timestamp", F.lit("2024-01-01 10:00:00.123456").cast("timestamp"))
    sinks.append_audit(exact, str(tmp_path / "log"))
    got = files.read_audit(spark, str(tmp_path / "log")).select("timestamp").distinct().collect()
    assert [r.timestamp.microsecond for r in got] == [123456]


def test_text_scan_takes_allowed_types_whole(spark, tmp_path):
    (tmp_path / "one.txt").write_text("a\nb")
    (tmp_path / "two.png").write_text("zz")
    rows = files.read_invoice_texts(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.text) for r in rows] == [("one", "a\nb")]


def test_model_agrees_with_its_labels_and_survives_saving(spark, tmp_path):
    words = {"Cloud": ["aws", "azure"], "Travel": ["uber", "hotel"], "Food": ["cafe", "pizza"]}
    rows = [(i, w[i % 2], f"charge {w[(i + 1) % 2]}", float(10 + i % 90), c) for c, w in words.items() for i in range(60)]
    df = spark.createDataFrame(rows, "n int, vendor string, description string, amount double, category string")
    train, test = L.split(df.withColumn("id", F.concat("category", F.col("n").cast("string"))), "id")
    assert train.count() + test.count() == 180 and 15 < test.count() < 60
    model = L.train(train)
    assert L.load(str(tmp_path / "none")) is None
    L.save(model, str(tmp_path / "model"))
    out = L.categorize(test.drop("category"), str(tmp_path / "model"))
    scored = L.predict(L.load(str(tmp_path / "model")), test)
    assert L.accuracy(scored).first().accuracy > 0.95
    assert L.metrics(scored).count() == 3
    assert {r.method for r in out.select("method").distinct().collect()} == {"ML-based"}
    assert out.where("category_confidence > 1 or category_confidence < 0.3").count() == 0


INVOICE = "invoice_id string, seq long, vendor string, invoice_number string, d date, total double, confidence double"


def scored_by_stream(spark, tmp_path, rows, parts, **more):
    src, alerts, cp = (str(tmp_path / n) for n in ("in", "alerts", "cp"))
    for part in parts:
        spark.createDataFrame(part, INVOICE).coalesce(1).write.mode("append").parquet(src)
        job = S.score_invoices(spark.readStream.schema(INVOICE).parquet(src), alerts, cp, **more)
        job.awaitTermination()
    cols = ["invoice_id", "alert_type", "occurrences", "alert_id"]
    got = sorted(map(tuple, spark.read.parquet(alerts).select(*cols).collect()))
    want = sorted(map(tuple, R.alerts(spark.createDataFrame(rows, INVOICE)).select(*cols).collect()))
    return got, want, job


def test_stream_scores_invoices_like_one_batch(spark, tmp_path):
    rows = [(f"i{n}", n, ["Acme", "b", None][n % 3], f"N-{n % 6}", dt.date(2024, 1, 1 + n % 20), 10.0 + n % 3, 0.9) for n in range(40)]
    rows += [(f"j{n}", 40 + n, "Acme", None if n % 2 else f"{'QR'[n % 4 // 2]}{n}", None if n == 3 else dt.date(2024, 2, 1 + n), None if n == 5 else 10.0, 0.4) for n in range(12)]
    rows += [("k1", 60, "acme", "X", dt.date(2024, 3, 1), 9000.0, 0.9), ("k2", 61, "ACME", "X", dt.date(2024, 3, 8), 9000.005, 0.9)]
    got, want, job = scored_by_stream(spark, tmp_path, rows, (rows[:25], rows[25:30], rows[30:]))
    assert got == want and {g[1] for g in got} >= {"duplicate_invoice", "near_duplicate", "inconsistent_invoice_format", "amount_anomaly", "low_ocr_confidence"}
    # the last batch reads its own rows and no earlier ones
    assert job.lastProgress["numInputRows"] == len(rows) - 30


def test_training_rows_are_spread(spark, monkeypatch):
    monkeypatch.setattr(L, "TRAIN_ROWS", 30)
    one = spark.range(100).coalesce(1)
    assert L.spread(one).rdd.getNumPartitions() == 4 and L.spread(one).count() == 100
    assert L.spread(one.where("id < 30")).rdd.getNumPartitions() == 1


def test_texts_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """One file of documents is written by as many tasks as there are documents for."""
    from outlay.plans.catalog import audit

    texts = [f"Invoice {i}\nTotal: {i}.00" for i in range(30)]
    spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(audit, "TEXTS_PER_TASK", 10, raising=False)
    monkeypatch.setattr(audit, "scratch_path", lambda spark, name: str(tmp_path / name))
    rows = audit.scan_invoice_text(spark, str(tmp_path)).collect()
    assert sorted((r.n_chars, r.file_hash) for r in rows) == sorted((len(t) + 1, hashlib.sha256(f"{t}\n".encode()).hexdigest()) for t in texts)
    assert len({f.name.split("-")[1] for f in (tmp_path / "texts").glob("part-*.txt")}) > 1
