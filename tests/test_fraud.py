from __future__ import annotations

import datetime as dt
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from outlay.config import FraudConfig
from outlay.operators import contained, fraud as R

DAY = dt.date(2024, 1, 1)
SCHEMA = "invoice_id string, seq long, vendor string, invoice_number string, d date, total double, subtotal double, tax double, items_sum double, n_items int, confidence double"


def invoice(i, seq, vendor="acme", number=None, day=DAY, total=10.0, subtotal=None, tax=None, items=None, n_items=0, confidence=0.9):
    return (f"i{i}", seq, vendor, number, day, total, subtotal, tax, items, n_items, confidence)


def shape(s):
    return re.sub(r"\d", "N", re.sub("[a-zA-Z]", "A", s))


def loop_history(rows):
    """Per invoice: duplicates, near duplicates, new format, amount anomaly."""
    out = {}
    for a in rows:
        before = [b for b in rows if b[1] < a[1] and b[2] == a[2]]
        dup = sum(1 for b in before if a[3] and a[3] == b[3])
        near = sum(
            1 for b in before
            if a[5] and b[5] and a[4] and b[4] and abs(a[5] - b[5]) < 0.01 and abs((a[4] - b[4]).days) <= 7
        )
        numbered = [b[3] for b in before if b[3]]
        fmt = bool(len(before) >= 3 and numbered and a[3] and shape(a[3]) not in map(shape, numbered))
        past = [b[5] for b in before if b[5] is not None]
        odd = False
        if len(past) >= 3 and a[5] is not None and min(past) < max(past):
            odd = abs(a[5] - statistics.mean(past)) / statistics.pstdev(past) > 3
        out[a[0]] = (dup, near, int(fmt), int(odd))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_history_rules_equal_the_loops(spark, seed):
    rnd = random.Random(seed)
    order = rnd.sample(range(10_000), 220)
    rows = [
        invoice(
            i, order[i], rnd.choice(["hot", "hot", "hot", "b"]), rnd.choice([None, "INV-1", "INV-2", "X9", "A-12"]),
            rnd.choice([None, DAY, DAY, DAY + dt.timedelta(days=rnd.randrange(30))]),
            rnd.choice([10.0, 10.0, 10.005, 10.01, 11.0, 12.0, 400.0, None, 0.0]),
        )
        for i in range(220)
    ]
    # A group of copies whose members arrive between each other.
    rows += [invoice(500 + i, 20_000 + i, "copies", "C-1", DAY + dt.timedelta(days=i % 2), 99.0) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    got = {r[0]: [0, 0, 0, 0] for r in rows}
    for at, found in enumerate([R.duplicate_alerts(df), R.near_duplicate_alerts(df), R.format_alerts(df), R.amount_alerts(df)]):
        for r in found.collect():
            got[r.invoice_id][at] += r.occurrences
    assert {k: tuple(v) for k, v in got.items()} == loop_history(rows)


def test_document_rules_and_risk(spark):
    rows = [
        invoice(1, 1, "Test Company", "INV-001", total=1000.0, subtotal=900.0, tax=100.0, items=900.0, n_items=1, confidence=0.95),
        invoice(2, 2, "fine", "N1", total=102.0, subtotal=90.0, tax=10.0, items=94.5, n_items=2),
        invoice(3, 3, "fine", "N2", total=102.1, subtotal=90.0, tax=10.0, items=94.6, n_items=2, confidence=0.49),
        invoice(4, 4, "", None, None, 0.0),
        invoice(5, 5, "fine", "N3", total=999.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    alerts = R.document_alerts(df).cache()
    kinds = {}
    for r in alerts.collect():
        kinds.setdefault(r.invoice_id, set()).add(r.alert_type)
    assert kinds == {
        "i1": {"suspicious_round_amount", "suspicious_vendor_name"},
        "i3": {"calculation_mismatch", "line_items_mismatch", "low_ocr_confidence"},
        "i4": {"missing_critical_fields"},
    }
    missing = alerts.where("alert_type = 'missing_critical_fields'").first()
    assert missing.evidence[0] == "Missing fields: vendor, invoice_number, date, total_amount"
    risk = {r.invoice_id: r for r in R.risk(df, alerts).collect()}
    assert abs(risk["i1"].risk_score - 26.0) < 1e-9 and risk["i1"].risk_level == "medium"
    assert risk["i2"].risk_score == 0.0 and risk["i2"].alert_count == 0 and risk["i2"].risk_level == "low"


def test_risk_is_capped_and_counts_every_earlier_copy(spark):
    rows = [invoice(i, i, "v", "N-1", total=50.0 + i) for i in range(5)]
    df = spark.createDataFrame(rows, SCHEMA)
    risk = {r.invoice_id: r for r in R.risk(df, R.duplicate_alerts(df)).collect()}
    assert [risk[f"i{i}"].alert_count for i in range(5)] == [0, 1, 2, 3, 4]
    assert [risk[f"i{i}"].risk_score for i in range(5)] == [0.0, 40.0, 80.0, 100.0, 100.0]


def test_unpaid_equals_the_loop(spark):
    rnd = random.Random(3)
    names = ["abcdefghijkl", "abcdefghijxy", "xabcdefghijz", "short", "a", "ab.c", "other name"]
    rows = [invoice(i, i, rnd.choice(names + [""]), "n", DAY + dt.timedelta(days=rnd.randrange(300)), 5.0) for i in range(80)]
    pays = [(rnd.choice(names + [None]), DAY + dt.timedelta(days=rnd.randrange(300))) for _ in range(25)]
    df = spark.createDataFrame(rows, SCHEMA)
    txn = spark.createDataFrame(pays, "vendor string, d date")
    for chars in (10, None):
        want = {
            r[0] for r in rows
            if r[2] and not any(v and r[2][:chars] in v and abs((d - r[4]).days) <= 30 for v, d in pays)
        }
        assert {r.invoice_id for r in R.unpaid(df, txn, FraudConfig(vendor_chars=chars)).collect()} == want


def test_invoice_format(spark):
    df = spark.createDataFrame([("INV-001",), ("a1 B2",)], "n string")
    assert [r[0] for r in df.select(R.invoice_format("n")).collect()] == ["AAA-NNN", "AN AN"]


def test_lookup_reads_one_bucket(spark, tmp_path):
    rows = spark.range(500).select(F.concat(F.lit("inv"), F.col("id").cast("string")).alias("invoice_id"), F.col("id").cast("double").alias("risk_score"))
    table = R.keep_results(rows, str(tmp_path / "kept"))
    found = R.result_of(spark, table, "inv77")
    assert [r.risk_score for r in found.collect()] == [77.0] and R.result_of(spark, table, "none").collect() == []
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan does not tell
    plan = R.result_of(spark, table, "inv77")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert "SelectedBucketsCount: 1 out of 8" in plan
    spark.sql(f"drop table {table}")


@pytest.mark.parametrize("size", [4_000_000, 8, 1])
def test_names_inside_texts(spark, monkeypatch, size):
    monkeypatch.setattr(contained, "TEXTS", 5)
    rng = random.Random(size)
    texts = {"".join(rng.choice("abç ") for _ in range(rng.randrange(0, 12))) for _ in range(60)}
    names = {"".join(rng.choice("abç ") for _ in range(rng.randrange(0, 4))) for _ in range(25)}
    one, two = ([(x,) for x in (*sorted(s), None)] for s in (texts, names))
    found = contained.contained_names(spark.createDataFrame(one, "text string"), spark.createDataFrame(two, "name string"), size).collect()
    assert sorted(map(tuple, found)) == sorted((t, n) for t in texts for n in names if n and n in t)
