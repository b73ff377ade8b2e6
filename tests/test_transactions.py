from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from outlay.operators import actions as C, anomalies as A, insights as I, transactions as T
from outlay.session import materialize

DAY = dt.date(2024, 1, 1)
SCHEMA = "id string, seq long, vendor string, category string, amount double, d date"


def table(spark, rows):
    return spark.createDataFrame([(f"t{i}", i, *r) for i, r in enumerate(rows)], SCHEMA)


def loop_flags(rows):
    """The rules as plain loops over rows (vendor, category, amount, date)."""
    amounts = [r[2] for r in rows]
    mean, std = statistics.mean(amounts), max(statistics.stdev(amounts), 1e-6)
    out = [set() for _ in rows]
    for i, (vendor, category, amount, day) in enumerate(rows):
        if (amount - mean) / std > 2.5:
            out[i].add("global_outlier")
        same = [r[2] for r in rows if r[1] == category]
        if len(same) >= 5:
            sd = statistics.stdev(same)
            if sd and (amount - statistics.mean(same)) / sd > 2.0:
                out[i].add("category_outlier")
        others = [r[2] for j, r in enumerate(rows) if r[0] == vendor and j != i]
        if others and amount > 3 * statistics.mean(others):
            out[i].add("historical_outlier")
        for j in range(i + 1, len(rows)):
            v2, _, a2, d2 = rows[j]
            if v2 == vendor and day and day == d2 and abs(amount - a2) / amount < 0.05:
                out[i].add("duplicate")
                out[j].add("duplicate")
        per_day = {}
        for v, _, _, d in rows:
            if v == vendor and d:
                per_day[d] = per_day.get(d, 0) + 1
        if day and len(per_day) > 1 and per_day[day] > 2 * statistics.mean(per_day.values()):
            out[i].add("frequency_spike")
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_flags_equal_the_loops(spark, seed):
    rnd = random.Random(seed)
    rows = [
        (
            rnd.choice(["hot", "hot", "hot", "b", "c"]),
            rnd.choice("xyz"),
            rnd.choice([100.0, 105.0, 95.0, 95.24, 104.99, 99.0, 110.25, 500.0, 5000.0, round(rnd.uniform(80, 130), 2)]),
            rnd.choice([None] + [DAY + dt.timedelta(days=n) for n in (0, 0, 0, 1, 2)]),
        )
        for _ in range(150)
    ]
    scored = A.score(table(spark, rows)).collect()
    want = loop_flags(rows)
    assert len(scored) == len(rows)
    for r in scored:
        assert set(r.flags) == want[r.seq], (r, want[r.seq])
        points = sum(A.POINTS[f] for f in r.flags)
        assert r.anomaly_score == min(points, 10) and r.is_anomaly == (points >= 5)
        assert len(r.anomaly_reasons) == len(r.flags)


def test_duplicate_boundary_depends_on_the_earlier_row(spark):
    def flagged(a, b):
        return A.duplicates(table(spark, [("v", "x", a, DAY), ("v", "x", b, DAY)])).count() == 2

    assert not flagged(100.0, 105.0) and flagged(105.0, 100.0)
    assert flagged(100.0, 104.99) and not flagged(100.0, 95.0)


def test_cleaning_and_features(spark):
    raw = spark.createDataFrame(
        [
            ("2024-01-01", "  AWS ", "10.5", None),
            ("03/28/2026", "b", "1e3", "x"),
            ("bad", None, "7", "y"),
            ("2024-01-01 13:05:00", "c", "5", ""),
            ("2024-01-01", "d", "-1", ""),
            ("2024-01-01", "d", "nan", ""),
            ("2024-01-01", "d", "1.5d", ""),
            ("2024-01-01", "d", None, ""),
        ],
        "date string, merchant string, amount string, desc string",
    )
    rows = {r.vendor: r for r in T.engineer_features(T.clean(raw)).collect()}
    assert set(rows) == {"aws", "b", "unknown", "c"}
    assert rows["aws"].description == "" and rows["aws"].day_of_week == 0 and rows["aws"].hour == 0
    assert rows["b"].d == dt.date(2026, 3, 28) and rows["b"].amount == 1000.0
    assert rows["unknown"].d is None and rows["unknown"].hour == -1
    assert rows["c"].hour == 13
    report = T.input_report(T.alias_columns(raw)).first()
    assert (report.n_raw, report.n_null_amount, report.n_bad_amount, report.n_not_positive, report.n_clean) == (8, 1, 2, 1, 4)
    with pytest.raises(ValueError):
        T.input_report(raw.drop("date"))


def test_keyword_categories(spark):
    rows = [("Adobe Creative Cloud", "", 99.0), ("uber", "taxi ride", 10.0), ("acme", "", 6000.0), ("acme", "", 5000.0), ("aws", "aws aws", 1.0)]
    df = spark.createDataFrame(rows, "vendor string, description string, amount double")
    got = [r.category for r in T.categorize_keywords(df).collect()]
    assert got == ["Miscellaneous", "Travel", "Operations", "Miscellaneous", "Cloud Services"]
    whole = T.categorize_keywords(
        spark.createDataFrame([("current", "", 1.0)], "vendor string, description string, amount double"), whole_words=True
    )
    assert whole.first().category == "Miscellaneous"


def test_next_index(spark):
    ids = spark.createDataFrame([("txn_007",), ("txn_1200",), ("other",)], "id string")
    assert T.next_index(ids).first()[0] == 1201
    assert T.next_index(ids.where("id = 'other'")).first()[0] == 1
    assert T.next_index(ids.limit(0)).first()[0] == 0


def test_subscription_gap_boundaries(spark):
    def rows(vendor, gaps, amounts=None):
        days, at = [DAY], DAY
        for g in gaps:
            at += dt.timedelta(days=g)
            days.append(at)
        return [(vendor, "x", (amounts or [50.0] * 9)[i], d) for i, d in enumerate(days)]

    data = (
        rows("ok", [25, 35, 30]) + rows("short", [24, 30]) + rows("long", [30, 36]) + rows("two", [30])
        + rows("wild", [30, 30], [50.0, 60.0, 40.0]) + [("twice", "x", 5.0, DAY)] * 2 + rows("twice", [30, 30])
    )
    assert {r.vendor for r in I.subscription_vendors(table(spark, data)).collect()} == {"ok"}


def test_actions_and_decisions(spark):
    rows = [("v", "x", 10.0, DAY)] * 3 + [("w", "x", 12.0, DAY + dt.timedelta(days=i)) for i in range(60)] + [("w", "x", 900.0, DAY)]
    scored = materialize(A.score(table(spark, rows)), "scored")
    acts = C.actions(scored, I.insights(scored)).cache()
    first = acts.where("type = 'review'").first()
    assert first.target == "t63" and first.priority == "high" and first.auto_executable
    decisions = spark.createDataFrame(
        [(first.id, "execute", 2), (first.id, "dismiss", 3), ("act_002", "execute", 1)], "id string, decision string, decided_at int"
    )
    done = {r.id: r for r in C.apply_decisions(acts, decisions).collect()}
    assert done[first.id].status == "executed" and done[first.id].n_rejected == 1
    assert done["act_002"].status == "pending" and done["act_002"].rejected == "not auto-executable"
    tagged = C.tag_transactions(scored, C.apply_decisions(acts, decisions)).where(F.size("tags") > 0)
    assert [r.id for r in tagged.collect()] == ["t63"]


def test_records_clean_nested_values(spark):
    df = spark.sql("select struct(double('nan') as x, array(double('nan'), 1.5D) as y) as s, map('k', date'2024-01-02') as m, cast(null as struct<z: double>) as n")
    assert T.records(df).first().record == '{"s":{"x":null,"y":[null,1.5]},"m":{"k":"2024-01-02"},"n":null}'


def test_pages_follow_the_input_order(spark):
    df = T.assign_ids(spark.range(1100).selectExpr("id as seq", "'a' as category", "true as is_anomaly"), "seq")
    page = T.page(df, page_no=3).collect()
    assert [r.seq for r in page] == list(range(100, 150)) and page[0].id == "txn_100"
    assert [r.seq for r in T.page(df, after=1049).collect()] == list(range(1050, 1100))
    blocks = T.page_blocks(df, 100)
    assert 8 <= len(blocks) <= 12 and sum(n for _, _, n in blocks) == 1100
    for page_no, want in ((1, range(50)), (13, range(600, 650)), (22, range(1050, 1100)), (23, range(0))):
        rows = T.page(df, page_no=page_no, blocks=blocks).collect()
        assert [r.seq for r in rows] == list(want) and {(r.total_count, r.total_pages) for r in rows} <= {(1100, 22)}
    assert T.page(df.where("false")).collect() == []


def test_new_documents_read_known_hashes_where_they_lie(spark, monkeypatch):
    arriving = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, None)], "doc_id int, content string")
    known = spark.createDataFrame([("b",), ("x",), ("b",), (None,)], "content string").select(F.sha2("content", 256).alias("file_hash"))
    want = sorted([(1, 2), (4, 1), (5, 1)])
    for few in (T.ARRIVING_FEW, 0):
        monkeypatch.setattr(T, "ARRIVING_FEW", few)
        assert sorted((r.doc_id, r.copies) for r in T.new_documents(arriving, known).collect()) == want
    plan = T.new_documents(arriving, known)._jdf.queryExecution().toString()
    assert T.new_documents(arriving.where("false"), known).collect() == [] and "LeftAnti" in plan


def test_ranges_of_pages_are_searched_not_compared(spark, monkeypatch):
    monkeypatch.setattr(T.F, "filter", None)  # a filter over all cuts costs rows times ranges
    rows = spark.range(3000).selectExpr("case when id % 100 = 7 then null else id div 2 end as seq")
    blocks = T.page_blocks(rows, 10)
    assert 250 <= len(blocks) <= 301 and sum(n for _, _, n in blocks) == 3000
    assert blocks[0][0] == 0 and blocks[-1][1] == 1499 and all(a[1] < b[0] for a, b in zip(blocks, blocks[1:]))
