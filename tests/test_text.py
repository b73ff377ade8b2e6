from __future__ import annotations

import datetime as dt
import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from outlay.functions import invoice_text as X
from outlay.functions.similarity import close_names
from outlay.operators import extraction as E

INVOICE = """
    Nordlicht Druckerei GmbH
    Hafenweg 7, 24103 Kiel

    Invoice #: ND-2024-0317
    Date: 2024-04-09

    Ship To: Museum Foundation

    Description                          Qty    Price    Total
    ----------------------------------------------------------------
    Exhibition Posters                   25     $18      $450
    Catalogue Reprint                    3      $220     $660
    Courier                              1      $42      $42

    Sub-Total:                                           $1,152
    VAT (19%):                                           $218.88
    Amount due:                                          $1,370.88
    """

def as_of():
    return F.lit("2024-06-01").cast("date")


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")


def test_whole_invoice(spark):
    row = E.extract_invoices(docs(spark, INVOICE), as_of()).first()
    assert (row.vendor, row.invoice_number, row.d) == ("Nordlicht Druckerei Gmb H", "ND-2024-0317", dt.date(2024, 4, 9))
    assert (row.total, row.subtotal, row.tax, row.items_sum) == (1370.88, 1152.0, 218.88, 1152.0)
    assert [(i.quantity, i.unit_price, i.total) for i in row.line_items] == [(25.0, 18.0, 450.0), (3.0, 220.0, 660.0), (1.0, 42.0, 42.0)]
    assert row.parser_used == "hybrid"


def test_poor_and_empty_texts(spark):
    rows = E.extract_invoices(
        docs(spark, "", "From: Some Vendor Inc\nRef: AB-77\nDated 3 May 2023\npay $1,200.50 now\nwidget 2 $10.00", "---\n12\nhi"), as_of()
    ).collect()
    assert rows[0].vendor == "Unknown" and rows[0].total is None and rows[0].n_items == 0
    assert rows[1].invoice_number == "AB-77" and rows[1].d == dt.date(2023, 5, 3)
    assert rows[1].total == 1200.5
    assert [(i.description, i.quantity, i.total) for i in rows[1].line_items][-1] == ("widget", 2.0, 20.0)
    assert rows[2].vendor == "Unknown"


def test_nothing_is_cut_or_capped(spark):
    vendor = "Gesellschaft " + "fuer sehr lange Namen " * 3 + "mbH"
    number = "ORD-" + "7" * 40
    row = E.with_fallback(docs(spark, f"{vendor}\nOrder No: {number}\npay $2,500,000.00"), as_of()).first()
    assert row.fb_vendor.vendor == vendor and row.fb_number == number and row.fb_amounts.total == 2_500_000.0
    off = E.with_fallback(docs(spark, "Subtotal: 100.00\nTax: 10.00\nTotal: 150.00", "Total: 5.00"), as_of()).select("fb_amounts").collect()
    assert sorted(r[0].amounts_differ for r in off) == [False, True]


def test_header_dates_with_the_year_first_and_their_window(spark):
    texts = ["Date: 2024-03-28", "Date: 2024/3/8", "x 2023-12-31 y", "Date: 03/28/2024", "Date: 2028-03-24", "Date: 1/2/1999", "2024-13-45"]
    rows = docs(spark, *[f"Some Name\n{t}" for t in texts])
    got = E.with_header_fields(E.with_sections(rows), as_of()).orderBy(F.col("doc_id").cast("int")).select("d").collect()
    assert [r.d for r in got] == [dt.date(2024, 3, 28), dt.date(2024, 3, 8), dt.date(2023, 12, 31), dt.date(2024, 3, 28), None, None, None]


def test_sections_of_several_tables(spark):
    text = "Total note\nName\nItem Qty Price\na 1\nb 2\nSubtotal 3\nthanks\nItem Qty Price\nc 4\nTotal 9\nend"
    row = E.with_sections(docs(spark, text, "")).orderBy("doc_id").collect()
    assert row[0].header == ["Total note", "Name"] and row[0]["items"] == ["a 1", "b 2", "c 4"]
    assert row[0].footer == ["Subtotal 3", "thanks", "Total 9", "end"]
    assert row[1].header == row[1]["items"] == row[1].footer == []


def test_dates(spark):
    cases = {
        "03/28/2024": dt.date(2024, 3, 28), "28/03/2024": dt.date(2024, 3, 28), "2024-3-8": dt.date(2024, 3, 8),
        "due Mar 5, 2021 or so": dt.date(2021, 3, 5), "5 September 2020": dt.date(2020, 9, 5), "1/2/24": dt.date(2024, 1, 2),
        "28.03.2024": dt.date(2024, 3, 28), "on 2024.03.28.": dt.date(2024, 3, 28), "March 5th, 2024": dt.date(2024, 3, 5), "3rd of May 2021": dt.date(2021, 5, 3),
        "21st August 2022": dt.date(2022, 8, 21), "version 1.2.24": None, "1.2.3.2024": None,
        "1/2/99": dt.date(1999, 1, 2), "2024": None, "24": None, "45/45/2024": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.d for r in df.select("t", X.parse_date(F.col("t")).alias("d")).collect()} == cases


def test_numbers_and_roles(spark):
    lines = {
        "Thing 3 $10.00 $30.00": ([3.0, 10.0, 30.0], (3.0, 10.0, 30.0)),
        "Thing 3 $10.00 $31.00": ([3.0, 10.0, 31.0], (3.0, 10.0, 30.0)),
        "Thing 7 $10.00 $31.00": ([7.0, 10.0, 31.0], (None, 10.0, 31.0)),
        "Thing 5 $20.00": ([5.0, 20.0], (5.0, None, 20.0)),
        "Thing $15.00 $20.00": ([15.0, 20.0], (None, 15.0, 20.0)),
        "Thing $1500": ([15.0], (None, None, 15.0)),
        "Thing $1,500": ([1500.0], (None, None, 1500.0)),
        "9 Thing 2 $4.00 $8.00": ([9.0, 2.0, 4.0, 8.0], (2.0, 4.0, 8.0)),
    }
    df = spark.createDataFrame([(t,) for t in lines], "t string").select("t", X.numbers_in(F.col("t")).alias("n"))
    for r in df.select("t", "n", X.line_item(F.col("t"), F.col("n")).alias("i")).collect():
        numbers, roles = lines[r.t]
        assert r.n == numbers
        assert (r.i.quantity, r.i.unit_price, r.i.total) == roles, r.t


def test_vendor_and_number_repair(spark):
    df = spark.createDataFrame([("  AcmeCorp  XYZWorks ", "INV-2023-20245", dt.date(2024, 1, 1)), ("a", "INV-1999", None)], "v string, n string, d date")
    got = df.select(X.normalize_vendor(F.col("v")), X.align_year(F.col("n"), F.col("d"))).collect()
    assert tuple(got[0]) == ("Acme Corp XYZ Works", "INV-2024-20245") and got[1][1] == "INV-1999"


def test_close_names_misses_no_pair(spark):
    rnd = random.Random(4)
    names = {"".join(rnd.choice("abcd ") for _ in range(rnd.randrange(1, 14))).strip() or "a" for _ in range(150)}
    for name in list(names)[:80]:
        at = rnd.randrange(len(name))
        names.add((name[:at] + rnd.choice(["", "x", "ab"]) + name[at + 1:]).strip() or "b")
    df = spark.createDataFrame([(n,) for n in sorted(names)], "a string")
    got = {(r.a, r.b) for r in close_names(df, df.withColumnRenamed("a", "b"), "a", "b", "ratcliff").collect()}
    want = {(a, b) for a in names for b in names if SequenceMatcher(None, a, b).ratio() >= 0.8}
    assert got == want


def test_later_patterns_are_read_only_where_earlier_fail(spark):
    read = []

    def reading(group):
        read.append(group)
        return F.when(group != "13", group)

    df = spark.createDataFrame([("a 13 b 7",), ("a 5",), (None,), ("x",)], "t string")
    got = X.first_read(F.col("t"), (r"a (\d+)", r"b (\d+)"), reading, lambda v: v.isNotNull())
    assert [r[0] for r in df.select(got).collect()] == ["7", "5", None, None]
    plan = df.select(X.header_date(F.col("t"), F.lit("2024-01-01").cast("date")))._jdf.queryExecution().analyzed().toString()
    assert "coalesce" in plan and len(read) == 2
