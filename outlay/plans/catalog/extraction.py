"""Queries that read invoices back out of rendered text."""

from __future__ import annotations

from pyspark.sql import functions as F

from outlay.functions import invoice_text as X
from outlay.functions.text import money
from outlay.operators import extraction as E
from outlay.plans.fixtures import view, with_views
from outlay.plans.registry import query


def documents(spark, sf):
    """Every invoice of ``v_doc`` as text, with a page mark and a blank line to skip.

    The key chooses how the date, the number and the total are written; some vendors are long.
    """
    kind = F.col("k") % 4
    dated = F.when(kind == 1, F.date_format("d", "yyyy-MM-dd")).when(kind == 2, F.date_format("d", "MMMM d, yyyy"))
    dated = dated.when(kind == 3, F.date_format("d", "yyyy/M/d")).otherwise(F.date_format("d", "MM/dd/yyyy"))
    numbered = F.when(F.col("k") % 3 == 0, "Invoice No: ").when(F.col("k") % 3 == 1, "Reference No: ").otherwise("Invoice #")
    totalled = F.when(F.col("k") % 5 == 1, "Amount due: ").when(F.col("k") % 5 == 2, "Balance due: ").otherwise("Total: ")
    lines = view(spark, sf, "v_lines")
    line = F.concat_ws(
        " ", "description", F.col("quantity").cast("string"),
        F.concat(F.lit("$"), money("unit_price")), F.concat(F.lit("$"), money("line_total")),
    )
    items = lines.groupBy("k").agg(
        F.array_sort(F.collect_list(F.struct("line_no", line.alias("line")))).alias("items")
    )
    docs = view(spark, sf, "v_doc").join(items, "k")
    amount = {n: F.concat(F.lit("$"), money(n)) for n in ("subtotal", "tax", "total")}
    text = F.concat_ws(
        "\n",
        F.lit("--- Page 1 ---"),
        F.col("vendor"),
        F.concat(numbered, "invoice_number"),
        F.concat(F.lit("Date: "), dated),
        F.lit(""),
        F.lit("Description  Qty  Price  Total"),
        F.array_join(F.transform("items", lambda i: i["line"]), "\n"),
        F.concat(F.lit("Subtotal: "), amount["subtotal"]),
        F.concat(F.lit("Tax (5%): "), amount["tax"]),
        F.concat(totalled, amount["total"]),
    )
    return docs.select(F.col("k").alias("doc_id"), text.alias("text"))


def sections(spark, sf):
    return E.with_sections(documents(spark, sf))


def as_of():
    return F.lit("2000-01-01").cast("date")


DOC = "v_doc"


@query(with_views("select k as doc_id, 6 + n_items + case when invoice_number is null then 0 else 1 end as n_lines from v_doc", DOC))
def extract_lines(spark, sf):
    return E.with_lines(documents(spark, sf)).select("doc_id", F.size("lines").alias("n_lines"))


@query(with_views("select k as doc_id, 2 + case when invoice_number is null then 0 else 1 end as n_header, n_items, 3 as n_footer from v_doc", DOC))
def extract_sections(spark, sf):
    return sections(spark, sf).select(
        "doc_id", F.size("header").alias("n_header"), F.size("items").alias("n_items"), F.size("footer").alias("n_footer")
    )


@query(with_views("select k as doc_id, vendor, vendor as fallback_vendor, 0.6 as fallback_confidence from v_doc", DOC))
def extract_vendor(spark, sf):
    rows = E.with_fallback(E.with_header_fields(sections(spark, sf)))
    return rows.select(
        "doc_id", "vendor", F.col("fb_vendor.vendor").alias("fallback_vendor"), F.col("fb_vendor.confidence").alias("fallback_confidence")
    )


# The pattern pass looks for "INV" before "Reference", so it reads such a number behind its letters.
@query(with_views("select k as doc_id, invoice_number, case when k % 3 = 1 then substr(invoice_number, 4) else invoice_number end as fallback_number from v_doc", DOC))
def extract_invoice_number(spark, sf):
    rows = E.with_fallback(E.with_header_fields(sections(spark, sf)))
    return rows.select("doc_id", "invoice_number", F.col("fb_number").alias("fallback_number"))


@query(with_views("select k as doc_id, read_d as d, read_d as fallback_date from v_doc", DOC))
def extract_date(spark, sf):
    rows = E.with_fallback(E.with_header_fields(sections(spark, sf), as_of()), as_of())
    return rows.select("doc_id", "d", F.col("fb_d").alias("fallback_date"))


@query(with_views("select k as doc_id, 3 * count(*) as n_numbers, round(sum(quantity + unit_price + line_total), 2) as sum_numbers from v_lines group by k", "v_lines"))
def extract_numbers(spark, sf):
    rows = E.with_numbers(sections(spark, sf))
    values = F.flatten(F.transform("item_numbers", lambda p: p["numbers"]))
    return rows.select("doc_id", F.size(values).alias("n_numbers"), values.alias("v")).select(
        "doc_id", "n_numbers", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 2).alias("sum_numbers")
    )


ITEMS = "select k as doc_id, description, cast(quantity as double) as quantity, unit_price, line_total as total, {} as confidence from v_lines"


@query(with_views(ITEMS.format("1.0"), "v_lines"))
def extract_line_items(spark, sf):
    return E.item_rows(E.with_items(sections(spark, sf)))


@query(with_views(ITEMS.format("0.7"), "v_lines"))
def extract_fallback_items(spark, sf):
    return E.item_rows(E.with_fallback(documents(spark, sf)), "fb_items")


@query(with_views("select k as doc_id, round(subtotal, 2) as subtotal, round(tax, 2) as tax, round(total, 2) as total from v_doc", DOC))
def extract_totals(spark, sf):
    return E.with_totals(sections(spark, sf)).select("doc_id", "subtotal", "tax", "total")


@query(with_views("select k as doc_id, n_items, round(subtotal, 2) as items_sum from v_doc", DOC))
def extract_valid_items(spark, sf):
    rows = E.with_valid_items(E.with_totals(E.with_items(sections(spark, sf))))
    return rows.select(
        "doc_id", F.size("line_items").alias("n_items"), F.round(E.items_total("line_items"), 2).alias("items_sum")
    )


@query(
    with_views(
        """select k as doc_id, round(0.9 * 0.25 + 0.95 * 0.3 + 0.25 + case when invoice_number is null then 0.05 else 0.09 end
 + case when read_d is null then 0.05 else 0.09 end, 6) as confidence
from v_doc""",
        DOC,
    )
)
def extract_confidence(spark, sf):
    return E.parse_layout(documents(spark, sf), as_of()).select("doc_id", F.round("confidence", 6).alias("confidence"))


@query(
    with_views(
        """select k as doc_id, round(subtotal, 2) as subtotal, round(tax, 2) as tax, round(total, 2) as total,
 round(abs(subtotal + tax - total) / total, 4) as off, abs(subtotal + tax - total) / total >= 0.02 as amounts_differ from v_doc""",
        DOC,
    )
)
def extract_amounts(spark, sf):
    return documents(spark, sf).select("doc_id", X.fallback_amounts(F.col("text")).alias("a")).select("doc_id", "a.*").withColumn(
        "off", F.round("off", 4)
    )


@query(
    """select p_partkey as part_id, regexp_replace(regexp_replace(upper(p_brand[1:2]) || p_brand[3:] || 'Works ' || p_type || 'Co',
 '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Z]{2,})([A-Z][a-z])', '\\1 \\2', 'g') as vendor from part"""
)
def normalize_vendor(spark, sf):
    from outlay.plans.fixtures import load

    raw = F.expr("concat('  ', upper(substring(p_brand, 1, 2)), substring(p_brand, 3), 'Works   ', p_type, 'Co ')")
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("part_id"), X.normalize_vendor(raw).alias("vendor")
    )


@query(
    with_views(
        """with n as (select k, d, 'INV-' || cast(2000 + k % 12 as varchar) || '-' || cast(k as varchar) as number, cast(2000 + k % 12 as varchar) as y from v_doc)
select k as doc_id, case when y <> cast(year(d) as varchar) and y[1:3] = cast(year(d) as varchar)[1:3]
 then 'INV-' || cast(year(d) as varchar) || '-' || cast(k as varchar) else number end as invoice_number from n""",
        DOC,
    )
)
def align_invoice_year(spark, sf):
    number = F.concat(F.lit("INV-"), (F.col("k") % 12 + 2000).cast("string"), F.lit("-"), F.col("k").cast("string"))
    return view(spark, sf, "v_doc").select(F.col("k").alias("doc_id"), X.align_year(number, F.col("d")).alias("invoice_number"))


@query(
    with_views(
        """select k as doc_id, vendor, case when regexp_extract(invoice_number, '20\\d{2}') <> cast(year(read_d) as varchar)
  and regexp_extract(invoice_number, '20\\d{2}')[1:3] = cast(year(read_d) as varchar)[1:3]
  then regexp_replace(invoice_number, '20\\d{2}', cast(year(read_d) as varchar)) else invoice_number end as invoice_number,
 read_d as d, round(total, 2) as total, round(subtotal, 2) as subtotal, round(tax, 2) as tax, n_items,
 case when invoice_number is not null or read_d is not null then 'hybrid' else 'intelligent' end as parser_used from v_doc""",
        DOC,
    )
)
def extract_invoice(spark, sf):
    return E.extract_invoices(documents(spark, sf), as_of()).select(
        "doc_id", "vendor", "invoice_number", "d", "total", "subtotal", "tax", "n_items", "parser_used"
    )


def layouts(spark, sf):
    """Every order as a text in one of eight layouts, chosen by the key; the last one names its vendor in a line about the customer in every other text.

    Labels, kinds of numbers, ways to write dates, items of one to four numbers, cents without a point, items that do not
    add up, a second page, no total, no footer, no items.
    """
    k = F.col("k").cast("string")
    amount = {n: F.concat(F.lit("$"), money(n)) for n in ("s", "t", "g", "y", "z", "rest", "x", "x2", "p")}

    def cents(name):
        return F.concat(F.lit("$"), F.round(F.col(name) * 100).cast("long").cast("string"))

    def line(*parts):
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    def date(pattern):
        return F.date_format("d", pattern)

    head = F.lit("Item  Qty  Price  Total")
    footer = (line("Subtotal: ", amount["s"]), line("Tax: ", amount["t"]), line("Total: ", amount["g"]))
    suffix = F.when(F.dayofmonth("d").isin(1, 21, 31), "st").when(F.dayofmonth("d").isin(2, 22), "nd").when(F.dayofmonth("d").isin(3, 23), "rd").otherwise("th")
    two = (line("gamma rods 2 ", amount["y"], " ", amount["z"]), line("delta kits 1 ", amount["rest"], " ", amount["rest"]))
    kinds = [
        (line("Invoice from: ", F.col("vendor")), line("Invoice No: IN-", k), line("Date: ", date("yyyy.MM.dd")), head,
         line("alpha cable 3 ", amount["x"]), line("beta panel 4 ", amount["x2"]), footer[0], line("VAT (20%): ", amount["t"]), footer[2]),
        (F.col("vendor"), line("PO #: 77-", k), line("Dated: ", date("MMMM d"), suffix, ", ", date("yyyy")), head, *two, *footer[:2]),
        (F.col("vendor"), line("Ref # RF-", k), line("Date: ", date("yyyy-MM-dd")), head, line("service fee ", amount["x"]),
         line("pack 12 lamps 3 ", amount["p"], " ", amount["x2"]), *footer),
        (F.col("vendor"), line("Bill No: BL-", k), line("Issued on ", date("MMM d, yyyy")), head, line("epsilon tubes 2 ", cents("y"), " ", cents("z")),
         line("delta kits 1 ", cents("rest"), " ", cents("rest")), footer[0], line("GST: ", amount["t"]), line("Amount due: ", amount["g"])),
        (F.col("vendor"), line("Inv. ", "#IV", k), line("Date: ", date("MM/dd/yyyy")), head, two[0], *footer),
        (F.lit("Page 1"), F.col("vendor"), line("Invoice #: PG-", k), line("Date: ", date("yyyy/M/d")), head, two[0], F.lit("--- Page 2 ---"), F.lit(""), head, two[1], *footer),
        (F.col("vendor"), line("Order No: ORD-", k), line("Delivered ", date("d MMMM yyyy")), head, *two),
        (F.when(F.col("k") % 16 == 15, line("Customer from: ", F.col("vendor"))).otherwise(F.col("vendor")), line("Invoice #: DC-", k),
         line("Date: ", date("MM/dd/yyyy")), *footer),
    ]
    text = F.lit(None)
    for kind, lines in enumerate(kinds):
        text = F.when(F.col("kind") == kind, F.concat_ws("\n", *lines)).otherwise(text)
    return view(spark, sf, "v_layout").select(F.col("k").alias("doc_id"), text.alias("text"))


@query(
    with_views(
        """with told as (select *, kind = 7 and k % 16 = 15 as bare,
  case kind when 0 then 'IN-' when 1 then '77-' when 2 then 'RF-' when 3 then 'BL-' when 4 then 'IV' when 5 then 'PG-' when 6 then 'ORD-' else 'DC-' end || k as number,
  case kind when 0 then 0.8 when 2 then 0.85 when 7 then 0.4 else 1.0 end as items,
  case kind when 4 then z when 7 then 0 when 2 then round(x + round(3 * p, 2), 2) else s end as items_sum from v_layout),
rated as (select *, case when kind = 0 or bare then 0.3 else 0.9 end * 0.25 + case when kind in (1, 6, 7) then 0.3 else 0.95 end * 0.3 + items * 0.25
  + case when kind in (1, 4, 6) then 0.05 else 0.09 end + case when kind in (1, 6) or read_d is null then 0.05 else 0.09 end as confidence from told)
select k as doc_id, vendor, case when regexp_extract(number, '20\\d{2}') <> cast(year(read_d) as varchar)
  and regexp_extract(number, '20\\d{2}')[1:3] = cast(year(read_d) as varchar)[1:3]
  then regexp_replace(number, '20\\d{2}', cast(year(read_d) as varchar)) else number end as invoice_number, read_d as d,
 case kind when 1 then s when 6 then greatest(z, rest) else g end as total, case kind when 4 then s when 7 then s else items_sum end as subtotal,
 case kind when 6 then null else t end as tax, case kind when 4 then 1 when 7 then 0 else 2 end as n_items, items_sum, round(confidence, 6) as confidence,
 case when confidence < 0.5 then 'fallback' else 'hybrid' end as parser_used from rated""",
        "v_layout",
    )
)
def extract_layouts(spark, sf):
    return E.extract_invoices(layouts(spark, sf), as_of()).select(
        "doc_id", "vendor", "invoice_number", "d", "total", F.round("subtotal", 2).alias("subtotal"), "tax", "n_items", "items_sum",
        F.round("confidence", 6).alias("confidence"), "parser_used",
    )
