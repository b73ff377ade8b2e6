"""Invoice fields from text. Input ``(doc_id, text)``; one row per document throughout.

A document's lines are an array in its row, so that sections, items and totals are found
without exploding, shuffling or ordering anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from outlay.functions import invoice_text as X


def with_lines(docs: DataFrame) -> DataFrame:
    return docs.withColumn("lines", X.lines_of(F.col("text")))


def with_sections(docs: DataFrame) -> DataFrame:
    """Add ``header``, ``items`` and ``footer`` lines.

    A table head starts the items and is dropped; after it a line about totals starts the
    footer, until another table head comes.
    """
    marked = with_lines(docs).withColumn(
        "_marks",
        F.transform(
            "lines",
            lambda s: F.when(X.is_table_head(s), "head").when(s.rlike(X.TOTAL_WORDS), "total").otherwise(""),
        ),
    )
    n = F.size("lines")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def change(i: Column) -> Column:
        """Where a new section starts: a table head, and the first total after one."""
        return F.get("_marks", i) != ""

    places = marked.withColumn("_at", F.filter(at, change))
    after = F.transform("_at", lambda i, j: F.coalesce(F.get("_at", j + 1), n))
    runs = places.withColumn(
        "_runs",
        F.zip_with("_at", after, lambda i, end: F.struct(i.alias("at"), end.alias("end"), F.get("_marks", i).alias("mark"))),
    )

    def lines(start: Column, end: Column) -> Column:
        return F.slice("lines", start + 1, end - start)

    # Totals ahead of the first head belong to the header.
    first = F.coalesce(F.get(F.filter("_runs", lambda r: r["mark"] == "head"), F.lit(0))["at"], n)
    runs = runs.withColumn("_first", first).withColumn("_runs", F.filter("_runs", lambda r: r["at"] >= F.col("_first")))
    items = F.transform(F.filter("_runs", lambda r: r["mark"] == "head"), lambda r: lines(r["at"] + 1, r["end"]))
    footer = F.transform(F.filter("_runs", lambda r: r["mark"] == "total"), lambda r: lines(r["at"], r["end"]))
    return (
        runs.withColumn("header", lines(F.lit(0), F.col("_first")))
        .withColumn("items", F.flatten(items))
        .withColumn("footer", F.flatten(footer))
        .drop("_marks", "_at", "_runs", "_first")
    )


def _last(values: Column) -> Column:
    return F.try_element_at(F.array_compact(values), F.lit(-1))


def with_header_fields(sections: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Add ``vendor`` (first line like a name), ``invoice_number`` and ``d`` (last line wins).

    Dates are judged as of ``as_of``, today where it is not given."""
    day = F.current_date() if as_of is None else as_of
    named = F.filter("header", lambda s: (F.length(s) >= 4) & ~s.rlike(X.HEADER_NOISE))
    return (
        sections.withColumn("vendor", F.get(named, F.lit(0)))
        .withColumn("invoice_number", _last(F.transform("header", X.header_number)))
        .withColumn("d", _last(F.transform("header", lambda s: X.header_date(s, day))))
    )


def with_numbers(sections: DataFrame) -> DataFrame:
    """Add ``item_numbers``: per item line its text and numbers."""
    lines = F.filter(
        "items", lambda s: (F.length(s) >= 3) & ~s.rlike(X.HEADER_NOISE) & ~s.rlike(X.NON_ITEM)
    )
    pairs = F.transform(lines, lambda s: F.struct(s.alias("line"), X.numbers_in(s).alias("numbers")))
    return sections.withColumn("item_numbers", F.filter(pairs, lambda p: F.size(p["numbers"]) > 0))


def with_items(sections: DataFrame) -> DataFrame:
    """Add ``line_items`` parsed from the item lines."""
    items = F.transform("item_numbers", lambda p: X.line_item(p["line"], p["numbers"]))
    return with_numbers(sections).withColumn(
        "line_items", F.filter(items, lambda i: F.length(i["description"]) >= 2)
    ).drop("item_numbers")


def item_rows(docs: DataFrame, items: str = "line_items") -> DataFrame:
    """One row per line item.

    The outer form keeps Spark from copying the parse into an inferred size filter, which
    makes planning explode; the row of an itemless document is dropped afterwards.
    """
    return docs.select("doc_id", F.inline_outer(items)).where("total is not null")


def with_totals(sections: DataFrame) -> DataFrame:
    """Add ``subtotal, tax, total``: the last number of the first footer line of each kind."""
    numbered = F.filter(
        F.transform("footer", lambda s: F.struct(s.alias("line"), X.numbers_in(s).alias("numbers"))),
        lambda p: F.size(p["numbers"]) > 0,
    )

    def amount(cond) -> Column:
        first = F.get(F.filter("_numbered", lambda p: cond(p["line"])), F.lit(0))["numbers"]
        return F.try_element_at(first, F.lit(-1))

    return (
        sections.withColumn("_numbered", numbered)
        .withColumn("subtotal", amount(lambda s: s.rlike(X.SUBTOTAL)))
        .withColumn("tax", amount(lambda s: s.rlike(X.TAX) & ~s.rlike(X.SUBTOTAL)))
        .withColumn("total", amount(lambda s: s.rlike(X.TOTAL) & ~s.rlike(X.SUBTOTAL) & ~s.rlike(X.TAX)))
        .drop("_numbered")
    )


def items_total(items: str | Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, i: acc + F.coalesce(i["total"], F.lit(0.0)))


def with_valid_items(parsed: DataFrame) -> DataFrame:
    """Keep all items when they add up to the total, else only the trustworthy ones."""
    target = F.coalesce("total", "subtotal")
    adds_up = F.coalesce(F.try_divide(F.abs(items_total("line_items") - target), target) < 0.05, F.lit(False))
    floor = F.when(adds_up, 0.0).when(target > 0, 0.6).otherwise(0.5)
    # bound to a variable, as the optimizer would put the floor's expression into the filter, to be computed for each item
    known = F.array(F.struct(F.col("line_items").alias("items"), floor.alias("floor")))
    kept = F.transform(known, lambda p: F.filter(p["items"], lambda i: i["confidence"] > p["floor"]))
    return parsed.withColumn("line_items", F.get(kept, F.lit(0)))


def with_confidence(parsed: DataFrame) -> DataFrame:
    vendor = F.when(F.length("vendor") > 3, 0.9).otherwise(0.3)
    off = F.abs(F.col("subtotal") + F.col("tax") - F.col("total")) / F.col("total")
    total = (
        F.when(F.col("total").isNull(), 0.3)
        .when(F.col("subtotal").isNull() | F.col("tax").isNull(), 0.9)
        .when(off < 0.02, 0.95)
        .otherwise(0.85)
    )
    n = F.size("line_items")
    mean = F.aggregate("line_items", F.lit(0.0), lambda acc, i: acc + i["confidence"]) / n
    items = F.when(n > 0, mean).otherwise(0.4)
    number = F.when(F.col("invoice_number").isNotNull(), 0.9).otherwise(0.5)
    date = F.when(F.col("d").isNotNull(), 0.9).otherwise(0.5)
    return parsed.withColumn(
        "confidence", vendor * 0.25 + total * 0.30 + items * 0.25 + number * 0.10 + date * 0.10
    )


def parse_layout(docs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """All fields of the layout pass."""
    return with_confidence(with_valid_items(with_totals(with_items(with_header_fields(with_sections(docs), as_of)))))


def with_fallback(docs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Add what the pattern pass finds: ``fb_vendor, fb_number, fb_d, fb_amounts, fb_items``.

    Amounts and items, the dearest patterns, are only looked for where the layout has not found all it can use: amounts where
    one is missing, items where there are none or they do not add up to the stated amount.
    """
    text = F.col("text")
    return (
        docs.withColumn("fb_vendor", X.fallback_vendor(text))
        .withColumn("fb_number", X.fallback_number(text))
        .withColumn("fb_d", X.fallback_date(text, F.current_date() if as_of is None else as_of))
        .withColumn("fb_amounts", F.when(_lacks_amounts(), X.fallback_amounts(text)) if "total" in docs.columns else X.fallback_amounts(text))
        .withColumn("fb_items", F.when(_lacks_items(), X.fallback_items(text)) if "line_items" in docs.columns else X.fallback_items(text))
    )


def _lacks_amounts() -> Column:
    return F.col("total").isNull() | F.col("subtotal").isNull() | F.col("tax").isNull()


def _lacks_items() -> Column:
    """No items, an amount that is not known yet, or another sum than the stated one."""
    target = F.coalesce("subtotal", "total")
    return (F.size("line_items") == 0) | F.col("subtotal").isNull() | F.coalesce(items_total("line_items") != target, F.lit(True))


def extract_invoices(docs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """One invoice per document: layout fields, filled from the pattern pass where missing."""
    df = with_fallback(parse_layout(docs, as_of), as_of)
    df = df.withColumn("layout_total", F.col("total")).withColumn("layout_items", items_total("line_items"))
    vendor = F.when(X.is_placeholder_vendor(F.col("vendor")), F.col("fb_vendor.vendor")).otherwise(F.col("vendor"))
    number = F.when(X.is_valid_number(F.col("invoice_number")), F.col("invoice_number")).otherwise(
        F.coalesce("fb_number", "invoice_number")
    )
    df = (
        df.withColumn("vendor", X.normalize_vendor(vendor))
        .withColumn("d", F.coalesce("d", "fb_d"))
        .withColumn("invoice_number", X.align_year(number, F.col("d")))
        .withColumn("total", F.coalesce("total", "fb_amounts.total"))
        .withColumn("subtotal", F.coalesce("subtotal", "fb_amounts.subtotal"))
        .withColumn("tax", F.coalesce("tax", "fb_amounts.tax"))
    )
    target = F.coalesce("subtotal", "total")
    closer = F.abs(items_total("fb_items") - target) < F.abs(F.col("layout_items") - target)
    use_fallback = (F.size("fb_items") > 0) & (
        (F.size("line_items") == 0) | F.coalesce(closer, F.lit(False))
    )
    df = df.withColumn("line_items", F.when(use_fallback, F.col("fb_items")).otherwise(F.col("line_items")))
    df = df.withColumn("items_sum", F.round(items_total("line_items"), 2)).withColumn(
        "total", F.coalesce("total", F.round(F.col("subtotal") + F.col("tax"), 2))
    )
    near = F.abs(F.col("subtotal") - F.col("items_sum")) / F.col("subtotal") < 0.02
    subtotal = F.when(
        (F.col("items_sum") > 0) & (F.col("subtotal").isNull() | near), F.col("items_sum")
    ).otherwise(F.col("subtotal"))
    hybrid = (F.col("fb_vendor.confidence") >= 0.85) | F.col("fb_number").isNotNull() | F.col("fb_d").isNotNull()
    return df.withColumn("subtotal", subtotal).select(
        "doc_id",
        F.coalesce("vendor", F.lit("Unknown")).alias("vendor"),
        "invoice_number",
        "d",
        "total",
        "subtotal",
        "tax",
        "line_items",
        "items_sum",
        F.size("line_items").alias("n_items"),
        "confidence",
        F.when(F.col("confidence") < 0.5, "fallback").when(hybrid, "hybrid").otherwise("intelligent").alias("parser_used"),
    )
