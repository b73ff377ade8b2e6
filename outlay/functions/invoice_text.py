"""Expressions that read fields out of invoice text. All work on whole texts, row by row,
as Spark expressions: a document needs no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from outlay.functions.text import strip

# Words of a table head, of totals, and lines that are no vendor or item.
ITEM_HEAD_WORDS = r"\b(qty|quantity|qnty|units|count|descriptions?|items?|products?|services?|details|particulars)\b|#"
OTHER_HEAD_WORDS = r"\b(unit price|price|rate|amount|cost|total|sum|subtotal)\b"
TOTAL_WORDS = r"(?i)\b(sub[\s-]?total|total|tax|amount due)\b"
SUBTOTAL, TAX, TOTAL = r"(?i)\bsub[\s-]?total\b", r"(?i)\b(tax|vat|gst)\b", r"(?i)\b(total|amount due|balance)\b"
PAGE_MARK = r"(?i)^---\s*page\s+\d+\s*---$"
HEADER_NOISE = (
    r"(?i)^(---\s*page\b|page\s+\d+|invoice\b|date\b|bill\s+to\b|ship\s+to\b|customer\b|subtotal\b|tax\b|total\b)"
)
NON_ITEM = r"(?i)^(invoice|date|bill\s+to|customer|reference|ref)\b"
PLACEHOLDER = r"(?i)^(---\s*page|page\s+\d+|bill\s+to|date\b|invoice\b)"

# Patterns in order of trust.
HEADER_NUMBER = (
    r"(?i)(?:invoice|invoic[eos]|inv)\s*(?:no|number|#)?\s*[:#]?\s*([A-Z0-9][A-Z0-9-]{2,})",
    r"(?i)(?:reference|ref|doc(?:ument)?|bill)\s*(?:no|number|#)?\s*[:#]?\s*([A-Z0-9][A-Z0-9-]{2,})",
    r"(?i)bill\s*(?:no|#)?\s*:?\s*([A-Z0-9-]+)",
)
ANY_NUMBER = (
    r"(?i)Invoice\s*(?:No|Number|#)?\s*:?\s*([A-Z0-9-]+)",
    r"(?i)INV\s*(?:No|Number|#)?\s*:?\s*([A-Z0-9-]+)",
    r"(?i)Bill\s*(?:No|Number|#)?\s*:?\s*([A-Z0-9-]+)",
    r"(?i)Reference\s*(?:No|Number|#)?\s*:?\s*([A-Z0-9-]+)",
    r"(?i)PO\s*#?\s*:?\s*([A-Z0-9-]+)",
    r"(?i)Order\s*(?:No|Number|#)?\s*:?\s*([A-Z0-9-]+)",
    r"(?i)Doc(?:ument)?\s*(?:No|Number|#)?\s*:?\s*([A-Z0-9-]+)",
    r"(?i)Ref\s*#?\s*:?\s*([A-Z0-9-]+)",
    r"(?i)#\s*([A-Z0-9-]{3,})",
    r"(?i)\b(INV-?\d{4,})\b",
    r"(?i)\b(PO\d{6,})\b",
    r"(?i)\b([A-Z]{2,}\d{4,})\b",
)
MONTHS = "jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec"
# A day-month pattern must not start inside a year, so the year-first forms go ahead of it.
HEADER_DATE = (
    r"(?i)date\s*:?\s*(\d{4}[/-]\d{1,2}[/-]\d{1,2})",
    r"(?i)date\s*:?\s*(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
    r"(?<!\d)(\d{4}[/.-]\d{1,2}[/.-]\d{1,2})(?!\d)",
    r"(?<![\d.])(\d{1,2}\.\d{1,2}\.\d{4})(?![\d.])",
    r"(?<![\d/-])(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
    rf"(?i)((?:{MONTHS})[a-z]*\s+\d{{1,2}},?\s+\d{{4}})",
)
ANY_DATE = (
    r"(?i)(?:Invoice\s+)?Date\s*:?\s*([A-Za-z0-9\s,./-]+)",
    r"(?i)Dated\s*:?\s*([A-Za-z0-9\s,./-]+)",
    r"(?i)(?:Issue|Issued)\s+(?:Date|On)\s*:?\s*([A-Za-z0-9\s,./-]+)",
    r"(?i)Date\s+of\s+Invoice\s*:?\s*([A-Za-z0-9\s,./-]+)",
    r"(?<![\d/-])(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
    r"(?<!\d)(\d{4}[/-]\d{1,2}[/-]\d{1,2})(?!\d)",
    rf"(?i)((?:{MONTHS})[a-z]*\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}})",
    rf"(?i)(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:of\s+)?(?:{MONTHS})[a-z]*\s+\d{{4}})",
)
# How a date may be written; two-digit years from 76 on are of the last century.
YEAR_FIRST = r"(?<!\d)(\d{4}[/.-]\d{1,2}[/.-]\d{1,2})"
YEAR_LAST = r"(?<![\d/.-])(\d{1,2}[/-]\d{1,2}[/-](?:\d{4}|\d{2})|\d{1,2}\.\d{1,2}\.\d{4})(?!\d)"
ORDINAL = "(?:st|nd|rd|th)?"
MONTH_FIRST = rf"(?i)((?:{MONTHS})[a-z]*\.?\s+\d{{1,2}}{ORDINAL},?\s+\d{{4}})"
DAY_FIRST = rf"(?i)(\d{{1,2}}{ORDINAL}\s+(?:of\s+)?(?:{MONTHS})[a-z]*\.?,?\s+\d{{4}})"
LAST_CENTURY = "76"
AMOUNT = r"\s*:?\s*\$?\s*([\d,]+\.?\d{0,2})"
TOTAL_AMOUNT = (
    r"(?i)\b(?:Total|Amount Due|Balance Due|Grand Total|Total Amount|Amount Payable|Net Total)" + AMOUNT,
    r"(?i)\b(?:Total|Amount)" + AMOUNT,
    r"(?i)\$\s*([\d,]+\.?\d{2})\s*(?:Total|Due)",
)
SUBTOTAL_AMOUNT = (r"(?i)Subtotal" + AMOUNT, r"(?i)Sub-Total" + AMOUNT, r"(?i)Sub Total" + AMOUNT)
TAX_AMOUNT = (r"(?i)\b(?:Tax|VAT|GST|Sales Tax)" + AMOUNT, r"(?i)\b(?:Tax|VAT|GST)\s*\([\d.]+%\)" + AMOUNT)
VENDOR_LABELS = (
    r"(?i)(?:From|Vendor|Bill From|Billed By)\s*:?\s*([A-Za-z0-9\s&.,'-]+?)(?:\n|$)",
    r"(?i)(?:Company|Business)\s*:?\s*([A-Za-z0-9\s&.,'-]+?)(?:\n|$)",
)
# Fixed value: from this share on subtotal and tax do not make up the total.
AMOUNTS_DIFFER = 0.02
NOT_A_NAME = r"(?i)^(---|Page|\d+|Invoice|Bill|Date|From|To)"


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found)


def plain_number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit("")).try_cast("double")


def each(values: Column | list[Column], fn) -> Column:
    """``fn`` over an array; the values are computed once, however often ``fn`` uses them."""
    return F.transform(F.array(*values) if isinstance(values, list) else values, fn)


def first_of(values: Column, cond=lambda v: v.isNotNull()) -> Column:
    return F.get(F.filter(values, cond), F.lit(0))


def first_read(text: Column, patterns: tuple[str, ...], read, cond) -> Column:
    """The first reading that ``cond`` holds for; a pattern is only tried, and its group only read, when those before have failed."""
    groups = [F.filter(F.array(F.regexp_extract(text, p, 1)), lambda g: g != "") for p in patterns]
    return F.coalesce(*[first_of(each(g, read), cond) for g in groups])


def _date(parts: Column, year: int, month: int, day: int) -> Column:
    """A date from text parts; impossible ones give null without an exception."""
    y = F.get(parts, F.lit(year))
    full = F.when(F.length(y) > 2, y).when(y >= LAST_CENTURY, F.concat(F.lit("19"), y)).otherwise(F.concat(F.lit("20"), y))
    return F.concat_ws("-", full, F.get(parts, F.lit(month)), F.get(parts, F.lit(day))).try_cast("date")


def _named_date(parts: Column, month: int, day: int) -> Column:
    at = F.instr(F.lit(MONTHS.replace("|", "")), F.lower(F.substring(F.get(parts, F.lit(month)), 1, 3)))
    numbered = F.array(F.get(parts, F.lit(2)), F.floor((at + 2) / 3).cast("string"), F.get(parts, F.lit(day)))
    return F.when(at > 0, _date(numbered, 0, 1, 2))


def parse_date(text: Column) -> Column:
    """The first thing in a text that reads as a date, else null; month first where both fit."""

    def tried(pattern: str, splitter: str, *readings) -> Column:
        found = F.regexp_replace(F.regexp_extract(text, pattern, 1), r"(?i)(?<=\d)(?:st|nd|rd|th)\b|\bof\s+", "")
        parts = F.split(found, splitter)
        return first_of(each([parts], lambda p: F.coalesce(*[read(p) for read in readings])))

    return F.coalesce(
        tried(YEAR_FIRST, "[/.-]", lambda p: _date(p, 0, 1, 2)),
        tried(YEAR_LAST, "[/.-]", lambda p: _date(p, 2, 0, 1), lambda p: _date(p, 2, 1, 0)),
        tried(MONTH_FIRST, r"[.,]?\s+", lambda p: _named_date(p, 0, 1)),
        tried(DAY_FIRST, r"[.,]?\s+", lambda p: _named_date(p, 1, 0)),
    )


def lines_of(text: Column) -> Column:
    """Trimmed lines without blank lines and page marks."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: (s != "") & ~s.rlike(PAGE_MARK))


def is_table_head(line: Column) -> Column:
    """At least two head words, one of them of an item column, and no digits."""
    low = F.lower(line)
    own = F.array_distinct(F.regexp_extract_all(low, F.lit(ITEM_HEAD_WORDS), F.lit(0)))
    other = F.array_distinct(F.regexp_extract_all(low, F.lit(OTHER_HEAD_WORDS), F.lit(0)))
    return ~line.rlike(r"\d") & (F.size(own) >= 1) & (F.size(own) + F.size(other) >= 2)


def numbers_in(line: Column) -> Column:
    """Positive numbers of a line. Four or more digits without point or comma are cents
    when the line is about money."""
    money = F.contains(line, F.lit("$")) | line.rlike(r"\d+\.\d{2}")

    def value(token: Column) -> Column:
        cents = ~F.contains(token, F.lit(".")) & ~F.contains(token, F.lit(",")) & (F.length(token) >= 4) & money
        return F.when(cents, plain_number(token) / 100).otherwise(plain_number(token))

    tokens = F.regexp_extract_all(line, F.lit(r"\$?\s*([\d,]+\.?\d*)"), F.lit(1))
    return F.filter(F.transform(tokens, value), lambda x: x > 0)


def description_of(line: Column) -> Column:
    text = F.regexp_replace(line, r"[\d,]+\.?\d*", "")
    return F.regexp_replace(strip(F.regexp_replace(text, r"\s+", " ")), r"(?U)^[^\w]+|[^\w]+$", "")


def _close(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.abs(a - b), b) < 0.05, F.lit(False))


def line_item(line: Column, numbers: Column) -> Column:
    """``description, quantity, unit_price, total, confidence`` of an item line."""
    n = F.size(numbers)
    last = F.when(n > 3, F.slice(numbers, -3, 3)).otherwise(numbers)
    parts = F.struct(description_of(line).alias("text"), last.alias("last"), n.alias("n"))
    return F.get(each([parts], lambda p: _item(p["text"], p["last"], p["n"])), F.lit(0))


def _item(text: Column, last: Column, n: Column) -> Column:
    a, b, c = F.get(last, F.lit(0)), F.get(last, F.lit(1)), F.get(last, F.lit(2))
    two, three = n == 2, n >= 3
    fits = three & _close(a * b, c)
    quantity = F.when(fits, a).when(two & (a < 100) & (b > a * 2), a)
    price = (
        F.when(fits, b)
        .when(three & (b < c), b)
        .when(two & quantity.isNull() & (a > 1) & (a < b), a)
    )
    stated = F.when(three, c).when(two, b).otherwise(a)
    product = F.round(a * b, 2)
    total = F.when(fits & _close(product, stated), product).otherwise(stated)
    points = (
        F.lit(0.5)
        + F.when(F.length(text) > 5, 0.2).otherwise(0.0)
        + F.when(quantity.isNotNull(), 0.1).otherwise(0.0)
        + F.when(price.isNotNull(), 0.1).otherwise(0.0)
        + F.when(fits, 0.2).otherwise(0.0)
    )
    return F.struct(
        text.alias("description"),
        quantity.alias("quantity"),
        price.alias("unit_price"),
        total.alias("total"),
        F.least(points, F.lit(1.0)).alias("confidence"),
    )


def fallback_items(text: Column) -> Column:
    """Items from lines that read ``description quantity price``."""
    quantity, price = r"\s+(\d+)\s", r"\s+\d+\s+\$?\s*([\d,]+\.?\d*)"

    def item(parts: Column) -> Column:
        qty = F.regexp_extract(parts["rest"], "^" + quantity, 1).try_cast("double")
        each_price = plain_number(F.regexp_extract(parts["rest"], "^" + price, 1))
        return F.struct(
            strip(parts["head"]).alias("description"),
            qty.alias("quantity"),
            each_price.alias("unit_price"),
            (qty * each_price).alias("total"),
            F.lit(0.7).alias("confidence"),
        )

    # The costly search runs once per line that can match; the numbers are read behind it.
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r"\s\d+\s+\$?\s*[\d,]"))
    heads = each(lines, lambda s: F.struct(s.alias("line"), F.regexp_extract(s, "^(.+?)" + price, 1).alias("head")))
    parts = each(
        heads,
        lambda h: F.struct(h["head"].alias("head"), F.substr(h["line"], F.length(h["head"]) + 1).alias("rest")),
    )
    return F.filter(each(parts, item), lambda i: i["total"].isNotNull())


def fallback_vendor(text: Column) -> Column:
    """``struct(vendor, confidence)`` from labels, else from the first line like a name."""
    labelled = first_of(F.array(*[strip(F.regexp_extract(text, p, 1)) for p in VENDOR_LABELS]), lambda v: F.length(v) > 3)
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: F.length(s) >= 4)
    named = F.get(
        F.filter(lines, lambda s: ~s.rlike(NOT_A_NAME) & ~s.rlike(r"^[\d\s/\-:]+$")), F.lit(0)
    )

    def told(f: Column) -> Column:
        return F.struct(
            F.coalesce(f["labelled"], f["named"], F.lit("Unknown")).alias("vendor"),
            F.when(f["labelled"].isNotNull(), 0.85).when(f["named"].isNotNull(), 0.6).otherwise(0.3).alias("confidence"),
        )

    return F.get(each([F.struct(labelled.alias("labelled"), named.alias("named"))], told), F.lit(0))


def fallback_number(text: Column) -> Column:
    return first_read(
        text, ANY_NUMBER, strip, lambda n: n.rlike(r"\d") & (F.length(n) >= 3) & ~n.rlike(r"^\d{1,2}$")
    )


def in_window(day: Column, as_of: Column) -> Column:
    """Not after ``as_of`` and at most ten years before it."""
    return day.between(F.date_sub(as_of, 3650), as_of)


def header_date(line: Column, as_of: Column) -> Column:
    return first_read(line, HEADER_DATE, parse_date, lambda x: in_window(x, as_of))


def header_number(line: Column) -> Column:
    return first_read(line, HEADER_NUMBER, lambda n: n, lambda n: n.rlike(r"\d"))


def fallback_date(text: Column, as_of: Column) -> Column:
    """The first date in the window of ``as_of``."""
    return first_read(text, ANY_DATE, parse_date, lambda x: in_window(x, as_of))


def _first_positive(text: Column, patterns: tuple[str, ...], all_matches: bool) -> Column:
    tries = []
    for pattern in patterns:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)) if all_matches else F.array(F.regexp_extract(text, pattern, 1))
        tries.append(first_of(F.transform(found, plain_number), lambda v: v > 0))
    return F.coalesce(*tries)


def fallback_amounts(text: Column) -> Column:
    """``struct(total, subtotal, tax, off, amounts_differ)``; without a labelled total the largest money value.

    ``off`` is the share by which subtotal and tax miss the total, ``amounts_differ`` warns from 2 % on.
    """
    dollars = F.regexp_extract_all(text, F.lit(r"\$\s*([\d,]+(?:\.\d{1,2})?)"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"(?:^|\s)([\d,]+\.\d{2})(?=\s|$)"), F.lit(1))
    values = F.filter(F.transform(F.concat(dollars, bare), plain_number), lambda v: v > 0)
    amounts = F.struct(
        F.coalesce(_first_positive(text, TOTAL_AMOUNT, True), F.array_max(values)).alias("total"),
        _first_positive(text, SUBTOTAL_AMOUNT, False).alias("subtotal"),
        _first_positive(text, TAX_AMOUNT, False).alias("tax"),
    )

    def checked(a: Column) -> Column:
        off = F.try_divide(F.abs(a["subtotal"] + a["tax"] - a["total"]), a["total"])
        return F.struct(
            a["total"].alias("total"), a["subtotal"].alias("subtotal"), a["tax"].alias("tax"),
            off.alias("off"), F.coalesce(off >= AMOUNTS_DIFFER, F.lit(False)).alias("amounts_differ"),
        )

    return F.get(each([amounts], checked), F.lit(0))


def is_placeholder_vendor(vendor: Column) -> Column:
    low = F.lower(strip(vendor))
    return F.coalesce((low == "") | low.isin("unknown", "n/a") | low.rlike(PLACEHOLDER), F.lit(True))


def is_valid_number(number: Column) -> Column:
    return F.coalesce((F.length(strip(number)) >= 4) & number.rlike(r"\d"), F.lit(False))


def normalize_vendor(vendor: Column) -> Column:
    """Collapse spaces; split ``camelCase`` and ``ABCWord``."""
    text = strip(F.regexp_replace(vendor, r"\s+", " "))
    steps = ((r"([a-z])([A-Z])", "$1 $2"), (r"([A-Z]{2,})([A-Z][a-z])", "$1 $2"))
    return reduce(lambda col, step: F.regexp_replace(col, step[0], step[1]), steps, text)


def align_year(number: Column, day: Column) -> Column:
    """Correct a ``20xx`` year in the number whose last digit differs from the date's."""
    year = first_match(number, r"(20\d{2})")
    dated = F.date_format(day, "yyyy")
    off = (year != dated) & (F.substring(year, 1, 3) == F.substring(dated, 1, 3))
    head = F.regexp_extract(number, r"^(.*?)20\d{2}", 1)
    tail = F.regexp_extract(number, r"^.*?20\d{2}(.*)$", 1)
    fixed = F.concat(head, dated, tail)
    return F.when(off, fixed).otherwise(number)
