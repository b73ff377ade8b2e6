"""Invoice fraud rules, alerts and risk.

Input: one row per invoice with ``invoice_id, seq, vendor, invoice_number, d, total, subtotal,
tax, items_sum, n_items, confidence``. ``seq`` is the unique upload order: an invoice is
compared only with the vendor's earlier ones.

An alert row says how often it applies in ``occurrences``: a copy of an invoice with three
earlier ones is one row with three occurrences. Risk and counts add occurrences up, so they
are the same as with one alert per earlier copy, while the output stays linear in the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from outlay.config import FraudConfig
from outlay.functions.text import fixed, present
from outlay.operators.contained import contained_names
from outlay.operators.skew import lookup, running_before, with_block
from outlay.session import materialize
from outlay.sources.tables import find, write_keyed

# Severity, confidence, description and recommended action per alert type.
ALERTS: dict[str, tuple[str, float, str, str]] = {
    "duplicate_invoice": ("critical", 1.0, "Duplicate invoice number", "REJECT - Duplicate submission detected"),
    "near_duplicate": ("high", 0.85, "Possible duplicate: same vendor, amount, and date range", "REVIEW - Verify if legitimate repeat purchase"),
    "suspicious_round_amount": ("medium", 0.6, "Suspiciously round amount", "REVIEW - Verify invoice authenticity"),
    "calculation_mismatch": ("high", 0.9, "Invoice calculation error detected", "REJECT - Mathematical error or manipulation"),
    "line_items_mismatch": ("high", 0.85, "Line items do not match subtotal", "REVIEW - Verify line item calculations"),
    "suspicious_vendor_name": ("high", 0.8, "Suspicious vendor name pattern detected", "REVIEW - Verify vendor legitimacy"),
    "inconsistent_invoice_format": ("medium", 0.7, "Invoice number format differs from vendor history", "REVIEW - Verify invoice authenticity"),
    "amount_anomaly": ("medium", 0.75, "Amount significantly differs from vendor history", "REVIEW - Verify unusual amount"),
    "low_ocr_confidence": ("medium", 0.6, "Low OCR extraction confidence", "REVIEW - Request original document"),
    "missing_critical_fields": ("high", 0.9, "Critical invoice fields missing", "REJECT - Request complete invoice"),
    "no_matching_transaction": ("high", 0.8, "No matching bank transaction found", "REVIEW - Verify payment was made"),
}
# Vendor names that look made up.
SUSPICIOUS_NAMES = ("test", "sample", "example", "dummy", "fake", "xxx", r"abc\s*company", r"vendor\s*\d+")
# Points per severity and risk bands.
SEVERITY_POINTS = {"critical": 40.0, "high": 25.0, "medium": 10.0, "low": 5.0}
RISK_BANDS = (
    (75.0, "critical", "REJECT - High fraud risk detected. Do not process this invoice."),
    (50.0, "high", "HOLD - Significant concerns. Require manual review and verification."),
    (25.0, "medium", "REVIEW - Minor issues detected. Verify before processing."),
    (None, "low", "APPROVE - Low risk. Safe to process."),
)


def _dollars(col: str | Column) -> Column:
    return F.concat(F.lit("$"), fixed(col, 2))


def _text(*parts: str | Column) -> Column:
    return F.concat_ws("", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _alert(kind: str, evidence: list[Column], occurrences: Column | None = None) -> Column:
    severity, confidence, description, action = ALERTS[kind]
    return F.struct(
        F.lit(kind).alias("alert_type"),
        F.lit(severity).alias("severity"),
        F.lit(confidence).alias("confidence"),
        (F.lit(1).cast("long") if occurrences is None else occurrences.cast("long")).alias("occurrences"),
        F.lit(description).alias("description"),
        F.array(*evidence).alias("evidence"),
        F.lit(action).alias("recommended_action"),
    )


def _block_of(df: DataFrame) -> list[str]:
    """The column of order blocks, if the rows have been cut into blocks already."""
    return ["_block"] if "_block" in df.columns else []


def prepare(invoices: DataFrame) -> DataFrame:
    """Lower-case vendors; empty texts and zero amounts count as missing."""
    df = invoices.withColumn("vendor", F.lower(F.coalesce("vendor", F.lit(""))))
    for name in ("items_sum", "subtotal", "tax", "confidence"):
        value = F.col(name) if name in df.columns else F.lit(None)
        df = df.withColumn(name, value.cast("double"))
    if "n_items" not in df.columns:
        df = df.withColumn("n_items", F.when(F.col("items_sum").isNotNull(), 1).otherwise(0))
    return df


def document_alerts(invoices: DataFrame, cfg: FraudConfig = FraudConfig()) -> DataFrame:
    """Rules that need only the invoice itself, in one pass without a shuffle."""
    df = prepare(invoices)
    total, sub, tax = F.col("total"), F.col("subtotal"), F.col("tax")
    items = F.col("items_sum")
    has_total = F.coalesce(total != 0, F.lit(False))
    has_sub = F.coalesce(sub != 0, F.lit(False))
    has_tax = F.coalesce(tax != 0, F.lit(False))

    round_amount = has_total & (total >= cfg.round_amount_floor) & (total % 100 == 0)
    calc_diff = F.abs(sub + tax - total)
    calc_pct = F.when(total > 0, F.try_divide(calc_diff, total)).otherwise(0.0)
    item_diff = F.abs(items - sub)
    item_pct = F.when(sub > 0, F.try_divide(item_diff, sub)).otherwise(0.0)
    missing = F.array_compact(
        F.array(
            F.when(~present("vendor"), F.lit("vendor")),
            F.when(~present("invoice_number"), F.lit("invoice_number")),
            F.when(F.col("d").isNull(), F.lit("date")),
            F.when(~has_total, F.lit("total_amount")),
        )
    )
    single = [
        (
            round_amount,
            _alert("suspicious_round_amount", [
                _text("Total is a whole number of hundreds: ", _dollars(total)),
            ]),
        ),
        (
            has_sub & has_tax & has_total & (calc_pct > cfg.calc_tolerance),
            _alert("calculation_mismatch", [
                _text("Subtotal: ", _dollars(sub)),
                _text("Tax: ", _dollars(tax)),
                _text("Stated Total: ", _dollars(total)),
                _text("Calculated Total: ", _dollars(sub + tax)),
                _text("Difference: ", _dollars(calc_diff), " (", fixed(calc_pct * 100, 1), "%)"),
            ]),
        ),
        (
            has_sub & (F.col("n_items") > 0) & (item_pct > cfg.items_tolerance),
            _alert("line_items_mismatch", [
                _text("Line items sum: ", _dollars(items)),
                _text("Stated subtotal: ", _dollars(sub)),
                _text("Difference: ", _dollars(item_diff), " (", fixed(item_pct * 100, 1), "%)"),
            ]),
        ),
        (
            F.coalesce(F.col("confidence"), F.lit(1.0)) < cfg.low_confidence,
            _alert("low_ocr_confidence", [
                _text("OCR confidence: ", fixed(F.col("confidence") * 100, 1), "%"),
                F.lit(f"Below {cfg.low_confidence:g}"),
            ]),
        ),
        (
            F.size(missing) > 0,
            _alert("missing_critical_fields", [
                _text("Missing fields: ", F.array_join(missing, ", ")),
                            ]),
        ),
    ]
    named = [
        (
            F.col("vendor").rlike(f"(?i){pattern}"),
            _alert("suspicious_vendor_name", [
                _text("Vendor: ", F.col("vendor")), F.lit(f"Matches pattern: {pattern}"),
            ]),
        )
        for pattern in SUSPICIOUS_NAMES
    ]
    found = F.array_compact(F.array(*[F.when(cond, alert) for cond, alert in single + named]))
    return df.select("invoice_id", F.inline(found))


def _rows(df: DataFrame, alert: Column) -> DataFrame:
    return df.select("invoice_id", F.inline(F.array(alert)))


def duplicate_alerts(invoices: DataFrame) -> DataFrame:
    """Same vendor and number as earlier invoices."""
    df = prepare(invoices).where(present("invoice_number"))
    counted = running_before(
        df.select("invoice_id", "seq", "vendor", "invoice_number", *_block_of(df)),
        ["vendor", "invoice_number"], "seq", {"n_before": F.lit(1).cast("long")},
    ).where("n_before > 0")
    return duplicate_rows(counted)


def duplicate_rows(counted: DataFrame) -> DataFrame:
    """Alerts of invoices with ``n_before`` earlier ones of the same number."""
    return _rows(
        counted,
        _alert("duplicate_invoice", [
            _text("Invoice #", F.col("invoice_number"), " already submitted"),
            _text("Previous submissions: ", F.col("n_before").cast("string")),
            _text("Vendor: ", F.col("vendor")),
        ], F.col("n_before")),
    )


def near_cells(cfg: FraudConfig) -> Column:
    """``array<struct<c, w, home>>``: the cells of amount and day in which an invoice's near duplicates lie, its own marked.

    Cells are wider than twice the reach, so there are at most two of each.
    """
    cents, days = 4 * cfg.same_amount, 4 * cfg.near_days
    total, day = F.col("total"), F.datediff("d", F.lit("1970-01-01").cast("date"))

    def around(value: Column, by: float, width: float) -> Column:
        return F.array_distinct(F.array(F.floor((value - by) / width), F.floor((value + by) / width)))

    c, w = F.floor(total / cents), F.floor(day / days)
    cell = F.transform(
        around(total, cfg.same_amount * 1.5, cents),
        lambda x: F.transform(around(day, cfg.near_days, days), lambda y: F.struct(x.alias("c"), y.alias("w"), ((x == c) & (y == w)).alias("home"))),
    )
    return F.flatten(cell)


def near_duplicates(invoices: DataFrame, cfg: FraudConfig = FraudConfig()) -> DataFrame:
    """``(invoice_id, vendor, total, n_before)``: earlier invoices of the vendor with the same
    amount within a cent and a date within a week.

    Works on distinct (vendor, amount, date) triples: only neighbouring triples are paired,
    and copies within a triple are counted by rank, never paired.
    """
    base = (
        prepare(invoices)
        .where(F.coalesce(F.col("total") != 0, F.lit(False)) & F.col("d").isNotNull())
        .select("invoice_id", "seq", "vendor", "total", "d", *_block_of(invoices))
    )
    key = ["vendor", "total", "d"]
    triples = base.groupBy(*key).agg(
        F.count("*").alias("n"), F.min("seq").alias("s_min"), F.max("seq").alias("s_max")
    )
    # Buckets wider than twice the reach: a triple's neighbours lie in at most two of them.
    cents, days = 4 * cfg.same_amount, 4 * cfg.near_days
    day_no = F.datediff("d", F.lit("1970-01-01").cast("date"))
    reach = cfg.same_amount * 1.5

    def spread(value: Column, by: float, width: float) -> Column:
        return F.explode(F.array_distinct(F.array(F.floor((value - by) / width), F.floor((value + by) / width))))

    asking = (
        triples.select(*key, F.col("s_min").alias("q_min"), F.col("s_max").alias("q_max"))
        .withColumn("_c", spread(F.col("total"), reach, cents))
        .withColumn("_w", spread(day_no, cfg.near_days, days))
    )
    there = triples.select(
        "vendor", F.col("total").alias("total2"), F.col("d").alias("d2"), "n", "s_min", "s_max",
        F.floor(F.col("total") / cents).alias("_c"), F.floor(day_no / days).alias("_w"),
    )
    pairs = (
        asking.join(there, ["vendor", "_c", "_w"])
        .where(
            (F.abs(F.col("total") - F.col("total2")) < cfg.same_amount)
            & (F.abs(F.datediff("d", "d2")) <= cfg.near_days)
            & (F.col("s_min") < F.col("q_max"))
        )
        .select(*key, "total2", "d2", "n", (F.col("s_max") < F.col("q_min")).alias("before"))
    )
    # Usually few; a written table lets the planner see that.
    pairs = materialize(pairs, "near-pairs")
    # Whole triple earlier: its size counts for every row. Interleaved: rank by seq.
    whole = pairs.where("before").groupBy(*key).agg(F.sum("n").alias("n_whole"))
    mixed = pairs.where(~F.col("before"))
    sizes = triples.select(*key, "n")
    blocked = base if "_block" in base.columns else with_block(base, "seq")
    queries = lookup(blocked, _sized(mixed.groupBy(*key).agg(F.collect_set(F.struct("total2", "d2")).alias("others")), sizes, key), key, "n", ["seq"])
    asks = queries.select(
        "vendor", F.explode("others").alias("o"), "seq", "_block", "invoice_id"
    ).select(
        "vendor", F.col("o.total2").alias("total"), F.col("o.d2").alias("d"), "seq", "_block",
        "invoice_id", F.lit(0).cast("long").alias("member"),
    )
    named = mixed.select("vendor", F.col("total2").alias("total"), F.col("d2").alias("d")).distinct()
    members = lookup(blocked, _sized(named, sizes, key), key, "n", ["seq"]).select(
        *key, "seq", "_block", F.lit(None).cast("string").alias("invoice_id"),
        F.lit(1).cast("long").alias("member"),
    )
    # A row of the triple itself is both asking and counted; asking sorts first.
    both = asks.unionByName(members).withColumn("_at", F.struct("seq", "member"))
    ranked = (
        running_before(both, key, "_at", {"n_before": F.col("member")})
        .where("invoice_id is not null")
        .groupBy("invoice_id")
        .agg(F.sum("n_before").alias("n_rank"))
    )
    withwhole = lookup(base, _sized(whole, sizes, key), key, "n", ["seq"]).select("invoice_id", "n_whole")
    counts = (
        withwhole.select("invoice_id", F.col("n_whole").alias("k"))
        .unionByName(ranked.select("invoice_id", F.col("n_rank").alias("k")))
        .groupBy("invoice_id")
        .agg(F.sum("k").alias("n_before"))
        .where("n_before > 0")
    )
    return base.join(counts, "invoice_id").select("invoice_id", "vendor", "total", "n_before")


def _sized(keys: DataFrame, sizes: DataFrame, key: list[str]) -> DataFrame:
    return keys.join(sizes, key)


def near_duplicate_alerts(invoices: DataFrame, cfg: FraudConfig = FraudConfig()) -> DataFrame:
    return near_duplicate_rows(near_duplicates(invoices, cfg), cfg)


def near_duplicate_rows(counted: DataFrame, cfg: FraudConfig = FraudConfig()) -> DataFrame:
    """Alerts of invoices with ``n_before`` earlier ones that are alike."""
    return _rows(
        counted,
        _alert("near_duplicate", [
            _text("Vendor: ", F.col("vendor")),
            _text("Amount: ", _dollars("total")),
            _text("Earlier invoices within ", str(cfg.near_days), " days: ", F.col("n_before").cast("string")),
        ], F.col("n_before")),
    )


def invoice_format(number: str | Column) -> Column:
    """Shape of an invoice number: letters become A, digits N."""
    return F.regexp_replace(F.regexp_replace(number, "[a-zA-Z]", "A"), r"\d", "N")


def vendor_formats(invoices: DataFrame) -> DataFrame:
    """Number shapes per vendor with their first use; the history behind format alerts."""
    df = prepare(invoices).where(present("invoice_number"))
    return df.groupBy("vendor", invoice_format("invoice_number").alias("format")).agg(
        F.min("seq").alias("first_seq"), F.min_by("invoice_id", "seq").alias("invoice_id"), F.count("*").alias("n")
    )


def format_alerts(invoices: DataFrame, cfg: FraudConfig = FraudConfig()) -> DataFrame:
    """Invoices that are the first of their shape once the vendor has a history.

    Only the first use of a shape can be new, so shapes are grouped first; the start of a
    vendor's history comes from a row-number limit, which Spark applies before the shuffle.
    """
    df = prepare(invoices)
    place = F.row_number().over(W.partitionBy("vendor").orderBy("seq"))
    started = (
        df.select("vendor", "seq")
        .withColumn("place", place)
        .where(F.col("place") <= cfg.min_history)
        .groupBy("vendor")
        .agg(F.max("seq").alias("known_from"), F.count("*").alias("n_known"))
        .where(F.col("n_known") == cfg.min_history)
    )
    # A vendor has few shapes; a shape's alert tells how many there were before it.
    before = F.row_number().over(W.partitionBy("vendor").orderBy("first_seq")) - 1
    new = (
        vendor_formats(invoices)
        .withColumn("n_before", before)
        .join(started, "vendor")
        .where((F.col("first_seq") > F.col("known_from")) & (F.col("n_before") > 0))
    )
    return format_rows(new)


def format_rows(new: DataFrame) -> DataFrame:
    """Alerts of invoices with a new ``format``, after ``n_before`` others."""
    return _rows(
        new,
        _alert("inconsistent_invoice_format", [
            _text("Current format: ", F.col("format")),
            _text("Shapes used before: ", F.col("n_before").cast("string")),
        ]),
    )


def amount_history(invoices: DataFrame) -> DataFrame:
    """Each invoice with count, mean and population deviation of the vendor's earlier totals.

    Sums are taken of amounts shifted by the vendor's mean, so that squares do not cancel.
    """
    df = prepare(invoices).select("invoice_id", "seq", "vendor", "total", *_block_of(invoices))
    means = df.groupBy("vendor").agg(F.avg("total").alias("centre"), F.count("*").alias("n_rows"))
    blocked = df if "_block" in df.columns else with_block(df, "seq")
    shifted = lookup(blocked, means, ["vendor"], "n_rows", ["seq"]).withColumn(
        "x", F.col("total") - F.col("centre")
    )
    known = F.col("total").isNotNull()
    run = running_before(
        shifted,
        ["vendor"],
        "seq",
        {
            "n_before": F.when(known, 1).otherwise(0).cast("long"),
            "sum_x": F.when(known, F.col("x")).otherwise(0.0),
            "sum_xx": F.when(known, F.col("x") * F.col("x")).otherwise(0.0),
        },
        {"min_before": ("min", F.col("total")), "max_before": ("max", F.col("total"))},
    )
    n, mean_x = F.col("n_before"), F.try_divide("sum_x", "n_before")
    return run.select(
        "invoice_id",
        "vendor",
        "total",
        "n_before",
        "min_before",
        "max_before",
        (F.col("centre") + mean_x).alias("mean_before"),
        F.sqrt(F.greatest(F.try_divide("sum_xx", n) - mean_x * mean_x, F.lit(0.0))).alias("std_before"),
    )


def amount_anomalies(invoices: DataFrame, cfg: FraudConfig = FraudConfig()) -> DataFrame:
    z = F.abs(F.try_divide(F.col("total") - F.col("mean_before"), F.col("std_before")))
    varied = F.col("min_before") < F.col("max_before")
    return (
        amount_history(invoices)
        .where((F.col("n_before") >= cfg.min_history) & varied)
        .withColumn("z", z)
        .where(F.col("z") > cfg.history_z)
    )


def amount_alerts(invoices: DataFrame, cfg: FraudConfig = FraudConfig()) -> DataFrame:
    return amount_rows(amount_anomalies(invoices, cfg))


def amount_rows(found: DataFrame) -> DataFrame:
    """Alerts of invoices whose ``total`` is ``z`` deviations off the vendor's mean."""
    return _rows(
        found,
        _alert("amount_anomaly", [
            _text("Current amount: ", _dollars("total")),
            _text("Historical average: ", _dollars("mean_before")),
            _text("Standard deviation: ", _dollars("std_before")),
            _text("Z-score: ", fixed("z", 2)),
        ]),
    )


def unpaid(invoices: DataFrame, transactions: DataFrame, cfg: FraudConfig = FraudConfig()) -> DataFrame:
    """Invoices without any transaction within a month whose vendor contains the invoice
    vendor, or with ``vendor_chars`` its first characters.

    Vendor names are found in payees by automata (see ``contained``), payments are reduced to
    days per name start, and a range window per name start finds the nearest payment. Its
    groups hold calendar days, not rows.
    """
    df = prepare(invoices).where(
        F.coalesce(F.col("total") != 0, F.lit(False)) & F.col("d").isNotNull() & present("vendor")
    ).withColumn("start", F.col("vendor") if cfg.vendor_chars is None else F.substring("vendor", 1, cfg.vendor_chars))
    starts = df.select("start").distinct()
    pays = transactions.where("vendor is not null and d is not null").select(
        F.lower("vendor").alias("payee"), "d"
    ).distinct()
    payees = pays.select(F.col("payee").alias("text")).distinct()
    named = contained_names(payees, starts.select(F.col("start").alias("name"))).toDF("payee", "start")
    paid_days = pays.join(named, "payee").select("start", "d").distinct()
    asked = df.groupBy("start", "d").agg(F.count("*").alias("n_asked"))
    day_no = F.datediff("d", F.lit("1970-01-01").cast("date"))
    span = W.partitionBy("start").orderBy("day_no").rangeBetween(-cfg.payment_days, cfg.payment_days)
    calendar = (
        asked.withColumn("paid", F.lit(0))
        .unionByName(paid_days.withColumn("n_asked", F.lit(0).cast("long")).withColumn("paid", F.lit(1)))
        .withColumn("day_no", day_no)
        .withColumn("any_paid", F.max("paid").over(span))
    )
    open_days = calendar.where("n_asked > 0 and any_paid = 0").select("start", "d", "n_asked")
    return lookup(df, open_days, ["start", "d"], "n_asked", ["seq"]).drop("n_asked", "start")


def unpaid_alerts(invoices: DataFrame, transactions: DataFrame, cfg: FraudConfig = FraudConfig()) -> DataFrame:
    return _rows(
        unpaid(invoices, transactions, cfg),
        _alert("no_matching_transaction", [
            _text("Invoice amount: ", _dollars("total")),
            _text("Invoice date: ", F.col("d").cast("string")),
            _text("Vendor: ", F.col("vendor")),
            F.lit(f"No transaction found within {cfg.payment_days} days"),
        ]),
    )


def alerts(
    invoices: DataFrame, transactions: DataFrame | None = None, cfg: FraudConfig = FraudConfig()
) -> DataFrame:
    """All alerts of all rules; ids are hashes of the content. The invoices are written once, in blocks of their order,
    for the rules that look back."""
    invoices = with_block(invoices, "seq")
    found = document_alerts(invoices, cfg)
    for more in (
        duplicate_alerts(invoices),
        near_duplicate_alerts(invoices, cfg),
        format_alerts(invoices, cfg),
        amount_alerts(invoices, cfg),
    ):
        found = found.unionByName(more)
    if transactions is not None:
        found = found.unionByName(unpaid_alerts(invoices, transactions, cfg))
    return with_alert_id(found)


def with_alert_id(found: DataFrame) -> DataFrame:
    content = F.concat_ws("|", "invoice_id", "alert_type", F.array_join("evidence", "|"))
    return found.withColumn("alert_id", F.sha2(content, 256))


def _band(index: int) -> Column:
    out = None
    for band in RISK_BANDS:
        floor, value = band[0], F.lit(band[index])
        if floor is None:
            return out.otherwise(value)
        cond = F.col("risk_score") >= floor
        out = F.when(cond, value) if out is None else out.when(cond, value)
    raise ValueError("the last band has no floor")


def risk(invoices: DataFrame, found: DataFrame) -> DataFrame:
    """Score, level, counts and recommendation of every invoice, also without alerts."""
    points = F.create_map(*[F.lit(x) for pair in SEVERITY_POINTS.items() for x in pair])
    per = found.groupBy("invoice_id").agg(
        F.sum(points[F.col("severity")] * F.col("confidence") * F.col("occurrences")).alias("points"),
        F.sum("occurrences").alias("alert_count"),
        F.sum(F.when(F.col("severity") == "critical", F.col("occurrences")).otherwise(0)).alias("critical_alerts"),
        F.sum(F.when(F.col("severity") == "high", F.col("occurrences")).otherwise(0)).alias("high_alerts"),
    )
    zero = F.lit(0).cast("long")
    return (
        invoices.select("invoice_id")
        .join(per, "invoice_id", "left")
        .select(
            "invoice_id",
            F.least(F.coalesce("points", F.lit(0.0)), F.lit(100.0)).alias("risk_score"),
            F.coalesce("alert_count", zero).alias("alert_count"),
            F.coalesce("critical_alerts", zero).alias("critical_alerts"),
            F.coalesce("high_alerts", zero).alias("high_alerts"),
        )
        .withColumn("risk_level", _band(1))
        .withColumn("recommendation", _band(2))
    )


def keep_results(results: DataFrame, path: str | None = None) -> str:
    """Keep fraud results for lookups by ``invoice_id``; returns the table's name."""
    return write_keyed(results, "invoice_id", path=path)


def result_of(spark: SparkSession, table: str, invoice_id: str) -> DataFrame:
    """The kept fraud result of one invoice, if there is one; reads one bucket."""
    return find(spark, table, "invoice_id", invoice_id)


def alert_counts(found: DataFrame) -> DataFrame:
    """Counts over all invoices, as the alert overview shows them."""
    return found.agg(
        F.coalesce(F.sum("occurrences"), F.lit(0)).alias("total_alerts"),
        F.coalesce(F.sum(F.when(F.col("severity") == "critical", F.col("occurrences"))), F.lit(0)).alias("critical_alerts"),
        F.coalesce(F.sum(F.when(F.col("severity") == "high", F.col("occurrences"))), F.lit(0)).alias("high_alerts"),
    )
