"""Cleaning, ids, features, keyword categories and paging of transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DateType, DoubleType, FloatType, MapType, StructType, TimestampNTZType, TimestampType

from outlay.functions.text import strip
from outlay.operators.skew import row_index
from outlay.session import materialize

# The category keywords and the category of everything else.
CATEGORY_KEYWORDS: dict[str, list[str]] = {
    "Cloud Services": ["aws", "azure", "gcp", "cloud", "hosting", "digitalocean", "heroku", "linode"],
    "Travel": ["uber", "lyft", "flight", "hotel", "airbnb", "taxi", "airline", "booking", "delta", "marriott"],
    "Food & Dining": ["starbucks", "chipotle", "subway", "panera", "restaurant", "cafe", "zomato", "swiggy", "doordash"],
    "Office Expenses": ["office", "supplies", "furniture", "depot", "staples", "ikea"],
    "Software": ["adobe", "microsoft", "slack", "zoom", "github", "atlassian", "jetbrains"],
    "Marketing": ["google ads", "facebook", "linkedin", "mailchimp", "hubspot", "salesforce"],
    "Operations": ["utilities", "rent", "insurance", "payroll", "legal", "accounting", "electric", "internet"],
}
DEFAULT_CATEGORY = "Miscellaneous"
LARGE_AMOUNT_CATEGORY = "Operations"
LARGE_AMOUNT = 5000.0
KEYWORD_CONFIDENCE = 0.85
REVIEW_BELOW = 0.7

COLUMN_ALIASES = {"merchant": "vendor", "desc": "description"}
REQUIRED_COLUMNS = ("date", "vendor", "amount")
MIN_ROWS = 10
DATE_FORMATS = ("M/d/yyyy", "yyyy/M/d", "d-M-yyyy", "d MMM yyyy", "MMM d, yyyy", "MMMM d, yyyy")

NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI]nf(inity)?)\s*$"


def alias_columns(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed(
        {old: new for old, new in COLUMN_ALIASES.items() if old in df.columns and new not in df.columns}
    )


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED_COLUMNS if c not in df.columns]


def number(col: str) -> Column:
    """Text to number; anything that is not a plain number gives null."""
    text = F.col(col).cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def input_report(df: DataFrame) -> DataFrame:
    """One row: how many rows arrive, why some are dropped, and whether enough stay."""
    absent = missing_columns(df)
    if absent:
        raise ValueError(f"missing required columns: {', '.join(absent)}")
    amount = number("amount")
    return df.agg(
        F.count("*").alias("n_raw"),
        F.count_if(F.col("amount").isNull()).alias("n_null_amount"),
        F.count_if(F.col("amount").isNotNull() & amount.isNull()).alias("n_bad_amount"),
        F.count_if(amount <= 0).alias("n_not_positive"),
        F.count_if(amount > 0).alias("n_clean"),
    ).withColumn("accepted", (F.col("n_raw") >= MIN_ROWS) & (F.col("n_clean") >= MIN_ROWS))


def clean(df: DataFrame) -> DataFrame:
    """Drop rows without a positive amount; lower-case vendors; fill descriptions."""
    df = alias_columns(df)
    if "description" not in df.columns:
        df = df.withColumn("description", F.lit(""))
    return (
        df.withColumn("amount", number("amount"))
        .where("amount > 0")
        .withColumn("vendor", F.coalesce(strip(F.lower("vendor")), F.lit("unknown")))
        .withColumn("description", F.coalesce("description", F.lit("")))
    )


def assign_ids(df: DataFrame, order: str, start: int | Column = 0) -> DataFrame:
    """``txn_NNN`` in the order of a unique column, counted from ``start``."""
    at = F.col("_at") + (start if isinstance(start, Column) else F.lit(start))
    return (
        row_index(df, order, "_at")
        .withColumn("id", F.concat(F.lit("txn_"), zero_padded(at)))
        .drop("_at")
    )


def zero_padded(n: Column, width: int = 3) -> Column:
    text = n.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def next_index(df: DataFrame) -> DataFrame:
    """One row: the first free id number."""
    suffix = F.regexp_extract("id", r"txn_(\d+)", 1)
    largest = F.max(F.when(suffix != "", suffix.cast("long")))
    return df.agg(F.coalesce(largest + 1, F.count("*")).alias("next_index"))


def engineer_features(df: DataFrame) -> DataFrame:
    """Parse dates (bad ones become null) and add weekday, hour and amount features."""
    text = strip(F.col("date").cast("string"))
    parsed = F.coalesce(
        text.try_cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS]
    )
    return (
        df.withColumn("ts", parsed)
        .withColumn("d", F.to_date("ts"))
        .withColumn("vendor_normalized", F.col("vendor"))
        .withColumn("day_of_week", F.weekday("ts"))
        .withColumn("hour", F.coalesce(F.hour("ts"), F.lit(-1)))
        .withColumn("amount_float", F.col("amount"))
    )


def categorize_keywords(
    df: DataFrame,
    dictionary: dict[str, list[str]] | None = None,
    whole_words: bool = False,
) -> DataFrame:
    """The category with the most distinct keywords found; ties and misses get defaults."""
    dictionary = dictionary or CATEGORY_KEYWORDS
    text = F.lower(F.concat_ws(" ", F.coalesce("vendor", F.lit("")), F.coalesce("description", F.lit(""))))

    def found(keyword: str) -> Column:
        if whole_words:
            return text.rlike(rf"\b\Q{keyword}\E\b")
        return F.contains(text, F.lit(keyword))

    scores = F.array(
        *[
            F.struct(
                reduce(lambda a, b: a + b, [found(k).cast("int") for k in dict.fromkeys(words)]).alias("score"),
                F.lit(category).alias("category"),
            )
            for category, words in dictionary.items()
        ]
    )
    best = F.array_max(F.transform("_scores", lambda s: s["score"]))
    leaders = F.filter("_scores", lambda s: s["score"] == F.col("_best"))
    category = (
        F.when(
            F.col("_best") == 0,
            F.when(F.col("amount") > LARGE_AMOUNT, LARGE_AMOUNT_CATEGORY).otherwise(DEFAULT_CATEGORY),
        )
        .when(F.size(leaders) > 1, DEFAULT_CATEGORY)
        .otherwise(leaders[0]["category"])
    )
    return (
        df.withColumn("_scores", scores)
        .withColumn("_best", best)
        .withColumn("category", category)
        .withColumn("category_confidence", F.lit(KEYWORD_CONFIDENCE))
        .withColumn("needs_review", F.lit(False))
        .drop("_scores", "_best")
    )


#: Arriving contents whose hashes are broadcast.
ARRIVING_FEW = 200_000
PAGE_BLOCK_ROWS, PAGE_BLOCKS = 100_000, 10_000


def filtered(df: DataFrame, category: str | None = None, anomaly: bool | None = None) -> DataFrame:
    """The rows that pages are made of."""
    if category is not None:
        df = df.where(F.col("category") == category)
    if anomaly is not None:
        df = df.where(F.col("is_anomaly") == anomaly)
    return df


def page_blocks(df: DataFrame, block_rows: int = PAGE_BLOCK_ROWS) -> list[tuple[int, int, int]]:
    """``(first, last, rows)`` of ranges of ``seq`` in order: at most about ``PAGE_BLOCKS``, of ``block_rows`` rows or more each.

    Kept beside a table it lets every page be read from one or two ranges. A row's range is searched for among the sorted cuts,
    and ranges are counted in each batch before anything is shuffled.
    """
    n = df.count()
    parts = min(-(-n // block_rows), PAGE_BLOCKS)
    if parts <= 1:
        cuts = []
    else:
        cuts = df.agg(F.percentile_approx("seq", [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    cuts, kind = sorted(set(cuts)), df.schema["seq"].dataType.simpleString()

    def counted(batches):
        """First, last and number of the rows of each block in a batch; rows without ``seq`` count to the first block."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            seq = batch.column(0)
            known = pc.drop_null(seq)
            block = np.searchsorted(cuts, known.to_numpy(zero_copy_only=False), "left").astype(np.int32)
            table = pa.table({"block": pa.array(block), "seq": known}).group_by("block").aggregate([("seq", "min"), ("seq", "max"), ("seq", "count")])
            for part in table.select(["block", "seq_min", "seq_max", "seq_count"]).rename_columns(["block", "first", "last", "n"]).to_batches():
                yield part
            if seq.null_count:
                none = pa.nulls(1, seq.type)
                yield pa.record_batch({"block": pa.array([0], pa.int32()), "first": none, "last": none, "n": pa.array([seq.null_count])})

    parts = df.select("seq").mapInArrow(counted, f"block int, first {kind}, last {kind}, n long")
    ranges = parts.groupBy("block").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    return [(r.first, r.last, r.n) for r in ranges.select("first", "last", "n").orderBy("first").collect()]


def page(
    df: DataFrame,
    page_no: int = 1,
    limit: int = 50,
    category: str | None = None,
    anomaly: bool | None = None,
    after: int | None = None,
    blocks: list[tuple[int, int, int]] | None = None,
) -> DataFrame:
    """One page of the filtered table in input order (``seq``), with the total rows and pages on each row.

    ``after``, the last ``seq`` of the page before, makes a deep page as cheap as the first. Without it the
    ranges of ``page_blocks`` (of the filtered rows; counted if not given) tell where the page begins: rows of other ranges
    are neither sorted nor moved.
    """
    df = filtered(df, category, anomaly)
    if after is not None:
        total, rest = df.agg(F.count("*")).scalar(), df.where(F.col("seq") > after).orderBy("seq")
    else:
        blocks = page_blocks(df) if blocks is None else blocks
        total, skip = F.lit(sum(n for _, _, n in blocks)).cast("long"), (page_no - 1) * limit
        upto, met = 0, []
        for first, last, n in blocks:
            if upto < skip + limit and skip < upto + n:
                met.append((first, last, upto))
            upto += n
        if met:
            rest = df.where(F.col("seq").between(met[0][0], met[-1][1])).orderBy("seq").offset(skip - met[0][2])
        else:
            rest = df.where("false")
    return (
        rest.limit(limit)
        .withColumn("total_count", total)
        .withColumn("total_pages", F.ceil(F.col("total_count") / F.lit(limit)))
    )


def records(df: DataFrame) -> DataFrame:
    """Each row as one JSON text: NaN becomes null, dates ``yyyy-MM-dd``, nulls are kept, at any depth."""

    def safe(col: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            inner = F.struct(*[safe(col[f.name], f.dataType).alias(f.name) for f in kind.fields])
            return F.when(col.isNotNull(), inner)
        if isinstance(kind, ArrayType):
            return F.transform(col, lambda x: safe(x, kind.elementType))
        if isinstance(kind, MapType):
            return F.transform_values(col, lambda _, v: safe(v, kind.valueType))
        if isinstance(kind, (DoubleType, FloatType)):
            return F.when(~F.isnan(col), col)
        if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
            return F.date_format(col, "yyyy-MM-dd")
        return col

    fields = [safe(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"))


def from_invoices(invoices: DataFrame) -> DataFrame:
    """Transaction rows that stand for processed invoices."""
    return invoices.select(
        F.col("d"),
        F.coalesce(strip(F.lower("vendor")), F.lit("unknown")).alias("vendor"),
        F.col("total").alias("amount"),
        F.concat(F.lit("Invoice "), F.coalesce("invoice_number", F.lit("N/A"))).alias("description"),
        F.lit("invoice_ocr").alias("source"),
        F.col("invoice_id"),
        F.col("confidence"),
    ).where("amount > 0")


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def new_documents(arriving: DataFrame, known: DataFrame) -> DataFrame:
    """One row per distinct content among those whose hash is not known yet.

    Known hashes are first reduced to those that arrive again: the arriving ones are broadcast up to ``ARRIVING_FEW``, and
    the known ones, of which there may be very many more, are filtered where they lie. What is shuffled follows the arriving
    contents. Larger arrivals are joined by hash.
    """
    hashed = arriving.withColumn("file_hash", F.sha2(F.col("content"), 256))
    first = hashed.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    first = materialize(first, "arrived")
    hashes = first.select("file_hash")
    few = F.broadcast if first.count() <= ARRIVING_FEW else (lambda df: df)
    again = known.select("file_hash").join(few(hashes), "file_hash", "left_semi").distinct()
    return first.join(few(again), "file_hash", "left_anti")
