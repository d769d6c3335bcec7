"""Profiles of untyped tables: types, blanks, distinct values, signs and layout, each one aggregation over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrules.sources.ingest import parse_amount

# Date forms that are recognised, money and numbers, words of a header that mean money.
DATE_FORMS = {"MM/dd/yyyy": r"^\d{1,2}/\d{1,2}/\d{4}$", "MM/dd/yy": r"^\d{1,2}/\d{1,2}/\d{2}$", "yyyy-MM-dd": r"^\d{4}-\d{2}-\d{2}$", "MM-dd-yyyy": r"^\d{1,2}-\d{1,2}-\d{4}$", "dd.MM.yyyy": r"^\d{1,2}\.\d{1,2}\.\d{4}$"}
CURRENCY = r"^[$€£¥]\s*-?[\d,]+\.?\d*$|^-?[$€£¥]\s*[\d,]+\.?\d*$"
NUMBER = r"^-?[\d,]+\.?\d*$|^\([\d,]+\.?\d*\)$"
TICKER = r"^[A-Z]{1,5}$"
MONEY_HEADER = r"(?i)\$|amount|price|cost|fee|balance|total"
SAMPLES, CREDITS = 5, 10


def long_form(df: DataFrame) -> DataFrame:
    """name, value: one row per cell; blank cells are null."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.trim(F.col(c).cast("string")).alias("value")) for c in df.columns])
    return df.select(F.explode(cells).alias("c")).select("c.name", F.when(F.col("c.value") != "", F.col("c.value")).alias("value"))


def column_profile(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Per column: filled, blank_share, distinct, type, samples (its first SAMPLES values). A type needs `share` of the filled values (a ticker half of them)."""
    rate = lambda p: F.avg(F.col("value").rlike(p).cast("double"))
    cells = long_form(df)
    found = cells.groupBy("name").agg(
        F.count("value").alias("filled"),
        F.avg(F.col("value").isNull().cast("double")).alias("blank_share"),
        F.countDistinct("value").alias("distinct"),
        *[rate(p).alias(f"d{k}") for k, p in enumerate(DATE_FORMS.values())],
        rate(CURRENCY).alias("currency"),
        rate(NUMBER).alias("number"),
        rate(TICKER).alias("ticker"),
    )
    kind = F.when(F.col("filled") == 0, "empty")
    for k, form in enumerate(DATE_FORMS):
        kind = kind.when(F.col(f"d{k}") >= share, f"date {form}")
    kind = (
        kind.when(F.col("currency") >= share, "currency")
        .when((F.col("number") >= share) & F.col("name").rlike(MONEY_HEADER), "currency")
        .when(F.col("number") >= share, "number")
        .when((F.col("distinct") <= 15) & (F.col("filled") >= 5), "categorical")
        .when(F.col("ticker") >= 0.5, "ticker")
        .otherwise("text")
    )
    ranked = cells.filter("value IS NOT NULL").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy("value"))).filter(F.col("rank") <= SAMPLES)
    samples = ranked.groupBy("name").agg(F.array_sort(F.collect_list("value")).alias("samples"))
    return found.join(samples, "name", "left").select("name", "filled", "blank_share", "distinct", kind.alias("type"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def value_counts(df: DataFrame, most: int = 20) -> DataFrame:
    """Values with their counts, of the columns that have at most `most` distinct values."""
    counts = long_form(df).filter("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("name").agg(F.count("*").alias("distinct")).filter(F.col("distinct") <= most).select("name")
    return counts.join(few, "name", "left_semi")


def _samples(rows: DataFrame, n: int, name: str) -> DataFrame:
    """One row: an array of the n first different (description, amount)."""
    first = rows.select("description", "amount").distinct().orderBy("description", "amount").limit(n)
    return first.agg(F.array_sort(F.collect_list(F.struct("description", "amount"))).alias(name))


def sign_profile(amounts: DataFrame, amount: str = "amount", description: str = "description") -> DataFrame:
    """One row: amounts of 0 or more and negative ones, with their totals by size, share of the former, convention (70 / 30 percent, else the larger
    total), whether negating is advised, and CREDITS samples of negative amounts."""
    rows = amounts.select(F.col(description).alias("description"), F.col(amount).alias("amount"))
    found = rows.filter("amount IS NOT NULL").agg(
        F.sum((F.col("amount") >= 0).cast("int")).alias("positive"),
        F.sum((F.col("amount") < 0).cast("int")).alias("negative"),
        F.sum(F.greatest("amount", F.lit(0.0))).alias("positive_total"),
        F.sum(F.greatest(-F.col("amount"), F.lit(0.0))).alias("negative_total"),
    )
    share = F.try_divide(F.col("positive"), F.col("positive") + F.col("negative"))
    negate = (F.col("positive_share") < 0.3) | ((F.col("positive_share") <= 0.7) & (F.col("positive_total") <= F.col("negative_total")))
    told = found.withColumn("positive_share", share).withColumn("negate", negate).withColumn("convention", F.when(F.col("negate"), "expenses negative").otherwise("expenses positive"))
    return told.join(F.broadcast(_samples(rows.filter("amount < 0"), CREDITS, "sample_credits")))  # one row each


def amount_notes(raw: DataFrame, column: str, description: str) -> DataFrame:
    """One row over amount texts: with parentheses, with symbols, numbers of decimals seen, whether some have decimals and some none, positive and
    negative ones with SAMPLES samples; zeros and what is no number are left out of the latter."""
    c = F.trim(column)
    value = parse_amount(F.col(column))
    rows = raw.select(F.trim(description).alias("description"), value.alias("amount"), c.alias("text")).filter("amount IS NOT NULL")
    decimals = F.length(F.regexp_extract("text", r"\.(\d*)\)?$", 1))
    pointed = F.contains("text", F.lit("."))
    found = rows.agg(
        F.sum(F.col("text").rlike(r"^\(.*\)$").cast("int")).alias("in_parentheses"),
        F.sum(F.col("text").rlike("[$€£¥]").cast("int")).alias("with_symbol"),
        F.array_sort(F.collect_set(F.when(pointed, decimals))).alias("decimal_places"),
        (F.max(pointed) & ~F.min(pointed)).alias("mixed"),
        F.sum((F.col("amount") > 0).cast("int")).alias("positive"),
        F.sum((F.col("amount") < 0).cast("int")).alias("negative"),
    )
    for sign, kept in (("positive", "amount > 0"), ("negative", "amount < 0")):
        found = found.join(F.broadcast(_samples(rows.filter(kept), SAMPLES, f"sample_{sign}")))
    return found


# Separators that an export may have.
DELIMITERS = (",", ";", "\t", "|")


def layout(lines: DataFrame, value: str = "value") -> DataFrame:
    """One row over text lines: n, dates (lines that begin with a date and two blanks), amounts (lines that end with an amount), thousands (whether a separator of thousands
    occurs), delimiter and the likely layout.

    Signs of columns: long lines of nearly equal length 1, three dates or more 2, three amounts or more 1; from 3 on the layout is fixed_width. Else it is csv, if some
    delimiter, not counted inside quotes or between thousands, occurs equally often in nine of ten lines; else unknown.
    """
    text = F.col(value)
    bare = F.regexp_replace(text, '"[^"]*"', "")
    count = {d: F.length(b) - F.length(F.replace(b, F.lit(d), F.lit(""))) for d in DELIMITERS for b in [F.regexp_replace(bare, r"(?<=\d),(?=\d{3}(?!\d))", "") if d == "," else bare]}
    rows = lines.filter(F.trim(value) != "").select(text.alias("line"), *[n.alias(f"d{k}") for k, n in enumerate(count.values())])
    usual = rows.agg(*[F.mode(f"d{k}", deterministic=True).alias(f"m{k}") for k in range(len(DELIMITERS))])
    size = F.length("line")
    found = rows.join(F.broadcast(usual)).agg(
        F.count("*").alias("n"),
        F.sum(F.col("line").rlike(r"^\d{2}/\d{2}/\d{4}\s{2,}").cast("int")).alias("dates"),
        F.sum(F.col("line").rlike(r"\s+-?[\d,]+\.\d{2}\s*$").cast("int")).alias("amounts"),
        F.max(F.col("line").rlike(r"\d{1,3},\d{3}")).alias("thousands"),
        ((F.avg(size) > 80) & (F.max(size) - F.min(size) < 20)).alias("even"),
        *[F.avg(((F.col(f"m{k}") > 0) & (F.col(f"d{k}") == F.col(f"m{k}"))).cast("double")).alias(f"s{k}") for k in range(len(DELIMITERS))],
    )
    signs = F.col("even").cast("int") + F.when(F.col("dates") >= 3, 2).otherwise(0) + F.when(F.col("amounts") >= 3, 1).otherwise(0)
    delimiter = F.coalesce(*[F.when(F.col(f"s{k}") >= 0.9, F.lit(d)) for k, d in enumerate(DELIMITERS)])
    kind = F.when(signs >= 3, "fixed_width").when(delimiter.isNotNull(), "csv").otherwise("unknown")
    return found.select("n", "dates", "amounts", "thousands", delimiter.alias("delimiter"), kind.alias("layout"))
