"""Reading text exports of transactions into one typed table, and rows that can't be read into a table of rejects."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrules.functions.text import trimmed
from txnrules.sources import records


@dataclass
class ColumnMap:
    """Which position holds which role. `captures` are named further positions; `template` builds the description from them."""

    date: int
    amount: int
    description: int | None = None
    location: int | None = None
    captures: dict[str, int] = field(default_factory=dict)
    template: str | None = None
    date_format: str = "%m/%d/%Y"
    decimal: str = "."
    sign: str = "as_is"  # or "negate", "absolute"

    @property
    def width(self) -> int:
        used = [self.date, self.amount, self.description, self.location, *self.captures.values()]
        return 1 + max(p for p in used if p is not None)


def spark_format(pattern: str) -> str:
    """strptime's pattern as Spark's; day and month take one or two digits."""
    known = {"%m": "M", "%d": "d", "%Y": "yyyy", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%H": "H", "%M": "m", "%S": "s"}
    return re.sub(r"%[a-zA-Z]", lambda m: known[m[0]], pattern)


def parse_amount(text: Column | str, decimal: str = ".") -> Column:
    """Number from text: (x) is negative, currency signs and thousands separators go; null if it is none."""
    text = trimmed(F.col(text) if isinstance(text, str) else text)
    bare = F.translate(F.regexp_replace(text, r"^\((.*)\)$", "$1"), "$€£¥ ", "")
    number = F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")) if decimal == "," else F.replace(bare, F.lit(","), F.lit(""))
    value = F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number.try_cast("double"))
    return F.when(text.rlike(r"^\(.*\)$"), -value).otherwise(value)


def parse_date(text: Column | str, pattern: str) -> Column:
    """Date from text; of a text with more after a blank only the first part is read, unless the pattern has a blank."""
    text = trimmed(F.col(text) if isinstance(text, str) else text)
    part = text if " " in pattern else F.regexp_extract(text, r"^(\S*)", 1)
    return F.try_to_date(part, spark_format(pattern))


def location_of(own: Column | None, description: Column) -> Column:
    """Own column, else two capitals that end the description; null if neither."""
    trailing = F.nullif(F.regexp_extract(description, r"\s([A-Z]{2})\s*$", 1), F.lit(""))
    return trailing if own is None else F.coalesce(F.nullif(trimmed(own), F.lit("")), trailing)


def read_delimited(spark: SparkSession, path: str, width: int, separator: str = ",", header: bool = True, multiline: bool = False) -> DataFrame:
    """All columns as text, by position c0 ... ; short lines have nulls at the end, and their number of cells in _cells. `separator` may be 'tab'.

    With `multiline` quoted cells may hold line ends; records are then put together by `records.read_ordered`, by any number of tasks.
    """
    if multiline:
        return records.read_ordered(spark, path, width, separator, header).drop("file", "offset", "line")
    separator = "\t" if separator == "tab" else separator
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(width)] + [T.StructField("_line", T.StringType())])
    read = spark.read.option("columnPruning", False).csv(path, schema=schema, sep=separator, header=header, quote='"', escape='"', enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_line")
    # Spark keeps the whole line where it has another number of cells than the schema.
    cells = F.size(F.split(F.regexp_replace("_line", '"(?:[^"]|"")*"', ""), re.escape(separator)))
    return read.select(*[f"c{k}" for k in range(width)], F.when(F.col("_line").isNotNull(), cells).alias("_cells"))


def read_pattern(spark: SparkSession, path: str, pattern: str, header: bool = False) -> DataFrame:
    """Lines that match from their start, a column c0 ... per group; other lines, and with `header` the first of each file, are left out."""
    java = "^(?:" + pattern.replace("(?P<", "(?<") + ")"
    groups = re.compile(pattern).groups
    lines = spark.read.csv(path, schema="value string", sep="\x01", quote="", escape="\x02", header=header, enforceSchema=True)
    return lines.filter(F.col("value").rlike(java)).select(*[F.regexp_extract("value", java, k + 1).alias(f"c{k}") for k in range(groups)])


def prepare(raw: DataFrame, columns: ColumnMap, source: str) -> DataFrame:
    """Typed rows, bad ones included: date, raw_description, description, amount, is_credit, source, location, field, reason (null for a good row)."""
    cell = lambda k: F.coalesce(trimmed(F.col(f"c{k}")), F.lit(""))
    captured = {n: cell(k) for n, k in columns.captures.items()}
    if columns.template:
        parts = re.split(r"\{(\w+)\}", columns.template)
        description = F.concat(*[captured[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)])
    else:
        description = cell(columns.description)
    amount = parse_amount(cell(columns.amount), columns.decimal)
    amount = F.abs(amount) if columns.sign == "absolute" else -amount if columns.sign == "negate" else amount
    made = raw.select(
        parse_date(cell(columns.date), columns.date_format).alias("date"),
        description.alias("raw_description"),
        description.alias("description"),
        amount.alias("amount"),
        (amount < 0).alias("is_credit"),
        F.lit(source).alias("source"),
        location_of(None if columns.location is None else cell(columns.location), description).alias("location"),
        (F.create_map(*[x for n, c in captured.items() for x in (F.lit(n), c)]) if captured else F.create_map().cast("map<string,string>")).alias("field"),
        (F.coalesce("_cells", F.lit(columns.width)) < columns.width if "_cells" in raw.columns else F.lit(False)).alias("_short"),
        (cell(columns.date) == "").alias("_no_date"),
        (cell(columns.amount) == "").alias("_no_amount"),
    )
    reason = (
        F.when(F.col("_short"), "too few columns")
        .when(F.col("_no_date") | F.col("_no_amount") | (F.trim("description") == ""), "empty")
        .when(F.col("date").isNull(), "bad date")
        .when(F.col("amount").isNull(), "bad amount")
        .when(F.col("amount") == 0, "zero amount")
    )
    return made.withColumn("reason", reason).drop("_short", "_no_date", "_no_amount")


def good(prepared: DataFrame) -> DataFrame:
    return prepared.filter("reason IS NULL").drop("reason")


def rejected(prepared: DataFrame) -> DataFrame:
    return prepared.filter("reason IS NOT NULL")


# Presets of two common layouts.
CARD = ColumnMap(date=0, description=1, amount=2)
BANK_LINE = r"(\d{1,2}/\d{1,2}/\d{4})\s+(.+?)\s+(-?[\d,]+\.\d{2})\s+(-?[\d,]+\.\d{2})\s*$"
BANK = ColumnMap(date=0, description=1, amount=2, sign="negate")

# Words by which a header names a role.
ROLES = {
    "date": ("date",),
    "description": ("description", "merchant", "payee", "memo", "name"),
    "amount": ("amount", "debit", "charge", "value"),
    "location": ("location", "city", "state"),
}


def by_header(df: DataFrame) -> DataFrame:
    """The columns whose names contain a role's word, under the role's name; the first of several wins."""
    taken = {}
    for role, words in ROLES.items():
        for name in df.columns:
            if role not in taken and name not in taken.values() and any(w in name.lower() for w in words):
                taken[role] = name
    return df.select(*[F.col(n).cast("string").alias(r) for r, n in taken.items()])


def unite(parts: list[DataFrame]) -> DataFrame:
    """All sources under one schema, with src_idx by their order."""
    numbered = [p.withColumn("src_idx", F.lit(k)) for k, p in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)


def read_sources(spark: SparkSession, sources: list[tuple[str, str, ColumnMap]]) -> DataFrame:
    """Good rows of all (path, name, columns) that can be read; a source that is missing or can't be read is passed over."""
    parts = []
    for path, name, columns in sources:
        try:
            parts.append(good(prepare(read_delimited(spark, path, columns.width), columns, name)))
        except AnalysisException as failed:
            warnings.warn(f"source {name} is passed over: {failed.getCondition() or failed}", stacklevel=2)
    if not parts:
        raise FileNotFoundError("none of the sources can be read")
    return unite(parts)


# Column names that hold money in a supplemental source.
MONEY = ("amount", "price", "total", "cost", "fee", "tax")


def read_supplemental(spark: SparkSession, path: str, date_format: str = "%m/%d/%Y", decimal: str = ".", multiline: bool = False) -> DataFrame:
    """A look-up source: names in lower case, cells trimmed, blank rows dropped, money as numbers (0 where it is none), dates as dates with the text in date_raw."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=multiline)
    cells = raw.select(*[trimmed(F.col(f"`{c}`")).alias(c.strip().lower()) for c in raw.columns])
    cells = cells.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(f"`{c}`"), F.lit("")) != "" for c in cells.columns]))
    for c in cells.columns:
        if c in MONEY:
            cells = cells.withColumn(c, F.coalesce(parse_amount(c, decimal), F.lit(0.0)))
    if "date" in cells.columns:
        cells = cells.withColumn("date_raw", F.col("date")).withColumn("date", parse_date("date", date_format))
    return cells


def read_rule_table(spark: SparkSession, path: str) -> DataFrame:
    """Rules as rows: ord, pattern, merchant, category, subcategory, tags; comment lines, blank lines and empty patterns are left out."""
    raw = spark.read.csv(path, header=True, comment="#", quote='"', escape='"')
    tags = F.split(F.coalesce("Tags", F.lit("")), r"\|") if "Tags" in raw.columns else F.array().cast("array<string>")
    place = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_row"))
    # A rule table is small: it is numbered in one task, by file and line.
    kept = place.filter(trimmed("Pattern") != "").withColumn("ord", F.row_number().over(Window.orderBy("_file", "_block", "_row")) - 1)
    return kept.select(
        "ord",
        trimmed("Pattern").alias("pattern"),
        trimmed("Merchant").alias("merchant"),
        F.nullif(trimmed("Category"), F.lit("")).alias("category"),
        trimmed("Subcategory").alias("subcategory"),
        F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != "").alias("tags"),
    )


def source_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(F.count("*").alias("n"))
