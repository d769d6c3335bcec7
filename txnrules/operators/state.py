"""Totals that are kept up to date: partial aggregates by month and batch, in three tables under one folder.

`totals` has a row per merchant and bucket, `facets` one per combination of category, subcategory, location, merchant and tags, `descriptions` one per merchant, category and description, each
within a month and a batch. Everything in them merges: sums, counts, least and greatest values, sets, the first and last rows of an explicit order. `add` writes the partial aggregates of new transactions
as partitions of their own (month, batch) by dynamic partition overwrite, so no file of another month or batch is touched, and a batch that is added again replaces
itself. Readers merge; with a list of months they read those months' partitions only. `compacted` writes the merged state into a new folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnrules.operators.spend import ORDER, suggested

GRAINS = {"totals": ["merchant", "bucket"], "facets": ["category", "subcategory", "location", "merchant", "tags"], "descriptions": ["merchant", "category", "description"]}
EXAMPLES = 3
_ORDER = "struct<date: date, description: string, amount: double, source: string>"
SCHEMAS = {
    "totals": f"merchant string, bucket string, n long, total double, amount double, squares double, max double, min double, last struct<order: {_ORDER}, category: string, subcategory: string>, first struct<order: {_ORDER}, rule: string>, tags array<string>",
    "facets": "category string, subcategory string, location string, merchant string, tags array<string>, n long",
    "descriptions": "merchant string, category string, description string, n long, size double, has_negative boolean, examples array<struct<date: date, amount: double, source: string>>",
}
# How the columns of each table merge.
MERGES = {
    "totals": {"n": F.sum, "total": F.sum, "amount": F.sum, "squares": F.sum, "max": F.max, "min": F.min, "last": F.max, "first": F.min, "tags": lambda x: F.array_sort(F.array_distinct(F.flatten(F.collect_set(x))))},
    "facets": {"n": F.sum},
    "descriptions": {"n": F.sum, "size": F.sum, "has_negative": F.max, "examples": lambda x: F.slice(F.array_sort(F.flatten(F.collect_list(x))), 1, EXAMPLES)},
}


def partials(df: DataFrame) -> dict[str, DataFrame]:
    """The three tables of transactions with buckets, each with its month."""
    order, p = F.struct(*ORDER), F.col("effective_amount")
    rule = F.col("matched_rule") if "matched_rule" in df.columns else F.lit(None).cast("string")
    totals = df.groupBy("month", *GRAINS["totals"]).agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(p), F.lit(0.0)).alias("total"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"),
        F.coalesce(F.sum(p * p), F.lit(0.0)).alias("squares"),
        F.max(p).alias("max"),
        F.min(p).alias("min"),
        F.max(F.struct(order.alias("order"), "category", "subcategory")).alias("last"),
        F.min(F.when(rule.isNotNull(), F.struct(order.alias("order"), rule.alias("rule")))).alias("first"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
    )
    facets = df.groupBy("month", *GRAINS["facets"]).agg(F.count("*").alias("n"))
    keys = ["month", *GRAINS["descriptions"]]
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(F.abs("amount")).alias("size"), F.max(F.col("amount") < 0).alias("has_negative"))
    # Spark keeps three rows of a group and task before the window.
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("date", "amount", "source"))).filter(F.col("_rank") <= EXAMPLES)
    first = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("date", "amount", "source"))).alias("examples"))
    same = [counted[k].eqNullSafe(first[k]) for k in keys]
    descriptions = counted.join(first, same).select(*[counted[k] for k in keys], "n", "size", "has_negative", "examples")
    return {"totals": totals, "facets": facets, "descriptions": descriptions}


def add(df: DataFrame, folder: str, batch: str, only: tuple[str, ...] = tuple(GRAINS)) -> None:
    """Add transactions with buckets as a batch of its own; adding the same batch again replaces what it had in those months."""
    for name, rows in partials(df).items():
        if name in only:
            rows.withColumn("batch", F.lit(batch)).hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(f"{folder}/{name}")


def merged(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """Rows of a table of the state merged by the keys."""
    return rows.groupBy(*keys).agg(*[merge(column).alias(column) for column, merge in MERGES[name].items()])


def read(spark: SparkSession, folder: str, name: str, months: list[str] | None = None) -> DataFrame:
    """A table of the state as it was written: partial rows by month and batch."""
    found = spark.read.schema(f"{SCHEMAS[name]}, month string, batch string").parquet(f"{folder}/{name}")
    return found.filter(F.col("month").isin(months)) if months is not None else found


def compacted(spark: SparkSession, folder: str, into: str) -> None:
    """The merged state as a single batch in another folder."""
    for name, grain in GRAINS.items():
        merged(read(spark, folder, name), name, "month", *grain).withColumn("batch", F.lit("all")).hint("rebalance", "month").write.partitionBy("month", "batch").parquet(f"{into}/{name}")


def merchant_periods(totals: DataFrame) -> DataFrame:
    """merchant, month and what `spend.of_periods` and `views.features_of` need."""
    return merged(totals, "totals", "merchant", "month")


def description_counts(descriptions: DataFrame) -> DataFrame:
    return descriptions.groupBy("merchant", "description").agg(F.sum("n").alias("n"))


def combinations(facets: DataFrame) -> DataFrame:
    """Counts of the combinations that `facets.values_of` needs."""
    return facets.groupBy(*GRAINS["facets"]).agg(F.sum("n").alias("n"))


def discover(descriptions: DataFrame, limit: int = 0) -> DataFrame:
    """As `spend.discover`, from the state."""
    unknown = merged(descriptions.filter(F.col("category") == "Unknown"), "descriptions", "description")
    examples = F.transform("examples", lambda x: F.struct(x["date"].alias("date"), x["amount"].alias("amount")))
    return suggested(unknown.select("description", F.col("n").alias("count"), F.col("size").alias("total"), "has_negative", examples.alias("examples")), limit)
