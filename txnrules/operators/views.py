"""Views: named conditions over merchants, which may overlap.

A merchant's features are columns of one table (from `features`), so a view is a Spark SQL condition over them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrules.functions.values import holds, period_key
from txnrules.operators.spend import SPECIAL, merchant_periods, total


@dataclass
class View:
    """name, condition in Spark SQL over the features, and its own variables (name -> SQL), in order."""

    name: str
    when: str
    variables: dict[str, str] = field(default_factory=dict)


def features(df: DataFrame) -> DataFrame:
    """Per merchant: n_payments, months, total, cv of the monthly totals (signed), avg, max, min, stddev of payments, tags, category, subcategory, and over its months'
    totals and sizes: n_periods, max_sum, min_sum, avg_sum, max_count. One pass over the transactions, into merchant and month; no list of payments is gathered."""
    return features_of(merchant_periods(df))


def features_of(periods: DataFrame) -> DataFrame:
    """`features` from the rows of `spend.merchant_periods`, or of a kept state."""
    n, s = F.sum("n"), F.sum("total")
    spread = F.sqrt(F.greatest(F.sum("squares") - s * s / n, F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))
    cv = F.when((F.count("*") < 2) | (F.avg("total") == 0), 0.0).otherwise(F.stddev_pop("total") / F.avg("total"))
    return (
        periods.groupBy("merchant")
        .agg(
            n.alias("n_payments"),
            F.count("*").alias("months"),
            s.alias("total"),
            cv.alias("cv"),
            (s / n).alias("avg"),
            F.max("max").alias("max"),
            F.min("min").alias("min"),
            F.coalesce(spread, F.lit(0.0)).alias("stddev"),
            F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_set("tags")), F.lower))).alias("tags"),
            F.max("last").alias("last"),
            F.count("*").alias("n_periods"),
            F.max("total").alias("max_sum"),
            F.min("total").alias("min_sum"),
            F.avg("total").alias("avg_sum"),
            F.max("n").alias("max_count"),
        )
        .select("*", "last.category", "last.subcategory")
        .drop("last")
    )


def months_in(df: DataFrame) -> DataFrame:
    """One row: n_months in the data, 12 if there are none; shares the pass of `features`."""
    return months_of(merchant_periods(df))


def months_of(periods: DataFrame) -> DataFrame:
    found = periods.agg(F.countDistinct("month").alias("n"))
    return found.select(F.when(F.col("n") > 0, F.col("n")).otherwise(12).alias("n_months"))


def by_period(df: DataFrame, unit: str) -> DataFrame:
    """merchant, period: sum, count, avg, max, min, stddev of its payments."""
    return (
        df.withColumn("period", period_key(unit, F.col("date")))
        .groupBy("merchant", "period")
        .agg(
            total().alias("sum"),
            F.count("*").alias("count"),
            F.avg("effective_amount").alias("avg"),
            F.max("effective_amount").alias("max"),
            F.min("effective_amount").alias("min"),
            F.coalesce(F.stddev_samp("effective_amount"), F.lit(0.0)).alias("stddev"),
        )
    )


def periods(df: DataFrame) -> DataFrame:
    """One row: distinct months (12 if none), years (1 if none), weeks and days in the data."""
    counts = {u: F.countDistinct(period_key(u, F.col("date"))) for u in ("month", "year", "week", "day")}
    found = df.agg(*[c.alias(f"{u}s") for u, c in counts.items()])
    return found.select(F.when(F.col("months") > 0, F.col("months")).otherwise(12).alias("n_months"), F.greatest("years", F.lit(1)).alias("n_years"), F.col("weeks").alias("n_weeks"), F.col("days").alias("n_days"))


def ordinary(merchants: DataFrame) -> DataFrame:
    """Merchants without a tag that marks income, investment or transfer."""
    return merchants.filter(~F.arrays_overlap("tags", F.array(*[F.lit(t) for t in SPECIAL])))


def classify_views(merchants: DataFrame, views: list[View], variables: dict[str, str] | None = None) -> DataFrame:
    """merchants with `view`, a row for each view that holds; a condition that can't be told doesn't hold."""
    flagged = merchants
    for name, value in (variables or {}).items():
        flagged = flagged.withColumn(name, F.expr(value))
    flags = []
    for v in views:
        own = flagged
        for name, value in v.variables.items():
            own = own.withColumn(name, F.expr(value))
        flagged = own.withColumn(f"_in_{len(flags)}", holds(F.expr(v.when))).drop(*v.variables)
        flags.append(F.when(F.col(f"_in_{len(flags)}"), F.lit(v.name)))
    named = flagged.withColumn("view", F.explode(F.filter(F.array(*flags), lambda x: x.isNotNull())))
    return named.drop(*[f"_in_{k}" for k in range(len(views))])


# The default views.
DEFAULT_VIEWS = {
    "Total": "true",
    "Bills": "category = 'Bills' AND months >= 6",
    "Subscriptions": "category = 'Subscriptions'",
    "Groceries": "subcategory = 'Grocery'",
    "Dining": "subcategory IN ('Restaurant', 'Fast Food', 'Delivery')",
    "Travel": "category = 'Travel'",
    "Shopping": "category = 'Shopping'",
    "Health": "category = 'Health'",
    "Big Purchases": "total > 1000 AND months <= 3",
}


def default_views() -> list[View]:
    return [View(name, when) for name, when in DEFAULT_VIEWS.items()]


def monthly_figure() -> Column:
    """Average when active for consistent merchants, else total over the months of the data (n_months)."""
    return F.when(F.col("cv") < 0.3, F.col("total") / F.col("months")).otherwise(F.col("total") / F.col("n_months"))


def view_totals(placed: DataFrame) -> DataFrame:
    """Per view: merchants, total, total and monthly figures of its merchants, average by month of the data; placed has n_months."""
    return placed.groupBy("view").agg(F.count("*").alias("merchants"), F.sum("total").alias("total"), F.sum(monthly_figure()).alias("monthly"), F.sum(F.col("total") / F.col("n_months")).alias("per_month"))
