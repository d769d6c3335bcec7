"""Numbers, dates and arrays, with the rule language's meaning where it differs from Spark's."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quotient(a: Column, b: Column) -> Column:
    """0 where the divisor is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))


def remainder(a: Column, b: Column) -> Column:
    """Takes the divisor's sign; 0 where the divisor is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a - b * F.floor(F.try_divide(a, b)))


def chain(*parts: Column) -> Column:
    """a < b < c ..."""
    found = F.lit(True)
    for a, b in zip(parts, parts[1:], strict=False):
        found = found & (a < b)
    return found


def holds(condition: Column) -> Column:
    """False where the condition can't be told."""
    return F.coalesce(condition, F.lit(False))


def date_part(part: str, date: Column) -> Column:
    """month, year, day or weekday (Monday is 0); 0 without a date."""
    return F.coalesce({"month": F.month, "year": F.year, "day": F.day, "weekday": F.weekday}[part](date), F.lit(0))


def period_key(unit: str, date: Column) -> Column:
    """Text key of month, year, day or week (weeks start on Monday; week 00 is before the first one)."""
    if unit == "week":
        week = F.floor((F.dayofyear(date) - 1 + 7 - F.weekday(date)) / 7)
        return F.format_string("%d-W%02d", F.year(date), week)
    return F.date_format(date, {"month": "yyyy-MM", "year": "yyyy", "day": "yyyy-MM-dd"}[unit])


def months_between_keys(first: str, last: str) -> Column:
    """Array of the month keys from first to last."""
    days = F.sequence(F.to_date(F.lit(first + "-01")), F.to_date(F.lit(last + "-01")), F.expr("INTERVAL 1 MONTH"))
    return F.transform(days, lambda d: F.date_format(d, "yyyy-MM"))


# Names of the months.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def resolve_month(df: DataFrame, wanted: str, date: str = "date") -> DataFrame:
    """One row, month: the key itself, or the latest month in the data that a name or number stands for."""
    if len(wanted) == 7 and wanted[4] == "-":
        return df.sparkSession.range(1).select(F.lit(wanted).alias("month"))
    number = int(wanted) if wanted.isdigit() else next(k + 1 for k, m in enumerate(MONTHS) if m.startswith(wanted.lower()))
    return df.select(period_key("month", F.col(date)).alias("month")).filter(F.col("month").like(f"%-{number:02d}")).agg(F.max("month").alias("month"))


def amount_condition(amount: Column, op: str, low: float, high: float | None = None) -> Column:
    """>, >=, <, <=, = (within a cent) or an inclusive range; false without an amount."""
    found = {">": amount > low, ">=": amount >= low, "<": amount < low, "<=": amount <= low, "=": F.abs(amount - low) < 0.01, "range": amount.between(low, high if high is not None else low)}[op]
    return holds(found)


def date_condition(date: Column, on: str | None = None, first: str | None = None, last: str | None = None, month: int | None = None, last_days: int | None = None, as_of: str | None = None) -> Column:
    """All given parts hold; false without a date. `last_days` counts back from `as_of`, today if not given."""
    found = F.lit(True)
    if on:
        found = found & (date == F.to_date(F.lit(on)))
    if first:
        found = found & (date >= F.to_date(F.lit(first)))
    if last:
        found = found & (date <= F.to_date(F.lit(last)))
    if month:
        found = found & (F.month(date) == month)
    if last_days is not None:
        found = found & (date >= F.date_sub(F.to_date(F.lit(as_of or datetime.date.today().isoformat())), last_days))
    return holds(found)


def list_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def list_avg(values: Column) -> Column:
    return F.when(F.size(values) > 0, list_sum(values) / F.size(values)).otherwise(0.0)


def list_max(values: Column) -> Column:
    return F.coalesce(F.array_max(values), F.lit(0.0))


def list_min(values: Column) -> Column:
    return F.coalesce(F.array_min(values), F.lit(0.0))


def list_stddev(values: Column) -> Column:
    """Of a sample; 0 for fewer than two values."""
    mean = list_avg(values)
    squares = list_sum(F.transform(values, lambda x: (x - mean) * (x - mean)))
    return F.when(F.size(values) > 1, F.sqrt(squares / (F.size(values) - 1))).otherwise(0.0)
