"""Writing classified transactions and report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrules.operators import spend


def write_classified(df: DataFrame, path: str) -> None:
    """Classified transactions by month, for pruning by month."""
    df.write.mode("overwrite").partitionBy("month").parquet(path)


def report_tables(df: DataFrame) -> dict[str, DataFrame]:
    """Cash flow, transfers, months, credits, categories and merchants, of transactions with buckets."""
    merchants, flow = spend.by_merchant(df), spend.cash_flow(df)
    return {
        "cash_flow": flow,
        "transfers": flow.select(F.explode(F.array(*[F.struct(F.lit(k).alias("item"), F.col(v).alias("amount")) for k, v in (("in", "transfer_in"), ("out", "transfer_out"), ("net", "net_transfers"))])).alias("x")).select("x.*"),
        "months": spend.chart(df),
        "credits": merchants.filter("total < 0"),
        "categories": spend.category_shares(df),
        "merchants": merchants,
    }


def write_report(df: DataFrame, folder: str, form: str = "parquet") -> None:
    for name, made in report_tables(df).items():
        flat = made.select(*[F.array_join(c, "|").alias(c) if t == "array<string>" and form == "csv" else F.col(c) for c, t in made.dtypes])
        writer = flat.write.mode("overwrite")
        writer.option("header", True).csv(f"{folder}/{name}") if form == "csv" else writer.format(form).save(f"{folder}/{name}")


def summary(df: DataFrame) -> DataFrame:
    """One row: totals of all merchants, of those that are positive, negative, or tagged as income or transfer, monthly average and number of months."""
    periods = spend.merchant_periods(df)
    tagged = lambda tag: F.abs(F.coalesce(F.sum(F.when(spend.tagged(tag), F.col("total"))), F.lit(0.0)))
    sums = spend.of_periods(periods).agg(spend.total("total").alias("total"), spend.total(F.when(F.col("total") > 0, F.col("total"))).alias("gross_spending"), F.abs(spend.total(F.when(F.col("total") < 0, F.col("total")))).alias("credits"), tagged("income").alias("income"), tagged("transfer").alias("transfers"))
    months = spend.num_months(periods)
    told = sums.join(F.broadcast(months))  # one row each
    return told.withColumns({"monthly": F.col("total") / F.col("num_months"), "net_cash_flow": F.when(F.col("income") > 0, F.col("income") - F.col("total"))})


def merchant_records(df: DataFrame, detail: int = 1) -> DataFrame:
    """A row per merchant: totals and tags; with detail 1 also averages and the first rule, with detail 2 how its months vary."""
    merchants = spend.by_merchant(df)
    plain = ["merchant", "category", "subcategory", "tags", "count", "total", "months_active", "monthly_value"]
    if detail == 0:
        return merchants.select(*plain)
    told = merchants.select(*plain, "avg_when_active", "max_payment", "first_rule")
    return told if detail == 1 else told.join(spend.variation(df), "merchant")


def report_records(df: DataFrame) -> DataFrame:
    """Transactions of the report, one a row, with the category and subcategory of their merchant; its name orders them, and spend.ORDER within it."""
    places = spend.by_merchant(df).select("merchant", F.col("category").alias("merchant_category"), F.col("subcategory").alias("merchant_subcategory"))
    return df.select("merchant", "month", *spend.ORDER, "effective_amount", "location", "tags").join(places, "merchant")


def json_parts(df: DataFrame, detail: int = 1) -> dict[str, DataFrame]:
    """What the JSON export has: summary, months, categories, credits and merchants; with detail 1 each merchant's descriptions, with detail 2 its transactions. All tables are flat."""
    merchants = merchant_records(df, detail)
    parts = {
        "summary": summary(df),
        "months": spend.by(df, "month"),
        "categories": spend.by(df, "category", "subcategory").filter("total > 0"),
        "credits": merchants.filter("total < 0").select("merchant", "category", F.abs("total").alias("amount")),
        "merchants": merchants,
    }
    if detail > 0:
        parts["descriptions"] = spend.description_counts(df)
    if detail > 1:
        parts["transactions"] = report_records(df)
    return parts


def write_json(df: DataFrame, folder: str, detail: int = 1) -> None:
    """The parts as JSON lines, a folder each."""
    for name, part in json_parts(df, detail).items():
        part.write.mode("overwrite").json(f"{folder}/{name}")


def write_discovery(df: DataFrame, path: str, form: str = "csv", limit: int = 0) -> None:
    """Unknown descriptions with suggestions, as CSV or JSON rows."""
    found = spend.discover(df, limit).select("description", "count", "total", "has_negative", "suggested_merchant", "suggested_pattern")
    found.write.mode("overwrite").option("header", True).format(form).save(path)
