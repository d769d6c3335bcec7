"""Buckets, totals and tables over classified transactions.

Input columns: description, amount, date, merchant, category, subcategory, tags. Amounts are doubles and are never rounded per row.
Lists and "first" or "last" follow an explicit order of columns, never the order of rows in a file.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrules.functions.text import suggested_merchant, suggested_pattern, suggested_rule
from txnrules.functions.values import period_key

SPECIAL = ("income", "investment", "transfer")
ORDER = ("date", "description", "amount", "source")


def tagged(tag: str) -> Column:
    return F.exists("tags", lambda t: F.lower(t) == tag)


def bucket() -> Column:
    """income, investment, transfer_in, transfer_out, spending or credit, in this order of precedence."""
    return (
        F.when(tagged("income"), "income")
        .when(tagged("investment"), "investment")
        .when(tagged("transfer"), F.when(F.col("amount") > 0, "transfer_in").otherwise("transfer_out"))
        .when(F.col("amount") > 0, "spending")
        .otherwise("credit")
    )


def effective() -> Column:
    """Income and investment count by their size."""
    return F.when(tagged("income") | tagged("investment"), F.abs("amount")).otherwise(F.col("amount"))


def with_buckets(df: DataFrame) -> DataFrame:
    return df.withColumns({"bucket": bucket(), "effective_amount": effective(), "month": period_key("month", F.col("date"))})


def total(value: Column | str = "effective_amount") -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def by(df: DataFrame, *keys: str) -> DataFrame:
    """count and total per key; df comes from with_buckets."""
    return df.groupBy(*keys).agg(F.count("*").alias("count"), total().alias("total"))


def num_months(df: DataFrame) -> DataFrame:
    """One row: distinct months, 12 if there are none."""
    return df.agg(F.countDistinct("month").alias("n")).select(F.when(F.col("n") > 0, F.col("n")).otherwise(12).alias("num_months"))


def merchant_periods(df: DataFrame) -> DataFrame:
    """merchant, month: what tables of merchants and features of views are made of. Distinct months are then rows, so nothing is expanded to count them."""
    order, p = F.struct(*ORDER), F.col("effective_amount")
    rule = F.col("matched_rule") if "matched_rule" in df.columns else F.lit(None).cast("string")
    return df.groupBy("merchant", "month").agg(
        F.count("*").alias("n"),
        total().alias("total"),
        F.sum(p * p).alias("squares"),
        F.max(p).alias("max"),
        F.min(p).alias("min"),
        F.max(F.struct(order.alias("order"), "category", "subcategory")).alias("last"),
        F.min(F.when(rule.isNotNull(), F.struct(order.alias("order"), rule.alias("rule")))).alias("first"),
        F.array_distinct(F.flatten(F.collect_set("tags"))).alias("tags"),
    )


def by_merchant(df: DataFrame) -> DataFrame:
    """Per merchant: count, total, months active, averages, largest payment, tags, category of the last transaction, rule of the first one that has a rule."""
    return of_periods(merchant_periods(df))


def of_periods(periods: DataFrame) -> DataFrame:
    """`by_merchant` from the rows of `merchant_periods`; rows without a month count for no month."""
    found = periods.groupBy("merchant").agg(
        F.sum("n").alias("count"),
        total("total").alias("total"),
        F.count("month").alias("months_active"),
        F.greatest(F.max("max"), F.lit(0.0)).alias("max_payment"),
        F.max("last").alias("_last"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
        F.min("first").alias("_first"),
    )
    named = found.withColumns({"category": F.col("_last.category"), "subcategory": F.col("_last.subcategory"), "first_rule": F.col("_first.rule")}).drop("_last", "_first")
    return named.withColumns({"avg_when_active": F.col("total") / F.nullif("months_active", F.lit(0)), "monthly_value": F.col("total") / 12})


def payment_statistics(df: DataFrame) -> DataFrame:
    """Per merchant: sum, count, avg, max, min and sample deviation (0 for one payment) of its payments."""
    p = "effective_amount"
    return df.groupBy("merchant").agg(total().alias("sum"), F.count("*").alias("count"), F.avg(p).alias("avg"), F.max(p).alias("max"), F.min(p).alias("min"), F.coalesce(F.stddev_samp(p), F.lit(0.0)).alias("stddev"))


def payments(df: DataFrame, unit: str = "month") -> DataFrame:
    """merchant, period, the columns of ORDER and the payment, one a row, with `in_order`'s columns: payments of a merchant in their order, in no list that could outgrow a row."""
    rows = df.select("merchant", period_key(unit, F.col("date")).alias("period"), *ORDER, F.col("effective_amount").alias("payment"))
    return in_order(rows, "period", "payment", F.round(F.col("payment") * 100).cast("long").cast("string"), ",")


def transactions(df: DataFrame) -> DataFrame:
    """merchant, month, the columns of ORDER and tags, one a row, with `in_order`'s columns."""
    return in_order(df.select("merchant", "month", *ORDER, "tags"), "month", "tags", F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(" "), "description"), "\n")


def in_order(rows: DataFrame, period: str, last: str, line: Column, between: str) -> DataFrame:
    """Rows with their place in their merchant's, and with n and digest of their merchant and period (see `digests`). ORDER and the column `last` order them, nulls last.

    Places are counted within a period and go on from the periods before it, so no merchant is one window; rows that nothing tells apart are equal.
    """
    order = [F.asc_nulls_last(c) for c in (*ORDER, last)]
    before = Window.partitionBy("merchant").orderBy(F.asc_nulls_last(period)).rowsBetween(Window.unboundedPreceding, -1)
    groups = digests(rows, ["merchant", period], line, order, between).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = rows.withColumn("at", F.row_number().over(Window.partitionBy("merchant", period).orderBy(*order)))
    same = at["merchant"].eqNullSafe(groups["merchant"]) & at[period].eqNullSafe(groups[period])
    return at.join(groups, same).select(*[at[c] for c in rows.columns], (F.col("at") + F.col("before")).alias("place"), "n", "digest")


def digests(rows: DataFrame, keys: list[str], line: Column, order: list[Column], between: str) -> DataFrame:
    """keys (texts), n and digest: the number of rows, and the MD5 of their lines in order, without null ones, joined by `between`. A group streams through its task and is never held."""

    def run(batches):
        group, n, digest = None, 0, None
        for batch in batches:
            done = []
            *of, lines = [c.to_pylist() for c in batch.columns]
            for key, found in groupby(zip(zip(*of, strict=True), lines, strict=True), lambda x: x[0]):
                if key != group:
                    if group is not None:
                        done.append((*group, n, digest and digest.hexdigest()))
                    group, n, digest = key, 0, None
                found = [x for _, x in found]
                n += len(found)
                if told := [x for x in found if x is not None]:
                    if digest is None:
                        digest = hashlib.md5(usedforsecurity=False)
                    else:
                        digest.update(between.encode())
                    digest.update(between.join(told).encode())
            yield rows_of(done)
        if group is not None:
            yield rows_of([(*group, n, digest and digest.hexdigest())])

    def rows_of(done):
        kinds = [pa.string()] * len(keys) + [pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate(kinds)], [*keys, "n", "digest"])

    lined = rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, line.alias("line"))
    return lined.mapInArrow(run, ", ".join(f"{k} string" for k in keys) + ", n long, digest string")


def description_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("merchant", "description").agg(F.count("*").alias("n"))


def listed_descriptions(counts: DataFrame) -> DataFrame:
    """merchant and its descriptions with their numbers, as description:n, in order: as long as the merchant has different descriptions, however many transactions."""
    each = F.collect_list(F.when(F.col("description").isNotNull(), F.struct("description", "n")))
    told = counts.groupBy("merchant").agg(F.array_sort(each).alias("each"))
    text = F.array_join(F.transform("each", lambda x: F.concat_ws(":", x["description"], x["n"].cast("string"))), "|")
    return told.select("merchant", F.when(F.size("each") > 0, text).alias("descriptions"))


def credit_groups(df: DataFrame, *keys: str) -> DataFrame:
    """Groups (merchants, or finer ones) whose total is negative."""
    return by(df, *keys).filter("total < 0")


def merchant_months(df: DataFrame) -> DataFrame:
    return df.groupBy("merchant", "month").agg(total().alias("total"))


def variation(df: DataFrame, signed: bool = False) -> DataFrame:
    """merchant, cv of its monthly totals, consistent (below 0.3). Fewer than two months or, unless signed, a mean that isn't positive: 0."""
    stats = merchant_months(df).groupBy("merchant").agg(F.count("*").alias("n"), F.avg("total").alias("mean"), F.stddev_pop("total").alias("sd"))
    none = (F.col("n") < 2) | ((F.col("mean") == 0) if signed else (F.col("mean") <= 0))
    return stats.select("merchant", F.when(none, 0.0).otherwise(F.col("sd") / F.col("mean")).alias("cv")).withColumn("consistent", F.col("cv") < 0.3)


def in_bucket(name: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("bucket") == name, F.abs("amount"))), F.lit(0.0))


def cash_flow(df: DataFrame) -> DataFrame:
    """One row of totals by bucket, net cash flow (income - spending + credits), net transfers, raw total, monthly average, count."""
    months = F.when(F.countDistinct("month") > 0, F.countDistinct("month")).otherwise(12)
    sums = df.agg(
        *[in_bucket(b).alias(b) for b in ("income", "spending", "credit", "transfer_in", "transfer_out", "investment")],
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("raw_total"),
        total().alias("merchant_total"),
        F.count("*").alias("count"),
        months.alias("num_months"),
    )
    return sums.withColumns(
        {
            "net_cash_flow": F.col("income") - F.col("spending") + F.col("credit"),
            "net_transfers": F.col("transfer_in") - F.col("transfer_out"),
            "monthly_average": (F.col("spending") + F.col("transfer_out")) / F.col("num_months"),
        }
    )


def hierarchy(df: DataFrame, months: int = 12) -> DataFrame:
    """Rollup category > subcategory > merchant: ytd, monthly, count, level (0 the whole, 3 a merchant); Unknown is relabelled."""
    unknown = F.col("category") == "Unknown"
    named = df.withColumns({"category": F.when(unknown, "Uncategorized").otherwise(F.col("category")), "subcategory": F.when(unknown, "Unknown").otherwise(F.col("subcategory"))})
    rolled = named.rollup("category", "subcategory", "merchant").agg(total().alias("ytd"), F.count("*").alias("count"), F.grouping_id().alias("g"))
    level = F.when(F.col("g") == 7, 0).when(F.col("g") == 3, 1).when(F.col("g") == 1, 2).otherwise(3)
    return rolled.select("category", "subcategory", "merchant", "ytd", (F.col("ytd") / months).alias("monthly"), "count", level.alias("level"))


def category_types(df: DataFrame) -> DataFrame:
    """Per category: spending (at least 0), income, investment and transfers by size; credits are left out."""
    transfers = F.coalesce(F.sum(F.when(F.col("bucket").startswith("transfer"), F.abs("amount"))), F.lit(0.0))
    return df.groupBy("category").agg(F.greatest(in_bucket("spending"), F.lit(0.0)).alias("spending"), in_bucket("income").alias("income"), in_bucket("investment").alias("investment"), transfers.alias("transfers"))


def signed_totals(merchants: DataFrame) -> DataFrame:
    """One row: gross spending (positive merchant totals) and credits (negative ones, by size)."""
    return merchants.agg(F.coalesce(F.sum(F.when(F.col("total") > 0, F.col("total"))), F.lit(0.0)).alias("gross_spending"), F.coalesce(F.sum(F.when(F.col("total") < 0, -F.col("total"))), F.lit(0.0)).alias("credits"))


def category_shares(df: DataFrame) -> DataFrame:
    """Positive categories with their share of all positive category totals, in percent, one decimal."""
    sums = df.groupBy("category").agg(total().alias("total")).filter("total > 0")
    whole = sums.agg(F.sum("total").alias("whole"))
    return sums.join(F.broadcast(whole)).select("category", "total", F.bround(100 * F.col("total") / F.col("whole"), 1).alias("share"))


def merchant_shares(merchants: DataFrame) -> DataFrame:
    """Each merchant's share of its category's total, percent; 0 where that is 0. Category totals come from their own aggregate, so a large category is no single window."""
    sums = merchants.groupBy("category").agg(F.sum("total").alias("of"))
    return merchants.join(sums, "category").select("merchant", "category", "total", F.when(F.col("of") == 0, 0.0).otherwise(F.bround(100 * F.col("total") / F.col("of"), 1)).alias("share"))


def type_shares(df: DataFrame) -> DataFrame:
    """Per category: its spending, income and investment as percent of all spending, income and investment, one decimal; 0 where there is none."""
    kinds = ("spending", "income", "investment")
    each = category_types(df)
    whole = each.agg(*[F.sum(k).alias(f"all_{k}") for k in kinds])  # one row
    share = lambda k: F.when(F.col(f"all_{k}") == 0, 0.0).otherwise(F.bround(100 * F.col(k) / F.col(f"all_{k}"), 1)).alias(k)
    return each.join(F.broadcast(whole)).select("category", *[share(k) for k in kinds])


def category_averages(df: DataFrame) -> DataFrame:
    """Per category: total over all months of the data."""
    months = num_months(df)  # one row
    return by(df, "category").join(F.broadcast(months)).select("category", (F.col("total") / F.col("num_months")).alias("per_month"))


def discover(df: DataFrame, limit: int = 0) -> DataFrame:
    """Unknown descriptions: count, total size, whether any is negative, the three first examples, suggested name, pattern, tags and rule; largest first, all if limit is 0."""
    unknown = df.filter(F.col("category") == "Unknown")
    found = unknown.groupBy("description").agg(
        F.count("*").alias("count"),
        F.sum(F.abs("amount")).alias("total"),
        F.max((F.col("amount") < 0).cast("int")).cast("boolean").alias("has_negative"),
    )
    # Spark keeps three rows of a description and task before the window.
    first = unknown.withColumn("rank", F.row_number().over(Window.partitionBy("description").orderBy("date", "amount", "source"))).filter(F.col("rank") <= 3)
    examples = first.groupBy("description").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "date", "amount"))), lambda x: F.struct(x["date"].alias("date"), x["amount"].alias("amount"))).alias("examples"))
    return suggested(found.join(examples, "description"), limit)


def suggested(unknown: DataFrame, limit: int = 0) -> DataFrame:
    """Unknown descriptions with suggested name, pattern, tags and rule; largest first."""
    tags = F.when(F.col("has_negative"), F.array(F.lit("refund"))).otherwise(F.array().cast("array<string>"))
    told = (
        unknown.withColumns({"suggested_merchant": suggested_merchant("description"), "suggested_pattern": suggested_pattern("description"), "suggested_tags": tags})
        .withColumn("suggested_rule", suggested_rule("description", F.col("suggested_tags")))
        .orderBy(F.desc("total"), "description")
    )
    return told.limit(limit) if limit else told


def tag_usage(merchants: DataFrame) -> DataFrame:
    """Merchants per tag, most used first."""
    return merchants.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def chart(df: DataFrame) -> DataFrame:
    """Spending, income and investment by month."""
    return df.groupBy("month").agg(in_bucket("spending").alias("spending"), in_bucket("income").alias("income"), in_bucket("investment").alias("investment"))


def category_by_month(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Spending by month, a column per category."""
    spent = df.filter(F.col("bucket") == "spending")
    return spent.groupBy("month").pivot("category", categories).agg(F.sum("amount")) if categories else spent.groupBy("month").pivot("category").agg(F.sum("amount"))


def top(df: DataFrame, n: int, *keys: str | Column) -> DataFrame:
    """First n rows by keys; name a last key that makes the order total."""
    return df.orderBy(*keys).limit(n)


def top_in_each(df: DataFrame, group: str, n: int, *keys: Column) -> DataFrame:
    """The first n rows of each group, with their rank and the number that remain. Spark keeps n rows per group and task before the window."""
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*keys))).filter(F.col("rank") <= n)
    sizes = df.groupBy(group).agg(F.count("*").alias("size"))
    return ranked.join(sizes, group).withColumn("remaining", F.greatest(F.col("size") - n, F.lit(0))).drop("size")


def listing(merchants: DataFrame, each: int, rows: int) -> DataFrame:
    """The largest `each` merchants of every category, categories by the total of their merchants, the first `rows` rows; only merchants with a positive total."""
    positive = merchants.filter("total > 0")
    of = positive.groupBy("category").agg(F.sum("total").alias("of_category"))
    return top_in_each(positive, "category", each, F.desc("total"), F.asc("merchant")).join(of, "category").orderBy(F.desc("of_category"), "category", "rank").limit(rows)


def sort_by(df: DataFrame, column: str, descending: bool = True, absolute: bool = False, tie: str = "merchant") -> DataFrame:
    """Ordered by a text column ignoring case or by a number, by size if `absolute`."""
    kind = dict(df.dtypes)[column]
    key = F.lower(column) if kind == "string" else F.abs(column) if absolute else F.col(column)
    return df.orderBy(key.desc() if descending else key.asc(), tie)
