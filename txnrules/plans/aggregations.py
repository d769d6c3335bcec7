"""Queries for totals (A*), views (V*), rankings (W*), set operations (U*) and report tables (K*)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from txnrules.functions import values as V
from txnrules.operators import facets, spend, state, views
from txnrules.plans import tables
from txnrules.plans.registry import register
from txnrules.plans.tables import SPENDING_SQL, TXN_SQL
from txnrules.sources import sinks, store

c = F.col
r2 = lambda x: F.round(x, 2)
ORDER_SQL = "(date, description, amount, source)"
MERCHANTS_SQL = f"""{SPENDING_SQL}, mer AS (
    SELECT merchant, count(*) AS count, coalesce(sum(eff), 0) AS total, count(DISTINCT month) AS months_active, greatest(max(eff), 0) AS max_payment,
           arg_max(category, {ORDER_SQL}) AS category, arg_max(subcategory, {ORDER_SQL}) AS subcategory,
           list_sort(list_distinct(flatten(list(tags)))) AS tags FROM sp GROUP BY merchant)"""
MONTHS_SQL = f"{MERCHANTS_SQL}, mm AS (SELECT merchant, month, sum(eff) AS total FROM sp GROUP BY ALL)"
CV_SQL = f"""{MONTHS_SQL}, cvs AS (SELECT merchant, CASE WHEN count(*) < 2 OR avg(total) = 0 THEN 0 ELSE stddev_pop(total) / avg(total) END AS signed_cv,
    CASE WHEN count(*) < 2 OR avg(total) <= 0 THEN 0 ELSE stddev_pop(total) / avg(total) END AS cv FROM mm GROUP BY merchant)"""


def spent(name: str, sql: str, build, base: str = SPENDING_SQL) -> None:
    register(name, f"WITH {base} {sql}")(lambda spark, sf_dir: build(tables.spending(spark, sf_dir)))


def merchants(name: str, sql: str, build, base: str = MERCHANTS_SQL) -> None:
    register(name, f"WITH {base} {sql}")(lambda spark, sf_dir: build(spend.by_merchant(tables.spending(spark, sf_dir))))


spent("a01_buckets", "SELECT bucket, count(*) AS n, round(sum(amount), 2) AS total FROM sp GROUP BY bucket", lambda d: d.groupBy("bucket").agg(F.count("*").alias("n"), r2(F.sum("amount")).alias("total")))
spent("a02_effective_amount", "SELECT category, round(sum(eff), 2) AS total, round(sum(amount), 2) AS raw FROM sp GROUP BY category", lambda d: d.groupBy("category").agg(r2(F.sum("effective_amount")).alias("total"), r2(F.sum("amount")).alias("raw")))
spent("a03_by_category", "SELECT category, subcategory, count(*) AS count, round(sum(eff), 2) AS total FROM sp GROUP BY ALL", lambda d: spend.by(d, "category", "subcategory").withColumn("total", r2("total")))


def from_state(name: str, table: str, sql: str, build, base: str) -> None:
    """A query on a table of the kept state."""
    register(name, f"WITH {base} {sql}")(lambda spark, sf_dir: build(tables.kept(spark, sf_dir, table)))


def by_merchant(spark, sf_dir):
    """Merchants with their descriptions, from two tables of the kept state."""
    found = spend.of_periods(state.merchant_periods(tables.kept(spark, sf_dir, "totals")))
    listed = spend.listed_descriptions(state.description_counts(tables.kept(spark, sf_dir, "descriptions")))
    return found.join(listed, "merchant").select(
        "merchant", "count", r2("total").alias("total"), "months_active", r2("max_payment").alias("max_payment"), "category", "subcategory", F.array_join("tags", "|").alias("tags"), "first_rule", "descriptions"
    )


register(
    "a04_by_merchant",
    f"""WITH {MERCHANTS_SQL} SELECT merchant, count, round(total, 2) AS total, months_active, round(max_payment, 2) AS max_payment, category, subcategory, array_to_string(tags, '|') AS tags, first_rule, descriptions
    FROM mer JOIN (SELECT merchant, arg_min(matched_rule, {ORDER_SQL}) FILTER (matched_rule IS NOT NULL) AS first_rule FROM sp GROUP BY merchant) USING (merchant)
    JOIN (SELECT merchant, string_agg(description || ':' || n, '|' ORDER BY description) AS descriptions FROM (SELECT merchant, description, count(*) AS n FROM sp GROUP BY ALL) GROUP BY merchant) USING (merchant)""",
)(by_merchant)
spent(
    "a04_from_transactions",
    "SELECT merchant, count, round(total, 2) AS total, months_active, array_to_string(tags, '|') AS tags FROM mer",
    lambda d: spend.by_merchant(d).select("merchant", "count", r2("total").alias("total"), "months_active", F.array_join("tags", "|").alias("tags")),
    MERCHANTS_SQL,
)
from_state("a05_descriptions", "descriptions", "SELECT merchant, description, count(*) AS n FROM sp GROUP BY ALL", state.description_counts, SPENDING_SQL)
spent("a06_merchant_months", "SELECT merchant, month, round(total, 2) AS total FROM mm", lambda d: spend.merchant_months(d).withColumn("total", r2("total")), MONTHS_SQL)
spent("a07_by_month", "SELECT month, count(*) AS count, round(sum(eff), 2) AS total FROM sp GROUP BY month", lambda d: spend.by(d, "month").withColumn("total", r2("total")))
spent("a08_num_months", "SELECT count(DISTINCT month) AS num_months FROM sp", spend.num_months)
merchants("a09_when_active", "SELECT merchant, months_active, round(total / months_active, 2) AS avg_when_active FROM mer", lambda m: m.select("merchant", "months_active", r2("avg_when_active").alias("avg_when_active")))
spent("a10_variation", "SELECT merchant, round(cv, 4) AS cv, cv < 0.3 AS consistent FROM cvs", lambda d: spend.variation(d).withColumn("cv", F.round("cv", 4)), CV_SQL)
# A twelfth of a sum of cents is often half a cent: sums are brought to cents first, or the noise of summing doubles, in whatever order, would decide.
TWELFTH_SQL, twelfth = "round(round({}, 2) / 12, 2)", lambda total: r2(r2(total) / 12)
merchants("a11_monthly_value", f"SELECT merchant, {TWELFTH_SQL.format('total')} AS monthly_value FROM mer", lambda m: m.select("merchant", twelfth("total").alias("monthly_value")))
_FLOW = """flow AS (SELECT coalesce(sum(abs(amount)) FILTER (bucket = 'income'), 0) AS income, coalesce(sum(amount) FILTER (bucket = 'spending'), 0) AS spending, coalesce(sum(-amount) FILTER (bucket = 'credit'), 0) AS credit,
    coalesce(sum(amount) FILTER (bucket = 'transfer_in'), 0) AS transfer_in, coalesce(sum(-amount) FILTER (bucket = 'transfer_out'), 0) AS transfer_out, coalesce(sum(abs(amount)) FILTER (bucket = 'investment'), 0) AS investment,
    sum(amount) AS raw_total, sum(eff) AS merchant_total, count(*) AS count, count(DISTINCT month) AS num_months FROM sp)"""
FLOW_SQL = f"{SPENDING_SQL}, {_FLOW}"
_MONEY = ("income", "spending", "credit", "transfer_in", "transfer_out", "investment", "raw_total", "merchant_total", "net_cash_flow", "net_transfers", "monthly_average")


def _flow(d):
    f = spend.cash_flow(d)
    return f.withColumns({n: r2(n) for n in _MONEY})


_FLOW_COLUMNS = """round(income, 2) AS income, round(spending, 2) AS spending, round(credit, 2) AS credit, round(transfer_in, 2) AS transfer_in, round(transfer_out, 2) AS transfer_out, round(investment, 2) AS investment,
    round(raw_total, 2) AS raw_total, round(merchant_total, 2) AS merchant_total, count, num_months, round(income - spending + credit, 2) AS net_cash_flow, round(transfer_in - transfer_out, 2) AS net_transfers, round((spending + transfer_out) / num_months, 2) AS monthly_average"""
spent("a12_cash_flow", f"SELECT {_FLOW_COLUMNS} FROM flow", _flow, FLOW_SQL)
merchants("a13_gross", "SELECT round(sum(total) FILTER (total > 0), 2) AS gross_spending, round(coalesce(-sum(total) FILTER (total < 0), 0), 2) AS credits FROM mer", lambda m: spend.signed_totals(m).select(r2("gross_spending").alias("gross_spending"), r2("credits").alias("credits")))
spent(
    "a14_summary",
    "SELECT count, num_months, round(spending, 2) AS spending, CASE WHEN income > 0 THEN round(income - spending + credit, 2) END AS net_cash_flow FROM flow",
    lambda d: spend.cash_flow(d).select("count", "num_months", r2("spending").alias("spending"), F.when(c("income") > 0, r2("net_cash_flow")).alias("net_cash_flow")),
    FLOW_SQL,
)
spent("a15_category_shares", "SELECT category, round(total, 2) AS total, round(100 * total / sum(total) OVER (), 1) AS share FROM (SELECT category, sum(eff) AS total FROM sp GROUP BY category) WHERE total > 0", lambda d: spend.category_shares(d).withColumn("total", r2("total")))
spent(
    "a16_credit_merchants",
    "SELECT merchant, location, month, round(sum(eff), 2) AS total FROM sp GROUP BY merchant, location, month HAVING sum(eff) < 0",
    lambda d: spend.credit_groups(d, "merchant", "location", "month").select("merchant", "location", "month", r2("total").alias("total")),
)
spent(
    "a17_hierarchy",
    f"""SELECT category, subcategory, merchant, round(sum(eff), 2) AS ytd, {TWELFTH_SQL.format('sum(eff)')} AS monthly, count(*) AS count, CASE grouping_id(category, subcategory, merchant) WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS level
    FROM (SELECT CASE WHEN category = 'Unknown' THEN 'Uncategorized' ELSE category END AS category, subcategory, merchant, eff FROM sp) GROUP BY ROLLUP (category, subcategory, merchant)""",
    lambda d: spend.hierarchy(d).withColumns({"monthly": twelfth("ytd"), "ytd": r2("ytd")}),
)
spent(
    "a18_category_types",
    """SELECT category, round(coalesce(sum(amount) FILTER (bucket = 'spending'), 0), 2) AS spending, round(coalesce(sum(abs(amount)) FILTER (bucket = 'income'), 0), 2) AS income,
    round(coalesce(sum(abs(amount)) FILTER (bucket = 'investment'), 0), 2) AS investment, round(coalesce(sum(abs(amount)) FILTER (starts_with(bucket, 'transfer')), 0), 2) AS transfers FROM sp GROUP BY category""",
    lambda d: spend.category_types(d).select("category", *[r2(n).alias(n) for n in ("spending", "income", "investment", "transfers")]),
)
merchants("a19_monthly_figure", "SELECT merchant, round(CASE WHEN total / months_active <> 0 THEN total / months_active ELSE total / 12 END, 2) AS monthly FROM mer", lambda m: m.select("merchant", r2(F.coalesce(F.nullif("avg_when_active", F.lit(0.0)), c("total") / 12)).alias("monthly")))
_DISCOVERED = f"""{SPENDING_SQL}, un AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY date, amount, source) AS r FROM sp WHERE category = 'Unknown'),
    di AS (SELECT description, count(*) AS count, round(sum(abs(amount)), 2) AS total, bool_or(amount < 0) AS has_negative, string_agg(strftime(date, '%Y-%m-%d') || ' ' || round(amount, 2), '|' ORDER BY r) FILTER (r <= 3) AS examples,
        array_to_string(list_transform(regexp_extract_all(description, '[A-Z#0-9]+')[1:3], lambda w: CASE WHEN starts_with(w, 'BRAND#') THEN 'Brand#' || w[7:] ELSE upper(w[1]) || lower(w[2:]) END), ' ') AS suggested_merchant FROM un GROUP BY description)"""
from_state(
    "a22_discover",
    "descriptions",
    "SELECT description, count, total, has_negative, examples, suggested_merchant, CASE WHEN has_negative THEN 'refund' ELSE '' END AS suggested_tags FROM di",
    lambda t: state.discover(t).select(
        "description",
        "count",
        r2("total").alias("total"),
        "has_negative",
        F.array_join(F.transform("examples", lambda e: F.concat_ws(" ", F.date_format(e["date"], "yyyy-MM-dd"), r2(e["amount"]).cast("string"))), "|").alias("examples"),
        "suggested_merchant",
        F.array_join("suggested_tags", "|").alias("suggested_tags"),
    ),
    _DISCOVERED,
)
merchants("a23_overview", "SELECT category, count(*) AS merchants, round(sum(total), 2) AS total FROM mer GROUP BY category", lambda m: m.groupBy("category").agg(F.count("*").alias("merchants"), r2(F.sum("total")).alias("total")))
spent("a24_chart", "SELECT month, round(coalesce(sum(amount) FILTER (bucket = 'spending'), 0), 2) AS spending, round(coalesce(sum(abs(amount)) FILTER (bucket = 'income'), 0), 2) AS income, round(coalesce(sum(abs(amount)) FILTER (bucket = 'investment'), 0), 2) AS investment FROM sp GROUP BY month", lambda d: spend.chart(d).select("month", *[r2(n).alias(n) for n in ("spending", "income", "investment")]))
spent(
    "a24_category_by_month",
    "SELECT month, round(sum(amount) FILTER (category = 'Hardware'), 2) AS \"Hardware\", round(sum(amount) FILTER (category = 'Fasteners'), 2) AS \"Fasteners\" FROM sp WHERE bucket = 'spending' GROUP BY month",
    lambda d: spend.category_by_month(d, ["Hardware", "Fasteners"]).select("month", r2("Hardware").alias("Hardware"), r2("Fasteners").alias("Fasteners")),
)
_FACETS = [facets.Facet("category", "hardware"), facets.Facet("category", "Fasteners"), facets.Facet("month", "1996-01..1997-06"), facets.Facet("tag", "income", True)]
_FACET_SQL = "lower(category) IN ('hardware', 'fasteners') AND month BETWEEN '1996-01' AND '1997-06' AND NOT list_contains(tags, 'income')"
spent(
    "a25_filtered_totals",
    f"SELECT count(*) AS n, round(coalesce(sum(amount) FILTER (bucket = 'spending'), 0), 2) AS spending, round(coalesce(-sum(amount) FILTER (bucket = 'credit'), 0), 2) AS credit, round(coalesce(sum(amount) FILTER (bucket = 'spending'), 0) + coalesce(sum(amount) FILTER (bucket = 'credit'), 0), 2) AS net FROM sp WHERE {_FACET_SQL}",
    lambda d: spend.cash_flow(d.filter(facets.facet_filter(_FACETS))).select(c("count").alias("n"), r2("spending").alias("spending"), r2("credit").alias("credit"), r2(c("spending") - c("credit")).alias("net")),
)
spent(
    "a26_grand_total",
    f"SELECT round(sum(amount), 2) AS total, round(-sum(amount) FILTER (amount < 0), 2) AS credits, round(sum(amount) FILTER (amount > 0), 2) AS gross FROM sp WHERE {_FACET_SQL}",
    lambda d: d.filter(facets.facet_filter(_FACETS)).agg(r2(F.sum("amount")).alias("total"), r2(-F.sum(F.when(c("amount") < 0, c("amount")))).alias("credits"), r2(F.sum(F.when(c("amount") > 0, c("amount")))).alias("gross")),
)
spent(
    "a28_filtered_merchants",
    f"SELECT category, subcategory, merchant, count(*) AS n, round(sum(eff), 2) AS total, count(DISTINCT month) AS active FROM sp WHERE {_FACET_SQL} GROUP BY ALL",
    lambda d: d.filter(facets.facet_filter(_FACETS)).groupBy("category", "subcategory", "merchant").agg(F.count("*").alias("n"), r2(F.sum("effective_amount")).alias("total"), F.countDistinct("month").alias("active")),
)
spent(
    "a29_subcategories",
    "SELECT category, subcategory, count(DISTINCT merchant) AS merchants, count(*) AS n, round(sum(eff), 2) AS total, array_to_string(list_sort(list_distinct(flatten(list(tags)))), '|') AS tags FROM sp GROUP BY ALL",
    lambda d: d.groupBy("category", "subcategory").agg(F.countDistinct("merchant").alias("merchants"), F.count("*").alias("n"), r2(F.sum("effective_amount")).alias("total"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))), "|").alias("tags")),
)
spent("a30_income_transfers", "SELECT sum(list_contains(tags, 'income')::INT) AS income, sum(list_contains(tags, 'transfer')::INT) AS transfers FROM sp", lambda d: d.agg(F.sum(spend.tagged("income").cast("int")).alias("income"), F.sum(spend.tagged("transfer").cast("int")).alias("transfers")))
# Rows with their place in their merchant's order, and number and digest of the rows of their merchant and month.
_PLACED = """row_number() OVER (PARTITION BY sp.merchant ORDER BY sp.date, sp.description, sp.amount, sp.source, sp.{0}) AS place, n, digest
    FROM sp JOIN g ON sp.merchant IS NOT DISTINCT FROM g.merchant AND sp.month IS NOT DISTINCT FROM g.month"""
spent(
    "a31_transactions_by_merchant",
    f"SELECT sp.merchant, sp.month, sp.date, sp.description, round(sp.amount, 2) AS amount, sp.source, array_to_string(sp.tags, '|') AS tags, {_PLACED.format('tags')}",
    lambda d: spend.transactions(d).select("merchant", "month", "date", "description", r2("amount").alias("amount"), "source", F.array_join("tags", "|").alias("tags"), "place", "n", "digest"),
    f"{SPENDING_SQL}, g AS (SELECT merchant, month, count(*) AS n, md5(string_agg(strftime(date, '%Y-%m-%d') || ' ' || description, chr(10) ORDER BY {ORDER_SQL[1:-1]})) AS digest FROM sp GROUP BY ALL)",
)
spent("a32_latest_date", "SELECT max(date) AS latest FROM sp", lambda d: d.agg(F.max("date").alias("latest")))
spent("a33_averages", "SELECT round((spending + transfer_out) / num_months, 2) AS per_month, round(spending / num_months, 2) AS spending FROM flow", lambda d: spend.cash_flow(d).select(r2("monthly_average").alias("per_month"), r2(c("spending") / c("num_months")).alias("spending")), FLOW_SQL)
spent("a33_category_averages", "SELECT category, round(sum(eff) / (SELECT count(DISTINCT month) FROM sp), 2) AS per_month FROM sp GROUP BY category", lambda d: spend.category_averages(d).select("category", r2("per_month").alias("per_month")))
merchants("a34_merchant_shares", "SELECT merchant, category, CASE WHEN sum(total) OVER (PARTITION BY category) = 0 THEN 0 ELSE round(100 * total / sum(total) OVER (PARTITION BY category), 1) END AS share FROM mer", lambda m: spend.merchant_shares(m).select("merchant", "category", "share"))
_OF = "CASE WHEN sum({0}) OVER () = 0 THEN 0 ELSE round(100 * {0} / sum({0}) OVER (), 1) END AS {0}"
spent(
    "a34_type_shares",
    f"""SELECT category, {_OF.format("spending")}, {_OF.format("income")}, {_OF.format("investment")} FROM (SELECT category, coalesce(sum(amount) FILTER (bucket = 'spending'), 0) AS spending,
    coalesce(sum(abs(amount)) FILTER (bucket = 'income'), 0) AS income, coalesce(sum(abs(amount)) FILTER (bucket = 'investment'), 0) AS investment FROM sp GROUP BY category)""",
    spend.type_shares,
)
merchants("a35_tag_usage", "SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM mer) GROUP BY tag", spend.tag_usage)

# Views
FEATURES_SQL = f"""{CV_SQL}, per AS (SELECT merchant, month AS period, sum(eff) AS s, count(*) AS n FROM sp GROUP BY ALL),
ov AS (SELECT merchant, count(*) AS n_periods, max(s) AS max_sum, min(s) AS min_sum, avg(s) AS avg_sum, max(n) AS max_count FROM per GROUP BY merchant),
ft AS (SELECT mer.merchant, mer.count AS n_payments, months_active AS months, mer.total, category, subcategory, tags, signed_cv AS cv, n_periods, max_sum, min_sum, avg_sum, max_count,
       (SELECT max(eff) FROM sp WHERE sp.merchant = mer.merchant) AS max FROM mer JOIN ov USING (merchant) JOIN cvs USING (merchant))"""


def featured(name: str, sql: str, build) -> None:
    register(name, f"WITH {FEATURES_SQL} {sql}")(lambda spark, sf_dir: build(views.features_of(state.merchant_periods(tables.kept(spark, sf_dir, "totals")))))


featured("v02_months", "SELECT merchant, months FROM ft", lambda f: f.select("merchant", "months"))
featured("v03_total", "SELECT merchant, round(total, 2) AS total FROM ft", lambda f: f.select("merchant", r2("total").alias("total")))
featured("v04_cv", "SELECT merchant, round(cv, 4) AS cv FROM ft", lambda f: f.select("merchant", F.round("cv", 4).alias("cv")))
featured("v05_tags", "SELECT merchant, array_to_string(tags, '|') AS tags FROM ft", lambda f: f.select("merchant", F.array_join("tags", "|").alias("tags")))
featured("v06_fields", "SELECT merchant, category, subcategory FROM ft", lambda f: f.select("merchant", "category", "subcategory"))
featured("v15_composition", "SELECT merchant, n_periods, round(max_sum, 2) AS max_sum, round(min_sum, 2) AS min_sum, round(avg_sum, 2) AS avg_sum, max_count FROM ft", lambda f: f.select("merchant", "n_periods", *[r2(n).alias(n) for n in ("max_sum", "min_sum", "avg_sum")], "max_count"))
spent(
    "v07_payment_statistics",
    "SELECT merchant, round(coalesce(sum(eff), 0), 2) AS s, count(*) AS n, round(avg(eff), 2) AS a, round(max(eff), 2) AS mx, round(min(eff), 2) AS mn, round(coalesce(stddev_samp(eff), 0), 2) AS sd FROM sp GROUP BY merchant",
    lambda d: spend.payment_statistics(d).select("merchant", r2("sum").alias("s"), c("count").alias("n"), r2("avg").alias("a"), r2("max").alias("mx"), r2("min").alias("mn"), r2("stddev").alias("sd")),
)
for _id, _sql, _name in (
    ("v08_count", "count(*)", "count"),
    ("v09_avg", "round(avg(eff), 2)", "avg"),
    ("v10_max", "round(max(eff), 2)", "max"),
    ("v11_min", "round(min(eff), 2)", "min"),
    ("v12_stddev", "round(coalesce(stddev_samp(eff), 0), 2)", "stddev"),
):
    spent(_id, f"SELECT merchant, {_sql} AS value FROM sp GROUP BY merchant", lambda d, n=_name: spend.payment_statistics(d).select("merchant", (c(n) if n == "count" else r2(n)).alias("value")))
spent(
    "v01_payments",
    f"SELECT sp.merchant, sp.month AS period, sp.date, sp.description, round(sp.amount, 2) AS amount, sp.source, round(sp.eff, 2) AS payment, {_PLACED.format('eff')}",
    lambda d: spend.payments(d).select("merchant", "period", "date", "description", r2("amount").alias("amount"), "source", r2("payment").alias("payment"), "place", "n", "digest"),
    f"{SPENDING_SQL}, g AS (SELECT merchant, month, count(*) AS n, md5(array_to_string(list((round(eff * 100)::BIGINT)::VARCHAR ORDER BY {ORDER_SQL[1:-1]}, eff), ',')) AS digest FROM sp GROUP BY ALL)",
)
for _unit, _form in (("month", "%Y-%m"), ("year", "%Y"), ("week", "%Y-W%W"), ("day", "%Y-%m-%d")):
    spent(
        f"v13_by_{_unit}",
        f"SELECT merchant, strftime(date, '{_form}') AS period, round(sum(eff), 2) AS sum, count(*) AS count, round(coalesce(stddev_samp(eff), 0), 2) AS stddev FROM sp GROUP BY ALL",
        lambda d, u=_unit: views.by_period(d, u).select("merchant", "period", r2("sum").alias("sum"), "count", r2("stddev").alias("stddev")),
    )
spent(
    "v14_nested_lists",
    "SELECT merchant, round(sum(a), 2) AS sum_of_averages, round(max(m), 2) AS max_of_minima FROM (SELECT merchant, month, avg(eff) AS a, min(eff) AS m FROM sp GROUP BY ALL) GROUP BY merchant",
    lambda d: views.by_period(d, "month").groupBy("merchant").agg(r2(F.sum("avg")).alias("sum_of_averages"), r2(F.max("min")).alias("max_of_minima")),
)
register("v16_periods", f"WITH {TXN_SQL} SELECT count(DISTINCT strftime(date, '%Y-%m')) AS n_months, count(DISTINCT year(date)) AS n_years, count(DISTINCT strftime(date, '%Y-W%W')) AS n_weeks, count(DISTINCT date) AS n_days FROM txn")(lambda spark, sf_dir: views.periods(tables.txn(spark, sf_dir)))
_OWN = [views.View("big", "total > floor_total"), views.View("bills", "months >= 12 AND mean > 1000", {"mean": "total / months"}), views.View("none", "total < 0 AND n_payments < 0"), views.View("broken", "try_cast(category AS INT) > 0")]
_OWN_SQL = "SELECT 'big' AS view, merchant FROM ft WHERE total > 1000000 UNION ALL SELECT 'bills', merchant FROM ft WHERE months >= 12 AND total / months > 1000"
featured("v17_variables", _OWN_SQL, lambda f: views.classify_views(f, _OWN, {"floor_total": "1000000.0"}).select("view", "merchant"))
featured("v18_filter", "SELECT merchant FROM ft WHERE months >= 12 AND total / months > 1000", lambda f: views.classify_views(f, _OWN[1:2]).select("merchant"))
register("v20_ordinary", f"WITH {SPENDING_SQL} SELECT merchant FROM sp WHERE segment <> 'MACHINERY' GROUP BY merchant HAVING NOT list_has_any(flatten(list(tags)), ['income', 'investment', 'transfer'])")(
    # without the segment that makes income, some merchants have no special tag
    lambda spark, sf_dir: views.ordinary(views.features(tables.spending(spark, sf_dir).filter("field['segment'] <> 'MACHINERY'"))).select("merchant")
)
# The default views look at these categories and subcategories.
_NAMES = {"category": {"Hardware": "Bills", "Fasteners": "Subscriptions", "Devices": "Travel", "Colours": "Shopping", "Heavy": "Health"}, "subcategory": {"Widgets": "Grocery", "Cold": "Restaurant", "Other": "Fast Food", "Small": "Delivery"}}
_MORE_VIEWS = {"large": "max >= 1000", "refunds": "total < 0", "steady": "months >= 12 AND cv < 0.3"}
RENAMED_SQL = f"{SPENDING_SQL.replace(', sp AS (', ', sp0 AS (')}, sp AS (SELECT * REPLACE (" + ", ".join(f"CASE {k} " + " ".join(f"WHEN '{x}' THEN '{y}'" for x, y in v.items()) + f" ELSE {k} END AS {k}" for k, v in _NAMES.items()) + ") FROM sp0)"
PLACED_SQL = (
    FEATURES_SQL.replace(SPENDING_SQL, RENAMED_SQL)
    + ", nm AS (SELECT count(DISTINCT month) AS n FROM sp), pl AS ("
    + " UNION ALL ".join(f"SELECT '{v}' AS view, ft.*, nm.n FROM ft, nm WHERE {w}" for v, w in {**views.DEFAULT_VIEWS, **_MORE_VIEWS}.items())
    + ")"
)


def renamed(d):
    for column, names in _NAMES.items():
        d = d.withColumn(column, F.coalesce(F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[c(column)], c(column)))
    return d


def placed(spark, sf_dir):
    """Merchants in the default views and three more, with the number of months in the data."""
    periods = state.merchant_periods(tables.kept(spark, sf_dir, "totals"))
    found = views.classify_views(renamed(views.features_of(periods)), views.default_views() + [views.View(n, w) for n, w in _MORE_VIEWS.items()])
    return found.join(F.broadcast(views.months_of(periods)))  # one row


def viewed(name: str, sql: str, build) -> None:
    register(name, f"WITH {PLACED_SQL} {sql}")(lambda spark, sf_dir: build(placed(spark, sf_dir)))


viewed("v19_views", "SELECT view, merchant FROM pl", lambda p: p.select("view", "merchant"))
viewed("v21_default_views", "SELECT view, count(*) AS merchants, round(sum(total), 2) AS total FROM pl GROUP BY view", lambda p: p.groupBy("view").agg(F.count("*").alias("merchants"), r2(F.sum("total")).alias("total")))
viewed("v22_views_of_merchant", "SELECT view, months, round(cv, 4) AS cv, round(total, 2) AS total FROM pl WHERE merchant = 'Widget Co'", lambda p: p.filter("merchant = 'Widget Co'").select("view", "months", F.round("cv", 4).alias("cv"), r2("total").alias("total")))
featured("v23_expressions", "SELECT merchant, CASE WHEN total / n_payments > 20000 AND category <> 'Heavy' THEN 'dear' ELSE 'cheap' END AS kind FROM ft", lambda f: f.select("merchant", F.when((V.quotient(c("total"), c("n_payments")) > 20000) & ~c("category").isin("Heavy"), "dear").otherwise("cheap").alias("kind")))


viewed(
    "a20_view_totals",
    "SELECT view, count(*) AS merchants, round(sum(total), 2) AS total, round(sum(CASE WHEN cv < 0.3 THEN total / months ELSE total / n END), 2) AS monthly, round(sum(total) / any_value(n), 2) AS per_month FROM pl GROUP BY view",
    lambda p: views.view_totals(p).select("view", "merchants", *[r2(n).alias(n) for n in ("total", "monthly", "per_month")]),
)
viewed("a21_view_monthly", "SELECT view, merchant, round(CASE WHEN cv < 0.3 THEN total / months ELSE total / n END, 2) AS monthly FROM pl", lambda p: p.select("view", "merchant", r2(views.monthly_figure()).alias("monthly")))


@register("a27_filtered_views", f"WITH {PLACED_SQL} SELECT view, count(*) AS n, round(sum(eff), 2) AS total FROM sp JOIN (SELECT view, merchant FROM pl) USING (merchant) WHERE month BETWEEN '1996-01' AND '1996-06' GROUP BY view")
def a27(spark, sf_dir):
    d = tables.spending(spark, sf_dir).filter(facets.facet_filter([facets.Facet("month", "1996-01..1996-06")]))
    return d.join(placed(spark, sf_dir).select("view", "merchant"), "merchant").groupBy("view").agg(F.count("*").alias("n"), r2(F.sum("effective_amount")).alias("total"))


# Rankings
def ranked(name: str, sql: str, build) -> None:
    merchants(name, sql, build)


ranked("w01_top_merchants", "SELECT merchant, round(total, 2) AS total FROM mer WHERE total > 0 ORDER BY total DESC, merchant LIMIT 25", lambda m: spend.top(m.filter("total > 0"), 25, F.desc("total"), "merchant").select("merchant", r2("total").alias("total")))
_EACH = "SELECT category, merchant, row_number() OVER (PARTITION BY category ORDER BY total DESC, merchant) AS rank, greatest(count(*) OVER (PARTITION BY category) - {n}, 0) AS remaining FROM mer"
ranked(
    "w02_top_in_categories",
    """, pos AS (SELECT *, sum(total) OVER (PARTITION BY category) AS of_category, row_number() OVER (PARTITION BY category ORDER BY total DESC, merchant) AS rank FROM mer WHERE total > 0)
    SELECT category, merchant, rank FROM pos WHERE rank <= 5 ORDER BY of_category DESC, category, rank LIMIT 20""",
    lambda m: spend.listing(m, 5, 20).select("category", "merchant", c("rank").cast("long").alias("rank")),
)
spent("w03_top_categories", "SELECT category, round(sum(eff), 2) AS total FROM sp GROUP BY category ORDER BY sum(eff) DESC, category LIMIT 15", lambda d: spend.top(spend.by(d, "category"), 15, F.desc("total"), "category").select("category", r2("total").alias("total")))


viewed(
    "w04_view_merchants",
    ", k AS (SELECT view, merchant, row_number() OVER (PARTITION BY view ORDER BY total DESC, merchant) AS rank, greatest(count(*) OVER (PARTITION BY view) - 20, 0) AS remaining FROM pl) SELECT * FROM k WHERE rank <= 20",
    lambda p: spend.top_in_each(p, "view", 20, F.desc("total"), F.asc("merchant")).select("view", "merchant", c("rank").cast("long").alias("rank"), "remaining"),
)
spent("w05_top_unknown", "SELECT description, count(*) AS count FROM sp WHERE category = 'Unknown' GROUP BY description ORDER BY sum(abs(amount)) DESC, description LIMIT 10", lambda d: spend.discover(d, 10).select("description", "count"))
ranked("w06_top_per_category", f"SELECT category, merchant, rank, remaining FROM ({_EACH.format(n=5)}) WHERE rank <= 5", lambda m: spend.top_in_each(m, "category", 5, F.desc("total"), F.asc("merchant")).select("category", "merchant", c("rank").cast("long").alias("rank"), "remaining"))
spent(
    "w07_recent",
    "SELECT merchant, date, description, round(amount, 2) AS amount FROM (SELECT *, row_number() OVER (PARTITION BY merchant ORDER BY date DESC, description, amount, source) AS rank FROM sp) WHERE rank <= 10",
    lambda d: spend.top_in_each(d, "merchant", 10, F.desc("date"), F.asc("description"), F.asc("amount"), F.asc("source")).select("merchant", "date", "description", r2("amount").alias("amount")),
)
ranked("w08_sorted", "SELECT merchant, round(total, 2) AS total FROM mer ORDER BY abs(total) DESC, merchant", lambda m: spend.sort_by(m, "total", True, True).select("merchant", r2("total").alias("total")))
ranked("w08_sorted_by_name", "SELECT merchant, count FROM mer ORDER BY lower(merchant), merchant", lambda m: spend.sort_by(m, "merchant", False).select("merchant", "count"))
spent(
    "w09_top_categories_by_month",
    "SELECT month, category, round(sum(amount), 2) AS total FROM sp WHERE bucket = 'spending' AND category IN (SELECT category FROM sp WHERE bucket = 'spending' GROUP BY category ORDER BY sum(amount) DESC, category LIMIT 8) GROUP BY ALL",
    lambda d: d.filter("bucket = 'spending'").join(spend.top(d.filter("bucket = 'spending'").groupBy("category").agg(F.sum("amount").alias("t")), 8, F.desc("t"), "category").select("category"), "category", "left_semi").groupBy("month", "category").agg(r2(F.sum("amount")).alias("total")),
)
ranked("w10_by_monthly_value", f"SELECT merchant, {TWELFTH_SQL.format('total')} AS monthly FROM mer ORDER BY total / 12 DESC, merchant", lambda m: m.orderBy(F.desc("monthly_value"), "merchant").select("merchant", twelfth("total").alias("monthly")))

# Set operations
register("u01_union", "SELECT 'orders' AS kind, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")(
    lambda spark, sf_dir: tables.otxn(spark, sf_dir).select("description", F.lit("orders").alias("kind")).unionByName(tables.txn(spark, sf_dir).select("description", F.lit("lineitem").alias("kind")), allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"))
)
spent("u02_distinct", "SELECT 'tags' AS kind, count(DISTINCT t) AS n FROM (SELECT unnest(tags) AS t FROM sp) UNION ALL SELECT 'months', count(DISTINCT month) FROM sp UNION ALL SELECT 'locations', count(DISTINCT location) FROM sp UNION ALL SELECT 'categories', count(DISTINCT category) FROM sp", lambda d: d.select(F.explode("tags").alias("x")).agg(F.lit("tags").alias("kind"), F.countDistinct("x").alias("n")).unionByName(d.agg(F.lit("months").alias("kind"), F.countDistinct("month").alias("n"))).unionByName(d.agg(F.lit("locations").alias("kind"), F.countDistinct("location").alias("n"))).unionByName(d.agg(F.lit("categories").alias("kind"), F.countDistinct("category").alias("n"))))
spent("u03_tag_overlap", "SELECT list_has_any(tags, ['tools', 'large']) AS overlap, count(*) AS n FROM sp GROUP BY 1", lambda d: d.groupBy(F.arrays_overlap("tags", F.array(F.lit("tools"), F.lit("large"))).alias("overlap")).agg(F.count("*").alias("n")))

spent(
    "u02_top_locations",
    "SELECT location, count(*) AS n, round(sum(abs(amount)), 2) AS size FROM sp WHERE location IS NOT NULL GROUP BY location ORDER BY count(*) DESC, location LIMIT 10",
    lambda d: spend.top(d.filter("location IS NOT NULL").groupBy("location").agg(F.count("*").alias("n"), r2(F.sum(F.abs("amount"))).alias("size")), 10, F.desc("n"), "location"),
)

# Report tables: rows of all of them under one form.
def rows_of(parts, forms):
    """Rows (part, key, value) of tables; forms: table -> list of (name of the part, key, value)."""
    return reduce(lambda a, b: a.unionByName(b), [parts[t].select(F.lit(n).alias("part"), k.alias("key"), v.cast("double").alias("value")) for t, each in forms.items() for n, k, v in each])


_K02 = f"""{FLOW_SQL}, mer AS (SELECT merchant, sum(eff) AS total FROM sp GROUP BY merchant), cat AS (SELECT category, sum(eff) AS total FROM sp GROUP BY category)"""
spent(
    "k02_report_tables",
    """SELECT 'cash_flow' AS part, 'net' AS key, round(income - spending + credit, 2) AS value FROM flow UNION ALL SELECT 'months', month, round(coalesce(sum(amount) FILTER (bucket = 'spending'), 0), 2) FROM sp GROUP BY month
    UNION ALL SELECT 'transfers', 'in', round(transfer_in, 2) FROM flow UNION ALL SELECT 'transfers', 'out', round(transfer_out, 2) FROM flow UNION ALL SELECT 'transfers', 'net', round(transfer_in - transfer_out, 2) FROM flow
    UNION ALL SELECT 'credits', merchant, round(total, 2) FROM mer WHERE total < 0 UNION ALL SELECT 'categories', category, round(100 * total / sum(total) OVER (), 1) FROM cat WHERE total > 0 UNION ALL SELECT 'merchants', merchant, round(total, 2) FROM mer""",
    lambda d: rows_of(
        sinks.report_tables(d),
        {
            "cash_flow": [("cash_flow", F.lit("net"), r2("net_cash_flow"))],
            "transfers": [("transfers", c("item"), r2("amount"))],
            "months": [("months", c("month"), r2("spending"))],
            "credits": [("credits", c("merchant"), r2("total"))],
            "categories": [("categories", c("category"), c("share"))],
            "merchants": [("merchants", c("merchant"), r2("total"))],
        },
    ),
    _K02,
)


spent("k01_nested", "SELECT merchant, category, subcategory, array_to_string(tags, '|') AS tags, count, round(total, 2) AS total, months_active FROM mer", lambda d: sinks.merchant_records(d, 0).select("merchant", "category", "subcategory", F.array_join("tags", "|").alias("tags"), "count", r2("total").alias("total"), "months_active"), MERCHANTS_SQL)
_K01 = f"""{CV_SQL}, totals AS (SELECT sum(total) AS total, sum(total) FILTER (total > 0) AS gross, coalesce(abs(sum(total) FILTER (total < 0)), 0) AS credits, coalesce(abs(sum(total) FILTER (list_contains(tags, 'income'))), 0) AS income,
    coalesce(abs(sum(total) FILTER (list_contains(tags, 'transfer'))), 0) AS transfers, (SELECT count(DISTINCT month) FROM sp) AS months FROM mer)"""


@register(
    "k01_json",
    f"""WITH {_K01} SELECT 'summary' AS part, 'total' AS key, round(total, 2) AS value FROM totals UNION ALL SELECT 'summary', 'gross', round(gross, 2) FROM totals UNION ALL SELECT 'summary', 'credits', round(credits, 2) FROM totals
    UNION ALL SELECT 'summary', 'income', round(income, 2) FROM totals UNION ALL SELECT 'summary', 'transfers', round(transfers, 2) FROM totals UNION ALL SELECT 'summary', 'monthly', round(total / months, 2) FROM totals
    UNION ALL SELECT 'summary', 'net', CASE WHEN income > 0 THEN round(income - total, 2) END FROM totals UNION ALL SELECT 'months', month, round(sum(eff), 2) FROM sp GROUP BY month
    UNION ALL SELECT 'categories', category || '/' || subcategory, round(sum(eff), 2) FROM sp GROUP BY category, subcategory HAVING sum(eff) > 0 UNION ALL SELECT 'credits', merchant || '/' || category, round(abs(total), 2) FROM mer WHERE total < 0
    UNION ALL SELECT 'merchants', merchant || '/' || category || '/' || subcategory || '/' || array_to_string(tags, ','), count FROM mer UNION ALL SELECT 'merchants.total', merchant, round(total, 2) FROM mer UNION ALL SELECT 'merchants.months', merchant, months_active FROM mer
    UNION ALL SELECT 'merchants.average', merchant, round(total / months_active, 2) FROM mer UNION ALL SELECT 'merchants.cv', merchant, round(cv, 4) FROM cvs
    UNION ALL SELECT 'descriptions', merchant || '/' || description, count(*) FROM sp GROUP BY merchant, description
    UNION ALL SELECT 'transactions', merchant || '/' || month || '/' || strftime(date, '%Y-%m-%d') || '/' || description || '/' || source || '/' || array_to_string(tags, ','), round(amount, 2) FROM sp""",
)
def k01_json(spark, sf_dir):
    """The JSON export with all its levels, written and read back."""
    folder = f"{store.shared_folder(spark)}/json-{uuid.uuid4().hex}"
    sinks.write_json(tables.spending(spark, sf_dir), folder, 2)
    parts = {name: spark.read.json(f"{folder}/{name}") for name in ("summary", "months", "categories", "credits", "merchants", "descriptions", "transactions")}
    path = lambda *columns: F.concat_ws("/", *columns)
    one = lambda key, column: ("summary", F.lit(key), r2(column))
    return rows_of(
        parts,
        {
            "summary": [one("total", "total"), one("gross", "gross_spending"), one("credits", "credits"), one("income", "income"), one("transfers", "transfers"), one("monthly", "monthly"), one("net", "net_cash_flow")],
            "months": [("months", c("month"), r2("total"))],
            "categories": [("categories", path("category", "subcategory"), r2("total"))],
            "credits": [("credits", path("merchant", "category"), r2("amount"))],
            "merchants": [
                ("merchants", path("merchant", "category", "subcategory", F.array_join("tags", ",")), c("count")),
                ("merchants.total", c("merchant"), r2("total")),
                ("merchants.months", c("merchant"), c("months_active")),
                ("merchants.average", c("merchant"), r2("avg_when_active")),
                ("merchants.cv", c("merchant"), F.round("cv", 4)),
            ],
            "descriptions": [("descriptions", path("merchant", "description"), c("n"))],
            "transactions": [("transactions", path("merchant", "month", "date", "description", "source", F.array_join("tags", ",")), r2("amount"))],
        },
    )


spent(
    "k03_report_records",
    """SELECT sp.merchant, month, date, sp.description, round(amount, 2) AS amount, source, location, array_to_string(sp.tags, '|') AS tags, mer.category AS merchant_category, mer.subcategory AS merchant_subcategory FROM sp JOIN mer USING (merchant)""",
    lambda d: sinks.report_records(d).select("merchant", "month", "date", "description", r2("amount").alias("amount"), "source", "location", F.array_join("tags", "|").alias("tags"), "merchant_category", "merchant_subcategory"),
    MERCHANTS_SQL,
)
viewed(
    "k03_sections",
    "SELECT view, merchant, lower(category || '/' || subcategory) AS path, months, n_payments, round(total, 2) AS total, round(CASE WHEN total / months <> 0 THEN total / months ELSE total / n END, 2) AS monthly, array_to_string(tags, '|') AS tags FROM pl",
    lambda p: p.select(
        "view",
        "merchant",
        F.lower(F.concat_ws("/", "category", "subcategory")).alias("path"),
        "months",
        "n_payments",
        r2("total").alias("total"),
        r2(F.coalesce(F.nullif(c("total") / c("months"), F.lit(0.0)), c("total") / c("n_months"))).alias("monthly"),
        F.array_join("tags", "|").alias("tags"),
    ),
)
spent(
    "k03_totals",
    "SELECT num_months, (SELECT max(date) FROM sp) AS data_through, round(income, 2) AS income, round(spending, 2) AS spending, round(credit, 2) AS credits, round(income - spending + credit, 2) AS cash_flow, round(transfer_in, 2) AS transfers_in, round(transfer_out, 2) AS transfers_out, round(transfer_in - transfer_out, 2) AS transfers_net, round(investment, 2) AS investment FROM flow",
    lambda d: spend.cash_flow(d)
    .join(F.broadcast(d.agg(F.max("date").alias("data_through"))))  # one row each
    .select(
        "num_months",
        "data_through",
        *[r2(k).alias(n) for k, n in (("income", "income"), ("spending", "spending"), ("credit", "credits"), ("net_cash_flow", "cash_flow"), ("transfer_in", "transfers_in"), ("transfer_out", "transfers_out"), ("net_transfers", "transfers_net"), ("investment", "investment"))],
    ),
    FLOW_SQL,
)
spent("k04_discovery_rows", "SELECT description, count, total, suggested_merchant FROM di", lambda d: spend.discover(d).select("description", "count", r2("total").alias("total"), "suggested_merchant"), _DISCOVERED)
