"""Totals on small tables."""

import datetime
import hashlib

from pyspark.sql import functions as F

from txnrules.operators import spend, views
from txnrules.plans import registry

SCHEMA = "description string, amount double, date date, merchant string, category string, subcategory string, tags array<string>, source string, location string"


def frame(spark, *rows):
    made = [(d, float(a), datetime.date(2025, m, 15), d.title(), c, "s", tags, "src", None) for d, a, m, c, tags in rows]
    return spend.with_buckets(spark.createDataFrame(made, SCHEMA))


def test_buckets_and_cash_flow(spark):
    d = frame(spark, ("grocery", 50, 1, "Food", []), ("salary", 3000, 1, "Income", ["income"]), ("move", 100, 1, "T", ["transfer"]), ("refund", -30, 1, "Food", []), ("coffee", 5, 1, "Food", []))
    f = spend.cash_flow(d).first()
    assert (f.income, f.transfer_in, f.spending, f.credit, f.net_cash_flow) == (3000, 100, 55, 30, 2975)
    assert {r.bucket for r in d.collect()} == {"spending", "income", "transfer_in", "credit"}


def test_months_and_hierarchy(spark):
    d = frame(spark, ("a", 50, 1, "Food", []), ("b", 5, 1, "Food", []), ("a", 25, 2, "Unknown", []))
    assert {r.month: r.total for r in spend.by(d, "month").collect()} == {"2025-01": 55, "2025-02": 25}
    assert spend.num_months(d).first().num_months == 2 and spend.num_months(d.limit(0)).first().num_months == 12
    rows = spend.hierarchy(d).collect()
    assert next(r.ytd for r in rows if r.level == 0) == 80 and any(r.category == "Uncategorized" for r in rows)


def test_variation_and_views(spark):
    d = frame(spark, *[("net", 10, m, "Media", []) for m in range(1, 9)], ("tv", 700, 1, "Shop", ["Big"]), ("tv", 110, 5, "Shop", []))
    cv = {r.merchant: (round(r.cv, 4), r.consistent) for r in spend.variation(d).collect()}
    assert cv["Net"] == (0.0, True) and not cv["Tv"][1]
    found = views.classify_views(views.features(d), [views.View("total", "total > 100"), views.View("steady", "cv < lim AND months >= 6", {"lim": "0.1"}), views.View("none", "false")])
    assert sorted((r.view, r.merchant) for r in found.collect()) == [("steady", "Net"), ("total", "Tv")]
    assert spend.by_merchant(d).filter("merchant = 'Tv'").first().max_payment == 700


def test_empty(spark):
    d = frame(spark, ("a", 1, 1, "x", [])).limit(0)
    assert spend.by_merchant(d).count() == 0 and spend.cash_flow(d).first()["count"] == 0
    assert views.classify_views(views.features(d), views.default_views()).count() == 0


def unordered(spark):
    """Rows of two merchants and a null date, shuffled, with equal rows and amounts that only their tags tell apart."""
    day = datetime.date
    made = [("b", -5.0, day(2025, 2, 1), ["income"]), ("a", 1.5, day(2025, 1, 9), []), ("b", -5.0, day(2025, 2, 1), []), ("a", 1.5, day(2025, 1, 9), []), ("c", 7.25, None, []), ("a", 3.0, day(2025, 2, 1), ["x"])]
    rows = [(d, a, when, "Shop", "Food", "s", tags, "src", None) for d, a, when, tags in made] + [("z", 2.0, day(2025, 1, 1), "Other", "Food", "s", [], "src", None)]
    return spend.with_buckets(spark.createDataFrame(rows, SCHEMA).repartition(3))


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def test_transactions_are_grouped_in_order(spark):
    found = sorted((r.merchant, r.place, r.month, r.description, r.tags, r.n, r.digest) for r in spend.transactions(unordered(spark)).collect())
    january, february = md5("2025-01-09 a\n2025-01-09 a"), md5("2025-02-01 a\n2025-02-01 b\n2025-02-01 b")
    assert found[0] == ("Other", 1, "2025-01", "z", [], 1, md5("2025-01-01 z"))
    assert found[1:] == [
        ("Shop", 1, "2025-01", "a", [], 2, january),
        ("Shop", 2, "2025-01", "a", [], 2, january),
        ("Shop", 3, "2025-02", "a", ["x"], 3, february),
        ("Shop", 4, "2025-02", "b", [], 3, february),
        ("Shop", 5, "2025-02", "b", ["income"], 3, february),
        ("Shop", 6, None, "c", [], 1, None),  # nothing tells when it was
    ]


def test_payments_are_listed_in_order(spark):
    found = sorted((r.merchant, r.place, r.period, r.payment, r.n, r.digest) for r in spend.payments(unordered(spark), "year").filter("merchant = 'Shop'").collect())
    assert [x[1:4] for x in found] == [(1, "2025", 1.5), (2, "2025", 1.5), (3, "2025", 3.0), (4, "2025", -5.0), (5, "2025", 5.0), (6, None, 7.25)]
    assert {x[4:] for x in found} == {(5, md5("150,150,300,-500,500")), (1, md5("725"))}
    assert spend.payments(unordered(spark).limit(0)).count() == 0


def test_merchants_list_their_descriptions(spark):
    found = spend.listed_descriptions(spend.description_counts(unordered(spark)))
    assert {r.merchant: r.descriptions for r in found.collect()} == {"Shop": "a:3|b:2|c:1", "Other": "z:1"}
    query, sql = registry.queries()["a04_by_merchant"](spark, "/root/testdata/sf0.001"), registry.oracle_sql()["a04_by_merchant"]
    listed = {r.merchant: (r["count"], r.descriptions) for r in query.collect()}
    assert "descriptions" in sql and all(n == sum(int(x.rsplit(":", 1)[1]) for x in told.split("|")) for n, told in listed.values())


def test_a_group_streams_through_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        d = spend.with_buckets(spark.range(1000).selectExpr("'x' AS description", "CAST(id AS double) AS amount", "date'2025-01-01' AS date", "'M' AS merchant", "'c' AS category", "'s' AS source", "array() AS tags").withColumn("tags", F.col("tags").cast("array<string>")))
        found = spend.payments(d).orderBy("place").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.place, r.payment) for r in found] == [(k + 1, float(k)) for k in range(1000)] and {(r.n, r.digest) for r in found} == {(1000, md5(",".join(f"{k}00" if k else "0" for k in range(1000))))}
