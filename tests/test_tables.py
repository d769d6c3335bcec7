"""Look-ups, facets, profiles, suggestions and sinks on small tables."""

import os
import time

import pytest
from pyspark.sql import functions as F

from txnrules.functions import text as X
from txnrules.operators import facets, lookup, profile, spend, views
from txnrules.sources import sinks


@pytest.fixture(scope="module")
def spending(spark):
    rows = [("NETFLIX", 10.0, "2025-01-15", "Netflix", "Subscriptions", "", ["monthly"]), ("NETFLIX", 12.0, "2025-02-15", "Netflix", "Subscriptions", "", ["monthly"]), ("CAR 9", 1500.0, "2025-02-01", "Car", "Unknown", "Unknown", []), ("CAR 9", -20.0, "2025-03-01", "Car", "Unknown", "Unknown", ["refund"]), ("PAY", 900.0, "2025-03-02", "Work", "Pay", "", ["income"])]
    made = spark.createDataFrame(rows, "description string, amount double, date string, merchant string, category string, subcategory string, tags array<string>")
    return spend.with_buckets(made.withColumn("date", F.to_date("date")).withColumn("source", F.lit("s")).withColumn("location", F.lit(None).cast("string")))


def test_lookups(spark):
    t = spark.createDataFrame([(1, 50.0), (2, 9.0), (None, 1.0)], "id int, amount double")
    s = spark.createDataFrame([(1, "Book", 20.0, 1), (1, "Cable", 30.0, 2), (3, "Toy", 10.0, 3)], "order_id int, item string, price double, ord int")
    on = {"id": "order_id"}
    assert {r.id: r.found for r in lookup.exists(t, s, on).collect()} == {1: True, 2: False, None: False}
    assert sorted(r.id or 0 for r in lookup.without(t, s, on).collect()) == [0, 2]
    found = lookup.aggregated(t, s, on, {"n": F.count("*"), "items": F.array_join(lookup.listed("item", "ord"), ",")}, default={"n": 0})
    assert {r.id: (r.n, r.items) for r in found.collect()} == {1: (2, "Book,Cable"), 2: (0, None), None: (0, None)}


def test_joins_without_equality(spark):
    t = spark.createDataFrame([(1, 5.0), (2, 10.0), (3, 99.5), (4, None)], "id int, amount double")
    s = spark.createDataFrame([("a", 0.0, 10.0), ("b", 5.0, 100.0), ("c", 7.0, 7.0), ("d", None, 9.0)], "name string, low double, high double")
    found = lookup.in_range(t, s, "amount", "low", "high", 8.0)
    assert sorted((r.id, r.s_name) for r in found.collect()) == [(1, "a"), (1, "b"), (2, "b"), (3, "b")]
    below = lookup.by_condition(t, s, "id", F.col("amount") < F.col("s_high"), {"n": F.count("*")})
    assert "CartesianProduct" not in below._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.n for r in below.collect()} == {1: 4, 2: 1, 3: 1, 4: None}


def test_ranges_of_any_width(spark):
    import random

    rng = random.Random(81)
    ranges = [(k, lo := rng.uniform(-1e6, 1e6), lo + 10 ** rng.uniform(-3, 7)) for k in range(300)] + [(300, float("-inf"), 0.0), (301, -5.0, float("inf")), (302, None, 5.0), (303, 5.0, float("nan")), (304, 3.0, 3.0), (305, -1e300, 1e300), (306, 0.0, 0.01), (307, -0.01, 0.0)]
    values = [(k, rng.uniform(-1e6, 1e6)) for k in range(300)] + [(300, 0.0), (301, -0.01), (302, None), (303, 1e12), (304, -1e12), (305, 0.005)]
    t, s = spark.createDataFrame(values, "id int, x double"), spark.createDataFrame(ranges, "name int, low double, high double")
    found = lookup.in_range(t, s, "x", "low", "high", 0.01)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    want = sorted((k, n) for k, x in values for n, lo, hi in ranges if x is not None and lo is not None and hi == hi and lo <= x < hi)
    assert sorted((r.id, r.s_name) for r in found.collect()) == want
    pieces = spark.createDataFrame([(a, b) for a, b in [(-7, 13), (0, 1), (5, 5), (-(2**60), 2**60), (3, 2**59 + 1)]], "a long, b long").select("a", "b", lookup.dyadic(F.col("a"), F.col("b")).alias("p")).collect()
    for r in pieces:
        assert len(r.p) <= 2 * lookup.LEVELS and sum(2**x.level for x in r.p) == r.b - r.a
        spans = sorted((x.place << x.level, (x.place + 1) << x.level) for x in r.p)
        assert not spans or (spans[0][0], spans[-1][1]) == (r.a, r.b)
    assert lookup.in_range(t, s.limit(0), "x", "low", "high", 0.01).count() == 0


def test_totals_of_ranges_without_pairs(spark, monkeypatch):
    import random

    monkeypatch.setattr(lookup, "BUCKETS", 7)
    monkeypatch.setattr(lookup, "COARSE", 4)
    rng = random.Random(83)
    ranges = [(k, lo := rng.uniform(-1e3, 1e3), lo + 10 ** rng.uniform(-3, 4)) for k in range(300)] + [(300, float("-inf"), 0.0), (301, -5.0, float("inf")), (302, None, 5.0), (303, 5.0, float("nan")), (304, 3.0, 3.0), (305, -0.0, 7.0), (306, -0.0, 7.0), (307, 1e6, 2e6)]
    values = [(k, round(rng.uniform(-1e3, 1e3), rng.choice([0, 1, 9]))) for k in range(900)] + [(900, 0.0), (901, -0.0), (902, None), (903, 1e12), (904, float("nan")), (905, float("inf"))]
    t, s = spark.createDataFrame(values, "id int, x double"), spark.createDataFrame(ranges, "name int, low double, high double")
    asked = {"n": (F.count("*"), F.sum), "last": (F.max("x"), F.max), "ids": (F.sum("id"), F.sum)}
    found = lookup.aggregated_in_range(t, s, "x", "low", "high", asked)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    want = {}
    for name, lo, hi in ranges:
        inside = [(k, x) for k, x in values if x is not None and lo is not None and hi == hi and lo <= x < hi]
        if inside:
            want[name] = (lo, hi, len(inside), max(x for _, x in inside), sum(k for k, _ in inside))
    assert {r.name: (r.low, r.high, r.n, r["last"], r.ids) for r in found.collect()} == want and len(want) > 150
    assert lookup.aggregated_in_range(t.limit(0), s, "x", "low", "high", asked).count() == 0


def test_ranges_make_no_pairs_and_no_broadcast_of_pieces(spark, tmp_path):
    from txnrules.plans import joins

    spark.range(300000).selectExpr("CAST(id % 500000 AS DOUBLE) + 0.5 AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(3000).selectExpr("id AS p_partkey", "CAST(0 AS INT) AS p_size", "CAST(0 AS DOUBLE) AS p_retailprice").withColumn("p_partkey", F.col("p_partkey") * 97).write.parquet(str(tmp_path / "part.parquet"))
    found = joins.j09d(spark, str(tmp_path))  # 900 million pairs
    assert {(r.n, r.largest) for r in found.collect()} == {(300000, 299999.5)} and found.count() == 3000


def test_price_ranges_make_no_pairs(spark, tmp_path):
    from txnrules.plans import joins

    spark.range(200000).selectExpr("90005.0D + id % 10 AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(10000).selectExpr("id AS p_partkey", "CAST(1 AS INT) AS p_size", "CAST(900 AS DOUBLE) AS p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    found = joins.j09c(spark, str(tmp_path))  # a billion pairs
    assert [tuple(r) for r in found.groupBy("n").count().collect()] == [(100000, 10000)]


def test_no_cartesian_product_unasked(spark):
    t, s = spark.createDataFrame([(1, 5.0)], "id int, x double"), spark.createDataFrame([("a", 1.0), ("b", 9.0)], "name string, y double")
    with pytest.raises(ValueError):
        lookup.by_condition(t, s, "id", F.col("x") > F.col("s_y"), {"n": F.count("*")}, broadcast_rows=1)
    assert lookup.by_condition(t, s, "id", (F.col("x") > F.col("s_y")) & (F.col("id") == F.length("s_name")), {"n": F.count("*")}, broadcast_rows=1).first().n == 1


def test_facets(spending):
    values = {(r.kind, r.value, r.parent): r.n for r in facets.facet_values(spending).collect()}
    assert values[("merchant", "Car", "")] == 2 and values[("tag", "monthly", "")] == 2 and values[("subcategory", "Unknown", "Unknown")] == 2 and values[("category", "Pay", "")] == 1
    assert not any(k == "location" for k, _, _ in values) and sum(n for (k, _, _), n in values.items() if k == "merchant") == 5
    kept = spending.filter(facets.facet_filter([facets.Facet("category", "subscriptions"), facets.Facet("month", "2025-02..2025-03"), facets.Facet("tag", "income", True)]))
    assert kept.count() == 1


def test_views(spending):
    found = {}
    for r in views.classify_views(views.features(spending), views.default_views()).collect():
        found.setdefault(r.view, set()).add(r.merchant)
    assert found == {"Total": {"Netflix", "Car", "Work"}, "Subscriptions": {"Netflix"}, "Big Purchases": {"Car"}}
    f = {r.merchant: r for r in views.features(spending).collect()}
    assert (f["Car"].months, f["Car"].total, f["Car"].max, f["Car"].min, f["Work"].stddev) == (2, 1480.0, 1500.0, -20.0, 0.0)
    assert abs(f["Car"].stddev - 1520 / 2**0.5) < 1e-6 and views.months_in(spending).first().n_months == 3


def test_discovery_and_records(spending):
    (car,) = spend.discover(spending).collect()
    assert (car["count"], car.total, car.has_negative, [e.amount for e in car.examples], car.suggested_merchant, list(car.suggested_tags)) == (2, 1520.0, True, [1500.0, -20.0], "Car 9", ["refund"])
    assert car.suggested_rule.endswith("tags: refund")
    assert {r.merchant: (r["count"], r.total, r.months_active) for r in sinks.merchant_records(spending, 2).collect()} == {"Car": (2, 1480.0, 2), "Netflix": (2, 22.0, 2), "Work": (1, 900.0, 1)}
    assert sorted((r.merchant, r.month, r.amount, r.merchant_category) for r in sinks.report_records(spending).collect())[:2] == [("Car", "2025-02", 1500.0, "Unknown"), ("Car", "2025-03", -20.0, "Unknown")]
    told = sinks.summary(spending).first()
    assert (told.total, told.gross_spending, told.credits, told.income, told.num_months, told.net_cash_flow) == (2402.0, 2402.0, 0.0, 900.0, 3, -1502.0)
    assert {r["item"]: r.amount for r in sinks.report_tables(spending)["transfers"].collect()} == {"in": 0.0, "out": 0.0, "net": 0.0}


def test_json_parts_by_detail(spending, tmp_path):
    assert [sorted(sinks.json_parts(spending, k)) for k in (0, 2)] == [["categories", "credits", "merchants", "months", "summary"], ["categories", "credits", "descriptions", "merchants", "months", "summary", "transactions"]]
    sinks.write_json(spending, str(tmp_path), 2)
    assert spending.sparkSession.read.json(f"{tmp_path}/transactions").count() == 5


def test_listing_orders_categories_by_total(spending):
    found = [(r.category, r.merchant, r["rank"]) for r in spend.listing(spend.by_merchant(spending), 5, 2).collect()]
    assert found == [("Unknown", "Car", 1), ("Pay", "Work", 1)]


@pytest.mark.parametrize(
    "text, merchant, pattern",
    [
        ("SQ *BLUE BOTTLE 12345 SEATTLE WA", "Blue Bottle", r"BLUE\s*BOTTLE"),
        ("GOOGLE *YouTube Premium", "Youtube Premium", r"YOUTUBE\s*PREMIUM"),
        ("o'neil's  #42", "O'Neil'S", "O'NEIL'S"),
        ("ACME DES:PAYROLL ID:77", "Acme", r"ACME\s*DES:PAYROLL\s*ID:77"),
        ("a.b (c) d e", "A.B (C) D", r"A\.B\s*\(C\)\s*D"),
        ("", "Unknown", ""),
    ],
)
def test_suggestions(spark, text, merchant, pattern):
    row = spark.createDataFrame([(text,)], "t string").select(X.suggested_merchant("t").alias("m"), X.suggested_pattern("t").alias("p")).first()
    assert (row.m, row.p) == (merchant, pattern)


@pytest.mark.parametrize(
    "lines, kind, delimiter",
    [
        (["01/02/2025  SHOP ONE  1,234.56", "01/03/2025  SHOP  5.99", "01/04/2025  X  7.00"], "fixed_width", None),
        (["Date,What,Amount", '1/2/2025,"a, b","1,234.56"', "1/3/2025,c,5.99"], "csv", ","),
        (["a;b;1,234.50", "c;d;5.00"], "csv", ";"),
        (["just words", "and more of them"], "unknown", None),
    ],
)
def test_layout(spark, lines, kind, delimiter):
    found = profile.layout(spark.createDataFrame([(x,) for x in lines], "value string")).first()
    assert (found.layout, found.delimiter) == (kind, delimiter)


def test_column_profile(spark):
    rows = [("1-2-2025", "$5.00", "AB"), ("11-12-2025", "$1,000.10", "C"), (" ", "5", "DEF")] * 2
    found = {r.name: r for r in profile.column_profile(spark.createDataFrame(rows, "d string, fee string, t string"), 0.6).collect()}
    assert (found["d"].type, found["d"].filled, list(found["d"].samples)) == ("date MM-dd-yyyy", 4, ["1-2-2025", "11-12-2025"])
    assert found["fee"].type == "currency" and found["t"].type == "categorical"


def test_distinct_texts_are_compared_once(spark):
    from txnrules.functions.similarity import closest

    found = closest(spark.createDataFrame([("Gizmo Inc",)] * 5 + [("Bolt Co",), (None,)], "merchant string"), "Gizmoo Ink", "merchant")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.index("ArrowEvalPython") < plan.index("Aggregate")  # the comparison is made of what the aggregate leaves
    assert [r.merchant for r in found.collect()] == ["Gizmo Inc"]


def test_the_classified_table_leaves_no_shuffle_files(spark, monkeypatch, tmp_path):
    from txnrules.plans import tables
    from txnrules.sources import store

    monkeypatch.setattr(store, "shared_folder", lambda s: str(tmp_path))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    shuffled = lambda: {f"{at}/{n}" for folder in folders for at, _, names in os.walk(folder) for n in names if n.startswith("shuffle_")}
    try:
        before = shuffled()
        found = tables.spending(spark, "/root/testdata/sf0.001")
        plan = tables.classified(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        left = shuffled() - before
        assert plan.count("SortMergeJoin") == 4 and plan.count("Exchange hashpartitioning(l_") == 2  # line items are shuffled twice
        assert found.count() == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    for _ in range(50):  # they go a little later
        if not (left := left & shuffled()):
            break
        time.sleep(0.1)
    assert not left
