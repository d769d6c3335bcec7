"""The kept state, tables written once, and streams that feed them."""

import datetime
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from txnrules.functions.text import register_sql_functions
from txnrules.operators import facets, spend, state, views
from txnrules.operators.rules import Rule, RuleSet
from txnrules.sources import store
from txnrules.streaming import totals

RAW = "description string, amount double, date date, source string, location string"
RULES = RuleSet([Rule("Shop", "has(description, 'shop')", "Retail", "Any", "The Shop", ["buy"]), Rule("Broken", "CAST(description AS INT) > 0", "Bad"), Rule("Unknown name", "nothing = 1", "Bad"), Rule("Pay", "amount > 900", tags=["income"])])


def rows(n=400, months=range(1, 7)):
    rng = random.Random(61)
    dates = [datetime.date(2025, rng.choice(list(months)), rng.randrange(1, 28)) for _ in range(n)]
    return [(rng.choice(["SHOP 1", "SHOP 2", "CAFE", "BAR 7", "PAYROLL"]), float(rng.randrange(-20000, 100000)) / 100, d, rng.choice("ab"), rng.choice(["X", None])) for d in dates]


def frame(spark, data):
    register_sql_functions(spark)
    return spend.with_buckets(RULES.classify(spark.createDataFrame(data, RAW)))


def told(spark, folder):
    """What the state says, with figures rounded."""
    read = lambda name: state.read(spark, folder, name)
    periods = state.merchant_periods(read("totals"))
    return [plain(x) for x in (spend.of_periods(periods), views.features_of(periods), facets.values_of(state.combinations(read("facets"))), state.description_counts(read("descriptions")), state.discover(read("descriptions")))]


def direct(df):
    return [plain(x) for x in (spend.by_merchant(df), views.features(df), facets.facet_values(df), spend.description_counts(df), spend.discover(df))]


def plain(df):
    return sorted(repr([round(x, 5) + 0.0 if isinstance(x, float) else x for x in (r[c] for c in sorted(df.columns))]) for r in df.collect())


def files(folder):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/**/*.parquet", recursive=True)}


def test_adding_a_month_equals_recomputing_all(spark, tmp_path):
    folder, data = str(tmp_path), rows()
    early, last = [r for r in data if r[2].month < 6], [r for r in data if r[2].month == 6]
    state.add(frame(spark, early), folder, "one")
    before = files(folder)
    state.add(frame(spark, last), folder, "two")
    after = files(folder)
    assert before and {f: t for f, t in after.items() if f in before} == before and all("month=2025-06" in f for f in set(after) - set(before))
    state.add(frame(spark, last), folder, "two")  # the same batch again counts once
    assert told(spark, folder) == direct(frame(spark, data))
    more = rows(90, [3, 6])
    state.add(frame(spark, more), folder, "three")  # a month that is there already
    some = state.read(spark, folder, "totals", ["2025-03"])
    assert some.select(F.sum("n")).first()[0] == sum(r[2].month == 3 for r in data + more) and some.select(F.input_file_name()).distinct().count() == 2
    state.compacted(spark, folder, f"{folder}/compact")
    assert told(spark, f"{folder}/compact") == direct(frame(spark, data + more))


def test_empty_state(spark, tmp_path):
    state.add(frame(spark, []), str(tmp_path), "none")
    assert all(x == [] for x in told(spark, str(tmp_path)))
    state.add(frame(spark, [("SHOP", 1.0, None, None, None)]), str(tmp_path), "undated")
    assert spend.of_periods(state.merchant_periods(state.read(spark, str(tmp_path), "totals"))).first().months_active == 0


def test_a_stream_in_three_batches_equals_one(spark, tmp_path):
    data, source = rows(300), f"{tmp_path}/in"
    parts = [data[:100], data[100:200], data[200:]]
    stream = lambda: spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(source)
    for k, part in enumerate(parts[:2]):
        spark.createDataFrame(part, RAW).coalesce(1).write.mode("append").parquet(source)
    run = lambda: totals.keep_totals(stream(), RULES, f"{tmp_path}/state", f"{tmp_path}/check", availableNow=True).awaitTermination(120)
    assert run()
    assert state.read(spark, f"{tmp_path}/state", "facets").select(F.sum("n")).first()[0] == 200
    spark.createDataFrame(parts[2], RAW).coalesce(1).write.mode("append").parquet(source)
    assert run()  # goes on from its checkpoint
    assert told(spark, f"{tmp_path}/state") == direct(frame(spark, data)) and len({r.batch for r in state.read(spark, f"{tmp_path}/state", "totals").collect()}) == 3


def test_failing_rules_in_a_plain_stream(spark, tmp_path):
    spark.createDataFrame(rows(50), RAW).coalesce(1).write.parquet(f"{tmp_path}/in")
    found = totals.classified(spark.readStream.schema(RAW).parquet(f"{tmp_path}/in"), RULES)
    query = found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/check").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 50 and {r.category for r in out.collect()} == {"Retail", "Unknown"}


def test_tables_written_once(spark, tmp_path):
    path, built = f"{tmp_path}/t.parquet", []
    spark.range(3).write.parquet(path)

    def build():
        built.append(1)
        return spark.read.parquet(path).withColumn("month", F.lit("2025-01"))

    once = lambda: store.table_once(spark, "t", [path], build, "month")
    assert (once().count(), once().count()) == (3, 3) and once().inputFiles() == once().inputFiles() and path not in once().inputFiles()[0]
    first = once().inputFiles()
    spark.range(5).write.mode("overwrite").parquet(path)
    assert once().count() == 5 and once().inputFiles() != first
    assert once().filter("month = '2025-01'").count() == 5 and dict(once().dtypes)["month"] == "string"


@pytest.mark.parametrize("unit", ["month", "day"])
def test_payments_and_transactions_are_flat(spark, unit):
    d = frame(spark, rows(40))
    assert spend.payments(d, unit).count() == spend.transactions(d).count() == 40
