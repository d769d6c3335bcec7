"""The text index and mergeable profiles."""

import random

import pytest
from pyspark.sql import functions as F

from txnrules.operators import search, sketches

SCHEMA = "id int, description string, location string, amount double"


def data():
    rng = random.Random(91)
    words = ["anvil", "Bolt", "CAFÉ", "red", "widget", "ab", "", "İstanbul", "x\ny", "100%", "a_b"]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 4))) if k % 17 else None, rng.choice(["Nation_1", "nation_22", None]), k / 7) for k in range(600)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("index"))
    search.write_index(spark.createDataFrame(data(), SCHEMA), folder, ["description", "location"], blocks=70)
    return folder


@pytest.mark.parametrize("wanted", ["anvil", "BOLT", "café", "ed wid", "tion_2", "a", "", "zzz", "t\nn", "i̇st", "x\ny", "100%", "a_b", "anvil anvil anvil"])
def test_search_finds_what_contains_finds(spark, index, wanted):
    df = spark.createDataFrame(data(), SCHEMA)
    want = df.filter(F.contains(F.lower("description"), F.lit(wanted.lower())) | F.contains(F.lower("location"), F.lit(wanted.lower())))
    got = search.search(spark, index, SCHEMA, ["description", "location"], wanted)
    assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect())


def test_only_blocks_that_can_hit_are_read(spark, index):
    rows = spark.read.parquet(f"{index}/rows")
    blocks = search.blocks_with(spark, index, "widget widget")
    read = rows.filter(F.col("block").isin(blocks)).count()
    assert 0 < read < rows.count() / 3 and rows.select("block").distinct().count() > 63
    found = search.search(spark, index, SCHEMA, ["description"], "widget widget")
    assert "PartitionFilters: [block" in found._jdf.queryExecution().executedPlan().toString()
    assert search.blocks_with(spark, index, "qqq") == [] and search.blocks_with(spark, index, "qq") is None


def test_empty_index(spark, tmp_path):
    search.write_index(spark.createDataFrame([], SCHEMA), str(tmp_path), ["description"])
    assert search.search(spark, str(tmp_path), SCHEMA, ["description"], "anvil").count() == 0


def test_profiles_of_parts_merge_to_that_of_the_whole(spark, tmp_path):
    rng = random.Random(92)
    rows = [(str(rng.randrange(20_000)), f"{rng.gauss(100, 30):.2f}" if k % 9 else "n/a", rng.choice(["red", "blue", "green"]) if k % 5 else " ", None) for k in range(30_000)]
    df = spark.createDataFrame(rows, "key string, amount string, colour string, nothing string")
    for k in range(3):
        sketches.sketched(df.filter(F.pmod(F.hash("key"), F.lit(3)) == k), f"part {k}").write.mode("append").parquet(f"{tmp_path}/profiles")
    both = [{r.name: r for r in sketches.described(p).collect()} for p in (sketches.merged(spark.read.parquet(f"{tmp_path}/profiles")), sketches.sketched(df, "whole"))]
    amounts = sorted(float(r[1]) for r in rows if r[1] != "n/a")
    for found in both:
        assert {n: (r["rows"], r.filled, r.numeric) for n, r in found.items()} == {"key": (30_000, 30_000, 30_000), "amount": (30_000, 30_000, len(amounts)), "colour": (30_000, 24_000, 0), "nothing": (30_000, 0, 0)}
        assert abs(found["key"]["distinct"] / len({r[0] for r in rows}) - 1) < 0.05 and found["colour"]["distinct"] == 3 and found["nothing"]["distinct"] == 0
        for q, x in zip((0.25, 0.5, 0.75), found["amount"].quantiles[1:4], strict=True):
            assert abs(sum(a <= x for a in amounts) / len(amounts) - q) < 0.03
        assert (found["amount"].quantiles[0], found["amount"].quantiles[4]) == (amounts[0], amounts[-1]) and found["colour"].quantiles is None
        assert {x["value"]: x.n for x in found["colour"].frequent} == {c: sum(r[2] == c for r in rows) for c in ("red", "blue", "green")} and found["colour"].short == 0
        assert (found["colour"].least, found["colour"].greatest) == ("blue", "red") and len(found["key"].frequent) <= sketches.CANDIDATES and found["key"].short <= 30_000 / sketches.CANDIDATES


def test_frequent_values_survive(spark, monkeypatch):
    monkeypatch.setattr(sketches, "CANDIDATES", 5)
    values = ["often"] * 300 + [f"v{k}" for k in range(400)]
    random.Random(93).shuffle(values)
    parts = [sketches.sketched(spark.createDataFrame([(v,) for v in values[k::4]], "v string"), str(k)) for k in range(4)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    found = sketches.described(sketches.merged(whole)).first()
    often = next(x.n for x in found.frequent if x["value"] == "often")
    assert 300 - found.short <= often <= 300 and found.short <= 700 / 5
