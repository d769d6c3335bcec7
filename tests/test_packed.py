"""Hits as bits give what a column per rule gives."""

import random

import pytest
from pyspark.sql import functions as F

from txnrules.functions.text import register_sql_functions
from txnrules.operators import packed
from txnrules.operators import rules as R

WORDS = ["red", "bolt", "anvil", "widget", "gizmo", "café"]


def rule_set(n, mode, seed=1):
    rng = random.Random(seed)
    made = []
    for k in range(n):
        tags = rng.choice([[], ["Big "], ["x", "y"], ["{description}", "z"], ["[split(description, ' ')]"]])
        when = rng.choice(["has(description, '{}')", "begins(description, '{}')", "amount > {n}", "has(description, '{}') AND amount < {n}", "finds(description, '{}.*t')", "CAST(description AS INT) > {n}", "nothing = '{}'"])
        category = None if tags and rng.random() < 0.3 else f"C{k}"
        made.append(R.Rule(f"R{k % (n - 3)}", when.replace("{}", rng.choice(WORDS)).replace("{n}", str(rng.randrange(100))), category, rng.choice([None, f"S{k}"]), rng.choice([None, f"M{k}"]), tags, rng.choice([50, 50, 70]), {}, {"f": "upper(description)"} if rng.random() < 0.1 else {}))
    return R.RuleSet(made, mode)


def frame(spark, n=120):
    rng = random.Random(2)
    register_sql_functions(spark)
    return spark.createDataFrame([(k, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 4))) or None, float(rng.randrange(120))) for k in range(n)], "id int, description string, amount double")


@pytest.mark.parametrize("n, mode", [(7, "first"), (70, "first"), (70, "specific")])
def test_equal_to_a_column_per_rule(spark, n, mode):
    rules, df = rule_set(n, mode), frame(spark)
    a, b = rules.classify(df), packed.classify(df, rules)
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda d: sorted(repr([r[c] if c != "tag_sources" else sorted((r[c] or {}).items()) for c in sorted(a.columns)]) for r in d.collect())
    assert rows(a) == rows(b)


def test_usage_and_pairs(spark):
    rules = R.RuleSet([R.Rule("Tag", "amount >= 0", tags=["t"]), R.Rule("Red", "has(description, 'red')", "A"), R.Rule("Red bolt", "has(description, 'red') AND has(description, 'bolt')", "B"), R.Rule("Bolt", "has(description, 'bolt')", "C"), R.Rule("Never", "amount < 0", "D")])
    df = frame(spark)
    told = {r.rule: (r.ever, r.first, r.shadowed) for r in packed.usage(df, rules).collect()}
    assert told == {"Tag": (True, False, False), "Red": (True, True, False), "Red bolt": (True, False, True), "Bolt": (True, True, False), "Never": (False, False, False)}
    both = df.filter("description LIKE '%red%' AND description LIKE '%bolt%'").count()
    pairs = {(r.a, r.b): r.n for r in packed.together(df, rules).collect()}
    assert pairs[1, 2] == pairs[2, 3] == pairs[1, 3] == both and (0, 4) not in pairs
    assert {r.ever for r in packed.usage(df.limit(0), rules).collect()} == {False}


def test_five_thousand_rules(spark):
    rules = R.RuleSet([R.Rule(f"R{k}", f"description = 'D{k}' OR amount = {k}.5", f"C{k}", tags=[f"t{k % 7}"]) for k in range(5000)] + [R.Rule("Again", "description = 'D4999'", "Late")])
    df = spark.createDataFrame([("D4999", 3.5), ("D62", 63.5), ("x", 1.0)], "description string, amount double")
    found = packed.classify(df, rules).select("description", "category", "matched_rule", F.col("rule_places").alias("p"), "tags").collect()
    assert sorted((r.description, r.category, r.matched_rule, list(r.p), list(r.tags)) for r in found) == [("D4999", "C3", "R3", [3, 4999, 5000], ["t1", "t3"]), ("D62", "C62", "R62", [62, 63], ["t0", "t6"]), ("x", "Unknown", None, [], [])]
    assert [r.rule for r in packed.usage(df, rules).filter("shadowed").collect()] == ["R63", "R4999", "Again"]
