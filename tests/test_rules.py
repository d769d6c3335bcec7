"""Rule semantics on small tables."""

import pytest
from pyspark.sql import functions as F

from txnrules.functions.literals import required
from txnrules.functions.text import register_sql_functions
from txnrules.operators import rules as R


def txn(spark, *rows):
    return spark.createDataFrame([(d, float(a)) for d, a in rows], "description string, amount double")


def one(spark, rules, mode="first", row=("STORE 12", 150)):
    register_sql_functions(spark)
    return R.RuleSet(rules, mode).classify(txn(spark, row)).collect()[0]


GENERAL = R.Rule("General", "has(description, 'STORE')", "General", tags=["retail"])
LARGE = R.Rule("Large", "has(description, 'STORE') AND amount > 100", "Large Purchase", tags=["large"])


def test_overlap_in_both_modes(spark):
    assert one(spark, [GENERAL, LARGE]).category == "General"
    assert one(spark, [GENERAL, LARGE], "specific").category == "Large Purchase"


@pytest.mark.parametrize("mode", ["first", "specific"])
def test_tags_of_all_matching_rules(spark, mode):
    found = one(spark, [GENERAL, LARGE, R.Rule("Dear", "amount > 500", tags=["expensive"])], mode, ("STORE", 600))
    assert found.tags == ["expensive", "large", "retail"]
    assert found.tag_sources == {"expensive": "Dear", "large": "Large", "retail": "General"}


def test_order_matters_for_the_first_match_only(spark):
    uber, eats = R.Rule("Uber", "has(description, 'UBER')", "Transport"), R.Rule("Eats", "has(description, 'UBER EATS')", "Food")
    row = ("UBER EATS 1", 20)
    assert [one(spark, x, "first", row).category for x in ([uber, eats], [eats, uber])] == ["Transport", "Food"]
    assert [one(spark, x, "specific", row).category for x in ([uber, eats], [eats, uber])] == ["Food", "Food"]


def test_let_fields_priority_and_fallback(spark):
    rule = R.Rule("Half", "half > 70", "Big", let={"half": "amount / 2"}, fields={"half": "round(half, 1)"})
    found = one(spark, [rule])
    assert (found.category, found.extra_half, found.match_source) == ("Big", "75.0", "user")
    found = one(spark, [rule], row=("some shop 44 ny", 1))
    assert (found.merchant, found.category, found.subcategory, found.match_source, found.extra_half) == ("Some Shop Ny", "Unknown", "Unknown", "auto", None)
    assert one(spark, [GENERAL, R.Rule("Top", "amount > 0", "Top", priority=90)], "specific").category == "Top"


def test_conditions_that_cannot_be_told_do_not_match(spark):
    rules = [R.Rule("Bad", "try_cast(description AS INT) > 3", "Bad"), GENERAL]
    assert one(spark, rules).category == "General"
    assert one(spark, rules, row=(None, 5)).category == "Unknown"


def test_invalid_rules_are_refused():
    with pytest.raises(ValueError):
        R.Rule("Nothing", "true")


def test_transforms_keep_the_first_original(spark):
    moved = R.transformed(txn(spark, ("SQ * CAFE", 1)), [("description", F.regexp_replace("description", r"^SQ \* ", "")), ("description", F.lower("description"))]).collect()[0]
    assert (moved.description, moved.raw_values) == ("cafe", {"description": "SQ * CAFE"})


def test_empty_input(spark):
    register_sql_functions(spark)
    assert R.RuleSet([GENERAL, LARGE]).classify(txn(spark)).count() == 0


def test_rules_of_one_name_are_told_apart(spark):
    rules = [R.Rule("Stream", "has(description, 'NETFLIX')", "Media", tags=["a"], fields={"x": "'first'"}), R.Rule("Stream", "has(description, 'HULU')", "Media2", tags=["b"], fields={"x": "'second'"})]
    register_sql_functions(spark)
    found = R.RuleSet(rules).classify(txn(spark, ("NETFLIX", 1), ("HULU", 2), ("HULU NETFLIX", 3))).orderBy("amount").collect()
    assert [(r.category, list(r.all_rules), list(r.rule_places), list(r.tags), r.extra_x) for r in found] == [("Media", ["Stream"], [0], ["a"], "first"), ("Media2", ["Stream"], [1], ["b"], "second"), ("Media", ["Stream", "Stream"], [0, 1], ["a", "b"], "first")]


def test_let_names_stay_in_quoted_text(spark):
    rule = R.Rule("Due", "contains(description, 'total due') AND total > 5", "Bills", let={"total": "amount"})
    assert one(spark, [rule], row=("the total due", 7)).category == "Bills"


def test_a_failing_rule_is_skipped(spark):
    broken = ["CAST(description AS INT) > 0", "1 / (amount - amount) > 0", "split(description, ' ')[7] = 'x'", "CAST('x' AS DATE) IS NULL AND false"]
    rules = [R.Rule(f"Broken {k}", when, "Bad") for k, when in enumerate(broken)] + [GENERAL]
    assert one(spark, rules).category == "General"
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    found = one(spark, [R.Rule("Field", "amount > 0", "Some", fields={"bad": "CAST(description AS INT)", "good": "'g'"})])
    assert (found.extra_bad, found.extra_good) == (None, "g")


def test_specificity_counts_names_once():
    assert R.Rule("A", "has(description, 'AB') AND amount > 1 AND amount < 9", "X").specificity() == (50, 1, 1, 2)
    assert R.Rule("B", "anyof(description, 'AB', 'C') AND location = 'NY'", "X", priority=7).specificity() == (7, 1, 0, 5)


def test_rule_table(spark):
    rules = spark.createDataFrame(
        [(0, "shop", "Shop", "Retail", "Any", ["a"], ">", 10.0, None, None, None, None), (1, "shop|bar", None, None, None, ["b"], None, None, None, None, None, None)],
        "ord int, pattern string, merchant string, category string, subcategory string, tags array<string>, amt_op string, amt_lo double, amt_hi double, date_lo date, date_hi date, month int",
    )
    rows = spark.createDataFrame([("SHOP 1", 11.0), ("shop 1", 5.0), ("bar", 1.0), ("none", 1.0), (None, 1.0), ("shop", None), ("SHOP 1", 11.0)], "description string, amount double").withColumn("date", F.lit("2025-01-05").cast("date"))
    matched = R.match_table(rows, rules)
    plan = matched._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    got = sorted((r.description or "", r.amount or 0.0, r.category or "", tuple(r.tags)) for r in matched.collect())
    assert got == sorted([("SHOP 1", 11.0, "Retail", ("a", "b"))] * 2 + [("shop 1", 5.0, "", ("b",)), ("bar", 1.0, "", ("b",)), ("none", 1.0, "", ()), ("", 1.0, "", ()), ("shop", 0.0, "", ("b",))])


@pytest.mark.parametrize(
    "pattern, literals",
    [
        ("netflix", ["netflix"]),
        ("BOLT|Gizmo", ["bolt", "gizmo"]),
        ("^red .*(widget|bo)", ["red "]),
        ("foo(bar)?baz|quux+", ["foo", "quu"]),
        ("é+cafe", ["cafe"]),
        ("(?<name>abcd)e", ["abcde"]),
        (r"AMZN\s*MK(?=TPLACE)", ["tplace"]),
        (r"\p{L}shop", ["shop"]),
        ("ab|cdefg", None),
        (r"^\d+$", None),
        ("a{0,3}bc", None),
        ("(?i)abcdef", None),
        ("[a[bc]def]xyz", None),
        (r"\Qabc\E", None),
        ("(unclosed", None),
        (None, None),
    ],
)
def test_required_literals(pattern, literals):
    assert required(pattern) == literals


def rule_rows(spark, patterns):
    rows = [(k, p, f"M{k}", f"C{k}", None, [f"t{k}"], None, None, None, None, None, None) for k, p in enumerate(patterns)]
    return spark.createDataFrame(rows, "ord int, pattern string, merchant string, category string, subcategory string, tags array<string>, amt_op string, amt_lo double, amt_hi double, date_lo date, date_hi date, month int")


def test_many_rules_match_as_by_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(R, "RULES_AT_ONCE", 3)
    monkeypatch.setattr(R, "ARRAYS_AT_ONCE", 2)
    rng = random.Random(31)
    words = ["NETFLIX", "hulu", "Café", "store 12", "SHOP", "a", "ſtore", "12345", "x-y", "İstanbul", "K9", "BOLT", "", "red widget"]
    texts = sorted({" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(200)})
    parts = ["net", "flix", r"\d+", "hu.u", "caf[eé]", "(store|shop)", "^red", "bolt$", r"\s", "k9", "istan", "(?=x)x-y", "store", "[a-c]", "shop"]
    patterns = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 3))) for _ in range(120)] + ["(", "[", None, "(?P<n>netflix)", r"\Qx-y\E", "*x", "store 12"]
    rules = rule_rows(spark, patterns)
    frame = spark.createDataFrame([(t,) for t in texts], "description string")
    found = R.matching_rules(frame, rules)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    jvm = spark._jvm.java.util.regex.Pattern
    want, bad = set(), set()
    for k, p in enumerate(patterns):
        try:
            compiled = jvm.compile("(?iU)" + p.replace("(?P<", "(?<")) if p is not None else None
        except Exception:  # noqa: BLE001
            compiled = None
        if compiled is None:
            bad.add(k)
        else:
            want |= {(t, k) for t in texts if compiled.matcher(t).find()}
    assert {(r.description, r.ord) for r in found.collect()} == want and len(want) > 100
    assert {r.ord for r in R.rejected_rows(rules).collect()} == bad and len(bad) == 4


def test_rules_are_looked_up_by_the_literal_that_fewest_texts_have(spark):
    texts = spark.createDataFrame([(f"Customer#{k:09d}",) for k in range(1, 3000)], "description string")
    patterns = [rf"customer\S0*{k}\b" for k in range(1000, 1400)] + [rf"^customer#{k:09d}$" for k in range(200)] + ["^customer"]
    known = rule_rows(spark, patterns).select("ord", F.col("pattern").alias("java")).withColumn("choices", R._choices("java"))
    n = {r.ord: r.n for r in R._least(texts, known).collect()}
    assert max(n[k] for k in range(600)) < 30 and n[600] == 2999
    found = {(r.description, r.ord) for r in R.matching_rules(texts, rule_rows(spark, patterns)).collect()}
    exact = {(f"Customer#{1000 + k:09d}", k) for k in range(400)} | {(f"Customer#{k:09d}", 400 + k) for k in range(1, 200)}
    assert found == exact | {(f"Customer#{k:09d}", 600) for k in range(1, 3000)}


def test_an_invalid_pattern_is_left_out(spark):
    rows = spark.createDataFrame([("SHOP 1", 11.0), ("bar", 1.0), (None, 2.0)], "description string, amount double").withColumn("date", F.lit("2025-01-05").cast("date"))
    got = R.match_table(rows, rule_rows(spark, ["(", "shop", "[z"])).collect()
    assert sorted((r.description or "", r.category, tuple(r.tags)) for r in got) == [("", None, ()), ("SHOP 1", "C1", ("t1",)), ("bar", None, ())]


@pytest.mark.parametrize("mode", ["first", "specific"])
def test_rules_that_cannot_be_used_are_left_out_alone(spark, mode):
    bad = [
        R.Rule("Unknown column", "nothing_such = 'x'", "Bad", tags=["bad"]),
        R.Rule("Bad pattern", "finds(description, 'STORE(')", "Bad"),
        R.Rule("Bad infix pattern", "description RLIKE '[a'", "Bad"),
        R.Rule("No SQL", "amount >", "Bad"),
        R.Rule("Wrong type", "amount + 1", "Bad"),
        R.Rule("Bad tag", "amount > 0", tags=["{missing}"]),
        R.Rule("Bad field", "amount > 0", "Bad", fields={"x": "missing + 1"}),
    ]
    register_sql_functions(spark)
    rules = R.RuleSet([*bad, GENERAL, R.Rule("Java only", r"finds(description, '\\p{Alpha}+')", tags=["word"])], mode)
    df = txn(spark, ("STORE 12", 150))
    found = rules.classify(df).collect()[0]
    assert (found.category, list(found.tags), list(found.all_rules)) == ("General", ["retail", "word"], ["General", "Java only"])
    assert sorted(rules.left_out(df)) == list(range(7)) and set(rules.audit(df)["left_out"]) == {r.name for r in bad}
    assert R.RuleSet([GENERAL]).left_out(df) == {} and R.RuleSet(bad[:1]).classify(df).first().category == "Unknown"


def test_audit_names_what_rules_use():
    rules = R.RuleSet([GENERAL, R.Rule("Paid", "orders_n > 0 AND x > 1", "P", let={"x": "amount"}, fields={"f": "'orders_n'"})])
    told = rules.audit(sources=("orders_n",))
    assert (told["of_other_sources"], told["with_let"], told["with_fields"], told["left_out"]) == (["Paid"], ["Paid"], ["Paid"], {})
