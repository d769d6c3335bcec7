"""Queries for conditions (P*), rules (R*) and ready fields of the rule language."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrules.functions import text as X
from txnrules.functions import values as V
from txnrules.functions.similarity import with_similarity
from txnrules.operators import packed
from txnrules.operators import rules as R
from txnrules.plans import tables
from txnrules.plans.registry import register
from txnrules.plans.tables import CLASSIFIED_SQL, FALLBACK_SQL, HITS, OTXN_SQL, RULES, TXN_SQL, case_sql


def counted(name: str, condition, sql: str | None) -> None:
    """A condition on all transactions: by source, the rows it keeps and their total."""

    def query(spark, sf_dir):
        kept = tables.txn(spark, sf_dir).filter(V.holds(condition()))
        return kept.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))

    oracle = f"WITH {TXN_SQL} SELECT source, count(*) AS n, round(sum(amount), 2) AS total FROM txn WHERE {sql} GROUP BY source" if sql else None
    register(name, oracle)(query)


c = F.col
counted("p01_contains", lambda: X.contains("widget") & X.contains(c("location"), "tion_1"), "contains(description, 'WIDGET') AND contains(upper(location), 'TION_1')")
counted("p02_regex", lambda: X.matches(r"^(red|cold)\s+\w+t\b"), r"regexp_matches(description, '^(RED|COLD)\s+\w+T\b')")
counted("p02_regex_lookahead", lambda: X.matches(r"^red (?!widget)"), "starts_with(description, 'RED ') AND NOT starts_with(description, 'RED WIDGET')")
counted("p03_normalized", lambda: X.normalized("cold-bolt"), r"contains(regexp_replace(description, '[\s\-''.*]+', '', 'g'), 'COLDBOLT')")
counted("p04_anyof", lambda: X.anyof("widget", "anvil"), "contains(description, 'WIDGET') OR contains(description, 'ANVIL')")
counted("p05_startswith", lambda: X.startswith("red") | X.startswith(c("location"), "nation_2"), "starts_with(description, 'RED') OR starts_with(upper(location), 'NATION_2')")
counted("p07_exists", lambda: X.filled(c("field")["priority"]) & ~X.filled(c("field")["missing"]), "trim(priority) <> ''")
counted("p08_equal_text", lambda: X.same(c("location"), "nation_3") | (c("source") != "F"), "lower(location) = 'nation_3' OR source <> 'F'")
counted("p09_compare", lambda: V.chain(F.lit(1000), F.abs("amount"), F.lit(5000)) | (c("amount") >= 90000), "(1000 < abs(amount) AND abs(amount) < 5000) OR amount >= 90000")
counted("p10_in", lambda: X.within("bolt", c("description")) & ~c("source").isin("X") & X.has_tag(F.split(F.lower(c("field")["segment"]), " "), "MACHINERY"), "contains(description, 'BOLT') AND source NOT IN ('X') AND segment = 'MACHINERY'")
counted("p11_date_text", lambda: (c("date") >= "1996-02-01") & (c("date") < "1997-01-01"), "date >= DATE '1996-02-01' AND date < DATE '1997-01-01'")
counted("p12_logic", lambda: (X.contains("red") | X.contains("cold")) & ~(c("amount") > 100) | V.holds(c("field")["missing"] == "x"), "(contains(description, 'RED') OR contains(description, 'COLD')) AND NOT amount > 100")
counted(
    "p13_arithmetic",
    lambda: (V.remainder(F.floor("amount"), F.lit(-7)) > -3) & (V.quotient(c("amount"), F.floor("amount") - F.floor("amount")) == 0) & (F.concat("source", F.lit("x")) == "Fx"),
    "floor(amount) - (-7) * floor(floor(amount) / -7) > -3 AND source || 'x' = 'Fx'",
)
counted("p14_ternary", lambda: F.when(c("amount") < 0, c("source") == "F").otherwise(c("amount") > 50000), "CASE WHEN amount < 0 THEN source = 'F' ELSE amount > 50000 END")
counted("p15_literals", lambda: F.lit(True) & ~F.lit(False) & (c("amount") > 10.5) & (c("source") == "O"), "amount > 10.5 AND source = 'O'")
counted(
    "p16_names",
    lambda: (V.date_part("month", c("date")) == 3) & (V.date_part("year", c("date")) > 1995) & (V.date_part("day", c("date")) < 20) & (V.date_part("weekday", c("date")) < 5) & (V.date_part("day", F.lit(None).cast("date")) == 0),
    "month(date) = 3 AND year(date) > 1995 AND day(date) < 20 AND isodow(date) < 6",
)
counted("p18_field", lambda: (c("field")["priority"] == "1-URGENT") & c("field")["none"].isNull(), "priority = '1-URGENT'")
counted(
    "p19_amount_modifiers",
    lambda: V.amount_condition(c("amount"), "range", 100, 900) | V.amount_condition(c("amount"), ">=", 80000) | V.amount_condition(c("amount"), "=", -5000),
    "amount BETWEEN 100 AND 900 OR amount >= 80000 OR abs(amount + 5000) < 0.01",
)
counted(
    "p20_date_modifiers",
    lambda: V.date_condition(c("date"), first="1996-01-01", last="1996-03-31") | V.date_condition(c("date"), on="1997-05-05") | V.date_condition(c("date"), month=12) | V.date_condition(c("date"), last_days=200, as_of="2001-12-31"),
    "date BETWEEN DATE '1996-01-01' AND DATE '1996-03-31' OR date = DATE '1997-05-05' OR month(date) = 12 OR date >= DATE '2001-12-31' - 200",
)
counted("p21_all_modifiers", lambda: V.amount_condition(c("amount"), "<", 0) & V.date_condition(c("date"), month=7) & V.date_condition(F.lit(None).cast("date"), month=7).eqNullSafe(False), "amount < 0 AND month(date) = 7")


@register("p17_txn_reference", f"WITH {TXN_SQL} SELECT source, count(*) AS n, round(sum(amount), 2) AS total FROM txn WHERE location = 'NATION_4' AND amount > 0 GROUP BY source")
def p17(spark, sf_dir):
    """Columns by the name of their table."""
    kept = tables.txn(spark, sf_dir).alias("txn").filter((F.col("txn.location") == "NATION_4") & (F.col("txn.amount") > 0))
    return kept.groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@register("p06_fuzzy")
def p06(spark, sf_dir):
    """Names similar to a misspelt one; the ratio has no SQL form."""
    told = with_similarity(tables.txn(spark, sf_dir), "cold bolts", "ratio", "name", 0.8)
    return told.filter("ratio > 0").groupBy("name").agg(F.count("*").alias("n"), F.round(F.max("ratio"), 4).alias("ratio"))


TOTALS = "count(*) AS n, round(sum(amount), 2) AS total"


def totals(df, *keys):
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@register("r01_first_match", f"WITH {CLASSIFIED_SQL} SELECT category, subcategory, merchant, coalesce(matched_rule, 'none') AS rule, {TOTALS} FROM cls GROUP BY ALL")
def r01(spark, sf_dir):
    return totals(tables.classified(spark, sf_dir).withColumn("rule", F.coalesce("matched_rule", F.lit("none"))), "category", "subcategory", "merchant", "rule")


_RANKED = R.RuleSet(RULES, "specific").by_specificity()
_SPECIFIC = f"""WITH {TXN_SQL}, s AS (
    SELECT amount, {case_sql([(HITS[r.name], f"'{r.category}'") for r in _RANKED if r.category], "'Unknown'")} AS category,
           {case_sql([(HITS[r.name], f"'{r.subcategory}'") for r in _RANKED if r.subcategory], "'Unknown'")} AS subcategory,
           {case_sql([(HITS[r.name], f"'{r.merchant or r.name}'") for r in _RANKED], FALLBACK_SQL)} AS merchant FROM txn)
SELECT category, subcategory, merchant, {TOTALS} FROM s GROUP BY ALL"""


@register("r02_most_specific", _SPECIFIC)
def r02(spark, sf_dir):
    return totals(tables.classified(spark, sf_dir, "specific"), "category", "subcategory", "merchant")


@register("r04_tags", f"WITH {CLASSIFIED_SQL} SELECT array_to_string(tags, '|') AS tags, {TOTALS} FROM cls GROUP BY ALL")
def r04(spark, sf_dir):
    return totals(tables.classified(spark, sf_dir).withColumn("tags", F.array_join("tags", "|")), "tags")


@register("r05_dynamic_tags", f"WITH {TXN_SQL}, t AS (SELECT amount, unnest(list_distinct([lower(segment), lower(priority), 'big'])) AS tag FROM txn WHERE amount > 60000) SELECT tag, {TOTALS} FROM t GROUP BY tag")
def r05(spark, sf_dir):
    rule = R.Rule("Big", "amount > 60000", tags=["{field['segment']}", "[array(field['priority'], ' ', NULL)]", " BIG "])
    found = R.RuleSet([rule]).classify(tables.txn(spark, sf_dir))
    return totals(found.withColumn("tag", F.explode("tags")), "tag")


@register(
    "r06_tag_sources",
    f"""WITH {CLASSIFIED_SQL}, t AS (SELECT amount, {case_sql([(HITS['Widgets'], "'Widgets'"), (HITS['Cold bolts'], "'Cold bolts'")])} AS rule FROM cls WHERE list_contains(tags, 'tools'))
    SELECT rule, {TOTALS} FROM t GROUP BY rule""",
)
def r06(spark, sf_dir):
    found = tables.classified(spark, sf_dir).filter(F.array_contains("tags", "tools"))
    return totals(found.withColumn("rule", F.col("tag_sources")["tools"]), "rule")


@register("r07_let", f"WITH {TXN_SQL} SELECT CASE WHEN abs(amount) / 12 + abs(amount) / 100 > 3000 THEN 'dear' WHEN contains(description, 'RED') THEN 'the red size' ELSE 'Unknown' END AS category, {TOTALS} FROM txn GROUP BY ALL")
def r07(spark, sf_dir):
    """Names see earlier ones; quoted text keeps words that are names too."""
    names = {"size": "abs(amount)", "monthly": "size / 12", "fee": "size / 100", "red": "'RED'"}
    rules = [R.Rule("Dear", "monthly + fee > 3000", "dear", let=names), R.Rule("Red", "contains(description, red) AND 'monthly fee' = concat('monthly', ' fee')", "the red size", let=names)]
    return totals(R.RuleSet(rules).classify(tables.txn(spark, sf_dir)), "category")


@register("r08_variables", f"WITH {TXN_SQL} SELECT CASE WHEN amount > 30000 AND month(date) = 12 THEN 'gift' ELSE 'Unknown' END AS category, {TOTALS} FROM txn GROUP BY ALL")
def r08(spark, sf_dir):
    rules = R.RuleSet([R.Rule("Gift", "large_one AND december", "gift")], variables={"large_one": "amount > 30000", "december": "month(date) = 12"})
    return totals(rules.classify(tables.txn(spark, sf_dir)), "category")


@register("r09_extra_fields", f"WITH {TXN_SQL} SELECT CASE WHEN contains(description, 'RED') THEN lower(type) END AS extra_kind, CASE WHEN contains(description, 'RED') THEN 'r' END AS extra_code, {TOTALS} FROM txn GROUP BY ALL")
def r09(spark, sf_dir):
    rule = R.Rule("Red", "contains(description, 'RED')", "Colours", fields={"kind": "lower(field['type'])", "code": "'r'"})
    return totals(R.RuleSet([rule]).classify(tables.txn(spark, sf_dir)), "extra_kind", "extra_code")


@register("r10_transforms", f"WITH {TXN_SQL} SELECT regexp_replace(replace(description, 'BRAND#', ''), '[0-9]+', '', 'g') AS description, max(description) AS raw, {TOTALS} FROM txn GROUP BY 1")
def r10(spark, sf_dir):
    moved = R.transformed(tables.txn(spark, sf_dir), [("description", X.replace_all("description", "brand#", "")), ("description", F.regexp_replace("description", "[0-9]+", ""))])
    return moved.groupBy("description").agg(F.max(F.col("raw_values")["description"]).alias("raw"), F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@register("r11_tag_only", f"WITH {TXN_SQL} SELECT array_to_string(list_sort(flatten([CASE WHEN {HITS['Large']} THEN ['large'] ELSE [] END, CASE WHEN {HITS['Income']} THEN ['income'] ELSE [] END])), '|') AS tags, {TOTALS} FROM txn GROUP BY ALL")
def r11(spark, sf_dir):
    X.register_sql_functions(spark)
    found = R.RuleSet([r for r in RULES if not r.category]).classify(tables.txn(spark, sf_dir))
    return totals(found.withColumn("tags", F.array_join("tags", "|")), "tags")


@register("r12_fallback", f"WITH {CLASSIFIED_SQL} SELECT merchant, subcategory, array_to_string(tags, '|') AS tags, {TOTALS} FROM cls WHERE category = 'Unknown' GROUP BY ALL")
def r12(spark, sf_dir):
    found = tables.classified(spark, sf_dir).filter("category = 'Unknown'")
    return totals(found.withColumn("tags", F.array_join("tags", "|")), "merchant", "subcategory", "tags")


@register("r13_match_info", f"WITH {CLASSIFIED_SQL} SELECT CASE WHEN matched_rule IS NULL THEN 'auto' ELSE 'user' END AS match_source, matched_rule, {TOTALS} FROM cls GROUP BY ALL")
def r13(spark, sf_dir):
    return totals(tables.classified(spark, sf_dir), "match_source", "matched_rule")


_ANY = " UNION ALL ".join(f"SELECT {k} AS ord, '{r.name}' AS rule, count(*) AS n FROM txn WHERE {HITS[r.name]}" for k, r in enumerate(RULES))


@register("r14_all_matches", f"WITH {TXN_SQL} {_ANY}")
def r14(spark, sf_dir):
    return R.rule_hits(tables.classified(spark, sf_dir), R.RuleSet(RULES))


def _rule_rows(spark):
    rows = [
        (0, "^red .*(widget|bolt)", "Paint House", "Colours", "Red", ["red"], ">", 1000.0, None, None, None, None),
        (1, "anvil", "Anvil Works", "Heavy", "Anvils", ["heavy", "iron"], "range", 100.0, 40000.0, None, None, None),
        (2, "widget", None, None, None, ["tools"], None, None, None, "1996-01-01", "1996-12-31", None),
        (3, "bolt|gizmo", "Bolt Co", "Fasteners", "Any", [], None, None, None, None, None, 6),
    ]
    made = spark.createDataFrame(rows, "ord int, pattern string, merchant string, category string, subcategory string, tags array<string>, amt_op string, amt_lo double, amt_hi double, date_lo string, date_hi string, month int")
    return made.withColumns({"date_lo": F.to_date("date_lo"), "date_hi": F.to_date("date_hi")})


_R0, _R1 = "regexp_matches(description, '^RED .*(WIDGET|BOLT)') AND amount > 1000", "contains(description, 'ANVIL') AND amount BETWEEN 100 AND 40000"
_R2, _R3 = "contains(description, 'WIDGET') AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'", "regexp_matches(description, 'BOLT|GIZMO') AND month(date) = 6"


@register(
    "r16_rule_table",
    f"""WITH {TXN_SQL} SELECT CASE WHEN {_R0} THEN 'Colours' WHEN {_R1} THEN 'Heavy' WHEN {_R3} THEN 'Fasteners' END AS category,
    array_to_string(list_sort(flatten([CASE WHEN {_R0} THEN ['red'] ELSE [] END, CASE WHEN {_R1} THEN ['heavy', 'iron'] ELSE [] END, CASE WHEN {_R2} THEN ['tools'] ELSE [] END])), '|') AS tags,
    {TOTALS} FROM txn GROUP BY ALL""",
)
def r16(spark, sf_dir):
    found = R.match_table(tables.txn(spark, sf_dir).select("description", "amount", "date"), _rule_rows(spark))
    return totals(found.withColumn("tags", F.array_join("tags", "|")), "category", "tags")


@register(
    "r17_rule_row",
    f"WITH {TXN_SQL} SELECT source, {TOTALS} FROM txn WHERE {_R1} AND month(date) = 6 GROUP BY source",
)
def r17(spark, sf_dir):
    """One rule row as a condition: pattern, amount range and month together."""
    row = {"pattern": "anvil", "amt_op": "range", "amt_lo": 100.0, "amt_hi": 40000.0, "month": 6}
    return totals(tables.txn(spark, sf_dir).filter(R.row_condition(row)), "source")


@register(
    "r18_explain",
    f"WITH {CLASSIFIED_SQL} SELECT description AS original, {case_sql([(HITS[r.name], f'{chr(39)}{r.name}{chr(39)}') for r in RULES])} AS first_rule, matched_rule, matched_rule IS NULL AS unknown, count(*) AS n FROM cls GROUP BY ALL",
)
def r18(spark, sf_dir):
    told = R.explain(tables.classified(spark, sf_dir))
    return told.groupBy("original", "first_rule", "matched_rule", "unknown").agg(F.count("*").alias("n"))


_BROKEN = {
    "Cast": "CAST(description AS INT) > 0",
    "Zero": "amount / (amount - amount) > 0",
    "Index": "split(description, ' ')[99] = 'x'",
    "Element": "element_at(array(1, 2), 9) = 1",
    "Date": "to_date(description) > DATE '1990-01-01'",
    "Missing field": "field['none'] = 'x'",
    "Unknown column": "no_such_column = 'x'",
    "Invalid pattern": "finds(description, 'RED(')",
}


def _broken_rules():
    return R.RuleSet([R.Rule(name, when, "bad") for name, when in _BROKEN.items()] + [R.Rule("Red", "contains(description, 'RED')", "ok", let={"x": "amount"}, fields={"size": "x"})])


@register("r19_failing_rule", f"WITH {TXN_SQL} SELECT CASE WHEN contains(description, 'RED') THEN 'ok' ELSE 'Unknown' END AS category, {TOTALS} FROM txn GROUP BY ALL")
def r19(spark, sf_dir):
    """Conditions that would raise an error, can't be told or can't be analysed match nothing, and later rules go on."""
    X.register_sql_functions(spark)
    return totals(_broken_rules().classify(tables.txn(spark, sf_dir)), "category")


@register(
    "r01_same_name",
    f"""WITH {TXN_SQL}, s AS (SELECT amount, CASE WHEN contains(description, 'WIDGET') THEN 'Metal' WHEN contains(description, 'ANVIL') THEN 'Stone' ELSE 'Unknown' END AS category,
        CASE WHEN contains(description, 'WIDGET') OR contains(description, 'ANVIL') THEN 'Maker' END AS rule, contains(description, 'WIDGET')::INT + contains(description, 'ANVIL')::INT AS hits FROM txn)
    SELECT category, rule, hits, {TOTALS} FROM s GROUP BY ALL""",
)
def r01b(spark, sf_dir):
    """Two rules of one name are two rules."""
    rules = [R.Rule("Maker", "contains(description, 'WIDGET')", "Metal"), R.Rule("Maker", "contains(description, 'ANVIL')", "Stone")]
    found = R.RuleSet(rules).classify(tables.txn(spark, sf_dir))
    return totals(found.select("amount", "category", F.col("matched_rule").alias("rule"), F.size("all_rules").alias("hits")), "category", "rule", "hits")


@register("r14_same_name", f"WITH {TXN_SQL} SELECT 0 AS ord, 'Maker' AS rule, count(*) AS n FROM txn WHERE contains(description, 'WIDGET') UNION ALL SELECT 1, 'Maker', count(*) FROM txn WHERE contains(description, 'ANVIL')")
def r14b(spark, sf_dir):
    rules = R.RuleSet([R.Rule("Maker", "contains(description, 'WIDGET')", "Metal"), R.Rule("Maker", "contains(description, 'ANVIL')", "Stone")])
    return R.rule_hits(rules.classify(tables.txn(spark, sf_dir)), rules)


@register("r20_audit", f"WITH {TXN_SQL}, h AS ({_ANY}) SELECT ord, rule, n, n = 0 AS never_hit, rule IN ('Widgets', 'Cold bolts', 'Gizmos', 'Large', 'Income', 'Anvils') AS with_tags, rule IN ('Large', 'Income') AS tag_only, rule IN ('Gizmos', 'Income', 'Anvils') AS special FROM h")
def r20(spark, sf_dir):
    """Audit of the rule set: what each rule has, and how often it hits in the data."""
    rules = R.RuleSet(RULES)
    told = rules.audit()
    special = [r.name for r in RULES if set(told["special_tags"]) & {t.lower() for t in r.tags}]
    hits = R.rule_hits(tables.classified(spark, sf_dir), rules)
    named = lambda names: c("rule").isin(*names)
    return hits.select("ord", "rule", "n", (c("n") == 0).alias("never_hit"), named([r.name for r in RULES if r.tags]).alias("with_tags"), named(told["tag_only"]).alias("tag_only"), named(special).alias("special"))


@register(
    "r20_left_out",
    f"""WITH {TXN_SQL}, r AS (SELECT unnest([{", ".join(f"'{n}'" for n in [*_BROKEN, "Red"])}]) AS rule)
    SELECT rule, CASE WHEN rule = 'Red' THEN (SELECT count(*) FROM txn WHERE contains(description, 'RED')) ELSE 0 END AS n, rule IN ('Unknown column', 'Invalid pattern') AS left_out,
           rule = 'Missing field' AS of_other_source, rule = 'Red' AS with_let, rule = 'Red' AS with_fields FROM r""",
)
def r20_left_out(spark, sf_dir):
    """Audit: rules that can't be used on the data, rules that use another source's columns, and hits."""
    X.register_sql_functions(spark)
    rules, df = _broken_rules(), tables.txn(spark, sf_dir)
    told = rules.audit(df, sources=("field",))
    named = lambda names: c("rule").isin(*names)
    flags = {"left_out": told["left_out"], "of_other_source": told["of_other_sources"], "with_let": told["with_let"], "with_fields": told["with_fields"]}
    return R.rule_hits(rules.classify(df), rules).select("rule", "n", *[named(names).alias(k) for k, names in flags.items()])


def _customer_rules(spark, sf_dir):
    """A rule for every customer, of three forms: the name, its number without zeros, no literal at all; every hundredth is no valid pattern."""
    key, name = c("c_custkey"), c("c_name")
    pattern = (
        F.when(key % 100 == 0, F.concat(F.lit("("), name))
        .when(key % 50 == 1, F.concat(F.lit(r"^\w{8}#0*"), key.cast("string"), F.lit("$")))
        .when(key % 2 == 0, F.concat(F.lit("^"), F.lower(name), F.lit("$")))
        .otherwise(F.concat(F.lit(r"customer\S0*"), key.cast("string"), F.lit(r"\b")))
    )
    none = lambda kind: F.lit(None).cast(kind)
    return tables.table(spark, sf_dir, "customer").select(
        key.cast("int").alias("ord"),
        pattern.alias("pattern"),
        name.alias("merchant"),
        c("c_mktsegment").alias("category"),
        F.lit("one").alias("subcategory"),
        F.array(F.lower("c_mktsegment")).alias("tags"),
        F.when(key % 3 == 0, ">").alias("amt_op"),
        F.when(key % 3 == 0, 100000.0).alias("amt_lo"),
        none("double").alias("amt_hi"),
        none("date").alias("date_lo"),
        none("date").alias("date_hi"),
        none("int").alias("month"),
    )


@register(
    "r16_many_rules",
    f"""WITH {OTXN_SQL}, m AS (SELECT otxn.amount, c_custkey % 100 <> 0 AND (c_custkey % 3 <> 0 OR otxn.amount > 100000) AS hit, c_mktsegment, c_name FROM otxn JOIN customer ON description = c_name)
    SELECT CASE WHEN hit THEN c_mktsegment END AS category, CASE WHEN hit THEN lower(c_mktsegment) ELSE '' END AS tags, count(DISTINCT CASE WHEN hit THEN c_name END) AS merchants, {TOTALS} FROM m GROUP BY ALL""",
)
def r16_many(spark, sf_dir):
    """As many rules as there are customers, on the orders' customers; literals lead to the rules."""
    found = R.match_table(tables.otxn(spark, sf_dir).select("description", "amount", "date"), _customer_rules(spark, sf_dir))
    tagged = found.withColumn("tags", F.array_join("tags", "|"))
    return tagged.groupBy("category", "tags").agg(F.countDistinct("merchant").alias("merchants"), F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@register("r16_rejected_rules", "SELECT c_custkey::INT AS ord, '(' || c_name AS pattern, 'invalid pattern' AS reason FROM customer WHERE c_custkey % 100 = 0")
def r16_rejected(spark, sf_dir):
    return R.rejected_rows(_customer_rules(spark, sf_dir))


@register("r01_packed_hits", f"WITH {CLASSIFIED_SQL} SELECT category, subcategory, merchant, coalesce(matched_rule, 'none') AS rule, array_to_string(tags, '|') AS tags, {TOTALS} FROM cls GROUP BY ALL")
def r01_packed(spark, sf_dir):
    """The same rules with hits as bits."""
    X.register_sql_functions(spark)
    found = packed.classify(tables.txn(spark, sf_dir), R.RuleSet(RULES))
    return totals(found.withColumns({"rule": F.coalesce("matched_rule", F.lit("none")), "tags": F.array_join("tags", "|")}), "category", "subcategory", "merchant", "rule", "tags")


_BRANDS = [R.Rule(f"Brand {k}", f"description LIKE '%BRAND#{k}'", f"Brand {k}", tags=[f"b{k % 5}"]) for k in range(200)] + [R.Rule("Thirteen again", "has(description, 'BRAND#13')", "Late"), R.Rule("Any", "amount > 0", "Any")]


@register(
    "r20_shadowed",
    f"""WITH {TXN_SQL}, b AS (SELECT regexp_extract(description, 'BRAND#(.*)$', 1)::INT AS k, amount FROM txn), r AS (SELECT unnest(range(202))::INT AS ord)
    SELECT ord, CASE WHEN ord < 200 THEN ord IN (SELECT k FROM b) WHEN ord = 200 THEN 13 IN (SELECT k FROM b) ELSE (SELECT count(*) > 0 FROM b WHERE amount > 0) END AS ever,
           CASE WHEN ord < 200 THEN false WHEN ord = 200 THEN 13 IN (SELECT k FROM b) ELSE (SELECT count(*) > 0 FROM b WHERE amount > 0) AND NOT EXISTS (SELECT 1 FROM b WHERE amount > 0 AND k >= 200) END AS shadowed FROM r""",
)
def r20_shadowed(spark, sf_dir):
    """Rules that hit but never come first, from bits OR-ed over all rows."""
    X.register_sql_functions(spark)
    return packed.usage(tables.txn(spark, sf_dir), R.RuleSet(_BRANDS)).select("ord", "ever", "shadowed")
