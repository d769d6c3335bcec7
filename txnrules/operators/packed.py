"""Rule sets of thousands of rules: hits as bits.

A row's hits are an array of words of 63 bits, a bit per rule, instead of a column and an array entry per rule. Conditions must be SQL texts; 63 of them make one
expression. What rules give (names, categories, tags) are constant arrays looked up by place, so the plan grows by a condition a rule and nothing else. `classify` gives
the columns that `RuleSet.classify` gives. Rules that can't be used are left out, as there.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrules.functions.text import fallback_merchant
from txnrules.operators.rules import Rule, RuleSet, _entries, _no_entries, lenient

BITS = 63
HITS = "_hits"
GENERATED = 2 * BITS  # conditions that are compiled


def words_of(places: list[int], rules: int) -> list[int]:
    """A mask of these places."""
    words = [0] * -(-max(rules, 1) // BITS)
    for k in places:
        words[k // BITS] |= 1 << k % BITS
    return words


def _constant(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def hits(conditions: list[str]) -> Column:
    """The words of a row; a condition that can't be told is no hit."""
    words = []
    for start in range(0, max(len(conditions), 1), BITS):
        bits = [f"(CASE WHEN ({text}) THEN {1 << k}L ELSE 0L END)" for k, text in enumerate(conditions[start : start + BITS])]
        words.append(_either(bits))
    array = f"array({', '.join(words)})"
    # Inside a lambda Spark evaluates expressions as they are; as generated code, that many conditions grow beyond what a method may hold.
    return F.expr(array if len(conditions) <= GENERATED else f"transform(array(0), _once_ -> {array})[0]")


def _either(bits: list[str]) -> str:
    """OR of the bits as a tree that is as deep as it has to be."""
    if len(bits) < 2:
        return bits[0] if bits else "0L"
    middle = len(bits) // 2
    return f"({_either(bits[:middle])} | {_either(bits[middle:])})"


def first_place(words: Column, mask: list[int]) -> Column:
    """The least place that is in the words and in the mask; null if there is none."""
    both = F.zip_with(words, _constant(mask, "array<bigint>"), lambda x, m: x.bitwiseAND(m))
    places = F.transform(both, lambda x, w: F.when(x != 0, w * BITS + F.bit_count(x.bitwiseAND(-x) - 1)))
    return F.array_min(places).cast("int")  # nulls don't count


def all_places(words: Column) -> Column:
    """All places in the words, ascending; only words with a hit are looked into."""
    some = F.filter(F.transform(words, lambda x, w: F.struct(x.alias("x"), w.alias("w"))), lambda s: s["x"] != 0)
    bits = F.sequence(F.lit(0), F.lit(BITS - 1))
    return F.flatten(F.transform(some, lambda s: F.transform(F.filter(bits, lambda b: F.call_function("shiftright", s["x"], b).bitwiseAND(1) == 1), lambda b: s["w"] * BITS + b)))


def with_hits(df: DataFrame, rules: RuleSet, without: dict[int, str] | None = None) -> DataFrame:
    """df with the words of the rules in the order of the set (place k is bit k % 63 of word k // 63), as the column HITS."""
    if any(isinstance(r.when, Column) for r in rules.rules):
        raise ValueError("conditions must be SQL texts")
    with lenient(df.sparkSession):
        df = df.withColumns({n: F.expr(v) for n, v in rules.variables.items()})
        without = rules._left_out(df) if without is None else without
        return df.withColumn(HITS, hits(["false" if k in without else r.bound(r.when) for k, r in enumerate(rules.rules)]))


def classify(df: DataFrame, rules: RuleSet) -> DataFrame:
    """As `RuleSet.classify`."""
    without = rules.left_out(df)
    with lenient(df.sparkSession):
        return _classified(with_hits(df, rules, without), rules, without)


def _classified(df: DataFrame, rules: RuleSet, without: dict[int, str]) -> DataFrame:
    own, places = rules.rules, range(len(rules.rules))
    order = list(places) if rules.mode == "first" else sorted(places, key=lambda k: own[k].specificity(), reverse=True)
    rank = {k: i for i, k in enumerate(order)}
    count = len(own)

    def winner(chosen: list[int], name: str) -> dict[str, Column]:
        """The place of the first of these rules in the order."""
        if rules.mode == "first":
            return {name: first_place(F.col(HITS), words_of(chosen, count))}
        allowed = _constant([rank[k] if k in set(chosen) else None for k in places], "array<int>")
        best = F.array_min(F.transform("rule_places", lambda k: F.get(allowed, k)))
        return {name: F.get(_constant(order, "array<int>"), best)}

    value = lambda name, of: F.get(_constant([of(r) for r in own], "array<string>"), F.col(name))
    with_category = [k for k in places if own[k].category]
    columns = {**winner(with_category, "_place")}
    if rules.mode == "specific":
        columns |= winner([k for k in places if own[k].subcategory], "_subcategory_of") | winner(with_category if rules.merchant_from_category_rules else list(places), "_merchant_of")
    made = df.withColumn("rule_places", all_places(F.col(HITS))).withColumns(columns)

    static = _constant([_plain_entries(r) for r in own], "array<array<struct<tag:string,rule:string>>>")
    told = F.flatten(F.transform("rule_places", lambda k: F.get(static, k)))
    dynamic = [k for k in places if k not in without and any(t[:1] in "{[" for t in own[k].tags)]
    if dynamic:  # in their place among the others
        each = F.create_map(*[x for k in dynamic for x in (F.lit(k), F.when(F.array_contains("rule_places", k), _entries(own[k])).otherwise(_no_entries()))])
        made = made.withColumn("_dynamic", each)
        told = F.flatten(F.transform("rule_places", lambda k: F.coalesce(F.get(static, k), F.try_element_at(F.col("_dynamic"), k))))
    made = made.withColumn("_told", F.filter(told, lambda e: e["tag"] != ""))
    names = sorted({f for r in own for f in r.fields})
    extras = {f"extra_{n}": F.coalesce(*[F.when(F.col("_place") == k, F.expr(own[k].bound(own[k].fields[n])).cast("string")) for k in places if n in own[k].fields and k not in without], F.lit(None).cast("string")) for n in names}
    tags = F.array_sort(F.array_distinct(F.transform("_told", lambda e: e["tag"])))
    unmatched = F.col("_place").isNull()
    fallback = fallback_merchant("description")
    if rules.mode == "first":
        merchant = F.when(unmatched, fallback).otherwise(value("_place", lambda r: r.merchant or r.name))
        subcategory = value("_place", lambda r: r.subcategory or "")
    else:
        merchant = F.coalesce(value("_merchant_of", lambda r: r.merchant or r.name), fallback)
        subcategory = F.coalesce(value("_subcategory_of", lambda r: r.subcategory), F.lit(""))
    made = made.withColumns(
        {
            **extras,
            "matched_rule": value("_place", lambda r: r.name),
            "all_rules": F.transform("rule_places", lambda k: F.get(_constant([r.name for r in own], "array<string>"), k)),
            "match_source": F.when(unmatched, "auto").otherwise("user"),
            "merchant": merchant,
            "category": F.coalesce(value("_place", lambda r: r.category), F.lit("Unknown")),
            "subcategory": F.when(unmatched, "Unknown").otherwise(subcategory),
            "tags": tags,
            "tag_sources": F.map_from_entries(F.transform(tags, lambda t: F.struct(t, F.filter("_told", lambda e: e["tag"] == t)[0]["rule"]))),
        }
    )
    return made.drop("_place", "_told", "_dynamic", "_subcategory_of", "_merchant_of", HITS)


def _plain_entries(rule: Rule) -> list[dict] | None:
    """None for a rule with a tag that is worked out per row."""
    if any(t[:1] in "{[" for t in rule.tags):
        return None
    return [{"tag": t.strip(" ").lower(), "rule": rule.name} for t in rule.tags]


def usage(df: DataFrame, rules: RuleSet) -> DataFrame:
    """A row per rule: ord, rule, ever (it hits some row), first (it gives some row its category), shadowed (it has a category, hits, and never is the first).

    One pass: the words of all rows, and the bit of each row's first rule, are OR-ed.
    """
    own = rules.rules
    if rules.mode != "first":
        raise ValueError("only in a set where the first match wins")
    mask = words_of([k for k, r in enumerate(own) if r.category], len(own))
    wide = range(len(mask))
    marked = with_hits(df, rules).select(HITS).withColumn("_first", first_place(F.col(HITS), mask))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_first") % BITS)
    ored = marked.agg(*[F.bit_or(F.get(HITS, F.lit(w))).alias(f"h{w}") for w in wide], *[F.bit_or(F.when(F.floor(F.col("_first") / BITS) == w, bit)).alias(f"f{w}") for w in wide])
    names = df.sparkSession.createDataFrame([(k, r.name, bool(r.category)) for k, r in enumerate(own)], "ord int, rule string, categorised boolean")
    gathered = ored.select(*[F.array(*[F.coalesce(f"{x}{w}", F.lit(0).cast("long")) for w in wide]).alias(x) for x in "hf"])  # one row
    is_in = lambda x: F.expr(f"shiftright(get({x}, ord div {BITS}), ord % {BITS}) & 1") == 1
    told = names.join(F.broadcast(gathered)).withColumns({"ever": is_in("h"), "first": is_in("f")})
    return told.select("ord", "rule", "ever", "first", (F.col("categorised") & F.col("ever") & ~F.col("first")).alias("shadowed"))


def together(df: DataFrame, rules: RuleSet) -> DataFrame:
    """(a, b, n): pairs of places of rules that hit the same rows, and how many; rows are counted by their words first."""
    grouped = with_hits(df, rules).groupBy(HITS).agg(F.count("*").alias("n")).withColumn("places", all_places(F.col(HITS)))
    left = grouped.select("n", "places", F.explode("places").alias("a"))
    return left.select("n", "a", F.explode(F.filter("places", lambda b: b > F.col("a"))).alias("b")).groupBy("a", "b").agg(F.sum("n").alias("n"))
