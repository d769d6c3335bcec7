"""Rule sets: ordered or most-specific classification of transactions, tags, derived fields.

A rule's condition is Spark SQL (the functions of functions.text.register_sql_functions can be used) or a Column. The whole set becomes one
projection: winners are `coalesce(when(...), ...)` chains in rule order, tags an array of all that match. Specificity depends on the
rule alone, so rules are sorted on the driver once. Rules are known by their place in the set, so several may have one name. A condition that
can't be told (null, or what would raise an error: a failing cast, a division by zero, an index out of range) doesn't match, and the next rules go on. A rule that
can't be used at all (`left_out`: a name that isn't there, an invalid pattern) is passed over in the same way.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from txnrules.functions import literals
from txnrules.functions.text import fallback_merchant, java_pattern
from txnrules.functions.values import amount_condition, date_condition, holds

PATTERN_FUNCTIONS = re.compile(r"\b(?:has|begins|finds|has_plain|anyof|similar|contains|startswith|rlike|regexp)\s*\(|\b(?:r?like|regexp)\b", re.IGNORECASE)
# Names that make a rule more specific by being in its condition, each once.
FIELD_NAMES = ("amount", "date", "month", "year", "day", "weekday", "source", "field")
PATTERNS = re.compile(r"\b(?:finds|rlike|regexp|regexp_like)\s*\([^,]+,\s*'((?:[^'\\]|\\.)*)'\)|\b(?:rlike|regexp)\s+'((?:[^'\\]|\\.)*)'", re.IGNORECASE)
QUOTED = re.compile(r"'((?:[^'\\]|\\.)*)'")
RULES_AT_ONCE = 1000  # rows of a rule table in one array
ARRAYS_AT_ONCE = 100  # arrays of so many rules that are broadcast together
SALTS = 16
COMMON = 50  # a literal that more than one in so many texts have leads to no rule


@contextmanager
def lenient(spark: SparkSession) -> Iterator[None]:
    """Expressions analysed inside give null where they would otherwise raise an error; Spark fixes that when it analyses them."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@dataclass
class Rule:
    """One rule. `tags` are texts, '{SQL}' for a text or '[SQL]' for an array of the row; `let` binds names, in order, for the condition and the fields."""

    name: str
    when: str | Column
    category: str | None = None
    subcategory: str | None = None
    merchant: str | None = None
    tags: list[str] = field(default_factory=list)
    priority: int = 50
    let: dict[str, str] = field(default_factory=dict)
    fields: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not self.category and not self.tags:
            raise ValueError(f"rule {self.name} has neither category nor tags")

    def bound(self, expression: str) -> str:
        """The expression with the let names replaced by what they stand for; later names see earlier ones."""
        known: dict[str, str] = {}
        for name, value in self.let.items():
            known[name] = _substituted(value, known)
        return _substituted(expression, known)

    def condition(self) -> Column:
        return holds(self.when if isinstance(self.when, Column) else F.expr(self.bound(self.when)))

    def texts(self) -> list[str]:
        """All SQL of the rule: the condition, as a yes or no, tags that are worked out per row, and fields."""
        condition = [f"coalesce(({self.bound(self.when)}), false)"] if isinstance(self.when, str) else []
        return condition + [f"CAST({self.bound(t[1:-1])} AS {'array<string>' if t[0] == '[' else 'string'})" for t in self.tags if t[:1] in "{["] + [self.bound(v) for v in self.fields.values()]

    def analysed(self, df: DataFrame) -> None:
        """Raises an error if the rule can't be used on df."""
        df.selectExpr("1", *self.texts())
        if isinstance(self.when, Column):
            df.select(self.condition())

    def patterns(self) -> list[str]:
        """Quoted regular expressions of the condition, as Spark reads them."""
        text = self.bound(self.when) if isinstance(self.when, str) else ""
        quoted = PATTERNS.findall(text)
        return [(a or b).replace("\\\\", "\\") for a, b in quoted]

    def specificity(self) -> tuple[int, int, int, int]:
        """(priority, pattern functions, different field names in the condition, length of quoted text)."""
        text = self.when if isinstance(self.when, str) else ""
        bare = QUOTED.sub("''", text)
        return self.priority, len(PATTERN_FUNCTIONS.findall(bare)), sum(n in text.lower() for n in FIELD_NAMES), sum(map(len, QUOTED.findall(text)))


def _substituted(expression: str, known: dict[str, str]) -> str:
    """Names replaced outside quoted text."""
    if not known:
        return expression
    names = re.compile(r"'(?:[^'\\]|\\.)*'|\b(?:" + "|".join(map(re.escape, known)) + r")\b")
    return names.sub(lambda m: m[0] if m[0][0] == "'" else f"({known[m[0]]})", expression)


class RuleSet:
    """Rules in order. mode: 'first' (first matching rule that has a category) or 'specific' (each field from the most specific matching rule that sets it)."""

    def __init__(self, rules: list[Rule], mode: str = "first", variables: dict[str, str] | None = None, merchant_from_category_rules: bool = False):
        if mode not in ("first", "specific"):
            raise ValueError(mode)
        self.rules, self.mode, self.variables = rules, mode, variables or {}
        self.merchant_from_category_rules = merchant_from_category_rules

    def by_specificity(self) -> list[Rule]:
        return sorted(self.rules, key=lambda r: r.specificity(), reverse=True)  # stable: ties go to the earlier rule

    @staticmethod
    def _winner(places: list[int], value) -> Column:
        """Of the rules at these places the first that matches gives the value."""
        return F.coalesce(*[F.when(F.col(f"_rule_{k}"), value(k)) for k in places], F.lit(None).cast("string"))

    def left_out(self, df: DataFrame) -> dict[int, str]:
        """Places of the rules that can't be used on df, with the reason: no SQL, a name or type that df doesn't have, an invalid pattern. `classify` goes on without them.

        Each rule is analysed alone only if the set as a whole can't be.
        """
        with lenient(df.sparkSession):
            return self._left_out(df.withColumns({n: F.expr(v) for n, v in self.variables.items()}))

    def _left_out(self, df: DataFrame) -> dict[int, str]:
        compile_ = df.sparkSession._jvm.java.util.regex.Pattern.compile
        reasons: dict[int, str] = {}

        def tried(k: int, what: str, attempt) -> None:
            try:
                attempt()
            except (PySparkException, Py4JJavaError) as failed:
                condition = failed.getCondition() if isinstance(failed, PySparkException) else None
                reasons.setdefault(k, f"{what}: {condition or 'not valid'}")

        log = logging.getLogger("SQLQueryContextLogger")  # Spark logs each failed analysis at length
        level = log.level
        log.setLevel(logging.CRITICAL)
        for k, r in enumerate(self.rules):
            for pattern in r.patterns():
                tried(k, f"pattern {pattern}", lambda p=pattern: compile_("(?iU)" + p))
        try:
            df.selectExpr("1", *[t for k, r in enumerate(self.rules) if k not in reasons for t in r.texts()])
            df.select(F.lit(1), *[r.condition() for k, r in enumerate(self.rules) if k not in reasons and isinstance(r.when, Column)])
        except PySparkException:
            for k, r in enumerate(self.rules):
                if k not in reasons:
                    tried(k, "expression", lambda r=r: r.analysed(df))
        finally:
            log.setLevel(level)
        return reasons

    def classify(self, df: DataFrame) -> DataFrame:
        """df with merchant, category, subcategory, tags, matched_rule, all_rules, rule_places (of all matching rules in the set, from 0), tag_sources and,
        where rules have them, extra_<field> columns."""
        with lenient(df.sparkSession):
            return self._classified(df)

    def _classified(self, df: DataFrame) -> DataFrame:
        df = df.withColumns({n: F.expr(v) for n, v in self.variables.items()})
        without = self._left_out(df)
        rules = [Rule(r.name, "false", r.category, r.subcategory, r.merchant, [], r.priority) if k in without and r.category else r for k, r in enumerate(self.rules)]
        rules = [Rule(r.name, "false", tags=["-"]) if k in without and not r.category else r for k, r in enumerate(rules)]
        df = df.select("*", *[r.condition().alias(f"_rule_{k}") for k, r in enumerate(rules)])
        places = range(len(rules))
        ranked = sorted(places, key=lambda k: self.rules[k].specificity(), reverse=True)  # stable: ties go to the earlier rule
        order = list(places) if self.mode == "first" else ranked
        with_category = [k for k in order if rules[k].category]
        place = F.coalesce(*[F.when(F.col(f"_rule_{k}"), F.lit(k)) for k in with_category], F.lit(None).cast("int"))
        if self.mode == "first":
            subcategory = self._winner(with_category, lambda k: F.lit(rules[k].subcategory or ""))
            merchant = self._winner(with_category, lambda k: F.lit(rules[k].merchant or rules[k].name))
        else:
            subcategory = self._winner([k for k in ranked if rules[k].subcategory], lambda k: F.lit(rules[k].subcategory))
            merchant = self._winner(with_category if self.merchant_from_category_rules else ranked, lambda k: F.lit(rules[k].merchant or rules[k].name))
        values = {
            "_place": place,
            "matched_rule": self._winner(with_category, lambda k: F.lit(rules[k].name)),
            "_category": self._winner(with_category, lambda k: F.lit(rules[k].category)),
            "_subcategory": subcategory,
            "_merchant": merchant,
        }
        told = F.concat(_no_entries(), *[F.when(F.col(f"_rule_{k}"), _entries(rules[k])).otherwise(_no_entries()) for k in places if rules[k].tags])
        matching = F.array(*[F.when(F.col(f"_rule_{k}"), F.lit(k)) for k in places]) if rules else F.array().cast("array<int>")
        made = df.withColumns({**values, "_told": F.filter(told, lambda e: e["tag"] != ""), "rule_places": F.filter(matching, lambda k: k.isNotNull())})
        names = sorted({f for r in rules for f in r.fields})
        extras = {f"extra_{n}": F.coalesce(*[F.when(F.col("_place") == k, F.expr(rules[k].bound(rules[k].fields[n])).cast("string")) for k in places if n in rules[k].fields]) for n in names}
        all_names = F.array(*[F.lit(r.name) for r in rules]) if rules else F.array().cast("array<string>")
        tags = F.array_sort(F.array_distinct(F.transform("_told", lambda e: e["tag"])))
        first_of = F.map_from_entries(F.transform(tags, lambda t: F.struct(t, F.filter("_told", lambda e: e["tag"] == t)[0]["rule"])))
        unmatched = F.col("_category").isNull()
        made = made.withColumns(
            {
                **extras,
                "all_rules": F.transform("rule_places", lambda k: F.get(all_names, k)),
                "match_source": F.when(unmatched, "auto").otherwise("user"),
                "merchant": F.coalesce("_merchant", fallback_merchant("description")) if self.mode == "specific" else F.when(unmatched, fallback_merchant("description")).otherwise(F.col("_merchant")),
                "category": F.coalesce("_category", F.lit("Unknown")),
                "subcategory": F.when(unmatched, "Unknown").otherwise(F.coalesce("_subcategory", F.lit(""))),
                "tags": tags,
                "tag_sources": first_of,
            }
        )
        return made.drop("_place", "_category", "_subcategory", "_merchant", "_told", *[f"_rule_{k}" for k in places])

    def audit(self, df: DataFrame | None = None, sources: tuple[str, ...] = ()) -> dict[str, object]:
        """Counts and oddities of the set; with df also the rules that can't be used on it. `sources` are names of columns that come from other sources."""
        plain = [t.lower() for r in self.rules for t in r.tags if t[:1] not in ("{", "[")]
        text = lambda r: QUOTED.sub("''", " ".join([r.bound(r.when) if isinstance(r.when, str) else "", *r.fields.values()]))
        return {
            "rules": len(self.rules),
            "with_tags": sum(bool(r.tags) for r in self.rules),
            "tags": sorted(set(plain)),
            "tag_only": [r.name for r in self.rules if not r.category],
            "without_merchant": [r.name for r in self.rules if not r.merchant],
            "special_tags": sorted(set(plain) & {"income", "investment", "transfer", "refund"}),
            "with_let": [r.name for r in self.rules if r.let],
            "with_fields": [r.name for r in self.rules if r.fields],
            "repeated_names": sorted({r.name for k, r in enumerate(self.rules) if r.name in [x.name for x in self.rules[:k]]}),
            "of_other_sources": [r.name for r in self.rules if any(re.search(rf"\b{re.escape(x)}\b", text(r)) for x in sources)],
            "left_out": {self.rules[k].name: reason for k, reason in self.left_out(df).items()} if df is not None else {},
        }


def _no_entries() -> Column:
    return F.array().cast("array<struct<tag:string,rule:string>>")


def _entries(rule: Rule) -> Column:
    """(tag, rule) of a rule's tags: lower case, trimmed; '{expression}' is worked out per row and may give text or, as '[expression]', an array."""
    lists = []
    for tag in rule.tags:
        if tag.startswith("["):
            values = F.expr(rule.bound(tag[1:-1]))
        else:
            values = F.array(F.expr(rule.bound(tag[1:-1])).cast("string") if tag.startswith("{") else F.lit(tag))
        lists.append(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda t: F.struct(F.lower(F.trim(F.coalesce(t, F.lit("")))).alias("tag"), F.lit(rule.name).alias("rule"))))
    return F.concat(*lists) if lists else _no_entries()


def transformed(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """Replaces columns one step after the other; the first original of each is kept in the map raw_values."""
    originals = {name: F.col(name).cast("string") for name, _ in reversed(steps)}
    df = df.withColumn("raw_values", F.create_map(*[x for n, c in originals.items() for x in (F.lit(n), c)]) if originals else F.create_map().cast("map<string,string>"))
    for name, value in steps:
        df = df.withColumn(name, F.coalesce(value, F.col(name)))
    return df


def all_matches(classified: DataFrame) -> DataFrame:
    """A row per transaction and matching rule."""
    return classified.withColumn("rule", F.explode("all_rules"))


def rule_hits(classified: DataFrame, rules: RuleSet) -> DataFrame:
    """Hits per rule, by its place in the set; rules without any are included."""
    names = classified.sparkSession.createDataFrame([(k, r.name) for k, r in enumerate(rules.rules)], "ord int, rule string")
    counted = classified.select(F.explode("rule_places").alias("ord")).groupBy("ord").agg(F.count("*").alias("n"))
    return names.join(counted, "ord", "left").select("ord", "rule", F.coalesce("n", F.lit(0)).alias("n"))


def explain(classified: DataFrame) -> DataFrame:
    """Per row: original and transformed text, the first matching rule of any kind, whether nothing gave a category."""
    original = F.coalesce(F.col("raw_values")["description"], "description") if "raw_values" in classified.columns else F.col("description")
    return classified.select(original.alias("original"), F.col("description").alias("text"), F.get("all_rules", F.lit(0)).alias("first_rule"), "matched_rule", (F.col("match_source") == "auto").alias("unknown"))


def row_condition(row: dict) -> Column:
    """A row of a rule table (pattern, amt_op, amt_lo, amt_hi, date_lo, date_hi, month; those that are null don't count) as one condition."""
    condition = F.col("description").rlike(java_pattern(row["pattern"]))
    if row.get("amt_op"):
        condition = condition & amount_condition(F.col("amount"), row["amt_op"], row["amt_lo"], row.get("amt_hi"))
    if row.get("date_lo") or row.get("date_hi"):
        condition = condition & date_condition(F.col("date"), first=row.get("date_lo"), last=row.get("date_hi"))
    if row.get("month"):
        condition = condition & date_condition(F.col("date"), month=row["month"])
    return holds(condition)


def _java(pattern: Column) -> Column:
    return F.concat(F.lit("(?iU)"), F.replace(pattern, F.lit("(?P<"), F.lit("(?<")))


def _compiles(pattern: Column) -> Column:
    """Whether Java takes the pattern; it is asked once per rule, and a refusal is a null instead of an error."""
    return F.coalesce(F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull(), F.lit(False))


def rejected_rows(rules: DataFrame) -> DataFrame:
    """Rows of a rule table that `match_table` leaves out: ord, pattern, reason."""
    reason = F.when(F.col("pattern").isNull(), "no pattern").when(~_compiles(_java(F.col("pattern"))), "invalid pattern")
    return rules.select("ord", "pattern", reason.alias("reason")).filter("reason IS NOT NULL")


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _choices(patterns: pd.Series) -> pd.Series:
    """Sets of literals of rule patterns; rules only, no transactions, go through it."""
    return patterns.map(literals.choices)


def matching_rules(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (description, ord) where the rule's pattern is found in the text; texts has distinct descriptions.

    Rules are looked up by a literal that their matches must have: of all the literals of a pattern, the one that fewest texts may have. It goes into an index under the one of its keys (parts of
    as many characters as the largest of literals.SIZES that fits) that fewest texts have; texts are joined with the index on their keys, and candidates are tested for the literal, then for the pattern.
    Rules without such a literal, or whose literals more than one in COMMON texts have, are tested on every text, as arrays of RULES_AT_ONCE rules that are broadcast ARRAYS_AT_ONCE at a time. So no
    rule set of any size gives a nested-loop join, and no key brings many texts and many rules into one task.
    """
    tasks = rules.sparkSession.sparkContext.defaultParallelism  # tables of few bytes make much work here, and would be read by one task
    spread, texts = rules.filter(F.col("pattern").isNotNull()).select("ord", "pattern").repartition(tasks), texts.repartition(tasks)
    known = spread.select("ord", _java(F.col("pattern")).alias("java"), _choices("pattern").alias("choices")).filter(_compiles(F.col("java")))
    most = texts.count() / COMMON
    least = _least(texts, known.filter(F.size("choices") > 0))
    found = _by_literal(texts, least.filter(F.col("n") <= most))
    plain = known.filter(F.size("choices") == 0).select("ord", "java").unionByName(least.filter(F.col("n") > most).select("ord", "java"))
    arrays = -(-plain.count() // RULES_AT_ONCE)
    for first in range(0, arrays, ARRAYS_AT_ONCE):
        last = min(first + ARRAYS_AT_ONCE, arrays) - 1
        numbered = plain.withColumn("_turn", F.pmod(F.xxhash64("ord"), F.lit(arrays)).cast("int")).filter(F.col("_turn").between(first, last))
        packed = numbered.groupBy("_turn").agg(F.collect_list(F.struct("ord", "java")).alias("_rules"))
        tried = texts.withColumn("_turn", F.explode(F.sequence(F.lit(first), F.lit(last)))).join(F.broadcast(packed), "_turn")
        hits = F.filter("_rules", lambda r: F.rlike("description", r["java"]))
        found = found.unionByName(tried.select("description", F.explode(F.transform(hits, lambda r: r["ord"])).alias("ord")))
    return found


def _keys_of(texts: DataFrame, sizes: list[int]) -> DataFrame:
    """A row per text and key."""
    return texts.select("description", F.explode(literals.keys(literals.folded("description"), F.array(*[F.lit(k) for k in sizes]))).alias("_key"))


def _least(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """ord, java, n, literals (structs n, _literal, _key): of a rule's sets of literals the one that at most n texts can have, the least of its sets."""
    each = rules.select("ord", "java", F.posexplode("choices").alias("_choice", "_of")).select("ord", "java", "_choice", F.explode("_of").alias("_literal"))
    of_rules = each.withColumn("_key", F.explode(literals.keys("_literal", F.array(literals.key_size("_literal")))))
    common = _keys_of(texts, list(literals.SIZES)).select("_key").join(of_rules.select("_key").distinct(), "_key").groupBy("_key").agg(F.count("*").alias("_n"))
    rarest = of_rules.join(common, "_key", "left").groupBy("ord", "java", "_choice", "_literal").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), "_key")).alias("_least"))
    told = rarest.groupBy("ord", "java", "_choice").agg(F.sum("_least.n").alias("n"), F.collect_list(F.struct("_least.n", "_literal", "_least._key")).alias("literals"))
    return told.groupBy("ord", "java").agg(F.min(F.struct("n", "_choice", "literals")).alias("_best")).select("ord", "java", "_best.n", "_best.literals")


def _by_literal(texts: DataFrame, rules: DataFrame) -> DataFrame:
    index = rules.select("ord", "java", F.explode("literals").alias("_one")).filter("_one.n > 0").select("ord", "java", "_one._literal", "_one._key")  # a key that no text has: the rule matches none
    candidates = _keys_of(texts, list(literals.SIZES)).join(index, "_key").filter(F.contains(literals.folded("description"), F.col("_literal")))
    return candidates.filter(F.rlike("description", F.col("java"))).select("description", "ord").distinct()


def match_table(df: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules as rows (ord, pattern, merchant, category, subcategory, tags, amt_op, amt_lo, amt_hi, date_lo, date_hi, month): the first matching
    row with a category gives the fields, all matching rows give tags. Rows of df without a match are kept, null descriptions match nothing, and rows of `rejected_rows` are left out.

    Patterns are tested on the distinct texts only (`matching_rules`). The rules that a text matches come back to its rows as one array, so nothing has to be
    regrouped; a text that very many rows have is dealt to SALTS tasks.
    """
    texts = df.select("description").filter("description IS NOT NULL").distinct()
    found = matching_rules(texts, rules).join(rules, "ord")
    rule = F.struct("ord", "merchant", "category", "subcategory", "tags", "amt_op", "amt_lo", "amt_hi", "date_lo", "date_hi", "month")
    of_text = found.groupBy("description").agg(F.array_sort(F.collect_list(rule)).alias("_hits"))  # no more than there are rules
    salted = of_text.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    joined = df.withColumn("_salt", F.pmod(F.xxhash64("amount", "date"), F.lit(SALTS)).cast("int")).join(salted, ["description", "_salt"], "left")

    def fits(r: Column) -> Column:
        amount, lo, hi, op = F.col("amount"), r["amt_lo"], r["amt_hi"], r["amt_op"]
        amount_ok = (
            F.when(op.isNull(), True).when(op == ">", amount > lo).when(op == ">=", amount >= lo).when(op == "<", amount < lo).when(op == "<=", amount <= lo)
            .when(op == "=", F.abs(amount - lo) < 0.01).otherwise(amount.between(lo, hi))
        )
        date_ok = (r["date_lo"].isNull() | (F.col("date") >= r["date_lo"])) & (r["date_hi"].isNull() | (F.col("date") <= r["date_hi"]))
        return F.coalesce(amount_ok & date_ok & (r["month"].isNull() | (F.month("date") == r["month"])), F.lit(False))

    fitting = joined.withColumn("_hits", F.filter("_hits", fits))
    won = F.get(F.filter("_hits", lambda r: r["category"].isNotNull()), F.lit(0))
    tags = F.array_sort(F.array_distinct(F.flatten(F.transform("_hits", lambda r: r["tags"]))))
    return fitting.withColumn("_won", won).select(*df.columns, "_won.merchant", "_won.category", "_won.subcategory", F.coalesce(tags, F.array().cast("array<string>")).alias("tags"))
