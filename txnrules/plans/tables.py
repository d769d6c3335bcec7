"""The transaction views over the star-schema tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrules.operators import state
from txnrules.operators.rules import Rule, RuleSet
from txnrules.operators.spend import with_buckets
from txnrules.sources import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transactions. (orderkey, linenumber) repeats, so there is no row id."""
    t = lambda n: table(spark, sf_dir, n)
    # Line items go through as few and as narrow shuffles as there are large tables to meet: orders bring what customers and nations have, parts come last.
    lines = t("lineitem").select(
        "l_orderkey",
        "l_partkey",
        (F.col("l_extendedprice") * F.when(F.col("l_returnflag") == "R", -1).otherwise(1)).alias("amount"),
        F.to_date("l_shipdate").alias("date"),
        "l_linestatus",
    )
    customers = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_mktsegment", "n_name")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderpriority").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.upper(F.concat_ws(" ", "p_name", "p_brand")).alias("description"),
        "amount",
        "date",
        F.col("l_linestatus").alias("source"),
        F.col("n_name").alias("location"),
        F.create_map(F.lit("priority"), "o_orderpriority", F.lit("segment"), "c_mktsegment", F.lit("type"), "p_type").alias("field"),
        F.col("p_name").alias("name"),
    )


TXN_SQL = """txn AS (
    SELECT upper(p_name || ' ' || p_brand) AS description, l_extendedprice * (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) AS amount,
           CAST(l_shipdate AS DATE) AS date, l_linestatus AS source, n_name AS location, o_orderpriority AS priority, c_mktsegment AS segment, p_type AS type, p_name AS name
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def otxn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as transactions, with a unique id."""
    t = lambda n: table(spark, sf_dir, n)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(F.col("o_orderkey").alias("txn_id"), F.col("c_name").alias("description"), F.col("o_totalprice").alias("amount"), F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("source"), F.col("n_name").alias("location"))


OTXN_SQL = """otxn AS (
    SELECT o_orderkey AS txn_id, c_name AS description, o_totalprice AS amount, CAST(o_orderdate AS DATE) AS date, o_orderstatus AS source, n_name AS location
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def osrc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a supplemental source; ord is a text that orders them totally, but for equal rows."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        F.col("l_orderkey").alias("orderkey"),
        F.col("p_name").alias("item"),
        F.col("l_extendedprice").alias("amount"),
        F.to_date("l_shipdate").alias("date"),
        F.struct(F.col("l_linenumber").alias("a"), F.col("l_partkey").alias("b"), F.col("l_suppkey").alias("c"), F.col("l_extendedprice").alias("d")).alias("ord"),
    )


OSRC_SQL = """osrc AS (
    SELECT l_orderkey AS orderkey, p_name AS item, l_extendedprice AS amount, CAST(l_shipdate AS DATE) AS date, l_linenumber AS o1, l_partkey AS o2, l_suppkey AS o3
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""

# Rules of the registered queries: category by noun, subcategory by adjective, tags by amount and field.
RULES = [
    Rule("Widgets", "has(description, 'WIDGET')", "Hardware", "Widgets", "Widget Co", ["{field['priority']}", "tools"]),
    Rule("Cold bolts", "has(description, 'COLD') AND has(description, 'BOLT')", "Fasteners", "Cold", "Bolt Co", ["tools"]),
    Rule("Bolts", "has(description, 'BOLT')", "Fasteners", "Other", "Bolt Co", priority=40),
    Rule("Gizmos", "finds(description, 'gizmo|gadget')", "Devices", "Small", "Gizmo Inc", ["transfer"]),
    Rule("Red", "begins(description, 'RED')", "Colours", "Red", "Paint House"),
    Rule("Large", "amount > 50000", tags=["large"]),
    Rule("Income", "field['segment'] = 'MACHINERY'", tags=["income"]),
    Rule("Anvils", "has(description, 'ANVIL') AND amount > 20000", "Heavy", "Anvils", "Anvil Works", ["investment"]),
]


def classified(spark: SparkSession, sf_dir: str, mode: str = "first") -> DataFrame:
    from txnrules.functions.text import register_sql_functions

    register_sql_functions(spark)
    return RuleSet(RULES, mode).classify(txn(spark, sf_dir))


INPUTS = ("lineitem", "orders", "part", "customer", "nation")


def spending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified transactions with buckets, written once a session and read by all queries."""
    return store.table_once(spark, "classified", [f"{sf_dir}/{n}.parquet" for n in INPUTS], lambda: with_buckets(classified(spark, sf_dir)))


def kept(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the state of all transactions, written once a session."""
    folder = store.folder_once(spark, f"state-{name}", [f"{sf_dir}/{n}.parquet" for n in INPUTS], lambda f: state.add(spending(spark, sf_dir), f, "all", (name,)))
    return state.read(spark, folder, name) if folder else state.partials(spending(spark, sf_dir))[name]


_HITS = [
    ("Widgets", "contains(description, 'WIDGET')"),
    ("Cold bolts", "contains(description, 'COLD') AND contains(description, 'BOLT')"),
    ("Bolts", "contains(description, 'BOLT')"),
    ("Gizmos", "regexp_matches(description, 'GIZMO|GADGET')"),
    ("Red", "starts_with(description, 'RED')"),
    ("Large", "amount > 50000"),
    ("Income", "segment = 'MACHINERY'"),
    ("Anvils", "contains(description, 'ANVIL') AND amount > 20000"),
]
HITS = dict(_HITS)
_TAGS = {"Widgets": ["lower(priority)", "'tools'"], "Cold bolts": ["'tools'"], "Gizmos": ["'transfer'"], "Large": ["'large'"], "Income": ["'income'"], "Anvils": ["'investment'"]}
FALLBACK_SQL = r"array_to_string(list_transform(list_filter(string_split(regexp_replace(description, '[^A-Za-z ]', ' ', 'g'), ' '), lambda w: w <> '')[1:3], lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def case_sql(pairs: list[tuple[str, str]], default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {default} END"


def tags_sql() -> str:
    parts = ", ".join(f"CASE WHEN {HITS[n]} THEN [{', '.join(ts)}] ELSE [] END" for n, ts in _TAGS.items())
    return f"list_sort(list_distinct(flatten([{parts}])))"


_FIRST = [r for r in RULES if r.category]
CLASSIFIED_SQL = (
    TXN_SQL
    + f""", cls AS (
    SELECT txn.*, {case_sql([(HITS[r.name], f"'{r.category}'") for r in _FIRST], "'Unknown'")} AS category,
           {case_sql([(HITS[r.name], f"'{r.subcategory}'") for r in _FIRST], "'Unknown'")} AS subcategory,
           {case_sql([(HITS[r.name], f"'{r.merchant}'") for r in _FIRST], FALLBACK_SQL)} AS merchant,
           {case_sql([(HITS[r.name], f"'{r.name}'") for r in _FIRST])} AS matched_rule,
           {tags_sql()} AS tags
    FROM txn)"""
)
SPENDING_SQL = (
    CLASSIFIED_SQL
    + """, sp AS (
    SELECT *, strftime(date, '%Y-%m') AS month,
           CASE WHEN list_contains(tags, 'income') THEN 'income' WHEN list_contains(tags, 'investment') THEN 'investment'
                WHEN list_contains(tags, 'transfer') THEN CASE WHEN amount > 0 THEN 'transfer_in' ELSE 'transfer_out' END
                WHEN amount > 0 THEN 'spending' ELSE 'credit' END AS bucket,
           CASE WHEN list_contains(tags, 'income') OR list_contains(tags, 'investment') THEN abs(amount) ELSE amount END AS eff
    FROM cls)"""
)


