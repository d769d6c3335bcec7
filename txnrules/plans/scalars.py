"""Queries for scalar and list functions (F*), ingest parsing (I*), sources (S*) and profiles (T*)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from txnrules.functions import text as X
from txnrules.functions import values as V
from txnrules.operators import profile, sketches
from txnrules.plans import tables
from txnrules.plans.registry import register
from txnrules.plans.tables import OTXN_SQL, TXN_SQL
from txnrules.sources import ingest, records, sinks

c = F.col


def on_parts(name: str, sql: str, **columns) -> None:
    """Functions of every part's name, brand and price."""

    def query(spark, sf_dir):
        return tables.table(spark, sf_dir, "part").select("p_partkey", *[make().alias(n) for n, make in columns.items()])

    register(name, f"SELECT p_partkey, {sql} FROM part")(query)


on_parts("f01_extract", r"regexp_extract(p_name, '^\w+ (\w)', 1) AS a, '' AS b, regexp_extract(p_brand, '([0-9]+)', 1) AS d", a=lambda: X.extract(c("p_name"), r"^\w+ (\w)"), b=lambda: X.extract(c("p_name"), "x+"), d=lambda: X.extract(c("p_brand"), r"(?P<n>[0-9]+)"))
on_parts("f02_split", "trim(split_part(p_name, ' ', 2)) AS a, trim(split_part(p_name, 'o', 9)) AS b, '' AS d", a=lambda: X.split_at("p_name", " ", 1), b=lambda: X.split_at("p_name", "o", 8), d=lambda: X.split_at("p_name", " ", -1))
on_parts("f03_substring", "substring(p_name, 2, 3) AS a, right(p_name, 3) AS b, '' AS d", a=lambda: X.slice_text("p_name", 1, 4), b=lambda: X.slice_text("p_name", -3, 99), d=lambda: X.slice_text("p_name", 4, 2))
on_parts("f04_trim", "p_name AS a", a=lambda: X.trimmed(F.concat(F.lit(" \t"), "p_name", F.lit("\n "))))
on_parts("f05_regex_replace", r"regexp_replace(p_name, '(\w+) (\w+)', '\2-\1', 'g') AS a, replace(p_brand, 'Brand', '$') AS b", a=lambda: X.replace_all("p_name", r"(\w+) (\w+)", r"\2-\1"), b=lambda: X.replace_all("p_brand", "BRAND", "$"))
on_parts("f06_uppercase", "upper(p_name) AS a", a=lambda: F.upper("p_name"))
on_parts("f07_lowercase", "lower(p_brand) AS a", a=lambda: F.lower("p_brand"))
on_parts("f08_strip_prefix", "CASE WHEN starts_with(p_name, 'red') THEN substring(p_name, 4) ELSE p_name END AS a", a=lambda: X.strip_prefix("p_name", "RED"))
on_parts("f09_strip_suffix", "CASE WHEN ends_with(p_name, 'bolt') THEN p_name[1:length(p_name) - 4] ELSE p_name END AS a, p_name AS b", a=lambda: X.strip_suffix("p_name", "Bolt"), b=lambda: X.strip_suffix("p_name", ""))
on_parts("f10_text_methods", "lower(upper(p_name)) AS a", a=lambda: F.lower(F.upper(X.trimmed(F.concat(F.lit(" "), "p_name")))))
on_parts("f11_case_sensitive", "starts_with(p_brand, 'Brand') AS a, ends_with(p_brand, 'A') AS b, starts_with(p_brand, 'BRAND') AS d", a=lambda: F.startswith("p_brand", F.lit("Brand")), b=lambda: F.endswith("p_brand", F.lit("A")), d=lambda: F.startswith("p_brand", F.lit("BRAND")))
on_parts("f12_replace", "replace(p_name, 'o', '.+') AS a", a=lambda: F.replace("p_name", F.lit("o"), F.lit(".+")))
on_parts("f13_abs", "abs(p_retailprice - 1000) AS a", a=lambda: F.abs(c("p_retailprice") - 1000))
on_parts("f14_round", "round_even(p_size / 4.0, 0)::DOUBLE AS a", a=lambda: F.bround(c("p_size") / 4.0, 0))
on_parts("f15_min_max", "least(p_size, 10, p_partkey)::BIGINT AS a, greatest(p_size, 10)::BIGINT AS b", a=lambda: F.least("p_size", F.lit(10), "p_partkey").cast("long"), b=lambda: F.greatest("p_size", F.lit(10)).cast("long"))
on_parts("f16_max_val", "greatest(p_retailprice, 1200.0) AS a, least(p_retailprice, 1200.0) AS b", a=lambda: F.greatest("p_retailprice", F.lit(1200.0)), b=lambda: F.least("p_retailprice", F.lit(1200.0)))
on_parts("f17_len", "len(string_split(p_name, ' '))::BIGINT AS a, length(p_name)::BIGINT AS b", a=lambda: F.size(F.split("p_name", " ")).cast("long"), b=lambda: F.length("p_name").cast("long"))


def _sizes():
    return F.transform(F.split("p_name", " "), lambda w: F.length(w).cast("double"))


_SIZES = "list_transform(string_split(p_name, ' '), lambda w: length(w)::DOUBLE)"
on_parts(
    "f18_list_functions",
    f"list_sum({_SIZES}) AS a, list_max({_SIZES}) AS b, list_min({_SIZES}) AS d, len(list_filter({_SIZES}, lambda x: x > 5)) > 0 AS e, len(list_filter({_SIZES}, lambda x: x <= 3)) = 0 AS f, round(list_avg({_SIZES}), 6) AS g",
    a=lambda: V.list_sum(_sizes()),
    b=lambda: V.list_max(_sizes()),
    d=lambda: V.list_min(_sizes()),
    e=lambda: F.exists(_sizes(), lambda x: x > 5),
    f=lambda: F.forall(_sizes(), lambda x: x > 3),
    g=lambda: F.round(V.list_avg(_sizes()), 6),
)
on_parts("f19_index", "string_split(p_name, ' ')[2] AS a, string_split(p_name, ' ')[-1] AS b, NULL::VARCHAR AS d", a=lambda: F.get(F.split("p_name", " "), F.lit(1)), b=lambda: F.try_element_at(F.split("p_name", " "), F.lit(-1)), d=lambda: F.get(F.split("p_name", " "), F.lit(9)))
on_parts("f20_attribute", "p_brand AS a, p_size::BIGINT AS b", a=lambda: F.struct("p_brand", "p_size")["p_brand"], b=lambda: F.array(F.struct("p_size"))[0]["p_size"].cast("long"))
on_parts(
    "f21_comprehension",
    "array_to_string(list_transform(list_filter(string_split(p_name, ' '), lambda w: length(w) > 3), lambda w: upper(w)), '+') AS a",
    a=lambda: F.array_join(F.transform(F.filter(F.split("p_name", " "), lambda w: F.length(w) > 3), F.upper), "+"),
)
on_parts("f23_currency", "CASE WHEN p_retailprice < 1000 THEN '-' ELSE '' END || '$' || format('{:,.2f}', abs(p_retailprice - 1000)) AS a, format('{:,.0f}', p_size::DOUBLE) || ' EUR' AS b", a=lambda: X.currency(c("p_retailprice") - 1000), b=lambda: X.currency(c("p_size").cast("double"), 0, "{} EUR"))
on_parts("f28_merchant_id", "replace(replace(p_name || '''s', '''', ''), ' ', '_') AS a", a=lambda: X.element_id(F.concat("p_name", F.lit("'s"))))
_CORE = r"trim(regexp_replace(upper(p_name), '\s+[A-Z]{2}$', ''))"
_TITLE = "array_to_string(list_transform(string_split(p_name, ' ')[1:3], lambda w: upper(w[1]) || lower(w[2:])), ' ')"
on_parts(
    "f24_suggested_pattern",
    r"array_to_string(string_split(upper(p_name), ' ')[1:3], '\s*') AS a, array_to_string(string_split(upper(p_name), ' ')[1:2], '\s*') || '\s*C\.\*' AS b",
    a=lambda: X.suggested_pattern(F.concat(F.lit("Sq *"), "p_name", F.lit(" #12"))),
    b=lambda: X.suggested_pattern(F.concat(F.lit("google *"), "p_name", F.lit(" c.* 98765 SEATTLE WA"))),
)
on_parts(
    "f25_suggested_merchant",
    f"{_TITLE} AS a, 'O' || chr(39) || {_TITLE} AS b, 'Unknown' AS d",
    a=lambda: X.suggested_merchant(F.concat(F.lit("TST*"), F.upper("p_name"), F.lit("  #77 DES:PAYMENT ID:9"))),
    b=lambda: X.suggested_merchant(F.concat(F.lit("o'"), "p_name")),
    d=lambda: X.suggested_merchant(F.substring("p_name", 1, 0)),
)
_RULE = f"""'[' || {_TITLE.format("p_name")} || ']' || chr(10) || 'match: contains("' || array_to_string(string_split({_CORE}, ' ')[1:3], '\\s*') || '")' || chr(10) || 'category: CATEGORY' || chr(10) || 'subcategory: SUBCATEGORY' || CASE WHEN p_size > 20 THEN chr(10) || 'tags: refund' ELSE '' END"""
on_parts("f26_suggested_rule", f"{_RULE} AS a", a=lambda: X.suggested_rule(c("p_name"), F.when(c("p_size") > 20, F.array(F.lit("refund"))).otherwise(F.array().cast("array<string>"))))
on_parts("i11_fallback_merchant", r"array_to_string(list_transform(list_filter(string_split(regexp_replace(p_name || ' ' || p_brand, '[^A-Za-z ]', ' ', 'g'), ' '), lambda w: w <> '')[1:3], lambda w: upper(w[1]) || lower(w[2:])), ' ') AS a", a=lambda: X.fallback_merchant(F.concat_ws(" ", "p_name", "p_brand")))
on_parts("i10_clean", "p_name AS a", a=lambda: X.clean(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t ")), F.lit("\n"))))


@register(
    "f27_period_keys",
    f"WITH {TXN_SQL} SELECT strftime(date, '%Y-%m') AS m, strftime(date, '%Y') AS y, strftime(date, '%Y-W%W') AS w, strftime(date, '%Y-%m-%d') AS d, count(*) AS n FROM txn GROUP BY ALL",
)
def f27(spark, sf_dir):
    keys = [V.period_key(u, F.col("date")).alias(u[0]) for u in ("month", "year", "week", "day")]
    return tables.txn(spark, sf_dir).groupBy(*keys).agg(F.count("*").alias("n"))


@register("f29_month_filter", f"WITH {TXN_SQL}, m AS (SELECT strftime(date, '%Y-%m') AS month FROM txn) SELECT max(month) AS month FROM m WHERE month LIKE '%-03' UNION ALL SELECT max(month) FROM m WHERE month LIKE '%-11' UNION ALL SELECT '1996-02'")
def f29(spark, sf_dir):
    df = tables.txn(spark, sf_dir)
    return V.resolve_month(df, "mar").unionByName(V.resolve_month(df, "11")).unionByName(V.resolve_month(df, "1996-02"))


@register("f30_month_range", f"WITH {TXN_SQL} SELECT month, count(*) AS n FROM (SELECT strftime(date, '%Y-%m') AS month FROM txn) WHERE month BETWEEN '1995-11' AND '1996-04' GROUP BY month")
def f30(spark, sf_dir):
    df = tables.txn(spark, sf_dir).withColumn("month", V.period_key("month", F.col("date")))
    wanted = spark.range(1).select(F.explode(V.months_between_keys("1995-11", "1996-04")).alias("month"))
    return df.join(wanted, "month").groupBy("month").agg(F.count("*").alias("n"))


def raw(spark, sf_dir):
    """Orders as an untyped text table: dates, amounts with currency signs, parentheses, blanks."""
    t = tables.otxn(spark, sf_dir)
    money = F.format_number(F.col("amount"), 2)
    text = F.when(F.col("txn_id") % 7 == 0, F.concat(F.lit("("), money, F.lit(")"))).when(F.col("txn_id") % 7 == 1, F.concat(F.lit("$"), money)).when(F.col("txn_id") % 101 == 0, F.lit(" ")).otherwise(money)
    return t.select(
        F.date_format("date", "M/d/yyyy").alias("c0"),
        F.concat("description", F.lit(" store "), F.substring("location", 1, 2)).alias("c1"),
        text.alias("c2"),
        F.when(F.col("txn_id") % 3 == 0, F.col("location")).otherwise("").alias("c3"),
        F.col("txn_id").cast("string").alias("c4"),
    )


_RAW = f"""{OTXN_SQL}, raw AS (
    SELECT date, description || ' store ' || substring(location, 1, 2) AS description, CASE WHEN txn_id % 7 = 0 THEN -round(amount, 2) WHEN txn_id % 7 <> 1 AND txn_id % 101 = 0 THEN NULL ELSE round(amount, 2) END AS amount,
           CASE WHEN txn_id % 3 = 0 THEN location ELSE substring(location, 1, 2) END AS location, txn_id::VARCHAR AS id FROM otxn)"""
SHAPE = ingest.ColumnMap(date=0, description=1, amount=2, location=3, captures={"id": 4})


def prepared(name: str, sql: str, build) -> None:
    register(name, f"WITH {_RAW} {sql}")(lambda spark, sf_dir: build(ingest.good(ingest.prepare(raw(spark, sf_dir), SHAPE, "bank"))))


cents = lambda x: F.round(F.sum(x), 2)
prepared("i01_amounts", "SELECT id, amount FROM raw WHERE amount IS NOT NULL", lambda d: d.select(c("field")["id"].alias("id"), "amount"))
prepared("i02_dates", "SELECT id, date FROM raw WHERE amount IS NOT NULL", lambda d: d.select(c("field")["id"].alias("id"), "date"))
prepared("i04_captures", "SELECT id, id AS captured FROM raw WHERE amount IS NOT NULL", lambda d: d.select(c("field")["id"].alias("id"), F.element_at("field", "id").alias("captured")))
prepared("i07_credit", "SELECT amount < 0 AS is_credit, count(*) AS n, round(sum(amount), 2) AS total FROM raw WHERE amount IS NOT NULL GROUP BY 1", lambda d: d.groupBy("is_credit").agg(F.count("*").alias("n"), cents("amount").alias("total")))
prepared("i08_location", "SELECT location, count(*) AS n FROM raw WHERE amount IS NOT NULL GROUP BY 1", lambda d: d.groupBy("location").agg(F.count("*").alias("n")))
prepared("i09_source_label", "SELECT 'bank' AS source, count(*) AS n FROM raw WHERE amount IS NOT NULL", lambda d: ingest.source_counts(d))
prepared("s07_positions", "SELECT description, count(*) AS n, round(sum(amount), 2) AS total FROM raw WHERE amount IS NOT NULL GROUP BY 1", lambda d: d.groupBy("description").agg(F.count("*").alias("n"), cents("amount").alias("total")))


@register("i03_template", f"WITH {OTXN_SQL} SELECT description || ' (' || source || ')' AS description, count(*) AS n FROM otxn GROUP BY 1")
def i03(spark, sf_dir):
    rows = tables.otxn(spark, sf_dir).select(F.date_format("date", "yyyy-MM-dd").alias("c0"), F.col("description").alias("c1"), F.col("source").alias("c2"), F.col("amount").cast("string").alias("c3"))
    shape = ingest.ColumnMap(date=0, amount=3, captures={"merchant": 1, "kind": 2}, template="{merchant} ({kind})", date_format="%Y-%m-%d")
    return ingest.good(ingest.prepare(rows, shape, "x")).groupBy("description").agg(F.count("*").alias("n"))


@register("i05_sign", f"WITH {_RAW} SELECT 'absolute' AS sign, round(sum(abs(amount)), 2) AS total FROM raw UNION ALL SELECT 'negate', round(sum(-amount), 2) FROM raw")
def i05(spark, sf_dir):
    def one(sign):
        shape = ingest.ColumnMap(date=0, description=1, amount=2, sign=sign)
        return ingest.good(ingest.prepare(raw(spark, sf_dir), shape, "x")).agg(F.lit(sign).alias("sign"), cents("amount").alias("total"))

    return one("absolute").unionByName(one("negate"))


@register("i06_dropped_rows", f"WITH {_RAW} SELECT CASE WHEN id::INT % 10 = 3 THEN 'too few columns' WHEN amount IS NULL THEN 'empty' END AS reason, count(*) AS n FROM raw GROUP BY 1")
def i06(spark, sf_dir):
    """Every tenth line of an export ends after its second column."""
    path = scratch(spark)
    quoted = F.transform(F.array(*[F.coalesce(f"c{k}", F.lit("")) for k in range(5)]), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    raw(spark, sf_dir).select(F.array_join(F.when(c("c4").cast("int") % 10 == 3, F.slice(quoted, 1, 2)).otherwise(quoted), ",").alias("value")).write.text(path)
    return ingest.prepare(ingest.read_delimited(spark, path, 5, header=False), SHAPE, "bank").groupBy("reason").agg(F.count("*").alias("n"))


@register("k06_rejects", f"WITH {_RAW} SELECT 'empty' AS reason, description FROM raw WHERE amount IS NULL")
def k06(spark, sf_dir):
    return ingest.rejected(ingest.prepare(raw(spark, sf_dir), SHAPE, "bank")).select("reason", "description")


def scratch(spark) -> str:
    """A folder that driver and executors share, for files that a query writes and reads."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{shared.rstrip('/')}/export-{uuid.uuid4().hex}"


@register("s01_delimited", f"WITH {_RAW} SELECT source, count(*) AS n, round(sum(amount), 2) AS total FROM (SELECT 'bank' AS source, amount FROM raw WHERE amount IS NOT NULL) GROUP BY 1")
def s01(spark, sf_dir):
    path = scratch(spark)
    raw(spark, sf_dir).write.csv(path, header=True, sep=";", quoteAll=True)
    d = ingest.good(ingest.prepare(ingest.read_delimited(spark, path, 5, ";"), SHAPE, "bank"))
    return d.groupBy("source").agg(F.count("*").alias("n"), cents("amount").alias("total"))


_LINES = f"{OTXN_SQL} SELECT count(*) AS n, round(sum(-amount), 2) AS total, count(DISTINCT description) AS names FROM otxn"


@register("s02_pattern", f"WITH {OTXN_SQL} SELECT description, count(*) AS n, round(sum(amount), 2) AS total FROM otxn GROUP BY 1")
def s02(spark, sf_dir):
    path = scratch(spark)
    t = tables.otxn(spark, sf_dir)
    lines = t.select(F.format_string("%s | %s | %s", F.date_format("date", "MM/dd/yyyy"), "description", F.format_number("amount", 2)).alias("value"))
    others = spark.createDataFrame([("",), ("opening balance",)], "value string")
    lines.unionByName(others).withColumn("value", F.regexp_replace("value", '"', "'")).select(F.col("value").alias("01/01/2001 | a header that looks like a row | 5.00")).write.csv(path, header=True, quote="", sep="\x01", emptyValue="")
    d = ingest.good(ingest.prepare(ingest.read_pattern(spark, path, r"(\d\d/\d\d/\d{4}) \| (.*?) \| (-?[\d,.]+)", header=True), ingest.CARD, "x"))
    return d.groupBy("description").agg(F.count("*").alias("n"), cents("amount").alias("total"))


@register("s03_card", f"WITH {OTXN_SQL} SELECT location, count(*) AS n, round(sum(amount), 2) AS total FROM otxn GROUP BY 1")
def s03(spark, sf_dir):
    """A card export, read by its header."""
    path = scratch(spark)
    t = tables.otxn(spark, sf_dir)
    t.select(F.date_format("date", "MM/dd/yyyy").alias("Date"), F.col("location").alias("Description"), F.col("amount").cast("string").alias("Amount")).write.csv(path, header=True)
    d = ingest.good(ingest.prepare(ingest.read_delimited(spark, path, 3), ingest.CARD, "card")).withColumnRenamed("description", "place")
    return d.groupBy(F.col("place").alias("location")).agg(F.count("*").alias("n"), cents("amount").alias("total"))


@register("s04_bank_lines", f"WITH {_LINES}")
def s04(spark, sf_dir):
    path = scratch(spark)
    t = tables.otxn(spark, sf_dir)
    t.select(F.format_string("%s  %s  %s  %s", F.date_format("date", "MM/dd/yyyy"), "description", F.format_number("amount", 2), F.format_number(F.lit(1000.5), 2)).alias("value")).write.text(path)
    d = ingest.good(ingest.prepare(ingest.read_pattern(spark, path, ingest.BANK_LINE), ingest.BANK, "bank"))
    return d.agg(F.count("*").alias("n"), cents("amount").alias("total"), F.countDistinct("description").alias("names"))


@register("s05_sources", f"WITH {_RAW} SELECT source, n * 1 AS n FROM (SELECT 'a' AS source, count(*) AS n FROM raw WHERE amount IS NOT NULL UNION ALL SELECT 'b', count(*) FROM raw WHERE amount IS NOT NULL)")
def s05(spark, sf_dir):
    path = scratch(spark)
    raw(spark, sf_dir).write.csv(path, header=True)
    return ingest.source_counts(ingest.read_sources(spark, [(path, "a", SHAPE), (f"{path}-that-is-missing", "none", SHAPE), (path, "b", SHAPE)]))


@register("s06_supplemental", f"WITH {OTXN_SQL} SELECT source AS status, count(*) AS n, round(sum(CASE WHEN txn_id % 5 = 0 THEN 0 ELSE amount END), 2) AS total, count(CASE WHEN txn_id % 4 <> 0 THEN 1 END) AS dated FROM otxn GROUP BY 1")
def s06(spark, sf_dir):
    path = scratch(spark)
    t = tables.otxn(spark, sf_dir)
    t.select(
        F.when(F.col("txn_id") % 4 == 0, "soon").otherwise(F.date_format("date", "M/d/yyyy")).alias("Date"),
        F.col("source").alias("Status"),
        F.when(F.col("txn_id") % 5 == 0, "n/a").otherwise(F.format_number("amount", 2)).alias("Amount"),
    ).write.csv(path, header=True)
    d = ingest.read_supplemental(spark, path)
    return d.groupBy("status").agg(F.count("*").alias("n"), cents("amount").alias("total"), F.count("date").alias("dated"))


@register("s08_by_header", f"WITH {OTXN_SQL} SELECT description, count(*) AS n FROM (SELECT description FROM otxn UNION ALL SELECT location FROM otxn) GROUP BY 1")
def s08(spark, sf_dir):
    t = tables.otxn(spark, sf_dir)
    one = ingest.by_header(t.select(F.col("date").alias("Trans Date"), F.col("description").alias("Payee"), F.col("amount").alias("Amount USD")))
    two = ingest.by_header(t.select(F.col("amount").alias("Debit"), F.col("location").alias("Merchant name"), F.col("date").alias("Posting date")))
    return one.unionByName(two).groupBy("description").agg(F.count("*").alias("n"))


@register("s09_rule_table", "SELECT 'brand ' || p_brand AS pattern, p_brand AS merchant, count(*) AS n, 'x|y' AS tags FROM part GROUP BY ALL")
def s09(spark, sf_dir):
    path = scratch(spark)
    parts = tables.table(spark, sf_dir, "part")
    parts.select(F.concat(F.lit("brand "), "p_brand").alias("Pattern"), F.col("p_brand").alias("Merchant"), F.lit("Parts").alias("Category"), F.lit("").alias("Subcategory"), F.lit("X| y |").alias("Tags")).unionByName(
        spark.createDataFrame([("", "none", "c", "", "")], "Pattern string, Merchant string, Category string, Subcategory string, Tags string")
    ).write.csv(path, header=True)
    return ingest.read_rule_table(spark, path).groupBy("pattern", "merchant", F.array_join("tags", "|").alias("tags")).agg(F.count("*").alias("n"))


@register("s10_source_counts", f"WITH {TXN_SQL} SELECT source, count(*) AS n FROM txn GROUP BY source")
def s10(spark, sf_dir):
    return ingest.source_counts(tables.txn(spark, sf_dir))


def _profiled(spark, sf_dir):
    t = tables.table(spark, sf_dir, "orders")
    return t.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.format_number("o_totalprice", 2).alias("price"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderkey") % 4 == 0, "").otherwise(F.concat(F.lit("order "), "o_orderkey")).alias("note"),
        F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("cost"),
        F.date_format("o_orderdate", "M-d-yyyy").alias("dashed"),
    )


_PROFILED = """o AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, format('{:,.2f}', o_totalprice) AS price, o_custkey::VARCHAR AS customer, o_orderpriority AS priority, CASE WHEN o_orderkey % 4 <> 0 THEN 'order ' || o_orderkey END AS note, '$' || format('{:,.2f}', o_totalprice) AS cost, month(o_orderdate) || '-' || day(o_orderdate) || '-' || year(o_orderdate) AS dashed FROM orders),
    cells AS (SELECT name, value FROM o UNPIVOT INCLUDE NULLS (value FOR name IN (day, price, customer, priority, note, cost, dashed)))"""


@register(
    "t01_column_types",
    f"""WITH {_PROFILED}, f AS (SELECT name, count(value) AS n, count(DISTINCT value) AS d, avg(regexp_matches(value, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')::INT) AS iso, avg(regexp_matches(value, '^\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}$')::INT) AS dash,
        avg(regexp_matches(value, '^\\$[\\d,]+\\.?\\d*$')::INT) AS money, avg(regexp_matches(value, '^-?[\\d,]+\\.?\\d*$')::INT) AS number FROM cells GROUP BY name)
    SELECT name, CASE WHEN iso >= 0.8 THEN 'date yyyy-MM-dd' WHEN dash >= 0.8 THEN 'date MM-dd-yyyy' WHEN money >= 0.8 OR number >= 0.8 AND name = 'price' THEN 'currency' WHEN number >= 0.8 THEN 'number' WHEN d <= 15 AND n >= 5 THEN 'categorical' ELSE 'text' END AS type FROM f""",
)
def t01(spark, sf_dir):
    return profile.column_profile(_profiled(spark, sf_dir)).select("name", "type")


@register(
    "t02_column_profile",
    f"""WITH {_PROFILED}, k AS (SELECT name, array_to_string(list(value ORDER BY value), '|') AS samples FROM (SELECT name, value, row_number() OVER (PARTITION BY name ORDER BY value) AS r FROM (SELECT DISTINCT name, value FROM cells WHERE value IS NOT NULL)) WHERE r <= 5 GROUP BY name)
    SELECT name, count(value) AS filled, round(1 - count(value) / count(*), 6) AS blank_share, count(DISTINCT value) AS "distinct", any_value(samples) AS samples FROM cells JOIN k USING (name) GROUP BY name""",
)
def t02(spark, sf_dir):
    found = profile.column_profile(_profiled(spark, sf_dir))
    return found.select("name", "filled", F.round("blank_share", 6).alias("blank_share"), "distinct", F.array_join("samples", "|").alias("samples"))


@register("t02_value_counts", f"WITH {_PROFILED} SELECT name, value, count(*) AS n FROM cells WHERE value IS NOT NULL AND name IN (SELECT name FROM cells GROUP BY name HAVING count(DISTINCT value) <= 20) GROUP BY ALL")
def t02b(spark, sf_dir):
    return profile.value_counts(_profiled(spark, sf_dir))


_SAMPLES = "(SELECT string_agg(description || ' ' || round(amount, 2), '|' ORDER BY description, amount) FROM (SELECT DISTINCT description, amount FROM txn WHERE amount {} 0 ORDER BY description, amount LIMIT {}))"


@register(
    "t03_signs",
    f"""WITH {TXN_SQL}, s AS (SELECT sum((amount >= 0)::INT) AS positive, sum((amount < 0)::INT) AS negative, round(sum(greatest(amount, 0)), 2) AS positive_total, round(-sum(least(amount, 0)), 2) AS negative_total FROM txn), p AS (SELECT *, positive / (positive + negative) AS share FROM s)
    SELECT positive, negative, positive_total, negative_total, round(share, 6) AS positive_share, share < 0.3 OR share <= 0.7 AND positive_total <= negative_total AS negate, CASE WHEN share < 0.3 OR share <= 0.7 AND positive_total <= negative_total THEN 'expenses negative' ELSE 'expenses positive' END AS convention,
           {_SAMPLES.format('<', 10)} AS sample_credits FROM p""",
)
def t03(spark, sf_dir):
    s = profile.sign_profile(tables.txn(spark, sf_dir))
    told = F.array_join(F.transform("sample_credits", lambda x: F.concat_ws(" ", x["description"], F.round(x["amount"], 2).cast("string"))), "|")
    return s.withColumns({**{n: F.round(n, 6 if n == "positive_share" else 2) for n in ("positive_total", "negative_total", "positive_share")}, "sample_credits": told})


@register(
    "t04_amounts",
    f"""WITH {OTXN_SQL}, a AS (SELECT description, round(amount, 2) * CASE WHEN txn_id % 7 = 0 THEN -1 ELSE 1 END AS v, txn_id FROM otxn WHERE txn_id % 7 < 2 OR txn_id % 101 <> 0)
    SELECT sum((txn_id % 7 = 0)::INT) AS in_parentheses, sum((txn_id % 7 = 1)::INT) AS with_symbol, '2' AS decimal_places, false AS mixed, sum((v > 0)::INT) AS positive, sum((v < 0)::INT) AS negative,
           (SELECT string_agg(description || ' ' || v, '|' ORDER BY description, v) FROM (SELECT * FROM a WHERE v > 0 ORDER BY description, v LIMIT 5)) AS sample_positive, (SELECT string_agg(description || ' ' || v, '|' ORDER BY description, v) FROM (SELECT * FROM a WHERE v < 0 ORDER BY description, v LIMIT 5)) AS sample_negative FROM a""",
)
def t04(spark, sf_dir):
    found = profile.amount_notes(raw(spark, sf_dir).withColumn("c1", F.regexp_replace("c1", " store ..$", "")), "c2", "c1")
    told = lambda n: F.array_join(F.transform(n, lambda x: F.concat_ws(" ", x["description"], F.round(x["amount"], 2).cast("string"))), "|").alias(n)
    return found.select("in_parentheses", "with_symbol", F.array_join("decimal_places", ",").alias("decimal_places"), "mixed", "positive", "negative", told("sample_positive"), told("sample_negative"))


_LAYOUT = "SELECT '{0}' AS file, count(*) AS n, sum(regexp_matches(line, '^\\d{{2}}/\\d{{2}}/\\d{{4}}\\s{{2,}}')::INT) AS dates, sum(regexp_matches(line, '\\s+-?[\\d,]+\\.\\d{{2}}\\s*$')::INT) AS amounts, bool_or(regexp_matches(line, '\\d{{1,3}},\\d{{3}}')) AS thousands, {1} AS delimiter FROM {0}"


@register(
    "t05_layout",
    f"""WITH {OTXN_SQL}, bank AS (SELECT strftime(date, '%m/%d/%Y') || '  ' || description || '  ' || format('{{:,.2f}}', amount) AS line FROM otxn), export AS (SELECT strftime(date, '%m/%d/%Y') || ';' || description || ';' || format('{{:,.2f}}', amount) AS line FROM otxn), prose AS (SELECT description AS line FROM otxn),
    f AS ({_LAYOUT.format("bank", "NULL")} UNION ALL {_LAYOUT.format("export", "';'")} UNION ALL {_LAYOUT.format("prose", "NULL")})
    SELECT file, n, dates, amounts, thousands, CASE WHEN dates >= 3 AND amounts >= 3 THEN 'fixed_width' WHEN delimiter IS NOT NULL THEN 'csv' ELSE 'unknown' END AS layout, delimiter FROM f""",
)
def t05(spark, sf_dir):
    """A statement in columns, a delimited export and plain names."""
    t = tables.otxn(spark, sf_dir).select(F.date_format("date", "MM/dd/yyyy").alias("day"), "description", F.format_number("amount", 2).alias("money"))
    files = {"bank": F.concat_ws("  ", "day", "description", "money"), "export": F.concat_ws(";", "day", "description", "money"), "prose": F.col("description")}
    told = [profile.layout(t.select(line.alias("value"))).select(F.lit(n).alias("file"), "n", "dates", "amounts", "thousands", "layout", "delimiter") for n, line in files.items()]
    return told[0].unionByName(told[1]).unionByName(told[2])


@register("k05_classified", f"WITH {tables.CLASSIFIED_SQL} SELECT strftime(date, '%Y-%m') AS month, category, count(*) AS n FROM cls GROUP BY ALL")
def k05(spark, sf_dir):
    path = scratch(spark)
    sinks.write_classified(tables.spending(spark, sf_dir).drop("tag_sources"), path)
    back = spark.read.parquet(path)
    return back.groupBy(F.col("month").cast("string").alias("month"), "category").agg(F.count("*").alias("n"))


@register(
    "s01_ordered_records",
    """WITH r AS (SELECT o_orderkey, o_orderpriority, o_totalprice, row_number() OVER (PARTITION BY o_orderkey % 3 ORDER BY o_orderkey) AS nth FROM orders)
    SELECT o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total, sum(nth * (o_orderkey % 1000))::BIGINT AS order_sum FROM r GROUP BY 1""",
)
def s01_records(spark, sf_dir):
    """Orders exported to three files with line ends in quoted cells, read back with each row's place in its file."""
    path = scratch(spark)
    orders = tables.table(spark, sf_dir, "orders").withColumn("file", c("o_orderkey") % 3)
    line = F.concat_ws(",", c("o_orderkey").cast("string"), F.concat(F.lit('"'), c("o_orderpriority"), F.lit('\nsecond ""line""'), F.lit('"')), c("o_totalprice").cast("string"))
    orders.repartition("file").sortWithinPartitions("file", "o_orderkey").select(line.alias("value"), "file").write.partitionBy("file").text(path)
    rows = records.read_ordered(spark, path, 3, header=False)
    place = F.row_number().over(Window.partitionBy("file").orderBy("offset"))
    read = rows.select(F.split_part("c1", F.lit("\n"), F.lit(1)).alias("priority"), c("c0").cast("long").alias("key"), c("c2").cast("double").alias("amount"), place.alias("nth"))
    return read.groupBy("priority").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"), F.sum(c("nth") * (c("key") % 1000)).alias("order_sum"))


@register(
    "t02_merged_sketches",
    """SELECT 'c_acctbal' AS name, count(*) AS rows, count(c_acctbal) AS filled, count(c_acctbal) AS numeric, true AS distinct_close, true AS median_close, NULL::BIGINT AS most_frequent FROM customer
    UNION ALL SELECT 'c_mktsegment', count(*), count(c_mktsegment), 0, true, NULL, (SELECT max(n) FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment)) FROM customer""",
)
def t02_merged(spark, sf_dir):
    """Profiles of three parts of the customers, merged; estimates are compared with exact figures and are within their stated errors."""
    df = tables.table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    parts = [sketches.sketched(df.filter(F.pmod("c_nationkey", F.lit(3)) == k).drop("c_nationkey"), str(k)) for k in range(3)]
    told = sketches.described(sketches.merged(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    exact = sketches.cells(df.drop("c_nationkey")).groupBy("name").agg(F.countDistinct("value").alias("exact"))
    middle = F.broadcast(told.filter("name = 'c_acctbal'").select(F.get("quantiles", F.lit(2)).alias("median")))  # one row
    below = df.join(middle).agg(F.avg((c("c_acctbal") <= c("median")).cast("int")).alias("below"))
    found = told.join(exact, "name").join(F.broadcast(below))  # one row
    named = lambda name, value: F.when(c("name") == name, value)
    return found.select(
        "name",
        "rows",
        "filled",
        "numeric",
        (F.abs(c("distinct") / c("exact") - 1) < 0.05).alias("distinct_close"),
        named("c_acctbal", F.abs(c("below") - 0.5) < 0.03).alias("median_close"),
        named("c_mktsegment", F.array_max(F.transform("frequent", lambda x: x["n"]))).alias("most_frequent"),
    )
