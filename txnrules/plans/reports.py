"""Queries for facet filters, searches and look-ups (X*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrules.functions import values as V
from txnrules.functions.similarity import closest
from txnrules.operators import facets, search, spend, state
from txnrules.operators.facets import Facet
from txnrules.plans import tables
from txnrules.plans.aggregations import MERCHANTS_SQL, PLACED_SQL, placed
from txnrules.plans.registry import register
from txnrules.plans.tables import SPENDING_SQL
from txnrules.sources import store

c = F.col


def filtered(name: str, chosen: list[Facet], sql: str, texts: tuple[str, ...] = ("description",)) -> None:
    def query(spark, sf_dir):
        kept = tables.spending(spark, sf_dir).filter(facets.facet_filter(chosen, texts))
        return kept.groupBy("merchant", "month").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))

    register(name, f"WITH {SPENDING_SQL} SELECT merchant, month, count(*) AS n, round(sum(amount), 2) AS total FROM sp WHERE {sql} GROUP BY ALL")(query)


filtered("x01_facets", [Facet("category", "hardware"), Facet("category", "heavy"), Facet("location", "nation_1"), Facet("tag", "large", True)], "category IN ('Hardware', 'Heavy') AND location = 'NATION_1' AND NOT list_contains(tags, 'large')")
filtered("x02_facet_kinds", [Facet("merchant", "Bolt_Co"), Facet("subcategory", "COLD"), Facet("tag", "TOOLS")], "merchant = 'Bolt Co' AND subcategory = 'Cold' AND list_contains(tags, 'tools')")
filtered("x03_month_range", [Facet("month", "1996-11..1997-02"), Facet("month", "1998-01")], "month BETWEEN '1996-11' AND '1997-02' OR month = '1998-01'")
filtered("x04_text_search", [Facet("text", "anvil"), Facet("text", "nation_5")], "contains(lower(description), 'anvil') OR contains(lower(location), 'nation_5')", ("description", "location"))


@register("x05_months_selected", f"WITH {SPENDING_SQL} SELECT count(DISTINCT month) AS n FROM sp WHERE month BETWEEN '1996-11' AND '1997-02' AND category = 'Heavy'")
def x05(spark, sf_dir):
    d = tables.spending(spark, sf_dir).filter(facets.facet_filter([Facet("category", "heavy")]))
    wanted = spark.range(1).select(F.explode(V.months_between_keys("1996-11", "1997-02")).alias("month"))
    return d.join(wanted, "month", "left_semi").agg(F.countDistinct("month").alias("n"))


_VALUES = f"""{SPENDING_SQL}, vals AS (SELECT 'tag' AS kind, t AS value, '' AS parent, count(*) AS n FROM (SELECT unnest(tags) AS t FROM sp) GROUP BY t UNION ALL SELECT 'category', category, '', count(*) FROM sp GROUP BY category
    UNION ALL SELECT 'subcategory', subcategory, category, count(*) FROM sp GROUP BY subcategory, category UNION ALL SELECT 'location', location, '', count(*) FROM sp GROUP BY location UNION ALL SELECT 'merchant', merchant, '', count(*) FROM sp GROUP BY merchant)"""


@register("x06_facet_values", f"WITH {_VALUES} SELECT * FROM vals")
def x06(spark, sf_dir):
    return facets.values_of(state.combinations(tables.kept(spark, sf_dir, "facets")))


@register("x06_suggestions", f"WITH {_VALUES} SELECT kind, value FROM vals WHERE contains(lower(value), 'co') ORDER BY list_position(['tag', 'category', 'subcategory', 'location', 'merchant'], kind), value, parent LIMIT 8")
def x06b(spark, sf_dir):
    return facets.suggestions(facets.values_of(state.combinations(tables.kept(spark, sf_dir, "facets"))), "CO").select("kind", "value")


@register("x07_months", f"WITH {SPENDING_SQL} SELECT DISTINCT month FROM sp")
def x07(spark, sf_dir):
    return tables.spending(spark, sf_dir).select("month").distinct().orderBy("month")


@register("x08_merchant_filters", f"WITH {PLACED_SQL} SELECT DISTINCT merchant FROM pl WHERE view = 'large' AND category = 'Subscriptions' AND list_has_any(tags, ['large', 'red']) AND merchant IN (SELECT merchant FROM sp WHERE month = '1996-05' AND contains(lower(location), 'tion_1'))")
def x08(spark, sf_dir):
    p = placed(spark, sf_dir)
    rows = tables.spending(spark, sf_dir).filter((c("month") == "1996-05") & F.contains(F.lower("location"), F.lit("tion_1")))
    kept = p.filter((c("view") == "large") & (c("category") == "Subscriptions") & F.arrays_overlap("tags", F.array(F.lit("large"), F.lit("red"))))
    return kept.join(rows.select("merchant"), "merchant", "left_semi").select("merchant").distinct()


@register("x09_find_merchant", f"WITH {SPENDING_SQL} SELECT DISTINCT merchant, 3 AS how FROM sp WHERE contains(lower(merchant), 'bol')")
def x09(spark, sf_dir):
    return facets.find_merchant(tables.spending(spark, sf_dir), "BOL")


@register("x10_text_matches", f"WITH {SPENDING_SQL} SELECT merchant, count(*) AS n, round(sum(abs(amount)), 2) AS size FROM sp WHERE contains(lower(description), 'red') GROUP BY merchant")
def x10(spark, sf_dir):
    return facets.text_matches(tables.spending(spark, sf_dir), "red").withColumn("size", F.round("size", 2))


_SHOWN = "merchant string, description string, location string, source string, amount double"


def index(spark, sf_dir):
    """The text index over classified transactions, written once a session."""
    rows = tables.spending(spark, sf_dir).select("merchant", "description", "location", "source", "amount")
    return store.folder_once(spark, "text-index", [f"{sf_dir}/{n}.parquet" for n in tables.INPUTS], lambda folder: search.write_index(rows, folder, ["description", "location"]))


@register("x04_indexed_search", f"WITH {SPENDING_SQL} SELECT description, location, source, count(*) AS n, round(sum(amount), 2) AS total FROM sp WHERE contains(lower(description), 'd anv') OR contains(lower(location), 'd anv') GROUP BY ALL")
def x04_indexed(spark, sf_dir):
    found = search.search(spark, index(spark, sf_dir), _SHOWN, ["description", "location"], "D ANV")
    return found.groupBy("description", "location", "source").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


@register("x10_indexed_matches", f"WITH {SPENDING_SQL} SELECT merchant, count(*) AS n, round(sum(abs(amount)), 2) AS size FROM sp WHERE contains(lower(description), 'brand#13') GROUP BY merchant")
def x10_indexed(spark, sf_dir):
    found = search.search(spark, index(spark, sf_dir), _SHOWN, ["description"], "Brand#13")
    return found.groupBy("merchant").agg(F.count("*").alias("n"), F.round(F.sum(F.abs("amount")), 2).alias("size"))


@register("x11_closest")
def x11(spark, sf_dir):
    """Names most like a misspelt one; the ratio has no SQL form."""
    return closest(tables.spending(spark, sf_dir), "Gizmoo Ink", "merchant").select("merchant", F.round("ratio", 4).alias("ratio"))


@register("x12_one_category", f"WITH {MERCHANTS_SQL} SELECT merchant, round(total, 2) AS total FROM mer WHERE lower(category) = 'fasteners'")
def x12(spark, sf_dir):
    return spend.by_merchant(tables.spending(spark, sf_dir)).filter(F.lower("category") == "fasteners").select("merchant", F.round("total", 2).alias("total"))


@register("x12_named_views", f"WITH {PLACED_SQL} SELECT view, merchant FROM pl WHERE view IN ('large', 'refunds')")
def x12b(spark, sf_dir):
    return placed(spark, sf_dir).filter(c("view").isin("large", "refunds")).select("view", "merchant")
