"""Facet filters, searches and look-ups over classified transactions and merchants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrules.functions.text import element_id


@dataclass
class Facet:
    """kind: merchant, category, subcategory, location, tag, month (a key or first..last) or text."""

    kind: str
    value: str
    exclude: bool = False


def facet_test(f: Facet, texts: tuple[str, ...] = ("description",)) -> Column:
    value = F.lit(f.value.lower())
    if f.kind == "merchant":
        return (F.lower("merchant") == value) | (F.lower(element_id("merchant")) == value)
    if f.kind == "tag":
        return F.exists("tags", lambda t: F.lower(t) == value)
    if f.kind == "month":
        first, _, last = f.value.partition("..")
        return F.col("month").between(first, last or first)
    if f.kind == "text":
        found = F.lit(False)
        for t in texts:
            found = found | F.coalesce(F.contains(F.lower(t), value), F.lit(False))
        return found
    return F.lower(f.kind) == value


def facet_filter(facets: list[Facet], texts: tuple[str, ...] = ("description",)) -> Column:
    """Any excluding facet rejects; including ones are alternatives within a kind and all needed across kinds."""
    keep = F.lit(True)
    for f in (f for f in facets if f.exclude):
        keep = keep & ~F.coalesce(facet_test(f, texts), F.lit(False))
    for kind in {f.kind: None for f in facets if not f.exclude}:
        some = F.lit(False)
        for f in (f for f in facets if f.kind == kind and not f.exclude):
            some = some | F.coalesce(facet_test(f, texts), F.lit(False))
        keep = keep & some
    return keep


# The order in which kinds of facets are offered.
KIND_ORDER = {"tag": 0, "category": 1, "subcategory": 2, "location": 3, "merchant": 4}


def facet_values(df: DataFrame) -> DataFrame:
    """kind, value, parent, n: every value that can be filtered on, with its number of transactions. One pass over the transactions counts combinations; grouping sets and tags count these."""
    return values_of(df.groupBy("category", "subcategory", "location", "merchant", "tags").agg(F.count("*").alias("n")))


def values_of(combined: DataFrame) -> DataFrame:
    """`facet_values` from counts of combinations. Two small aggregates over the combinations' own: by text columns, and by tag."""
    sets = [["category"], ["category", "subcategory"], ["location"], ["merchant"]]
    grouped = combined.groupingSets(sets, "category", "subcategory", "location", "merchant").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    # The bits of g, from category to merchant, say which column a set leaves out.
    none = F.lit("")
    kind = F.when(F.col("g") == 0b0111, "category").when(F.col("g") == 0b0011, "subcategory").when(F.col("g") == 0b1101, "location").otherwise("merchant")
    value = F.when(kind == "category", F.col("category")).when(kind == "subcategory", F.col("subcategory")).when(kind == "location", F.col("location")).otherwise(F.col("merchant"))
    columns = grouped.select(kind.alias("kind"), value.alias("value"), F.when(kind == "subcategory", F.col("category")).otherwise(none).alias("parent"), "n").filter("kind <> 'location' OR value IS NOT NULL")
    tags = combined.select(F.explode("tags").alias("value"), "n").groupBy("value").agg(F.sum("n").alias("n")).select(F.lit("tag").alias("kind"), "value", none.alias("parent"), "n")
    return columns.unionByName(tags)


def suggestions(values: DataFrame, typed: str, n: int = 8) -> DataFrame:
    """First n facet values that contain what was typed, in the order of kinds."""
    rank = F.create_map(*[x for k, r in KIND_ORDER.items() for x in (F.lit(k), F.lit(r))])[F.col("kind")]
    return values.filter(F.contains(F.lower("value"), F.lit(typed.lower()))).orderBy(rank, "value", "parent").limit(n)


def find_merchant(df: DataFrame, wanted: str) -> DataFrame:
    """Merchants by the best way that finds any: exact, ignoring case, part of the name, part of a transaction's text."""
    low = F.lit(wanted.lower())
    rank = F.when(F.col("merchant") == wanted, 1).when(F.lower("merchant") == low, 2).when(F.contains(F.lower("merchant"), low), 3).when(F.contains(F.lower("description"), low), 4)
    found = df.withColumn("how", rank).filter("how IS NOT NULL").groupBy("merchant").agg(F.min("how").alias("how"))
    best = found.agg(F.min("how").alias("best"))
    return found.join(F.broadcast(best), F.col("how") == F.col("best")).select("merchant", "how")


def text_matches(df: DataFrame, wanted: str) -> DataFrame:
    """Transactions that contain the text, by merchant, largest size first."""
    hits = df.filter(F.contains(F.lower("description"), F.lit(wanted.lower())))
    return hits.groupBy("merchant").agg(F.count("*").alias("n"), F.sum(F.abs("amount")).alias("size")).orderBy(F.desc("size"), "merchant")
