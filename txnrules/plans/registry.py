"""All registered queries: name -> function of (spark, folder of tables), and name -> DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnrules.operators import spend
from txnrules.plans import tables


def flagship(spark, sf_dir):
    """First-match classification, buckets, totals by category."""
    found = spend.by(tables.spending(spark, sf_dir), "category", "subcategory")
    return found.select("category", "subcategory", "count", F.round("total", 2).alias("total"))


QUERIES, SQL = {}, {}


def register(name: str, sql: str | None = None):
    """Registers the decorated query, with the SQL it must agree with."""

    def put(query):
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return put


def queries():
    from txnrules.plans import aggregations, conditions, joins, reports, scalars  # noqa: F401

    return dict(QUERIES)


def oracle_sql():
    queries()
    return dict(SQL)
