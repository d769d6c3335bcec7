"""Classifies a stream of transactions and keeps the state of `operators.state` up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from txnrules.functions.text import register_sql_functions
from txnrules.operators import state
from txnrules.operators.rules import RuleSet
from txnrules.operators.spend import with_buckets


def classified(stream: DataFrame, rules: RuleSet) -> DataFrame:
    """The classified stream with buckets; row-wise, so any sink and output mode can follow."""
    register_sql_functions(stream.sparkSession)
    return with_buckets(rules.classify(stream))


def keep_totals(stream: DataFrame, rules: RuleSet, folder: str, checkpoint: str, name: str = "stream", **trigger) -> StreamingQuery:
    """Start a query that adds every micro-batch to the state in `folder`, as the batch `name`-<number>.

    A micro-batch writes its own partitions, so months it doesn't touch stay as they are, and one that runs again after a failure replaces what it had written:
    each transaction counts once. Start it again with the same checkpoint to go on. `trigger` is what DataStreamWriter.trigger takes.
    """
    register_sql_functions(stream.sparkSession)

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            state.add(with_buckets(rules.classify(rows)), folder, f"{name}-{number}")
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()
