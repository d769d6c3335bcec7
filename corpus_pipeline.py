"""A corpus pipeline of five stages, each applying one operator of txnrules.llm to all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; stages but the last return the columns of documents, whatever further columns these
have. A stage's result is lazy and reads tables that the stage wrote in the shared folder. The next stage called deletes them, so write a result as
Parquet, and reread it as the next one's docs, before that, as `run` does. No other operator's tables are touched.

Nulls, in every stage: a null text is an empty one, and null ids are kept. Repeated rows are documents of their own. Texts are read
whole, however long. An empty table gives an empty result. Each stage says what that and ties mean for it.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrules.llm import bpe, decontaminate, jaccard_join, line_dedup, quality_classifier
from txnrules.llm.runtime import cut, delete, table, tables

_left: list[str] = []  # tables of the stage called last


def _stage(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    @functools.wraps(function)
    def run_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _left)
        with tables() as made:
            found = function(spark, docs, sf_dir)
        _left.extend(made)
        return found

    return run_stage


@_stage
def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more; it learns word vectors from docs and weights from the labels that are not held out.

    Null and empty texts have a score like any other; equal texts have one score. Without labels of both kinds every score is the labels' mean, or 0.5.
    """
    found = quality_classifier.score(docs, *quality_classifier.learn(spark, sf_dir, docs))
    return found.filter("score >= 0.5").select("row.*")


@_stage
def lines(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents cut down to the lines that are equal or similar to no earlier line; of similar lines the first stays, by id and place (null ids last).

    A document that had words and has none left, because all its lines occur earlier, goes. Null, empty and wordless texts stay as they are.
    """
    cleaned = line_dedup.dedup(docs, before="text before")
    worded = lambda c: F.col(c).rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    emptied = worded("text before") & ~worded("text")
    return cleaned.filter(~F.coalesce(emptied, F.lit(False))).drop("text before")


@_stage
def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of similar documents, the one with the least id (null ids last, then the earlier row).

    Texts without words that are equal but for white space are one class; every null text stays.
    """
    return jaccard_join.first_of_each(docs)


@_stage
def contamination(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; those with null and empty texts stay. An empty benchmark leaves all."""
    return decontaminate.without_documents(docs, table(spark, sf_dir, "benchmark"))


@_stage
def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text of every document; a null or empty text has no tokens."""
    lexicon = bpe.ship(spark, bpe.frequent_words(docs), bpe.default_vocabulary())
    return bpe.encode(docs, lexicon).select(F.col("key").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("contamination", contamination), ("tokens", tokens)]

# A trained classifier, signatures and BPE can't be said in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """The last stage's result. What stages write on the way goes once it has been read; the last stage's docs stay."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        found = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            with tables() as kept:
                docs = cut(found)
            delete(spark, before)
            before = kept
    return found
