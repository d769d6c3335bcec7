"""Longest-matching-blocks similarity of texts, worked out on distinct texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_ratio(text: str, pattern: str, threshold: float) -> float:
    """Best ratio of the pattern with a window of its length; a shorter text is compared whole. 0 if below the threshold."""
    text, pattern = text.lower(), pattern.lower()
    size = len(pattern)
    matcher = SequenceMatcher(b=pattern, autojunk=False)
    best = 0.0
    for at in range(max(1, len(text) - size + 1)):
        matcher.set_seq1(text[at : at + size] if len(text) >= size else text)
        if matcher.quick_ratio() >= max(threshold, best) and (ratio := matcher.ratio()) > best:
            best = ratio
            if best == 1:
                break
    return best if best >= threshold else 0.0


def with_similarity(df: DataFrame, pattern: str, name: str, text: str = "description", threshold: float = 0.8) -> DataFrame:
    """df with a column `name`: the ratio, 0 below the threshold. Each distinct text is compared once."""

    @F.pandas_udf("double")
    def ratio(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: window_ratio(t, pattern, threshold))

    told = df.select(text).filter(F.col(text).isNotNull()).distinct().withColumn(name, ratio(text))
    return df.join(told, text, "left").fillna(0.0, [name])


def closest(df: DataFrame, wanted: str, column: str, n: int = 3, least: float = 0.6) -> DataFrame:
    """The n distinct values most similar to `wanted`, with their ratio, at least `least`."""

    @F.pandas_udf("double")
    def ratio(values: pd.Series) -> pd.Series:
        matcher = SequenceMatcher(b=wanted.lower(), autojunk=False)

        def one(v: str) -> float:
            matcher.set_seq1(v.lower())
            return matcher.ratio()

        return values.map(one)

    # Else Spark would move the condition on the ratio, and with it the comparison, to before the distinct.
    told = df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("ratio", ratio.asNondeterministic()(column))
    return told.filter(F.col("ratio") >= least).orderBy(F.desc("ratio"), column).limit(n)
