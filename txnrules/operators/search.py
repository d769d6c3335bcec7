"""Text search by an index of trigrams with bitmaps of blocks.

Rows are written in blocks, each a folder: rows with like text are together, as blocks are ranges of the text. The posting table has, per sequence of three characters
and word of 63 block numbers, a bitmap of the blocks in which some row's text has it. A search intersects the bitmaps of all trigrams of what is wanted, reads only the blocks that are left, and
tests their rows; so it finds what `contains` over all rows finds. Case is ignored as Spark's lower does. A wanted text of fewer than three characters has no trigram, and all blocks are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrules.functions import literals

BITS = 63
BLOCKS = 64
MOST_BLOCKS = 100_000  # block numbers that a search brings to the driver to name the folders it reads


def _searched(columns: list[str]) -> Column:
    """The texts of a row, in lower case, between signs that no search crosses."""
    return F.concat_ws("\n", *[F.lower(F.coalesce(c, F.lit(""))) for c in columns])


def write_index(df: DataFrame, folder: str, columns: list[str], blocks: int = BLOCKS) -> None:
    """Write df's rows in at most `blocks` blocks by the first of the columns, and the postings of the texts of all of them."""
    if not 0 < blocks <= MOST_BLOCKS:
        raise ValueError(f"between 1 and {MOST_BLOCKS} blocks")
    spread = F.xxhash64(*[F.col(c).cast("string") for c in df.columns if not dict(df.dtypes)[c].startswith("map")])  # equal texts may lie in several blocks
    numbered = df.repartitionByRange(blocks, *[F.col(c) for c in columns[:1]], spread).withColumn("block", F.spark_partition_id())
    numbered.write.mode("overwrite").partitionBy("block").parquet(f"{folder}/rows")
    rows = df.sparkSession.read.schema(numbered.schema).parquet(f"{folder}/rows")
    texts = rows.select(_searched(columns).alias("text"), "block").distinct().withColumn("chars", F.split("text", "")).filter(F.size("chars") >= literals.GRAM)
    grams = texts.select(F.explode(literals.grams(F.col("chars"))).alias("gram"), "block").distinct()
    bit = F.expr(f"shiftleft(1L, pmod(block, {BITS}))")
    grams.groupBy("gram", F.floor(F.col("block") / BITS).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).hint("rebalance").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{folder}/postings")


def blocks_with(spark: SparkSession, folder: str, wanted: str) -> list[int] | None:
    """Numbers of the blocks that can hold the text; None if it is too short to tell."""
    low = wanted.lower()
    grams = sorted({low[k : k + literals.GRAM] for k in range(len(low) - literals.GRAM + 1)})
    if not grams:
        return None
    found = spark.read.parquet(f"{folder}/postings").filter(F.col("gram").isin(grams)).groupBy("word").agg(F.count("*").alias("n"), F.bit_and("bits").alias("bits")).filter(F.col("n") == len(grams))
    numbers = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.call_function("shiftright", F.col("bits"), k).bitwiseAND(1) == 1)
    return sorted(r.block for r in found.select(F.explode(F.transform(numbers, lambda k: F.col("word") * BITS + k)).alias("block")).collect())


def search(spark: SparkSession, folder: str, schema: str, columns: list[str], wanted: str) -> DataFrame:
    """Rows whose text in one of the columns contains what is wanted, ignoring case; reads the blocks that can hold it only. schema is that of the rows written."""
    rows = spark.read.schema(f"{schema}, block int").parquet(f"{folder}/rows")
    blocks = blocks_with(spark, folder, wanted)
    if blocks is not None:
        rows = rows.filter(F.col("block").isin(blocks)) if blocks else rows.filter(F.lit(False))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(wanted.lower())), F.lit(False))
    return rows.filter(hit).drop("block")
