"""Column profiles that merge: sketches of each text column, per file or batch, stored and added up.

A profile row has, for one column: rows, filled cells, a HyperLogLog sketch of distinct values (relative error about 1.04 / sqrt(2 ** LG), 1.6 % at 12), a KLL sketch of the cells that are numbers (rank error about
1.7 % at 200), the least and greatest text, and at most CANDIDATES values with their counts, as a Misra-Gries summary: a value's count is too low by at most `short`, which is below filled / CANDIDATES, so
every value more frequent than that is there. Profiles of parts merge to the profile of the whole within these errors. `operators.profile` is exact and the default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LG = 12
CANDIDATES = 256
NUMBER = r"^\s*[-+]?(\d+(\.\d*)?|\.\d+)([eE][-+]?\d+)?\s*$"


def cells(df: DataFrame) -> DataFrame:
    """name, value: every cell of every column as text, blank ones as null."""
    each = [F.struct(F.lit(c).alias("name"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("value")) for c in df.columns]
    return df.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def _reduced(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Misra-Gries: the CANDIDATES values of the highest counts, all less the next count, which is added to `short`."""
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= CANDIDATES + 1)
    gathered = ranked.groupBy(*keys).agg(F.collect_list(F.struct("value", "n")).alias("all"), F.coalesce(F.max(F.when(F.col("rank") == CANDIDATES + 1, F.col("n"))), F.lit(0)).alias("less"))
    left = F.filter(F.transform("all", lambda x: F.struct(x["value"].alias("value"), (x["n"] - F.col("less")).alias("n"))), lambda x: x["n"] > 0)
    return gathered.select(*keys, F.sort_array(left).alias("frequent"), F.col("less").alias("short"))


def sketched(df: DataFrame, part: str) -> DataFrame:
    """The profile of one part (a file, a batch), a row per column."""
    rows = cells(df)
    number = F.when(F.col("value").rlike(NUMBER), F.expr("try_cast(value AS DOUBLE)"))
    totals = rows.groupBy("name").agg(
        F.count("*").alias("rows"),
        F.count("value").alias("filled"),
        F.hll_sketch_agg("value", LG).alias("distinct"),
        F.kll_sketch_agg_double(number).alias("numbers"),
        F.count(number).alias("numeric"),
        F.min("value").alias("least"),
        F.max("value").alias("greatest"),
    )
    frequent = _reduced(rows.filter("value IS NOT NULL").groupBy("name", "value").agg(F.count("*").alias("n")), ["name"])
    return totals.join(frequent, "name", "left").withColumn("part", F.lit(part))


def merged(profiles: DataFrame) -> DataFrame:
    """Stored profiles of parts as the profile of the whole."""
    some = F.filter(F.collect_list(F.when(F.col("numeric") > 0, F.col("numbers"))), lambda x: x.isNotNull())
    totals = profiles.groupBy("name").agg(
        F.sum("rows").alias("rows"),
        F.sum("filled").alias("filled"),
        F.hll_union_agg("distinct").alias("distinct"),
        some.alias("all_numbers"),
        F.sum("numeric").alias("numeric"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.coalesce(F.sum("short"), F.lit(0)).alias("short_before"),
    )
    fold = "aggregate(slice(all_numbers, 2, greatest(size(all_numbers) - 1, 0)), all_numbers[0], (a, b) -> kll_sketch_merge_double(a, b))"
    counted = profiles.select("name", F.explode("frequent").alias("x")).groupBy("name", F.col("x.value").alias("value")).agg(F.sum("x.n").alias("n"))
    joined = totals.withColumn("numbers", F.expr(f"CASE WHEN size(all_numbers) > 0 THEN {fold} END")).drop("all_numbers").join(_reduced(counted, ["name"]), "name", "left")
    return joined.withColumn("short", F.col("short_before") + F.coalesce("short", F.lit(0))).drop("short_before")


def described(profiles: DataFrame, quantiles: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Readable figures: name, rows, filled, distinct, numeric, quantiles (null without numbers), least, greatest, frequent (value, n), short."""
    points: Column = F.array(*[F.expr(f"CASE WHEN numeric > 0 THEN kll_sketch_get_quantile_double(numbers, {q}D) END") for q in quantiles])
    return profiles.select("name", "rows", "filled", F.hll_sketch_estimate("distinct").alias("distinct"), "numeric", F.when(F.col("numeric") > 0, points).alias("quantiles"), "least", "greatest", F.coalesce("frequent", F.array().cast("array<struct<value:string,n:bigint>>")).alias("frequent"), F.coalesce("short", F.lit(0)).alias("short"))
