"""Looking up rows of a supplemental source for each transaction, as joins.

For equal keys the source is aggregated by key before the join, so nothing has to be regrouped and a hot key costs one
row. For other conditions the transaction's own key regroups the matches.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 62  # sizes of pieces of a range, as powers of two
BUCKETS = 256  # stretches of values that are numbered at once
COARSE = 12  # the topmost levels, whose cells are broadcast: fewer than 2 ** COARSE


def exists(df: DataFrame, source: DataFrame, on: dict[str, str], name: str = "found") -> DataFrame:
    """Flag: some row of source has the same key. on: column of df -> column of source."""
    keys = source.select(*[F.col(s).alias(f"_{s}") for s in on.values()]).distinct().withColumn(name, F.lit(True))
    return df.join(keys, [F.col(d) == F.col(f"_{s}") for d, s in on.items()], "left").drop(*[f"_{s}" for s in on.values()]).fillna(False, [name])


def without(df: DataFrame, source: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows of df that have no row in source."""
    keys = source.select(*[F.col(s).alias(f"_{s}") for s in on.values()])
    return df.join(keys, [F.col(d) == F.col(f"_{s}") for d, s in on.items()], "left_anti")


def aggregated(df: DataFrame, source: DataFrame, on: dict[str, str], aggregates: dict[str, Column], where: Column | None = None, default: dict[str, object] | None = None) -> DataFrame:
    """df with the aggregates of the rows of source that have its key; `default` fills those without any."""
    rows = source.filter(where) if where is not None else source
    per_key = rows.groupBy(*[F.col(s).alias(f"_{s}") for s in on.values()]).agg(*[a.alias(n) for n, a in aggregates.items()])
    joined = df.join(per_key, [F.col(d) == F.col(f"_{s}") for d, s in on.items()], "left").drop(*[f"_{s}" for s in on.values()])
    return joined.fillna(default) if default else joined


def listed(value: str, order: str) -> Column:
    """Values in source order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])


def first_of(value: str, order: str) -> Column:
    return F.min_by(value, order)


def nth(values: Column | str, k: int) -> Column:
    """The k-th from the front, or from the back if negative; null out of range."""
    return F.get(values, F.lit(k)) if k >= 0 else F.try_element_at(values, F.lit(k))


def near_in_time(df: DataFrame, source: DataFrame, days: int, date: str = "date", source_date: str = "date", on: dict[str, str] | None = None) -> DataFrame:
    """Pairs whose dates are at most `days` apart (and whose keys are equal): both sides are put into buckets of days + 1, and joined with the bucket and its neighbours.

    Columns of source come with the prefix s_.
    """
    number = lambda c: F.floor(F.datediff(F.col(c), F.to_date(F.lit("1970-01-01"))) / (days + 1))
    left = df.withColumn("_bucket", F.explode(F.array(number(date) - 1, number(date), number(date) + 1)))
    right = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns], number(source_date).alias("_of"))
    close = (F.col("_bucket") == F.col("_of")) & (F.abs(F.datediff(F.col(f"s_{source_date}"), F.col(date))) <= days)
    for d, s in (on or {}).items():
        close = close & (F.col(d) == F.col(f"s_{s}"))
    return left.join(right, close).drop("_bucket", "_of")


def dyadic(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """The whole numbers from low to before high as aligned pieces: structs (level, place), each of the 2 ** level numbers from place * 2 ** level on; at most 2 * levels of them."""

    def at(k: Column) -> Column:
        first = -F.call_function("shiftright", -low, k)  # low / 2 ** k, rounded up
        last = F.call_function("shiftright", high, k)
        odd_first, odd_last = first.bitwiseAND(1) == 1, last.bitwiseAND(1) == 1
        after = first + F.when(odd_first, 1).otherwise(0)
        piece = lambda when, place: F.when(when, F.struct(k.alias("level"), place.alias("place")))
        return F.array(piece((first < last) & odd_first, first), piece((after < last) & odd_last, last - 1))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), at)), lambda x: x.isNotNull())


def _steps(value: Column, unit: float) -> Column:
    """value in whole units, rounded down; what is too large or infinite counts as the last one."""
    most = float(2 ** (LEVELS - 2))
    return F.floor(F.least(F.greatest(value / unit, F.lit(-most)), F.lit(most))).cast("long")


def in_range(df: DataFrame, source: DataFrame, value: str, low: str, high: str, unit: float) -> DataFrame:
    """Pairs where df's value is in [low, high) of a row of source (columns with the prefix s_), of any number of rows on both sides and ranges of any width.

    A range, in steps of `unit`, is cut into aligned pieces whose sizes are powers of two (`dyadic`), at most two of a size. A value belongs to one piece of each size, so it looks for as many
    pieces as there are sizes among the ranges, and pairs meet in a join of sizes and places. The bounds are tested exactly; `unit` is the width below which ranges share pieces. Ranges with a
    null or NaN bound, and such values, match nothing. Pairs can be as many as both sides multiplied: `aggregated_in_range` gives totals without making them.
    """
    right = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns]).filter((F.col(f"s_{low}") < F.col(f"s_{high}")) & ~F.isnan(F.col(f"s_{high}").cast("double")))
    pieces = right.withColumn("_piece", F.explode(dyadic(_steps(F.col(f"s_{low}"), unit), _steps(F.col(f"s_{high}"), unit) + 1)))
    levels = [r.level for r in pieces.select("_piece.level").distinct().collect()]  # at most LEVELS
    steps = df.filter(F.col(value).isNotNull()).withColumn("_step", _steps(F.col(value), unit))
    looked = steps.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in sorted(levels)]).cast("array<int>")))
    inside = (F.col(value) >= F.col(f"s_{low}")) & (F.col(value) < F.col(f"s_{high}"))
    same = (F.col("_level") == F.col("_piece.level")) & (F.expr("shiftright(_step, _level)") == F.col("_piece.place"))
    # Spark takes the pieces of a range for one row: without the hint it broadcasts tables that are far too large for it.
    return looked.join(pieces.hint("merge"), same & inside).drop("_step", "_level", "_piece")


def aggregated_in_range(df: DataFrame, source: DataFrame, value: str, low: str, high: str, aggregates: dict[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
    """Rows of source that have any value of df in [low, high), with aggregates of df's rows there, of any number of rows on both sides and ranges of any width.
    aggregates: name -> aggregate of df's rows, and the function that merges two of them (count and F.sum, max and F.max).

    No pair is made. Different values are numbered in their order (`_numbered`) and aggregated by aligned cells of 1, 2, 4 ... numbers; a range is the numbers from that of its first value on,
    cut into at most two cells of a size (`dyadic`). Work so grows with rows times the logarithm of the number of values. Nulls and NaN as in `in_range`.
    """
    rows = source.filter((F.col(low) < F.col(high)) & ~F.isnan(F.col(high).cast("double")))
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    values = known.groupBy(F.col(value).alias("_x")).agg(*[a.alias(n) for n, (a, _) in aggregates.items()])
    ranges = rows.select(F.col(low).alias("_low"), F.col(high).alias("_high")).distinct()
    bounds = ranges.select(F.explode(F.array("_low", "_high")).alias("_x")).distinct()
    numbered, count = _numbered(values.withColumn("_is", F.lit(1)).unionByName(bounds.withColumn("_is", F.lit(0)), allowMissingColumns=True))
    levels = max(1, count.bit_length())
    merged = lambda grouped: grouped.agg(*[merge(n).alias(n) for n, (_, merge) in aggregates.items()])

    each = numbered.filter("_is = 1").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    cells = merged(each.withColumn("_place", F.expr("shiftright(_at, _level)")).groupBy("_level", "_place"))
    at = lambda name: numbered.filter("_is = 0").select(F.col("_x").alias(f"_{name}"), F.col("_at").alias(f"_{name}_at"))
    placed = ranges.join(at("low").hint("merge"), "_low").join(at("high").hint("merge"), "_high")
    pieces = placed.select("_low", "_high", F.explode(dyadic(F.col("_low_at"), F.col("_high_at"), levels)).alias("_piece")).select("_low", "_high", "_piece.level", "_piece.place")
    same, top = (F.col("_level") == F.col("level")) & (F.col("_place") == F.col("place")), levels - COARSE
    # Many ranges share a large cell, few a small one.
    large = pieces.filter(F.col("level") >= top).join(F.broadcast(cells.filter(F.col("_level") >= top)), same)
    small = pieces.filter(F.col("level") < top).join(cells.filter(F.col("_level") < top).hint("merge"), same)
    found = merged(large.unionByName(small).groupBy("_low", "_high"))
    return rows.join(found.hint("merge"), (F.col(low) == F.col("_low")) & (F.col(high) == F.col("_high"))).drop("_low", "_high")


def _numbered(points: DataFrame) -> tuple[DataFrame, int]:
    """points (_x; _is: 1 for a value, 0 for a bound; each _x at most once of a kind) with _at, the number of values below _x, and the number of all values.

    Points are dealt to BUCKETS stretches at their approximate quantiles, and numbered within each; the driver sees the quantiles and the sizes of the stretches.
    """
    points = points.withColumn("_double", F.col("_x").cast("double"))
    quantiles = points.agg(F.percentile_approx("_double", [k / BUCKETS for k in range(1, BUCKETS)], 100 * BUCKETS)).first()[0] or []
    splits = [-float("inf"), *sorted({q for q in quantiles if abs(q) != float("inf")}), float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="_double", outputCol="_bucket").transform(points).withColumn("_bucket", F.col("_bucket").cast("int"))
    sizes = {r["_bucket"]: r.n for r in dealt.groupBy("_bucket").agg(F.sum("_is").alias("n")).collect()}
    before = reduce(lambda found, k: [*found, found[-1] + sizes.get(k, 0)], range(len(splits) - 1), [0])
    below = Window.partitionBy("_bucket").orderBy("_x", "_is").rowsBetween(Window.unboundedPreceding, -1)
    at = F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("_bucket")) + F.coalesce(F.sum("_is").over(below), F.lit(0))
    return dealt.withColumn("_at", at).drop("_double", "_bucket"), before[-1]


def by_condition(df: DataFrame, source: DataFrame, key: str, condition: Column, aggregates: dict[str, Column], broadcast_rows: int = 100_000) -> DataFrame:
    """Any condition between df and source (columns of source with prefix s_); matches are aggregated by df's key. A source of at most broadcast_rows, which is
    counted, is broadcast. A larger one needs an equality in the condition; without one Spark would pair all rows with all, and a ValueError says so: `in_range` and
    `near_in_time` are for such conditions."""
    right = source.select(*[F.col(c).alias(f"s_{c}") for c in source.columns])
    small = source.limit(broadcast_rows + 1).count() <= broadcast_rows
    joined = df.join(F.broadcast(right) if small else right, condition)
    if not small:
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        if "CartesianProduct" in plan or "BroadcastNestedLoopJoin" in plan:
            raise ValueError(f"the condition has no equality and the source has more than {broadcast_rows} rows: use in_range or near_in_time")
    found = joined.groupBy(key).agg(*[a.alias(n) for n, a in aggregates.items()])
    return df.join(found, key, "left")
