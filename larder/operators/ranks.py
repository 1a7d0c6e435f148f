"""Exact order statistics and NTILE without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from larder.session import small_table

#: A pass counts the rows of a bracket in so many cells; a bracket of at most so many
#: rows, or of one value, needs no further pass.
CELLS, BRACKET_ROWS = 4_096, 4_096
_LARGEST = 1.7976931348623157e308


def _scaled(x: Column, wide: Column) -> Column:
    """A monotone scale: logarithmic on both sides of zero in wide brackets, else linear."""
    finite = F.least(F.greatest(x, F.lit(-_LARGEST)), F.lit(_LARGEST))
    return F.when(wide, F.signum(finite) * F.log1p(F.abs(finite))).otherwise(finite)


def _cell(whole: bool) -> Column:
    """The cell, 0 to ``CELLS`` - 1, of ``value`` between ``low`` and ``high``; never falls where the value rises."""
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    if whole:
        x, a, b = (c.cast("decimal(20,0)") for c in (value, low, high))
        inner = F.floor((x - a) * CELLS / (b - a + 1))
    else:
        wide = F.abs(high) / 2 - F.abs(low) / 2 > 500 * F.least(F.abs(low), F.abs(high)) + 500
        wide = wide | (F.abs(low) / 2 - F.abs(high) / 2 > 500 * F.least(F.abs(low), F.abs(high)) + 500)
        a, b = _scaled(low, wide), _scaled(high, wide)
        # of the range halved, so that it stays finite
        part = F.try_divide(_scaled(value, wide) / 2 - a / 2, b / 2 - a / 2)
        inner = F.floor(F.nanvl(F.coalesce(part, F.lit(0.5)), F.lit(0.5)) * CELLS)
    inside = F.least(F.greatest(inner.cast("int"), F.lit(0)), F.lit(CELLS - 1))
    # the ends always part, so that every pass narrows
    return F.when(value <= low, 0).when(value >= high, CELLS - 1).otherwise(inside)


def _counted_cells(values: DataFrame, brackets: DataFrame, keys: list[str], whole: bool) -> DataFrame:
    """Per bracket and cell: rows in it, rows of the bracket before it, least and largest value."""
    cells = (
        values.join(brackets, keys)
        .filter(F.col("value").between(F.col("low"), F.col("high")))
        .groupBy(*keys, "low", "high", _cell(whole).alias("cell"))
        .agg(F.count(F.lit(1)).alias("rows"), F.min("value").alias("least"), F.max("value").alias("largest"))
    )
    upto = Window.partitionBy(*keys, "low", "high").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("before", F.coalesce(F.sum("rows").over(upto), F.lit(0)))


def _bracket_values(values: DataFrame, brackets: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct values of brackets that have few, with the rows of each."""
    return (
        values.join(brackets, keys)
        .filter(F.col("value").between(F.col("low"), F.col("high")))
        .groupBy(*keys, "low", "high", "value")
        .agg(F.count(F.lit(1)).alias("ties"))
    )


def _narrowed(targets: DataFrame, values: DataFrame, keys: list[str], whole: bool) -> DataFrame:
    """The targets, those in large brackets in the cell that their rank falls into."""
    large = (F.col("size") > BRACKET_ROWS) & (F.col("low") < F.col("high"))
    brackets = targets.filter(large).select(*keys, "low", "high").distinct()
    place = F.col("rank") - F.col("below")
    moved = (
        targets.filter(large)
        .join(_counted_cells(values, brackets, keys, whole), [*keys, "low", "high"])
        .filter((F.col("before") < place) & (place <= F.col("before") + F.col("rows")))
        .withColumns({"below": F.col("below") + F.col("before"), "size": F.col("rows"), "low": F.col("least"), "high": F.col("largest")})
    )
    return targets.filter(~large).unionByName(moved.select(*targets.columns))


def values_at_ranks(values: DataFrame, ranks: DataFrame, keys: Sequence[str], tag: Sequence[str]) -> DataFrame:
    """The value at each wanted 1-based rank within its key.

    ``values`` has ``keys`` and a non-null ``value``; ``ranks`` has ``keys``,
    ``tag`` columns and ``rank``. Returns ``ranks`` plus ``value`` and
    ``below``, the number of strictly smaller values of that key.

    Each pass counts the rows of the brackets that hold a wanted rank in ``CELLS``
    cells and goes on in the cell with the rank, until a bracket has ``BRACKET_ROWS``
    rows at most or one value. Only then are values put in order, with ties collapsed,
    so no task orders more than that however large a key is.
    """
    keys, tag = list(keys), list(tag)
    whole = isinstance(values.schema["value"].dataType, LongType)
    extent = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    targets = small_table(
        ranks.join(extent, keys)
        .filter((F.col("rank") >= 1) & (F.col("rank") <= F.col("size")))
        .select(*keys, *tag, "rank", F.lit(0).cast("bigint").alias("below"), "size", "low", "high")
    )
    several = F.col("low") < F.col("high")
    while not targets.filter(several & (F.col("size") > BRACKET_ROWS)).isEmpty():
        targets = small_table(_narrowed(targets, values, keys, whole))
    single = targets.filter(~several).withColumn("value", F.col("low"))
    few = targets.filter(several)
    if few.isEmpty():
        return single.select(*keys, *tag, "rank", "value", "below")
    order = Window.partitionBy(*keys, "low", "high").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ordered = _bracket_values(values, few.select(*keys, "low", "high").distinct(), keys).withColumn("upto", F.sum("ties").over(order))
    before = F.col("upto") - F.col("ties")
    place = F.col("rank") - F.col("below")
    found = (
        few.join(ordered, [*keys, "low", "high"])
        .filter((before < place) & (place <= F.col("upto")))
        .withColumn("below", F.col("below") + before)
    )
    return single.unionByName(found.select(*single.columns)).select(*keys, *tag, "rank", "value", "below")


def quantiles(
    df: DataFrame, groups: Sequence[str], columns: Sequence[str], probabilities: Sequence[float]
) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, in long form.

    Returns ``groups``, ``variable``, ``probability``, ``quantile``. NULLs are
    ignored. ``df`` is read several times: pass a stored table.
    """
    keys = [*groups, "variable"]
    values = (
        df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(list(groups), list(columns), "variable", "value")
        .filter(F.col("value").isNotNull())
    )
    position = F.col("p") * (F.col("n") - 1)
    wanted = (
        values.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])))
        .withColumn("weight", position - F.floor(position))
        .withColumn("offset", F.explode(F.array(F.lit(0), F.lit(1))))
        .withColumn("rank", F.least(F.floor(position) + 1 + F.col("offset"), F.col("n")))
        .drop("n")
    )
    found = values_at_ranks(values, wanted, keys, ["p", "weight", "offset"])
    lower = F.max(F.when(F.col("offset") == 0, F.col("value")))
    upper = F.max(F.when(F.col("offset") == 1, F.col("value")))
    return found.groupBy(*keys, F.col("p").alias("probability"), "weight").agg(
        (lower + (upper - lower) * F.col("weight")).alias("quantile")
    ).drop("weight")


def medians(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row per group with the exact median of each column."""
    long = quantiles(df, groups, columns, [0.5])
    return long.groupBy(*groups).pivot("variable", list(columns)).agg(F.first("quantile"))


@dataclass(frozen=True)
class Ntile:
    """``output`` = NTILE(``buckets``) by ``column``; NULL inputs sort last and stay NULL."""

    output: str
    column: str
    buckets: int
    descending: bool = False

    def sort_value(self) -> Column:
        x = F.col(self.column).cast("double")
        return -x if self.descending else x


def with_ntiles(df: DataFrame, specs: Sequence[Ntile], tie_break: str) -> DataFrame:
    """Add NTILE columns over the whole table, ties broken by a unique integer key.

    A bucket is decided by its first row, so only the few rows that open a
    bucket have to be found; every row is then compared with those cut points.
    ``df`` is read several times: pass a stored table.
    """
    total = df.count()
    starts = [
        (spec.output, bucket, (bucket - 1) * (total // spec.buckets) + min(bucket - 1, total % spec.buckets) + 1)
        for spec in specs
        for bucket in range(2, spec.buckets + 1)
    ]
    names, buckets, ranks = zip(*starts)
    wanted = df.sparkSession.createDataFrame(
        pa.table({"variable": names, "bucket": pa.array(buckets, pa.int32()), "rank": ranks})
    )
    values = (
        df.select(tie_break, *[s.sort_value().alias(s.output) for s in specs])
        .unpivot([tie_break], [s.output for s in specs], "variable", "value")
        .filter(F.col("value").isNotNull())
    )
    cuts = small_table(values_at_ranks(values, wanted, ["variable"], ["bucket"]))
    # the cut value may be shared by many rows: find the opening key among them
    tied = values.join(cuts.select("variable", "value", "bucket"), ["variable", "value"]).select(
        "variable", "bucket", F.col(tie_break).cast("bigint").alias("value")
    )
    inner = cuts.select("variable", "bucket", (F.col("rank") - F.col("below")).alias("rank"))
    openers = values_at_ranks(tied, inner, ["variable", "bucket"], []).select(
        "variable", "bucket", F.col("value").alias("key")
    )
    cut_rows = cuts.join(openers, ["variable", "bucket"]).select("variable", "bucket", "value", "key").collect()
    scored = df
    for spec in specs:
        x = spec.sort_value()
        reached = [
            ((x > c["value"]) | ((x == c["value"]) & (F.col(tie_break) >= c["key"]))).cast("int")
            for c in sorted(cut_rows, key=lambda c: c["bucket"])
            if c["variable"] == spec.output
        ]
        bucket = sum(reached, F.lit(1))
        scored = scored.withColumn(spec.output, F.when(x.isNotNull(), bucket))
    return scored
