"""Joins on an order: inequality pairs and touching intervals, by equal keys alone.

Neither pairs all rows of a group: range bounds or time slices make equal keys, so
Spark hash-partitions the work and a large owner is spread over its slices.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_or_before(left: DataFrame, right: DataFrame, left_value: str, right_value: str, ranges: int = 16) -> DataFrame:
    """All pairs of rows with ``left_value`` at or before ``right_value``, both numeric; NULLs pair with nothing.

    Both sides are cut at the same bounds. A row meets the other side's rows of its own
    range by comparison and those of later ranges without one.
    """
    points = ", ".join(f"{i / ranges}D" for i in range(1, max(2, ranges)))
    found = right.agg(F.expr(f"percentile_approx({right_value}, array({points}), 1000)").alias("bounds")).first()["bounds"]
    bounds = sorted(set(found or [0.0]))  # one bound at least: two ranges make the keys

    def number(value: str) -> Column:
        return sum(((F.col(value) > b).cast("int") for b in bounds), F.lit(0))

    mine = left.filter(F.col(left_value).isNotNull()).withColumn("_range", number(left_value))
    theirs = right.filter(F.col(right_value).isNotNull()).withColumn("_range", number(right_value))
    own = mine.join(theirs, "_range").filter(F.col(left_value) <= F.col(right_value))
    later = F.when(F.col("_range") < len(bounds), F.sequence(F.col("_range") + 1, F.lit(len(bounds))))
    return own.unionByName(mine.withColumn("_range", F.explode(later)).join(theirs, "_range")).drop("_range")


def touching_pairs(intervals: DataFrame, owner: str, item: str, start: str, end: str, slice_days: int = 28) -> DataFrame:
    """Every ordered pair (owner, item, other) of an owner's intervals that touch; ends count as inside.

    A sweep along time keeps the open intervals. Time is cut into slices, so that an
    owner of any size is swept by many tasks: a slice begins with the intervals that are
    open then, and a pair is made in the slice where its later one starts. Intervals
    without a start or end, or that end before they start, touch nothing; items should
    occur once per owner.
    """
    width = slice_days * 86_400_000_000
    kinds = {f.name: f.dataType.simpleString() for f in intervals.select(owner, item).schema}
    at, until = (F.unix_micros(F.col(c).cast("timestamp")) for c in (start, end))
    dated = intervals.select(owner, item, at.alias("_at"), until.alias("_until")).filter("_at <= _until")
    first, last = (F.floor(F.col(c) / width).cast("bigint") for c in ("_at", "_until"))
    sliced = dated.withColumn("_slice", F.explode(F.sequence(first, last))).withColumn("_opens", F.col("_slice") == first)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, still = None, []
        for batch in batches:
            owners, items, others = [], [], []
            for who, what, begin, finish, part, opens in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (who, part) != group:
                    group, still = (who, part), []
                if opens:
                    while still and still[0][0] < begin:
                        heapq.heappop(still)
                    for _, other in still:
                        owners += [who, who]
                        items += [what, other]
                        others += [other, what]
                heapq.heappush(still, (finish, what))
            arrays = [pa.array(v, t) for v, t in zip((owners, items, others), (batch.schema.types[0], batch.schema.types[1], batch.schema.types[1]))]
            yield pa.RecordBatch.from_arrays(arrays, names=[owner, item, "other"])

    swept = sliced.repartition(owner, "_slice").sortWithinPartitions(owner, "_slice", "_opens", "_at", item)
    columns = swept.select(owner, item, "_at", "_until", "_slice", "_opens")
    return columns.mapInArrow(sweep, f"{owner} {kinds[owner]}, {item} {kinds[item]}, other {kinds[item]}")
