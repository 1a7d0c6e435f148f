"""Counts, shares, crosstabs and per-group summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import ratio
from larder.operators.ranks import medians, quantiles
from larder.session import small_table


def round_even(x: Column, digits: int) -> Column:
    """Round half to even after scaling, as array libraries do."""
    scale = float(10**digits)
    return F.rint(x.cast("double") * scale) / scale


def crosstab(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Counts of ``column`` values (one output column each) per ``row``, zeros filled."""
    named = df.select(row, F.col(column).cast("string").alias("_value"))
    labels = [str(v).lower() if isinstance(v, bool) else str(v) for v in values]
    return named.groupBy(row).pivot("_value", labels).count().na.fill(0)


def crosstab_long(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """The crosstab as cells, with the share of each cell within its row."""
    table = crosstab(df, row, column, values)
    labels = [c for c in table.columns if c != row]
    cells = table.unpivot([row], labels, column, "n")
    per_row = Window.partitionBy(row)
    return cells.withColumn("row_pct", 100 * ratio(F.col("n"), F.sum("n").over(per_row)))


def crosstab_margins(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Crosstab with an ``All`` row and column, from one cube."""
    cells = df.cube(row, column).agg(
        F.count(F.lit(1)).alias("n"), F.grouping(row).alias("_all_rows"), F.grouping(column).alias("_all_columns")
    )
    named = cells.select(
        F.when(F.col("_all_rows") == 1, "All").otherwise(F.col(row)).alias(row),
        F.when(F.col("_all_columns") == 1, "All").otherwise(F.col(column)).alias(column),
        "n",
    )
    return named.groupBy(row).pivot(column, [*values, "All"]).agg(F.first("n")).na.fill(0)


def value_counts(df: DataFrame, group: str, variables: Sequence[str]) -> DataFrame:
    """Counts of each value of each variable per group and its share of non-NULL values."""
    long = df.select(group, *[F.col(v).cast("string").alias(v) for v in variables]).unpivot(
        [group], list(variables), "variable", "value"
    )
    counts = long.filter(F.col("value").isNotNull()).groupBy(group, "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy(group, "variable")
    return counts.withColumn("pct_within", 100 * ratio(F.col("n"), F.sum("n").over(within)))


def group_order(df: DataFrame, group: str, measure: str) -> DataFrame:
    """Groups ranked by the mean of a measure, largest first."""
    means = small_table(df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.avg(measure).alias("mean")))
    return means.select(group, F.row_number().over(Window.orderBy(F.desc("mean"), group)).alias("position"))


def segment_summary(predictions: DataFrame, segment: str, predicted: str, actual: str) -> DataFrame:
    """One row per segment: size, predicted value, behaviour means, zero and revenue shares.

    ``predictions`` is read twice: pass a stored table.
    """
    summary = predictions.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n_households"),
        F.avg(predicted).alias("mean_pred"),
        F.avg("obs_monetary").alias("mean_obs"),
        F.avg("obs_frequency").alias("mean_freq"),
        F.avg("obs_recency_days").alias("mean_rec"),
        F.count_if(F.col(actual) == 0).alias("n_zero"),
        F.sum("obs_monetary").alias("revenue"),
    )
    middle = medians(predictions, [segment], [predicted]).withColumnRenamed(predicted, "median_pred")
    panel = Window.partitionBy()
    return (
        small_table(summary)
        .join(middle, segment)
        .select(
            F.col(segment).alias("segment_name"),
            "n_households",
            round_even(100 * ratio(F.col("n_households"), F.sum("n_households").over(panel)), 2).alias("pct_panel"),
            round_even(F.col("mean_pred"), 2).alias("mean_pred_clv"),
            round_even(F.col("median_pred"), 2).alias("median_pred_clv"),
            round_even(F.col("mean_obs"), 2).alias("mean_obs_monetary"),
            round_even(F.col("mean_freq"), 2).alias("mean_frequency"),
            round_even(F.col("mean_rec"), 2).alias("mean_recency_days"),
            round_even(100 * ratio(F.col("n_zero"), F.col("n_households")), 2).alias("zero_spend_rate_pct"),
            round_even(100 * ratio(F.col("revenue"), F.sum("revenue").over(panel)), 2).alias("revenue_share_pct"),
        )
    )


def spread_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Percentiles 5/25/50/75/95, maximum and population skewness per column.

    ``df`` is read several times: pass a stored table.
    """
    points = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "max": 1.0}
    long = quantiles(df, [], columns, list(points.values()))
    picked = [F.max(F.when(F.col("probability") == p, F.col("quantile"))).alias(name) for name, p in points.items()]
    skew = df.agg(*[F.skewness(F.col(c).cast("double")).alias(c) for c in columns]).unpivot(
        [], list(columns), "variable", "skew"
    )
    return small_table(long.groupBy("variable").agg(*picked)).join(skew, "variable")


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, all in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    once = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    return once.unpivot([], once.columns, "pair", "r").select(
        F.split_part("pair", F.lit("|"), F.lit(1)).alias("feature_a"),
        F.split_part("pair", F.lit("|"), F.lit(2)).alias("feature_b"),
        "r",
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
