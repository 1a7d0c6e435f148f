"""Campaign exposure with overlap counts and window truncation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import ratio, round_to, window_truncation


def overlap_counts(
    intervals: DataFrame, owner: str, item: str, start: str, end: str, keep: Sequence[str] = ()
) -> DataFrame:
    """For each interval, how many other intervals of its owner it touches.

    Both ends are inclusive. Instead of pairing intervals, each owner's start
    and end points are swept once in time order: the intervals begun by my end,
    less those finished before my start, less myself. Needs start <= end and
    each item once per owner; undated intervals touch nothing. ``keep`` names
    further columns of the interval to carry along.
    """
    dated = F.col(start).isNotNull() & F.col(end).isNotNull()
    edges = [F.struct(F.col(c).alias("at"), F.lit(i).alias("closing")) for i, c in enumerate((start, end))]
    points = intervals.select(
        owner, item, *keep, dated.cast("int").alias("dated"), F.explode(F.array(*edges)).alias("edge")
    ).select(owner, item, *keep, "dated", "edge.at", "edge.closing")
    so_far = (
        Window.partitionBy(owner)
        .orderBy("at", "closing", item)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    opening, closing = 1 - F.col("closing"), F.col("closing")
    counted = points.withColumns(
        {
            "begun": F.sum(opening * F.col("dated")).over(so_far),
            "finished": F.sum(closing * F.col("dated")).over(so_far),
        }
    )
    begun_by_end = F.max(F.when(F.col("closing") == 1, F.col("begun")))
    finished_before_start = F.max(F.when(F.col("closing") == 0, F.col("finished")))
    return counted.groupBy(owner, item).agg(
        *[F.max(c).alias(c) for c in keep],
        F.when(F.max("dated") == 1, begun_by_end - finished_before_start - 1)
        .otherwise(0)
        .alias("n_overlapping"),
    )


def campaign_exposure(campaigns: DataFrame, descriptions: DataFrame, transactions: DataFrame) -> DataFrame:
    """One row per household and campaign; campaigns without a description drop out."""
    exposed = campaigns.join(descriptions, "campaign_id")
    counted = overlap_counts(
        exposed, "household_id", "campaign_id", "start_date", "end_date", ("campaign_type", "start_date", "end_date")
    )
    observed = transactions.agg(
        F.min("transaction_timestamp").alias("first_seen"),
        F.max("transaction_timestamp").alias("last_seen"),
    )
    first = observed.select("first_seen").scalar()
    last = observed.select("last_seen").scalar()
    return (
        counted.withColumn("first_seen", first)
        .withColumn("last_seen", last)
        .withColumn("effective_start", F.greatest("start_date", "first_seen"))
        .withColumn("effective_end", F.least("end_date", "last_seen"))
        .select(
            "household_id",
            "campaign_id",
            "campaign_type",
            "start_date",
            "end_date",
            F.datediff("end_date", "start_date").alias("duration_days"),
            F.col("n_overlapping").alias("n_concurrent_campaigns"),
            (F.col("n_overlapping") > 0).alias("has_concurrent_exposure"),
            window_truncation(
                F.col("start_date"), F.col("end_date"), F.col("first_seen"), F.col("last_seen")
            ).alias("window_truncation"),
            "effective_start",
            "effective_end",
            F.datediff("effective_end", "effective_start").alias("effective_duration_days"),
        )
    )


def concurrency(campaigns: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Household, campaign and whether another campaign overlaps: the part features need."""
    exposed = campaigns.join(
        descriptions.select("campaign_id", "start_date", "end_date"), "campaign_id"
    )
    counts = overlap_counts(exposed, "household_id", "campaign_id", "start_date", "end_date")
    return counts.select(
        "household_id", "campaign_id", (F.col("n_overlapping") > 0).alias("has_concurrent_exposure")
    )


def campaign_block(exposure: DataFrame, redemptions: DataFrame) -> DataFrame:
    """Per household: any overlap, campaigns seen, redeemed share when single-arm."""
    redeemed = (
        redemptions.select("household_id", "campaign_id").distinct().withColumn("redeemed", F.lit(1))
    )
    per_household = (
        exposure.join(redeemed, ["household_id", "campaign_id"], "left")
        .groupBy("household_id")
        .agg(
            F.bool_or("has_concurrent_exposure").alias("is_concurrent_arm"),
            F.count("campaign_id").alias("n_campaigns_exposed"),
            F.count("redeemed").alias("n_redeemed"),
        )
    )
    share = round_to(ratio(F.col("n_redeemed"), F.col("n_campaigns_exposed")), 4)
    return per_household.select(
        "household_id",
        "is_concurrent_arm",
        "n_campaigns_exposed",
        F.when(~F.col("is_concurrent_arm"), share).alias("redemption_propensity"),
    )


def truncation_flags(exposure: DataFrame) -> DataFrame:
    """Per household over non-overlapping exposures: any window cut on either side."""
    return (
        exposure.filter(~F.col("has_concurrent_exposure"))
        .groupBy("household_id")
        .agg(
            F.bool_or(F.col("window_truncation") == "right_truncated").alias("right_trunc"),
            F.bool_or(F.col("window_truncation") == "left_truncated").alias("left_trunc"),
        )
    )
