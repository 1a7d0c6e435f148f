"""The flat report tables built from the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import ratio
from larder.operators.cleaning import with_demographics
from larder.operators.resampling import bootstrap_means
from larder.operators.tabulate import round_even, segment_summary, value_counts
from larder.session import small_table

PROFILE_VARIABLES = ("age", "income", "marital_status", "household_size", "kids_count")


def segment_summary_extract(predictions: DataFrame, replicates: int = 10_000) -> DataFrame:
    """One row per segment with a bootstrap interval of its mean predicted value."""
    summary = segment_summary(predictions, "cluster_name", "hurdle_pred_clv", "clv_pred_window")
    intervals = bootstrap_means(predictions, "cluster_name", "household_id", ["hurdle_pred_clv"], replicates)
    ends = small_table(
        intervals.select(
            F.col("cluster_name").alias("segment_name"),
            round_even(F.col("ci_low"), 2).alias("clv_ci_low"),
            round_even(F.col("ci_high"), 2).alias("clv_ci_high"),
        )
    )
    return summary.join(ends, "segment_name").select(
        "segment_name",
        "n_households",
        "pct_panel",
        "mean_pred_clv",
        "median_pred_clv",
        "clv_ci_low",
        "clv_ci_high",
        "mean_obs_monetary",
        "mean_frequency",
        "mean_recency_days",
        "zero_spend_rate_pct",
        "revenue_share_pct",
    )


def household_scored_extract(
    split: DataFrame, predictions: DataFrame, assignments: DataFrame, demographics: DataFrame
) -> DataFrame:
    """Every household; the assigned segment wins over the one carried by the prediction."""
    predicted = predictions.select("household_id", F.col("cluster_name").alias("carried"), "hurdle_pred_clv", F.col("clv_pred_window").alias("actual"))
    assigned = assignments.select("household_id", F.col("cluster_name").alias("assigned"), "r_score", "f_score", "m_score")
    base = split.select(
        "household_id", "obs_recency_days", "obs_frequency", "obs_monetary", "obs_tenure_days", "is_pred_only"
    )
    joined = base.join(predicted, "household_id", "left").join(assigned, "household_id", "left")
    return with_demographics(joined, demographics).select(
        "household_id",
        F.coalesce("assigned", "carried").alias("cluster_name"),
        "hurdle_pred_clv",
        F.col("actual").alias("clv_pred_window"),
        "obs_monetary",
        "obs_frequency",
        "obs_recency_days",
        "obs_tenure_days",
        "has_demographics",
        # scores that came as text become numbers, what is none becomes NULL
        *[F.col(c).try_cast("int").alias(c) for c in ("m_score", "r_score", "f_score")],
        "is_pred_only",
    )


def demographic_crosstab_extract(assignments: DataFrame, demographics: DataFrame, segment: str) -> DataFrame:
    """Value shares of each demographic per segment, with the covered part of the segment."""
    named = assignments.filter(F.col(segment).isNotNull()).select("household_id", F.col(segment).alias("segment_name"))
    covered = named.join(demographics.select("household_id", *PROFILE_VARIABLES), "household_id")
    sizes = small_table(
        named.join(demographics.select("household_id", F.lit(1).alias("known")), "household_id", "left")
        .groupBy("segment_name")
        .agg(F.count("known").alias("n_segment_with_demo"), F.count(F.lit(1)).alias("n_segment_total"))
    )
    share = 100 * ratio(F.col("n_segment_with_demo"), F.col("n_segment_total"))
    return (
        value_counts(covered, "segment_name", PROFILE_VARIABLES)
        .join(sizes, "segment_name")
        .select(
            "segment_name",
            F.col("variable").alias("demographic_variable"),
            F.col("value").alias("demographic_value"),
            F.col("n").alias("n_households"),
            round_even(F.col("pct_within"), 1).alias("pct_within_segment"),
            round_even(share, 1).alias("pct_segment_covered"),
            "n_segment_with_demo",
            "n_segment_total",
        )
    )


def campaign_results_extract(effects: DataFrame) -> DataFrame:
    money = {c: F.round(c, 2) for c in ("effect_dollars", "ci_low", "ci_high", "ess_treated", "ess_control")}
    return effects.withColumns(money).orderBy("segment_name", "estimate_type")
