"""Cohort retention by quarter of the study year."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.contract import Study
from larder.functions.columns import at_midnight, ratio, round_to
from larder.operators.ordered_joins import at_or_before


def study_quarter(ts: Column, study: Study) -> Column:
    """Quarter 1 to 4 of the study year. What lies before the year is in its first quarter, what lies after in none."""
    year = study.year_end.year - 1
    bounds = [*(date(year, month, 1) for month in (4, 7, 10)), study.year_end]
    quarter = F.when(ts < at_midnight(bounds[0]), 1)
    for number, bound in enumerate(bounds[1:], 2):
        quarter = quarter.when(ts < at_midnight(bound), number)
    return quarter


def quarter_label(quarter: Column, study: Study) -> Column:
    return F.concat(F.lit(f"{study.year_end.year - 1}-Q"), quarter.cast("string"))


def quarters_active(clean: DataFrame, study: Study) -> DataFrame:
    """One row per household and quarter with a transaction."""
    quarter = study_quarter(F.col("transaction_timestamp"), study)
    return clean.select("household_id", quarter.alias("quarter")).filter("quarter IS NOT NULL").distinct()


def quarter_pairs(active: DataFrame) -> DataFrame:
    """Each quarter seen in the panel with itself and every later one."""
    seen = active.select("quarter").distinct()
    return at_or_before(
        seen.withColumnRenamed("quarter", "cohort"), seen.withColumnRenamed("quarter", "subsequent"), "cohort", "subsequent"
    )


def cohort_activity(active: DataFrame) -> DataFrame:
    """Households of each cohort (their first quarter) that are active in each quarter."""
    cohorts = active.groupBy("household_id").agg(F.min("quarter").alias("cohort"))
    return active.join(cohorts, "household_id").groupBy("cohort", F.col("quarter").alias("subsequent")).agg(F.count(F.lit(1)).alias("n_retained"))


def retention_matrix(clean: DataFrame, study: Study) -> DataFrame:
    """Cohort against every later quarter seen in the panel, empty cells too, in order."""
    active = quarters_active(clean, study)
    activity = cohort_activity(active)
    sizes = activity.filter("cohort = subsequent").select("cohort", F.col("n_retained").alias("n_cohort"))
    cells = quarter_pairs(active).join(sizes, "cohort").join(activity, ["cohort", "subsequent"], "left")
    retained = F.coalesce("n_retained", F.lit(0))
    return cells.select(
        quarter_label(F.col("cohort"), study).alias("cohort_quarter"),
        quarter_label(F.col("subsequent"), study).alias("subsequent_quarter"),
        "n_cohort",
        retained.alias("n_retained"),
        round_to(ratio(retained * 100, F.col("n_cohort")), 1).alias("retention_rate_pct"),
        (F.col("subsequent") - F.col("cohort")).alias("quarters_since_cohort"),
    ).orderBy("cohort_quarter", "subsequent_quarter")
