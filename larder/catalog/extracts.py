"""Report tables and their sinks as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.catalog import query
from larder.catalog.tables import half_even
from larder.plans import extracts as ex
from larder.session import scratch_path
from larder.sources import files

_DEMO = ex.PROFILE_VARIABLES


def _crosstab_sql(where: str = "TRUE") -> str:
    long = " UNION ALL ".join(
        f"SELECT l.segment, '{c}' AS v, h.{c} AS x FROM labelled l JOIN known_households h ON h.household_id = l.household_id "
        f"WHERE h.has_demographics AND h.{c} IS NOT NULL"
        for c in _DEMO
    )
    return f"""
WITH long AS ({long}),
sizes AS (SELECT l.segment, COUNT(CASE WHEN h.has_demographics THEN 1 END) AS covered, COUNT(*) AS total
          FROM labelled l JOIN known_households h ON h.household_id = l.household_id GROUP BY l.segment),
cells AS (SELECT segment, v, x, COUNT(*) AS n, SUM(COUNT(*)) OVER (PARTITION BY segment, v) AS of_all FROM long GROUP BY segment, v, x)
SELECT c.segment AS segment_name, v AS demographic_variable, x AS demographic_value, n AS n_households,
       {half_even("100 * CAST(n AS DOUBLE) / CAST(of_all AS DOUBLE)", 1)} AS pct_within_segment,
       {half_even("100 * CAST(covered AS DOUBLE) / total", 1)} AS pct_segment_covered,
       covered AS n_segment_with_demo, total AS n_segment_total
FROM cells c JOIN sizes s ON s.segment = c.segment WHERE {where}"""


@query("ex_demographic_crosstab", "analysis", _crosstab_sql())
def demographic_crosstab(stages):
    return ex.demographic_crosstab_extract(stages.labelled, stages.panel.demographics, "segment")


_HOUSEHOLD = "household_id, m_score, r_score, f_score, obs_monetary, obs_frequency, obs_recency_days, obs_tenure_days, has_demographics, is_pred_only"


@query(
    "ex_household_scored",
    "analysis",
    """SELECT c.household_id, CASE WHEN l.mean_gap_days IS NOT NULL THEN l.segment WHEN NOT c.is_pred_only THEN 'Single-Trip' END AS cluster_name,
              CASE WHEN NOT c.is_pred_only THEN c.obs_monetary / 273.0 * 92 END AS hurdle_pred_clv,
              CASE WHEN NOT c.is_pred_only THEN c.clv_pred_window END AS clv_pred_window,
              c.obs_monetary, c.obs_frequency, c.obs_recency_days, c.obs_tenure_days, l.has_demographics,
              CASE WHEN l.mean_gap_days IS NOT NULL THEN l.m_score END AS m_score,
              CASE WHEN l.mean_gap_days IS NOT NULL THEN l.r_score END AS r_score,
              CASE WHEN l.mean_gap_days IS NOT NULL THEN l.f_score END AS f_score, c.is_pred_only
       FROM clv_split c JOIN labelled l ON l.household_id = c.household_id""",
)
def household_scored(stages):
    """The scored panel with the rule-based class and a spend-rate prediction."""
    assigned = stages.labelled.filter(F.col("mean_gap_days").isNotNull()).withColumnRenamed("segment", "cluster_name")
    predicted = stages.split.filter(~F.col("is_pred_only")).select(
        "household_id",
        F.lit("Single-Trip").alias("cluster_name"),
        (F.col("obs_monetary") / 273.0 * 92).alias("hurdle_pred_clv"),
        "clv_pred_window",
    )
    return ex.household_scored_extract(stages.split, predicted, assigned, stages.panel.demographics)


@query("ex_household_scored_model")
def household_scored_model(stages):
    """The scored panel with k-means segments and hurdle predictions."""
    return ex.household_scored_extract(stages.split, stages.predictions, stages.assignments, stages.panel.demographics)


@query("ex_segment_summary")
def segment_summary(stages):
    return ex.segment_summary_extract(stages.predictions)


@query("ex_campaign_results")
def campaign_results(stages):
    return ex.campaign_results_extract(stages.effects)


_CSV = "household_id, segment, r_score, f_score, m_score, rfm_code, has_demographics"


def _written(stages):
    rows = stages.labelled.select(*_CSV.split(", "))
    path = scratch_path(stages.spark, "extract")
    files.write_extract(rows, path, ["household_id"])
    return path, rows.schema


@query("snk_csv_extract", "analysis", f"SELECT {_CSV} FROM labelled")
def csv_extract(stages):
    """Write the labelled households as CSV and read every column back."""
    path, schema = _written(stages)
    return files.read_extract(stages.spark, path, schema)


@query("src_csv_read", "analysis", "SELECT household_id, segment, m_score FROM labelled")
def csv_read(stages):
    path, schema = _written(stages)
    return files.read_extract(stages.spark, path, schema, ["household_id", "segment", "m_score"])
