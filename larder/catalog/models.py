"""Segmentation and value models as queries."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from larder.catalog import query
from larder.functions import columns as fc
from larder.operators import segmentation as sg
from larder.operators import value_models as vm
from larder.operators.ranks import medians, quantiles
from larder.operators.tabulate import crosstab_margins
from larder.session import materialise, scratch_path, small_table
from larder.sources import files

IMPUTED = """
imputed AS (
  SELECT * REPLACE (COALESCE(std_gap_days, 0.0) AS std_gap_days,
                    COALESCE(top_category_spend_share, 0.0) AS top_category_spend_share,
                    COALESCE(basket_trend_direction, 2) AS basket_trend_direction)
  FROM household_features WHERE mean_gap_days IS NOT NULL
)"""
_FILLED = "household_id, std_gap_days, top_category_spend_share, basket_trend_direction"


@query("prj_impute_kmeans", "features", f"WITH {IMPUTED} SELECT {_FILLED} FROM imputed")
def impute_kmeans(stages):
    return sg.impute_for_clustering(stages.features).select(*_FILLED.split(", "))


_SQL_HOW = {
    "as is": "CAST({c} AS DOUBLE)",
    "log1p": "LN(1 + CAST({c} AS DOUBLE))",
    "log": "LN(GREATEST(CAST({c} AS DOUBLE), 0.01))",
    "sqrt": "SQRT(CAST({c} AS DOUBLE))",
}
STRAIGHT = {c: _SQL_HOW[how].format(c=c) for c, how in sg.CANDIDATES.items()}


@query(
    "prj_transforms",
    "features",
    f"WITH {IMPUTED} SELECT household_id, " + ", ".join(f"ROUND({x}, 8) AS {c}" for c, x in STRAIGHT.items()) + " FROM imputed",
)
def transforms(stages):
    rows = sg.transform_features(sg.impute_for_clustering(stages.features))
    return rows.select("household_id", *[fc.round_to(F.col(c), 8).alias(c) for c in sg.CANDIDATES])


_GIVEN = ("is_single_trip_obs", "has_trend_obs", "is_redemption_eligible")


@query(
    "prj_impute_clv",
    "split",
    """SELECT household_id, CASE WHEN obs_mean_gap_days IS NULL THEN 1.0 ELSE 0.0 END AS is_single_trip_obs,
              CASE WHEN obs_basket_trend_direction IS NULL THEN 0.0 ELSE 1.0 END AS has_trend_obs,
              CASE WHEN obs_redemption_propensity IS NULL THEN 0.0 ELSE 1.0 END AS is_redemption_eligible,
              COALESCE(obs_mean_gap_days, obs_recency_days) AS obs_mean_gap_days,
              COALESCE(obs_std_gap_days, 0.0) AS obs_std_gap_days,
              CAST(COALESCE(obs_basket_trend_direction, 2) AS DOUBLE) AS obs_basket_trend_direction,
              COALESCE(obs_redemption_propensity, 0.0) AS obs_redemption_propensity,
              COALESCE(obs_top_category_spend_share, 0.0) AS obs_top_category_spend_share,
              CASE WHEN is_concurrent_arm THEN 1.0 ELSE 0.0 END AS is_concurrent_arm,
              CAST(COALESCE(n_campaigns_exposed, 0) AS DOUBLE) AS n_campaigns_exposed
       FROM clv_split WHERE NOT is_pred_only""",
)
def impute_clv(stages):
    return vm.impute_for_value(stages.split).select(
        "household_id",
        *_GIVEN,
        "obs_mean_gap_days",
        "obs_std_gap_days",
        "obs_basket_trend_direction",
        "obs_redemption_propensity",
        "obs_top_category_spend_share",
        "is_concurrent_arm",
        "n_campaigns_exposed",
    )


_SCALED = ("frequency", "monetary", "recency_days", "tenure_days", "retail_disc_rate")


@query(
    "ml_robust_scale",
    "features",
    "SELECT household_id, "
    + ", ".join(
        f"ROUND(({c} - quantile_cont(CAST({c} AS DOUBLE), 0.5) OVER ()) / (quantile_cont(CAST({c} AS DOUBLE), 0.75) OVER () "
        f"- quantile_cont(CAST({c} AS DOUBLE), 0.25) OVER ()), 8) AS {c}"
        for c in _SCALED
    )
    + " FROM household_features",
)
def robust_scale(stages):
    scaled = sg.robust_scale(stages.features, _SCALED)
    return scaled.select("household_id", *[fc.round_to(F.col(c), 8).alias(c) for c in _SCALED])


_NAMES = list(sg.CANDIDATES)
_PAIRS = (
    f"WITH {IMPUTED}, pairs AS ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CORR({STRAIGHT[a]}, {STRAIGHT[b]}) AS r FROM imputed"
        for i, a in enumerate(_NAMES)
        for b in _NAMES[i + 1 :]
    )
    + ")"
)


def _collinear(stages):
    if not hasattr(stages, "_collinear_pairs"):
        rows = materialise(sg.transform_features(sg.impute_for_clustering(stages.features)), "choice")
        stages._collinear_pairs = small_table(sg.collinear_pairs(rows))
    return stages._collinear_pairs


@query("ml_feature_choice", "features", _PAIRS + " SELECT feature_a, feature_b, ROUND(r, 6) AS r FROM pairs WHERE ABS(r) > 0.7")
def feature_choice(stages):
    return _collinear(stages).withColumn("r", fc.round_to(F.col("r"), 6))


@query(
    "ml_feature_list",
    "features",
    _PAIRS
    + f""", rule AS (
      SELECT BOOL_OR(feature_a = 'mean_gap_days' AND feature_b = 'gap_score' AND ABS(r) > 0.7) AS no_score,
             BOOL_OR(feature_a = 'frequency' AND feature_b = 'mean_gap_days' AND ABS(r) > 0.8) AS no_gap FROM pairs)
    SELECT feature, NOT ((feature = 'gap_score' AND no_score) OR (feature = 'mean_gap_days' AND no_gap)) AS kept
    FROM (SELECT UNNEST({_NAMES!r}) AS feature), rule""",
)
def feature_list(stages):
    """The candidate inputs, and which stay after the redundant ones are dropped."""
    kept = sg.choose_features(_collinear(stages))
    rows = [(name, name in kept) for name in _NAMES]
    return stages.spark.createDataFrame(rows, "feature STRING, kept BOOLEAN")


@query("ml_kmeans_sweep")
def kmeans_sweep(stages):
    return _sweep(stages)


def _sweep(stages):
    if not hasattr(stages, "_sweep_table"):
        fit = stages.segmentation
        stages._sweep_table = sg.sweep_table(fit.scaled, fit.features, fit.fits)
    return stages._sweep_table


@query("ml_silhouette")
def silhouette(stages):
    return _sweep(stages).filter(F.col("k") == sg.CHOSEN_K).select("k", "silhouette")


@query("ml_choose_k")
def choose_k(stages):
    return sg.choose_k(_sweep(stages))


@query(
    "ml_calinski_harabasz",
    "analysis",
    f"""WITH x AS (SELECT segment, UNNEST([{', '.join(f'CAST({c} AS DOUBLE)' for c in _SCALED)}]) AS v,
                          UNNEST([{', '.join(f"'{c}'" for c in _SCALED)}]) AS c FROM labelled),
        g AS (SELECT segment, c, COUNT(*) AS n, AVG(v) AS m, VAR_POP(v) AS s FROM x GROUP BY segment, c),
        t AS (SELECT g.*, SUM(n * m) OVER (PARTITION BY c) / SUM(n) OVER (PARTITION BY c) AS mid FROM g)
        SELECT ROUND((SUM(n * POWER(m - mid, 2)) / (COUNT(DISTINCT segment) - 1))
                     / (SUM(n * s) / (SUM(n) / {len(_SCALED)} - COUNT(DISTINCT segment))), 6) AS calinski_harabasz FROM t""",
)
def calinski_harabasz(stages):
    return sg.calinski_harabasz(stages.labelled, "segment", _SCALED).withColumn(
        "calinski_harabasz", fc.round_to(F.col("calinski_harabasz"), 6)
    )


_STEP = [[0.5 * i - 0.5] * len(_SCALED) for i in range(4)]
_STEP_SQL = f"""
WITH scaled AS (SELECT household_id, [{", ".join(
    f"({c} - quantile_cont(CAST({c} AS DOUBLE), 0.5) OVER ()) / (quantile_cont(CAST({c} AS DOUBLE), 0.75) OVER () - quantile_cont(CAST({c} AS DOUBLE), 0.25) OVER ())"
    for c in _SCALED)}] AS x FROM household_features),
far AS (SELECT household_id, label, list_sum(list_transform(x, lambda v: POWER(v - (0.5 * label - 0.5), 2))) AS d FROM scaled, range(4) AS r(label)),
near AS (SELECT household_id, MIN(d) AS d, arg_min(label, (d, label)) AS label FROM far GROUP BY household_id)
SELECT CAST(label AS INTEGER) AS label, COUNT(*) AS size, ROUND(SUM(d), 3) AS inertia FROM near GROUP BY label"""


@query("ml_kmeans_step", "features", _STEP_SQL)
def kmeans_step(stages):
    """One pass of k-means with fixed centres."""
    scaled = sg.robust_scale(stages.features, _SCALED).select("household_id", *_SCALED)
    step = sg.kmeans_step(materialise(scaled, "step"), _SCALED, _STEP).filter("size > 0")
    return step.select("label", "size", fc.round_to(F.col("inertia"), 3).alias("inertia"))


@query(
    "st_adjusted_rand",
    "analysis",
    """WITH c AS (SELECT segment, f_decile, COUNT(*) AS n FROM labelled GROUP BY ALL),
       p AS (SELECT SUM(n) AS n, SUM(n * (n - 1) / 2) AS joint FROM c),
       a AS (SELECT SUM(m * (m - 1) / 2) AS a FROM (SELECT SUM(n) AS m FROM c GROUP BY segment)),
       b AS (SELECT SUM(m * (m - 1) / 2) AS b FROM (SELECT SUM(n) AS m FROM c GROUP BY f_decile))
       SELECT CAST(n AS BIGINT) AS n, ROUND((joint - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 8) AS ari FROM p, a, b""",
)
def adjusted_rand(stages):
    """Agreement of the rule-based classes with the frequency deciles."""
    cells = stages.labelled.groupBy("segment", "f_decile").agg(F.count(F.lit(1)).alias("n"))
    return sg.adjusted_rand(cells, [], "segment", "f_decile", "n").withColumn("ari", fc.round_to(F.col("ari"), 8))


@query("ml_bootstrap_ari")
def bootstrap_ari(stages):
    """How much the chosen segments change from one bootstrap sample of households to another."""
    fit = stages.segmentation
    index = sg.stability(fit.scaled, fit.features, fit.centres)
    return index.agg(F.count("ari").alias("n_replicates"), F.avg("ari").alias("mean_ari"), F.stddev_samp("ari").alias("sd_ari"), F.min("ari").alias("least_ari"))


@query("ml_assign_segments")
def assign_segments(stages):
    return stages.assignments


_CLASSES = ["Champions", "Loyal", "Mid-tier", "New/Returning", "At-Risk", "Lost"]
_PROFILE = ("frequency", "monetary", "recency_days", "mean_gap_days", "tenure_days", "private_label_spend_share")


@query("ml_profile")
def profile(stages):
    """Medians and class counts per k-means segment."""
    joined = stages.assignments.select("household_id", "cluster_name").join(
        stages.labelled.select("household_id", "segment", *_PROFILE), "household_id"
    )
    stored = materialise(joined, "profile")
    counts = crosstab_margins(stored, "cluster_name", "segment", _CLASSES)
    return counts.join(small_table(medians(stored, ["cluster_name"], _PROFILE)), "cluster_name", "left")


@query(
    "ml_profile_rules",
    "analysis",
    "SELECT COALESCE(CAST(f_decile AS VARCHAR), 'All') AS cluster_name, "
    + ", ".join(f"""COUNT(*) FILTER (segment = '{c}') AS "{c}\"""" for c in _CLASSES)
    + ', COUNT(*) AS "All", '
    + ", ".join(f"CASE WHEN f_decile IS NOT NULL THEN ROUND(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) END AS {c}" for c in _PROFILE)
    + " FROM labelled GROUP BY ROLLUP (f_decile)",
)
def profile_rules(stages):
    """Medians and class counts per frequency decile: the profile of a labelling that SQL knows."""
    rows = stages.labelled.select("household_id", F.col("f_decile").cast("string").alias("cluster_name"), "segment", *_PROFILE)
    stored = materialise(rows, "profile-rules")
    counts = crosstab_margins(stored, "cluster_name", "segment", _CLASSES)
    middle = medians(stored, ["cluster_name"], _PROFILE).select("cluster_name", *[fc.round_to(F.col(c), 6).alias(c) for c in _PROFILE])
    return counts.join(small_table(middle), "cluster_name", "left")


_CURVE = """
WITH curve AS (
  SELECT f_decile AS k, ROUND(AVG(top_store_trip_share), 8) AS silhouette, CAST(SUM(frequency) AS DOUBLE) AS inertia,
         CAST(SUM(recency_days) AS DOUBLE) AS calinski_harabasz FROM household_features GROUP BY f_decile),
bend AS (SELECT k, LAG(inertia) OVER (ORDER BY k) - 2 * inertia + LEAD(inertia) OVER (ORDER BY k) AS d2 FROM curve),
elbow AS (SELECT k AS elbow_k FROM bend WHERE d2 IS NOT NULL ORDER BY d2 DESC, k LIMIT 1)
SELECT arg_max(k, silhouette) AS silhouette_k, arg_max(k, calinski_harabasz) AS ch_k, elbow_k,
       GREATEST(3, LEAST(7, (SELECT k FROM curve WHERE silhouette >= 0.9 * (SELECT MAX(silhouette) FROM curve)
                             ORDER BY ABS(k - elbow_k), k LIMIT 1))) AS chosen_k FROM curve, elbow GROUP BY elbow_k"""


@query("ml_choose_k_curve", "features", _CURVE)
def choose_k_curve(stages):
    """The rule that chooses k, on a curve over the frequency deciles."""
    total = lambda c: F.sum(c).cast("double")
    curve = stages.features.groupBy(F.col("f_decile").alias("k")).agg(
        fc.round_to(F.avg("top_store_trip_share"), 8).alias("silhouette"),
        total("frequency").alias("inertia"),
        total("recency_days").alias("calinski_harabasz"),
    )
    return sg.choose_k(small_table(curve))


@query(
    "prj_segment_name",
    "features",
    """WITH m AS (SELECT f_decile AS cluster, quantile_cont(monetary, 0.5) AS med FROM household_features GROUP BY f_decile)
       SELECT cluster, CASE rn WHEN 1 THEN 'Champions' WHEN 2 THEN 'Loyal Actives' WHEN 3 THEN 'Declining' WHEN 4 THEN 'Truly Lapsed'
                       ELSE 'Segment ' || CAST(rn AS VARCHAR) END AS cluster_name
       FROM (SELECT cluster, ROW_NUMBER() OVER (ORDER BY med DESC, cluster) AS rn FROM m)""",
)
def segment_name(stages):
    return sg.name_segments(stages.features.withColumnRenamed("f_decile", "cluster"), "cluster")


@query(
    "prj_heuristic_name",
    "features",
    """WITH m AS (SELECT f_decile AS cluster, quantile_cont(frequency, 0.5) AS f, quantile_cont(monetary, 0.5) AS m,
                         quantile_cont(recency_days, 0.5) AS r, quantile_cont(mean_gap_days, 0.5) AS g
                  FROM household_features GROUP BY f_decile)
       SELECT cluster, CASE WHEN r <= 14 AND f >= 80 AND m >= 2500 THEN 'Champions'
                            WHEN r <= 30 AND f >= 30 AND m >= 1000 THEN 'Loyal Regulars'
                            WHEN r <= 20 AND f < 30 THEN 'New/Returning'
                            WHEN g >= 20 OR r >= 60 THEN 'Lapsed / Lost'
                            WHEN f < 30 AND m < 800 THEN 'Occasional' ELSE 'Mid-tier' END AS heuristic_name FROM m""",
)
def heuristic_name(stages):
    rows = stages.features.withColumnRenamed("f_decile", "cluster")
    table = medians(rows, ["cluster"], ["frequency", "monetary", "recency_days", "mean_gap_days"])
    return sg.heuristic_names(table).select("cluster", "heuristic_name")


@query("snk_model")
def model_folder(stages):
    """Store the return model with its settings, load it again and score with it."""
    models, path = stages.value_models, scratch_path(stages.spark, "model")
    pipeline = PipelineModel([VectorAssembler(inputCols=list(vm.FEATURES), outputCol="inputs"), models.returning])
    details = {
        "features": list(vm.FEATURES),
        "split_date": stages.panel.study.split_date.isoformat(),
        "segment_features": stages.segmentation.features,
        "segment_centres": stages.segmentation.centres.tolist(),
        "spend_alpha": models.returning_ridge.alpha,
    }
    files.save_model(pipeline, path, details)
    loaded, _ = files.load_model(stages.spark, path)
    return loaded.transform(models.frame).select("household_id", vector_to_array("probabilities")[1].alias("p_return"))


# ---- value models -----------------------------------------------------------


@query(
    "ml_split_strat",
    "split",
    """WITH s AS (SELECT CASE WHEN clv_pred_window > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS returned, COUNT(*) AS n,
                         CAST(ROUND(COUNT(*) * 0.2) AS BIGINT) AS held FROM clv_split WHERE NOT is_pred_only GROUP BY 1)
       SELECT returned, TRUE AS is_holdout, held AS n FROM s WHERE held > 0
       UNION ALL SELECT returned, FALSE, n - held FROM s WHERE n > held""",
)
def split_strat(stages):
    return stages.value_models.frame.groupBy("returned", "is_holdout").agg(F.count(F.lit(1)).alias("n"))


@query("ml_ols")
def ols(stages):
    return stages.value_models.coefficients()


@query("ml_coef_table")
def coef_table(stages):
    return stages.value_models.coefficients().select("feature", "coef", "pct_per_unit", "sig")


@query("so_topk_coef")
def topk_coef(stages):
    table = stages.value_models.coefficients()
    top = table.filter("coef > 0").orderBy(F.desc("coef")).limit(5)
    bottom = table.filter("coef < 0").orderBy("coef").limit(5)
    return top.unionByName(bottom).select("feature", "coef")


@query("ml_ridge_cv")
def ridge_cv(stages):
    fit = stages.value_models.ridge
    rows = [(float(a), float(s), a == fit.alpha) for a, s in fit.fold_scores.items()]
    return stages.spark.createDataFrame(rows, "alpha DOUBLE, mean_r2 DOUBLE, chosen BOOLEAN")


@query("ml_gbm")
def gbm(stages):
    models = stages.value_models
    return vm.metrics(materialise(models.with_boosted(models.holdout), "gbm"), "clv_pred_window", ["gbm"])


@query("ml_importance")
def importance(stages):
    return stages.value_models.importances().limit(10)


@query("ml_hurdle")
def hurdle(stages):
    models = stages.value_models
    return models.with_hurdle(models.holdout).select("household_id", "p_return", "hurdle")


@query("ml_logit_coefs")
def logit_coefs(stages):
    return stages.value_models.return_coefficients()


@query("ml_breusch_pagan")
def breusch_pagan(stages):
    return stages.value_models.diagnostics()


@query("ml_model_comparison")
def comparison(stages):
    return stages.value_models.comparison()


@query("ml_score_panel")
def score_panel(stages):
    return stages.predictions


@query("so_topk_resid")
def topk_resid(stages):
    models = stages.value_models
    scored = models.with_linear(models.holdout)
    return vm.worst_residuals(scored, "clv_pred_window", "ols").select(
        "household_id", "cluster_name", "clv_pred_window", "ols", "abs_error", "obs_monetary", "obs_frequency", "log_recency"
    )


# metrics checked with a deterministic prediction: spend per observed day times 92
_PREDICTED = """
WITH p AS (SELECT e.*, obs_monetary / 273.0 * 92 AS pred FROM estimation e)"""


def _predicted(stages):
    return stages.estimation.withColumn("pred", F.col("obs_monetary") / 273.0 * 92)


@query(
    "ml_metrics",
    "analysis",
    _PREDICTED
    + """SELECT 'pred' AS model, COUNT(*) AS n, ROUND(SQRT(AVG(POWER(outcome - GREATEST(pred, 0), 2))), 3) AS rmse,
                ROUND(AVG(ABS(outcome - GREATEST(pred, 0))), 3) AS mae,
                ROUND(1 - SUM(POWER(outcome - GREATEST(pred, 0), 2)) / (VAR_POP(outcome) * COUNT(*)), 6) AS r2,
                ROUND(100 * AVG(CASE WHEN pred < 0 THEN 1.0 ELSE 0.0 END), 6) AS neg_pct FROM p""",
)
def metrics(stages):
    table = vm.metrics(_predicted(stages), "outcome", ["pred"])
    digits = {"rmse": 3, "mae": 3, "r2": 6, "neg_pct": 6}
    return table.withColumns({c: fc.round_to(F.col(c), d) for c, d in digits.items()})


@query(
    "ml_metrics_by_segment",
    "analysis",
    _PREDICTED
    + """SELECT segment, COUNT(*) AS n, ROUND(100 * AVG(CASE WHEN outcome = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_pct,
                ROUND(SQRT(AVG(POWER(outcome - GREATEST(pred, 0), 2))), 3) AS rmse,
                ROUND(AVG(ABS(outcome - GREATEST(pred, 0))), 3) AS mae,
                ROUND(quantile_cont(ABS(outcome - GREATEST(pred, 0)), 0.5), 3) AS medae FROM p GROUP BY segment""",
)
def metrics_by_segment(stages):
    table = vm.metrics_by_segment(materialise(_predicted(stages), "predicted"), "segment", "outcome", "pred")
    return table.withColumns({c: fc.round_to(F.col(c), 6 if c == "zero_pct" else 3) for c in ("zero_pct", "rmse", "mae", "medae")})


@query(
    "ml_null_baseline",
    "analysis",
    """WITH b AS (SELECT quantile_cont(outcome, 0.5) AS med FROM estimation)
       SELECT ROUND(med, 6) AS prediction, ROUND(SQRT(AVG(POWER(outcome - med, 2))), 3) AS rmse, ROUND(AVG(ABS(outcome - med)), 3) AS mae
       FROM estimation, b GROUP BY med""",
)
def null_baseline(stages):
    middle = quantiles(stages.estimation, [], ["outcome"], [0.5]).first()["quantile"]
    error = F.col("outcome") - middle
    return stages.estimation.agg(
        fc.round_to(F.lit(middle), 6).alias("prediction"),
        fc.round_to(F.sqrt(F.avg(error * error)), 3).alias("rmse"),
        fc.round_to(F.avg(F.abs(error)), 3).alias("mae"),
    )
