"""Lifetime-value models on the observation window and their comparison."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import stars
from larder.operators.linear import OlsFit, RidgeFit, breusch_pagan, ordinary_least_squares, ridge_by_folds
from larder.operators.ranks import medians, values_at_ranks
from larder.operators.segmentation import SINGLE_TRIP
from larder.operators.tabulate import union_all
from larder.session import materialise, small_table

# Model inputs and settings.
FEATURES = (
    "log_recency",
    "log_frequency",
    "log_monetary",
    "obs_tenure_days",
    "obs_weekend_trip_share",
    "obs_top_store_trip_share",
    "obs_retail_disc_rate",
    "obs_coupon_disc_rate",
    "log_weight",
    "log_gap",
    "obs_basket_trend_direction",
    "has_trend_obs",
    "obs_private_label_spend_share",
    "sqrt_top_cat",
    "log_campaigns",
    "is_concurrent_arm",
    "is_single_trip_obs",
    "is_redemption_eligible",
    "obs_redemption_propensity",
)
ALPHAS = (0.1, 1.0, 10.0, 100.0, 1_000.0, 10_000.0)
HOLDOUT, FOLDS, SEED = 0.20, 5, 42
TREES, LEARNING_RATE, DEPTH, SUBSAMPLE, MIN_LEAF = 400, 0.05, 4, 0.8, 20


def impute_for_value(split: DataFrame) -> DataFrame:
    """Households with history; structural gaps filled and flagged."""
    given = lambda c: F.col(c).isNotNull().cast("double")
    return split.filter(~F.col("is_pred_only")).withColumns(
        {
            "is_single_trip_obs": 1.0 - given("obs_mean_gap_days"),
            "obs_mean_gap_days": F.coalesce("obs_mean_gap_days", F.col("obs_recency_days").cast("double")),
            "obs_std_gap_days": F.coalesce("obs_std_gap_days", F.lit(0.0)),
            "has_trend_obs": given("obs_basket_trend_direction"),
            "obs_basket_trend_direction": F.coalesce(F.col("obs_basket_trend_direction").cast("double"), F.lit(2.0)),
            "is_redemption_eligible": given("obs_redemption_propensity"),
            "obs_redemption_propensity": F.coalesce("obs_redemption_propensity", F.lit(0.0)),
            "obs_top_category_spend_share": F.coalesce("obs_top_category_spend_share", F.lit(0.0)),
            "is_concurrent_arm": F.coalesce(F.col("is_concurrent_arm").cast("double"), F.lit(0.0)),
            "n_campaigns_exposed": F.coalesce(F.col("n_campaigns_exposed").cast("double"), F.lit(0.0)),
        }
    )


def transform_for_value(imputed: DataFrame) -> DataFrame:
    """Straightened inputs; logs of money and days floor at one hundredth."""
    log = lambda c: F.log(F.greatest(F.col(c).cast("double"), F.lit(0.01)))
    return imputed.withColumns(
        {
            "log_recency": log("obs_recency_days"),
            "log_frequency": F.log1p("obs_frequency"),
            "log_monetary": log("obs_monetary"),
            "log_gap": log("obs_mean_gap_days"),
            "log_weight": F.log1p(F.coalesce("obs_weight_sold_spend_share", F.lit(0.0))),
            "sqrt_top_cat": F.sqrt("obs_top_category_spend_share"),
            "log_campaigns": F.log1p("n_campaigns_exposed"),
            **{
                c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                for c in FEATURES
                if c.startswith("obs_") and c not in ("obs_basket_trend_direction", "obs_redemption_propensity")
            },
        }
    )


def holdout_flag(df: DataFrame, stratum: Column, key: str, share: float = HOLDOUT, seed: int = SEED) -> DataFrame:
    """Mark the same share of every stratum as holdout, by rank of a hashed key.

    The draw depends on the key and seed alone. ``df`` is read several times:
    pass a stored table.
    """
    hashed = df.withColumn("stratum", stratum).withColumn("draw", F.xxhash64(key, F.lit(seed)))
    values = hashed.select("stratum", F.col("draw").alias("value"))
    sizes = small_table(values.groupBy("stratum").agg(F.round(F.count(F.lit(1)) * share).cast("bigint").alias("rank")))
    cuts = small_table(values_at_ranks(values, sizes, ["stratum"], []).select("stratum", F.col("value").alias("cut")))
    flagged = hashed.join(cuts, "stratum", "left")
    return flagged.withColumn("is_holdout", F.coalesce(F.col("draw") <= F.col("cut"), F.lit(False))).drop("cut")


def prepare(split: DataFrame, assignments: DataFrame) -> DataFrame:
    """Model rows: inputs, targets, segment, holdout flag and fold."""
    segments = assignments.select("household_id", "cluster_name")
    rows = transform_for_value(impute_for_value(split)).join(segments, "household_id", "left")
    y = F.col("clv_pred_window")
    stored = materialise(
        rows.select(
            "household_id",
            F.coalesce("cluster_name", F.lit(SINGLE_TRIP)).alias("cluster_name"),
            "clv_pred_window",
            F.log1p(F.greatest(y, F.lit(0.0))).alias("log_value"),
            (y > 0).cast("double").alias("returned"),
            "obs_monetary",
            "obs_frequency",
            "obs_recency_days",
            *FEATURES,
        ),
        "value-rows",
    )
    flagged = holdout_flag(stored, F.col("returned"), "household_id")
    fold = F.pmod(F.xxhash64("household_id", F.lit(SEED + 1)), F.lit(FOLDS)).cast("int")
    return materialise(flagged.withColumn("fold", fold).drop("draw", "stratum"), "value-frame")


def logistic_penalty(n: int) -> float:
    """The MLlib setting equal to a unit inverse penalty on standardised inputs."""
    return (n - 1) / n**2


def assembled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="inputs").transform(df)


def fit_logistic(df: DataFrame, columns: Sequence[str], label: str) -> LogisticRegressionModel:
    n = df.count()
    return LogisticRegression(
        featuresCol="inputs",
        labelCol=label,
        probabilityCol="probabilities",
        regParam=logistic_penalty(n),
        standardization=True,
        maxIter=1000,
        tol=1e-6,
    ).fit(assembled(df, columns))


def with_probability(df: DataFrame, model: LogisticRegressionModel, columns: Sequence[str], name: str) -> DataFrame:
    scored = model.transform(assembled(df, columns))
    return scored.withColumn(name, vector_to_array("probabilities")[1]).drop(
        "inputs", "probabilities", "rawPrediction", "prediction"
    )


def metrics(scored: DataFrame, actual: str, predictions: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R squared of predictions floored at zero, with the share below zero."""

    def one(name: str) -> DataFrame:
        error = F.col(actual) - F.greatest(F.col(name), F.lit(0.0))
        n, total = F.count(F.lit(1)), F.var_pop(actual) * F.count(F.lit(1))
        return (
            scored.groupBy(*by)
            .agg(
                n.alias("n"),
                F.sqrt(F.avg(error * error)).alias("rmse"),
                F.avg(F.abs(error)).alias("mae"),
                (1 - F.sum(error * error) / F.nullif(total, F.lit(0.0))).alias("r2"),
                (100 * F.avg((F.col(name) < 0).cast("double"))).alias("neg_pct"),
            )
            .withColumn("model", F.lit(name))
        )

    return union_all([one(name) for name in predictions])


def metrics_by_segment(scored: DataFrame, segment: str, actual: str, prediction: str) -> DataFrame:
    """Size, zero share, RMSE, MAE and median absolute error per segment.

    ``scored`` is read several times: pass a stored table.
    """
    error = F.abs(F.col(actual) - F.greatest(F.col(prediction), F.lit(0.0)))
    rows = scored.select(segment, actual, error.alias("abs_error"))
    middle = medians(rows, [segment], ["abs_error"]).withColumnRenamed("abs_error", "medae")
    summary = rows.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"),
        (100 * F.avg((F.col(actual) == 0).cast("double"))).alias("zero_pct"),
        F.sqrt(F.avg(F.col("abs_error") * F.col("abs_error"))).alias("rmse"),
        F.avg("abs_error").alias("mae"),
    )
    return small_table(summary).join(middle, segment)


@dataclass
class ValueModels:
    frame: DataFrame

    @cached_property
    def train(self) -> DataFrame:
        return self.frame.filter(~F.col("is_holdout"))

    @cached_property
    def holdout(self) -> DataFrame:
        return self.frame.filter("is_holdout")

    @cached_property
    def ols(self) -> OlsFit:
        return ordinary_least_squares(self.train, FEATURES, "log_value")

    @cached_property
    def ridge(self) -> RidgeFit:
        return ridge_by_folds(self.train, FEATURES, "log_value", "fold", ALPHAS)

    @cached_property
    def returning_ridge(self) -> RidgeFit:
        return ridge_by_folds(self.train.filter("returned = 1"), FEATURES, "log_value", "fold", ALPHAS)

    @cached_property
    def returning(self) -> LogisticRegressionModel:
        return fit_logistic(self.train, FEATURES, "returned")

    @cached_property
    def boosted(self) -> GBTRegressionModel:
        rows = assembled(self.train, FEATURES).select("inputs", "log_value").persist()
        try:
            return GBTRegressor(
                featuresCol="inputs",
                labelCol="log_value",
                predictionCol="boosted_log",
                maxIter=TREES,
                stepSize=LEARNING_RATE,
                maxDepth=DEPTH,
                subsamplingRate=SUBSAMPLE,
                minInstancesPerNode=MIN_LEAF,
                seed=SEED,
            ).fit(rows)
        finally:
            rows.unpersist()

    def with_hurdle(self, df: DataFrame) -> DataFrame:
        """Chance of returning times the spend expected of those who return."""
        spend = F.greatest(F.expm1(self.returning_ridge.predict()), F.lit(0.0))
        scored = with_probability(df, self.returning, FEATURES, "p_return")
        return scored.withColumn("hurdle", F.col("p_return") * spend)

    def with_boosted(self, df: DataFrame) -> DataFrame:
        scored = self.boosted.transform(assembled(df, FEATURES))
        return scored.withColumn("gbm", F.expm1("boosted_log")).drop("inputs", "boosted_log")

    def with_linear(self, df: DataFrame) -> DataFrame:
        return df.withColumns({"ols": F.expm1(self.ols.predict()), "ridge": F.expm1(self.ridge.predict())})

    def null_value(self) -> float:
        """The median training value."""
        return medians(self.train.withColumn("_all", F.lit(0)), ["_all"], ["clv_pred_window"]).first()[1]

    def comparison(self) -> DataFrame:
        """Holdout metrics of every model and of the median baseline."""
        scored = self.with_linear(self.with_hurdle(self.holdout)).withColumn("null", F.lit(self.null_value()))
        scored = materialise(self.with_boosted(scored), "value-holdout")
        return metrics(scored, "clv_pred_window", ["ols", "ridge", "gbm", "hurdle", "null"])

    def diagnostics(self) -> DataFrame:
        lm, p = breusch_pagan(self.train, self.ols, "log_value")
        row = (lm, p, self.ols.r_squared, self.ols.adjusted_r_squared, self.ridge.alpha, self.returning_ridge.alpha)
        return self.frame.sparkSession.createDataFrame(
            [tuple(float(v) for v in row)],
            "bp_lm DOUBLE, bp_p DOUBLE, r2 DOUBLE, r2_adjusted DOUBLE, ridge_alpha DOUBLE, returning_alpha DOUBLE",
        )

    def coefficients(self) -> DataFrame:
        """Least-squares coefficients with errors, percent effect and stars."""
        fit = self.ols
        rows = [
            (name, float(b), float(e), float(p))
            for name, b, e, p in zip(fit.columns, fit.coefficients[1:], fit.standard_errors[1:], fit.p_values[1:])
        ]
        table = self.frame.sparkSession.createDataFrame(rows, "feature STRING, coef DOUBLE, se DOUBLE, p DOUBLE")
        return (
            table.withColumn("pct_per_unit", 100 * F.expm1("coef"))
            .withColumn("sig", stars(F.col("p")))
            .orderBy(F.desc("coef"))
        )

    def return_coefficients(self) -> DataFrame:
        """Logistic coefficients on the standardised scale."""
        row = self.train.agg(*[F.stddev_pop(c).alias(c) for c in FEATURES]).first()
        rows = [
            (name, float(b) * (row[name] or 0.0)) for name, b in zip(FEATURES, self.returning.coefficients.toArray())
        ]
        return self.frame.sparkSession.createDataFrame(rows, "feature STRING, coef DOUBLE").orderBy(F.desc("coef"))

    def importances(self) -> DataFrame:
        rows = list(zip(FEATURES, (float(v) for v in self.boosted.featureImportances.toArray())))
        return self.frame.sparkSession.createDataFrame(rows, "feature STRING, importance DOUBLE").orderBy(
            F.desc("importance")
        )

    def score_all(self) -> DataFrame:
        """Hurdle prediction for every household with history."""
        return self.with_hurdle(self.frame).select(
            "household_id",
            "cluster_name",
            "clv_pred_window",
            F.greatest("hurdle", F.lit(0.0)).alias("hurdle_pred_clv"),
            "obs_monetary",
            "obs_frequency",
            "obs_recency_days",
        )


def fit_value_models(split: DataFrame, assignments: DataFrame) -> ValueModels:
    return ValueModels(prepare(split, assignments))


def worst_residuals(scored: DataFrame, actual: str, prediction: str, n: int = 10) -> DataFrame:
    """The households predicted worst, largest absolute error first."""
    error = F.abs(F.col(actual) - F.greatest(F.col(prediction), F.lit(0.0)))
    return scored.withColumn("abs_error", error).orderBy(F.desc("abs_error"), "household_id").limit(n)
