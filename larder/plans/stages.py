"""Stage tables of the analysis, each built once per session and data folder.

The stages hand over stored tables: features, split, labels, segments,
predictions, estimation arms. Everything is read back from Parquet.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.columns import exposure_group, rfm_class
from larder.plans.views import household_periods, v_campaign_exposure, v_clv_split, v_household_features
from larder.session import configure, materialise, scratch_path
from larder.sources.panel import Panel, derive_panel

_open: dict[tuple[str, str], "Stages"] = {}


class Stages:
    def __init__(self, spark: SparkSession, panel: Panel, folder: str):
        self.spark = spark
        self.panel = panel
        self.folder = folder

    @cached_property
    def ingested(self) -> str:
        """Folder with the eight panel tables as Parquet."""
        from larder.sources.files import write_panel

        path = scratch_path(self.spark, "panel")
        write_panel(self.panel, path)
        return path

    @cached_property
    def given_manifest(self) -> DataFrame:
        """Length and checksum of every given file, recorded when first asked for."""
        from larder.sources.files import file_checksums

        return materialise(file_checksums(self.spark, self.folder), "manifest")

    @cached_property
    def periods(self) -> DataFrame:
        """Measures per household of the whole study and before the split, from one pass over the lines."""
        return materialise(household_periods(self.panel), "periods")

    @cached_property
    def features(self) -> DataFrame:
        return materialise(v_household_features(self.panel, self.periods), "features")

    @cached_property
    def split(self) -> DataFrame:
        return materialise(v_clv_split(self.panel, self.periods), "split")

    @cached_property
    def exposure(self) -> DataFrame:
        return materialise(v_campaign_exposure(self.panel), "exposure")

    @cached_property
    def labelled(self) -> DataFrame:
        """Features with the rule-based class as ``segment``."""
        label = rfm_class(F.col("r_score"), F.col("f_score"), F.col("m_score"))
        return self.features.withColumn("segment", label)

    @cached_property
    def estimation(self) -> DataFrame:
        """Households with history: segment, outcome, covariates, exposure group."""
        split = self.panel.study.split_date.isoformat()
        redeemers = (
            self.panel.coupon_redemptions.filter(F.col("redemption_date") < F.lit(split).cast("timestamp_ntz"))
            .select("household_id", F.lit(True).alias("ever_redeemed"))
            .distinct()
        )
        frame = (
            self.split.filter(~F.col("is_pred_only"))
            .join(self.labelled.select("household_id", "segment", "m_score"), "household_id")
            .join(redeemers, "household_id", "left")
            .select(
                "household_id",
                "segment",
                "m_score",
                F.col("clv_pred_window").alias("outcome"),
                "obs_monetary",
                "obs_frequency",
                "obs_recency_days",
                "obs_tenure_days",
                exposure_group(F.col("n_campaigns_exposed"), F.col("is_concurrent_arm")).alias("exposure_group"),
                F.coalesce("ever_redeemed", F.lit(False)).alias("ever_redeemed"),
            )
        )
        return materialise(frame, "estimation")

    @cached_property
    def arms(self) -> DataFrame:
        """Single-arm and unexposed households with treatment and a stratum propensity."""
        from larder.operators.causal import treatment_arms, with_stratum_propensity

        return materialise(with_stratum_propensity(treatment_arms(self.estimation), ["segment", "m_score"]), "arms")

    @cached_property
    def segmentation(self):
        from larder.operators.segmentation import segment_households

        return segment_households(self.features)

    @cached_property
    def assignments(self) -> DataFrame:
        """k-means segment per household; single-day shoppers are not in it."""
        return materialise(self.segmentation.assignments, "assignments")

    @cached_property
    def value_models(self):
        from larder.operators.value_models import fit_value_models

        return fit_value_models(self.split, self.assignments)

    @cached_property
    def predictions(self) -> DataFrame:
        """Predicted value per household with history."""
        return materialise(self.value_models.score_all(), "predictions")

    @cached_property
    def effect_frame(self) -> DataFrame:
        """Predictions with exposure group, tenure and truncation flags."""
        from larder.operators.causal import effect_frame

        return materialise(effect_frame(self.predictions, self.split, self.exposure), "effect-frame")

    @cached_property
    def effect_arms(self) -> DataFrame:
        """Single-arm and unexposed households with the inputs of the effect models."""
        from larder.operators.causal import effect_arms

        return materialise(effect_arms(self.effect_frame), "effect-arms")

    @cached_property
    def panel_bootstrap(self):
        """Weighted effect over the panel with its interval, and the fitted propensity."""
        from larder.operators.causal import panel_effect

        table, propensity = panel_effect(self.effect_arms)
        return materialise(table, "panel-effect"), propensity

    @cached_property
    def segment_bootstrap(self) -> DataFrame:
        """Weighted effect of every segment with its interval."""
        from larder.operators.causal import segment_effects

        return materialise(segment_effects(self.effect_arms), "segment-effects")

    @cached_property
    def effects(self) -> DataFrame:
        """Naive, weighted and doubly robust effects, panel and segments, from the fits above."""
        from larder.operators.causal import campaign_effects

        return materialise(campaign_effects(self.effect_arms, *self.panel_bootstrap, self.segment_bootstrap), "effects")


def open_stages(spark: SparkSession, sf_dir: str) -> Stages:
    key = (spark.sparkContext.applicationId, str(sf_dir))
    if key not in _open:
        configure(spark)
        _open[key] = Stages(spark, derive_panel(spark, str(sf_dir)), str(sf_dir))
    return _open[key]
