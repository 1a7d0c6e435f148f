"""The eight derived tables, from raw panel to features and the CLV split."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.columns import rfm_code
from larder.operators.cleaning import households, transactions_base, transactions_clean, with_demographics
from larder.operators.exposure import campaign_block, campaign_exposure, concurrency
from larder.operators.features import rfm_raw, trip_ledger
from larder.operators.household_sums import Period, household_measures
from larder.operators.ranks import Ntile, with_ntiles
from larder.session import materialise, remove_stored, stored_into
from larder.sources.panel import Panel

RFM_NTILES = (
    Ntile("r_score", "recency_days", 5, descending=True),
    Ntile("f_score", "frequency", 5),
    Ntile("f_decile", "frequency", 10),
    Ntile("m_score", "monetary", 5),
)
FEATURE_NTILES = (
    Ntile("gap_score", "mean_gap_days", 5, descending=True),
    Ntile("gap_decile", "mean_gap_days", 10, descending=True),
    Ntile("trend_score", "basket_trend_ratio", 5),
)
RFM_COLUMNS = (
    "household_id",
    "has_demographics",
    "recency_days",
    "frequency",
    "monetary",
    "r_score",
    "f_score",
    "m_score",
    "f_decile",
    "rfm_code",
)
BEHAVIOUR_COLUMNS = (
    "weekend_trip_share",
    "top_store_trip_share",
    "retail_disc_rate",
    "coupon_disc_rate",
    "weight_sold_spend_share",
    "mean_gap_days",
    "std_gap_days",
    "basket_trend_ratio",
    "basket_trend_direction",
    "private_label_spend_share",
    "top_category_spend_share",
    "top_category",
)


def v_transactions_base(panel: Panel) -> DataFrame:
    return transactions_base(panel.transactions, panel.products, panel.study)


def v_transactions_clean(panel: Panel) -> DataFrame:
    return transactions_clean(panel.transactions, panel.products, panel.study)


def v_households(panel: Panel) -> DataFrame:
    return households(panel.transactions, panel.demographics)


def v_campaign_exposure(panel: Panel) -> DataFrame:
    return campaign_exposure(panel.campaigns, panel.campaign_descriptions, panel.transactions)


def v_coupon_redemptions(panel: Panel) -> DataFrame:
    return panel.coupon_redemptions


def v_rfm_features(panel: Panel) -> DataFrame:
    """Recency, frequency and monetary value with quintiles, decile and code."""
    ledger = trip_ledger(panel.transactions, panel.products, panel.study)
    raw = with_demographics(rfm_raw(ledger, panel.study.analysis_date, panel.study), panel.demographics)
    scored = with_ntiles(materialise(raw, "rfm"), RFM_NTILES, "household_id")
    return scored.withColumn("rfm_code", rfm_code("r_score", "f_score", "m_score")).select(*RFM_COLUMNS)


WHOLE, OBSERVED = "p0", "p1"


def household_periods(panel: Panel, *wanted: str) -> DataFrame:
    """Measures per household of the whole study and of the time before the split; line items are joined once."""
    study = panel.study
    periods = {
        WHOLE: Period(study.analysis_date, study.trend_halves),
        OBSERVED: Period(study.split_date, study.split_halves, study.split_date),
    }
    wanted = wanted or tuple(periods)
    rows = household_measures(panel.transactions, panel.products, study, [periods[name] for name in wanted])
    return rows.select("household_id", *[F.col(f"p{i}").alias(name) for i, name in enumerate(wanted)])


def household_table(panel: Panel, periods: DataFrame | None = None) -> DataFrame:
    """Every measure of a household but its scores."""
    sums = (periods or household_periods(panel, WHOLE)).select("household_id", f"{WHOLE}.*")
    exposed = concurrency(panel.campaigns, panel.campaign_descriptions)
    campaigns = campaign_block(exposed, panel.coupon_redemptions)
    return with_demographics(sums.join(campaigns, "household_id", "left"), panel.demographics)


def v_household_features(panel: Panel, periods: DataFrame | None = None) -> DataFrame:
    """One row per household: scores, behaviour, campaigns and cadence buckets; ``periods`` if they are stored."""
    scored = with_ntiles(
        materialise(household_table(panel, periods), "household-features"), (*RFM_NTILES, *FEATURE_NTILES), "household_id"
    )
    return scored.withColumn("rfm_code", rfm_code("r_score", "f_score", "m_score")).select(
        *RFM_COLUMNS,
        "tenure_days",
        *BEHAVIOUR_COLUMNS,
        "mom_spend_ratio_dec_nov",
        "is_concurrent_arm",
        "n_campaigns_exposed",
        "redemption_propensity",
        "gap_score",
        "gap_decile",
        "trend_score",
    )


def v_clv_split(panel: Panel, periods: DataFrame | None = None) -> DataFrame:
    """Features from before the split date beside net revenue from after it; ``periods`` if they are stored."""
    split = panel.study.split_date
    sums = (periods or household_periods(panel, OBSERVED)).select("household_id", f"{OBSERVED}.*")
    observed = ("recency_days", "frequency", "monetary", "tenure_days", *BEHAVIOUR_COLUMNS)
    exposed = concurrency(panel.campaigns, panel.campaign_descriptions)
    campaigns = campaign_block(exposed, before_redemption(panel.coupon_redemptions, split)).withColumnRenamed(
        "redemption_propensity", "obs_redemption_propensity"
    )
    named = with_demographics(
        sums.join(campaigns, "household_id", "left"),
        panel.demographics,
        "age",
        "income",
        "household_size",
        "kids_count",
        "marital_status",
    )
    return named.select(
        "household_id",
        *[F.col(c).alias(f"obs_{c}") for c in observed],
        "is_concurrent_arm",
        "n_campaigns_exposed",
        "obs_redemption_propensity",
        "age",
        "income",
        "household_size",
        "kids_count",
        "marital_status",
        F.col("later_net").alias("clv_pred_window"),
        (~F.col("observed")).alias("is_pred_only"),
    )


def before_redemption(redemptions: DataFrame, split) -> DataFrame:
    return redemptions.filter(F.col("redemption_date") < F.lit(split.isoformat()).cast("timestamp_ntz"))


VIEWS: dict[str, Callable[[Panel], DataFrame]] = {
    "v_transactions_base": v_transactions_base,
    "v_transactions_clean": v_transactions_clean,
    "v_households": v_households,
    "v_campaign_exposure": v_campaign_exposure,
    "v_coupon_redemptions": v_coupon_redemptions,
    "v_rfm_features": v_rfm_features,
    "v_household_features": v_household_features,
    "v_clv_split": v_clv_split,
}


class ViewRegistry:
    """Raw and derived tables by name for SQL users; a derived table is built on first use.

    Opening the registry runs no job. Tables that are stored on the way are kept until
    ``close``, which drops the names too.
    """

    def __init__(self, spark: SparkSession, panel: Panel):
        self.spark, self.panel = spark, panel
        self._built: dict[str, DataFrame] = {}
        self._stored: list[str] = []
        for name, df in panel.tables().items():
            df.createOrReplaceTempView(name)

    def view(self, name: str) -> DataFrame:
        """A derived table, built and registered if it isn't yet."""
        if name not in self._built:
            with stored_into(self._stored):
                if name == "v_rfm_features":  # its columns are stored with the features
                    df = self.view("v_household_features").select(*RFM_COLUMNS)
                else:
                    df = VIEWS[name](self.panel)
            df.createOrReplaceTempView(name)
            self._built[name] = df
        return self._built[name]

    def sql(self, text: str) -> DataFrame:
        """``spark.sql`` after the derived tables that the text names are registered."""
        for name in VIEWS:
            if re.search(rf"\b{name}\b", text, re.IGNORECASE):
                self.view(name)
        return self.spark.sql(text)

    def close(self) -> None:
        for name in (*self.panel.tables(), *self._built):
            self.spark.catalog.dropTempView(name)
        remove_stored(self.spark, self._stored)
        self._built, self._stored = {}, []


def register_views(spark: SparkSession, panel: Panel) -> ViewRegistry:
    """Raw tables and derived tables by name for SQL users; no job runs yet."""
    return ViewRegistry(spark, panel)


def view_report(registry: ViewRegistry) -> DataFrame:
    """Rows and columns per derived table, counted in one query."""
    views = {name: registry.view(name) for name in VIEWS}
    counts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("view_name"), "n_rows", F.lit(len(df.columns)).alias("n_columns")
        )
        for name, df in views.items()
    ]
    return reduce(DataFrame.unionByName, counts)
