"""Column expressions shared by the operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(money: Column) -> Column:
    """Money as whole cents, so that sums are exact whatever the order of rows."""
    return F.rint(money * 100).cast("bigint")


def dollars(total_cents: Column) -> Column:
    return total_cents / F.lit(100.0)


def round_to(x: Column, digits: int) -> Column:
    """Round half away from zero after scaling in binary floating point."""
    scale = float(10**digits)
    return F.round(x.cast("double") * scale) / scale


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL for a zero denominator."""
    return numerator.cast("double") / F.nullif(denominator.cast("double"), F.lit(0.0))


def at_midnight(day: date) -> Column:
    return F.lit(day.isoformat()).cast("timestamp_ntz")


def on_day(day: date) -> Column:
    return F.lit(day.isoformat()).cast("date")


def calendar_quarter(ts: Column) -> Column:
    """Year and quarter, like 2017-Q3."""
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7)


def net_revenue() -> Column:
    """Coupons are taken off; the retail discount already is."""
    return F.col("sales_value") - F.col("coupon_disc") - F.col("coupon_match_disc")


def shelf_price() -> Column:
    return F.col("sales_value") + F.col("retail_disc")


def trend_direction(change: Column, band: float) -> Column:
    """1 falling, 2 flat, 3 rising; NULL stays NULL."""
    return F.when(change < -band, 1).when(change > band, 3).when(change.isNotNull(), 2)


def rfm_code(*scores: str) -> Column:
    return F.concat(*[F.col(s).cast("string") for s in scores])


# Names of the rule-based customer classes.
CHAMPIONS, LOYAL, NEW, MID_TIER, AT_RISK, LOST = (
    "Champions",
    "Loyal",
    "New/Returning",
    "Mid-tier",
    "At-Risk",
    "Lost",
)


def rfm_class(r: Column, f: Column, m: Column) -> Column:
    """Rule-based class of a household from its three quintile scores."""
    # The ordered rules; the first that holds decides.
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), CHAMPIONS)
        .when(f >= 4, LOYAL)
        .when((r >= 4) & (f <= 2), NEW)
        .when((r >= 3) & (f >= 3), MID_TIER)
        .when((r <= 2) & (f >= 3) & (m >= 3), AT_RISK)
        .when((r <= 2) & (f <= 2), LOST)
        .otherwise(MID_TIER)
    )


def window_truncation(start: Column, end: Column, first: Column, last: Column) -> Column:
    """How a campaign window sticks out of the observed window: both sides, left, right, or not."""
    return (
        F.when((start < first) & (end > last), "both_truncated")
        .when(start < first, "left_truncated")
        .when(end > last, "right_truncated")
        .otherwise("within_window")
    )


def exposure_group(n_campaigns: Column, concurrent: Column) -> Column:
    exposed = F.coalesce(n_campaigns, F.lit(0)) > 0
    return F.when(~exposed, "unexposed").otherwise(
        F.when(F.coalesce(concurrent, F.lit(False)), "concurrent").otherwise("single_arm")
    )


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


# The words of the published analysis for an association, an effect and a balance.
def association_label(cramers_v: Column) -> Column:
    strong, moderate = F.lit("strong association"), F.lit("moderate")
    return F.when(cramers_v >= 0.7, strong).when(cramers_v >= 0.5, moderate).when(cramers_v.isNotNull(), "adds information beyond M")


def effect_size_label(eta_squared: Column) -> Column:
    return F.when(eta_squared >= 0.14, "large").when(eta_squared >= 0.06, "medium").when(eta_squared.isNotNull(), "small")


def balance_label(smd: Column) -> Column:
    return F.when(F.abs(smd) < 0.10, "YES").when(smd.isNotNull(), "NO !")


def log_or_null(x: Column) -> Column:
    return F.when(x > 0, F.log(x))
