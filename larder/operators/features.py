"""Household feature blocks over the trip ledger, each keyed by household_id."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.contract import Halves, Study
from larder.functions.columns import (
    at_midnight,
    cents,
    dollars,
    is_weekend,
    net_revenue,
    on_day,
    ratio,
    round_to,
    shelf_price,
    trend_direction,
)
from larder.operators.cleaning import is_weight_sold, known_product_rows

LEDGER_KEYS = ("household_id", "store_id", "basket_id", "week", "transaction_timestamp")


def trip_ledger(transactions: DataFrame, products: DataFrame, study: Study) -> DataFrame:
    """Clean lines summed per household, store, basket and time, in whole cents.

    The single blocks below are further sums of this table; ``household_sums`` makes
    all of them from one scan. The grouping key is wide enough that a dominant
    household spreads over all partitions.
    """
    weighed = F.when(is_weight_sold(study), cents(F.col("sales_value"))).otherwise(F.lit(0))
    return (
        known_product_rows(transactions, products)
        .groupBy(*LEDGER_KEYS)
        .agg(
            F.sum(cents(net_revenue())).alias("net"),
            F.sum(cents(F.col("sales_value"))).alias("sales"),
            F.sum(cents(shelf_price())).alias("shelf"),
            F.sum(cents(F.col("retail_disc"))).alias("retail_disc"),
            F.sum(cents(F.col("coupon_disc") + F.col("coupon_match_disc"))).alias("coupons"),
            F.sum(weighed).alias("weighed"),
        )
    )


def before(ledger: DataFrame, day: date) -> DataFrame:
    return ledger.filter(F.col("transaction_timestamp") < at_midnight(day))


def from_day(ledger: DataFrame, day: date) -> DataFrame:
    return ledger.filter(F.col("transaction_timestamp") >= at_midnight(day))


def _month_net(span: tuple[date, date]) -> Column:
    ts = F.col("transaction_timestamp")
    inside = (ts >= at_midnight(span[0])) & (ts < at_midnight(span[1]))
    return F.sum(F.when(inside, F.col("net")))


def spend_block(ledger: DataFrame, as_of: date, study: Study) -> DataFrame:
    """Recency, frequency, monetary value, tenure, discount rates, month change, weight-sold share."""
    first, last = F.min("transaction_timestamp").cast("date"), F.max("transaction_timestamp").cast("date")
    month_change = ratio(_month_net(study.later_month), _month_net(study.earlier_month)) - 1
    return ledger.groupBy("household_id").agg(
        F.datediff(on_day(as_of), last).alias("recency_days"),
        F.countDistinct("basket_id").alias("frequency"),
        dollars(F.sum("net")).alias("monetary"),
        F.datediff(last, first).alias("tenure_days"),
        round_to(ratio(F.sum("retail_disc"), F.sum("shelf")), 4).alias("retail_disc_rate"),
        round_to(ratio(F.sum("coupons"), F.sum("sales")), 4).alias("coupon_disc_rate"),
        round_to(month_change, 4).alias("mom_spend_ratio_dec_nov"),
        round_to(ratio(F.sum("weighed"), F.sum("sales")), 4).alias("weight_sold_spend_share"),
    )


def rfm_raw(ledger: DataFrame, as_of: date, study: Study) -> DataFrame:
    """Recency in days, distinct baskets and net revenue alone."""
    return spend_block(ledger, as_of, study).select("household_id", "recency_days", "frequency", "monetary")


def store_block(ledger: DataFrame) -> DataFrame:
    """Share of trips made to the most visited store."""
    visits = ledger.groupBy("household_id", "store_id").agg(
        F.countDistinct("basket_id").alias("visits")
    )
    return visits.groupBy("household_id").agg(
        round_to(ratio(F.max("visits"), F.sum("visits")), 4).alias("top_store_trip_share")
    )


def shopping_days(ledger: DataFrame) -> DataFrame:
    """One row per household and shopping day with the gap since the previous one."""
    days = ledger.select(
        "household_id", F.col("transaction_timestamp").cast("date").alias("trip_date")
    ).distinct()
    history = Window.partitionBy("household_id").orderBy("trip_date")
    return days.withColumn("gap_days", F.datediff("trip_date", F.lag("trip_date").over(history)))


def cadence_block(ledger: DataFrame) -> DataFrame:
    """Mean and sample deviation of gaps between days; weekend share of days.

    The deviation comes from integer sums, so it does not depend on row order.
    """
    n, total = F.count("gap_days"), F.sum("gap_days")
    squares = F.sum(F.col("gap_days").cast("bigint") * F.col("gap_days"))
    variance = ratio(n * squares - total * total, n * (n - 1))
    weekend_days = F.count_if(is_weekend(F.col("trip_date")))
    return (
        shopping_days(ledger)
        .groupBy("household_id")
        .agg(
            round_to(ratio(total, n), 2).alias("mean_gap_days"),
            round_to(F.sqrt(variance), 2).alias("std_gap_days"),
            round_to(ratio(weekend_days, F.count(F.lit(1))), 4).alias("weekend_trip_share"),
        )
    )


def basket_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("household_id", "basket_id", "week").agg(F.sum("net").alias("net"))


def trend_block(ledger: DataFrame, halves: Halves, study: Study) -> DataFrame:
    """Change of the mean basket from the first to the second half."""
    in_first = F.col("week").between(*halves.first)
    in_second = F.col("week").between(*halves.second)
    enough = study.min_baskets_per_half
    per_household = (
        basket_totals(ledger)
        .groupBy("household_id")
        .agg(
            F.count_if(in_first).alias("n1"),
            F.count_if(in_second).alias("n2"),
            dollars(F.sum(F.when(in_first, F.col("net")))).alias("net1"),
            dollars(F.sum(F.when(in_second, F.col("net")))).alias("net2"),
        )
        .filter((F.col("n1") >= enough) & (F.col("n2") >= enough))
        .select(
            "household_id", (F.col("net1") / F.col("n1")).alias("avg1"), (F.col("net2") / F.col("n2")).alias("avg2")
        )
        .withColumn("change", ratio(F.col("avg2") - F.col("avg1"), F.col("avg1")))
    )
    return per_household.select(
        "household_id",
        round_to(F.col("change"), 4).alias("basket_trend_ratio"),
        trend_direction(F.col("change"), study.trend_band).alias("basket_trend_direction"),
    )


def category_spend(transactions: DataFrame, products: DataFrame, study: Study) -> DataFrame:
    """Sales per household and category, with the own-label part."""
    sales = cents(F.col("sales_value"))
    return (
        transactions.select("household_id", "product_id", "sales_value")
        .join(products.select("product_id", "product_category", "brand"), "product_id")
        .groupBy("household_id", "product_category")
        .agg(
            F.sum(sales).alias("sales"),
            F.sum(F.when(F.col("brand") == study.private_brand, sales).otherwise(F.lit(0))).alias("private_sales"),
        )
    )


def top_category(spend: DataFrame, study: Study) -> DataFrame:
    """The best-selling ranked category per household; ties go to the first name."""
    best = F.min(F.struct((-F.col("sales")).alias("minus_sales"), F.col("product_category").alias("name")))
    return (
        spend.filter(F.col("product_category") != study.unranked_category)
        .groupBy("household_id")
        .agg(best.alias("best"), F.sum("sales").alias("ranked_sales"))
        .select(
            "household_id",
            F.col("best.name").alias("top_category"),
            (-F.col("best.minus_sales")).alias("top_sales"),
            "ranked_sales",
        )
    )


def product_block(spend: DataFrame, study: Study) -> DataFrame:
    """Own-label share of all sales, top category and its share of ranked sales."""
    ranked = F.col("product_category") != study.unranked_category
    candidate = F.struct((-F.col("sales")).alias("minus_sales"), F.col("product_category").alias("name"))
    return (
        spend.groupBy("household_id")
        .agg(
            round_to(ratio(F.sum("private_sales"), F.sum("sales")), 4).alias("private_label_spend_share"),
            F.min(F.when(ranked, candidate)).alias("best"),
            F.sum(F.when(ranked, F.col("sales"))).alias("ranked_sales"),
        )
        .select(
            "household_id",
            "private_label_spend_share",
            round_to(ratio(-F.col("best.minus_sales"), F.col("ranked_sales")), 4).alias("top_category_spend_share"),
            F.col("best.name").alias("top_category"),
        )
    )
