"""Row-level cleaning: derived money, flags, known products, household spine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.contract import DEMOGRAPHIC_COLUMNS, Study
from larder.functions.columns import net_revenue, shelf_price


def is_weight_sold(study: Study) -> Column:
    return F.col("product_id").isin(*study.weight_sold_products)


def with_known_flag(df: DataFrame, parent: DataFrame, key: str, flag: str) -> DataFrame:
    """Add a boolean telling whether ``key`` occurs in ``parent``; keeps every row."""
    known = parent.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(True))
    return df.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def transactions_base(transactions: DataFrame, products: DataFrame, study: Study) -> DataFrame:
    """All transaction rows with net revenue, shelf price and four row flags."""
    flagged = with_known_flag(transactions, products, "product_id", "is_known")
    return flagged.select(
        *transactions.columns,
        net_revenue().alias("net_revenue"),
        shelf_price().alias("shelf_price"),
        (~F.col("is_known")).alias("is_orphan_product"),
        is_weight_sold(study).alias("is_weight_sold"),
        (F.col("quantity") == 0).alias("is_coupon_adjustment"),
        ((F.col("quantity") > 0) & (F.col("sales_value") == 0)).alias("is_fully_discounted"),
    )


def known_product_rows(transactions: DataFrame, products: DataFrame) -> DataFrame:
    """Rows whose product exists. Coupon adjustment lines stay in."""
    return transactions.join(products.select("product_id"), "product_id", "left_semi")


def transactions_clean(transactions: DataFrame, products: DataFrame, study: Study) -> DataFrame:
    """The base columns over rows with a known product."""
    return (
        known_product_rows(transactions, products)
        .select(*transactions.columns)
        .select(
            "*",
            net_revenue().alias("net_revenue"),
            shelf_price().alias("shelf_price"),
            F.lit(False).alias("is_orphan_product"),
            is_weight_sold(study).alias("is_weight_sold"),
            (F.col("quantity") == 0).alias("is_coupon_adjustment"),
            ((F.col("quantity") > 0) & (F.col("sales_value") == 0)).alias("is_fully_discounted"),
        )
    )


def with_demographics(spine: DataFrame, demographics: DataFrame, *columns: str) -> DataFrame:
    """Left-join demographics to a household table, adding a coverage flag."""
    attributes = demographics.select(
        "household_id", F.lit(True).alias("has_demographics"), *columns
    )
    joined = spine.join(attributes, "household_id", "left")
    return joined.withColumn("has_demographics", F.coalesce("has_demographics", F.lit(False)))


def households(transactions: DataFrame, demographics: DataFrame) -> DataFrame:
    """Every household with any transaction, orphan products included."""
    spine = transactions.select("household_id").distinct()
    return with_demographics(spine, demographics, *DEMOGRAPHIC_COLUMNS)
