"""The eight panel tables, read from panel files or derived from order tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.contract import TABLES, Study
from larder.functions.columns import dollars
from larder.session import use_all_cores


@dataclass(frozen=True)
class Panel:
    transactions: DataFrame
    products: DataFrame
    demographics: DataFrame
    campaigns: DataFrame
    campaign_descriptions: DataFrame
    coupons: DataFrame
    coupon_redemptions: DataFrame
    promotions: DataFrame
    study: Study

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLES}

    def with_transactions(self, transactions: DataFrame) -> Panel:
        return replace(self, transactions=transactions)


def typed_scan(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read one Parquet table, naming and casting every declared column.

    A renamed column fails here; a retyped one is cast or fails.
    """
    source = spark.read.parquet(path)
    return source.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[table].schema.fields]
    )


def read_panel(spark: SparkSession, directory: str, study: Study = Study()) -> Panel:
    """The panel from a folder holding one Parquet file or folder per table."""
    root = PurePosixPath(directory) if "://" not in directory else directory.rstrip("/")
    return Panel(
        **{name: typed_scan(spark, f"{root}/{name}.parquet", name) for name in TABLES}, study=study
    )


# Fixed values of the derivation from order tables.
EPOCH, DAYS, FIRST_DAY = "1995-01-01", 366, "2017-01-01"
CAMPAIGNS, FIRST_CAMPAIGN_DAY = 27, "2016-12-15"
COUPON_BASE = 50_000_000_000
DERIVED_WEIGHT_SOLD = (7, 77, 177)


def derive_panel(spark: SparkSession, sf_dir: str) -> Panel:
    """A panel with the declared shape, derived from order-management tables.

    Dates fold into one study year. Money has whole cents.
    """

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    baskets = _baskets(table("orders"))
    lines = _order_lines(table("lineitem"), baskets)
    transactions = lines.drop("l_returnflag", "l_linestatus")
    filled = table("lineitem").select(F.col("l_orderkey").alias("basket_id"))
    shoppers = baskets.join(filled, "basket_id", "left_semi").select("household_id").distinct()
    descriptions = _campaign_descriptions(spark)
    signups = _signups(table("events"))
    return Panel(
        transactions=transactions,
        products=_products(table("part")),
        demographics=_demographics(table("customer")).join(shoppers, "household_id", "left_semi"),
        campaigns=signups.select("campaign_id", "household_id")
        .distinct()
        .join(shoppers, "household_id", "left_semi")
        .select("campaign_id", "household_id"),
        campaign_descriptions=descriptions,
        coupons=_coupons(table("part")),
        coupon_redemptions=_redemptions(signups, descriptions).join(
            shoppers, "household_id", "left_semi"
        ),
        promotions=lines.select(
            "product_id",
            "store_id",
            F.col("l_returnflag").alias("display_location"),
            F.col("l_linestatus").alias("mailer_location"),
            "week",
        ).distinct(),
        study=Study(weight_sold_products=DERIVED_WEIGHT_SOLD),
    )


def _baskets(orders: DataFrame) -> DataFrame:
    offset = F.pmod(F.datediff(F.col("o_orderdate"), F.lit(EPOCH)), F.lit(DAYS))
    return (
        orders.select(
            F.col("o_orderkey").alias("basket_id"),
            F.col("o_custkey").cast("int").alias("household_id"),
            offset.alias("day_off"),
        )
        # leaves some households without history before the split
        .filter(~((F.col("household_id") % 61 == 5) & (F.col("day_off") < 273)))
    )


def _order_lines(lineitem: DataFrame, baskets: DataFrame) -> DataFrame:
    adjustment = F.col("l_linenumber") == 7
    free = adjustment | ((F.col("l_linenumber") == 6) & (F.col("l_quantity") <= 2))
    # whole cents: price times percent, rounded half up
    price, percent = F.col("price"), F.rint(F.col("l_discount") * 100).cast("bigint")
    discount = F.when(adjustment, 0).otherwise(F.floor((price * percent + 50) / 100)).cast("bigint")
    items = use_all_cores(
        lineitem.select(
            "l_orderkey",
            "l_suppkey",
            "l_partkey",
            "l_linenumber",
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_returnflag",
            "l_linestatus",
        ),
        "l_orderkey",
        50_000,
    )
    items = (
        items.withColumn("price", F.rint(F.col("l_extendedprice") * 100).cast("bigint"))
        .withColumn("discount", discount)
        .select(
            F.col("l_orderkey").alias("basket_id"),
            F.col("l_suppkey").cast("int").alias("store_id"),
            F.col("l_partkey").cast("int").alias("product_id"),
            F.when(adjustment, 0).otherwise(F.col("l_quantity").cast("int")).alias("quantity"),
            dollars(F.when(free, 0).otherwise(price - F.col("discount"))).alias("sales_value"),
            dollars(F.col("discount")).alias("retail_disc"),
            F.when(adjustment, dollars(F.rint(F.col("l_tax") * 10_000))).otherwise(0.0).alias("coupon_disc"),
            F.when(adjustment & (F.col("l_returnflag") == "R"), 0.5).otherwise(0.0).alias("coupon_match_disc"),
            "l_returnflag",
            "l_linestatus",
        )
    )
    return items.join(baskets, "basket_id").select(
        "household_id",
        "store_id",
        "basket_id",
        "product_id",
        "quantity",
        "sales_value",
        "retail_disc",
        "coupon_disc",
        "coupon_match_disc",
        (F.floor(F.col("day_off") / 7) + 1).cast("smallint").alias("week"),
        F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("day_off"))
        .cast("timestamp_ntz")
        .alias("transaction_timestamp"),
        "l_returnflag",
        "l_linestatus",
    )


def _products(part: DataFrame) -> DataFrame:
    own_label = F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3", "Brand#4")
    return part.filter(F.col("p_partkey") % 100 != 13).select(
        F.col("p_partkey").cast("int").alias("product_id"),
        (F.col("p_partkey") % 50).cast("int").alias("manufacturer_id"),
        F.col("p_type").alias("department"),
        F.when(own_label, "Private").otherwise("National").alias("brand"),
        F.when(F.col("p_size") == 50, "COUPON/MISC ITEMS")
        .otherwise(F.concat("p_type", F.lit("-"), (F.col("p_size") % 10).cast("string")))
        .alias("product_category"),
        F.col("p_name").alias("product_type"),
        F.col("p_size").cast("string").alias("package_size"),
    )


def _pick(index, values: tuple[str | None, ...]):
    """The value at a 0-based position of a short fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _demographics(customer: DataFrame) -> DataFrame:
    third = F.floor(F.col("c_custkey") / 3)
    balance, size = F.col("c_acctbal"), F.col("c_nationkey") % 5 + 1
    segment = F.col("c_mktsegment")
    return customer.filter(F.col("c_custkey") % 3 == 0).select(
        F.col("c_custkey").cast("int").alias("household_id"),
        _pick(third % 6, ("19-24", "25-34", "35-44", "45-54", "55-64", "65+")).alias("age"),
        F.when(balance < 0, "Under 15K")
        .when(balance < 2500, "25-34K")
        .when(balance < 5000, "50-74K")
        .when(balance < 7500, "75-99K")
        .otherwise("150-174K")
        .alias("income"),
        _pick(third % 5, ("Homeowner", "Renter", "Probable Owner", "Probable Renter", None)).alias(
            "home_ownership"
        ),
        F.when(segment.isin("AUTOMOBILE", "BUILDING"), "Married")
        .when(segment != "HOUSEHOLD", "Unmarried")
        .alias("marital_status"),
        F.when(size == 5, "5+").otherwise(size.cast("string")).alias("household_size"),
        _pick(third % 4, ("1 Adult No Kids", "2 Adults No Kids", "1 Adult Kids", "2 Adults Kids")).alias(
            "household_comp"
        ),
        _pick(third % 4, ("0", "0", "1", "3+")).alias("kids_count"),
    )


def _signups(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "signup").select(
        (F.col("event_id") % CAMPAIGNS + 1).cast("smallint").alias("campaign_id"),
        (F.col("user_id") * 10 + F.col("event_id") % 10).cast("int").alias("household_id"),
        "event_id",
        "value",
    )


def _campaign_descriptions(spark: SparkSession) -> DataFrame:
    number = F.col("id").cast("int")
    start = F.date_add(F.lit(FIRST_CAMPAIGN_DAY).cast("date"), number * 13)
    return spark.range(1, CAMPAIGNS + 1, numPartitions=1).select(
        number.cast("smallint").alias("campaign_id"),
        _pick(number % 3, ("Type A", "Type B", "Type C")).alias("campaign_type"),
        start.cast("timestamp_ntz").alias("start_date"),
        F.date_add(start, 32 + 7 * (number % 3)).cast("timestamp_ntz").alias("end_date"),
    )


def _redemptions(signups: DataFrame, descriptions: DataFrame) -> DataFrame:
    start = F.col("start_date").cast("date")
    return (
        signups.filter(F.col("value") < 20)
        .groupBy("household_id", "campaign_id")
        .agg(F.max(F.col("event_id") % 30).cast("int").alias("delay"))
        .join(descriptions, "campaign_id")
        .select(
            "household_id",
            (COUPON_BASE + F.col("campaign_id")).cast("bigint").alias("coupon_upc"),
            "campaign_id",
            F.date_add(start, F.col("delay")).cast("timestamp_ntz").alias("redemption_date"),
        )
    )


def _coupons(part: DataFrame) -> DataFrame:
    campaign = F.col("p_partkey") % CAMPAIGNS + 1
    return part.select(
        (COUPON_BASE + campaign).cast("bigint").alias("coupon_upc"),
        F.col("p_partkey").cast("int").alias("product_id"),
        campaign.cast("smallint").alias("campaign_id"),
    )
