"""The declared shape of the customer panel: types, keys, references, counts."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    name: str
    ddl: str
    primary_key: tuple[str, ...]
    not_null: tuple[str, ...]
    pinned_rows: int
    pinned_bytes: int

    @property
    def columns(self) -> list[tuple[str, str]]:
        """Column names with their SQL types."""
        return [tuple(column.split()) for column in self.ddl.split(", ")]

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromDDL(self.ddl)


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str
    pinned_orphan_rows: int
    pinned_orphan_keys: int


# The published study's column types, keys and pinned counts.
TABLES: dict[str, TableSpec] = {
    spec.name: spec
    for spec in (
        TableSpec(
            "transactions",
            "household_id INT, store_id INT, basket_id BIGINT, product_id INT, quantity INT, "
            "sales_value DOUBLE, retail_disc DOUBLE, coupon_disc DOUBLE, coupon_match_disc DOUBLE, "
            "week SMALLINT, transaction_timestamp TIMESTAMP_NTZ",
            ("basket_id", "product_id"),
            ("household_id", "basket_id", "product_id", "store_id"),
            1_469_307,
            13_192_645,
        ),
        TableSpec(
            "products",
            "product_id INT, manufacturer_id INT, department STRING, brand STRING, "
            "product_category STRING, product_type STRING, package_size STRING",
            ("product_id",),
            ("product_id",),
            92_331,
            1_228_107,
        ),
        TableSpec(
            "demographics",
            "household_id INT, age STRING, income STRING, home_ownership STRING, marital_status STRING, "
            "household_size STRING, household_comp STRING, kids_count STRING",
            ("household_id",),
            ("household_id",),
            801,
            9_479,
        ),
        TableSpec(
            "campaigns",
            "campaign_id SMALLINT, household_id INT",
            ("household_id", "campaign_id"),
            ("campaign_id", "household_id"),
            6_589,
            16_544,
        ),
        TableSpec(
            "campaign_descriptions",
            "campaign_id SMALLINT, campaign_type STRING, start_date TIMESTAMP_NTZ, end_date TIMESTAMP_NTZ",
            ("campaign_id",),
            ("campaign_id",),
            27,
            1_955,
        ),
        TableSpec(
            "coupons",
            "coupon_upc BIGINT, product_id INT, campaign_id SMALLINT",
            (),
            ("coupon_upc", "product_id", "campaign_id"),
            116_204,
            424_871,
        ),
        TableSpec(
            "coupon_redemptions",
            "household_id INT, coupon_upc BIGINT, campaign_id SMALLINT, redemption_date TIMESTAMP_NTZ",
            (),
            ("household_id", "coupon_upc", "campaign_id"),
            2_102,
            13_589,
        ),
        TableSpec(
            "promotions",
            "product_id INT, store_id INT, display_location STRING, mailer_location STRING, week SMALLINT",
            (),
            ("product_id", "store_id"),
            20_940_529,
            21_567_722,
        ),
    )
}

# The order tables that a panel may be derived from.
ORDER_TABLES: dict[str, str] = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP, "
    "o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}

# Foreign keys with the orphans known to exist in the published study.
REFERENCES: tuple[Reference, ...] = (
    Reference("transactions", "product_id", "products", 4_836, 17),
    Reference("coupons", "product_id", "products", 16, 6),
    Reference("promotions", "product_id", "products", 0, 0),
    Reference("campaigns", "campaign_id", "campaign_descriptions", 0, 0),
    Reference("coupon_redemptions", "campaign_id", "campaign_descriptions", 0, 0),
    Reference("coupon_redemptions", "coupon_upc", "coupons", 0, 0),
)


@dataclass(frozen=True)
class Halves:
    """Two week ranges compared by the basket trend (inclusive bounds)."""

    first: tuple[int, int]
    second: tuple[int, int]


@dataclass(frozen=True)
class Study:
    """Dates and lists that parameterise the features. Defaults are fixed values."""

    analysis_date: date = date(2018, 1, 8)
    split_date: date = date(2017, 10, 1)
    year_end: date = date(2018, 1, 1)
    trend_halves: Halves = Halves((1, 26), (27, 53))
    split_halves: Halves = Halves((1, 19), (20, 39))
    earlier_month: tuple[date, date] = (date(2017, 11, 1), date(2017, 12, 1))
    later_month: tuple[date, date] = (date(2017, 12, 1), date(2018, 1, 1))
    weight_sold_products: tuple[int, ...] = (6534178, 6534166, 6544236)
    unranked_category: str = "COUPON/MISC ITEMS"
    private_brand: str = "Private"
    min_baskets_per_half: int = 3
    trend_band: float = 0.10


DEMOGRAPHIC_COLUMNS = (
    "age",
    "income",
    "home_ownership",
    "marital_status",
    "household_size",
    "household_comp",
    "kids_count",
)
