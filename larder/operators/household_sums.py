"""All household sums of the line items from one scan, for several periods at once.

Lines join their products and go to their household in one shuffle: a household's sums,
and the short list of its lines that counts, days and categories come from, are made where
its lines meet. That list is bounded: households of more than ``MOST_LINES`` lines take
another way, four levels of grouped sums with partial sums in the tasks:

1. lines, joined to their products once, over two grouping sets: trips (household,
   store, basket, week, time) and categories (household, category);
2. trips as baskets per week, store visits, days, and spend after the split date;
3. baskets, and visits per store;
4. households.

The keys of its first three levels are wide, so a dominant household is spread over all
partitions until its rows have become a few sums. Its days are the only list that is
ever gathered: a calendar bounds it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import itemgetter

from pyspark.sql import Column, DataFrame
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
from larder.operators.cleaning import is_weight_sold
from larder.session import small_table

#: A household of more lines is summed level by level.
MOST_LINES = 50_000
_MONEY = ("net", "sales", "shelf", "retail_disc", "coupons", "weighed")
_TRIP = ("store_id", "basket_id", "week", "transaction_timestamp")
BASKET, VISIT, DAY, CATEGORY, LATER = "basket", "visit", "day", "category", "later"


@dataclass(frozen=True)
class Period:
    """Measures as of a day; with ``split`` of the time before it, and net revenue from it on."""

    as_of: date
    halves: Halves
    split: date | None = None

    def early(self) -> Column:
        return F.lit(True) if self.split is None else F.col("transaction_timestamp") < at_midnight(self.split)


def known_lines(transactions: DataFrame, products: DataFrame, study: Study) -> DataFrame:
    """Lines with a known product, in whole cents."""
    sales = cents(F.col("sales_value"))
    return transactions.join(products.select("product_id", "product_category", "brand"), "product_id").select(
        "household_id",
        *_TRIP,
        "product_category",
        cents(net_revenue()).alias("net"),
        sales.alias("sales"),
        cents(shelf_price()).alias("shelf"),
        cents(F.col("retail_disc")).alias("retail_disc"),
        cents(F.col("coupon_disc") + F.col("coupon_match_disc")).alias("coupons"),
        F.when(is_weight_sold(study), sales).otherwise(F.lit(0)).alias("weighed"),
        F.when(F.col("brand") == study.private_brand, sales).otherwise(F.lit(0)).alias("private"),
    )


def line_sums(transactions: DataFrame, products: DataFrame, study: Study, split: date | None = None) -> DataFrame:
    """Lines with a known product summed per trip and per category, in whole cents.

    Category sums leave out lines from ``split`` on; ``lines`` counts those that are in.
    """
    early = F.lit(True) if split is None else F.col("transaction_timestamp") < at_midnight(split)
    lines = known_lines(transactions, products, study).withColumns(
        {
            "early_sales": F.when(early, F.col("sales")),
            "private_sales": F.when(early, F.col("private")),
            "early": early.cast("int"),
        }
    )
    sets = [["household_id", *_TRIP], ["household_id", "product_category"]]
    return lines.groupingSets(
        [[F.col(c) for c in keys] for keys in sets], *[F.col(c) for c in ("household_id", *_TRIP, "product_category")]
    ).agg(
        F.grouping("product_category").alias("is_trip"),
        *[F.sum(c).alias(c) for c in _MONEY],
        F.sum("early_sales").alias("early_sales"),
        F.sum("private_sales").alias("private_sales"),
        F.sum("early").alias("lines"),
    )


def _within(span: tuple[date, date], value: str) -> Column:
    ts = F.col("transaction_timestamp")
    return F.when((ts >= at_midnight(span[0])) & (ts < at_midnight(span[1])), F.col(value))


def _parts(sums: DataFrame, study: Study, split: date | None) -> DataFrame:
    """Second level: one row per basket and week, store visit, day, category; spend after the split in one more."""
    ts = F.col("transaction_timestamp")
    # name and value of every field; an entry leaves those out that it has no use for
    fields = {
        "basket_id": F.col("basket_id"),
        "week": F.col("week"),
        "store_id": F.col("store_id"),
        "day": ts.cast("date"),
        "category": F.col("product_category"),
        **{c: F.col(c) for c in _MONEY},
        "early_month": _within(study.earlier_month, "net"),
        "late_month": _within(study.later_month, "net"),
        "at": ts,
        "private_sales": F.col("private_sales"),
    }
    kinds = dict(sums.select(*[value.alias(name) for name, value in fields.items()]).dtypes)

    def entry(part: str, *used: str, **other: Column) -> Column:
        values = [other.get(c, fields[c]) if c in used or c in other else F.lit(None).cast(kinds[c]) for c in fields]
        return F.struct(F.lit(part).alias("part"), *[v.alias(c) for c, v in zip(fields, values)])

    trip = F.array(
        entry(BASKET, "basket_id", "week", *_MONEY, "early_month", "late_month", "at"),
        entry(VISIT, "store_id", "basket_id"),
        entry(DAY, "day"),
    )
    if split is not None:
        trip = F.when(ts < at_midnight(split), trip).otherwise(F.array(entry(LATER, "net")))
    category = F.when(F.col("lines") > 0, F.array(entry(CATEGORY, "category", "private_sales", sales=F.col("early_sales"))))
    entries = sums.select("household_id", F.explode(F.when(F.col("is_trip") == 1, trip).otherwise(category)).alias("e"))
    return (
        entries.select("household_id", "e.*")
        .groupBy("household_id", "part", "basket_id", "week", "store_id", "day", "category")
        .agg(
            *[F.sum(c).alias(c) for c in (*_MONEY, "early_month", "late_month", "private_sales")],
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
        )
    )


def _units(parts: DataFrame, halves: Halves) -> DataFrame:
    """Third level: baskets over their weeks, stores over their visits; the rest as it is."""
    is_basket = F.col("part") == BASKET
    first, second = (is_basket & F.col("week").between(*half) for half in (halves.first, halves.second))
    return parts.groupBy(
        "household_id", "part", F.when(is_basket, F.col("basket_id")).alias("basket_id"), "store_id", "day", "category"
    ).agg(
        *[F.sum(c).alias(c) for c in (*_MONEY, "early_month", "late_month", "private_sales")],
        F.min("first_at").alias("first_at"),
        F.max("last_at").alias("last_at"),
        F.count("basket_id").alias("baskets"),
        F.count_if(first).alias("n1"),
        F.count_if(second).alias("n2"),
        F.sum(F.when(first, F.col("net"))).alias("net1"),
        F.sum(F.when(second, F.col("net"))).alias("net2"),
    )


def _folded(array: Column, zero: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]]) -> Column:
    """The last state of a walk along an array; a state is a struct of named values."""
    state = lambda values: F.struct(*[value.alias(name) for name, value in values.items()])
    return F.aggregate(array, state(zero), lambda a, x: state(step(a, x)))


def _none() -> Column:
    return F.lit(0).cast("bigint")


def _visits(rows: Column, kinds: dict[str, str]) -> Column:
    """Distinct baskets of a household's lines by store: ``most`` of a store and ``every`` one."""
    known = F.filter(rows, lambda r: r["basket_id"].isNotNull())
    pairs = F.array_sort(F.transform(known, lambda r: F.struct(r["store_id"].alias("store_id"), r["basket_id"].alias("basket_id"))))
    zero = {c: F.lit(None).cast(kinds[c]) for c in ("store_id", "basket_id")}

    def step(a: Column, x: Column) -> dict[str, Column]:
        there = a["store_id"].eqNullSafe(x["store_id"])
        again = there & a["basket_id"].eqNullSafe(x["basket_id"])
        run = F.when(again, a["run"]).when(there, a["run"] + 1).otherwise(F.lit(1).cast("bigint"))
        return {
            "store_id": x["store_id"],
            "basket_id": x["basket_id"],
            "run": run,
            "most": F.greatest(a["most"], run),
            "every": F.when(again, a["every"]).otherwise(a["every"] + 1),
        }

    return _folded(pairs, {**zero, "run": _none(), "most": _none(), "every": _none()}, step)


def _categories(rows: Column, study: Study) -> Column:
    """Sales of a household's ranked categories: ``best_name`` and ``best`` of the largest, ``every`` one's sum."""
    ranked = F.filter(rows, lambda r: r["product_category"] != study.unranked_category)
    sales = F.array_sort(
        F.transform(ranked, lambda r: F.struct(r["product_category"].alias("name"), F.coalesce(r["sales"], _none()).alias("sales")))
    )
    # the category that the walk is in counts when it ends; of equal ones the first name stays
    better = lambda a: a["name"].isNotNull() & (a["best_name"].isNull() | (a["total"] > a["best"]))

    def step(a: Column, x: Column) -> dict[str, Column]:
        same = a["name"].eqNullSafe(x["name"])
        ends = ~same & better(a)
        return {
            "name": x["name"],
            "total": F.when(same, a["total"] + x["sales"]).otherwise(x["sales"]),
            "best_name": F.when(ends, a["name"]).otherwise(a["best_name"]),
            "best": F.when(ends, a["total"]).otherwise(a["best"]),
            "every": a["every"] + x["sales"],
        }

    text = F.lit(None).cast("string")
    end = F.struct(F.lit(None).cast("string").alias("name"), _none().alias("sales"))
    walked = F.concat(sales, F.array(end))  # an end mark closes the last category
    return _folded(walked, {"name": text, "total": _none(), "best_name": text, "best": _none(), "every": _none()}, step)


def _basket_weeks(rows: Column, weeks: tuple[int, int]) -> Column:
    """Distinct baskets by week in a span of weeks."""
    inside = F.filter(rows, lambda r: r["week"].between(*weeks))
    # as text, of which Spark keeps a hash set; a missing basket leaves the week alone
    return F.size(F.array_distinct(F.transform(inside, lambda r: F.concat_ws(":", r["basket_id"], r["week"])))).cast("bigint")


def _gathered(lines: DataFrame, study: Study, periods: Sequence[Period]) -> DataFrame:
    """Measures of every period, ``p0`` on, of households whose lines fit a list; one shuffle."""
    kinds = dict(lines.dtypes)
    sums, lists, walks = [], {}, {}
    for i, period in enumerate(periods):
        early = period.early()
        of = lambda value, early=early: F.when(early, F.col(value) if isinstance(value, str) else value)
        first, second = (F.col("week").between(*half) for half in (period.halves.first, period.halves.second))
        values = {
            **{c: F.sum(of(c)) for c in _MONEY},
            "early_month": F.sum(of(_within(study.earlier_month, "net"))),
            "late_month": F.sum(of(_within(study.later_month, "net"))),
            "trips": F.count(of(F.lit(1))),
            "first_day": F.min(of("transaction_timestamp")).cast("date"),
            "last_day": F.max(of("transaction_timestamp")).cast("date"),
            "net1": F.sum(of(F.when(first, F.col("net")))),
            "net2": F.sum(of(F.when(second, F.col("net")))),
            "private_sales": F.sum(of("private")),
            "later": F.sum(F.when(~F.coalesce(early, F.lit(False)), F.col("net"))),
        }
        sums += [value.alias(f"{name}_{i}") for name, value in values.items()]
        lists[f"rows_{i}"] = F.col("rows") if period.split is None else F.filter("rows", itemgetter(f"early_{i}"))
        rows = F.col(f"rows_{i}")
        walks |= {
            f"frequency_{i}": F.size(F.array_compact(F.array_distinct(F.transform(rows, lambda r: r["basket_id"])))).cast("bigint"),
            f"n1_{i}": _basket_weeks(rows, period.halves.first),
            f"n2_{i}": _basket_weeks(rows, period.halves.second),
            f"days_{i}": F.array_sort(F.array_compact(F.array_distinct(F.transform(rows, lambda r: r["day"])))),
            f"visit_{i}": _visits(rows, kinds),
            f"category_{i}": _categories(rows, study),
        }
    listed = ("store_id", "basket_id", "week", "product_category", "sales")
    row = F.struct(
        *listed,
        F.col("transaction_timestamp").cast("date").alias("day"),
        *[p.early().alias(f"early_{i}") for i, p in enumerate(periods) if p.split],
    )
    # all of a household's lines meet in one task, where the grouping needs no further shuffle
    grouped = lines.repartition("household_id").groupBy("household_id").agg(*sums, F.collect_list(row).alias("rows"))
    found = grouped.withColumns(lists).withColumns(walks)
    same = (*_MONEY, "early_month", "late_month", "trips", "first_day", "last_day", "net1", "net2", "private_sales", "later")
    for i, period in enumerate(periods):
        category, visit = F.col(f"category_{i}"), F.col(f"visit_{i}")
        plain = {
            **{name: F.col(f"{name}_{i}") for name in (*same, "frequency", "n1", "n2", "days")},
            "weekend_days": F.size(F.filter(f"days_{i}", is_weekend)),
            "all_sales": F.col(f"sales_{i}"),
            "most_visits": visit["most"],
            "visits": visit["every"],
            "best": F.when(
                category["best_name"].isNotNull(),
                F.struct((-category["best"]).alias("minus_sales"), category["best_name"].alias("name")),
            ),
            "ranked_sales": category["every"],
        }
        found = found.withColumns(plain).withColumn(f"p{i}", F.struct(*_measured(period, study)))
    return found.select("household_id", *[f"p{i}" for i in range(len(periods))])


def _measured(period: Period, study: Study) -> list[Column]:
    """The measures of a household from its sums, NULL if nothing is in the period."""
    measures = {**_spend(period.as_of), **_cadence(), **_trend(period.halves, study), **_products()}
    seen = F.col("trips") > 0
    return [
        *[F.when(seen, measure).alias(name) for name, measure in measures.items()],
        seen.alias("observed"),
        F.coalesce(dollars(F.col("later")), F.lit(0.0)).alias("later_net"),
    ]


def household_measures(
    transactions: DataFrame, products: DataFrame, study: Study, periods: Sequence[Period], most_lines: int = MOST_LINES
) -> DataFrame:
    """One row per household with a struct of measures for each period: ``p0``, ``p1`` and so on.

    Measures are spend, store, cadence, trend and product measures as of a day. With a
    split they are of the time before it, NULL for households without any, ``observed``
    says which have some, and ``later_net`` is net revenue from it on.
    """
    sizes = transactions.groupBy("household_id").agg(F.count(F.lit(1)).alias("n"))
    large = small_table(sizes.filter(F.col("n") > most_lines).select("household_id"))
    if large.isEmpty():
        return _gathered(known_lines(transactions, products, study), study, periods)
    others = transactions.join(large, "household_id", "left_anti")
    theirs = transactions.join(large, "household_id", "left_semi")
    parts = [
        _summed(theirs, products, study, period).select("household_id", F.struct(*_measured(period, study)).alias(f"p{i}"))
        for i, period in enumerate(periods)
    ]
    summed = reduce(lambda a, b: a.join(b, "household_id"), parts)
    return _gathered(known_lines(others, products, study), study, periods).unionByName(summed)


def household_sums(
    transactions: DataFrame, products: DataFrame, as_of: date, halves: Halves, study: Study, split: date | None = None
) -> DataFrame:
    """One row per household: the measures of a single period."""
    return household_measures(transactions, products, study, [Period(as_of, halves, split)]).select("household_id", "p0.*")


def _summed(transactions: DataFrame, products: DataFrame, study: Study, period: Period) -> DataFrame:
    """Sums of households of any size, level by level."""
    halves, split = period.halves, period.split
    parts = _parts(line_sums(transactions, products, study, split), study, split)

    def of(part: str, value: str | Column) -> Column:
        return F.when(F.col("part") == part, F.col(value) if isinstance(value, str) else value)

    candidate = F.struct((-F.col("sales")).alias("minus_sales"), F.col("category").alias("name"))
    ranked = F.col("category") != study.unranked_category
    return _units(parts, halves).groupBy("household_id").agg(
        F.count(of(BASKET, "basket_id")).alias("frequency"),
        F.count(of(BASKET, F.lit(1))).alias("trips"),
        *[F.sum(of(BASKET, c)).alias(c) for c in (*_MONEY, "early_month", "late_month")],
        F.min(of(BASKET, "first_at")).cast("date").alias("first_day"),
        F.max(of(BASKET, "last_at")).cast("date").alias("last_day"),
        *[F.sum(of(BASKET, c)).alias(c) for c in ("n1", "n2", "net1", "net2")],
        F.max(of(VISIT, "baskets")).alias("most_visits"),
        F.sum(of(VISIT, "baskets")).alias("visits"),
        F.sort_array(F.collect_list(of(DAY, "day"))).alias("days"),
        F.count_if((F.col("part") == DAY) & is_weekend(F.col("day"))).alias("weekend_days"),
        F.sum(of(CATEGORY, "sales")).alias("all_sales"),
        F.sum(of(CATEGORY, "private_sales")).alias("private_sales"),
        F.min(of(CATEGORY, F.when(ranked, candidate))).alias("best"),
        F.sum(of(CATEGORY, F.when(ranked, F.col("sales")))).alias("ranked_sales"),
        F.sum(of(LATER, "net")).alias("later"),
    )


def _spend(as_of: date) -> dict[str, Column]:
    return {
        "recency_days": F.datediff(on_day(as_of), "last_day"),
        "frequency": F.col("frequency"),
        "monetary": dollars(F.col("net")),
        "tenure_days": F.datediff("last_day", "first_day"),
        "retail_disc_rate": round_to(ratio(F.col("retail_disc"), F.col("shelf")), 4),
        "coupon_disc_rate": round_to(ratio(F.col("coupons"), F.col("sales")), 4),
        "mom_spend_ratio_dec_nov": round_to(ratio(F.col("late_month"), F.col("early_month")) - 1, 4),
        "weight_sold_spend_share": round_to(ratio(F.col("weighed"), F.col("sales")), 4),
        "top_store_trip_share": round_to(ratio(F.col("most_visits"), F.col("visits")), 4),
    }


def _cadence() -> dict[str, Column]:
    """Mean and sample deviation of the gaps between days; weekend share of days."""
    n, total = F.size("days") - 1, F.datediff("last_day", "first_day")
    gaps = F.zip_with(F.slice("days", 2, F.size("days")), F.col("days"), lambda b, a: F.datediff(b, a).cast("bigint"))
    squares = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda s, gap: s + F.coalesce(gap * gap, F.lit(0)))
    return {
        "mean_gap_days": round_to(ratio(total, n), 2),
        "std_gap_days": round_to(F.sqrt(ratio(n * squares - total.cast("bigint") * total, n * (n - 1))), 2),
        "weekend_trip_share": round_to(ratio(F.col("weekend_days"), F.size("days")), 4),
    }


def _trend(halves: Halves, study: Study) -> dict[str, Column]:
    """Change of the mean basket from the first to the second half."""
    enough = (F.col("n1") >= study.min_baskets_per_half) & (F.col("n2") >= study.min_baskets_per_half)
    mean1, mean2 = (dollars(F.col(f"net{i}")) / F.col(f"n{i}") for i in (1, 2))
    change = F.when(enough, ratio(mean2 - mean1, mean1))
    return {
        "basket_trend_ratio": round_to(change, 4),
        "basket_trend_direction": trend_direction(change, study.trend_band),
    }


def _products() -> dict[str, Column]:
    """Own-label share of all sales, top category and its share of ranked sales."""
    return {
        "private_label_spend_share": round_to(ratio(F.col("private_sales"), F.col("all_sales")), 4),
        "top_category_spend_share": round_to(ratio(-F.col("best.minus_sales"), F.col("ranked_sales")), 4),
        "top_category": F.col("best.name"),
    }
