"""Edge rules of cleaning, feature blocks and exposure on hand-made rows."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larder.contract import TABLES, Study
from larder.functions.columns import rfm_class, round_to, window_truncation
from larder.operators import exposure, features
from larder.operators.cleaning import households, transactions_base, transactions_clean
from larder.operators.household_sums import household_sums
from larder.operators.ordered_joins import at_or_before, touching_pairs
from larder.operators.retention import retention_matrix
from larder.plans import views
from larder.sources.panel import derive_panel

SMALL = "/root/testdata/sf0.001"
STUDY = Study(weight_sold_products=(7,))


def lines(spark, rows):
    """(household, store, basket, product, quantity, sales, coupon, day) rows as transactions."""
    full = [
        (h, s, b, p, q, float(v), 0.0, float(c), 0.0, (d - date(2017, 1, 1)).days // 7 + 1, datetime(d.year, d.month, d.day))
        for h, s, b, p, q, v, c, d in rows
    ]
    return spark.createDataFrame(full, TABLES["transactions"].schema)


def goods(spark, rows):
    return spark.createDataFrame(
        [(p, 1, "D", brand, cat, "t", "1") for p, cat, brand in rows], TABLES["products"].schema
    )


PRODUCTS = [(1, "MILK", "Private"), (2, "BREAD", "National"), (3, "COUPON/MISC ITEMS", "National")]


def one(df, **where):
    for key, value in where.items():
        df = df.filter(F.col(key) == value)
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def ledger(spark, rows):
    return features.trip_ledger(lines(spark, rows), goods(spark, PRODUCTS), STUDY)


def test_flags_and_net_revenue(spark):
    day = date(2017, 3, 1)
    txn = lines(spark, [(1, 1, 1, 1, 0, 0, 2.0, day), (1, 1, 1, 2, 3, 0, 0, day), (1, 1, 1, 99, 1, 5, 0, day), (1, 1, 1, 7, 1, 5, 0, day)])
    base = transactions_base(txn, goods(spark, [*PRODUCTS, (7, "FRUIT", "National")]), STUDY)
    coupon = one(base, product_id=1)
    assert coupon.net_revenue == -2.0 and coupon.is_coupon_adjustment and not coupon.is_fully_discounted
    assert one(base, product_id=2).is_fully_discounted
    assert one(base, product_id=99).is_orphan_product
    assert one(base, product_id=7).is_weight_sold
    clean = transactions_clean(txn, goods(spark, PRODUCTS), STUDY)
    assert {r.product_id for r in clean.collect()} == {1, 2}
    assert clean.columns == base.columns


def test_spine_keeps_households_with_orphans_only(spark):
    txn = lines(spark, [(1, 1, 1, 99, 1, 5, 0, date(2017, 1, 5))])
    demo = spark.createDataFrame([], TABLES["demographics"].schema)
    assert one(households(txn, demo)).has_demographics is False


def test_single_and_two_day_cadence(spark):
    rows = [
        (1, 1, 1, 1, 1, 1, 0, date(2017, 1, 7)),
        (1, 1, 2, 1, 1, 1, 0, date(2017, 1, 7)),
        (2, 1, 3, 1, 1, 1, 0, date(2017, 1, 7)),
        (2, 1, 4, 1, 1, 1, 0, date(2017, 1, 17)),
    ]
    cadence = features.cadence_block(ledger(spark, rows))
    alone, pair = one(cadence, household_id=1), one(cadence, household_id=2)
    assert alone.mean_gap_days is None and alone.std_gap_days is None and alone.weekend_trip_share == 1.0
    assert pair.mean_gap_days == 10.0 and pair.std_gap_days is None and pair.weekend_trip_share == 0.5
    spend = one(features.spend_block(ledger(spark, rows), STUDY.analysis_date, STUDY), household_id=1)
    assert spend.tenure_days == 0 and spend.frequency == 2 and spend.recency_days == 366


@pytest.mark.parametrize("late,expected", [(2, None), (3, (1.0, 3))])
def test_trend_needs_three_baskets_in_each_half(spark, late, expected):
    rows = [(1, 1, b, 1, 1, 10, 0, date(2017, 2, 1 + b)) for b in range(3)]
    rows += [(1, 1, 10 + b, 1, 1, 20, 0, date(2017, 9, 1 + b)) for b in range(late)]
    found = features.trend_block(ledger(spark, rows), STUDY.trend_halves, STUDY).collect()
    got = (found[0].basket_trend_ratio, found[0].basket_trend_direction) if found else None
    assert got == expected


def test_only_coupon_items_has_no_top_category(spark):
    day = date(2017, 1, 1)
    txn = lines(spark, [(1, 1, 1, 3, 1, 5, 0, day), (2, 1, 2, 1, 1, 4, 0, day), (2, 1, 2, 2, 1, 4, 0, day), (2, 1, 2, 3, 1, 8, 0, day)])
    block = features.product_block(features.category_spend(txn, goods(spark, PRODUCTS), STUDY), STUDY)
    only = one(block, household_id=1)
    assert only.top_category is None and only.top_category_spend_share is None
    tied = one(block, household_id=2)
    assert (tied.top_category, tied.top_category_spend_share, tied.private_label_spend_share) == ("BREAD", 0.5, 0.25)


def test_zero_denominators_give_null(spark):
    block = one(features.spend_block(ledger(spark, [(1, 1, 1, 1, 0, 0, 1, date(2017, 1, 1))]), STUDY.analysis_date, STUDY))
    assert block.coupon_disc_rate is None and block.retail_disc_rate is None and block.monetary == -1.0


def test_touching_windows_overlap_and_random_windows_match_pairs(spark):
    rng = random.Random(5)
    rows = [(h, c, (s := rng.randrange(60)), s + rng.randrange(15)) for h in range(20) for c in range(rng.randrange(1, 12))]
    rows += [(99, 1, 0, 10), (99, 2, 10, 20), (99, 3, 21, 22)]
    df = spark.createDataFrame(rows, "h INT, c INT, s INT, e INT")
    got = {(r.h, r.c): r.n_overlapping for r in exposure.overlap_counts(df, "h", "c", "s", "e").collect()}
    want = {
        (h, c): sum(1 for h2, c2, s2, e2 in rows if h2 == h and c2 != c and s <= e2 and s2 <= e) for h, c, s, e in rows
    }
    assert got == want and got[99, 1] == 1 and got[99, 3] == 0


def test_truncation_classes(spark):
    rows = [(1, -5, 50), (2, -5, 200), (3, 5, 200), (4, 5, 50)]
    df = spark.createDataFrame(rows, "i INT, s INT, e INT")
    found = df.select("i", window_truncation(F.col("s"), F.col("e"), F.lit(0), F.lit(100)).alias("w")).collect()
    assert [r.w for r in sorted(found)] == ["left_truncated", "both_truncated", "right_truncated", "within_window"]


def test_concurrent_household_has_no_propensity(spark):
    seen = spark.createDataFrame(
        [(1, 1, True), (1, 2, True), (2, 1, False), (2, 3, False)],
        "household_id INT, campaign_id SMALLINT, has_concurrent_exposure BOOLEAN",
    )
    redeemed = spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "household_id INT, campaign_id SMALLINT")
    block = exposure.campaign_block(seen, redeemed)
    assert one(block, household_id=1).redemption_propensity is None
    single = one(block, household_id=2)
    assert (single.redemption_propensity, single.n_campaigns_exposed, single.is_concurrent_arm) == (0.5, 2, False)


def test_retention_lists_empty_later_quarters(spark):
    rows = [(1, 1, 1, 1, 1, 1, 0, date(2017, 1, 5)), (2, 1, 2, 1, 1, 1, 0, date(2017, 5, 5)), (1, 1, 3, 1, 1, 1, 0, date(2018, 1, 1))]
    got = {(r[0], r[1]): (r.n_cohort, r.n_retained, r.retention_rate_pct, r.quarters_since_cohort) for r in retention_matrix(lines(spark, rows), STUDY).collect()}
    assert got == {
        ("2017-Q1", "2017-Q1"): (1, 1, 100.0, 0),
        ("2017-Q1", "2017-Q2"): (1, 0, 0.0, 1),
        ("2017-Q2", "2017-Q2"): (1, 1, 100.0, 0),
    }


def test_class_of_scores(spark):
    # The class of some recency-frequency-monetary codes.
    classes = {
        "555": "Champions", "444": "Champions", "453": "Loyal", "155": "Loyal", "341": "Loyal",
        "511": "New/Returning", "425": "New/Returning", "333": "Mid-tier", "531": "Mid-tier", "325": "Mid-tier",
        "231": "Mid-tier", "233": "At-Risk", "135": "At-Risk", "225": "Lost", "111": "Lost",
    }
    df = spark.createDataFrame([(c, *map(int, c)) for c in classes], "code STRING, r INT, f INT, m INT")
    got = df.select("code", rfm_class(F.col("r"), F.col("f"), F.col("m")).alias("c")).collect()
    assert {row.code: row.c for row in got} == classes


def test_rounding_is_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.125,), (-0.125,), (2.5,)], "x DOUBLE")
    assert [r[0] for r in df.select(round_to(F.col("x"), 2)).collect()] == [0.13, -0.13, 2.5]


def test_the_study_year_bounds_the_quarters(spark):
    rows = [(1, "2016-06-15"), (1, "2017-02-01"), (2, "2017-04-01"), (2, "2018-01-01"), (3, "2018-02-01"), (4, "2016-12-31"), (4, "2017-12-31")]
    clean = spark.createDataFrame(rows, "household_id INT, t STRING").selectExpr("household_id", "CAST(t AS timestamp_ntz) AS transaction_timestamp")
    got = {(r[0], r[1]): (r.n_cohort, r.n_retained, r.quarters_since_cohort) for r in retention_matrix(clean, Study()).collect()}
    assert got == {
        ("2017-Q1", "2017-Q1"): (2, 2, 0),
        ("2017-Q1", "2017-Q2"): (2, 0, 1),
        ("2017-Q1", "2017-Q4"): (2, 1, 3),
        ("2017-Q2", "2017-Q2"): (1, 1, 0),
        ("2017-Q2", "2017-Q4"): (1, 0, 2),
    }


def test_inequality_join_equals_all_pairs(spark):
    rng = random.Random(6)
    left, right = ([(i, rng.choice([None, 5, 5, rng.randrange(100)])) for i in range(n)] for n in (70, 90))
    want = sorted((i, j) for i, x in left for j, y in right if x is not None and y is not None and x <= y)
    for ranges in (1, 2, 40):
        pairs = at_or_before(spark.createDataFrame(left, "i INT, x INT"), spark.createDataFrame(right, "j INT, y INT"), "x", "y", ranges)
        assert sorted((r.i, r.j) for r in pairs.collect()) == want
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    none = spark.createDataFrame([], "j INT, y INT")
    assert at_or_before(spark.createDataFrame(left, "i INT, x INT"), none, "x", "y").count() == 0


def test_touching_intervals_equal_the_self_join(spark):
    rng = random.Random(7)
    base = datetime(2017, 1, 1)
    rows = []
    for owner in (1, 2, 3):
        for item in range(60 if owner == 2 else 8):
            begin = base + timedelta(days=rng.randrange(300))
            rows.append((owner, item, begin, begin + timedelta(days=rng.choice([0, 0, 3, 40, 200]))))
    rows += [(1, 90, None, base), (1, 91, base, None), (1, 92, base + timedelta(days=9), base)]
    df = spark.createDataFrame(rows, "owner INT, item SMALLINT, begins TIMESTAMP_NTZ, ends TIMESTAMP_NTZ")
    fine = [r for r in rows if r[2] and r[3] and r[2] <= r[3]]
    want = sorted((a[0], a[1], b[1]) for a in fine for b in fine if a[0] == b[0] and a[1] != b[1] and a[2] <= b[3] and b[2] <= a[3])
    for days in (1, 28, 4000):
        assert sorted(tuple(r) for r in touching_pairs(df, "owner", "item", "begins", "ends", days).collect()) == want


def test_household_sums_equal_the_single_blocks(spark):
    """Baskets over several weeks and stores, one-day and late households, unknown products: one scan gives every block."""
    rng = random.Random(4)
    rows = []
    for household in range(1, 25):
        for _ in range(rng.choice([1, 3, 40])):
            day = date(2017, 1, 1) + timedelta(days=rng.choice([5, 6, rng.randrange(364), rng.randrange(280, 364)]))
            rows.append((household, rng.randrange(3), rng.randrange(12), rng.choice([1, 1, 2, 3, 7, 99]), rng.randrange(3), rng.randrange(500) / 100, 0.25, day))
    rows += [(30, 1, 1, 1, 1, 1, 0, date(2017, 12, 1)), (31, 1, 1, 99, 1, 1, 0, date(2017, 2, 1)), (32, 1, 1, 3, 1, 0, 0, date(2017, 2, 1))]
    txn, products = lines(spark, rows).repartition(3), goods(spark, [*PRODUCTS, (7, "FRUIT", "National")])
    split, whole = STUDY.split_date, features.trip_ledger(txn, products, STUDY)
    for until, halves, as_of in ((None, STUDY.trend_halves, STUDY.analysis_date), (split, STUDY.split_halves, split)):
        early = whole if until is None else features.before(whole, split)
        spend = features.category_spend(txn if until is None else features.before(txn, split), products, STUDY)
        blocks = [
            features.spend_block(early, as_of, STUDY),
            features.store_block(early),
            features.cadence_block(early),
            features.trend_block(early, halves, STUDY),
            features.product_block(spend, STUDY),
        ]
        got = {r.household_id: r.asDict() for r in household_sums(txn, products, as_of, halves, STUDY, until).collect()}
        want = {h: {} for h in got}
        for block in blocks:
            for r in block.collect():
                want[r.household_id] |= r.asDict()
        assert got.keys() == {r.household_id for r in whole.select("household_id").distinct().collect()}
        later = {r.household_id: r.net for r in features.from_day(whole, split).groupBy("household_id").agg(F.sum("net").alias("net")).collect()}
        for household, row in got.items():
            assert row.pop("observed") == bool(want[household])
            assert row.pop("later_net") == (0.0 if until is None else later.get(household, 0) / 100)
            expected = {c: want[household].get(c) for c in row}
            assert {c: v for c, v in row.items() if c != "household_id" and v != expected[c]} == {}


@pytest.mark.parametrize("build", [views.household_table, views.v_clv_split])
def test_a_view_scans_the_line_items_once(spark, build):
    plan = build(derive_panel(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "l_extendedprice" in line]
    assert len(scans) == 1
