"""Closed-form tests against published tables and textbook values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.functions import tails
from larder.operators import statistics as st

# Published contingency tables, moments and p-values.
SPEND = {
    "Champions": (31, 32, 52, 104, 175),
    "Loyal Actives": (7, 163, 325, 367, 317),
    "Declining": (279, 265, 109, 17, 1),
    "Truly Lapsed": (128, 33, 8, 6, 0),
}
REDEEMED = {"Champions": (91, 13), "Loyal Actives": (348, 53), "Declining": (154, 5), "Truly Lapsed": (18, 1)}
MOMENTS = [
    ("Champions", 394, 656.8, 460.5**2),
    ("Loyal Actives", 1179, 506.6, 368.1**2),
    ("Declining", 671, 132.6, 97.4**2),
    ("Truly Lapsed", 175, 106.1, 141.9**2),
]


def cells(spark, table):
    rows = [(g, str(i), n) for g, counts in table.items() for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "g STRING, c STRING, n BIGINT")


@pytest.fixture(scope="module")
def moments(spark):
    return spark.createDataFrame(MOMENTS, "grp STRING, n BIGINT, mean DOUBLE, variance DOUBLE")


@pytest.mark.parametrize(
    "table,chi2,dof,v,low,p",
    [(SPEND, 1458.75, 12, 0.448, 0.0, 2.98e-305), (REDEEMED, 13.25, 3, 0.139, 0.125, 4.12e-3)],
)
def test_published_contingency(spark, table, chi2, dof, v, low, p):
    row = st.contingency_test_cells(cells(spark, table), "g", "c", "n").first()
    assert (round(row.chi2, 2), row.dof, round(row.cramers_v, 3), row.share_expected_below_5) == (chi2, dof, v, low)
    assert row.p == pytest.approx(p, rel=2e-2)


def test_published_welch_anova(moments):
    row = st.welch_anova(moments).first()
    assert row.f == pytest.approx(517.55, rel=1e-3) and row.df2 == pytest.approx(633.5, rel=1e-3)
    assert round(row.eta_squared, 3) == 0.288 and row.df1 == 3


def test_published_games_howell(moments):
    rows = {(r.group_a, r.group_b): r for r in st.games_howell(moments).collect()}
    assert len(rows) == 6
    near = rows["Declining", "Truly Lapsed"]
    assert round(near.difference, 1) == 26.5
    assert near.ci_low == pytest.approx(4.1, abs=0.1) and near.ci_high == pytest.approx(48.9, abs=0.1)
    assert near.p == pytest.approx(0.0936, abs=3e-3)
    far = rows["Champions", "Loyal Actives"]
    assert round(far.difference, 1) == 150.2 and far.p < 1e-4


def test_published_step_up(spark):
    tests = spark.createDataFrame(
        [("a", 0.192), ("b", 0.024), ("c", 0.044), ("d", 0.002), ("e", None)], "name STRING, p DOUBLE"
    )
    got = {r.name: r.bh_reject for r in st.benjamini_hochberg(tests, "p").collect()}
    assert got == {"a": False, "b": True, "c": False, "d": True, "e": None}


def test_published_sample_size(spark):
    df = spark.createDataFrame([(430.0, 40.03)], "sigma DOUBLE, delta DOUBLE")
    z = tails.normal_quantile
    assert st.sample_size(df, "sigma", "delta", z(0.975), z(0.8)).first().n_per_arm == 1812


def test_tails_match_tables():
    assert tails.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.2281, abs=1e-3)
    assert tails.f_tail(3.3258, 5, 10) == pytest.approx(0.05, abs=1e-4)
    assert tails.gamma_sf(18.307 / 2, 5) == pytest.approx(0.05, abs=1e-4)
    assert tails.studentized_range_tail(3.877, 3, 10) == pytest.approx(0.05, abs=5e-4)
    assert tails.studentized_range_tail(3.633, 4, 1e5) == pytest.approx(0.05, abs=5e-4)


def test_levene_and_one_way_match_brute_force(spark):
    rng = np.random.default_rng(0)
    groups = {g: rng.normal(i, 1 + i, 40 + i) for i, g in enumerate("abc")}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g STRING, x DOUBLE")

    def f_of(parts):
        n, k = sum(map(len, parts)), len(parts)
        grand = np.concatenate(parts).mean()
        between = sum(len(p) * (p.mean() - grand) ** 2 for p in parts) / (k - 1)
        return between / (sum(((p - p.mean()) ** 2).sum() for p in parts) / (n - k))

    assert st.levene_median(df, "g", "x").first().f == pytest.approx(f_of([abs(v - np.median(v)) for v in groups.values()]))
    assert st.one_way_anova(st.group_moments(df, "g", "x")).first().f == pytest.approx(f_of(list(groups.values())))


def test_interval_overlap_is_strict(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("b", 1.0, 2.0), ("c", 1.5, 3.0)], "g STRING, lo DOUBLE, hi DOUBLE")
    got = {(r.group_a, r.group_b): r.overlap for r in st.interval_overlap(df, "g", "lo", "hi").collect()}
    assert got == {("a", "b"): False, ("a", "c"): False, ("b", "c"): True}


def test_welch_t_two_groups(spark):
    df = spark.createDataFrame([("t", 10, 5.0, 4.0), ("c", 12, 3.0, 9.0)], "grp STRING, n BIGINT, mean DOUBLE, variance DOUBLE")
    row = st.welch_t(df, "t", "c").first()
    assert row.t == pytest.approx(2 / (0.4 + 0.75) ** 0.5) and 0 < row.p < 1


def test_residual_shape_of_symmetric_groups(spark):
    df = spark.createDataFrame([("a", v) for v in (-1.0, 0.0, 1.0)] + [("b", v) for v in (4.0, 5.0, 6.0)], "g STRING, x DOUBLE")
    assert st.residual_shape(df, "g", "x").select(F.abs("skew")).first()[0] < 1e-12
