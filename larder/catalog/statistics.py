"""Group tests as queries, on deterministic segments and outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.catalog import query
from larder.functions import columns as fc
from larder.operators import statistics as st
from larder.operators.resampling import bootstrap_means
from larder.operators.tabulate import crosstab_long

OUTCOME = "outcome"


def rounded(df, digits, *columns):
    return df.withColumns({c: fc.round_to(F.col(c), digits) for c in columns})


_MOMENTS = """
WITH m AS (
  SELECT segment AS g, COUNT(*) AS n, AVG(outcome) AS mean, VAR_SAMP(outcome) AS v FROM estimation GROUP BY segment
)"""


WELCH = (
    _MOMENTS
    + """, c AS (SELECT COUNT(*) AS k, SUM(n / v) AS big, SUM(n / v * mean) / SUM(n / v) AS mid, SUM(n * mean) / SUM(n) AS grand FROM m),
    l AS (SELECT SUM(POWER(1 - (n / v) / big, 2) / (n - 1)) AS lam, SUM(n / v * POWER(mean - mid, 2)) AS s,
                 SUM(n * POWER(mean - grand, 2)) AS ssb, SUM((n - 1) * v) AS ssw FROM m, c)
    SELECT ROUND((s / (k - 1)) / (1 + 2 * (k - 2) * lam / (POWER(k, 2) - 1)), 6) AS f, k - 1 AS df1,
           ROUND((POWER(k, 2) - 1) / (3 * lam), 6) AS df2, ROUND(ssb / (ssb + ssw), 6) AS eta_squared FROM c, l"""
)


@query("st_welch_anova", "analysis", WELCH)
def welch_anova(stages):
    result = st.welch_anova(st.group_moments(stages.estimation, "segment", OUTCOME)).drop("p")
    return rounded(result, 6, "f", "df2", "eta_squared")


_ONE_WAY = """
SELECT ROUND((SUM(n * POWER(mean - grand, 2)) / (COUNT(*) - 1)) / (SUM((n - 1) * v) / (SUM(n) - COUNT(*))), 6) AS f,
       COUNT(*) - 1 AS df1, CAST(SUM(n) - COUNT(*) AS BIGINT) AS df2
FROM (SELECT *, SUM(n * mean) OVER () / SUM(n) OVER () AS grand FROM m)"""


@query("st_f_oneway", "analysis", _MOMENTS + _ONE_WAY)
def f_oneway(stages):
    return rounded(st.one_way_anova(st.group_moments(stages.estimation, "segment", OUTCOME)).drop("p"), 6, "f")


@query(
    "st_levene_median",
    "analysis",
    """WITH z AS (
         SELECT e.segment, ABS(e.outcome - x.med) AS d
         FROM estimation e JOIN (SELECT segment, quantile_cont(outcome, 0.5) AS med FROM estimation GROUP BY segment) x
           ON x.segment = e.segment),
       m AS (SELECT segment AS g, COUNT(*) AS n, AVG(d) AS mean, VAR_SAMP(d) AS v FROM z GROUP BY segment)"""
    + _ONE_WAY,
)
def levene(stages):
    return rounded(st.levene_median(stages.estimation, "segment", OUTCOME).drop("p"), 6, "f")


@query(
    "st_residual_shape",
    "analysis",
    """WITH e AS (SELECT outcome - AVG(outcome) OVER (PARTITION BY segment) AS e FROM estimation),
       c AS (SELECT e - AVG(e) OVER () AS d FROM e)
       SELECT COUNT(*) AS n, ROUND(AVG(POWER(d, 3)) / POWER(AVG(d * d), 1.5), 6) AS skew,
              ROUND(AVG(POWER(d, 4)) / POWER(AVG(d * d), 2) - 3, 6) AS kurtosis FROM c""",
)
def residual_shape(stages):
    return rounded(st.residual_shape(stages.estimation, "segment", OUTCOME), 6, "skew", "kurtosis")


@query(
    "st_games_howell",
    "analysis",
    _MOMENTS
    + """SELECT a.g AS group_a, b.g AS group_b, ROUND(a.mean - b.mean, 3) AS difference,
                ROUND(SQRT(a.v / a.n + b.v / b.n), 3) AS se,
                ROUND(POWER(a.v / a.n + b.v / b.n, 2) / (POWER(a.v / a.n, 2) / (a.n - 1) + POWER(b.v / b.n, 2) / (b.n - 1)), 5) AS df
         FROM m a JOIN m b ON a.g < b.g""",
)
def games_howell(stages):
    result = st.games_howell(st.group_moments(stages.estimation, "segment", OUTCOME))
    return rounded(rounded(result, 3, "difference", "se"), 5, "df").drop("p", "ci_low", "ci_high")


@query("st_games_howell_p")
def games_howell_p(stages):
    return st.games_howell(st.group_moments(stages.estimation, "segment", OUTCOME))


@query("st_p_values")
def p_values(stages):
    """The tail probabilities of every closed-form test, in one table."""
    moments = st.group_moments(stages.estimation, "segment", OUTCOME)
    arms = st.group_moments(stages.estimation, "exposure_group", OUTCOME)
    tests = {
        "welch_anova": st.welch_anova(moments),
        "one_way": st.one_way_anova(moments),
        "levene": st.levene_median(stages.estimation, "segment", OUTCOME),
        "chi2_m_score": st.contingency_test(stages.labelled, "segment", "m_score", range(1, 6)),
        "welch_t": st.welch_t(arms, "single_arm", "unexposed"),
    }
    from larder.operators.tabulate import union_all

    return union_all([df.select(F.lit(name).alias("test"), "p") for name, df in tests.items()])


def _chi2(source: str, row: str, column: str) -> str:
    return f"""
WITH cells AS (SELECT {row} AS r, CAST({column} AS VARCHAR) AS c, COUNT(*) AS o FROM {source} GROUP BY ALL),
full_table AS (
  SELECT r.r, c.c, COALESCE(x.o, 0) AS o FROM (SELECT DISTINCT r FROM cells) r JOIN (SELECT DISTINCT c FROM cells) c ON TRUE
  LEFT JOIN cells x ON x.r = r.r AND x.c = c.c),
expected AS (
  SELECT o, CAST(SUM(o) OVER (PARTITION BY r) AS DOUBLE) * SUM(o) OVER (PARTITION BY c) / SUM(o) OVER () AS e,
         SUM(o) OVER () AS n, r, c FROM full_table),
t AS (SELECT SUM(POWER(o - e, 2) / e) AS chi2, COUNT(DISTINCT r) AS nr, COUNT(DISTINCT c) AS nc, MAX(n) AS n,
             AVG(CASE WHEN e < 5 THEN 1.0 ELSE 0.0 END) AS low FROM expected)
SELECT ROUND(chi2, 6) AS chi2, (nr - 1) * (nc - 1) AS dof, CAST(n AS BIGINT) AS n,
       ROUND(SQRT(chi2 / (n * (LEAST(nr, nc) - 1))), 6) AS cramers_v, ROUND(low, 6) AS share_expected_below_5 FROM t"""


def _chi2_result(df):
    return rounded(df, 6, "chi2", "cramers_v", "share_expected_below_5").drop("p")


FULL_CHI2 = _chi2("labelled", "segment", "m_score")


@query("st_chi2_contingency", "analysis", FULL_CHI2)
def contingency(stages):
    return _chi2_result(st.contingency_test(stages.labelled, "segment", "m_score", range(1, 6)))


@query("st_cramers_v", "analysis", f"SELECT cramers_v FROM ({FULL_CHI2})")
def cramers_v(stages):
    return _chi2_result(st.contingency_test(stages.labelled, "segment", "m_score", range(1, 6))).select("cramers_v")


@query(
    "st_redemption_by_segment",
    "analysis",
    _chi2("(SELECT * FROM estimation WHERE exposure_group = 'single_arm')", "segment", "ever_redeemed"),
)
def redemption_by_segment(stages):
    single = stages.estimation.filter(F.col("exposure_group") == "single_arm")
    return _chi2_result(st.contingency_test(single, "segment", "ever_redeemed", [False, True]))


@query(
    "st_redemption_table",
    "analysis",
    """WITH single AS (SELECT segment, ever_redeemed FROM estimation WHERE exposure_group = 'single_arm'),
       cells AS (SELECT s.segment, v.redeemed, COUNT(x.segment) AS n FROM (SELECT DISTINCT segment FROM single) s
                 CROSS JOIN (VALUES (FALSE), (TRUE)) AS v(redeemed)
                 LEFT JOIN single x ON x.segment = s.segment AND x.ever_redeemed = v.redeemed GROUP BY ALL)
       SELECT segment, CAST(redeemed AS VARCHAR) AS ever_redeemed, n, ROUND(100.0 * n / SUM(n) OVER (PARTITION BY segment), 6) AS row_pct FROM cells""",
)
def redemption_table(stages):
    """Redeemers and others per segment, with their share of the segment."""
    single = stages.estimation.filter(F.col("exposure_group") == "single_arm")
    return rounded(crosstab_long(single, "segment", "ever_redeemed", [False, True]), 6, "row_pct")


@query(
    "st_bootstrap_sample",
    "analysis",
    """SELECT segment, m.measure, COUNT(*) AS n, ROUND(AVG(m.x), 6) AS mean FROM (
         SELECT segment, UNNEST([{'measure': 'outcome', 'x': outcome}, {'measure': 'obs_monetary', 'x': obs_monetary}]) AS m FROM estimation)
       GROUP BY ALL""",
)
def bootstrap_sample(stages):
    """Replicate 0 of the bootstrap: the sample itself."""
    means = bootstrap_means(stages.estimation, "segment", "household_id", ["outcome", "obs_monetary"], replicates=20)
    return rounded(means.select("segment", "measure", "n", "mean"), 6, "mean")


@query(
    "st_welch_t",
    "analysis",
    """WITH m AS (SELECT exposure_group AS g, COUNT(*) AS n, AVG(outcome) AS mean, VAR_SAMP(outcome) AS v
                  FROM estimation GROUP BY exposure_group)
       SELECT ROUND(a.mean - b.mean, 3) AS difference, ROUND((a.mean - b.mean) / SQRT(a.v / a.n + b.v / b.n), 6) AS t,
              ROUND(POWER(a.v / a.n + b.v / b.n, 2) / (POWER(a.v / a.n, 2) / (a.n - 1) + POWER(b.v / b.n, 2) / (b.n - 1)), 5) AS df
       FROM m a JOIN m b ON a.g = 'single_arm' AND b.g = 'unexposed'""",
)
def welch_t(stages):
    moments = st.group_moments(stages.estimation, "exposure_group", OUTCOME)
    result = st.welch_t(moments, "single_arm", "unexposed").drop("p")
    return rounded(rounded(rounded(result, 3, "difference"), 6, "t"), 5, "df")


@query(
    "st_ci_overlap",
    "analysis",
    """WITH i AS (SELECT segment AS g, quantile_cont(outcome, 0.25) AS lo, quantile_cont(outcome, 0.75) AS hi
                  FROM estimation GROUP BY segment)
       SELECT a.g AS group_a, b.g AS group_b, a.hi > b.lo AND b.hi > a.lo AS overlap FROM i a JOIN i b ON a.g < b.g""",
)
def ci_overlap(stages):
    from larder.operators.ranks import quantiles

    long = quantiles(stages.estimation, ["segment"], [OUTCOME], [0.25, 0.75])
    pick = lambda p: F.max(F.when(F.col("probability") == p, F.col("quantile")))
    intervals = long.groupBy("segment").agg(pick(0.25).alias("low"), pick(0.75).alias("high"))
    return st.interval_overlap(intervals, "segment", "low", "high")


@query("st_bootstrap_mean_ci")
def bootstrap_mean_ci(stages):
    """Ten thousand resamples of the mean predicted value and spend per segment."""
    rows = stages.predictions.filter(F.col("cluster_name") != "Single-Trip")
    return bootstrap_means(rows, "cluster_name", "household_id", ["hurdle_pred_clv", "obs_monetary"])
