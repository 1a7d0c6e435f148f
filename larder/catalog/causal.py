"""Campaign-effect operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.catalog import query
from larder.catalog.statistics import FULL_CHI2, WELCH, contingency, rounded, welch_anova
from larder.functions import columns as fc
from larder.operators import causal as ca
from larder.operators.tabulate import union_all
from larder.session import materialise

_WEIGHED = """
WITH raw AS (
  SELECT *, CASE WHEN treated = 1 THEN 1 / LEAST(GREATEST(ps, 0.02), 0.98) ELSE 1 / (1 - LEAST(GREATEST(ps, 0.02), 0.98)) END AS w_raw
  FROM scored_arms),
weighed AS (SELECT *, quantile_cont(w_raw, 0.99) OVER () AS cap, LEAST(w_raw, quantile_cont(w_raw, 0.99) OVER ()) AS w FROM raw)"""


@query(
    "ca_naive_effect",
    "analysis",
    """SELECT CASE WHEN GROUPING(segment) = 1 THEN 'All Segments' ELSE segment END AS segment_name,
              COUNT(CASE WHEN treated = 1 THEN 1 END) AS n_treated, COUNT(CASE WHEN treated = 0 THEN 1 END) AS n_control,
              ROUND(AVG(CASE WHEN treated = 1 THEN outcome END), 3) AS mean_treated,
              ROUND(AVG(CASE WHEN treated = 0 THEN outcome END), 3) AS mean_control,
              ROUND(AVG(CASE WHEN treated = 1 THEN outcome END) - AVG(CASE WHEN treated = 0 THEN outcome END), 3) AS effect,
              ROUND(100 * (AVG(CASE WHEN treated = 1 THEN outcome END) - AVG(CASE WHEN treated = 0 THEN outcome END))
                    / NULLIF(AVG(CASE WHEN treated = 0 THEN outcome END), 0), 6) AS lift_pct,
              ROUND((AVG(CASE WHEN treated = 1 THEN outcome END) - AVG(CASE WHEN treated = 0 THEN outcome END))
                    / SQRT(VAR_SAMP(CASE WHEN treated = 1 THEN outcome END) / COUNT(CASE WHEN treated = 1 THEN 1 END)
                           + VAR_SAMP(CASE WHEN treated = 0 THEN outcome END) / COUNT(CASE WHEN treated = 0 THEN 1 END)), 6) AS t
       FROM arms GROUP BY ROLLUP (segment)""",
)
def naive_effect(stages):
    table = ca.naive_effects(stages.arms, "segment", "outcome").drop("df")
    return rounded(rounded(table, 3, "mean_treated", "mean_control", "effect"), 6, "lift_pct", "t")


@query("ca_naive_effect_p")
def naive_effect_p(stages):
    return ca.with_t_test(ca.naive_effects(stages.arms, "segment", "outcome"))


@query(
    "ca_segment_mix",
    "analysis",
    """SELECT exposure_group, segment, COUNT(*) AS n,
              ROUND(100.0 * COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY exposure_group), 6) AS pct_of_arm
       FROM arms GROUP BY exposure_group, segment""",
)
def segment_mix(stages):
    return rounded(ca.segment_mix(stages.arms, "segment"), 6, "pct_of_arm")


_COVARIATES = ("obs_monetary", "obs_frequency", "obs_recency_days", "obs_tenure_days")


_SMD = " UNION ALL ".join(
    f"""SELECT '{c}' AS covariate, ROUND(mt, 3) AS mean_treated, ROUND(mc, 3) AS mean_control,
               ROUND((mt - mc) / SQRT((vt + vc) / 2), 6) AS smd
        FROM (SELECT AVG(CASE WHEN treated = 1 THEN {c} END) AS mt, AVG(CASE WHEN treated = 0 THEN {c} END) AS mc,
                     VAR_SAMP(CASE WHEN treated = 1 THEN {c} END) AS vt, VAR_SAMP(CASE WHEN treated = 0 THEN {c} END) AS vc
              FROM arms)"""
    for c in _COVARIATES
)


@query("ca_smd", "analysis", _SMD)
def smd(stages):
    table = ca.standardised_differences(stages.arms, _COVARIATES)
    return rounded(rounded(table, 3, "mean_treated", "mean_control"), 6, "smd")


def _weighed(stages):
    return ca.with_weights(stages.arms)


@query(
    "ag_weighted_moments",
    "analysis",
    _WEIGHED
    + " UNION ALL ".join(
        f"""SELECT '{c}' AS covariate, ROUND(mt, 3) AS mean_treated, ROUND(mc, 3) AS mean_control,
                   ROUND((mt - mc) / SQRT((vt + vc) / 2), 6) AS smd
            FROM (SELECT ANY_VALUE(mt) AS mt, ANY_VALUE(mc) AS mc,
                         SUM(CASE WHEN treated = 1 THEN w * POWER({c} - mt, 2) END) / SUM(CASE WHEN treated = 1 THEN w END) AS vt,
                         SUM(CASE WHEN treated = 0 THEN w * POWER({c} - mc, 2) END) / SUM(CASE WHEN treated = 0 THEN w END) AS vc
                  FROM weighed, (SELECT SUM(CASE WHEN treated = 1 THEN w * {c} END) / SUM(CASE WHEN treated = 1 THEN w END) AS mt,
                                        SUM(CASE WHEN treated = 0 THEN w * {c} END) / SUM(CASE WHEN treated = 0 THEN w END) AS mc FROM weighed))"""
        for c in _COVARIATES
    ),
)
def weighted_moments(stages):
    table = ca.standardised_differences(_weighed(stages), _COVARIATES, "w")
    return rounded(rounded(table, 3, "mean_treated", "mean_control"), 6, "smd")


@query("prj_clip", "analysis", _WEIGHED + "SELECT household_id, ROUND(w_raw, 8) AS w_raw, ROUND(w, 8) AS w FROM weighed")
def clipped(stages):
    return rounded(_weighed(stages).select("household_id", "w_raw", "w"), 8, "w_raw", "w")


@query(
    "ca_ipw_ate",
    "analysis",
    _WEIGHED
    + """SELECT ROUND(SUM(CASE WHEN treated = 1 THEN w * outcome END) / SUM(CASE WHEN treated = 1 THEN w END)
                      - SUM(CASE WHEN treated = 0 THEN w * outcome END) / SUM(CASE WHEN treated = 0 THEN w END), 3) AS effect,
                COUNT(CASE WHEN treated = 1 THEN 1 END) AS n_treated, COUNT(CASE WHEN treated = 0 THEN 1 END) AS n_control
         FROM weighed""",
)
def ipw_ate(stages):
    return rounded(ca.weighted_effect(_weighed(stages), "outcome"), 3, "effect")


_ESS = """POWER(SUM(CASE WHEN treated = {t} THEN w END), 2) / SUM(CASE WHEN treated = {t} THEN w * w END)"""
_TRIM = (
    _WEIGHED
    + f"""SELECT ROUND(MAX(cap), 8) AS cap, COUNT(CASE WHEN w_raw > cap THEN 1 END) AS n_trimmed,
                 ROUND(100.0 * COUNT(CASE WHEN w_raw > cap THEN 1 END) / COUNT(*), 6) AS pct_trimmed,
                 COUNT(CASE WHEN treated = 1 THEN 1 END) AS n_treated, COUNT(CASE WHEN treated = 0 THEN 1 END) AS n_control,
                 ROUND({_ESS.format(t=1)}, 6) AS ess_treated, ROUND({_ESS.format(t=0)}, 6) AS ess_control FROM weighed"""
)


@query("ca_trim_report", "analysis", _TRIM)
def trim_report(stages):
    return rounded(rounded(ca.trim_report(_weighed(stages)), 8, "cap"), 6, "pct_trimmed", "ess_treated", "ess_control")


@query(
    "ag_ess",
    "analysis",
    _WEIGHED + f"SELECT ROUND({_ESS.format(t=1)}, 6) AS ess_treated, ROUND({_ESS.format(t=0)}, 6) AS ess_control FROM weighed",
)
def ess(stages):
    return rounded(ca.trim_report(_weighed(stages)).select("ess_treated", "ess_control"), 6, "ess_treated", "ess_control")


# recency per tenure day: a score with few ties, so that the bands differ
_SCORE = """
WITH s AS (SELECT treated, 1.0 / (1.0 + obs_recency_days / (1.0 + obs_tenure_days)) AS score FROM arms),
q AS (SELECT quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM s),
b AS (SELECT i + 1 AS band, e[i + 1] AS low, e[i + 2] AS high FROM q, range(0, 10) AS r(i))
SELECT CAST(b.band AS INTEGER) AS band, ROUND(b.low, 8) AS low, ROUND(b.high, 8) AS high, COUNT(s.treated) AS n_total,
       COUNT(CASE WHEN s.treated = 1 THEN 1 END) AS n_treated, COUNT(CASE WHEN s.treated = 0 THEN 1 END) AS n_control,
       ROUND(COALESCE(100.0 * COUNT(CASE WHEN s.treated = 1 THEN 1 END) / NULLIF(COUNT(s.treated), 0), 0), 6) AS pct_treated,
       COALESCE(100.0 * COUNT(CASE WHEN s.treated = 1 THEN 1 END) / NULLIF(COUNT(s.treated), 0), 0) > 90
         OR COALESCE(100.0 * COUNT(CASE WHEN s.treated = 1 THEN 1 END) / NULLIF(COUNT(s.treated), 0), 0) < 10 AS poor_overlap
FROM b LEFT JOIN s ON s.score >= b.low AND (s.score < b.high OR (b.band = 10 AND s.score <= b.high)) GROUP BY b.band, b.low, b.high"""


def _bands(stages):
    score = 1 / (1 + F.col("obs_recency_days") / (1.0 + F.col("obs_tenure_days")))
    scored = materialise(stages.arms.select("treated", score.alias("score")), "band-scores")
    return rounded(rounded(ca.overlap_by_band(scored, "score"), 8, "low", "high"), 6, "pct_treated")


query("wn_ps_decile", "analysis", _SCORE)(_bands)


@query("ca_overlap_table")
def overlap_table(stages):
    """Bands of the fitted propensity."""
    return ca.overlap_by_band(_scored(stages), "ps")


def _scored(stages):
    if not hasattr(stages, "_scored_arms"):
        stages._scored_arms = materialise(ca.with_propensity(stages.effect_arms, ca.PANEL_INPUTS), "effect-scored")
    return stages._scored_arms


@query("ca_propensity")
def propensity(stages):
    return _scored(stages).select("household_id", "treated", "ps")


@query("ca_balance_after_weighting")
def balance(stages):
    weighed = ca.with_weights(_scored(stages))
    before = ca.standardised_differences(weighed, ca.COVARIATES).select("covariate", F.col("smd").alias("smd_before"))
    after = ca.standardised_differences(weighed, ca.COVARIATES, "w").select("covariate", F.col("smd").alias("smd_after"))
    return before.join(after, "covariate").withColumn("balanced", F.abs("smd_after") < 0.10)


@query("ca_aipw")
def aipw(stages):
    return ca.doubly_robust_effect(_scored(stages), ca.PANEL_INPUTS, "hurdle_pred_clv")


@query("ca_bootstrap_ipw")
def bootstrap_ipw(stages):
    """Two thousand refits over the panel."""
    return stages.panel_bootstrap[0]


@query("ca_segment_ate")
def segment_ate(stages):
    """Five hundred refits within each segment, corrected for multiple tests."""
    return stages.segment_bootstrap


# shares as p-values, so that the correction can be checked
@query(
    "ca_bh",
    "analysis",
    """WITH p AS (SELECT segment, AVG(treated) AS p FROM arms GROUP BY segment),
            r AS (SELECT segment, p, ROW_NUMBER() OVER (ORDER BY p, segment) AS k, COUNT(*) OVER () AS m FROM p)
       SELECT segment, ROUND(p, 8) AS p,
              k <= COALESCE(MAX(CASE WHEN p <= k / CAST(m AS DOUBLE) * 0.6 THEN k END) OVER (), 0) AS bh_reject FROM r""",
)
def bh(stages):
    from larder.operators.statistics import benjamini_hochberg

    shares = stages.arms.groupBy("segment").agg(F.avg("treated").alias("p"))
    return rounded(benjamini_hochberg(shares, "p", 0.6), 8, "p")


@query(
    "ca_truncation_flags",
    "analysis",
    """SELECT c.household_id, COALESCE(r, FALSE) AS right_trunc, COALESCE(l, FALSE) AS left_trunc,
              COALESCE(r, FALSE) OR COALESCE(l, FALSE) AS any_trunc
       FROM (SELECT household_id FROM clv_split WHERE NOT is_pred_only) c
       LEFT JOIN (SELECT household_id, BOOL_OR(window_truncation = 'right_truncated') AS r,
                         BOOL_OR(window_truncation = 'left_truncated') AS l
                  FROM campaign_exposure WHERE n_concurrent_campaigns = 0 GROUP BY household_id) x
         ON x.household_id = c.household_id""",
)
def truncation_flags(stages):
    spine = stages.split.filter(~F.col("is_pred_only")).select("household_id", "obs_monetary")
    frame = ca.effect_frame(spine, stages.split, stages.exposure)
    return frame.select("household_id", "right_trunc", "left_trunc", "any_trunc")


_Z = "1.959963984540054"


_EFFECT = """SUM(CASE WHEN treated = 1 THEN w * outcome END) / SUM(CASE WHEN treated = 1 THEN w END)
  - SUM(CASE WHEN treated = 0 THEN w * outcome END) / SUM(CASE WHEN treated = 0 THEN w END)"""
_NEEDED = "CAST(CEIL(2 * POWER({z} + 0.8416212335729143, 2) * POWER(sigma / delta, 2)) AS BIGINT)"


@query(
    "ca_required_n",
    "analysis",
    _WEIGHED
    + f""", m AS (SELECT STDDEV_SAMP(outcome) AS sigma, 0.5 * ABS({_EFFECT}) AS delta FROM weighed)
        SELECT ROUND(sigma, 3) AS sigma, ROUND(delta, 3) AS delta, {_NEEDED.format(z=_Z)} AS n_fixed, {_NEEDED.format(z=2.361)} AS n_sequential FROM m""",
)
def required_n(stages):
    """Households per arm to see half the measured effect, for one look and for four."""
    return rounded(ca.required_sizes(_weighed(stages), "outcome"), 3, "sigma", "delta")


@query(
    "prj_dummies",
    "analysis",
    """SELECT household_id, CASE WHEN segment = 'Champions' THEN 1.0 ELSE 0.0 END AS seg_champions,
              CASE WHEN segment = 'Loyal' THEN 1.0 ELSE 0.0 END AS seg_loyal,
              CASE WHEN segment = 'New/Returning' THEN 1.0 ELSE 0.0 END AS seg_new_returning,
              ROUND(LN(1 + GREATEST(obs_monetary, 0)), 8) AS log1p_monetary, ROUND(LN(1 + obs_frequency), 8) AS log1p_frequency
       FROM arms""",
)
def dummies(stages):
    levels = ("Champions", "Loyal", "New/Returning")
    rows = ca.model_inputs(stages.arms, "segment", levels)
    return rounded(rows, 8, "log1p_monetary", "log1p_frequency").select(
        "household_id", *[ca.indicator(level) for level in levels], "log1p_monetary", "log1p_frequency"
    )


@query(
    "prj_effect_labels",
    "analysis",
    f"""WITH v AS ({FULL_CHI2}), e AS ({WELCH}), s AS ({_SMD}), n AS (SELECT segment, COUNT(*) AS n FROM estimation GROUP BY segment),
        r AS (SELECT segment, ROUND(AVG(CASE WHEN outcome = 0 THEN 1.0 ELSE 0.0 END), 6) AS p FROM estimation GROUP BY segment)
        SELECT 'association' AS measure, 'segment' AS subject, cramers_v AS value,
               CASE WHEN cramers_v >= 0.7 THEN 'strong association' WHEN cramers_v >= 0.5 THEN 'moderate' ELSE 'adds information beyond M' END AS label FROM v
        UNION ALL SELECT 'effect size', 'segment', eta_squared,
               CASE WHEN eta_squared >= 0.14 THEN 'large' WHEN eta_squared >= 0.06 THEN 'medium' ELSE 'small' END FROM e
        UNION ALL SELECT 'balance', covariate, smd, CASE WHEN ABS(smd) < 0.10 THEN 'YES' ELSE 'NO !' END FROM s
        UNION ALL SELECT 'arm size', segment, CAST(n AS DOUBLE), CASE WHEN n < 30 THEN 'low' ELSE '' END FROM n
        UNION ALL SELECT 'significance', segment, p,
               CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END FROM r""",
)
def effect_labels(stages):
    """Words for the strength of an association, the size of an effect, balance, small arms and significance."""
    v = contingency(stages).select(F.lit("segment").alias("subject"), F.col("cramers_v").alias("value"))
    eta = welch_anova(stages).select(F.lit("segment").alias("subject"), F.col("eta_squared").alias("value"))
    balance = smd(stages).select(F.col("covariate").alias("subject"), F.col("smd").alias("value"))
    groups = stages.estimation.groupBy(F.col("segment").alias("subject"))
    sizes = groups.agg(F.count(F.lit(1)).cast("double").alias("value"))
    shares = groups.agg(fc.round_to(F.avg((F.col("outcome") == 0).cast("double")), 6).alias("value"))
    value = F.col("value")
    labelled = (
        (v, "association", fc.association_label(value)),
        (eta, "effect size", fc.effect_size_label(value)),
        (balance, "balance", fc.balance_label(value)),
        (sizes, "arm size", F.when(value < ca.RELIABLE_ARM, "low").otherwise("")),
        (shares, "significance", fc.stars(value)),
    )
    return union_all([df.select(F.lit(name).alias("measure"), "subject", "value", label.alias("label")) for df, name, label in labelled])


@query(
    "set_union_estimates",
    "analysis",
    _WEIGHED
    + """SELECT 'All Segments' AS segment_name, 'ipw_adjusted' AS estimate_type,
                ROUND(SUM(CASE WHEN treated = 1 THEN w * outcome END) / SUM(CASE WHEN treated = 1 THEN w END)
                      - SUM(CASE WHEN treated = 0 THEN w * outcome END) / SUM(CASE WHEN treated = 0 THEN w END), 3) AS effect FROM weighed
         UNION ALL
         SELECT CASE WHEN GROUPING(segment) = 1 THEN 'All Segments' ELSE segment END, 'naive',
                ROUND(AVG(CASE WHEN treated = 1 THEN outcome END) - AVG(CASE WHEN treated = 0 THEN outcome END), 3)
         FROM arms GROUP BY ROLLUP (segment)""",
)
def union_estimates(stages):
    naive = ca.naive_effects(stages.arms, "segment", "outcome").select(
        "segment_name", F.lit("naive").alias("estimate_type"), "effect"
    )
    weighted = ca.weighted_effect(_weighed(stages), "outcome").select(
        F.lit(ca.ALL_SEGMENTS).alias("segment_name"), F.lit("ipw_adjusted").alias("estimate_type"), "effect"
    )
    return rounded(naive.unionByName(weighted), 3, "effect")
