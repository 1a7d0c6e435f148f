"""Campaign effects: naive, inverse-probability weighted, doubly robust, per segment."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import cents, clip, dollars, exposure_group, ratio
from larder.functions.tails import normal_quantile, t_p
from larder.operators.exposure import truncation_flags
from larder.operators.linear import Scale, ridge_by_folds
from larder.operators.ranks import quantiles
from larder.operators.resampling import ROWS_PER_TASK, EffectBootstrap
from larder.operators.segmentation import SEGMENT_NAMES
from larder.operators.statistics import benjamini_hochberg, sample_size
from larder.operators.tabulate import union_all
from larder.operators.value_models import fit_logistic, with_probability
from larder.session import materialise, small_table, use_all_cores

# Settings of the weighted estimates.
CLIP, CAP = (0.02, 0.98), 0.99
PANEL_REPLICATES, SEGMENT_REPLICATES, SEED = 2_000, 500, 42
MIN_ARM, RELIABLE_ARM, ALPHA = 5, 30, 0.05
# Fixed value: critical value of each of four looks at a total level of 0.05, two-sided.
FOUR_LOOKS = 2.361
EFFECT_ALPHAS = (1.0, 10.0, 100.0)
ALL_SEGMENTS = "All Segments"
SINGLE_ARM, UNEXPOSED, CONCURRENT = "single_arm", "unexposed", "concurrent"
COVARIATES = ("log1p_monetary", "log1p_frequency", "recency_days", "tenure_days")


def effect_frame(predictions: DataFrame, split: DataFrame, exposure: DataFrame) -> DataFrame:
    """Predictions with exposure group, tenure and campaign-window truncation."""
    facts = split.select("household_id", "is_concurrent_arm", "n_campaigns_exposed", "obs_tenure_days")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return (
        predictions.join(facts, "household_id", "left")
        .join(truncation_flags(exposure), "household_id", "left")
        .withColumn("exposure_group", exposure_group(F.col("n_campaigns_exposed"), F.col("is_concurrent_arm")))
        .withColumns({"right_trunc": flag("right_trunc"), "left_trunc": flag("left_trunc")})
        .withColumn("any_trunc", F.col("right_trunc") | F.col("left_trunc"))
    )


def treatment_arms(df: DataFrame) -> DataFrame:
    """Single-arm and unexposed households with a 0/1 treatment."""
    return df.filter(F.col("exposure_group") != CONCURRENT).withColumn(
        "treated", (F.col("exposure_group") == SINGLE_ARM).cast("int")
    )


def with_stratum_propensity(arms: DataFrame, by: Sequence[str]) -> DataFrame:
    """Smoothed treated share of each stratum as the propensity ``ps``."""
    shares = arms.groupBy(*by).agg(((F.sum("treated") + 1.0) / (F.count(F.lit(1)) + 2.0)).alias("ps"))
    return arms.join(small_table(shares), list(by))


def _arm(treated: int, column: str) -> Column:
    return F.when(F.col("treated") == treated, F.col(column))


def naive_effects(arms: DataFrame, segment: str, outcome: str) -> DataFrame:
    """Difference of arm means with Welch's t, for the panel and every segment."""
    sums = arms.rollup(segment).agg(
        F.grouping(segment).alias("whole"),
        *[
            f(_arm(t, outcome)).alias(f"{name}{t}")
            for t in (0, 1)
            for name, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))
        ],
    )
    v1, v0 = F.col("var1") / F.col("n1"), F.col("var0") / F.col("n0")
    return sums.select(
        F.when(F.col("whole") == 1, ALL_SEGMENTS).otherwise(F.col(segment)).alias("segment_name"),
        F.col("n1").alias("n_treated"),
        F.col("n0").alias("n_control"),
        F.col("mean1").alias("mean_treated"),
        F.col("mean0").alias("mean_control"),
        (F.col("mean1") - F.col("mean0")).alias("effect"),
        (100 * ratio(F.col("mean1") - F.col("mean0"), F.col("mean0"))).alias("lift_pct"),
        ratio(F.col("mean1") - F.col("mean0"), F.sqrt(v1 + v0)).alias("t"),
        (
            F.pow(v1 + v0, 2)
            / F.nullif(F.pow(v1, 2) / (F.col("n1") - 1) + F.pow(v0, 2) / (F.col("n0") - 1), F.lit(0.0))
        ).alias("df"),
    )


def with_t_test(effects: DataFrame) -> DataFrame:
    return effects.withColumn("p", t_p("t", "df"))


def segment_mix(arms: DataFrame, segment: str) -> DataFrame:
    """Share of each arm's households in each segment, in percent."""
    counts = arms.groupBy("exposure_group", segment).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("exposure_group")
    return counts.withColumn("pct_of_arm", 100 * ratio(F.col("n"), F.sum("n").over(within)))


def standardised_differences(arms: DataFrame, covariates: Sequence[str], weight: str | None = None) -> DataFrame:
    """Mean difference over pooled deviation per covariate.

    Unweighted deviations are sample ones, weighted ones population ones.
    """
    columns = ["treated", *([weight] if weight else [])]
    long = arms.select(*columns, *[F.col(c).cast("double").alias(c) for c in covariates]).unpivot(
        columns, list(covariates), "covariate", "x"
    )
    if weight:
        long = long.filter(F.col("x").isNotNull())
        w = F.col(weight)
        mean = lambda t: F.sum(_arm(t, "wx")) / F.sum(_arm(t, weight))
        spread = lambda t: F.sum(_arm(t, "wdd")) / F.sum(_arm(t, weight))
        # centred before squaring, so that large covariates keep their digits
        centres = small_table(
            long.withColumn("wx", w * F.col("x")).groupBy("covariate", "treated").agg((F.sum("wx") / F.sum(w)).alias("centre"))
        )
        long = (
            long.join(centres, ["covariate", "treated"])
            .withColumn("wx", w * F.col("x"))
            .withColumn("wdd", w * F.pow(F.col("x") - F.col("centre"), 2))
        )
    else:
        mean = lambda t: F.avg(_arm(t, "x"))
        spread = lambda t: F.var_samp(_arm(t, "x"))
    stats = long.groupBy("covariate").agg(
        mean(1).alias("mean_treated"), mean(0).alias("mean_control"), F.sqrt((spread(1) + spread(0)) / 2).alias("sd")
    )
    return stats.select(
        "covariate",
        "mean_treated",
        "mean_control",
        F.when(F.col("sd") > 0, (F.col("mean_treated") - F.col("mean_control")) / F.col("sd")).otherwise(0.0).alias("smd"),
    )


def model_inputs(df: DataFrame, segment: str, levels: Sequence[str]) -> DataFrame:
    """Covariates and segment indicators; levels not listed are the reference."""
    return df.withColumns(
        {
            "log1p_monetary": F.log1p(F.greatest(F.col("obs_monetary").cast("double"), F.lit(0.0))),
            "log1p_frequency": F.log1p("obs_frequency"),
            "recency_days": F.col("obs_recency_days").cast("double"),
            "tenure_days": F.col("obs_tenure_days").cast("double"),
            **{indicator(level): (F.col(segment) == level).cast("double") for level in levels},
        }
    )


def indicator(level: str) -> str:
    return "seg_" + level.lower().replace(" ", "_").replace("-", "_").replace("/", "_")


# every named segment but the last; it and single-day shoppers are the reference
INDICATOR_LEVELS = SEGMENT_NAMES[:-1]
PANEL_INPUTS = (*COVARIATES, *[indicator(level) for level in INDICATOR_LEVELS])


def with_propensity(df: DataFrame, inputs: Sequence[str], name: str = "ps") -> DataFrame:
    """Fitted chance of treatment from penalised logistic regression."""
    numeric = df.withColumn("treated", F.col("treated").cast("double"))
    return with_probability(numeric, fit_logistic(numeric, inputs, "treated"), inputs, name).withColumn(
        "treated", F.col("treated").cast("int")
    )


def with_weights(arms: DataFrame, ps: str = "ps", cap: float = CAP) -> DataFrame:
    """Inverse-probability weights ``w_raw`` and ``w``, capped at a pooled quantile.

    ``arms`` is read several times: pass a stored table.
    """
    p = clip(F.col(ps), *CLIP)
    weighed = arms.withColumn("w_raw", F.when(F.col("treated") == 1, 1 / p).otherwise(1 / (1 - p)))
    limit = quantiles(weighed, [], ["w_raw"], [cap]).first()["quantile"]
    return weighed.withColumn("w", F.least(F.col("w_raw"), F.lit(limit))).withColumn("cap", F.lit(limit))


def weighted_effect(weighed: DataFrame, outcome: str) -> DataFrame:
    """Difference of weighted arm means."""
    mean = lambda t: F.sum(_arm(t, "w") * F.col(outcome)) / F.sum(_arm(t, "w"))
    return weighed.agg(
        (mean(1) - mean(0)).alias("effect"),
        F.count(_arm(1, "w")).alias("n_treated"),
        F.count(_arm(0, "w")).alias("n_control"),
    )


def required_sizes(weighed: DataFrame, outcome: str, share: float = 0.5, power: float = 0.80) -> DataFrame:
    """Households per arm to see ``share`` of the measured effect, by one look and by four.

    The spread is the outcome's over both arms; four looks use the constant boundary. The
    outcome is money: it is summed exactly per weight, so that rounding of large sums, which
    depends on the order of rows, doesn't swamp a small effect.
    """
    cent = cents(F.col(outcome))
    square = cent.cast("decimal(19,0)") * cent.cast("decimal(19,0)")
    # few rows where weights come from strata, at most one per household
    levels = weighed.groupBy("treated", "w").agg(
        F.count(F.lit(1)).alias("rows"), F.count(cent).alias("n"), F.sum(cent).alias("cents"), F.sum(square).alias("squares")
    )
    weight = lambda t: F.sum(_arm(t, "w") * F.col("rows"))
    mean = lambda t: F.sum(_arm(t, "w") * F.col("cents")) / weight(t)
    n, total = F.sum("n"), F.sum(F.col("cents").cast("decimal(38,0)"))
    sums = levels.agg(
        dollars(share * F.abs(mean(1) - mean(0))).alias("delta"),
        n.cast("decimal(19,0)").alias("n"),
        total.cast("decimal(19,0)").alias("total"),
        F.sum("squares").alias("squares"),
    )
    spread = F.col("n") * F.col("squares") - F.col("total") * F.col("total")
    both = sums.select(dollars(F.sqrt(ratio(spread, F.col("n") * (F.col("n") - 1)))).alias("sigma"), "delta")
    z_beta = normal_quantile(power)
    fixed = sample_size(both, "sigma", "delta", normal_quantile(1 - ALPHA / 2), z_beta).withColumnRenamed("n_per_arm", "n_fixed")
    return sample_size(fixed, "sigma", "delta", FOUR_LOOKS, z_beta).withColumnRenamed("n_per_arm", "n_sequential")


def effective_size(weight: Column) -> Column:
    return F.pow(F.sum(weight), 2) / F.sum(weight * weight)


def trim_report(weighed: DataFrame) -> DataFrame:
    """Cap, trimmed households and effective sample size of each arm."""
    trimmed = F.count_if(F.col("w_raw") > F.col("cap"))
    return weighed.agg(
        F.max("cap").alias("cap"),
        trimmed.alias("n_trimmed"),
        (100 * ratio(trimmed, F.count(F.lit(1)))).alias("pct_trimmed"),
        F.count(_arm(1, "w")).alias("n_treated"),
        F.count(_arm(0, "w")).alias("n_control"),
        effective_size(_arm(1, "w")).alias("ess_treated"),
        effective_size(_arm(0, "w")).alias("ess_control"),
    )


def overlap_by_band(arms: DataFrame, ps: str, bands: int = 10) -> DataFrame:
    """Treated share per propensity band between exact quantiles; the last is closed.

    Every band is listed, empty ones too. ``arms`` is read several times.
    """
    found = quantiles(arms, [], [ps], [i / bands for i in range(bands + 1)]).collect()
    bounds = [row["quantile"] for row in sorted(found, key=lambda row: row["probability"])]
    band = sum(((F.col(ps) >= b).cast("int") for b in bounds[1:bands]), F.lit(1))
    counts = arms.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("treated").cast("bigint").alias("n_t")
    )
    edges = arms.sparkSession.createDataFrame(
        [(i + 1, bounds[i], bounds[i + 1]) for i in range(bands)], "band INT, low DOUBLE, high DOUBLE"
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    listed = edges.join(small_table(counts), "band", "left").withColumns({"n": zero("n"), "n_t": zero("n_t")})
    pct = F.coalesce(100 * ratio(F.col("n_t"), F.col("n")), F.lit(0.0))
    return listed.select(
        "band",
        "low",
        "high",
        F.col("n").alias("n_total"),
        F.col("n_t").alias("n_treated"),
        (F.col("n") - F.col("n_t")).alias("n_control"),
        pct.alias("pct_treated"),
        ((pct > 90) | (pct < 10)).alias("poor_overlap"),
    )


def doubly_robust_effect(scored: DataFrame, inputs: Sequence[str], outcome: str, ps: str = "ps") -> DataFrame:
    """Regression in each arm corrected by uncapped inverse-probability residuals."""
    fold = F.pmod(F.xxhash64("household_id", F.lit(SEED)), F.lit(5)).cast("int")
    rows = scored.withColumn("fold", fold)
    mu1, mu0 = (
        ridge_by_folds(rows.filter(F.col("treated") == t), inputs, outcome, "fold", EFFECT_ALPHAS).predict()
        for t in (1, 0)
    )
    y, t, p = F.col(outcome), F.col("treated"), clip(F.col(ps), *CLIP)
    phi = mu1 - mu0 + t * (y - mu1) / p - (1 - t) * (y - mu0) / (1 - p)
    return scored.agg(
        F.avg(phi).alias("effect"), F.sum("treated").alias("n_treated"), F.sum(1 - F.col("treated")).alias("n_control")
    )


def fitted_propensity(scale: Scale, beta: Sequence[float]) -> Column:
    """Chance of treatment from coefficients (constant first) of scaled inputs."""
    parts = [(F.col(c) - float(m)) / float(d) * float(b) for c, m, d, b in zip(scale.columns, scale.mean, scale.sd, beta[1:])]
    return 1 / (1 + F.exp(-(sum(parts, F.lit(float(beta[0]))))))


def bootstrap_effects(
    arms: DataFrame, group: str, inputs: Sequence[str], replicates: int, seed: int = SEED
) -> tuple[pd.DataFrame, dict[str, Column]]:
    """Effect of every replicate of every group, and each group's fitted propensity; inputs are scaled before fitting."""
    scale = Scale.of(arms, inputs)
    rows = scale.apply(arms).select(
        F.col(group).cast("string").alias(group),
        "household_id",
        *inputs,
        F.col("treated").cast("double").alias("treated"),
        F.col("hurdle_pred_clv").alias("outcome"),
    )
    stored = materialise(rows, "bootstrap-rows")
    spread = use_all_cores(stored, "household_id", ROWS_PER_TASK)
    stored = stored if spread is stored else materialise(spread, "bootstrap-spread")
    bootstrap = EffectBootstrap(stored, group, "household_id", inputs, replicates, seed, CLIP, CAP, MIN_ARM)
    drawn = bootstrap.effects()
    return drawn, {name: fitted_propensity(scale, beta) for name, beta in bootstrap.sample_fit.items()}


def summarise_replicates(replicates: DataFrame, group: str) -> DataFrame:
    """Point estimate, interval, standard error and bootstrap p per group.

    Replicates with too small an arm are left out. A group holds at most the
    chosen number of replicates, so exact percentiles are safe here.
    """
    sample = F.col("replicate") == 0
    usable = (
        ~sample & (F.col("n_treated") >= MIN_ARM) & (F.col("n_control") >= MIN_ARM) & ~F.isnan("effect") & F.col("effect").isNotNull()
    )
    drawn = F.when(usable, F.col("effect"))
    enough = (F.col("n_treated") >= MIN_ARM) & (F.col("n_control") >= MIN_ARM)
    stats = replicates.groupBy(F.col(group).alias("segment_name")).agg(
        F.max(F.when(sample, F.col("n_treated"))).alias("n_treated"),
        F.max(F.when(sample, F.col("n_control"))).alias("n_control"),
        F.max(F.when(sample, F.col("effect"))).alias("effect"),
        F.percentile(drawn, F.lit(0.025)).alias("ci_low"),
        F.percentile(drawn, F.lit(0.975)).alias("ci_high"),
        F.stddev_pop(drawn).alias("se"),
        F.count(drawn).alias("n_replicates"),
        F.avg((drawn <= 0).cast("double")).alias("share_low"),
        F.avg((drawn >= 0).cast("double")).alias("share_high"),
    )
    tail = F.when(F.col("effect") > 0, F.col("share_low")).otherwise(F.col("share_high"))
    p = F.greatest(2 * F.least(tail, F.lit(0.5)), 1 / F.nullif(F.col("n_replicates"), F.lit(0)))
    smaller = F.least("n_treated", "n_control")
    return stats.select(
        "segment_name",
        "n_treated",
        "n_control",
        *[F.when(enough, F.col(c)).alias(c) for c in ("effect", "ci_low", "ci_high", "se")],
        "n_replicates",
        F.when(enough, p).alias("p"),
        (smaller < RELIABLE_ARM).alias("low_n"),
        (~enough).alias("insufficient"),
    )


def segment_effects(arms: DataFrame, replicates: int = SEGMENT_REPLICATES) -> DataFrame:
    """Weighted effect per named segment, refitted within it, with corrected significance."""
    named = arms.filter(F.col("cluster_name").isin(*SEGMENT_NAMES))
    drawn, _ = bootstrap_effects(named, "cluster_name", COVARIATES, replicates)
    table = summarise_replicates(arms.sparkSession.createDataFrame(drawn), "cluster_name")
    return benjamini_hochberg(table, "p", ALPHA)


def panel_effect(arms: DataFrame, replicates: int = PANEL_REPLICATES) -> tuple[DataFrame, Column]:
    """Weighted effect over the panel with a bootstrap interval, and the propensity that it rests on."""
    whole = arms.withColumn("whole", F.lit(ALL_SEGMENTS))
    drawn, propensity = bootstrap_effects(whole, "whole", PANEL_INPUTS, replicates)
    table = summarise_replicates(arms.sparkSession.createDataFrame(drawn), "whole")
    return table.withColumn("bh_reject", F.lit(None).cast("boolean")), propensity[ALL_SEGMENTS]


def effect_arms(frame: DataFrame) -> DataFrame:
    return model_inputs(treatment_arms(frame), "cluster_name", INDICATOR_LEVELS)


def campaign_effects(arms: DataFrame, panel: DataFrame, propensity: Column, segments: DataFrame) -> DataFrame:
    """Naive, weighted and doubly robust rows stacked, one per segment and estimate.

    ``panel`` and ``propensity`` are those of ``panel_effect``, ``segments`` is from
    ``segment_effects``; every row of the whole panel rests on that one propensity.
    ``arms`` is read several times: pass a stored table.
    """
    scored = materialise(arms.withColumn("ps", propensity), "effect-scored")
    report = small_table(
        trim_report(with_weights(scored)).select(
            F.lit(ALL_SEGMENTS).alias("segment_name"), "ess_treated", "ess_control"
        )
    )
    nothing = lambda kind: F.lit(None).cast(kind)
    naive = naive_effects(
        arms.filter(F.col("cluster_name").isin(*SEGMENT_NAMES)), "cluster_name", "hurdle_pred_clv"
    ).filter(F.col("segment_name") != ALL_SEGMENTS)
    whole = naive_effects(arms, "cluster_name", "hurdle_pred_clv").filter(F.col("segment_name") == ALL_SEGMENTS)
    naive_rows = naive.unionByName(whole).select(
        "segment_name",
        F.lit("naive").alias("estimate_type"),
        F.col("effect").alias("effect_dollars"),
        nothing("double").alias("ci_low"),
        nothing("double").alias("ci_high"),
        "n_treated",
        "n_control",
        F.col("n_treated").cast("double").alias("ess_treated"),
        F.col("n_control").cast("double").alias("ess_control"),
        nothing("boolean").alias("survived_bh_correction"),
    )
    weighted_rows = (
        panel.unionByName(segments)
        .join(report, "segment_name", "left")
        .select(
            "segment_name",
            F.lit("ipw_adjusted").alias("estimate_type"),
            F.col("effect").alias("effect_dollars"),
            "ci_low",
            "ci_high",
            "n_treated",
            "n_control",
            "ess_treated",
            "ess_control",
            F.col("bh_reject").alias("survived_bh_correction"),
        )
    )
    robust_rows = doubly_robust_effect(scored, PANEL_INPUTS, "hurdle_pred_clv").select(
        F.lit(ALL_SEGMENTS).alias("segment_name"),
        F.lit("aipw").alias("estimate_type"),
        F.col("effect").alias("effect_dollars"),
        nothing("double").alias("ci_low"),
        nothing("double").alias("ci_high"),
        "n_treated",
        "n_control",
        nothing("double").alias("ess_treated"),
        nothing("double").alias("ess_control"),
        nothing("boolean").alias("survived_bh_correction"),
    )
    return union_all([naive_rows, weighted_rows, robust_rows])
