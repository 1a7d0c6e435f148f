"""Linear models, clustering, resampling and effects against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.operators import causal as ca
from larder.operators import segmentation as sg
from larder.operators.linear import Scale, breusch_pagan, ordinary_least_squares, ridge_by_folds
from larder.operators.resampling import EffectBootstrap, _raw_weights, bootstrap_means, poisson_draws
from larder.operators.value_models import holdout_flag, metrics, worst_residuals
from larder.session import materialise


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2] + [0, 100, 3]
    y = x @ [1.5, -0.3, 4.0] + rng.normal(size=300)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y, fold=np.arange(300) % 5, key=np.arange(300))
    return pdf, spark.createDataFrame(pdf)


def test_least_squares_matches_normal_equations(regression):
    pdf, df = regression
    fit = ordinary_least_squares(df, ["a", "b", "c"], "y")
    design = np.column_stack([np.ones(len(pdf)), pdf[["a", "b", "c"]]])
    beta, rss, *_ = np.linalg.lstsq(design, pdf.y, rcond=None)
    errors = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / (len(pdf) - 4))
    assert np.allclose(fit.coefficients, beta) and np.allclose(fit.standard_errors, errors)
    lm, p = breusch_pagan(df, fit, "y")
    assert lm >= 0 and 0 <= p <= 1
    predicted = df.select(fit.predict().alias("p")).toPandas().p
    assert np.allclose(np.sort(predicted), np.sort(design @ beta))


def test_ridge_matches_closed_form_and_fold_choice(regression):
    pdf, df = regression
    alphas = (0.1, 10.0, 1000.0)
    fit = ridge_by_folds(df, ["a", "b", "c"], "y", "fold", alphas)
    x = pdf[["a", "b", "c"]].to_numpy()
    z, y = (x - x.mean(0)) / x.std(0), pdf.y.to_numpy()

    def solve(z, y, alpha):
        zc, yc = z - z.mean(0), y - y.mean()
        w = np.linalg.solve(zc.T @ zc + alpha * np.eye(3), zc.T @ yc)
        return y.mean() - z.mean(0) @ w, w

    for alpha in alphas:
        scores = []
        for f in range(5):
            out = pdf.fold.to_numpy() == f
            a, w = solve(z[~out], y[~out], alpha)
            scores.append(1 - ((y[out] - a - z[out] @ w) ** 2).sum() / ((y[out] - y[out].mean()) ** 2).sum())
        assert fit.fold_scores[alpha] == pytest.approx(np.mean(scores))
    a, w = solve(z, y, fit.alpha)
    assert fit.alpha == max(alphas, key=fit.fold_scores.get) and np.allclose(fit.coefficients, [a, *w])


def test_scale_leaves_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a DOUBLE, b DOUBLE")
    scale = Scale.of(df, ["a", "b"])
    assert list(scale.sd) == [1.0, 1.0] and sorted(r.b for r in scale.apply(df).collect()) == [0.0, 0.0]


def test_kmeans_finds_separate_blobs(spark):
    rng = np.random.default_rng(2)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    points = np.vstack([c + rng.normal(size=(60, 2)) for c in centres])
    df = spark.createDataFrame(pd.DataFrame(points, columns=["x", "y"]).assign(household_id=range(180)))
    best = sg.kmeans_runs(df, ["x", "y"], [2, 3], n_init=5)
    assert np.allclose(sorted(map(tuple, best[3][0].round(0))), sorted(map(tuple, centres)), atol=1)
    near = ((points[:, None] - best[3][0][None]) ** 2).sum(2)
    assert best[3][1] == pytest.approx(near.min(1).sum())
    fits = sg.kmeans_fits(df, ["x", "y"], [2, 3], n_init=5)
    score = sg.silhouettes(df, ["x", "y"], fits)
    labels = ((points[:, None] - fits[3].centres[None]) ** 2).sum(2).argmin(1)
    every = ((points[:, None] - points[None]) ** 2).sum(2)
    mean = np.array([[every[i, labels == c].sum() / ((labels == c).sum() - (labels[i] == c)) for c in range(3)] for i in range(180)])
    own = mean[np.arange(180), labels]
    mean[np.arange(180), labels] = np.inf
    other = mean.min(1)
    assert score[3] == pytest.approx(((other - own) / np.maximum(other, own)).mean()) and score[3] > 0.9 > score[2]
    sizes = df.groupBy(sg.nearest_centre(["x", "y"], best[3][0])).count().collect()
    assert sorted(r["count"] for r in sizes) == [60, 60, 60]


def test_kmeans_finds_a_cluster_of_one_in_a_thousand(spark):
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(size=(19_980, 2)), rng.normal(size=(20, 2)) + 60])
    df = materialise(spark.createDataFrame(pd.DataFrame(points, columns=["x", "y"]).assign(household_id=range(20_000))), "rare")
    centres, _ = sg.kmeans_runs(df, ["x", "y"], [2], n_init=3)[2]
    assert np.allclose(sorted(map(tuple, centres.round(0))), [(0, 0), (60, 60)], atol=1)
    first, again = (sg.starting_centres(d, ["x", "y"], [2], 3) for d in (df, df.repartition(7)))
    assert all(np.allclose(first[run], again[run]) for run in first)


def _rand(a, b):
    """Adjusted Rand index by counting all pairs."""
    same_a, same_b = (np.equal.outer(x, x)[np.triu_indices(len(x), 1)] for x in (np.array(a), np.array(b)))
    expected = same_a.sum() * same_b.sum() / len(same_a)
    return ((same_a & same_b).sum() - expected) / ((same_a.sum() + same_b.sum()) / 2 - expected)


def test_adjusted_rand_equals_pair_counts(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 4, 90)
    b = np.where(rng.random(90) < 0.7, a, rng.integers(0, 3, 90))
    df = spark.createDataFrame(pd.DataFrame({"g": ["x"] * 90, "a": a, "b": b})).groupBy("g", "a", "b").agg(F.count("*").alias("n"))
    assert sg.adjusted_rand(df, ["g"], "a", "b", "n").first().ari == pytest.approx(_rand(a, b))
    assert sg.adjusted_rand(df, [], "a", "b", "n").first().ari == pytest.approx(_rand(a, b))
    one = spark.createDataFrame([(1, 1, 5)], "a INT, b INT, n BIGINT")
    assert sg.adjusted_rand(one, [], "a", "b", "n").first().ari == 1.0


def test_stability_tells_firm_from_arbitrary_segments(spark):
    rng = np.random.default_rng(6)
    blobs = np.vstack([c + rng.normal(size=(200, 2)) for c in ([0, 0], [12, 0], [0, 12])])
    cloud = rng.normal(size=(600, 2))
    found = {}
    for name, points in (("blobs", blobs), ("cloud", cloud)):
        df = materialise(spark.createDataFrame(pd.DataFrame(points, columns=["x", "y"]).assign(household_id=range(600))), name)
        centres, _ = sg.kmeans_runs(df, ["x", "y"], [3], n_init=4)[3]
        table = sg.stability(df, ["x", "y"], centres, replicates=12).toPandas()
        again = sg.stability(df.repartition(5), ["x", "y"], centres, replicates=12).toPandas()
        assert len(table) == 12 and table.n.between(300, 450).all()
        assert np.allclose(table.sort_values("replicate").ari, again.sort_values("replicate").ari)
        found[name] = table.ari.mean()
    assert found["blobs"] > 0.99 > 0.95 > found["cloud"] > 0


def test_a_step_with_given_centres(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 9.0)], "household_id INT, x DOUBLE")
    got = [tuple(r) for r in sg.kmeans_step(df, ["x"], [[0.0], [10.0], [99.0]]).orderBy("label").collect()]
    assert got == [(0, 2, 1.0, [0.5]), (1, 1, 1.0, [9.0]), (2, 0, 0.0, [99.0])]


def test_choose_k_follows_the_rule(spark):
    rows = [(2, 0.40, 100.0, 9.0), (3, 0.39, 60.0, 8.0), (4, 0.20, 50.0, 7.0), (5, 0.38, 45.0, 6.0)]
    sweep = spark.createDataFrame(rows, "k INT, silhouette DOUBLE, inertia DOUBLE, calinski_harabasz DOUBLE")
    row = sg.choose_k(sweep).first()
    assert (row.silhouette_k, row.ch_k, row.elbow_k, row.chosen_k) == (2, 2, 3, 3)


def test_holdout_is_exact_per_stratum_and_stable(spark):
    df = materialise(spark.range(1000).select(F.col("id").alias("key"), (F.col("id") % 10 == 0).cast("double").alias("s")), "h")
    first = holdout_flag(df, F.col("s"), "key")
    counts = {(r.s, r.is_holdout): r["count"] for r in first.groupBy("s", "is_holdout").count().collect()}
    assert counts == {(1.0, True): 20, (1.0, False): 80, (0.0, True): 180, (0.0, False): 720}
    again = holdout_flag(df.repartition(7), F.col("s"), "key")
    assert {r.key for r in first.filter("is_holdout").collect()} == {r.key for r in again.filter("is_holdout").collect()}


def test_metrics_floor_predictions_at_zero(spark):
    df = spark.createDataFrame([(1, 0.0, -5.0), (2, 10.0, 8.0)], "household_id INT, y DOUBLE, p DOUBLE")
    row = metrics(df, "y", ["p"]).first()
    assert (row.rmse, row.mae, row.neg_pct) == (pytest.approx(2**0.5), 1.0, 50.0) and row.r2 == pytest.approx(0.92)
    assert worst_residuals(df, "y", "p", 1).first().household_id == 2


def test_poisson_draws_have_the_right_law():
    draws = poisson_draws(np.arange(4000), np.arange(101), 42)
    assert (draws[:, 0] == 1).all()
    rest = draws[:, 1:]
    assert rest.mean() == pytest.approx(1, abs=0.01) and rest.var() == pytest.approx(1, abs=0.02)
    assert (rest == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert abs(np.corrcoef(rest[:, 0], rest[:, 1])[0, 1]) < 0.05


def test_bootstrap_of_means_is_stable_and_sized_right(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"household_id": range(800), "g": ["a"] * 500 + ["b"] * 300, "x": rng.normal(50, 10, 800)})
    df = spark.createDataFrame(pdf)
    got = {r.g: r for r in bootstrap_means(df, "g", "household_id", ["x"], 2000).collect()}
    again = {r.g: r for r in bootstrap_means(df.repartition(3), "g", "household_id", ["x"], 2000).collect()}
    for g, part in pdf.groupby("g"):
        half = 1.96 * part.x.std() / len(part) ** 0.5
        assert got[g].mean == pytest.approx(part.x.mean()) and got[g].n == len(part)
        assert got[g].ci_high - got[g].ci_low == pytest.approx(2 * half, rel=0.1)
        assert got[g].ci_low == pytest.approx(again[g].ci_low, rel=1e-12)


@pytest.fixture(scope="module")
def arms(spark):
    """Treatment depends on spend; the true effect is five."""
    rng = np.random.default_rng(4)
    n = 1200
    spend = rng.gamma(3, 100, n)
    odds = 1 / (1 + np.exp(-(np.log1p(spend) - 5.5)))
    treated = (rng.random(n) < odds).astype(int)
    pdf = pd.DataFrame(
        {
            "household_id": range(n),
            "cluster_name": np.where(spend > 300, "Champions", "Declining"),
            "obs_monetary": spend,
            "obs_frequency": rng.integers(1, 50, n),
            "obs_recency_days": rng.integers(1, 90, n),
            "obs_tenure_days": rng.integers(1, 270, n),
            "treated": treated,
            "hurdle_pred_clv": 0.2 * spend + 5 * treated + rng.normal(size=n),
        }
    )
    return pdf, materialise(ca.model_inputs(spark.createDataFrame(pdf), "cluster_name", ca.INDICATOR_LEVELS), "arms")


def test_joint_refits_agree_with_the_single_fit(arms):
    pdf, df = arms
    drawn, propensity = ca.bootstrap_effects(df.withColumn("whole", F.lit("all")), "whole", ca.PANEL_INPUTS, 200)
    scored = materialise(ca.with_propensity(df, ca.PANEL_INPUTS), "scored")
    exact = ca.weighted_effect(ca.with_weights(scored), "hurdle_pred_clv").first().effect
    first = drawn.effect[drawn.replicate == 0].item()
    assert first == pytest.approx(exact, abs=0.01)
    # with its own fit, the sample's effect is the plain estimate to the last digits: the cap is exact
    own = materialise(df.withColumn("ps", propensity["all"]), "own-fit")
    assert first == pytest.approx(ca.weighted_effect(ca.with_weights(own), "hurdle_pred_clv").first().effect, abs=1e-9)
    naive = pdf.groupby("treated").hurdle_pred_clv.mean().diff().iloc[-1]
    rest = drawn.effect[drawn.replicate > 0]
    assert rest.quantile(0.025) < 5 < rest.quantile(0.975) < naive
    robust = ca.doubly_robust_effect(scored, ca.PANEL_INPUTS, "hurdle_pred_clv").first().effect
    assert robust == pytest.approx(5, abs=2)


def test_caps_of_all_replicates_are_exact_quantiles(arms, spark):
    pdf, df = arms
    rows = df.select("household_id", F.lit("all").alias("g"), "log1p_monetary", F.col("treated").cast("double").alias("treated"), F.col("hurdle_pred_clv").alias("outcome"))
    boot = EffectBootstrap(materialise(rows, "cap-rows"), "g", "household_id", ["log1p_monetary"], 30, 42, ca.CLIP, ca.CAP, ca.MIN_ARM)
    moments = boot._moments()
    rng = np.random.default_rng(8)
    beta = {"all": np.column_stack([rng.normal(-5, 1, 31), rng.normal(1, 0.3, 31)])}
    got = boot._caps(moments, beta)["all"]
    data = rows.toPandas().sort_values("household_id")
    draws = poisson_draws(data.household_id.to_numpy(), np.arange(31), 42)
    weights, _ = _raw_weights(beta["all"], data[["log1p_monetary", "treated", "outcome"]].to_numpy(float), ca.CLIP)
    for r in range(31):
        assert got[r] == pytest.approx(np.quantile(np.repeat(weights[:, r], draws[:, r].astype(int)), ca.CAP), rel=1e-12)


def test_equal_weights_reduce_to_the_naive_effect(arms):
    _, df = arms
    flat = ca.with_weights(materialise(df.withColumn("ps", F.lit(0.5)), "flat"))
    naive = ca.naive_effects(df, "cluster_name", "hurdle_pred_clv").filter("segment_name = 'All Segments'").first()
    assert ca.weighted_effect(flat, "hurdle_pred_clv").first().effect == pytest.approx(naive.effect)
    report = ca.trim_report(flat).first()
    assert report.n_trimmed == 0 and report.ess_treated == pytest.approx(naive.n_treated)


def test_weighting_improves_balance(arms):
    _, df = arms
    weighed = ca.with_weights(materialise(ca.with_propensity(df, ca.PANEL_INPUTS), "balance"))
    before = {r.covariate: r.smd for r in ca.standardised_differences(weighed, ca.COVARIATES).collect()}
    after = {r.covariate: r.smd for r in ca.standardised_differences(weighed, ca.COVARIATES, "w").collect()}
    assert abs(after["log1p_monetary"]) < abs(before["log1p_monetary"])


def test_small_arms_are_reported_not_estimated(spark):
    rows = [("a", r, 3, 40, 1.0) for r in range(10)] + [("b", r, 20, 40, 1.0 + r) for r in range(10)]
    df = spark.createDataFrame(rows, "s STRING, replicate INT, n_treated BIGINT, n_control BIGINT, effect DOUBLE")
    got = {r.segment_name: r for r in ca.summarise_replicates(df, "s").collect()}
    assert got["a"].insufficient and got["a"].effect is None and got["a"].p is None
    assert not got["b"].insufficient and got["b"].low_n and got["b"].p == pytest.approx(1 / 9)


def test_overlap_lists_every_band(spark):
    df = materialise(spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1)], "ps DOUBLE, treated INT"), "bands")
    rows = ca.overlap_by_band(df, "ps").collect()
    assert len(rows) == 10 and sum(r.n_total for r in rows) == 3
