"""Findings of the third round: each test failed before its finding was settled."""

from datetime import date
from fractions import Fraction
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from larder.catalog import tables
from larder.contract import Study
from larder.llm import token_files
from larder.operators import causal, resampling, segmentation
from larder.operators.household_sums import Period, household_measures
from larder.sources import files
from larder.sources.panel import derive_panel
from test_features import PRODUCTS, SMALL, goods, lines


def stages_of(spark, rows):
    return SimpleNamespace(panel=SimpleNamespace(transactions=lines(spark, rows), products=goods(spark, PRODUCTS), study=Study()))


def test_quarters_outside_the_study_year_keep_their_own_name(spark):  # F5
    days = (date(2016, 12, 31), date(2017, 1, 1), date(2018, 1, 1))
    stages = stages_of(spark, [(1, 1, i, 1, 1, 2.0, 0, day) for i, day in enumerate(days)])
    found = {r["quarter"]: (r["n_rows"], r["net"]) for r in tables.quarter_bucket(stages).collect()}
    assert found == {"2016-Q4": (1, 2.0), "2017-Q1": (1, 2.0), "2018-Q1": (1, 2.0)}


def test_cohort_activity_lists_quarters_without_activity(spark):  # F6
    stages = stages_of(spark, [(1, 1, 1, 1, 1, 2.0, 0, date(2017, 2, 1)), (2, 1, 2, 1, 1, 2.0, 0, date(2017, 8, 1))])
    found = sorted(tuple(r) for r in tables.cohort_activity(stages).collect())
    assert found == [("2017-Q1", 0, 1), ("2017-Q1", 2, 0), ("2017-Q3", 0, 1)]


def test_a_table_in_parts_has_one_status(spark, tmp_path):  # F3
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(5).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    recorded = files.file_checksums(spark, str(tmp_path)).localCheckpoint()
    check = lambda: {tuple(r) for r in files.status_by_table(files.compare_manifests(recorded, files.file_checksums(spark, str(tmp_path)))).collect()}
    assert check() == {("orders.parquet", "intact"), ("part.parquet", "intact")}
    spark.range(7).coalesce(1).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert check() == {("orders.parquet", "changed"), ("part.parquet", "intact")}


def test_a_household_with_an_unknown_input_loses_no_other(spark):  # F4
    x = np.random.default_rng(0).normal(size=(300, 3))
    x[7, 1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)]
    df = spark.createDataFrame(rows, "household_id BIGINT, a DOUBLE, b DOUBLE, c DOUBLE")
    centres = np.array([[-0.5] * 3, [0.0] * 3, [0.5] * 3])
    far = np.nansum((x[:, None, :] - centres[None]) ** 2, axis=2)
    near = far.argmin(axis=1)
    step = {r["label"]: r for r in segmentation.kmeans_step(df, "abc", centres).collect()}
    for label in range(3):
        filled = np.where(np.isnan(x), centres[label], x)
        assert step[label]["size"] == (near == label).sum()
        assert np.isclose(step[label]["inertia"], far[near == label, label].sum())
        assert np.allclose(step[label]["centre"], filled[near == label].mean(axis=0))
    labels = df.select("household_id", segmentation.nearest_centre("abc", centres).alias("label")).orderBy("household_id")
    assert [r["label"] for r in labels.collect()] == near.tolist()
    fits = segmentation.kmeans_fits(df, "abc", [2, 3], n_init=3)
    assert all(np.isfinite(f.centres).all() and f.sums[:, 0].sum() == 300 for f in fits.values())
    assert all(np.isfinite(v) for v in segmentation.silhouettes(df, "abc", fits).values())
    assert segmentation.stability(df, "abc", fits[3].centres, 4).filter(F.col("ari") > 0.5).count() == 4


def test_large_households_get_the_measures_of_small_ones(spark):  # F8
    panel = derive_panel(spark, SMALL)
    study = panel.study
    periods = [Period(study.analysis_date, study.trend_halves), Period(study.split_date, study.split_halves, study.split_date)]
    measured = lambda most: {r["household_id"]: r for r in household_measures(panel.transactions, panel.products, study, periods, most).collect()}
    listed = measured(10**9)
    assert len(listed) > 100 and listed == measured(0) == measured(40)


def test_household_measures_shuffle_the_lines_once_after_their_joins(spark):  # F8
    panel = derive_panel(spark, SMALL)
    study = panel.study
    rows = household_measures(panel.transactions, panel.products, study, [Period(study.analysis_date, study.trend_halves)])
    plan = rows._jdf.queryExecution().sparkPlan().toString()
    prepared = rows._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert prepared.count("Exchange hashpartitioning(household_id") == 1


def test_draws_of_the_bootstrap_are_those_of_all_levels():  # F7
    keys, replicates = np.arange(-500, 2500) * 7919, np.arange(0, 120)
    with np.errstate(over="ignore"):
        bits = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        bits = bits + replicates.astype(np.uint64)[None, :] * np.uint64(0xD1342543DE82EF95) + np.uint64(42)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            bits = (bits ^ (bits >> np.uint64(shift))) * np.uint64(factor)
        bits ^= bits >> np.uint64(31)
    uniform = (bits >> np.uint64(11)) * 2.0**-53
    wanted = sum((uniform > level).astype(float) for level in resampling._POISSON)
    wanted[:, replicates == 0] = 1.0
    assert (resampling.poisson_draws(keys, replicates, 42) == wanted).all()
    # cells whose first bits leave the draw open are decided by all bits
    assert (resampling._BY_START == 255).sum() <= len(resampling._POISSON)


def test_a_weight_outside_its_bracket_costs_no_cell(spark):  # F7
    rng = np.random.default_rng(3)
    x = rng.normal(size=400)
    rows = [(i, "a", float(v), float(rng.random() < 0.4), float(v + rng.normal())) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "household_id BIGINT, grp STRING, x DOUBLE, treated DOUBLE, outcome DOUBLE")
    boot = resampling.EffectBootstrap(df, "grp", "household_id", ["x"], 20, 42, (0.02, 0.98), 0.99, 5)
    passes, plain = [], boot._pass
    boot._pass = lambda block, width, *a, **k: passes.append(width) or plain(block, width, *a, **k)
    moments = boot._moments()
    beta = boot._fit(moments, None, np.arange(21))
    del passes[:]
    caps = boot._caps(moments, beta)["a"]
    assert passes[0] == boot.CELLS  # the whole range is cut by counts alone
    data = np.array([r[2:] for r in rows])
    raw, _ = resampling._raw_weights(beta["a"], data, (0.02, 0.98))
    draws = resampling.poisson_draws(np.arange(400), np.arange(21), 42).astype(int)
    for r in range(21):
        assert np.isclose(caps[r], np.quantile(np.repeat(raw[:, r], draws[:, r]), 0.99), rtol=0, atol=1e-12)


def test_required_sizes_of_a_small_effect_are_exact(spark):  # F2
    rng = np.random.default_rng(11)
    spend = rng.integers(10**10, 4 * 10**10, 3000)
    # pairs of equal spend in both arms, one cent more in the treated one of every third
    rows = [(t, w, int(c + (t and i % 3 == 0))) for i, (c, w) in enumerate(zip(spend, rng.choice([1 / 0.3, 1 / 0.7, 1.1], 3000))) for t in (0, 1)]
    exact = lambda t: sum(Fraction(w) * c for a, w, c in rows if a == t) / sum(Fraction(w) for a, w, c in rows if a == t)
    n, total = len(rows), sum(c for _, _, c in rows)
    variance = Fraction(n * sum(c * c for _, _, c in rows) - total * total, n * (n - 1))
    found = []
    for parts, order in ((1, 1), (7, -1)):
        df = spark.createDataFrame([(a, float(w), c / 100) for a, w, c in rows][::order], "treated INT, w DOUBLE, outcome DOUBLE")
        found.append(causal.required_sizes(df.repartition(parts), "outcome").first())
    for row in found:
        assert np.isclose(row.sigma, float(variance) ** 0.5 / 100, rtol=1e-14)
        assert np.isclose(row.delta, float(abs(exact(1) - exact(0))) / 200, rtol=0, atol=2e-7)
    assert found[0].sigma == found[1].sigma


def test_words_of_letters_are_encoded_once_in_all_spellings():  # op3_token_files
    words = token_files.WordEncoder(token_files.default_tokenizer())
    texts = ["Ción ción. CIÓN, Éa×b É÷ ß Straße! ÿ \xff\xd7", "é É́a don't O'é ción's x<|endoftext|>é é<| <|endoftext|>", "µª ñ…. İx 0 é0 (ción) ción.ción", ""]
    ids, lengths = words.encode(pa.array([t.encode() for t in texts]))
    plain = [[*words.tokenizer.encode(t, add_special_tokens=False).ids, token_files.END_ID] for t in texts]
    assert lengths.tolist() == [len(p) for p in plain] and ids.tolist() == sum(plain, [])
    assert "ción".encode() in words.parts and not {"Ción".encode(), "ción.".encode(), "CIÓN,".encode()} & words.parts.keys()


def test_the_driver_loads_no_tokenizer(spark, monkeypatch):  # pipeline
    monkeypatch.setattr(token_files, "_encoders", {})
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id BIGINT, text STRING")
    assert token_files.token_files(docs).count() == 2 and not token_files._encoders
    assert token_files.token_files(docs.limit(0)).count() == 0
