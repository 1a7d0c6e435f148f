"""Findings of the fourth round: each test failed before its finding was settled."""

import zlib
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest

from larder.llm import token_files
from larder.operators import resampling
from larder.session import materialise

CLIP, CAP, REPLICATES = (0.02, 0.98), 0.99, 40


@pytest.fixture(scope="module")
def panel(spark):
    """A large group, one with over a tenth of its weights at the clip, a small one; ``rare`` is not drawn by all replicates."""
    rng = np.random.default_rng(14)
    frames = []
    for name, n, slope in (("large", 20_000, 0.7), ("clipped", 6_000, 4.0), ("small", 300, 0.5)):
        x, at = rng.normal(size=n), np.arange(n)
        treated = (rng.random(n) < 1 / (1 + np.exp(-slope * x - 0.3))).astype(float)
        rare = (at % (n // 2) == 7).astype(float)
        frames.append(pd.DataFrame({"g": name, "id": at * 31 + 5, "x": x, "rare": rare, "treated": treated, "outcome": 3 * x + treated + rng.normal(size=n)}))
    rows = pd.concat(frames, ignore_index=True)
    return rows, materialise(spark.createDataFrame(rows), "boot-rows")


def bootstrap(df, margin=None):
    boot = resampling.EffectBootstrap(df, "g", "id", ["x", "rare"], REPLICATES, 42, CLIP, CAP, 5)
    if margin:
        boot.MARGIN = margin
    return boot


def exact_effect(rows, drawn):
    """Weighted effect of one replicate by a plain fit and a sorted list of weights."""
    x, t, y = rows[["x", "rare"]].to_numpy(), rows.treated.to_numpy(), rows.outcome.to_numpy()
    n = drawn.sum()
    variance = (drawn @ (x * x)) / n - (drawn @ x / n) ** 2
    used = np.append(True, variance > 1e-12)
    z = np.column_stack([np.ones(len(x)), x])[:, used]
    penalty, beta = np.append(0.0, variance)[used], np.zeros(used.sum())
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ beta))
        curve = (z * (drawn * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        beta = beta + np.linalg.solve(curve, z.T @ (drawn * (t - p)) - penalty * beta)
    p = np.clip(1 / (1 + np.exp(-z @ beta)), *CLIP)
    raw = np.where(t == 1, 1 / p, 1 / (1 - p))
    cap = np.quantile(np.repeat(raw, drawn.astype(int)), CAP)
    w = np.minimum(raw, cap) * drawn
    return (w * t) @ y / (w @ t) - (w * (1 - t)) @ y / (w @ (1 - t)), cap


def test_effects_take_few_passes_of_all_replicates(panel, monkeypatch):  # F1
    rows, df = panel
    monkeypatch.setattr(resampling, "MOST_ROWS", 1_000)
    cells, plain = [], resampling.reduce_rows
    monkeypatch.setattr(resampling, "reduce_rows", lambda df, *a, **k: cells.append(df.count() * len(a[3])) or plain(df, *a, **k))
    found = bootstrap(df).effects()
    for name, of_group in rows.groupby("g"):
        draws = resampling.poisson_draws(of_group.id.to_numpy(), np.arange(REPLICATES + 1), 42)
        got = found[found.g == name].set_index("replicate")
        for r in range(REPLICATES + 1):
            assert got.effect[r] == pytest.approx(exact_effect(of_group, draws[:, r])[0], rel=1e-8, abs=1e-9)
            assert got.n_treated[r] == draws[:, r] @ of_group.treated and got.n_control[r] == draws[:, r] @ (1 - of_group.treated)
    # moments with the first step, few more steps and the effect; the caps only look at a part of the rows
    assert sum(cells) < 9 * len(rows) * (REPLICATES + 1)


def spread_fits(rows):
    rng = np.random.default_rng(5)
    middle = {"large": (0.3, 0.7, 0.1), "clipped": (0.3, 4.0, 0.0), "small": (0.3, 0.5, 0.1)}
    return {g: np.array(m) + rng.normal(0, 0.02, (REPLICATES + 1, 3)) for g, m in middle.items()}


@pytest.mark.parametrize("margin", [None, 0.3, 0.98])
def test_caps_are_exact_where_rows_are_left_out(panel, monkeypatch, margin):  # F1
    rows, df = panel
    monkeypatch.setattr(resampling, "MOST_ROWS", 1_000)
    boot, beta, read = bootstrap(df, margin), spread_fits(rows), []
    plain = boot._caps_of
    monkeypatch.setattr(boot, "_caps_of", lambda top, *a: read.append(top.groupBy("g").count().toPandas().set_index("g")["count"]) or plain(top, *a))
    caps = boot._caps(boot._moments(), beta)
    for name, of_group in rows.groupby("g"):
        draws = resampling.poisson_draws(of_group.id.to_numpy(), np.arange(REPLICATES + 1), 42).astype(int)
        raw, _ = resampling._raw_weights(beta[name], of_group[["x", "rare", "treated", "outcome"]].to_numpy(float), CLIP)
        wanted = [np.quantile(np.repeat(raw[:, r], draws[:, r]), CAP) for r in range(REPLICATES + 1)]
        assert caps[name] == pytest.approx(np.array(wanted), rel=1e-12)
    assert read[0]["small"] == 300 and read[0]["large"] < 2_500 and read[0]["clipped"] < 4_000
    assert (len(read) > 1) == (margin is not None)  # a bound over some cap is replaced by a lower one


def test_a_sample_where_every_replicate_fits_alike_keeps_its_caps(spark, monkeypatch):  # F1
    monkeypatch.setattr(resampling, "MOST_ROWS", 100)
    rows = pd.DataFrame({"g": "a", "id": range(400), "x": 1.0, "rare": 0.0, "treated": [float(i % 4 == 0) for i in range(400)], "outcome": [float(i % 7) for i in range(400)]})
    found = bootstrap(materialise(spark.createDataFrame(rows), "flat-rows")).effects().set_index("replicate")
    draws = resampling.poisson_draws(np.arange(400), np.arange(REPLICATES + 1), 42)
    for r in range(REPLICATES + 1):
        assert found.effect[r] == pytest.approx(exact_effect(rows, draws[:, r])[0], rel=1e-9)


def test_a_damaged_block_fails_by_its_checksum():
    ids = np.random.default_rng(2).geometric(0.02, 200_000).astype(np.uint32) % 400
    table = token_files.FrequencyTable.from_counts(np.bincount(ids, minlength=400))
    data = token_files.encode_block(ids, table)
    shard = object.__new__(token_files.Shard)
    shard.table, shard.blocks = table, [(0, len(data), len(ids), zlib.crc32(ids.astype("<u4").tobytes()))]
    shard.source = SimpleNamespace(read_at=lambda size, at: data[at : at + size])
    assert (shard.block(0) == ids).all()
    whole, words = data, 4 * int.from_bytes(data[16:20], "little")
    for at in range(len(whole) - words, len(whole) - words // 2, words // 40):  # the last words may leave the ids as they are
        data = whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :]
        with pytest.raises(ValueError, match="checksum"):
            shard.block(0)
