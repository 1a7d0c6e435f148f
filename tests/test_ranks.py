"""Distributed order statistics against a single sort."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from larder.operators import ranks
from larder.operators.ranks import Ntile, medians, quantiles, with_ntiles
from larder.session import materialise


@pytest.fixture(scope="module")
def skewed(spark):
    """Twenty thousand rows, a third of them sharing one value, some NULL."""
    x = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 11 == 0, None).otherwise(F.round(F.rand(3) * 50, 1))
    group = F.when(F.rand(4) < 0.6, "big").otherwise("small")
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("key"), x.alias("x"), group.alias("g"))
    return materialise(df, "skewed")


@pytest.mark.parametrize("buckets,descending", [(5, False), (10, True), (7, False)])
def test_ntile_equals_window_with_hot_ties_and_nulls(skewed, buckets, descending):
    got = with_ntiles(skewed, [Ntile("tile", "x", buckets, descending)], "key")
    order = F.col("x").desc_nulls_last() if descending else F.col("x").asc_nulls_last()
    tile = F.ntile(buckets).over(Window.orderBy(order, "key"))
    want = F.when(F.col("x").isNotNull(), F.col("want")).alias("want")
    both = got.withColumn("want", tile).select("tile", want)
    assert both.filter(~F.col("tile").eqNullSafe(F.col("want"))).count() == 0


def test_ntile_with_fewer_rows_than_buckets(spark):
    df = spark.createDataFrame([(1, 3.0), (2, 1.0), (3, None)], "key INT, x DOUBLE")
    got = {r.key: r.tile for r in with_ntiles(df, [Ntile("tile", "x", 5)], "key").collect()}
    assert got == {1: 2, 2: 1, 3: None}


def test_nulls_take_bucket_places(spark):
    df = spark.createDataFrame([(i, float(i) if i <= 5 else None) for i in range(1, 8)], "key INT, x DOUBLE")
    got = {r.key: r.tile for r in with_ntiles(df, [Ntile("tile", "x", 5)], "key").collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: None, 7: None}


def test_quantiles_interpolate_like_numpy(skewed):
    points = [0.0, 0.05, 0.5, 0.77, 0.99, 1.0]
    found = {(r.g, r.probability): r["quantile"] for r in quantiles(skewed, ["g"], ["x"], points).collect()}
    for group, rows in skewed.dropna().toPandas().groupby("g"):
        want = np.quantile(rows["x"], points)
        assert np.allclose([found[group, p] for p in points], want, atol=1e-12)


def test_medians_per_group(skewed):
    found = {r.g: r.x for r in medians(skewed, ["g"], ["x"]).collect()}
    want = skewed.toPandas().groupby("g")["x"].median().to_dict()
    assert found == want


def test_only_few_rows_are_ever_ordered(spark, monkeypatch):
    """Values over 300 orders of magnitude, hot ties and a hot key: brackets stay small, results exact."""
    monkeypatch.setattr(ranks, "BRACKET_ROWS", 50)
    monkeypatch.setattr(ranks, "CELLS", 1000)
    wild = F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.signum(F.rand(5) - 0.3) * F.pow(10.0, F.rand(6) * 300))
    key = F.when(F.rand(7) < 0.8, "big").otherwise("small")
    rows = materialise(spark.range(20_000).select(key.alias("k"), wild.alias("value")), "wild")
    wanted = [1, 500, 3_000]
    asked = spark.createDataFrame([(k, r) for k in ("big", "small", "none") for r in (*wanted, 10**9)], "k STRING, rank BIGINT")
    ordered, cells = [], []
    bracket_values, counted_cells = ranks._bracket_values, ranks._counted_cells

    def kept(frame, into):
        into.append(materialise(frame, "kept"))
        return into[-1]

    monkeypatch.setattr(ranks, "_bracket_values", lambda *a: kept(bracket_values(*a), ordered))
    monkeypatch.setattr(ranks, "_counted_cells", lambda *a: kept(counted_cells(*a), cells))
    got = {(r.k, r["rank"]): (r.value, r.below) for r in ranks.values_at_ranks(rows, asked, ["k"], []).collect()}
    for k, held in rows.toPandas().groupby("k")["value"]:
        held = np.sort(held.to_numpy())
        for r in wanted:
            assert got.pop((k, r)) == (held[r - 1], int((held < held[r - 1]).sum()))
    assert not got and ordered and cells
    assert all(r["sum"] <= 50 for f in ordered for r in f.groupBy("k", "low", "high").agg(F.sum("ties").alias("sum")).collect())
    assert all(r["count"] <= 1000 for f in cells for r in f.groupBy("k", "low", "high").count().collect())


def test_ranks_of_whole_numbers_at_the_ends_of_their_range(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BRACKET_ROWS", 2)
    monkeypatch.setattr(ranks, "CELLS", 4096)
    numbers = [-(2**63), -(2**63) + 1, -5, 0, 1, 2, 3, 2**62, 2**62 + 1, 2**63 - 2, 2**63 - 1, 2**63 - 1]
    values = spark.createDataFrame([("k", n) for n in numbers], "k STRING, value BIGINT")
    asked = spark.createDataFrame([("k", i + 1) for i in range(len(numbers))], "k STRING, rank BIGINT")
    got = {r["rank"]: (r.value, r.below) for r in ranks.values_at_ranks(values, asked, ["k"], []).collect()}
    assert got == {i + 1: (n, sum(m < n for m in numbers)) for i, n in enumerate(sorted(numbers))}


def test_ranks_with_infinite_values_and_nan(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BRACKET_ROWS", 2)
    monkeypatch.setattr(ranks, "CELLS", 4096)
    numbers = [float("-inf"), float("-inf"), -1.7e308, -1e-3, 0.0, 1e-3, 1.0, 1.0, 1.0, 1.5e308, float("inf"), float("inf"), float("nan"), float("nan")]
    values = spark.createDataFrame([("k", n) for n in numbers], "k STRING, value DOUBLE")
    asked = spark.createDataFrame([("k", i + 1) for i in range(len(numbers))], "k STRING, rank BIGINT")
    got = [r.value for r in ranks.values_at_ranks(values, asked, ["k"], []).orderBy("rank").collect()]
    assert [repr(x) for x in got] == [repr(x) for x in numbers]
