"""Group comparisons from per-group moments and contingency counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import ratio
from larder.functions.tails import chi2_p, f_p, range_p, t_critical, t_p
from larder.operators.ranks import medians
from larder.operators.tabulate import crosstab
from larder.session import small_table


def group_moments(df: DataFrame, group: str, value: str) -> DataFrame:
    """Size, mean and sample variance per group: one small row each."""
    return (
        df.filter(F.col(group).isNotNull())
        .groupBy(F.col(group).alias("grp"))
        .agg(
            F.count(value).alias("n"),
            F.avg(value).alias("mean"),
            F.var_samp(value).alias("variance"),
        )
    )


def welch_anova(moments: DataFrame) -> DataFrame:
    """Welch's F over group moments, with degrees of freedom, p and eta squared."""
    n, m, v = F.col("n"), F.col("mean"), F.col("variance")
    all_groups = Window.partitionBy()
    w = n / v
    weighed = small_table(moments).select(
        "n",
        "mean",
        "variance",
        w.alias("w"),
        F.sum(w).over(all_groups).alias("total_w"),
        (F.sum(w * m).over(all_groups) / F.sum(w).over(all_groups)).alias("centre"),
        (F.sum(n * m).over(all_groups) / F.sum(n).over(all_groups)).alias("grand"),
    )
    k = F.count(F.lit(1))
    lack = F.sum(F.pow(1 - F.col("w") / F.col("total_w"), 2) / (n - 1))
    between = F.sum(n * F.pow(m - F.col("grand"), 2))
    within = F.sum((n - 1) * v)
    spread = F.sum(F.col("w") * F.pow(m - F.col("centre"), 2)) / (k - 1)
    stats = weighed.agg(
        (spread / (1 + 2 * (k - 2) * lack / (k * k - 1))).alias("f"),
        (k - 1).alias("df1"),
        ((k * k - 1) / (3 * lack)).alias("df2"),
        (between / (between + within)).alias("eta_squared"),
    )
    return stats.withColumn("p", f_p("f", F.col("df1").cast("double"), "df2"))


def one_way_anova(moments: DataFrame) -> DataFrame:
    """Classic one-way F over group moments."""
    n, m, v = F.col("n"), F.col("mean"), F.col("variance")
    grand = F.sum(n * m).over(Window.partitionBy()) / F.sum(n).over(Window.partitionBy())
    k = F.count(F.lit(1))
    stats = (
        small_table(moments)
        .withColumn("grand", grand)
        .agg(
            (
                (F.sum(n * F.pow(m - F.col("grand"), 2)) / (k - 1))
                / (F.sum((n - 1) * v) / (F.sum(n) - k))
            ).alias("f"),
            (k - 1).alias("df1"),
            (F.sum(n) - k).alias("df2"),
        )
    )
    return stats.withColumn("p", f_p("f", F.col("df1").cast("double"), F.col("df2").cast("double")))


def levene_median(df: DataFrame, group: str, value: str) -> DataFrame:
    """Equality of spread: one-way F of distances to the group median.

    ``df`` is read several times: pass a stored table.
    """
    centre = small_table(medians(df, [group], [value]).withColumnRenamed(value, "centre"))
    distance = df.join(centre, group).withColumn("distance", F.abs(F.col(value) - F.col("centre")))
    return one_way_anova(group_moments(distance, group, "distance"))


def residual_shape(df: DataFrame, group: str, value: str) -> DataFrame:
    """Skewness and excess kurtosis of residuals from the group mean."""
    centre = small_table(df.groupBy(group).agg(F.avg(value).alias("centre")))
    residual = F.col(value) - F.col("centre")
    return df.join(centre, group).agg(
        F.count(value).alias("n"), F.skewness(residual).alias("skew"), F.kurtosis(residual).alias("kurtosis")
    )


def group_pairs(groups: DataFrame, key: str) -> DataFrame:
    """Every unordered pair of a small table's rows as structs ``a`` and ``b``.

    The pairs are of groups, never of the rows within one.
    """
    listed = small_table(groups).groupBy().agg(
        F.array_sort(F.collect_list(F.struct(key, *[c for c in groups.columns if c != key]))).alias("all")
    )
    return (
        listed.select("all", F.posexplode("all").alias("i", "a"))
        .select("a", F.explode(F.slice("all", F.col("i") + 2, F.greatest(F.size("all") - F.col("i") - 1, F.lit(0)))).alias("b"))
        .select("a", "b")
    )


def games_howell(moments: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Pairwise mean differences without assuming equal variances.

    p comes from the studentised range, the interval from Student's t.
    """
    pairs = group_pairs(moments, "grp")
    k = moments.count()
    va, vb = F.col("a.variance") / F.col("a.n"), F.col("b.variance") / F.col("b.n")
    stats = pairs.select(
        F.col("a.grp").alias("group_a"),
        F.col("b.grp").alias("group_b"),
        (F.col("a.mean") - F.col("b.mean")).alias("difference"),
        F.sqrt(va + vb).alias("se"),
        (F.pow(va + vb, 2) / (F.pow(va, 2) / (F.col("a.n") - 1) + F.pow(vb, 2) / (F.col("b.n") - 1))).alias("df"),
    )
    q = F.sqrt(F.lit(2.0)) * F.abs(ratio(F.col("difference"), F.col("se")))
    half = t_critical(F.lit(1 - alpha / 2), "df") * F.col("se")
    return (
        stats.withColumn("p", range_p(q, F.lit(float(k)), "df"))
        .withColumn("half", half)
        .withColumn("ci_low", F.col("difference") - F.col("half"))
        .withColumn("ci_high", F.col("difference") + F.col("half"))
        .drop("half")
    )


def contingency_test(df: DataFrame, row: str, column: str, values: Sequence) -> DataFrame:
    """Chi-square of independence with Cramer's V and the share of expected counts under 5.

    Rows and columns without any count are left out.
    """
    table = crosstab(df, row, column, values)
    labels = [c for c in table.columns if c != row]
    return contingency_test_cells(small_table(table).unpivot([row], labels, "col", "n"), row, "col", "n")


def contingency_test_cells(cells: DataFrame, row: str, column: str, count: str) -> DataFrame:
    n = F.col(count)
    margins = cells.select(
        row,
        column,
        count,
        F.sum(n).over(Window.partitionBy(row)).alias("row_n"),
        F.sum(n).over(Window.partitionBy(column)).alias("col_n"),
        F.sum(n).over(Window.partitionBy()).alias("total"),
    ).filter((F.col("row_n") > 0) & (F.col("col_n") > 0))
    expected = F.col("row_n") * F.col("col_n") / F.col("total")
    rows, columns = F.count_distinct(row), F.count_distinct(column)
    stats = margins.withColumn("expected", expected).agg(
        F.sum(F.pow(n - F.col("expected"), 2) / F.col("expected")).alias("chi2"),
        ((rows - 1) * (columns - 1)).alias("dof"),
        F.max("total").alias("n"),
        (F.least(rows, columns) - 1).alias("_span"),
        ratio(F.count_if(F.col("expected") < 5), F.count(F.lit(1))).alias("share_expected_below_5"),
    )
    return stats.select(
        "chi2",
        "dof",
        "n",
        F.sqrt(ratio(F.col("chi2"), F.col("n") * F.col("_span"))).alias("cramers_v"),
        "share_expected_below_5",
        chi2_p("chi2", F.col("dof").cast("double")).alias("p"),
    )


def welch_t(moments: DataFrame, first: str, second: str) -> DataFrame:
    """Two-sample t without assuming equal variances, first minus second."""
    pick = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c)))
    va, vb = pick(first, "variance") / pick(first, "n"), pick(second, "variance") / pick(second, "n")
    stats = moments.agg(
        (pick(first, "mean") - pick(second, "mean")).alias("difference"),
        ((pick(first, "mean") - pick(second, "mean")) / F.sqrt(va + vb)).alias("t"),
        (
            F.pow(va + vb, 2)
            / (F.pow(va, 2) / (pick(first, "n") - 1) + F.pow(vb, 2) / (pick(second, "n") - 1))
        ).alias("df"),
    )
    return stats.withColumn("p", t_p("t", "df"))


def interval_overlap(intervals: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """For each pair of groups, whether their intervals overlap."""
    pairs = group_pairs(intervals.select(key, low, high), key)
    return pairs.select(
        F.col(f"a.{key}").alias("group_a"),
        F.col(f"b.{key}").alias("group_b"),
        ((F.col(f"a.{high}") > F.col(f"b.{low}")) & (F.col(f"b.{high}") > F.col(f"a.{low}"))).alias("overlap"),
    )


def benjamini_hochberg(tests: DataFrame, p: str, alpha: float = 0.05) -> DataFrame:
    """Step-up rejection over a small table of tests; untested rows (NULL p) stay NULL."""
    tested = F.col(p).isNotNull()
    everything = Window.partitionBy(tested)
    ranked = small_table(tests).withColumn("_rank", F.row_number().over(everything.orderBy(p)))
    passes = F.col(p) <= F.col("_rank") / F.count(F.lit(1)).over(everything) * alpha
    last = F.max(F.when(passes, F.col("_rank")).otherwise(0)).over(everything)
    return (
        ranked.withColumn("_last", last)
        .withColumn("bh_reject", F.when(tested, F.col("_rank") <= F.col("_last")))
        .drop("_rank", "_last")
    )


def sample_size(groups: DataFrame, sigma: str, delta: str, z_alpha: float, z_beta: float) -> DataFrame:
    """Households per arm to detect ``delta`` given ``sigma``."""
    needed = 2 * (z_alpha + z_beta) ** 2 * F.pow(ratio(F.col(sigma), F.col(delta)), 2)
    return groups.withColumn("n_per_arm", F.ceil(needed).cast("bigint"))
