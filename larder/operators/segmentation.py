"""Behavioural segmentation: preparation, k sweep, naming and profiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.operators.ranks import medians, quantiles
from larder.operators.tabulate import correlations
from larder.session import materialise, small_table, use_all_cores

# Candidate inputs and how each is straightened.
CANDIDATES = {
    "frequency": "log1p",
    "monetary": "log",
    "recency_days": "log",
    "tenure_days": "as is",
    "weekend_trip_share": "as is",
    "top_store_trip_share": "as is",
    "retail_disc_rate": "as is",
    "weight_sold_spend_share": "log1p",
    "mean_gap_days": "log",
    "std_gap_days": "log1p",
    "gap_score": "as is",
    "basket_trend_direction": "as is",
    "private_label_spend_share": "as is",
    "top_category_spend_share": "sqrt",
}
# Canonical names by descending median spend, sweep and rule settings.
SEGMENT_NAMES = ("Champions", "Loyal Actives", "Declining", "Truly Lapsed")
SINGLE_TRIP = "Single-Trip"
CHOSEN_K = 4
SWEEP = range(2, 11)
N_INIT, MAX_ITER, SEED = 20, 500, 42
# Candidates for starting centres: rounds, and candidates a round per centre.
SEED_ROUNDS, OVERSAMPLING = 4, 2
# Passes after which the worse half of a k's restarts leaves; refits of the stability check.
ROUNDS_KEPT, REPLICATES = (4, 8, 12, 16), 200
# Rows whose distances to all centres a task holds at once.
ROWS_AT_ONCE = 2_000
CORRELATED, NEARLY_SAME = 0.70, 0.80


def impute_for_clustering(features: DataFrame) -> DataFrame:
    """Households with a cadence; undefined spread, trend and category share filled."""
    return features.filter(F.col("mean_gap_days").isNotNull()).fillna(
        {"std_gap_days": 0.0, "top_category_spend_share": 0.0, "basket_trend_direction": 2}
    )


def straighten(column: str, how: str) -> Column:
    """A monotone transform of a skewed input; logs floor at one cent or its like."""
    x = F.col(column).cast("double")
    return {
        "as is": lambda: x,
        "log1p": lambda: F.log1p(x),
        "log": lambda: F.log(F.greatest(x, F.lit(0.01))),
        "sqrt": lambda: F.sqrt(x),
    }[how]()


def transform_features(imputed: DataFrame) -> DataFrame:
    return imputed.select("household_id", *[straighten(c, how).alias(c) for c, how in CANDIDATES.items()])


def collinear_pairs(transformed: DataFrame, threshold: float = CORRELATED) -> DataFrame:
    """Pairs of inputs with |r| above the threshold, strongest first."""
    strength = F.abs("r")
    return correlations(transformed, list(CANDIDATES)).filter(strength > threshold).orderBy(strength.desc())


def choose_features(pairs: DataFrame) -> list[str]:
    """The inputs left after dropping the redundant cadence measures."""
    strength = {frozenset((row["feature_a"], row["feature_b"])): abs(row["r"]) for row in pairs.collect()}
    dropped = set()
    if frozenset(("gap_score", "mean_gap_days")) in strength:
        dropped.add("gap_score")
    if strength.get(frozenset(("frequency", "mean_gap_days")), 0.0) > NEARLY_SAME:
        dropped.add("mean_gap_days")
    return [c for c in CANDIDATES if c not in dropped]


def robust_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column less its median over its interquartile range, both exact.

    ``df`` is read several times: pass a stored table.
    """
    cut = {
        (row["variable"], row["probability"]): row["quantile"]
        for row in quantiles(df, [], columns, [0.25, 0.5, 0.75]).collect()
    }
    scaled = {c: (F.col(c) - cut[c, 0.5]) / ((cut[c, 0.75] - cut[c, 0.25]) or 1.0) for c in columns}
    return df.withColumns(scaled)


def _spread_out(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the weighted points, each drawn with odds of its squared distance to the earlier ones."""
    chosen = [points[rng.choice(len(points), p=weights / weights.sum())]]
    for _ in range(k - 1):
        nearest = weights * ((points[:, None, :] - np.array(chosen)[None]) ** 2).sum(axis=2).min(axis=1)
        odds = nearest / nearest.sum() if nearest.sum() > 0 else None
        chosen.append(points[rng.choice(len(points), p=odds)])
    return np.array(chosen)


def _distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Squared distances of rows to points; what a row doesn't know (NaN) adds nothing to its distances."""
    known = ~np.isnan(x)
    squares = (points**2).sum(axis=1)[None, :] if known.all() else known @ (points**2).T
    x = np.where(known, x, 0.0)
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ points.T + squares, 0.0)


def _nearest(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest point and squared distance to it."""
    far = _distances(x, points)
    near = far.argmin(axis=1)
    return near, far[np.arange(len(x)), near]


def _drawn(rows: DataFrame, names: list[str], points: np.ndarray, turn: int, wanted: int) -> np.ndarray:
    """Households drawn with odds of their squared distance to the points, in one pass.

    A household's key is exponential with its squared distance as the rate; the smallest
    keys are such a draw, so no total is needed first. Tasks pass on their smallest.
    """
    columns = ["household_id", *names]

    def smallest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            x = batch[names].to_numpy(float)
            _, far = _nearest(x, points)
            uniform = (batch["draw"].to_numpy() + 0.5) / float(1 << 53)
            with np.errstate(divide="ignore"):
                keyed = batch[columns].assign(key=-np.log(uniform) / far)
            keyed = keyed[np.isfinite(keyed["key"])]
            held = (keyed if held is None else pd.concat([held, keyed])).nsmallest(wanted, ["key", "household_id"])
        if held is not None:
            yield held

    draw = F.xxhash64("household_id", F.lit(SEED + turn)).bitwiseAND(F.lit((1 << 53) - 1)).alias("draw")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema.fields)
    kept = rows.select(*columns, draw).mapInPandas(smallest, f"{fields}, key DOUBLE")
    return kept.orderBy("key", "household_id").limit(wanted).select(*names).toPandas().to_numpy(float)


def starting_centres(df: DataFrame, columns: Sequence[str], ks: Sequence[int], n_init: int) -> dict:
    """Centres for every (k, start), spread over candidates that all households stand for.

    Each of some rounds is one pass that draws households with odds of their squared
    distance to the candidates so far, ``OVERSAMPLING`` times the largest k of them,
    however large the panel. Candidates weigh as many households as they are nearest to.
    """
    names, spread = list(columns), OVERSAMPLING * max(ks)
    rows = df.select("household_id", *[F.col(c).cast("double").alias(c) for c in names])
    lowest = F.struct(F.xxhash64("household_id", F.lit(SEED)), "household_id")
    # a candidate's unknown coordinates are zero, the median of scaled inputs
    points = np.nan_to_num(np.array([rows.agg(F.min_by(F.array(*names), lowest)).first()[0]], float))
    for turn in range(1, SEED_ROUNDS + 1):
        drawn = _drawn(rows, names, points, turn, spread)
        if not len(drawn):
            break
        points = np.unique(np.vstack([points, np.nan_to_num(drawn)]), axis=0)
    weights = _sums(rows, names, {"candidates": points})["candidates"][:, 0]
    return {
        (k, start): _spread_out(points, weights, k, np.random.default_rng([SEED, k, start]))
        for k in ks
        for start in range(n_init)
    }


def _sums(df: DataFrame, columns: Sequence[str], centres: dict, weigh: Callable | None = None) -> dict:
    """For every run, from one pass: households, coordinate sums, squared norms and cost per centre.

    ``weigh`` gives the weights of rows (households) by runs (in the order of ``centres``).
    A coordinate that a household doesn't know counts as that of its centre.
    """
    names, width = list(columns), len(columns) + 3
    stacked = np.vstack(list(centres.values()))
    edges = np.cumsum([0, *[len(c) for c in centres.values()]])
    kept = ["household_id", *names] if weigh else names
    # runs with equally many centres are handled together: run numbers, and their centres' numbers
    sizes = np.diff(edges)
    alike = [(np.flatnonzero(sizes == k), k, (edges[:-1][sizes == k][:, None] + np.arange(k)).ravel()) for k in np.unique(sizes)]

    def add(sums: np.ndarray, x: np.ndarray, weights: np.ndarray | None) -> None:
        unknown = np.isnan(x).astype(float)
        given = np.where(unknown > 0, 0.0, x)
        z = np.column_stack([np.ones(len(x)), given, (given**2).sum(axis=1)])
        rows = np.arange(len(x))[:, None]
        for runs, k, numbers in alike:
            points = stacked[numbers]
            far = _distances(x, points).reshape(len(x), -1, k)
            place = np.arange(len(runs)) * k + far.argmin(axis=2)
            member = np.zeros((len(x), len(numbers)))
            member[rows, place] = 1.0 if weights is None else weights[:, runs]
            sums[numbers, :-1] += member.T @ z
            if unknown.any():
                filled = member.T @ unknown
                sums[numbers, 1:-2] += filled * points
                sums[numbers, -2] += (filled * points**2).sum(axis=1)
            sums[numbers, -1] += np.einsum("ij,ij->j", member, far.reshape(len(x), -1))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(stacked), width))
        for batch in batches:
            x = batch[names].to_numpy(float)
            weights = weigh(batch["household_id"].to_numpy()) if weigh else None
            for at in range(0, len(x), ROWS_AT_ONCE):
                part = slice(at, at + ROWS_AT_ONCE)
                add(sums, x[part], None if weights is None else weights[part])
        yield pd.DataFrame({"centre": np.arange(len(stacked)), "sums": list(sums)})

    parts = df.select(*kept).mapInPandas(partial, "centre INT, sums ARRAY<DOUBLE>")
    table = parts.groupBy("centre").agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    totals = np.zeros((len(stacked), width))
    for row in table.toPandas().to_numpy(float):
        totals[int(row[0])] = row[1:]
    return {run: totals[low:high] for run, low, high in zip(centres, edges[:-1], edges[1:])}


def _moved(sums: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Centres at the means of their households; an empty one stays."""
    return np.where(sums[:, :1] > 0, sums[:, 1:-2] / np.maximum(sums[:, :1], 1e-300), before)


def _tolerance(df: DataFrame, columns: Sequence[str]) -> float:
    variance = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return 1e-4 * float(np.mean([variance[c] or 0.0 for c in columns]))


@dataclass
class Fit:
    """The best run of a k: centres, cost, and per centre households, coordinate sums, squared norms and cost."""

    centres: np.ndarray
    inertia: float
    sums: np.ndarray


def kmeans_fits(
    df: DataFrame, columns: Sequence[str], ks: Sequence[int], n_init: int = N_INIT, max_iter: int = MAX_ITER
) -> dict[int, Fit]:
    """The best run per k over all restarts.

    All restarts of all k move together: one pass over the households serves every run
    still moving. After the passes in ``ROUNDS_KEPT`` the worse half of a k's restarts
    leaves, so that the last passes, which only few runs need, are cheap.
    """
    centres = starting_centres(df, columns, ks, n_init)
    tolerance = _tolerance(df, columns)
    moving, cost = dict(centres), {}
    for number in range(1, max_iter + 1):
        for run, sums in _sums(df, columns, moving).items():
            moved = _moved(sums, centres[run])
            cost[run] = float(sums[:, -1].sum())
            shift = float(((moved - centres[run]) ** 2).sum())
            centres[run] = moving[run] = moved
            if shift <= tolerance:
                del moving[run]
        if number in ROUNDS_KEPT:
            for k in ks:
                ranked = sorted((run for run in centres if run[0] == k), key=cost.get)
                for run in ranked[max(1, -(-len(ranked) // 2)) :]:
                    del centres[run]
                    moving.pop(run, None)
        if not moving:
            break
    last = _sums(df, columns, centres)
    best = {k: min((run for run in last if run[0] == k), key=lambda run: last[run][:, -1].sum()) for k in ks}
    return {k: Fit(centres[run], float(last[run][:, -1].sum()), last[run]) for k, run in best.items()}


def kmeans_runs(
    df: DataFrame, columns: Sequence[str], ks: Sequence[int], n_init: int = N_INIT, max_iter: int = MAX_ITER
) -> dict[int, tuple[np.ndarray, float]]:
    """Best centres and inertia per k over all restarts."""
    return {k: (fit.centres, fit.inertia) for k, fit in kmeans_fits(df, columns, ks, n_init, max_iter).items()}


def kmeans_step(df: DataFrame, columns: Sequence[str], centres: np.ndarray) -> DataFrame:
    """One pass with given centres: label, households, cost and the centre they would move to."""
    sums = _sums(df, columns, {"step": np.asarray(centres, float)})["step"]
    moved = _moved(sums, np.asarray(centres, float))
    rows = [(i, int(s[0]), float(s[-1]), [float(x) for x in c]) for i, (s, c) in enumerate(zip(sums, moved))]
    return df.sparkSession.createDataFrame(rows, "label INT, size BIGINT, inertia DOUBLE, centre ARRAY<DOUBLE>")


def adjusted_rand(cells: DataFrame, by: Sequence[str], a: str, b: str, n: str) -> DataFrame:
    """Adjusted Rand index of two labellings from counts ``n`` of label pairs, per value of ``by``."""
    by = list(by)
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2

    def margin(label: str) -> DataFrame:
        sums = cells.groupBy(*by, label).agg(F.sum(n).alias("m"))
        return sums.groupBy(*by).agg(F.sum(pairs("m")).alias(f"in_{label}"))

    whole = cells.groupBy(*by).agg(F.sum(n).alias("n"), F.sum(pairs(n)).alias("both"))
    joined = whole.join(margin(a), by) if by else whole.withColumn(f"in_{a}", margin(a).scalar())
    joined = joined.join(margin(b), by) if by else joined.withColumn(f"in_{b}", margin(b).scalar())
    expected = F.col(f"in_{a}") * F.col(f"in_{b}") / F.nullif(pairs("n"), F.lit(0.0))
    most = (F.col(f"in_{a}") + F.col(f"in_{b}")) / 2
    # both labellings put all in one group, or each in its own: the same
    index = F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / (most - expected))
    return joined.select(*by, "n", index.alias("ari"))


def stability(df: DataFrame, columns: Sequence[str], centres: np.ndarray, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """Adjusted Rand index of each bootstrap refit with the fit, over the replicate's households.

    Replicates weigh households by Poisson draws, start from the fit's centres and move
    together: a pass serves all that still move. Only counts of label pairs leave the tasks.
    """
    from larder.operators.resampling import poisson_draws

    names, tolerance = list(columns), _tolerance(df, columns)
    found = {r: np.array(centres, float) for r in range(1, replicates + 1)}
    moving = dict(found)
    for _ in range(MAX_ITER):
        numbers = np.array(list(moving))
        weigh = lambda ids, numbers=numbers: poisson_draws(ids, numbers, seed)
        for run, sums in _sums(df, names, moving, weigh).items():
            moved = _moved(sums, found[run])
            shift = float(((moved - found[run]) ** 2).sum())
            found[run] = moving[run] = moved
            if shift <= tolerance:
                del moving[run]
        if not moving:
            break
    numbers, k = np.array(list(found)), len(centres)

    def contingency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.zeros((len(numbers), k, k), np.int64)
        for batch in batches:
            x = batch[names].to_numpy(float)
            base, _ = _nearest(x, np.asarray(centres, float))
            drawn = poisson_draws(batch["household_id"].to_numpy(), numbers, seed) > 0
            for at, run in enumerate(numbers):
                label, _ = _nearest(x, found[run])
                cells[at] += np.bincount((base * k + label)[drawn[:, at]], minlength=k * k).reshape(k, k)
        at, a, b = np.nonzero(cells)
        yield pd.DataFrame({"replicate": numbers[at], "a": a, "b": b, "n": cells[at, a, b]})

    parts = df.select("household_id", *names).mapInPandas(contingency, "replicate INT, a INT, b INT, n BIGINT")
    counts = small_table(parts.groupBy("replicate", "a", "b").agg(F.sum("n").alias("n")))
    return adjusted_rand(counts, ["replicate"], "a", "b", "n")


def nearest_centre(columns: Sequence[str], centres: np.ndarray) -> Column:
    """Index of the closest centre as a column expression; unknown coordinates add nothing."""
    part = lambda c, v: F.coalesce(F.pow(F.col(c) - float(v), 2), F.lit(0.0))
    distances = F.array(*[sum(part(c, v) for c, v in zip(columns, centre)) for centre in centres])
    return (F.array_position(distances, F.array_min(distances)) - 1).cast("int")


def total_spread(df: DataFrame, columns: Sequence[str]) -> tuple[int, float]:
    """Rows and total squared distance to the centre."""
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.var_pop(c).alias(c) for c in columns]).first()
    return row["n"], row["n"] * sum(row[c] or 0.0 for c in columns)


def silhouettes(df: DataFrame, columns: Sequence[str], fits: dict[int, Fit]) -> dict[int, float]:
    """Mean silhouette of each fit with squared distances, whose means have a closed form per cluster.

    All fits in one pass; the plain Euclidean silhouette needs all pairs of households.
    """
    names = list(columns)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = dict.fromkeys(fits, 0.0)
        for batch in batches:
            rows = batch.to_numpy(float)
            for k, fit in fits.items():
                n, sums, squares = fit.sums[:, 0], fit.sums[:, 1:-2], fit.sums[:, -2]
                label, _ = _nearest(rows, fit.centres)
                x = np.where(np.isnan(rows), fit.centres[label], rows)
                total = np.maximum((x**2).sum(axis=1)[:, None] * n + squares - 2 * x @ sums.T, 0.0)
                at = np.arange(len(x))
                own = total[at, label] / np.maximum(n[label] - 1, 1)
                other = np.where(n > 0, total / np.maximum(n, 1), np.inf)
                other[at, label] = np.inf
                best = other.min(axis=1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    score = np.where(n[label] > 1, (best - own) / np.maximum(best, own), 0.0)
                totals[k] += float(np.nan_to_num(score).sum())
        yield pd.DataFrame({"k": list(totals), "total": list(totals.values())})

    parts = df.select(*names).mapInPandas(partial, "k INT, total DOUBLE").groupBy("k").agg(F.sum("total").alias("total"))
    sums = {row["k"]: row["total"] for row in parts.collect()}
    return {k: sums[k] / max(1.0, float(fit.sums[:, 0].sum())) for k, fit in fits.items()}


def sweep_table(df: DataFrame, columns: Sequence[str], fits: dict[int, Fit]) -> DataFrame:
    """Silhouette, inertia and Calinski-Harabasz of the best run per k."""
    n, total = total_spread(df, columns)
    score = silhouettes(df, columns, fits)
    rows = [
        (k, score[k], fit.inertia, ((total - fit.inertia) / (k - 1)) / (fit.inertia / (n - k)))
        for k, fit in fits.items()
    ]
    return df.sparkSession.createDataFrame(
        rows, "k INT, silhouette DOUBLE, inertia DOUBLE, calinski_harabasz DOUBLE"
    )


def calinski_harabasz(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """Between over within variance for any labelling, from per-group moments."""
    groups = small_table(
        df.groupBy(label).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(c).alias(f"m_{c}") for c in columns],
            *[F.var_pop(c).alias(f"v_{c}") for c in columns],
        )
    )
    n, whole = F.col("n"), Window.partitionBy()
    centred = groups.withColumns(
        {f"g_{c}": F.sum(n * F.col(f"m_{c}")).over(whole) / F.sum(n).over(whole) for c in columns}
    )
    between = sum(F.pow(F.col(f"m_{c}") - F.col(f"g_{c}"), 2) for c in columns) * n
    within = sum(F.col(f"v_{c}") for c in columns) * n
    k = F.count(F.lit(1))
    return centred.agg(
        ((F.sum(between) / (k - 1)) / (F.sum(within) / (F.sum("n") - k))).alias("calinski_harabasz")
    )


def second_differences(curve: DataFrame) -> DataFrame:
    """Curvature of a short curve (k, inertia) at its inner points, the peak marked."""
    along = Window.orderBy("k")
    bend = F.lag("inertia").over(along) - 2 * F.col("inertia") + F.lead("inertia").over(along)
    inner = small_table(curve).withColumn("d2", bend).filter(F.col("d2").isNotNull())
    return inner.select("k", "d2", (F.col("d2") == F.max("d2").over(Window.partitionBy())).alias("is_elbow"))


def choose_k(sweep: DataFrame) -> DataFrame:
    """Among k within a tenth of the best silhouette, the one nearest the elbow, kept in 3..7."""
    elbow = second_differences(sweep.select("k", "inertia")).agg(F.max_by("k", F.struct("d2", -F.col("k"))).alias("elbow_k"))
    peak = sweep.agg(
        F.max("silhouette").alias("peak"),
        F.max_by("k", "silhouette").alias("silhouette_k"),
        F.max_by("k", "calinski_harabasz").alias("ch_k"),
    )
    facts = [peak.select(c).scalar().alias(c) for c in ("peak", "silhouette_k", "ch_k")]
    fitted = sweep.select("k", "silhouette", *facts, elbow.scalar().alias("elbow_k"))
    near = F.struct(F.abs(F.col("k") - F.col("elbow_k")), "k")
    return (
        fitted.filter(F.col("silhouette") >= 0.9 * F.col("peak"))
        .groupBy("silhouette_k", "ch_k", "elbow_k")
        .agg(F.min_by("k", near).alias("nearest"))
        .select("silhouette_k", "ch_k", "elbow_k", F.greatest(F.lit(3), F.least(F.lit(7), F.col("nearest"))).alias("chosen_k"))
    )


def name_segments(labelled: DataFrame, cluster: str, names: Sequence[str] = SEGMENT_NAMES) -> DataFrame:
    """Cluster to name by descending median spend: one row per cluster."""
    spend = small_table(medians(labelled, [cluster], ["monetary"]))
    place = F.row_number().over(Window.orderBy(F.desc("monetary"), cluster))
    named = F.try_element_at(F.array(*[F.lit(n) for n in names]), place)
    return spend.select(cluster, F.coalesce(named, F.concat(F.lit("Segment "), place.cast("string"))).alias("cluster_name"))


# Fallback names with the cluster medians each requires, first match wins.
HEURISTIC_NAMES = (
    ("Champions", "recency_days <= 14 AND frequency >= 80 AND monetary >= 2500"),
    ("Loyal Regulars", "recency_days <= 30 AND frequency >= 30 AND monetary >= 1000"),
    ("New/Returning", "recency_days <= 20 AND frequency < 30"),
    ("Lapsed / Lost", "mean_gap_days >= 20 OR recency_days >= 60"),
    ("Occasional", "frequency < 30 AND monetary < 800"),
)


def heuristic_names(cluster_medians: DataFrame) -> DataFrame:
    """A name per cluster from its median behaviour."""
    rules = " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in HEURISTIC_NAMES)
    return cluster_medians.withColumn("heuristic_name", F.expr(f"CASE {rules} ELSE 'Mid-tier' END"))


@dataclass
class Segmentation:
    """Chosen inputs, scaled rows, the fit of every k, the chosen centres and the named households."""

    features: list[str]
    scaled: DataFrame
    fits: dict[int, Fit]
    centres: np.ndarray
    assignments: DataFrame


def cluster_input(features: DataFrame) -> tuple[list[str], DataFrame]:
    """Chosen inputs and their scaled values, stored for the passes."""
    transformed = materialise(transform_features(impute_for_clustering(features)), "cluster-input")
    chosen = choose_features(collinear_pairs(transformed))
    scaled = materialise(robust_scale(transformed.select("household_id", *chosen), chosen), "cluster-scaled")
    spread = use_all_cores(scaled, "household_id", 2_000)
    return chosen, scaled if spread is scaled else materialise(spread, "cluster-spread")


def segment_households(
    features: DataFrame, k: int = CHOSEN_K, n_init: int = N_INIT, ks: Sequence[int] = SWEEP
) -> Segmentation:
    """Cluster on the chosen inputs for every k at once and name each household's segment at ``k``."""
    chosen, scaled = cluster_input(features)
    fits = kmeans_fits(scaled, chosen, sorted({*ks, k}), n_init)
    labels = scaled.select("household_id", nearest_centre(chosen, fits[k].centres).alias("cluster"))
    labelled = materialise(labels.join(features, "household_id"), "clustered")
    named = labelled.join(small_table(name_segments(labelled, "cluster")), "cluster")
    return Segmentation(
        chosen,
        scaled,
        fits,
        fits[k].centres,
        named.select(
            "household_id", "cluster", "cluster_name", "r_score", "f_score", "m_score", "rfm_code", "has_demographics"
        ),
    )
