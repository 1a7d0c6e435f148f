"""Bootstrap of means and of weighted treatment effects, all replicates in one pass.

A replicate re-weights every row by a Poisson(1) draw that depends only on the
row's key, the replicate and the seed, so retries and other partitionings give
the same result. Tasks reduce their rows to sums per replicate; no task ever
holds a group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.session import materialise, use_all_cores

_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 18)]))
# each row meets thousands of replicates
ROWS_PER_TASK, MOST_ROWS = 1_000, 50_000
# cells of the row-by-replicate tile a task works on, few enough for its cache, its replicates, and its rows per value summed up
_TILE, _TILE_REPLICATES, _ROWS_PER_SUM = 32_000, 128, 4

# the draw by the first 16 of a cell's random bits; 255 where a level lies within, so that all bits decide
_STARTS = np.arange((1 << 16) + 1) / (1 << 16)
_BY_START = np.searchsorted(_POISSON, _STARTS[:-1]).astype(np.uint8)
_BY_START[np.searchsorted(_POISSON, _STARTS[1:], side="right") != _BY_START] = 255


def poisson_draws(keys: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weights, rows by replicates; replicate 0 has weight one."""
    draws = np.empty((len(keys), len(replicates)))
    with np.errstate(over="ignore"):
        of_key = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)
        of_replicate = replicates.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
        step = max(1, _TILE // max(1, len(replicates)))
        both = np.empty((2, min(step, len(keys)), len(replicates)), np.uint64)
        for at in range(0, len(keys), step):
            key = of_key[at : at + step, None]
            bits, shifted = both[:, : len(key)]
            np.add(key, of_replicate, out=bits)
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                bits ^= np.right_shift(bits, np.uint64(shift), out=shifted)
                bits *= np.uint64(factor)
            # the last step of the hash leaves the first 31 bits as they are
            drawn = _BY_START.take(np.right_shift(bits, np.uint64(48), out=shifted).view(np.int64), mode="clip")
            draws[at : at + step] = drawn
            open_cells = np.flatnonzero(drawn == 255)
            rest = bits.ravel()[open_cells]
            uniform = ((rest ^ (rest >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
            draws[at : at + step].ravel()[open_cells] = np.searchsorted(_POISSON, uniform)
    draws[:, replicates == 0] = 1.0
    return draws


def reduce_rows(
    df: DataFrame,
    group: str,
    key: str,
    columns: Sequence[str],
    numbers: np.ndarray,
    width: int,
    seed: int,
    block: Callable[[object, np.ndarray], Callable[[np.ndarray, slice], np.ndarray]],
    largest: int = 0,
) -> DataFrame:
    """Sum ``block(group, rows)(draws, part)`` (replicates by ``width``) over all rows.

    A block prepares its rows once and is then asked for the sums of each ``part`` of the
    replicates. The last ``largest`` columns are combined by their maximum. Returns
    ``group``, ``replicate`` and an array of ``width`` values. Pass a stored table: rows are
    counted and dealt to tasks of at most ``MOST_ROWS``, more where replicates are few.
    """
    names, added, schema = list(columns), width - largest, f"{group} STRING, replicate INT, sums"

    def empty(rows: int) -> np.ndarray:
        return np.column_stack([np.zeros((rows, added)), np.full((rows, largest), -np.inf)])

    def combine(total: np.ndarray, new: np.ndarray) -> None:
        total[:, :added] += new[:, :added]
        np.maximum(total[:, added:], new[:, added:], out=total[:, added:])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        wide = min(len(numbers), _TILE_REPLICATES)
        step = max(_TILE // wide, _ROWS_PER_SUM * width)
        for batch in batches:
            for name, rows in batch.groupby(group):
                ids, data = rows[key].to_numpy(), rows[names].to_numpy(float)
                total = sums.setdefault(name, empty(len(numbers)))
                for at in range(0, len(rows), step):
                    of_part = block(name, data[at : at + step])
                    for first in range(0, len(numbers), wide):
                        part = slice(first, first + wide)
                        combine(total[part], of_part(poisson_draws(ids[at : at + step], numbers[part], seed), part))
        for name, total in sums.items():
            yield pd.DataFrame({group: name, "replicate": numbers, "sums": [row.tobytes() for row in total]})

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[object, int], np.ndarray] = {}
        for batch in batches:
            for name, replicate, given in batch.itertuples(index=False):
                new = np.frombuffer(given)
                if (name, replicate) in sums:
                    combine(sums[name, replicate][None], new[None])
                else:
                    sums[name, replicate] = new.copy()
        if sums:
            keys, totals = zip(*sums.items())
            yield pd.DataFrame({group: [k[0] for k in keys], "replicate": [k[1] for k in keys], "sums": totals})

    most = MOST_ROWS * max(1, ROWS_PER_TASK // len(numbers))
    parts = use_all_cores(df.select(group, key, *names), key, ROWS_PER_TASK, most).mapInPandas(partial, f"{schema} BINARY")
    return parts.repartition(group, "replicate").mapInPandas(whole, f"{schema} ARRAY<DOUBLE>")


def bootstrap_means(
    df: DataFrame, group: str, key: str, values: Sequence[str], replicates: int = 10_000, seed: int = 42
) -> DataFrame:
    """Mean and 95% percentile interval of each value per group."""
    rows = df.filter(F.col(group).isNotNull()).select(group, key, *[F.col(v).cast("double").alias(v) for v in values])

    def block(_, data: np.ndarray):
        columns = np.column_stack([np.ones(len(data)), data])
        return lambda draws, part: (columns.T @ draws).T

    sums = reduce_rows(rows, group, key, values, np.arange(replicates + 1), len(values) + 1, seed, block)
    means = sums.filter(F.col("sums")[0] > 0).select(
        group,
        "replicate",
        F.col("sums")[0].cast("bigint").alias("n"),
        F.explode(
            F.array(*[F.struct(F.lit(v).alias("measure"), (F.col("sums")[i + 1] / F.col("sums")[0]).alias("mean")) for i, v in enumerate(values)])
        ).alias("m"),
    ).select(group, "replicate", "n", "m.measure", "m.mean")
    drawn = F.when(F.col("replicate") > 0, F.col("mean"))
    return means.groupBy(group, "measure").agg(
        F.max(F.when(F.col("replicate") == 0, F.col("n"))).alias("n"),
        F.max(F.when(F.col("replicate") == 0, F.col("mean"))).alias("mean"),
        F.percentile(drawn, F.lit(0.025)).alias("ci_low"),
        F.percentile(drawn, F.lit(0.975)).alias("ci_high"),
    )


def _odds(score: np.ndarray) -> np.ndarray:
    """One and the odds of a log odds, which is overwritten."""
    with np.errstate(over="ignore"):
        np.exp(score, out=score)
    score += 1.0
    return score


def _towards(data: np.ndarray) -> np.ndarray:
    """Constant and covariates per row, with the sign that raises the weight of the row's own arm."""
    return np.column_stack([np.ones(len(data)), data[:, :-2]]) * np.where(data[:, -2] == 1, -1.0, 1.0)[:, None]


def _raw_weights(
    beta: np.ndarray, data: np.ndarray, clip: tuple[float, float]
) -> tuple[np.ndarray, np.ndarray]:
    """Inverse-probability weights, rows by replicates, and which rows are treated."""
    return _capped_weights(_towards(data) @ beta.T, treated := data[:, -2][:, None] == 1, clip), treated


def _capped_weights(score: np.ndarray, treated: np.ndarray, clip: tuple[float, float]) -> np.ndarray:
    """Weights from log odds against the row's own arm; ``score`` is overwritten."""
    (low, high), (under, over) = clip, (1.0 - clip[0], 1.0 - clip[1])
    score = _odds(score)
    np.maximum(score, np.where(treated, 1.0 / high, 1.0 / under), out=score)
    return np.minimum(score, np.where(treated, 1.0 / low, 1.0 / over), out=score)


class EffectBootstrap:
    """Inverse-probability effects refitted on every replicate of every group.

    The sample itself (replicate 0) is fitted first. From its fit the propensity models
    of all replicates take Newton steps together: each step is one pass that sums
    gradients and curvatures per replicate. The first step starts from the same
    coefficients everywhere, so it is part of the pass for the moments. The weight cap of
    each replicate is the exact quantile of its raw weights: counting passes narrow a
    bracket around each of the two order statistics until it holds a single weight. In
    large groups only rows whose weight reaches a bound in some replicate are counted one
    by one; that bound lies under the cap of every replicate, or the rows are chosen anew.
    """

    STEPS, CELLS, NARROWINGS = 25, 64, 40
    # cells of the log odds that the bound is chosen from, and how much more than the rows above the cap reach it
    BOUNDS, MARGIN = 1_024, 1.5

    def __init__(
        self,
        df: DataFrame,
        group: str,
        key: str,
        covariates: Sequence[str],
        replicates: int,
        seed: int,
        clip: tuple[float, float],
        cap: float,
        min_arm: int,
    ):
        self.df, self.group, self.key = df, group, key
        self.covariates, self.replicates, self.seed = list(covariates), replicates, seed
        self.clip, self.cap, self.min_arm = clip, cap, min_arm
        self.columns = [*self.covariates, "treated", "outcome"]
        #: Per group the coefficients (constant first) of the sample's propensity model.
        self.sample_fit: dict[str, np.ndarray] = {}

    def _pass(
        self, block: Callable, width: int, numbers: np.ndarray | None = None, largest: int = 0, df: DataFrame | None = None
    ) -> dict[str, np.ndarray]:
        """Sums per group, replicates by ``width``: bounded by the replicate count."""
        numbers = np.arange(self.replicates + 1) if numbers is None else numbers
        df = self.df if df is None else df
        table = reduce_rows(df, self.group, self.key, self.columns, numbers, width, self.seed, block, largest)
        rows: dict[str, np.ndarray] = {}
        for group, replicate, sums in table.toPandas().itertuples(index=False):
            rows.setdefault(group, np.zeros((len(numbers), width)))[np.searchsorted(numbers, replicate)] = sums
        return rows

    def _moments(self, numbers: np.ndarray | None = None, start: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
        """Counts, sums and sums of squares; with ``start`` the gradients and curvatures there, too."""
        d = len(self.covariates)
        pairs = np.triu_indices(d + 1)

        def block(group, data):
            x, t = data[:, :-2], data[:, -2]
            columns = [np.ones(len(data)), t, x, x * x]
            if start:
                z = _towards(data)
                missed = 1.0 - 1.0 / _odds(z @ start[group].T)
                columns += [-missed * z, missed * (1.0 - missed) * (z[:, pairs[0]] * z[:, pairs[1]])]
            columns = np.column_stack(columns)
            return lambda draws, part: (columns.T @ draws).T

        return self._pass(block, 2 + 2 * d + (d + 1 + len(pairs[0]) if start else 0), numbers)

    def _fit(
        self,
        moments: dict[str, np.ndarray],
        start: dict[str, np.ndarray] | None,
        numbers: np.ndarray,
        first: dict[str, np.ndarray] | None = None,
    ) -> dict[str, np.ndarray]:
        """Coefficients of some replicates of every group, from given ones or zero.

        ``first`` holds gradients and curvatures at the given ones.
        """
        d = len(self.covariates)
        weight, beta, scaled, before = {}, {}, {}, {}
        for group, every in moments.items():
            m = every[numbers]
            n = np.maximum(m[:, :1], 1.0)
            variance = m[:, 2 + d : 2 + 2 * d] / n - (m[:, 2 : 2 + d] / n) ** 2
            constant = variance <= 1e-12
            # penalty of one on standardised slopes; constant inputs stay out
            weight[group] = np.column_stack([np.zeros(len(n)), np.where(constant, 1.0, variance)])
            # replicates with too small an arm are left at zero and not used
            fitted = (m[:, 1] >= self.min_arm) & (m[:, 0] - m[:, 1] >= self.min_arm)
            scaled[group] = np.column_stack([fitted, ~constant & fitted[:, None]])
            beta[group] = np.where(scaled[group], start[group], 0.0) if start else np.zeros((len(n), d + 1))
            before[group] = np.full(len(n), np.inf)
        pairs = np.triu_indices(d + 1)  # curvatures are symmetric: each is summed once
        for _ in range(self.STEPS):
            current = dict(beta)

            def block(group, data):
                z = _towards(data)
                outer, coefficients = z[:, pairs[0]] * z[:, pairs[1]], current[group]

                def sums(draws, part):
                    other = _odds(z @ coefficients[part].T)
                    np.divide(1.0, other, out=other)
                    missed = 1.0 - other
                    missed *= draws
                    slope = -z.T @ missed
                    other *= missed
                    return np.vstack([slope, outer.T @ other]).T

                return sums

            left = False
            for group, sums in (first or self._pass(block, (d + 1) + len(pairs[0]), numbers)).items():
                slope = sums[:, : d + 1] - weight[group] * beta[group]
                curve = np.zeros((len(sums), d + 1, d + 1))
                curve[:, pairs[0], pairs[1]] = curve[:, pairs[1], pairs[0]] = sums[:, d + 1 :]
                curve = curve + weight[group][:, :, None] * np.eye(d + 1) + 1e-9 * np.eye(d + 1)
                slope = np.where(scaled[group], slope, 0.0)
                step = np.linalg.solve(curve, slope[:, :, None])[:, :, 0]
                step *= np.minimum(1.0, 5.0 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-12))
                size, last = np.abs(step).max(axis=1), before[group]
                if first:
                    # replicates without all inputs of the sample start elsewhere
                    elsewhere = scaled[group].any(axis=1) & (beta[group] != start[group]).any(axis=1)
                    step[elsewhere], size[elsewhere] = 0.0, np.inf
                beta[group] = beta[group] + step
                # errors are squared by a step: what is left is known from the last two, if they are small
                next_size = np.maximum(size / np.clip(last, 1e-12, 1e12) ** 2, 1.0) * size**2
                left = left or not ((size < 1e-7) | ((last < 0.5) & (next_size < 1e-10))).all()
                before[group] = size
            first = None
            if not left:
                break
        return beta

    def _top_rows(self, moments: dict[str, np.ndarray], beta: dict[str, np.ndarray], share: float) -> tuple[DataFrame, dict[str, float]]:
        """The rows that can reach a bound in some replicate, and the bounds as weights.

        The bound of a group is reached by ``share`` of its rows in every replicate. A row's log
        odds differ from those of the mean coefficients by at most the product of two lengths
        (Cauchy-Schwarz). Small groups keep all their rows and have no bound.
        """
        top = float(np.log(1.0 / min(self.clip[0], 1.0 - self.clip[1]) - 1.0))
        cells, size = self.BOUNDS, 2.0 * top / self.BOUNDS
        centre, spread, bounds = {}, {}, {}
        for group, m in moments.items():
            off = beta[group] - (middle := beta[group].mean(axis=0))
            if share < 1.0 and m[0, 0] > MOST_ROWS and np.isfinite(off).all():
                around = off.T @ off / len(off)
                root = np.linalg.cholesky(around + (1e-9 * np.trace(around) + 1e-18) * np.eye(len(around)))
                farthest = np.sqrt((np.linalg.solve(root, off.T) ** 2).sum(axis=0)).max()
                centre[group], spread[group] = middle, farthest * root
        if not centre:
            return self.df, {}

        def scores(group: str, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            z = _towards(data)
            return z @ centre[group], np.sqrt(((z @ spread[group]) ** 2).sum(axis=1)) + 1e-9

        def least(group, data):
            if group not in centre:
                return lambda draws, part: np.zeros((1, cells))
            score, most = scores(group, data)
            cell = np.clip(np.nan_to_num((score - most + top) / size), 0, cells - 1).astype(int)
            return lambda draws, part: np.bincount(cell, minlength=cells)[None]

        for group, counts in self._pass(least, cells, np.array([0])).items():
            reached = np.cumsum(counts[0, ::-1])[::-1] >= share * moments[group][0, 0]
            if reached[1:].any() and group in centre:
                bounds[group] = float(np.flatnonzero(reached)[-1] * size - top)
        group, columns = self.group, [self.key, *self.columns]
        names = self.columns

        def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for name, rows in batch.groupby(group):
                    if name in bounds:
                        score, most = scores(name, rows[names].to_numpy(float))
                        rows = rows[~(score + most < bounds[name])]
                    yield rows

        rows = self.df.select(group, *columns)
        return materialise(rows.mapInPandas(keep, rows.schema), "cap-rows"), {g: 1.0 + float(np.exp(b)) for g, b in bounds.items()}

    def _caps(self, moments: dict[str, np.ndarray], beta: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Per replicate the interpolated cap quantile of the raw weights, exact."""
        share = self.MARGIN * (1.0 - self.cap)
        while True:
            rows, bounds = self._top_rows(moments, beta, share)
            caps, exact = self._caps_of(rows, bounds, moments, beta)
            if exact:
                return caps
            share *= 8.0

    def _caps_of(
        self, rows: DataFrame, bounds: dict[str, float], moments: dict[str, np.ndarray], beta: dict[str, np.ndarray]
    ) -> tuple[dict[str, np.ndarray], bool]:
        """Caps from the rows that can reach a bound, and whether no cap lies under it.

        A first pass counts the draws in coarse cells of all weights. Then draws are counted in
        the cells of each bracket; the cell with the wanted rank, from its least to its largest
        weight, is the next bracket. Only weights in a bracket need more than a comparison. Rows
        that are left out are under the bound and so under every bracket.
        """
        low, high, target, share, outside = {}, {}, {}, {}, {}
        cells, bounds_of_p = self.CELLS, self.clip
        for group, m in moments.items():
            position = self.cap * np.maximum(m[:, 0] - 1.0, 0.0)
            target[group] = np.floor(position)[:, None] + np.array([1.0, 2.0])
            target[group] = np.minimum(target[group], np.maximum(m[:, :1], 1.0))
            share[group] = position - np.floor(position)
        size = 2.0 / min(self.clip[0], 1.0 - self.clip[1]) / cells

        def weights_of(group, data):
            z, treated, coefficients = _towards(data), data[:, -2][:, None] == 1, beta[group]
            return lambda part: _capped_weights(z @ coefficients[part].T, treated, bounds_of_p)

        def coarse(group, data):
            weights = weights_of(group, data)

            def sums(draws, part):
                w = weights(part)
                cell = np.minimum((w / size).astype(int), cells - 1) + np.arange(w.shape[1]) * cells
                return np.bincount(cell.ravel(), draws.ravel(), w.shape[1] * cells).reshape(-1, cells)

            return sums

        for group, counts in self._pass(coarse, cells, df=rows).items():
            outside[group] = moments[group][:, 0] - counts.sum(axis=1) if group in bounds else np.zeros(len(counts))
            upto = outside[group][:, None] + np.cumsum(counts, axis=1)
            hit = np.column_stack([np.argmax(upto >= target[group][:, side : side + 1], axis=1) for side in (0, 1)])
            # a little wider than the cell, so that rounding puts no weight outside
            low[group], high[group] = (hit - 1e-6) * size, (hit + 1 + 1e-6) * size
        if any(g not in outside or (outside[g] >= target[g][:, 0]).any() for g in bounds):
            return {}, False
        for _ in range(self.NARROWINGS):
            lo, hi = dict(low), dict(high)

            def block(group, data):
                weights = weights_of(group, data)

                def sums(draws, part):
                    w, starts, stops = weights(part), lo[group][part], hi[group][part]
                    reps = w.shape[1]
                    least, most = starts.min(axis=1), stops.max(axis=1)
                    under = w < least
                    row, rep = np.nonzero(~under & (w <= most) & (draws > 0))
                    value, drawn = w[row, rep], draws[row, rep]
                    before, total = np.einsum("ij,ij->j", draws, under), draws.sum(axis=0)
                    counts, ends = [], []
                    for side in (0, 1):
                        start, stop = starts[rep, side], stops[rep, side]
                        width = np.where(stop > start, stop - start, 1.0)
                        cell = np.clip(np.floor((value - start) / width * cells), 0, cells - 1).astype(int)
                        # of two ends that a cell can't tell apart, the upper one is in the last cell
                        cell = np.where((value >= stop) & (stop > start), cells - 1, cell)
                        inside = (value >= start) & (value <= stop)
                        flat = (rep * cells + cell)[inside]
                        found = np.bincount(flat, drawn[inside], reps * cells).reshape(reps, cells)
                        below = before + np.bincount(rep, drawn * (value < start), reps)
                        counts += [below, found, total - below - found.sum(axis=1)]
                        for sign in (-1.0, 1.0):
                            end = np.full(reps * cells, -np.inf)
                            np.maximum.at(end, flat, sign * value[inside])
                            ends.append(end.reshape(reps, cells))
                    return np.column_stack([*counts, *ends])

                return sums

            width = cells + 2
            for group, sums in self._pass(block, 2 * width + 4 * cells, largest=4 * cells, df=rows).items():
                reps = np.arange(len(sums))
                for side in (0, 1):
                    counts = outside[group][:, None] + np.cumsum(sums[:, side * width : (side + 1) * width], axis=1)
                    hit = np.clip(np.argmax(counts >= target[group][:, side : side + 1], axis=1) - 1, 0, cells - 1)
                    at = 2 * width + 2 * side * cells
                    least, most = -sums[reps, at + hit], sums[reps, at + cells + hit]
                    found = np.isfinite(least)  # not so where a replicate drew no row
                    low[group][:, side] = np.where(found, least, 0.0)
                    high[group][:, side] = np.where(found, most, 0.0)
            if all((low[g] == high[g]).all() for g in low):
                break
        caps = {g: low[g][:, 0] + (low[g][:, 1] - low[g][:, 0]) * share[g] for g in moments}
        return caps, all((low[g][:, 0] >= bound * (1.0 + 1e-9)).all() for g, bound in bounds.items())

    def effects(self) -> pd.DataFrame:
        """group, replicate, n_treated, n_control, effect; replicate 0 is the sample itself."""
        alone, inputs = np.array([0]), 2 + 2 * len(self.covariates)
        sample = self._fit(self._moments(alone), None, alone)
        self.sample_fit = {group: beta[0] for group, beta in sample.items()}
        sums = self._moments(start=sample)
        moments = {group: m[:, :inputs] for group, m in sums.items()}
        first = {group: m[:, inputs:] for group, m in sums.items()}
        beta = self._fit(moments, sample, np.arange(self.replicates + 1), first)
        caps, bounds = self._caps(moments, beta), self.clip

        def block(group, data):
            z, t, y = _towards(data), data[:, -2][:, None] == 1, data[:, -1:]
            columns = np.column_stack([t, t * y, ~t, ~t * y])

            def sums(draws, part):
                w = _capped_weights(z @ beta[group][part].T, t, bounds)
                np.minimum(w, caps[group][part], out=w)
                w *= draws
                return (columns.T @ w).T

            return sums

        frames = []
        for group, s in self._pass(block, 4).items():
            n, n_treated = moments[group][:, 0], moments[group][:, 1]
            with np.errstate(invalid="ignore", divide="ignore"):
                effect = s[:, 1] / s[:, 0] - s[:, 3] / s[:, 2]
            frames.append(
                pd.DataFrame(
                    {
                        self.group: group,
                        "replicate": np.arange(len(n)),
                        "n_treated": n_treated.astype("int64"),
                        "n_control": (n - n_treated).astype("int64"),
                        "effect": effect,
                    }
                )
            )
        return pd.concat(frames, ignore_index=True)
