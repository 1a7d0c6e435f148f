"""Linear models from cross-product sums gathered in one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.tails import gamma_sf, t_two_sided


@dataclass(frozen=True)
class Scale:
    """Column means and population deviations; a constant column scales by one."""

    columns: tuple[str, ...]
    mean: np.ndarray
    sd: np.ndarray

    @classmethod
    def of(cls, df: DataFrame, columns: Sequence[str]) -> Scale:
        row = df.agg(
            *[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]
        ).first()
        mean = np.array([row[f"m_{c}"] or 0.0 for c in columns])
        sd = np.array([row[f"s_{c}"] or 0.0 for c in columns])
        return cls(tuple(columns), mean, np.where(sd > 1e-12 * np.maximum(1.0, np.abs(mean)), sd, 1.0))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (F.col(c) - float(m)) / float(s) for c, m, s in zip(self.columns, self.mean, self.sd)}
        )


def cross_products(df: DataFrame, columns: Sequence[str], by: str) -> dict[object, np.ndarray]:
    """Sums of products of every two of (1, *columns), per value of ``by``.

    Each task reduces its rows to one small matrix per value; only those are
    shuffled and added up. ``by`` is a fold or arm number, so the result is a
    handful of matrices.
    """
    names, width = list(columns), len(columns) + 1

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            for key, rows in batch.groupby(by):
                z = np.column_stack([np.ones(len(rows)), rows[names].to_numpy(float)])
                sums[key] = sums.get(key, 0) + z.T @ z
        yield pd.DataFrame({by: list(sums), "products": [m.ravel() for m in sums.values()]})

    schema = f"{by} {df.schema[by].dataType.simpleString()}, products ARRAY<DOUBLE>"
    parts = df.select(by, *[F.col(c).cast("double").alias(c) for c in names]).mapInPandas(partial, schema)
    totals = parts.groupBy(by).agg(
        F.array(*[F.sum(F.col("products")[i]) for i in range(width * width)]).alias("products")
    )
    return {row[by]: np.array(row["products"]).reshape(width, width) for row in totals.collect()}


def _ridge(m: np.ndarray, alpha: float) -> np.ndarray:
    """Intercept and slopes from products of (1, X, y); the intercept is free."""
    n, d = m[0, 0], m.shape[0] - 2
    x, xy = m[0, 1 : d + 1] / n, m[0, -1] / n
    covariance = m[1 : d + 1, 1 : d + 1] - n * np.outer(x, x)
    slopes = np.linalg.lstsq(covariance + alpha * np.eye(d), m[1 : d + 1, -1] - n * x * xy, rcond=None)[0]
    return np.concatenate([[xy - x @ slopes], slopes])


def _squares(m: np.ndarray, fit: np.ndarray) -> tuple[float, float]:
    """Residual and total sums of squares of a fit on the rows behind ``m``."""
    v = np.concatenate([-fit, [1.0]])
    return float(v @ m @ v), float(m[-1, -1] - m[0, -1] ** 2 / m[0, 0])


@dataclass(frozen=True)
class RidgeFit:
    scale: Scale
    coefficients: np.ndarray
    alpha: float
    fold_scores: dict[float, float]

    def predict(self) -> Column:
        """The fitted value as a column expression over the raw inputs."""
        slopes = self.coefficients[1:] / self.scale.sd
        constant = float(self.coefficients[0] - slopes @ self.scale.mean)
        return sum((F.col(c) * float(b) for c, b in zip(self.scale.columns, slopes)), F.lit(constant))


def ridge_by_folds(
    df: DataFrame, columns: Sequence[str], target: str, fold: str, alphas: Sequence[float]
) -> RidgeFit:
    """Standardised ridge whose penalty has the best mean held-out R squared.

    All folds and penalties are scored from the same per-fold sums: the data
    is read twice, once for the scale and once for the sums.
    """
    scale = Scale.of(df, columns)
    folds = cross_products(scale.apply(df), [*columns, target], fold)
    whole = sum(folds.values())
    scores = {}
    for alpha in alphas:
        held_out = []
        for m in folds.values():
            residual, total = _squares(m, _ridge(whole - m, alpha))
            held_out.append(1.0 - residual / total if total > 0 else 0.0)
        scores[alpha] = float(np.mean(held_out))
    best = max(alphas, key=lambda a: scores[a])
    return RidgeFit(scale, _ridge(whole, best), best, scores)


@dataclass(frozen=True)
class OlsFit:
    columns: tuple[str, ...]
    coefficients: np.ndarray
    standard_errors: np.ndarray
    p_values: np.ndarray
    r_squared: float
    adjusted_r_squared: float

    def predict(self) -> Column:
        slopes = zip(self.columns, self.coefficients[1:])
        return sum((F.col(c) * float(b) for c, b in slopes), F.lit(float(self.coefficients[0])))


def ordinary_least_squares(df: DataFrame, columns: Sequence[str], target: str) -> OlsFit:
    """Least squares with classical standard errors; redundant inputs share their weight."""
    scale = Scale.of(df, columns)
    one = scale.apply(df).withColumn("_all", F.lit(0))
    m = cross_products(one, [*columns, target], "_all")[0]
    n, design = m[0, 0], m[:-1, :-1]
    inverse = np.linalg.pinv(design, hermitian=True)
    fit = inverse @ m[:-1, -1]
    residual, total = _squares(m, fit)
    freedom = n - np.linalg.matrix_rank(design, hermitian=True)
    # back to raw units: slope / sd, intercept less the means
    to_raw = np.eye(len(fit))
    to_raw[1:, 1:] = np.diag(1.0 / scale.sd)
    to_raw[0, 1:] = -scale.mean / scale.sd
    raw = to_raw @ fit
    errors = np.sqrt(np.maximum(np.diag(to_raw @ inverse @ to_raw.T), 0.0) * residual / freedom)
    p = [t_two_sided(b / e, freedom) if e > 0 else float("nan") for b, e in zip(raw, errors)]
    r2 = 1.0 - residual / total
    return OlsFit(
        tuple(columns), raw, errors, np.array(p), r2, 1.0 - (1.0 - r2) * (n - 1) / freedom
    )


def breusch_pagan(df: DataFrame, fit: OlsFit, target: str) -> tuple[float, float]:
    """Lagrange multiplier and p of squared residuals regressed on the inputs."""
    squared = df.withColumn("_squared", F.pow(F.col(target) - fit.predict(), 2))
    helper = ordinary_least_squares(squared, fit.columns, "_squared")
    n = df.count()
    lm = n * helper.r_squared
    return lm, gamma_sf(lm / 2, len(fit.columns) / 2)
