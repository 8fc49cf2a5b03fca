"""Ridge regression on standardised features, one model per series, from moments.

Spark aggregates counts, means and covariances, either per group or over the rows
before each row; from them every penalty is solved without going back to the data.
Only the p × p solve runs in Python, on Arrow batches of packed moments.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.operators.windows import SeriesWindow

# Workers get the solver with the job and need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The penalties searched.
ALPHAS = (0.01, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0, 50.0, 100.0, 200.0, 500.0)


def _moment_columns(features: list[str], label: str, frame: str = "") -> list[str]:
    """Count, means and upper covariance triangle of features and label, as SQL.

    ``frame`` is an ``OVER`` clause, or empty for a plain aggregate.
    """
    x = [f"double(`{c}`)" for c in [*features, label]]
    means = ", ".join(f"avg({c}) {frame}" for c in x)
    pairs = ", ".join(
        f"covar_pop({x[i]}, {x[j]}) {frame}" for i in range(len(x)) for j in range(i, len(x))
    )
    return [f"count(*) {frame} AS _n", f"array({means}) AS _means", f"array({pairs}) AS _covs"]


def moments(df: DataFrame, features: list[str], label: str, groups: list[str]) -> DataFrame:
    """One row of moments per group."""
    parts = _moment_columns(features, label)
    return df.groupBy(*groups).agg(*[F.expr(p) for p in parts])


def with_moments_before(df: DataFrame, features: list[str], label: str, w: SeriesWindow) -> DataFrame:
    """Each row with the moments of all rows of its series before it."""
    return df.selectExpr("*", *_moment_columns(features, label, w.over("start", 1)))


def _solver(p: int):
    upper = np.triu_indices(p + 1)

    @F.pandas_udf("array<double>")
    def solve(n: pd.Series, means: pd.Series, covs: pd.Series, alpha: pd.Series) -> pd.Series:
        if len(n) == 0:
            return pd.Series([], dtype=object)
        m = np.array([np.asarray(v, dtype=float) for v in means])
        c = np.zeros((len(m), p + 1, p + 1))
        c[:, upper[0], upper[1]] = np.array([np.asarray(v, dtype=float) for v in covs])
        c[:, upper[1], upper[0]] = c[:, upper[0], upper[1]]
        rows, a = n.to_numpy(dtype=float), alpha.to_numpy(dtype=float)

        sd = np.sqrt(np.maximum(np.diagonal(c, axis1=1, axis2=2)[:, :p], 0.0))
        flat = sd <= 1e-12 * np.maximum(np.abs(m[:, :p]), 1.0)
        scale = np.where(flat, 1.0, sd)
        gram = rows[:, None, None] * c[:, :p, :p] / (scale[:, :, None] * scale[:, None, :])
        moment = rows[:, None] * c[:, :p, p] / scale
        gram[flat] = 0.0
        moment[flat] = 0.0
        system = gram + a[:, None, None] * np.eye(p)
        if (a > 0).all():
            beta = np.linalg.solve(system, moment[:, :, None])[:, :, 0]
        else:
            beta = np.einsum("bij,bj->bi", np.linalg.pinv(system, hermitian=True), moment)
        beta = beta / scale
        intercept = m[:, p] - (beta * m[:, :p]).sum(axis=1)
        return pd.Series(list(np.column_stack([intercept, beta])))

    return solve


def with_coefficients(df: DataFrame, p: int) -> DataFrame:
    """Solve rows that carry ``_n``, ``_means``, ``_covs`` and ``alpha``.

    ``coefficients`` holds the intercept and then one slope per feature.
    """
    return df.withColumn("coefficients", _solver(p)("_n", "_means", "_covs", "alpha")).drop(
        "_n", "_means", "_covs"
    )


def fit(df: DataFrame, features: list[str], label: str, groups: list[str], alphas: list[float]) -> DataFrame:
    """Coefficients per group and penalty, from one aggregation."""
    each = F.explode(F.array(*[F.lit(float(a)) for a in alphas]))
    return with_coefficients(moments(df, features, label, groups).withColumn("alpha", each), len(features))


def linear(features: list[str], coefficients: str = "coefficients") -> Column:
    """Prediction of a row that carries its coefficients."""
    terms = [f"{coefficients}[{i + 1}] * double(`{c}`)" for i, c in enumerate(features)]
    return F.expr(" + ".join([f"{coefficients}[0]", *terms]))
