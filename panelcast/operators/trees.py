"""Candidates for one pooled model over all series of a panel."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.base import Estimator, Model
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.operators.ridge import ALPHAS
from panelcast.operators.selection import VECTOR


@dataclass(frozen=True)
class Candidate:
    """An estimator by name, its fixed settings and the points of its search."""

    name: str
    kind: type[Estimator]
    settings: dict = field(default_factory=dict)
    grid: tuple[dict, ...] = ({},)

    def estimator(self, label: str, point: dict | None = None, **more) -> Estimator:
        return self.kind(featuresCol=VECTOR, labelCol=label, **(self.settings | (point or {}) | more))

    def fit(self, vectors: DataFrame, label: str, point: dict | None = None, **more) -> Model:
        return self.estimator(label, point, **more).fit(vectors)


class RidgeCandidate(Candidate):
    """Ridge with the penalty ``alpha`` on the scale of the per-series ridge.

    MLlib divides the loss by the number of rows and scales the label, so its penalty is
    alpha / n * deviation of the label; only the normal solver is exact.
    """

    def fit(self, vectors: DataFrame, label: str, point: dict | None = None, **more) -> Model:
        rest = dict(point or {})
        alpha = rest.pop("alpha")
        size = vectors.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(label).alias("sd")).first()
        return self.estimator(label, rest, regParam=alpha / size["n"] * size["sd"], **more).fit(vectors)


def _points(**lists) -> tuple[dict, ...]:
    out: list[dict] = [{}]
    for name, values in lists.items():
        out = [p | {name: v} for p in out for v in values]
    return tuple(out)


def ridge_candidate(alphas: tuple[float, ...] = tuple(ALPHAS)) -> RidgeCandidate:
    settings = {"solver": "normal", "elasticNetParam": 0.0}
    return RidgeCandidate("ridge", LinearRegression, settings, _points(alpha=list(alphas)))


def candidates(seed: int = 42, forest_trees: int = 500, grids: dict[str, tuple[dict, ...]] | None = None) -> dict[str, Candidate]:
    """The candidates, each with every point of its usual grid that MLlib can express.

    MLlib has no counterpart for the minimum split size, the leaf-count cap, the split
    criterion, the huber loss or an L2 penalty on leaves; its trees are always histogram
    based and at most 30 deep.  Extra trees are approximated by a forest without
    resampling.  ``grids`` replaces the points of the candidates it names.
    """
    forest = {"numTrees": forest_trees, "seed": seed}
    known = [
        ridge_candidate(),
        Candidate(
            "random_forest",
            RandomForestRegressor,
            forest,
            _points(
                maxDepth=[5, 8, 12, 15, 20, 30],
                minInstancesPerNode=[1, 2, 4, 8],
                featureSubsetStrategy=["sqrt", "log2", "0.5", "0.8", "all"],
            ),
        ),
        Candidate(
            "extra_trees",
            RandomForestRegressor,
            forest | {"bootstrap": False, "subsamplingRate": 1.0, "minInstancesPerNode": 2},
            _points(maxDepth=[15, 20], featureSubsetStrategy=["0.5", "sqrt"]),
        ),
        Candidate(
            "gradient_boosting",
            GBTRegressor,
            {"seed": seed},
            _points(
                maxIter=[200, 400, 600, 800, 1000, 1500],
                stepSize=[0.01, 0.02, 0.05, 0.1],
                maxDepth=[2, 3, 4, 5],
                subsamplingRate=[0.6, 0.7, 0.8, 0.9, 1.0],
                minInstancesPerNode=[1, 2, 4, 8],
                featureSubsetStrategy=["all", "sqrt", "log2", "0.8"],
                lossType=["squared", "absolute"],
                minWeightFractionPerNode=[0.0, 0.05],
            ),
        ),
        Candidate(
            "hist_gradient_boosting",
            GBTRegressor,
            {"seed": seed, "maxBins": 255},
            _points(stepSize=[0.01, 0.02, 0.05, 0.1, 0.2], maxIter=[100, 200, 400, 600], maxDepth=[3, 5, 8, 10, 30]),
        ),
        Candidate("linear", LinearRegression, {"regParam": 0.0, "solver": "normal"}),
    ]
    out = {c.name: c for c in known}
    for name, grid in (grids or {}).items():
        old = out[name]
        out[name] = type(old)(name, old.kind, old.settings, grid)
    return out
