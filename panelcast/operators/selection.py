"""Feature filters.  Their results are as long as the feature list, never as the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.feature import VectorAssembler, VectorSlicer
from pyspark.ml.regression import (
    LinearRegressionModel,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.errors import mape

CORRELATION_LIMIT = 0.70  # fixed value
VECTOR = "_x"


def spread_of_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Range (max - min) of every feature from one pass, one row per feature."""
    wide = df.selectExpr(*[f"double(max(`{c}`) - min(`{c}`)) AS `{c}`" for c in features])
    return wide.unpivot([], features, "feature", "spread")


def varying(df: DataFrame, features: list[str]) -> list[str]:
    """Features that are not constant, in the given order."""
    spread = df.selectExpr(*[f"max(`{c}`) > min(`{c}`) AS `{c}`" for c in features]).first()
    return [c for c in features if spread[c]]


def correlation_matrix(df: DataFrame, features: list[str]) -> np.ndarray:
    """Pearson matrix; the Gram matrix is summed on the executors."""
    assembled = VectorAssembler(inputCols=features, outputCol=VECTOR).transform(
        df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in features])
    )
    return Correlation.corr(assembled.select(VECTOR), VECTOR).first()[0].toArray()


def correlation_table(spark: SparkSession, features: list[str], matrix: np.ndarray) -> DataFrame:
    """The matrix in long form, feature pairs as rows."""
    rows = [
        (a, b, float(matrix[i, j])) for i, a in enumerate(features) for j, b in enumerate(features)
    ]
    return spark.createDataFrame(rows, "feature_a string, feature_b string, correlation double")


def uncorrelated(
    features: list[str], matrix: np.ndarray, limit: float = CORRELATION_LIMIT
) -> list[str]:
    """Features that no earlier feature, kept or not, correlates with above the limit."""
    above = np.triu(np.abs(matrix) > limit, k=1).any(axis=0)
    return [c for c, drop in zip(features, above) if not drop]


def assemble(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Kept columns and one feature vector, which is all a fit has to read."""
    columns = [F.col(f"`{c}`").cast("double").alias(c) for c in features]
    extra = [c for c in keep if c not in features]
    vectors = VectorAssembler(inputCols=features, outputCol=VECTOR).transform(df.select(*extra, *columns))
    return vectors.select(*extra, VECTOR)


@dataclass(frozen=True)
class SelectionSettings:
    correlation_limit: float = CORRELATION_LIMIT
    trees: int = 100
    depth: int = 8
    step: int = 5
    folds: int = 2
    at_least: int = 10
    at_most: int = 20
    seed: int = 42
    bootstrap: bool = True


def _forest(vector: str, label: str, settings: SelectionSettings) -> RandomForestRegressor:
    return RandomForestRegressor(
        featuresCol=vector,
        labelCol=label,
        numTrees=settings.trees,
        maxDepth=settings.depth,
        seed=settings.seed,
        bootstrap=settings.bootstrap,
    )


def importances(
    df: DataFrame, features: list[str], label: str, settings: SelectionSettings
) -> list[tuple[str, float]]:
    """Random-forest importances, largest first, names deciding ties."""
    model = _forest(VECTOR, label, settings).fit(assemble(df, features, [label]))
    pairs = zip(features, (float(v) for v in model.featureImportances.toArray()))
    return sorted(pairs, key=lambda p: (-p[1], p[0]))


def linear_importances(model: LinearRegressionModel, features: list[str]) -> list[tuple[str, float]]:
    """Absolute coefficients of a linear model, largest first."""
    pairs = zip(features, (abs(float(v)) for v in model.coefficients.toArray()))
    return sorted(pairs, key=lambda p: (-p[1], p[0]))


def importance_table(spark: SparkSession, ranked: list[tuple[str, float]]) -> DataFrame:
    rows = [(i + 1, name, value) for i, (name, value) in enumerate(ranked)]
    return spark.createDataFrame(rows, "place int, feature string, importance double")


def eliminate(
    folded: DataFrame,
    features: list[str],
    label: str,
    settings: SelectionSettings,
    fold_range: range,
) -> list[str]:
    """Recursive elimination: drop the least important features while folds are scored.

    ``folded`` holds the training rows with ``fold`` and ``role``.  Every candidate
    size is scored by the MAPE of a forest over the test blocks; the size with the
    best mean score wins, and its features are those left when the elimination, run
    on all rows, has come down to that size.  The vectors are assembled and cached
    once; the descents are independent and share the cluster.
    """
    sizes = [len(features)]
    while sizes[-1] > settings.at_least:
        sizes.append(max(settings.at_least, sizes[-1] - settings.step))
    if len(sizes) == 1:
        return features
    vectors = assemble(folded, features, [label, "fold", "role"]).persist()

    def scored(f: int) -> list[float]:
        rows = vectors.where(F.col("fold") == f)
        test = rows.where(F.col("role") == "test")
        out = []
        for kept, model in _descend(rows.where(F.col("role") == "train"), features, sizes, label, settings):
            predicted = model.transform(_sliced(test, features, kept))
            out.append(predicted.agg(mape(F.col(label), F.col("prediction")).alias("m")).first()["m"])
        return out

    def descended() -> list[list[str]]:
        whole = vectors.where(F.col("fold") == fold_range[-1])
        return [kept for kept, _ in _descend(whole, features, sizes, label, settings)]

    try:
        with ThreadPoolExecutor(len(fold_range) + 1) as pool:
            path = pool.submit(descended)
            scores = list(pool.map(scored, fold_range))
            sets = path.result()
    finally:
        vectors.unpersist()
    means = [sum(s[i] for s in scores) / len(scores) for i in range(len(sizes))]
    best = min(range(len(sizes)), key=lambda i: (means[i], sizes[i]))
    return sets[best]


_SLICE = "_x_kept"


def _sliced(df: DataFrame, features: list[str], kept: list[str]) -> DataFrame:
    place = {c: i for i, c in enumerate(features)}
    slicer = VectorSlicer(inputCol=VECTOR, outputCol=_SLICE, indices=[place[c] for c in kept])
    return slicer.transform(df)


def _descend(
    df: DataFrame, features: list[str], sizes: list[int], label: str, settings: SelectionSettings
) -> Iterator[tuple[list[str], RandomForestRegressionModel]]:
    """Feature sets of falling size with a forest fitted on each."""
    kept = features
    for smaller in [*sizes[1:], None]:
        model = _forest(_SLICE, label, settings).fit(_sliced(df, features, kept))
        yield kept, model
        if smaller is not None:
            weight = dict(zip(kept, model.featureImportances.toArray()))
            ranked = set(sorted(kept, key=lambda c: (-weight[c], c))[:smaller])
            kept = [c for c in kept if c in ranked]


@dataclass
class Selection:
    """Result of the filter chain: what is left after each stage, in order."""

    stages: list[tuple[str, list[str]]] = field(default_factory=list)
    ranking: list[tuple[str, float]] = field(default_factory=list)

    @property
    def features(self) -> list[str]:
        return self.stages[-1][1]

    def funnel(self, spark: SparkSession) -> DataFrame:
        rows = [(i, name, len(kept)) for i, (name, kept) in enumerate(self.stages)]
        return spark.createDataFrame(rows, "stage_no int, stage string, feature_count long")

    def dropped(self, spark: SparkSession) -> DataFrame:
        """Features each stage removed: stage table minus the table of the stage after."""
        rows = [(i, name, c) for i, (name, kept) in enumerate(self.stages) for c in kept]
        table = spark.createDataFrame(rows, "stage_no int, stage string, feature string")
        names = table.select((F.col("stage_no") - 1).alias("stage_no"), F.col("stage").alias("dropped_by"))
        after = table.select((F.col("stage_no") - 1).alias("stage_no"), "feature")
        return (
            table.select("stage_no", "feature")
            .join(names.distinct(), "stage_no")
            .join(after, ["stage_no", "feature"], "left_anti")
            .select("dropped_by", "feature")
        )


def exact_stages(df: DataFrame, features: list[str], limit: float = CORRELATION_LIMIT) -> Selection:
    """The two stages that need no model."""
    moving = varying(df, features)
    kept = uncorrelated(moving, correlation_matrix(df, moving), limit)
    return Selection([("original", features), ("variance", moving), ("correlation", kept)])


def select_features(
    train: DataFrame,
    features: list[str],
    label: str,
    with_folds: Callable[[DataFrame, int], DataFrame],
    settings: SelectionSettings = SelectionSettings(),
) -> Selection:
    """Constant, correlated, unimportant: the filter chain on training rows only."""
    out = exact_stages(train, features, settings.correlation_limit)
    narrow = train.select(*[c for c in train.columns if c not in features], *out.features)
    folded = with_folds(narrow, settings.folds)
    kept = eliminate(folded, out.features, label, settings, range(settings.folds))
    out.stages.append(("elimination", kept))
    if len(kept) > settings.at_most:
        ranked = importances(narrow, kept, label, settings)
        kept = [c for c, _ in ranked[: settings.at_most]]
        out.stages.append(("cap", kept))
    out.ranking = importances(narrow, kept, label, settings)
    return out
