"""Choosing a model: baselines, ridge per series, pooled MLlib candidates."""

from __future__ import annotations

import datetime as dt
import random
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.calendar import DAY, MONTH, Grain
from panelcast.functions.errors import mape
from panelcast.functions.numeric import to_log
from panelcast.operators import baselines, ridge
from panelcast.operators.ranking import leaderboard
from panelcast.operators.scoring import score
from panelcast.operators.selection import (
    VECTOR,
    Selection,
    SelectionSettings,
    assemble,
    select_features,
)
from panelcast.operators.splits import with_folds
from panelcast.operators.trees import Candidate, ridge_candidate


# --- ridge, one model per series ------------------------------------------------


def ridge_cv(
    train: DataFrame,
    features: list[str],
    label: str,
    period: str,
    series_keys: list[str],
    alphas: Sequence[float] = ridge.ALPHAS,
    n_splits: int = 4,
) -> DataFrame:
    """MAPE of every penalty per series, averaged over expanding folds.

    One aggregation gives the moments of all folds; all penalties are solved from them.
    Test rows meet their fold's models in an equi-join on series and fold.
    """
    groups = [*series_keys, "fold"]
    folded = with_folds(train.select(*series_keys, period, *features, label), period, n_splits)
    models = ridge.fit(folded.where(F.col("role") == "train"), features, label, groups, list(alphas))
    tested = folded.where(F.col("role") == "test").join(models, groups, "inner")
    scored = tested.withColumn("y_pred", ridge.linear(features))
    per_fold = scored.groupBy(*groups, "alpha").agg(mape(F.col(label), F.col("y_pred")).alias("mape"))
    return per_fold.groupBy(*series_keys, "alpha").agg(F.avg("mape").alias("cv_mape"))


def best_alpha(cv: DataFrame, series_keys: list[str]) -> DataFrame:
    """Penalty with the lowest score per series; the smaller of equals."""
    best = F.min(F.struct(F.col("cv_mape"), F.col("alpha"))).alias("best")
    return cv.groupBy(*series_keys).agg(best).select(*series_keys, "best.alpha", "best.cv_mape")


def with_series_value(df: DataFrame, values: DataFrame, series_keys: list[str]) -> DataFrame:
    """Attach a per-series table (one row per series, one row in all without series)."""
    if series_keys:
        return df.join(values, series_keys, "inner")
    row = values.first()  # a handful of numbers, as any fitted model keeps on the driver
    if row is None:
        raise ValueError("nothing to fit on")
    kinds = {f.name: f.dataType for f in values.schema.fields}
    return df.withColumns({c: F.lit(row[c]).cast(kinds[c]) for c in values.columns})


def ridge_fit(
    df: DataFrame, features: list[str], label: str, series_keys: list[str], alpha: DataFrame | float
) -> DataFrame:
    """Coefficients per series at one penalty, or at the penalty chosen for each series."""
    if not isinstance(alpha, DataFrame):
        return ridge.fit(df, features, label, series_keys, [alpha])
    stats = ridge.moments(df, features, label, series_keys)
    chosen = with_series_value(stats, alpha.select(*series_keys, "alpha"), series_keys)
    return ridge.with_coefficients(chosen, len(features))


def ridge_predict(df: DataFrame, models: DataFrame, features: list[str], series_keys: list[str]) -> DataFrame:
    fitted = models.select(*series_keys, "coefficients")
    return with_series_value(df, fitted, series_keys).withColumn("y_pred", ridge.linear(features)).drop(
        "coefficients"
    )


# --- pooled MLlib models ----------------------------------------------------------


@dataclass(frozen=True)
class Tuned:
    name: str
    point: dict
    cv_mape: float


def fit_pipeline(
    df: DataFrame, candidate: Candidate, features: list[str], label: str, point: dict | None = None, log_target: bool = False
) -> PipelineModel:
    """Assembler and fitted model in one, so that a saved model takes plain columns.

    With ``log_target`` the model learns log(1 + label), and a last step brings its
    predictions back to the scale of the label.
    """
    assembler = VectorAssembler(inputCols=features, outputCol=VECTOR)
    target = F.col(label).cast("double")
    rows = assembler.transform(df.withColumn(_TARGET, to_log(target) if log_target else target)).select(VECTOR, _TARGET)
    if not log_target:
        return PipelineModel([assembler, candidate.fit(rows, _TARGET, point)])
    model = candidate.fit(rows, _TARGET, point, predictionCol=_LOGGED)
    back = SQLTransformer(statement=f"SELECT *, expm1({_LOGGED}) AS prediction FROM __THIS__")
    return PipelineModel([assembler, model, back])


_TARGET, _LOGGED = "_target", "_logged_prediction"


def pooled_ridge(df: DataFrame, features: list[str], label: str, alpha: float) -> PipelineModel:
    """One ridge over all rows by MLlib."""
    return fit_pipeline(df, ridge_candidate(), features, label, {"alpha": alpha})


def search(
    train: DataFrame,
    features: list[str],
    label: str,
    period: str,
    wanted: list[str],
    known: dict[str, Candidate],
    n_splits: int = 4,
    parallel: int = 4,
) -> list[Tuned]:
    """Grid search over expanding folds: every point of every wanted candidate.

    A caller that wants fewer points gives candidates of smaller grids.  The assembled
    folds are cached once; independent fits are submitted from a thread pool and share
    the cluster.
    """
    jobs = [(known[n], p) for n in _known(wanted, known) for p in known[n].grid]
    with _folded(train, features, label, period, n_splits) as folded:
        means = _fold_means(folded, jobs, label, n_splits, parallel)
    best: dict[str, Tuned] = {}
    for (candidate, point), m in zip(jobs, means):
        if candidate.name not in best or m < best[candidate.name].cv_mape:
            best[candidate.name] = Tuned(candidate.name, point, m)
    return list(best.values())


def _known(wanted: list[str], known: dict[str, Candidate]) -> list[str]:
    strange = [n for n in wanted if n not in known]
    if strange:
        raise ValueError(f"unknown candidates: {strange}")
    return wanted


@contextmanager
def _folded(train: DataFrame, features: list[str], label: str, period: str, n_splits: int) -> Iterator[DataFrame]:
    """The assembled folds, cached while they are used."""
    folded = assemble(with_folds(train, period, n_splits), features, [label, "fold", "role"]).persist()
    try:
        yield folded
    finally:
        folded.unpersist()


def _fold_means(folded: DataFrame, jobs: list[tuple[Candidate, dict]], label: str, n_splits: int, parallel: int) -> list[float]:
    """Mean error over the folds of every candidate and point; the fits share the cluster."""

    def one_fold(candidate: Candidate, point: dict, fold: int) -> float:
        rows = folded.where(F.col("fold") == fold)
        model = candidate.fit(rows.where(F.col("role") == "train"), label, point)
        scored = model.transform(rows.where(F.col("role") == "test"))
        return scored.agg(mape(F.col(label), F.col("prediction")).alias("m")).first()["m"]

    with ThreadPoolExecutor(parallel) as pool:
        scores = [[pool.submit(one_fold, c, p, f) for f in range(n_splits)] for c, p in jobs]
        return [sum(s.result() for s in per_job) / n_splits for per_job in scores]


@dataclass(frozen=True)
class Budget:
    """What a sampled search may spend.

    ``points`` of each candidate's grid are drawn with ``seed``; in each rung one of
    ``eta`` points survives, and what a fit may spend grows by ``eta``.  The last rung
    spends all of a point's trees or rounds, but no more than ``trees`` and ``rounds``; the
    points found carry these numbers, so that the model searched is the model fitted.
    """

    points: int = 27
    eta: int = 3
    trees: int = 500
    rounds: int = 1500
    seed: int = 42

    def sampled(self, candidate: Candidate) -> list[dict]:
        """Points of the grid in its order; all of a grid that is not larger, or whose fits have nothing to save."""
        if len(candidate.grid) <= self.points or self.spent(candidate, {}, 0) == {}:
            return list(candidate.grid)
        drawn = random.Random(f"{self.seed}:{candidate.name}").sample(range(len(candidate.grid)), self.points)
        return [candidate.grid[i] for i in sorted(drawn)]

    def spent(self, candidate: Candidate, point: dict, left: int) -> dict:
        """The point with what a fit may spend when ``left`` rungs are still to come."""
        name = {RandomForestRegressor: "numTrees", GBTRegressor: "maxIter"}.get(candidate.kind)
        if name is None:
            return point
        most = min((candidate.settings | point).get(name, 20), self.trees if name == "numTrees" else self.rounds)
        return point | {name: max(1, -(-most // self.eta**left))}


def rungs_of(count: int, eta: int) -> list[int]:
    """How many points each rung compares, down to one."""
    out = [count]
    while out[-1] > 1:
        out.append(-(-out[-1] // eta))
    return out


def halving_search(
    train: DataFrame,
    features: list[str],
    label: str,
    period: str,
    wanted: list[str],
    known: dict[str, Candidate],
    n_splits: int = 4,
    parallel: int = 4,
    budget: Budget = Budget(),
) -> list[Tuned]:
    """Sampled search by successive halving: the best point found of every wanted candidate.

    All candidates pass a rung together, so that their fits share the cluster.  A candidate
    that has nothing to save (the ridge) is compared in full at once.
    """
    left = {n: [(i, p) for i, p in enumerate(budget.sampled(known[n]))] for n in _known(wanted, known)}
    plans = {}
    for n, points in left.items():
        cheap = budget.spent(known[n], {}, 0) == {}
        plans[n] = [len(points)] if cheap else rungs_of(len(points), budget.eta)
    best: dict[str, Tuned] = {}
    with _folded(train, features, label, period, n_splits) as folded:
        for rung in range(max(len(p) for p in plans.values())):
            turn = [(n, i, budget.spent(known[n], p, len(plans[n]) - 1 - rung)) for n in left if rung < len(plans[n]) for i, p in left[n]]
            means = _fold_means(folded, [(known[n], p) for n, _, p in turn], label, n_splits, parallel)
            for n in {n for n, _, _ in turn}:
                ranked = sorted(((m, i, p) for (name, i, p), m in zip(turn, means) if name == n), key=lambda r: r[:2])
                best[n] = Tuned(n, ranked[0][2], ranked[0][0])
                kept = {i for _, i, _ in ranked[: plans[n][rung + 1]]} if rung + 1 < len(plans[n]) else set()
                left[n] = [(i, p) for i, p in left[n] if i in kept]
    return [best[n] for n in wanted]


def fit_tuned(
    df: DataFrame, tuned: Tuned, known: dict[str, Candidate], features: list[str], label: str, log_target: bool = False
) -> PipelineModel:
    return fit_pipeline(df, known[tuned.name], features, label, tuned.point, log_target)


def baseline_forecasts(rows: DataFrame, label: str, grain: Grain, series_keys: list[str], name: str) -> DataFrame:
    """A baseline over the targets of a supervised set, in the long form of the scoring functions."""
    table = rows.select(*series_keys, F.col("target_period").alias(grain.period), F.col(label).alias(grain.revenue))
    if name == "naive_last":
        return baselines.naive_last(table, grain, series_keys)
    season = int(name.removeprefix("seasonal_naive_"))
    return baselines.seasonal_naive(table, grain, series_keys, season).withColumn("model", F.lit(name))


def pooled_forecasts(model: PipelineModel, df: DataFrame, name: str, label: str, series_keys: list[str]) -> DataFrame:
    """Forecasts of a fitted pipeline in the long form of the scoring functions."""
    return model.transform(df).select(
        *series_keys,
        F.lit(name).alias("model"),
        F.col("target_period").alias("period"),
        F.col(label).alias("y_true"),
        F.col("prediction").alias("y_pred"),
    )


def leaderboard_with_params(scores: DataFrame, tuned: list[Tuned]) -> DataFrame:
    """Attach the chosen settings to the score rows, as text."""
    if not tuned:
        return scores.withColumn("best_params", F.lit(None).cast("string"))
    settings = F.create_map(
        *[F.lit(x) for t in tuned for x in (t.name, str(sorted(t.point.items())))]
    )
    return scores.withColumn("best_params", settings[F.col("model")])


# --- the whole choice ---------------------------------------------------------------


@dataclass
class TuningResult:
    """What a tuning run hands on: the refitted model, its features, and how it was chosen."""

    model: PipelineModel
    winner: Tuned
    features: list[str]
    selection: Selection
    leaderboard: DataFrame
    cutoff: dt.date

    def metadata(self, spark: SparkSession) -> DataFrame:
        row = (
            self.winner.name,
            str(sorted(self.winner.point.items())),
            self.winner.cv_mape,
            self.features,
            str(self.cutoff),
        )
        schema = "best_model string, best_point string, cv_mape double, feature_names array<string>, trained_to string"
        return spark.createDataFrame([row], schema)


def tune(
    rows: DataFrame,
    features: list[str],
    label: str,
    period: str,
    series_keys: list[str],
    train_end: dt.date,
    backtest_end: dt.date,
    wanted: list[str],
    known: dict[str, Candidate],
    settings: SelectionSettings = SelectionSettings(),
    n_splits: int = 4,
    log_target: bool = False,
    searched: Callable[..., list[Tuned]] = search,
) -> TuningResult:
    """Select features and settings on the training phase, report on the backtest, refit on both.

    ``rows`` is read several times and should be a staged or cached supervised set.  The
    winner is the candidate with the best score on the folds; the backtest is only
    reported, so that its errors stay honest.  The naive forecast, and other baselines
    that ``wanted`` names, stand in the leaderboard and never win.
    """
    grain = next(g for g in (MONTH, DAY) if g.period == period)
    names = list(dict.fromkeys(["naive_last", *(n for n in wanted if n.startswith("seasonal_naive_"))]))
    models = [n for n in wanted if n not in names]
    target = F.col("target_period")
    train = rows.where(target <= F.lit(train_end))
    test = rows.where((target > F.lit(train_end)) & (target <= F.lit(backtest_end)))
    chosen = select_features(train, features, label, lambda d, k: with_folds(d, period, k), settings)
    kept = chosen.features
    tuned = searched(train, kept, label, period, models, known, n_splits)
    if not tuned:
        raise ValueError("no candidate but baselines")
    parts = [
        pooled_forecasts(fit_tuned(train, t, known, kept, label, log_target), test, t.name, label, series_keys)
        for t in tuned
    ]
    scope = rows.where(target <= F.lit(backtest_end))
    past = [baseline_forecasts(scope, label, grain, series_keys, n) for n in names]
    parts += [p.where(F.col("period") > F.lit(train_end)) for p in past]
    columns = parts[0].columns
    forecasts = parts[0]
    for part in parts[1:]:
        forecasts = forecasts.unionByName(part.select(*columns))
    scores = leaderboard_with_params(score(forecasts, ["model"]), tuned)
    best = min(tuned, key=lambda t: (t.cv_mape, t.name))
    return TuningResult(
        model=fit_tuned(scope, best, known, kept, label, log_target),
        winner=best,
        features=kept,
        selection=chosen,
        leaderboard=leaderboard(scores, []),
        cutoff=backtest_end,
    )
