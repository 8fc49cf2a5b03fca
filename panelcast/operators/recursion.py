"""Step-by-step forecasts, in which each step's inputs hold the forecasts before it.

A series carries the state its next features need: of every metric the last values, as many
as the longest lag or window asks for, the moving averages, and the number of rows.  It is
read from the history once.  A step computes the features from the state, predicts, and
pushes the row into the state, all in SQL expressions on one row per series; so a step costs
the same however long the history is and however many steps came before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import Grain, calendar_features, month_cycle
from panelcast.functions.numeric import non_negative
from panelcast.operators import windows as W
from panelcast.session import cut_lineage

_WINDOWED = re.compile(r"(.+)_(lag|roll_mean|roll_std|roll_min|roll_max|ema)_(\d+)$")
_FORECAST = "_forecast"

Predict = Callable[[DataFrame], DataFrame]


def source_column(feature: str) -> str | None:
    """Metric a feature is derived from; None for calendar features."""
    windowed = _WINDOWED.match(feature)
    if windowed:
        return windowed[1]
    return feature.removesuffix("_pct_change") if feature.endswith("_pct_change") else None


class FeatureState:
    """State columns of a series and the expressions over them.

    ``_past_<metric>`` holds the values before the current row, the newest last,
    ``_ema_<metric>_<span>`` the moving average over them, ``_row`` their number.  The
    current row's metrics and period keep their names.
    """

    def __init__(self, features: list[str], cfg, grain: Grain, series_keys: list[str]):
        self.features, self.grain, self.keys = list(features), grain, list(series_keys)
        self.metrics = sorted({c for c in map(source_column, features) if c})
        self.depth = {c: 1 for c in self.metrics}
        self.spans: dict[str, set[int]] = {c: set() for c in self.metrics}
        for name in features:
            found = _WINDOWED.match(name)
            if found:
                metric, kind, n = found[1], found[2], int(found[3])
                self.depth[metric] = max(self.depth[metric], n if kind != "ema" else 1)
                if kind == "ema" and n > 1:
                    self.spans[metric].add(n)
            elif name.endswith("_pct_change"):
                self.depth[source_column(name)] = max(self.depth[source_column(name)], 2)
        self.averages = [f"{c}_ema_{n}" for c in self.metrics for n in sorted(self.spans[c])]
        spans = tuple(sorted({n for s in self.spans.values() for n in s}))
        self.cfg = replace(cfg, rolling_windows=spans or cfg.rolling_windows)

    def start(self, table: DataFrame) -> DataFrame:
        """One row per series: its newest row and the state before it."""
        from panelcast.plans.feature_frame import add_ratios, create_features

        period, keys = self.grain.period, self.keys
        metrics = [c for c in self.cfg.base_cols if c in table.columns]
        slim = table.select(*keys, period, *[F.col(c).cast("double").alias(c) for c in metrics])
        if self.averages:
            frame, _ = create_features(slim, self.cfg, self.grain, keys, self.averages)
        else:
            frame = slim
        have = [c for c in frame.columns if c in metrics or c in self.averages]
        frame, _ = add_ratios(frame.select(*keys, period, *have), self.cfg)
        back = f"row_number() OVER ({f'PARTITION BY {W._names(keys)} ' if keys else ''}ORDER BY `{period}` DESC) AS _back"
        deepest = max(self.depth.values(), default=1)
        row = ", ".join(f"`{c}`" for c in [period, *metrics, *self.metrics, *self.averages] if c in frame.columns)
        row = f"named_struct({', '.join(f"'{c}', `{c}`" for c in dict.fromkeys(x.strip('`') for x in row.split(', ')))})"
        state = frame.selectExpr("*", back).groupBy(*keys).agg(
            F.expr(f"max_by({row}, `{period}`)").alias("_now"),
            (F.count(F.lit(1)) - 1).alias(W.ROW),
            F.expr(f"array_sort(collect_list(if(_back BETWEEN 2 AND {deepest + 1}, {row}, NULL)))").alias("_before"),
        )
        state = state.where("_now IS NOT NULL")
        past = [
            f"transform(slice(_before, greatest(size(_before) - {self.depth[c]}, 0) + 1, {self.depth[c]}), r -> r.`{c}`) AS `_past_{c}`"
            for c in self.metrics
        ]
        averages = [f"_now.`{c}_ema_{n}` AS `_ema_{c}_{n}`" for c in self.metrics for n in sorted(self.spans[c])]
        current = [f"_now.`{c}` AS `{c}`" for c in dict.fromkeys([period, *metrics, *self.metrics])]
        return state.selectExpr(*[f"`{k}`" for k in keys], *current, W.ROW, *past, *averages)

    # --- features of the current row --------------------------------------------------

    def _expression(self, name: str) -> str:
        found = _WINDOWED.match(name)
        if not found:
            metric = source_column(name)
            if metric:
                return f"coalesce(try_divide({self._lag(metric, 1)}, {self._lag(metric, 2)}) - 1, 0)"
            if name == "month_index":
                return W.ROW
            return (calendar_features(self.grain.period, self.grain) | month_cycle(self.grain.period))[name]
        metric, kind, n = found[1], found[2], int(found[3])
        if kind == "lag" or (kind == "ema" and n <= 1):
            return self._lag(metric, n)
        if kind == "ema":
            return f"`_ema_{metric}_{n}`"
        past = f"`_past_{metric}`"
        tail = f"filter(slice({past}, greatest(size({past}) - {n}, 0) + 1, {n}), x -> x IS NOT NULL)"
        mean = f"try_divide(aggregate({tail}, 0D, (a, x) -> a + x), size({tail}))"
        if kind == "roll_mean":
            return mean
        if kind == "roll_std":
            squares = f"aggregate({tail}, 0D, (a, x) -> a + pow(x - {mean}, 2))"
            return f"sqrt(try_divide({squares}, nullif(size({tail}), 1) - 1))"
        return f"array_{kind.removeprefix('roll_')}({tail})"

    def _lag(self, metric: str, k: int) -> str:
        return f"get(`_past_{metric}`, size(`_past_{metric}`) - {k})"

    def with_features(self, state: DataFrame) -> DataFrame:
        return state.selectExpr("*", *[f"{self._expression(n)} AS `{n}`" for n in self.features])

    # --- the next row -----------------------------------------------------------------

    def advanced(self, predicted: DataFrame) -> DataFrame:
        """The state one period later: the current row joins the past, the forecast is the new revenue."""
        from panelcast.plans.feature_frame import add_ratios

        period, revenue = self.grain.period, self.grain.revenue
        out = {W.ROW: F.col(W.ROW) + 1}
        for c in self.metrics:
            depth = self.depth[c]
            joined = f"concat(`_past_{c}`, array(`{c}`))"
            out[f"_past_{c}"] = F.expr(f"slice({joined}, greatest(size({joined}) - {depth}, 0) + 1, {depth})")
            for n in self.spans[c]:
                r = repr(W._decay(n)) + "D"
                out[f"_ema_{c}_{n}"] = F.expr(f"if(`_ema_{c}_{n}` IS NULL, `{c}`, {r} * `_ema_{c}_{n}` + (1D - {r}) * `{c}`)")
        pushed = predicted.withColumns(out | {period: self.grain.shift(F.col(period)), revenue: F.col(_FORECAST)})
        return add_ratios(pushed, self.cfg)[0]


def recursive(
    table: DataFrame, predict: Predict, value: str, features: list[str], cfg, grain: Grain, series_keys: list[str], horizon: int,
    carried: DataFrame | None = None,
) -> DataFrame:
    """``horizon`` steps past the end of every series, clipped at zero.

    Metrics other than revenue repeat their last value; ratios and calendar features follow
    the forecast.  ``predict`` adds the column ``value``; ``carried`` has columns per series
    that it needs.  All series take a step together in one job, whose rows (one per series)
    are written below the shared folder, so a lost executor repeats one step.
    """
    from panelcast.plans.tuning import with_series_value

    state = FeatureState(features, cfg, grain, series_keys)
    now = state.start(table)
    if carried is not None:
        now = with_series_value(now, carried, series_keys)
    now = now.withColumn("_made", F.expr("array()").cast("array<struct<period:date,step:int,y_pred:double>>"))
    kept = [*now.columns]
    now = cut_lineage(now)
    for step in range(1, horizon + 1):
        made = predict(state.with_features(now)).withColumn(_FORECAST, non_negative(F.col(value)))
        entry = F.struct(grain.shift(F.col(grain.period)).alias("period"), F.lit(step).alias("step"), F.col(_FORECAST).alias("y_pred"))
        made = made.withColumn("_made", F.concat("_made", F.array(entry)))
        now = cut_lineage(state.advanced(made).select(*kept))
    return now.select(*series_keys, F.explode("_made").alias("_m")).select(*series_keys, "_m.*")


def recursive_ridge(
    table: DataFrame,
    models: DataFrame,
    features: list[str],
    grain: Grain,
    series_keys: list[str],
    horizon: int,
) -> DataFrame:
    """Recursive forecast with one row of coefficients per series (``models``)."""
    from panelcast.operators import ridge
    from panelcast.plans.feature_frame import FeatureConfig

    cfg = FeatureConfig.default(grain)
    predict = lambda rows: rows.withColumn("_y", ridge.linear(features))
    return recursive(
        table, predict, "_y", features, cfg, grain, series_keys, horizon, models.select(*series_keys, "coefficients")
    )
