"""From a period table to a wide feature frame and a supervised set."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.calendar import Grain, calendar_features, month_cycle
from panelcast.functions.numeric import ratio_zero_as_one
from panelcast.operators import windows as W

# The default metrics, lags and windows of the two grains.
SHARED_METRICS = (
    "total_orders",
    "avg_review_score",
    "total_items",
    "total_freight",
    "unique_customers",
    "avg_installments",
)
MONTH_LAGS, MONTH_WINDOWS = (1, 2, 3, 6), (3, 6)
DAY_LAGS, DAY_WINDOWS = (1, 7, 14, 21, 28, 30), (7, 14, 28, 30)


@dataclass(frozen=True)
class FeatureConfig:
    """What to derive.  ``add_trend`` adds the 0-based position of a row in its series."""

    base_cols: tuple[str, ...]
    lags: tuple[int, ...]
    rolling_windows: tuple[int, ...]
    add_seasonality: bool = True
    add_trend: bool = False
    target_col: str = "label"
    ratios: tuple[str, ...] = field(default=("revenue_per_order", "items_per_order", "freight_ratio"))

    @classmethod
    def default(cls, grain: Grain, **changes) -> "FeatureConfig":
        monthly = grain.unit == "month"
        values = {
            "base_cols": (grain.revenue, *SHARED_METRICS),
            "lags": MONTH_LAGS if monthly else DAY_LAGS,
            "rolling_windows": MONTH_WINDOWS if monthly else DAY_WINDOWS,
        }
        return cls(**(values | changes))


def add_ratios(df: DataFrame, cfg: FeatureConfig) -> tuple[DataFrame, list[str]]:
    """Ratios whose two inputs exist; daily tables have three, monthly tables one."""
    inputs = {
        "revenue_per_order": ("daily_revenue", "total_orders"),
        "items_per_order": ("total_items", "total_orders"),
        "freight_ratio": ("total_freight", "daily_revenue"),
    }
    present = {
        name: ratio_zero_as_one(F.col(top), F.col(bottom))
        for name, (top, bottom) in inputs.items()
        if name in cfg.ratios and top in df.columns and bottom in df.columns
    }
    return df.withColumns(present) if present else df, list(present)


def spread_series(df: DataFrame, series_keys: list[str]) -> DataFrame:
    """Hash the series over all shuffle partitions.

    Wide windows cost CPU, not bytes: left to itself, adaptive execution would merge
    the few megabytes of a period table into one task.  The windows that follow use
    this partitioning and add no exchange.
    """
    if not series_keys:
        return df
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(partitions, *series_keys)


def create_features(
    df: DataFrame,
    cfg: FeatureConfig,
    grain: Grain,
    series_keys: list[str],
    only: list[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Period table plus features, and the feature names in a fixed order.

    Every feature of a row is known before the row's own period has ended.  ``only``
    restricts the frame to features a model uses; columns and moving averages that
    none of them needs are not computed.
    """
    period = grain.period
    base, ratio_names = add_ratios(spread_series(df, series_keys), cfg)
    columns = [c for c in cfg.base_cols if c in base.columns]
    columns += [c for c in ratio_names if c not in columns]

    spans = list(cfg.rolling_windows)
    if only is not None:
        columns = [c for c in columns if any(name.startswith(f"{c}_") for name in only)]
    averaged = [c for c in columns if only is None or any(f"{c}_ema_{n}" in only for n in spans)]
    base, helpers = W.add_ema_blocks(base, averaged, spans, period, series_keys)
    w = W.block_window(series_keys, period)
    features: dict[str, str] = {}
    for c in columns:
        features |= {f"{c}_lag_{k}": W.lagged(c, k, w) for k in cfg.lags}
        for n in spans:
            features |= W.rolling(c, n, w)
            if c in averaged:
                features[f"{c}_ema_{n}"] = W.ema(c, n, spans, w)
        features[f"{c}_pct_change"] = W.delayed_change(c, w)
    features |= calendar_features(period, grain)
    if cfg.add_seasonality:
        features |= month_cycle(period)
    if cfg.add_trend:
        features["month_index"] = W.ROW
    if only is not None:
        features = {name: features[name] for name in only}

    label = {
        cfg.target_col: W.one_step_ahead(grain.revenue, w),
        "target_period": f"lead({period}, 1) {w.over()}",
    }
    kept = [c for c in base.columns if c not in features and c not in helpers]
    derived = [f"{e} AS `{n}`" for n, e in (features | label).items()]
    out = base.selectExpr(*[f"`{c}`" for c in kept], *derived)
    return out, list(features)


def supervised(
    df: DataFrame,
    cfg: FeatureConfig,
    grain: Grain,
    series_keys: list[str],
    only: list[str] | None = None,
) -> tuple[DataFrame, list[str]]:
    """Rows whose features and next-period target are all known.

    ``target_period`` is the period the target belongs to.
    """
    frame, names = create_features(df, cfg, grain, series_keys, only)
    keep = frame.na.drop(subset=[*names, cfg.target_col])
    columns = [*series_keys, grain.period, "target_period", *names, cfg.target_col]
    return keep.select(*columns), names
