"""Per-series window features, written as SQL expressions.

A feature frame has hundreds of them, and one ``selectExpr`` hands them to Spark in
a single call.  All use one window, the series in period order, so a frame of any
width costs one exchange.  A window never sees more than one series at period grain,
whose length the calendar bounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

ROW = "_row"
BLOCK = "_block"


def _names(columns) -> str:
    return ", ".join(f"`{c}`" for c in columns)


@dataclass(frozen=True)
class SeriesWindow:
    """``OVER`` clauses for the rows of a series in order."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    def over(self, first: str | int | None = None, last: str | int | None = None) -> str:
        """Clause with the default frame, or with the rows from ``first`` to ``last``.

        Numbers count rows before the current one; ``"start"`` is the first row.
        """
        parts = [f"PARTITION BY {_names(self.keys)}"] if self.keys else []
        parts.append(f"ORDER BY {_names(self.order)}")
        if first is not None:
            begin = "UNBOUNDED" if first == "start" else first
            end = "CURRENT ROW" if last == 0 else f"{last} PRECEDING"
            parts.append(f"ROWS BETWEEN {begin} PRECEDING AND {end}")
        return f"OVER ({' '.join(parts)})"


def series_window(series_keys: list[str], *order: str) -> SeriesWindow:
    return SeriesWindow(tuple(series_keys), order)


def lagged(column: str, k: int, w: SeriesWindow) -> str:
    return f"lag(double(`{column}`), {k}) {w.over()}"


def one_step_ahead(column: str, w: SeriesWindow) -> str:
    return f"lead(double(`{column}`), 1) {w.over()}"


def rolling(column: str, n: int, w: SeriesWindow) -> dict[str, str]:
    """Mean, sample deviation, minimum and maximum of the ``n`` rows before this one."""
    kinds = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
    return {
        f"{column}_roll_{name}_{n}": f"{call}(double(`{column}`)) {w.over(n, 1)}"
        for name, call in kinds.items()
    }


def delayed_change(column: str, w: SeriesWindow) -> str:
    """Relative change between the two rows before this one; undefined counts as zero."""
    return f"coalesce(try_divide({lagged(column, 1, w)}, {lagged(column, 2, w)}) - 1, 0)"


def growth(column: str, w: SeriesWindow) -> str:
    """Relative change against the row before."""
    before = lagged(column, 1, w)
    return f"try_divide(`{column}` - {before}, {before})"


def trend_index(w: SeriesWindow) -> str:
    return f"row_number() {w.over()} - 1"


# --- exponential moving average -------------------------------------------------
#
# With r = 1 - 2/(span+1) the average at row i is  r^i x_0 + (1-r) * sum_j r^(i-j) x_j.
# Dividing by r^i turns it into a running sum, which a window computes in one pass,
# but r^-i would overflow on a long series.  So rows are cut into blocks: the running
# sum is taken within a block, and the value at the end of the block before it is
# carried in, discounted by the rows since.  Blocks are long enough that what lies
# further back weighs less than double precision can hold, and short enough that the
# scale factors stay finite.

_FORGOTTEN = 18 * math.log(10)  # weight 1e-18: below double precision
_LARGEST_SCALE = 250 * math.log(10)  # scale 1e250: leaves room for the values


def _decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def ema_blocks(spans: list[int]) -> dict[int, int]:
    """Block length for each span above one; spans share a length where it suits both."""
    out: dict[int, int] = {}
    length = 0
    for span in sorted({s for s in spans if s > 1}, reverse=True):
        rate = -math.log(_decay(span))
        if length == 0 or length > math.floor(_LARGEST_SCALE / rate):
            length = math.ceil(_FORGOTTEN / rate)
        out[span] = length
    return out


def _block_name(n: int, lengths: list[int]) -> str:
    return BLOCK if n == lengths[0] else f"{BLOCK}_{n}"


def add_ema_blocks(
    df: DataFrame, columns: list[str], spans: list[int], period: str, series_keys: list[str]
) -> tuple[DataFrame, list[str]]:
    """Add the row number, the blocks and the running sums; also returns their names.

    Columns must have no nulls after their first value.
    """
    blocks = ema_blocks(spans)
    lengths = sorted(set(blocks.values()), reverse=True) or [1]
    number = f"bigint(row_number() {series_window(series_keys, period).over()} - 1)"
    df = df.selectExpr("*", f"{number} AS {ROW}")
    names = {n: _block_name(n, lengths) for n in lengths}
    df = df.selectExpr("*", *[f"{ROW} DIV {n} AS {name}" for n, name in names.items()])

    sums = {}
    for span, n in blocks.items():
        r = repr(_decay(span)) + "D"
        in_block = series_window([*series_keys, names[n]], period).over("start", 0)
        offset = f"({ROW} % {n})"
        weight = f"if({ROW} = 0, 1D, 1D - {r})"
        for c in columns:
            scaled = f"double(`{c}`) * {weight} * pow({r}, -{offset})"
            sums[f"_{c}_sum_{span}"] = f"pow({r}, {offset}) * sum({scaled}) {in_block}"
    if sums:
        df = df.selectExpr("*", *[f"{e} AS `{name}`" for name, e in sums.items()])
    return df, [ROW, *names.values(), *sums]


def ema(column: str, span: int, spans: list[int], w: SeriesWindow) -> str:
    """Moving average of the rows before this one, on a frame with its blocks added."""
    if span <= 1:
        return lagged(column, 1, w)
    n, r = ema_blocks(spans)[span], repr(_decay(span)) + "D"
    running, offset = f"`_{column}_sum_{span}`", f"({ROW} % {n})"
    carried = f"last(if({offset} = {n - 1}, {running}, NULL), true) {w.over('start', 2)}"
    since = f"if({offset} = 0, {n}, {offset})"
    return f"lag({running}, 1) {w.over()} + coalesce({carried} * pow({r}, {since}), 0)"


def block_window(series_keys: list[str], period: str) -> SeriesWindow:
    """Same order as the series window, written so that the sort by block serves it too."""
    return series_window(series_keys, BLOCK, period)
