"""Result columns in the types and rounding both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

REAL = (T.DoubleType, T.FloatType, T.DecimalType)
WHOLE = (T.IntegerType, T.ShortType, T.ByteType)


def present(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, real ones rounded as ``steady_round`` does.

    Written as SQL text: a feature frame has hundreds of columns.
    """
    out = []
    for f in df.schema.fields:
        name = f"`{f.name}`"
        if isinstance(f.dataType, REAL):
            out.append(f"rint(double({name}) * 10000D + 0.001D) / 10000D AS {name}")
        elif isinstance(f.dataType, WHOLE):
            out.append(f"bigint({name}) AS {name}")
        else:
            out.append(name)
    return df.selectExpr(*out)
