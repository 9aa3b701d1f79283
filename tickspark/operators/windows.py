"""Window functions over an explicit order that Spark lacks: delta, ratio, and the exponential average."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

RATIO_UNIT = 1_000_000


def delta(x: str, w: WindowSpec) -> Column:
    """Change from the row before; the first row's own value."""
    return F.col(x) - F.lag(x, 1, 0).over(w)


def ratio(x: str, w: WindowSpec) -> Column:
    """Millionths of the row before, cut toward zero; RATIO_UNIT at first, 0 after a zero."""
    before = F.lag(x).over(w)
    return F.when(F.row_number().over(w) == 1, F.lit(RATIO_UNIT).cast("long")).when(before == 0, F.lit(0).cast("long")).otherwise((F.col(x) / F.nullif(before, F.lit(0)) * RATIO_UNIT).cast("long"))


def alpha_of(period_or_alpha: float) -> float:
    """A whole number is a period n, smoothing by 2 / (n + 1); any other is the factor itself."""
    return 2 / (period_or_alpha + 1) if isinstance(period_or_alpha, int) else period_or_alpha


def ema(df: DataFrame, x: str, alpha: float, keys: Sequence[str], order: Sequence[str], name: str = "ema") -> DataFrame:
    """df with the exponential average of x per keys, carried in double and cut toward zero.

    Rows are sorted in the partitions of their keys and stream through with one number of state, so a
    key of any length needs no memory. A null x keeps the average.
    """
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, value = None, None
        for b in batches:
            own, out = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True)), []
            for key, v in zip(own, b.column(x).to_pylist(), strict=True):
                if key != last:
                    last, value = key, None
                if v is not None:
                    value = float(v) if value is None else alpha * v + (1 - alpha) * value
                out.append(None if value is None else int(value))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64())], names=[*columns, name])

    schema = df.schema.add(name, "long")
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
