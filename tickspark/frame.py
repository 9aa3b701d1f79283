"""A lazy per-symbol frame: comparisons, filters, sums, counts, VWAP and rolling means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickspark.functions.scalars import vwap


class TickFrame:
    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def of(cls, ticks: DataFrame, symbol: int) -> TickFrame:
        return cls(ticks.where(F.col("symbol") == symbol))

    def __getitem__(self, key: str | Column) -> TickColumn | TickFrame:
        return TickColumn(self, key) if isinstance(key, str) else self.filter(key)

    def filter(self, condition: Column) -> TickFrame:
        return TickFrame(self.rows.where(condition))

    def count(self) -> int:
        return self.rows.count()

    def vwap(self) -> float | None:
        return self.rows.agg(vwap("price", "volume")).first()[0]


class TickColumn:
    def __init__(self, frame: TickFrame, name: str):
        self.frame, self.name = frame, name

    def __gt__(self, x) -> Column:
        return F.col(self.name) > x

    def __ge__(self, x) -> Column:
        return F.col(self.name) >= x

    def __lt__(self, x) -> Column:
        return F.col(self.name) < x

    def __le__(self, x) -> Column:
        return F.col(self.name) <= x

    def __eq__(self, x) -> Column:  # type: ignore[override]
        return F.col(self.name) == x

    __hash__ = None  # type: ignore[assignment]

    def sum(self) -> int:
        return self.frame.rows.agg(F.coalesce(F.sum(self.name), F.lit(0))).first()[0]

    def mean(self) -> float | None:
        return self.frame.rows.agg(F.avg(self.name)).first()[0]

    def rolling(self, n: int, by: tuple[str, ...] = ("timestamp", "seq")) -> Rolling:
        return Rolling(self, n, by)


class Rolling:
    """The last n rows of each symbol, this one included."""

    def __init__(self, column: TickColumn, n: int, by: tuple[str, ...]):
        self.column, self.window = column, Window.partitionBy("symbol").orderBy(*by).rowsBetween(1 - n, 0)

    def mean(self) -> DataFrame:
        return self.column.frame.rows.withColumn(f"{self.column.name}_mean", F.avg(self.column.name).over(self.window))
