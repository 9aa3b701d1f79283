"""Joins of time series: as-of, window, union and plus joins. Equi-joins are DataFrame.join's."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Slices that as-of joins cut time into: hours of nanoseconds.
SLICE = 3_600_000_000_000


def _slice(df: DataFrame, time: str, width: int) -> Column:
    """A number that never falls as time grows; times that aren't numbers are one slice."""
    return F.floor(F.col(time) / F.lit(width)).cast("long") if isinstance(df.schema[time].dataType, NumericType) else F.lit(0).cast("long")


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, columns: Sequence[str], ties: str | None = None, inner: bool = True, right_columns: bool = True, forward: bool = False, strict: bool = False, slice_width: int = SLICE) -> DataFrame:
    """Left rows with columns of the last right row of equal keys at or before their time.

    Both sides pass one shuffle and one sort by keys and slices of time, and a running last value; the
    state is a row, so slices with many rows are streamed, not held. What a slice begins with, the last
    row of the slices before it, comes from an aggregation with a row per key and slice: a hot key is as
    many tasks as it has slices. slice_width is in the unit of the times and changes no result. ties:
    right column that decides among equal times. A null key or time joins nothing. inner drops left rows
    without a match; right_columns=False keeps the left columns alone (aj0). forward takes the first
    right row at or after the time instead; strict leaves out rows of the same time.
    """
    tie = F.col(ties).cast("long") if ties else F.lit(0).cast("long")
    payload = F.struct(F.lit(True).alias("hit"), *(F.col(c) for c in columns))
    names = [f"k{i}" for i in range(len(keys))]
    place = lambda df, time: [*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(time).alias("t"), _slice(df, time, slice_width).alias("slice")]
    a = left.select(*place(left, left_time), F.lit(0 if strict else 1).alias("side"), F.lit(None).cast("long").alias("tie"), F.struct(*left.columns).alias("l"), F.lit(None).cast(right.select(payload.alias("r")).schema["r"].dataType).alias("r"))
    b = right.where(F.col(right_time).isNotNull()).select(*place(right, right_time), F.lit(1 if strict else 0).alias("side"), tie.alias("tie"), F.lit(None).cast(a.schema["l"].dataType).alias("l"), payload.alias("r"))
    by = [F.desc("t") if forward else F.asc("t"), F.asc("side"), F.desc("tie") if forward else F.asc("tie")]
    w = Window.partitionBy(*names, "slice").orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the row that each slice hands on; slices of left rows alone are there to be handed one
    edge, order = F.min_by if forward else F.max_by, F.when(F.col("r").isNotNull(), F.struct("t", "tie"))
    handed = a.unionByName(b).select(*names, "slice", "t", "tie", "r").groupBy(*names, "slice").agg(edge("r", order).alias("edge"))
    before = Window.partitionBy(*names).orderBy(F.desc("slice") if forward else F.asc("slice")).rowsBetween(Window.unboundedPreceding, -1)
    begins = handed.withColumn("begin", F.last("edge", ignorenulls=True).over(before)).where("begin is not null").drop("edge")
    known = F.col("t").isNotNull()
    for n in names:
        known = known & F.col(n).isNotNull()
    both = a.unionByName(b).withColumn("m", F.last("r", ignorenulls=True).over(w)).where("l is not null")
    both = both.join(begins, [*names, "slice"], "left").withColumn("m", F.when(known, F.coalesce("m", "begin")))
    if inner:
        both = both.where("m.hit")
    return both.select("l.*", *(F.col(f"m.{c}") for c in (columns if right_columns else ())))


def window_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, value: str | Sequence[str], before: int, after: int, row_id: Sequence[str] = (), aggregates: Sequence[str] = ("avg", "sum", "count", "min", "max")) -> DataFrame:
    """Left rows with wj_* aggregates of right values whose time lies in [t - before, t + after]; 0 where there are none.

    Time is cut into buckets as wide as the window, so a left row looks into two buckets at most and
    the join has equal keys and buckets: its output is the true matches and near misses, never all
    pairs of a key. The left side is read once, and its rows are the groups of the aggregation: told
    apart by the columns of row_id, or else its distinct rows with how often each is there. Several values pass in the same join, with their names behind those
    of the aggregates (wj_max_bid).
    """
    values = {value: ""} if isinstance(value, str) else {v: f"_{v}" for v in value}
    width = before + after + 1
    at = lambda c: F.floor(c / F.lit(width))
    renamed = [F.col(c).alias(f"l_{c}") for c in left.columns]
    own = left.select(*renamed, F.lit(1).alias("times")) if row_id else left.groupBy(*renamed).agg(F.count("*").alias("times"))
    first, last = at(F.col(f"l_{left_time}") - before), at(F.col(f"l_{left_time}") + after)
    # a row without a time looks nowhere, but stays
    spread = own.select("*", F.explode_outer(F.array_distinct(F.array(first, last))).alias("bucket"))
    near = right.select(*(F.col(k).alias(f"r_{k}") for k in keys), F.col(right_time).alias("r_t"), *(F.col(v).alias(f"r_v{i}") for i, v in enumerate(values)), at(F.col(right_time)).alias("r_bucket"))
    match = F.col("bucket") == F.col("r_bucket")
    for k in keys:
        match = match & (F.col(f"l_{k}") == F.col(f"r_{k}"))
    within = F.col("r_t").between(F.col(f"l_{left_time}") - before, F.col(f"l_{left_time}") + after)
    rows = [f"l_{c}" for c in row_id or left.columns]
    rest = [F.first(f"l_{c}").alias(f"l_{c}") for c in left.columns if row_id and c not in row_id]
    parts = spread.join(near, match & within, "left").groupBy(*rows, "times").agg(*rest, *(f(f"r_v{i}").alias(f"{c}{i}") for i in range(len(values)) for f, c in ((F.sum, "s"), (F.count, "n"), (F.min, "lo"), (F.max, "hi"))))
    named = lambda i: {"avg": F.coalesce((F.col(f"s{i}") / F.nullif(f"n{i}", F.lit(0))).cast("long"), F.lit(0)), "sum": F.coalesce(f"s{i}", F.lit(0)), "count": F.col(f"n{i}"), "min": F.coalesce(f"lo{i}", F.lit(0)), "max": F.coalesce(f"hi{i}", F.lit(0))}
    out = [F.col(f"l_{c}").alias(c) for c in left.columns] + [named(i)[x].cast("long").alias(f"wj_{x}{end}") for i, end in enumerate(values.values()) for x in aggregates]
    if row_id:
        return parts.select(*out)
    return parts.select(*out, F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int"))).alias("_copy")).drop("_copy")


def union_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """All rows of both with all columns of either, null where a side lacks one."""
    return left.unionByName(right, allowMissingColumns=True)


def plus_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Left rows whose other columns grow by those of the same name in the right row of equal keys; of several, the last by order counts."""
    shared = [c for c in left.columns if c in right.columns and c not in keys and c != order]
    last = right.groupBy(*keys).agg(*(F.max_by(c, order).alias(f"plus_{c}") for c in shared))
    return left.join(last, list(keys), "left").select(*((F.col(c) + F.coalesce(f"plus_{c}", F.lit(0))).alias(c) if c in shared else F.col(c) for c in left.columns))
