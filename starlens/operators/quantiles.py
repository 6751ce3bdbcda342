"""Exact quantiles of columns too large for one task.

Equal values are counted first, then the distinct values are range-partitioned by
(group, value). A value's cumulative count is the total of the slices before its own plus a
running sum inside its slice, so neither a hot group nor a hot value meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.session import checkpointed

QUARTILES = [("q25", 0.25), ("q50", 0.5), ("q75", 0.75)]


def stacked(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Numeric columns as rows (keys, column, value)."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    return (
        df.select(*keys, F.explode(F.array(*pairs)).alias("_p"))
        .select(*keys, "_p.column", "_p.value")
    )


def value_counts(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, value, n); nulls are left out."""
    kept = df.where(F.col(value).isNotNull())
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    return kept.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def cumulative(counts: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """``counts`` plus ``cum`` (rows up to and including the value) and ``total`` per group."""
    keys = list(keys)
    # Written once: both reads below must see the same slices.
    sliced = checkpointed(
        counts.repartitionByRange(*keys, value).withColumn("_slice", F.spark_partition_id())
    )
    per_slice = sliced.groupBy(*keys, "_slice").agg(F.sum("n").alias("_slice_n"))
    group = Window.partitionBy(*keys)  # at most one row per slice
    before = group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    per_slice = per_slice.select(
        *keys, "_slice",
        F.coalesce(F.sum("_slice_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_slice_n").over(group).alias("total"),
    )
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        sliced.join(per_slice, [*keys, "_slice"])
        .withColumn("cum", F.col("_before") + F.sum("n").over(inside))
        .drop("_before", "_slice")
    )


def quantile_of(p: float, value: str = "value") -> Column:
    """Aggregate over ``cumulative`` rows: the p-quantile with linear interpolation."""
    position = F.lit(p) * (F.col("total") - 1)
    low, high = F.floor(position), F.ceil(position)
    at_low = F.min(F.when(F.col("cum") > low, F.col(value)))
    at_high = F.min(F.when(F.col("cum") > high, F.col(value)))
    return at_low + (at_high - at_low) * F.max(position - low)


def quantiles(df: DataFrame, keys: Sequence[str], value: str,
              probs: Sequence[tuple[str, float]]) -> DataFrame:
    """One row per group with a column per (name, probability)."""
    cum = cumulative(value_counts(df, keys, value), keys, value)
    aggs = [quantile_of(p, value).alias(name) for name, p in probs]
    return cum.groupBy(*keys).agg(*aggs)


def approximate_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                          probs: Sequence[tuple[str, float]], accuracy: int = 10_000) -> DataFrame:
    """The one-pass variant: rank error at most 1/accuracy."""
    aggs = [F.percentile_approx(value, p, accuracy).alias(name) for name, p in probs]
    return df.groupBy(*keys).agg(*aggs)
