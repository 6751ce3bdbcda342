"""Data-quality profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions.formatting import rounded
from starlens.operators import quantiles as Q

NUMERIC_TYPES = {"integer", "long", "double", "float", "short", "byte"}
NOT_CATEGORIES = ("review_id", "Review_Text", "Review_Date", "App_Version")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in NUMERIC_TYPES]


def categorical_columns(df: DataFrame, exclude=NOT_CATEGORIES) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() == "string" and f.name not in exclude]


def _long(row: DataFrame, columns, name: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in columns])
    return row.select(F.inline(cells))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls), all columns in one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return _long(row, df.columns, "nulls")


def distinct_counts(df: DataFrame, long_text: tuple[str, ...] = ("Review_Text",)) -> DataFrame:
    """(column, distinct), nulls not counted.

    Each value becomes a (column, digest) row once per map task, so a frequent value is sent
    once per task and long texts travel as 32 bytes.
    """
    def identity(c):
        value = F.col(c).cast("string")
        return F.sha2(value, 256) if c in long_text else value

    cells = F.array(*[F.struct(F.lit(c).alias("column"), identity(c).alias("v")) for c in df.columns])
    return df.select(F.inline(cells)).distinct().groupBy("column").agg(F.count("v").alias("distinct"))


def approx_distinct_counts(df: DataFrame) -> DataFrame:
    row = df.agg(*[F.approx_count_distinct(c).alias(c) for c in df.columns])
    return _long(row, df.columns, "distinct")


def distinct_values(df: DataFrame, columns) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).distinct()


def category_counts(df: DataFrame, columns) -> DataFrame:
    """(column, value, n), nulls left out."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_columns(df: DataFrame) -> DataFrame:
    """(column, type, non_null) for every column."""
    row = df.agg(*[F.count(c).alias(c) for c in df.columns])
    cells = F.array(*[
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                 F.col(f.name).alias("non_null")) for f in df.schema])
    return row.select(F.inline(cells))


def describe_numeric(df: DataFrame, columns) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles and max per column.

    Everything comes from the counts of distinct values: the rows are read once.
    """
    cum = Q.cumulative(Q.value_counts(Q.stacked(df, columns), ["column"]), ["column"])
    n, v = F.col("n"), F.col("value")
    moments = cum.groupBy("column").agg(
        F.sum("n").alias("count"), F.sum(n * v).alias("_s1"), F.min(v).alias("min"), F.max(v).alias("max"),
        *[Q.quantile_of(p).alias(name) for name, p in Q.QUARTILES])
    means = moments.withColumn("_mean", F.col("_s1") / F.col("count"))
    # second pass over the distinct values: squared distances from the mean do not cancel
    spread = cum.join(F.broadcast(means.select("column", "_mean")), "column").groupBy("column").agg(
        F.sum(n * (v - F.col("_mean")) * (v - F.col("_mean"))).alias("_ss"))
    return means.join(spread, "column").select(
        "column", "count", rounded(F.col("_mean")).alias("mean"),
        rounded(F.sqrt(F.try_divide(F.col("_ss"), F.col("count") - 1))).alias("std"),
        *[rounded(F.col(c)).alias(c) for c in ("min", "q25", "q50", "q75", "max")])
