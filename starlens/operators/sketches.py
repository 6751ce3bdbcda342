"""Stored sketches per product and day, merged over any span of days without the reviews.

Distinct counts keep a HyperLogLog state of 2^12 registers (a relative standard error of about 1.6 %),
quantiles a KLL state of the default size (a rank error of about 1.3 %). A state is a few kilobytes however many rows it stands for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.functions import dates

REGISTERS = 12
#: Bounds that the tests and the registered comparison hold the states to.
DISTINCT_ERROR = 0.05
RANK_ERROR = 0.03


def sketched(df: DataFrame, distinct: str = "review_id", value: str = "Thumbs_Up_Count") -> DataFrame:
    """(App, day, distinct_state, value_state, n); map tasks send one pair of states per product and day."""
    return df.groupBy("App", dates.day_key(F.col("Review_Date")).alias("day")).agg(
        F.hll_sketch_agg(F.col(distinct), F.lit(REGISTERS)).alias("distinct_state"),
        F.kll_sketch_agg_bigint(F.col(value).cast("bigint")).alias("value_state"), F.count(value).alias("n"))


def merged(states: DataFrame, keys: Sequence[str] = ("App",)) -> DataFrame:
    """The states of whole groups, from those of any days."""
    return states.groupBy(*keys).agg(F.hll_union_agg("distinct_state").alias("distinct_state"),
                                     F.kll_merge_agg_bigint("value_state").alias("value_state"), F.sum("n").alias("n"))


def distinct_count() -> Column:
    return F.hll_sketch_estimate("distinct_state")


def quantile(q: float) -> Column:
    return F.kll_sketch_get_quantile_bigint("value_state", F.lit(q))
