"""First n rows per group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.session import checkpointed

FAN_IN = 64
#: Up to this n Spark itself cuts each map task to n rows per group (spark.sql.optimizer.windowGroupLimitThreshold).
SMALL = 1000
#: Buckets of a group's range in one round, groups whose cuts are broadcast at most, rows beyond n that are let through.
BUCKETS = 1024
GROUPS = 100_000
SPARE = 1000


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
            rank: str = "rank") -> DataFrame:
    """Rows ranked 1..n in each group of ``keys`` under the total order ``order``.

    A product may own a third of all rows, so ranking it in one task is not an option. Rows are
    ranked first within (group, salt), the salt coming from the input partition, so a hot group is
    spread over all shuffle partitions; only the first n of each go on. Further rounds merge the
    salts FAN_IN at a time, at most FAN_IN * n rows of a group to a task. For n up to 1000 Spark
    also cuts each map task to n rows per (group, salt) before the shuffle (WindowGroupLimit).
    """
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.withColumn("_salt", F.spark_partition_id() % salts)
    while True:
        window = Window.partitionBy(*keys, "_salt").orderBy(*order)
        out = out.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)
        if salts == 1:
            return out.drop("_salt")
        salts = max(1, -(-salts // FAN_IN))
        out = out.withColumn("_salt", F.col("_salt") % salts).drop(rank)


def first_one(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group. Map tasks send at most one row per group."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= 1).drop("_rn")



def same_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Keys that may be null."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return same


def cuts(df: DataFrame, keys: Sequence[str], lead: Column, n: int, buckets: int = BUCKETS, spare: int = SPARE) -> DataFrame:
    """(keys, cut, total) per group: at least n of its ``total`` known leads are ``cut`` and less, if it has n.

    ``lead`` is a whole number between -2^61 and 2^61. Each round counts a histogram of ``buckets`` buckets
    between a group's bounds, one row per (task, group, bucket), and goes on inside the bucket that holds
    row n; rounds end when no group lets more than n / 8 + ``spare`` rows too many through, or the bucket is one value.
    """
    narrow = df.select(*keys, lead.cast("bigint").alias("_lead")).where("_lead IS NOT NULL")
    bounds = narrow.groupBy(*keys).agg(F.min("_lead").alias("_low"), F.max("_lead").alias("_high"), F.count("*").alias("_total"))
    state = checkpointed(bounds.withColumn("_before", F.lit(0).cast("bigint")).withColumn("_inside", F.col("_total")))
    width = F.expr(f"(_high - _low) div {buckets}") + 1
    while True:
        much = (F.col("_total") > n) & (F.col("_before") + F.col("_inside") > n + n // 8 + spare) & (F.col("_low") < F.col("_high"))
        open_ = state.where(much)
        many = open_.count()
        if not many or many > GROUPS:  # so many cuts aren't broadcast; the caller does without
            return state.select(*keys, F.col("_high").alias("cut"), F.col("_total").alias("total"))
        bucket = F.expr("(_lead - _low) div _width")
        asked = open_.withColumn("_width", width)
        counted = narrow.alias("l").join(F.broadcast(asked.select(*keys, "_low", "_high", "_width").alias("r")), same_keys("l", "r", keys)) \
            .where("_lead BETWEEN _low AND _high").select(*(F.col(f"l.{k}") for k in keys), bucket.alias("_bucket")) \
            .groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
        # a group has so many rows here as there are buckets
        running = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket"))
        joined = counted.withColumn("_running", running).alias("l").join(asked.alias("r"), same_keys("l", "r", keys)) \
            .select(*(F.col(f"l.{k}") for k in keys), "_bucket", "_n", "_running", "_low", "_high", "_width", "_total", "_before") \
            .where((F.col("_before") + F.col("_running") >= n) & (F.col("_before") + F.col("_running") - F.col("_n") < n))
        low = F.col("_low") + F.col("_bucket") * F.col("_width")
        inner = joined.select(*keys, low.alias("_low"), F.least("_high", low + F.col("_width") - 1).alias("_high"), "_total",
                              (F.col("_before") + F.col("_running") - F.col("_n")).alias("_before"), F.col("_n").alias("_inside"))
        state = checkpointed(state.where(~much).unionByName(inner))


def first_n_by_cut(df: DataFrame, keys: Sequence[str], lead: Column, order: Sequence[Column], n: int, rank: str = "rank",
                   buckets: int = BUCKETS, spare: int = SPARE) -> DataFrame:
    """``first_n`` for a large n: of each group little more than n rows are shuffled, however many it has.

    ``lead`` is a whole number that never decreases along ``order``; null leads come last. Cut-offs are found first
    (``cuts``); rows beyond their group's are filtered on the map side, ties of the last lead stay and are
    ranked exactly. With more than GROUPS groups, each is small and ``first_n`` does.
    """
    found = cuts(df, keys, lead, n, buckets, spare)
    if found.count() > GROUPS:
        return first_n(df, keys, order, n, rank)
    near = df.withColumn("_lead", lead.cast("bigint")).alias("l").join(F.broadcast(found.alias("r")), same_keys("l", "r", keys), "left")
    kept = near.where((F.col("_lead") <= F.col("cut")) | (F.col("_lead").isNull() & (F.coalesce("total", F.lit(0)) < n)))
    return first_n(kept.select(*(F.col(f"l.{c}") for c in df.columns)), keys, order, n, rank)
