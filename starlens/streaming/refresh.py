"""Refreshing the published daily table after a batch without reading old reviews again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.functions import dates
from starlens.operators import aggregate as A
from starlens.session import exists
from starlens.sources import versioned as V

PARTS = "parts"
STORED = "App string, sum_sentiment double, n_sentiment bigint, sum_star double, n bigint, day string"


def parts_of(batch: DataFrame) -> DataFrame:
    return A.series_parts(batch, dates.day_key(F.col("Review_Date")), "day")


def merge_parts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored daily parts plus those of new reviews. Sums and counts add up, so the result equals
    a rebuild from all reviews; only the batch is aggregated."""
    return A.add_parts(stored.unionByName(parts_of(batch)), "day")


def touched_days(batch: DataFrame) -> DataFrame:
    return batch.select(dates.day_key(F.col("Review_Date")).alias("day")).where("day IS NOT NULL").distinct()


def refresh(stored: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new parts of the touched days, their published series)."""
    days = touched_days(batch)  # one row per calendar day
    changed = merge_parts(stored.join(days, "day", "left_semi"), batch)
    return changed, A.series_from_parts(changed, "day")


def store_refresh(spark: SparkSession, path: str, batch: DataFrame, number: int | None = None, writer: str = "refresh", fan: int = V.FAN) -> bool:
    """Bring the stored parts up to date: the batch's own sums and counts are added in one step, old ones stay
    as they are. False, and nothing changes, if this batch number was handed in before. Parts that an earlier
    release left as plain folders of days are taken over first."""
    if V.manifest(spark, path)["version"] == 0 and exists(spark, path):
        V.append(spark.read.schema(STORED).option("basePath", path).parquet(f"{path}/day=*"), path, PARTS)
    if not V.append(parts_of(batch), path, PARTS, writer, number):
        return False
    compact(spark, path, fan)
    return True


def stored_parts(spark: SparkSession, path: str) -> DataFrame:
    """One row per product and day."""
    return A.add_parts(V.scan(spark, path, PARTS, STORED), "day")


def compact(spark: SparkSession, path: str, fan: int = V.FAN) -> None:
    """Merge parts in levels; the merged part has one row per product and day."""
    V.compact(spark, path, PARTS, STORED, lambda rows: A.add_parts(rows, "day").coalesce(1), fan=fan)


def published(spark: SparkSession, path: str) -> DataFrame:
    return A.series_from_parts(stored_parts(spark, path), "day")
