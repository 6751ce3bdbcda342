"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.session import configure, map_arrow, work_path, written  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/documents.parquet")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, although ``body`` may name it in inner lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def row_key(id_column: Column, text: Column) -> list[Column]:
    """128 bits that tell rows apart: copies under other ids differ, repeated rows share it."""
    return [F.xxhash64(F.coalesce(id_column.cast("string"), F.lit(""))).alias("key_id"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("key_text")]


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tasks_for(spark: SparkSession, n_bytes: int, task_bytes: int) -> int:
    """Tasks of about ``task_bytes`` each, but never more than four rounds of shuffle partitions: beyond that a task
    takes more than its share, so its memory must not depend on it."""
    return max(1, min(-(-n_bytes // task_bytes), 4 * parts(spark)))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads unsigned 64-bit numbers over their whole range."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
