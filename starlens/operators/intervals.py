"""Group means with 95% intervals."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.functions import fixed_values as fv
from starlens.functions.formatting import mean, rounded
from starlens.operators import quantiles as Q

#: Slices that ``mean_sliced_interval`` deals the units of a table to.
SLICES = 1024
#: Poisson(1) draws by inversion: a 32-bit hash at or above the k-th of these gives k + 1 and more. Beyond 12 the chance is below 2^-32.
POISSON = [math.floor(2 ** 32 * sum(math.exp(-1) / math.factorial(i) for i in range(k + 1))) for k in range(12)]


def mean_normal_interval(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean +- 1.96 standard errors."""
    half = F.lit(1.96) * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), mean(F.col(value)).alias("mean"),
        rounded(F.avg(value) - half).alias("ci_low"), rounded(F.avg(value) + half).alias("ci_high"))


def mean_bootstrap_interval(df: DataFrame, keys: Sequence[str], value: str, replicas: int = 1000,
                            seed: int = fv.SEED) -> DataFrame:
    """Mean with the 2.5% and 97.5% points of a Poisson bootstrap.

    A row resampled by Poisson(1) weights, added over the n rows that share a value, is one
    Poisson(n) draw, so the draws run over distinct values instead of rows. A batch adds up its
    draws, so it emits one row per (group, replica). A replica of a small group in which no row is
    drawn has no mean and is left out.
    """
    keys = list(keys)
    counts = Q.value_counts(df.select(*keys, F.col(value).cast("double").alias("value")), keys)
    # the draws of a value depend on the value alone, not on where its row is processed
    seeded = counts.withColumn("_seed", F.xxhash64(*keys, "value", F.lit(seed)))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, part in batch.groupby(keys, sort=False):
                weight, total = np.zeros(replicas), np.zeros(replicas)
                for v, n, s in zip(part["value"], part["n"], part["_seed"]):
                    w = np.random.default_rng(np.uint64(s % 2**64)).poisson(n, replicas)
                    weight += w
                    total += w * v
                out = pd.DataFrame({"replica": np.arange(replicas), "w": weight, "wx": total})
                for name, k in zip(keys, key if isinstance(key, tuple) else (key,)):
                    out[name] = k
                yield out[keys + ["replica", "w", "wx"]]

    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema if f.name in keys)
    drawn = seeded.mapInPandas(draw, f"{key_schema}, replica long, w double, wx double")
    means = drawn.groupBy(*keys, "replica").agg(F.try_divide(F.sum("wx"), F.sum("w")).alias("m"))
    # ``replicas`` rows per group
    interval = means.groupBy(*keys).agg(
        F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"))
    centre = counts.groupBy(*keys).agg(
        F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("mean"))
    return centre.join(interval, keys).select(
        *keys, "n", rounded(F.col("mean")).alias("mean"),
        rounded(F.col("ci_low")).alias("ci_low"), rounded(F.col("ci_high")).alias("ci_high"))


def _hash32(text: Column) -> Column:
    return F.conv(F.left(F.md5(text), F.lit(8)), 16, 10).cast("bigint")


def mean_sliced_interval(df: DataFrame, keys: Sequence[str], value: str, unit: str, replicas: int = 1000, slices: int = SLICES,
                         seed: int = fv.SEED) -> DataFrame:
    """Mean with the 2.5% and 97.5% points of a Poisson bootstrap, in column functions only.

    The rows are dealt by a hash of ``unit`` (an id) to ``slices``, and a replica weights each slice by a hash-seeded
    Poisson(1) draw. Rows of one unit, the null one among them, are drawn together. A group of few rows has
    about one row a slice and so the bootstrap of rows; one of many has random slices, whose spread
    tells the mean's up to a relative error of 1 / sqrt(2 * slices), 2 %. Only sums per group and slice
    are shuffled; they add up over batches. The draws are broadcast: ``slices`` times ``replicas`` bytes.
    """
    keys = list(keys)
    kept = df.where(F.col(value).isNotNull())
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    dealt = F.pmod(_hash32(F.coalesce(F.col(unit).cast("string"), F.lit(""))), F.lit(slices)).cast("int")
    sums = kept.groupBy(*keys, dealt.alias("_slice")).agg(F.count(value).alias("n"), F.sum(F.col(value).cast("double")).alias("x"))

    def draw(replica: Column) -> Column:
        hashed = _hash32(F.concat_ws(":", F.col("id").cast("string"), replica.cast("string"), F.lit(str(seed))))
        # the hash is bound once, then compared with each step
        return F.element_at(F.transform(F.array(hashed), lambda h: sum(((h >= t).cast("int") for t in POISSON), F.lit(0))), 1).cast("byte")

    draws = df.sparkSession.range(slices).select(
        F.col("id").cast("int").alias("_slice"), F.transform(F.sequence(F.lit(0), F.lit(replicas - 1)), draw).alias("_draws"))
    drawn = sums.join(F.broadcast(draws), "_slice").select(*keys, "n", "x", F.posexplode("_draws").alias("replica", "w"))
    means = drawn.groupBy(*keys, "replica").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    interval = means.groupBy(*keys).agg(
        F.percentile("m", F.lit(0.025)).alias("ci_low"), F.percentile("m", F.lit(0.975)).alias("ci_high"))
    centre = sums.groupBy(*keys).agg(F.sum("n").alias("n"), (F.sum("x") / F.sum("n")).alias("mean"))
    return centre.join(interval, keys).select(
        *keys, "n", rounded(F.col("mean")).alias("mean"),
        rounded(F.col("ci_low")).alias("ci_low"), rounded(F.col("ci_high")).alias("ci_high"))
