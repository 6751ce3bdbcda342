"""Shards of bounded size by extendible hashing.

A directory is indexed by the leading bits of a document's hash. Starting from one bucket, only
buckets over the byte limit split, on one more bit, until each fits. Sizes are known for all
prefixes of a cell at once, from one small table of cells, so no pass over the documents is
needed per bit; cells that are still too large are refined from their own documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import written

LIMIT_BYTES = 64 << 20
#: Bits of the hash, and bits by which a cell is finer than the mean shard.
BITS, FINER = 60, 3


def bits(key: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _prefix(depth: int | Column, of: str = "_bits") -> Column:
    if isinstance(depth, int):
        return F.shiftright(F.col(of), BITS - depth)
    return F.expr(f"shiftright({of}, {BITS} - _depth)")


def directory(sized: DataFrame, limit: int = LIMIT_BYTES) -> DataFrame:
    """The leaves for rows (_bits, _bytes): ``depth``, ``prefix``, ``shard_bytes``, ``shard_docs``.

    A leaf fits the limit and its parent doesn't. Rows of one hash can't be parted: alone over the
    limit they make a leaf of their own, the only kind that is too large.
    """
    spark = sized.sparkSession
    total = sized.agg(F.sum("_bytes").alias("n")).first()["n"] or 0
    leaves, left, low = None, sized, 0
    high = min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + FINER)
    while True:
        cells = left.groupBy(_prefix(high).alias("_cell")).agg(
            F.sum("_bytes").alias("b"), F.count("*").alias("n"), F.min("_bits").alias("one"), F.max("_bits").alias("other"))
        cells = written(cells, "cells")
        levels = F.explode(F.sequence(F.lit(low), F.lit(high)))
        nodes = cells.withColumn("depth", levels).groupBy("depth", F.expr(f"shiftright(_cell, {high} - depth)").alias("prefix")).agg(
            F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_docs"), F.min("one").alias("one"), F.max("other").alias("other"))
        nodes = nodes.withColumn("done", (F.col("shard_bytes") <= limit) | (F.col("one") == F.col("other")))
        parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"), F.col("done").alias("up_done"))
        found = nodes.withColumn("up", F.shiftright("prefix", 1)).join(parents, ["depth", "up"], "left") \
            .where(F.col("done") & ~F.coalesce("up_done", F.lit(False))).select("depth", "prefix", "shard_bytes", "shard_docs")
        leaves = found if leaves is None else leaves.unionByName(found)
        over = written(nodes.where(~F.col("done") & (F.col("depth") == high)).select(F.col("prefix").alias("_cell")), "over")
        if high == BITS or over.isEmpty():
            return leaves
        # prefixes at the new first level have parents that don't fit
        left = left.withColumn("_cell", _prefix(high)).join(over, "_cell", "left_semi").drop("_cell")
        low, high = high + 1, min(BITS, high + 8)


def shards(docs: DataFrame, limit: int = LIMIT_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its ``n_bytes`` and shard: ``shard`` (the leaf's bits, '' for a single shard), ``shard_depth``, ``shard_bytes``, ``shard_docs``.

    A null text has no bytes. Rows of one id share a hash and so a shard, also if together they
    exceed the limit, as does a document that is larger alone. Other columns are ignored.
    """
    sized = written(docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.octet_length(F.col(text_column).cast("string")), F.lit(0)).cast("long").alias("_bytes"))
                    .withColumn("_bits", bits(F.col("doc_id"))), "sized")
    leaves = written(directory(sized, limit), "leaves")
    return assigned(sized, leaves).select("doc_id", F.col("_bytes").alias("n_bytes"), "shard", "shard_depth", "shard_bytes", "shard_docs")


def assigned(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Rows with ``_bits`` and the leaf that their leading bits lead to, looked up at all depths in use at once."""
    depths = sorted(r["depth"] for r in leaves.select("depth").distinct().collect())  # at most BITS + 1
    if len(depths) < 2:
        only = depths[0] if depths else 0
        tried = rows.withColumn("depth", F.lit(only)).withColumn("prefix", _prefix(only))
    else:
        tried = rows.withColumn("_depth", F.explode(F.array(*[F.lit(d) for d in depths]))).withColumn("prefix", _prefix(F.col("_depth"))).withColumnRenamed("_depth", "depth")
    label = F.when(F.col("depth") == 0, "").otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return tried.join(leaves, ["depth", "prefix"]).withColumn("shard", label).withColumnRenamed("depth", "shard_depth").drop("prefix")


def write_shards(docs: DataFrame, target: str, limit: int = LIMIT_BYTES, id_column: str = "doc_id", text_column: str = "text") -> None:
    """All columns of ``docs`` as Parquet, one folder ``shard=<bits>`` per shard ('' is 'all')."""
    places = shards(docs, limit, id_column, text_column).select(F.col("doc_id").alias("_id"), "shard").distinct()
    out = docs.drop("shard").join(places, F.col(id_column).eqNullSafe(F.col("_id"))).drop("_id") \
        .withColumn("shard", F.when(F.col("shard") == "", "all").otherwise(F.col("shard")))
    out.repartition("shard").write.partitionBy("shard").parquet(target)


def shards_sql(limit: int = LIMIT_BYTES, depth: int = 24) -> str:
    """For DuckDB over ``documents``; ``depth`` bits are enough for the tables it is checked on."""
    return f"""WITH d AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes, ('0x' || md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15])::BIGINT AS bits FROM documents),
    p AS (SELECT doc_id, n_bytes, bits, k AS depth, bits >> ({BITS} - k) AS prefix FROM d, range({depth + 1}) t(k)),
    n AS (SELECT depth, prefix, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs, min(bits) = max(bits) AS one FROM p GROUP BY ALL),
    f AS (SELECT p.*, shard_bytes, shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS place FROM p JOIN n USING (depth, prefix) WHERE shard_bytes <= {limit} OR one)
    SELECT doc_id, n_bytes::BIGINT AS n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INTEGER), '0') END AS shard, CAST(depth AS INTEGER) AS shard_depth,
      shard_bytes::BIGINT AS shard_bytes, shard_docs FROM f WHERE place = 1"""
