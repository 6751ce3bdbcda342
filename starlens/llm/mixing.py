"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many sources their rates are sent to every task; more are joined by a salted shuffle.
BROADCAST_SOURCES = 10_000
SALTS = 64
SEED = 42


def uniform(key: Column) -> Column:
    """52 bits of a hash as a number from 0 to below 1."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2 ** 52))


def cumulative(rate: Column) -> Column:
    """The Poisson distribution of mean ``rate`` up to where a double can't tell it from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct((-rate).alias("log_p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("all"))

    def step(s: Column, k: Column) -> Column:
        log_p = s["log_p"] + F.ln(rate) - F.ln(k.cast("double"))
        total = s["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.concat(s["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["all"])


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.7, epochs: float = 1.0,
          source_column: str = "source", text_column: str = "text") -> DataFrame:
    """Per source its size in bytes and the mean repetition that gives it its target share.

    ``weights``: target shares by source, in any unit; sources not named get none. Without it the
    shares go with size ** ``power``. The mix is ``epochs`` times the corpus. A null source is a
    source of its own, named in ``weights`` by None; a source without a byte counts as one byte.
    """
    size = F.greatest(F.sum(F.octet_length(F.col(text_column).cast("string"))), F.lit(1)).cast("double")
    sizes = docs.groupBy(F.col(source_column).alias("source")).agg(F.coalesce(size, F.lit(1.0)).alias("bytes"))
    if weights is None:
        share = F.pow("bytes", F.lit(power))
    else:
        share = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), float(w)) for s, w in weights.items()], F.lit(0.0))
    shares = sizes.withColumn("share", share)
    total = shares.agg(F.sum("bytes").alias("bytes"), F.sum("share").alias("share")).first()
    scale = epochs * (total["bytes"] or 0.0) / (total["share"] or 1.0)
    return shares.select("source", "bytes", (F.lit(scale) * F.col("share") / F.col("bytes")).alias("rate"))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, power: float = 0.7, epochs: float = 1.0, seed: int = SEED,
        id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """Each document as often as its draw says, in random order over the whole mix.

    The draw inverts the Poisson distribution of the source's rate at a hash of seed and id, so it
    doesn't depend on the run; rows of one id share it. Adds ``copy`` (from 1), ``rate`` and
    ``shuffle_key``; input columns of these names are replaced. Rows are dealt by the hash of
    (id, copy) and sorted by it within a partition: files hold random parts in random order.
    """
    rate = rates(docs, weights, power, epochs, source_column, text_column).where(F.col("rate") > 0) \
        .select(F.col("source").alias("_mix_source"), "rate", cumulative(F.col("rate")).alias("_mix_cdf"))
    docs = docs.drop("copy", "rate", "shuffle_key")
    here = F.col(source_column).eqNullSafe(F.col("_mix_source"))
    few = rate.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    if few:
        joined = docs.join(F.broadcast(rate), here)
    else:
        # a source may hold a third of all rows: its rate is repeated for every salt
        salted = rate.withColumn("_mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn("_mix_row_salt", F.pmod(F.xxhash64(id_column), F.lit(SALTS)).cast("int")) \
            .join(salted, here & (F.col("_mix_row_salt") == F.col("_mix_salt"))).drop("_mix_row_salt", "_mix_salt")
    key = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    u = uniform(F.concat(F.lit(f"{seed}:"), key))
    count = F.size(F.filter("_mix_cdf", lambda c: c <= F.col("_mix_u")))
    drawn = joined.withColumn("_mix_u", u).withColumn("_mix_n", count).where(F.col("_mix_n") > 0) \
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).drop("_mix_source", "_mix_cdf", "_mix_u", "_mix_n")
    mixed = drawn.withColumn("shuffle_key", F.substring(F.md5(F.concat(F.lit(f"{seed}#"), key, F.lit("#"), F.col("copy").cast("string"))), 1, 16))
    return mixed.repartition("shuffle_key").sortWithinPartitions("shuffle_key")


def mix_sql(power: float = 0.7, epochs: float = 1.0, seed: int = SEED) -> str:
    return f"""WITH s AS (SELECT source, greatest(coalesce(sum(strlen(text)), 1), 1)::DOUBLE AS bytes FROM documents GROUP BY source),
    r AS (SELECT source, {epochs}::DOUBLE * (SELECT sum(bytes) FROM s) / (SELECT sum(pow(bytes, {power})) FROM s) * pow(bytes, {power}) / bytes AS rate FROM s),
    k AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS INTEGER) + 1)) AS k FROM r),
    c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS below FROM k),
    d AS (SELECT *, ('0x' || md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:13])::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
    n AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, u, count(*) AS n FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND below <= u GROUP BY ALL)
    SELECT doc_id, text, lang, source, n_chars, copy, md5('{seed}#' || coalesce(CAST(doc_id AS VARCHAR), '') || '#' || copy)[1:16] AS shuffle_key
    FROM (SELECT *, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM n)"""
