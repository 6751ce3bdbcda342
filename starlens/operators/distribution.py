"""Histograms, kernel density, box statistics and capped columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.functions import fixed_values as fv
from starlens.functions.formatting import rounded
from starlens.operators import quantiles as Q

NUMERIC = ["Star_Rating", "Word_Count", "Review_Length_Chars", "Thumbs_Up_Count", "Sentiment_Polarity"]
REACH = 9.0


def _bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """0-based bin; the last bin is closed. A constant column falls into bin 0."""
    width = (high - low) / F.lit(float(bins))
    raw = F.when(high > low, F.floor((value - low) / width)).otherwise(F.lit(0))
    return F.least(raw, F.lit(bins - 1)).cast("int")


def histogram(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """Equal-width bins over min..max of each column, empty bins included.

    Values are counted before they are binned, so the rows are read once and the edges come
    from the much smaller table of distinct values.
    """
    counts = Q.value_counts(Q.stacked(df, columns), ["column"])
    # reading n here too makes both uses of the counts alike, so they share one shuffle
    edges = counts.groupBy("column").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("total")).where("total > 0")
    # one row per column of the schema
    binned = counts.join(F.broadcast(edges), "column").select(
        "column", _bin_of(F.col("value"), F.col("low"), F.col("high"), bins).alias("bin"), "n"
    )
    filled = binned.groupBy("column", "bin").agg(F.sum("n").alias("n"))
    spine = edges.select("column", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    return spine.join(filled, ["column", "bin"], "left").select(
        "column", "bin",
        rounded(F.col("low") + F.col("bin") * width, 6).alias("bin_from"),
        rounded(F.col("low") + (F.col("bin") + 1) * width, 6).alias("bin_to"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def histogram_zoom(df: DataFrame, column: str = "Thumbs_Up_Count", top: int = fv.ZOOM_MAX, bins: int = 50) -> DataFrame:
    return histogram(df.where(F.col(column) <= top), [column], bins)


def histogram_log(df: DataFrame, column: str = "Thumbs_Up_Count", bins: int = 50) -> DataFrame:
    """Bins of equal width in log10(value + 1)."""
    return histogram(df.select(F.log10(F.col(column) + 1).alias("log10_" + column)), ["log10_" + column], bins)


def kde(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian kernel density on an even grid over min..max, Scott's bandwidth.

    A distinct value adds to the grid points within REACH bandwidths, beyond which its share is
    below a double's last digit; map tasks combine, so at most ``points`` rows per task are
    shuffled. A column without spread has no density: no rows.
    """
    counts = Q.value_counts(df.select(F.col(column).cast("double").alias("value")), [])
    stats = df.select(F.col(column).cast("double").alias("value")).where("value IS NOT NULL").agg(
        F.min("value").alias("low"), F.max("value").alias("high"),
        F.count("value").alias("total"), F.stddev_samp("value").alias("sd"),
    ).select(F.struct(
        "low", "high", "total",
        (F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2))).alias("bandwidth"),
        ((F.col("high") - F.col("low")) / F.lit(float(points - 1))).alias("step"),
    ).alias("s"))
    spread = counts.withColumn("s", stats.scalar()).select("value", "n", "s.*").where("bandwidth > 0")
    reach = F.lit(REACH) * F.col("bandwidth")
    first = F.greatest(F.ceil((F.col("value") - reach - F.col("low")) / F.col("step")), F.lit(0))
    last = F.least(F.floor((F.col("value") + reach - F.col("low")) / F.col("step")), F.lit(points - 1))
    near = spread.withColumn("point", F.explode(F.sequence(first, last)))
    # points that no value reaches
    spine = stats.select("s.*").where("bandwidth > 0").select(
        F.lit(None).cast("double").alias("value"), F.lit(0).cast("bigint").alias("n"), "*",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint"))).alias("point"))
    x = F.col("low") + F.col("point") * F.col("step")
    z = (x - F.col("value")) / F.col("bandwidth")
    norm = F.col("total") * F.col("bandwidth") * F.sqrt(F.lit(2.0) * F.pi())
    share = F.coalesce(F.col("n") * F.exp(F.lit(-0.5) * z * z) / norm, F.lit(0.0))
    return near.unionByName(spine).groupBy(F.col("point").cast("int").alias("point")).agg(
        rounded(F.first(x), 6).alias("x"), rounded(F.sum(share), 6).alias("density"))


def kde_binned(df: DataFrame, column: str, points: int = 200, fine: int = 8) -> DataFrame:
    """``kde`` by linear binning: no distinct value is shuffled.

    A value is split between its two neighbours on a grid ``fine`` times as narrow as that of the points, by nearness; map tasks
    add up the grid's weights. The density at a point is the sum of the kernel over the weights within REACH
    bandwidths. It differs from the exact one by about (grid step / bandwidth)^2 / 8 of its height.
    """
    last = fine * (points - 1)
    values = df.select(F.col(column).cast("double").alias("value")).where("value IS NOT NULL")
    stats = values.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("total"), F.stddev_samp("value").alias("sd")).select(F.struct(
        "low", "high", "total", (F.col("sd") * F.pow(F.col("total").cast("double"), F.lit(-0.2))).alias("bandwidth"),
        ((F.col("high") - F.col("low")) / F.lit(float(last))).alias("step")).alias("s"))
    place = (F.col("value") - F.col("s.low")) / F.col("s.step")
    cell = F.least(F.floor(place), F.lit(last - 1)).cast("int")
    cells = values.withColumn("s", stats.scalar()).where("s.bandwidth > 0").select(cell.alias("cell"), (place - cell).alias("part"), "s") \
        .groupBy("cell").agg(F.sum(1 - F.col("part")).alias("here"), F.sum("part").alias("next"), F.first("s").alias("s"))
    # at most ``last`` rows from here on
    both = F.array(F.struct(F.col("cell").alias("at"), F.col("here").alias("w")), F.struct((F.col("cell") + 1).alias("at"), F.col("next").alias("w")))
    weights = cells.select("s", F.inline(both)).select("s.*", "at", "w")
    reach = F.lit(REACH) * F.col("bandwidth") / F.col("step")
    first = F.greatest(F.ceil((F.col("at") - reach) / fine), F.lit(0)).cast("int")
    final = F.least(F.floor((F.col("at") + reach) / fine), F.lit(points - 1)).cast("int")
    # a weight between two points too far from both reaches none
    near = weights.withColumn("point", F.explode(F.when(first <= final, F.sequence(first, final))))
    spine = stats.select("s.*").where("bandwidth > 0").select("*", F.lit(0).alias("at"), F.lit(0.0).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    z = (F.col("point") * fine - F.col("at")) * F.col("step") / F.col("bandwidth")
    share = F.col("w") * F.exp(F.lit(-0.5) * z * z) / (F.col("total") * F.col("bandwidth") * F.sqrt(F.lit(2.0) * F.pi()))
    return near.unionByName(spine).groupBy("point").agg(
        rounded(F.first(F.col("low") + F.col("point") * fine * F.col("step")), 6).alias("x"), rounded(F.sum(share), 6).alias("density"))


def box_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles, whiskers at the last value within 1.5 IQR, and the rows beyond them."""
    counts = Q.value_counts(df, [key], value)
    cum = Q.cumulative(counts, [key], value)
    boxes = cum.groupBy(key).agg(*[Q.quantile_of(p, value).alias(name) for name, p in Q.QUARTILES],
                                 F.max("total").alias("n_rows"))
    reach = F.lit(1.5) * (F.col("q75") - F.col("q25"))
    inside = (F.col(value) >= F.col("q25") - reach) & (F.col(value) <= F.col("q75") + reach)
    return cum.join(boxes, key).groupBy(key).agg(
        F.first("n_rows").alias("n_rows"),
        rounded(F.first("q25")).alias("q25"),
        rounded(F.first("q50")).alias("q50"),
        rounded(F.first("q75")).alias("q75"),
        rounded(F.min(F.when(inside, F.col(value)))).alias("whisker_low"),
        rounded(F.max(F.when(inside, F.col(value)))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
    )


def cap_value(df: DataFrame, column: str, p: float = fv.WINSOR_QUANTILE) -> DataFrame:
    """One row: the exact p-quantile of a column."""
    return Q.quantiles(df.select(F.col(column).cast("double").alias(column)), [], column, [("cap", p)])


def winsorize(df: DataFrame, column: str = "Thumbs_Up_Count", out: str = "Thumbs_Up_Capped",
              p: float = fv.WINSOR_QUANTILE) -> DataFrame:
    """Cap a column at its exact p-quantile. The cap reaches the rows as a scalar subquery."""
    cap = cap_value(df, column, p).select("cap").scalar()
    return df.withColumn(out, F.least(F.col(column).cast("double"), cap))
