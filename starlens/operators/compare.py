"""Comparing products."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions import fixed_values as fv
from starlens.functions.formatting import fixed
from starlens.operators import aggregate as A

METRICS = ["total_reviews", "avg_star", "avg_sentiment", "std_dev", "five_star_pct", "one_star_pct", "top_pain_point"]


def product_cards(df: DataFrame, exclude=(fv.DEFAULT_THEME,)) -> DataFrame:
    """One row of KPIs per product: overview, shares of the extremes, top theme.

    Reviews are added up per product and theme, whatever themes are stored, and these few rows per
    product: one shuffle of sums, one of the sums of sums. Star sums are whole numbers, so the
    variance from them is exact.
    """
    star = F.col("Star_Rating").cast("double")
    per_theme = df.groupBy("App", "Review_Theme").agg(
        F.count(F.lit(1)).alias("n"), F.count(star).alias("n_star"), F.sum(star).alias("sum_star"), F.sum(star * star).alias("sum_square"),
        F.sum("Sentiment_Polarity").alias("sum_sentiment"), F.count("Sentiment_Polarity").alias("n_sentiment"),
        F.count_if(star == 5).alias("five"), F.count_if(star == 1).alias("one"))
    counted = F.col("Review_Theme").isNotNull() & ~F.coalesce(F.col("Review_Theme").isin(list(exclude)), F.lit(False))
    sums = per_theme.groupBy("App").agg(
        *[F.sum(c).alias(c) for c in per_theme.columns[2:]],
        F.min(F.when(counted, F.struct((-F.col("n")).alias("neg_n"), F.col("Review_Theme").alias("theme")))).alias("_best"))
    mean = F.try_divide(F.col("sum_star"), F.col("n_star"))
    variance = F.try_divide(F.col("sum_square") - F.col("sum_star") * mean, F.col("n_star") - 1)
    return sums.select(
        F.col("n").alias("total_reviews"),
        A.rounded(mean).alias("avg_star"),
        A.rounded(F.try_divide(F.col("sum_sentiment"), F.col("n_sentiment"))).alias("avg_sentiment"),
        A.rounded(F.when(F.col("n_star") > 1, F.sqrt(F.greatest(variance, F.lit(0.0))))).alias("std_dev"),
        A.percent(F.col("five"), F.col("n")).alias("five_star_pct"),
        A.percent(F.col("one"), F.col("n")).alias("one_star_pct"),
        "App", F.col("_best.theme").alias("top_pain_point"))


def _side_by_side(cards: DataFrame, key: str, values: list, names: list[str]) -> DataFrame:
    """Metrics as rows, the chosen products as columns."""
    cells = F.array(*[
        F.struct(F.lit(m).alias("metric"),
                 (F.col(m) if m == "top_pain_point" else F.col(m).cast("string") if m == "total_reviews"
                  else fixed(F.col(m), 4)).alias("value"))
        for m in METRICS
    ])
    long = cards.where(F.col(key).isin(values)).select(key, F.inline(cells))
    picked = [F.max(F.when(F.col(key) == v, F.col("value"))).alias(n) for v, n in zip(values, names)]
    return long.groupBy("metric").agg(*picked)


def compare_two(df: DataFrame, first: str, second: str) -> DataFrame:
    """Two named products head to head. Only their rows are read."""
    cards = product_cards(df.where(F.col("App").isin(first, second)))
    return _side_by_side(cards, "App", [first, second], ["first", "second"])


def compare_top2(df: DataFrame) -> DataFrame:
    """The two best rated products; here the default theme may be the top one."""
    ranked = A.product_ranking(product_cards(df, exclude=()))
    return _side_by_side(ranked, "rank", [1, 2], ["first", "second"])


def theme_compare(counts: DataFrame, first: str, second: str) -> DataFrame:
    """Theme counts of two products, 0 where a product lacks a theme."""
    def of(app):
        return F.coalesce(F.sum(F.when(F.col("App") == app, F.col("n"))), F.lit(0))

    chosen = counts.where(F.col("App").isin(first, second))
    return chosen.groupBy("Review_Theme").agg(of(first).alias("first"), of(second).alias("second"))


def insight_banner(published: DataFrame) -> DataFrame:
    """Best, worst, most positive and most polarised product; ties go to the first name."""
    def best(metric, sign):
        key = F.struct((F.lit(sign) * F.col(metric)).alias("a"), F.col("App").alias("b"))
        return F.min_by(F.struct("App", F.col(metric).alias("value")), key)

    facts = {
        "highest rated": best("avg_star", -1.0),
        "lowest rated": best("avg_star", 1.0),
        "most positive": best("avg_sentiment", -1.0),
        "most polarised": best("std_dev", -1.0),
    }
    one = published.agg(*[b.alias(f"f{i}") for i, b in enumerate(facts.values())])
    cells = F.array(*[
        F.struct(F.lit(name).alias("fact"), F.col(f"f{i}.App").alias("App"), F.col(f"f{i}.value").alias("value"))
        for i, name in enumerate(facts)
    ])
    return one.select(F.inline(cells))


def product_banner(df: DataFrame) -> DataFrame:
    """Facts per product: rank, sentiment, shares of the extremes, top pain point."""
    return A.product_ranking(product_cards(df)).select(
        "App", "rank", fixed(F.col("avg_star"), 2).alias("rating"), fixed(F.col("avg_sentiment"), 3).alias("sentiment"),
        "five_star_pct", "one_star_pct", "top_pain_point")
