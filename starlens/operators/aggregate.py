"""Per-product tables and their roll-ups. Group keys are few, so partial aggregation leaves
one row per (task, key) to shuffle, however uneven the products are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlens.functions import dates
from starlens.functions import fixed_values as fv
from starlens.functions.formatting import mean, percent, rounded
from starlens.operators.topn import first_n

STARS = range(1, 6)


def overview(df: DataFrame) -> DataFrame:
    """Reviews, mean star, mean sentiment and sample standard deviation per product."""
    return df.groupBy("App").agg(
        F.count(F.lit(1)).alias("total_reviews"),
        mean(F.col("Star_Rating")).alias("avg_star"),
        mean(F.col("Sentiment_Polarity")).alias("avg_sentiment"),
        rounded(F.stddev_samp("Star_Rating")).alias("std_dev"),
    )


def rating_distribution(df: DataFrame) -> DataFrame:
    """(App, star, n) with all five stars present. One pass: five conditional counts per product,
    then unpivoted."""
    star = F.col("Star_Rating")
    wide = df.groupBy("App").agg(*[F.count_if(star == s).alias(f"s{s}") for s in STARS])
    cells = F.array(*[F.struct(F.lit(s).alias("star"), F.col(f"s{s}").alias("n")) for s in STARS])
    return wide.select("App", F.inline(cells))


def rating_rollup(df: DataFrame) -> DataFrame:
    return rating_distribution(df).groupBy("star").agg(F.sum("n").alias("n"))


def theme_counts(df: DataFrame) -> DataFrame:
    """(App, Review_Theme, n); rows without a theme are left out."""
    return df.where("Review_Theme IS NOT NULL").groupBy("App", "Review_Theme").agg(F.count(F.lit(1)).alias("n"))


def theme_rollup(counts: DataFrame) -> DataFrame:
    return counts.groupBy("Review_Theme").agg(F.sum("n").alias("n"))


def theme_share(counts: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("App"))  # one row per theme
    return counts.select("App", "Review_Theme", "n", percent(F.col("n"), total).alias("share_pct"))


def series_parts(df: DataFrame, bucket: Column, name: str) -> DataFrame:
    """Sums and counts per (App, bucket): parts that can be added up over time and batches."""
    return (
        df.withColumn(name, bucket).where(F.col(name).isNotNull()).groupBy("App", name).agg(
            F.sum("Sentiment_Polarity").alias("sum_sentiment"),
            F.count("Sentiment_Polarity").alias("n_sentiment"),
            F.sum("Star_Rating").cast("double").alias("sum_star"),
            F.count("Star_Rating").alias("n"),
        )
    )


def add_parts(parts: DataFrame, name: str) -> DataFrame:
    return parts.groupBy("App", name).agg(
        *[F.sum(c).alias(c) for c in ("sum_sentiment", "n_sentiment", "sum_star", "n")])


def series_from_parts(parts: DataFrame, name: str) -> DataFrame:
    """Means from parts; null where nothing was counted."""
    def ratio(top, bottom):
        return rounded(F.try_divide(F.col(top), F.col(bottom)))

    return parts.select("App", name, ratio("sum_sentiment", "n_sentiment").alias("avg_sentiment"),
                        ratio("sum_star", "n").alias("avg_star"), "n")


def daily_series(df: DataFrame) -> DataFrame:
    return series_from_parts(series_parts(df, dates.day_key(F.col("Review_Date")), "day"), "day")


def monthly_series(df: DataFrame) -> DataFrame:
    return series_from_parts(series_parts(df, dates.month_key(F.col("Review_Date")), "month"), "month")


def monthly_from_daily(daily_parts: DataFrame) -> DataFrame:
    """The monthly series added up from stored daily parts instead of from the reviews."""
    parts = daily_parts.withColumn("month", F.substring("day", 1, 7))
    return series_from_parts(add_parts(parts, "month"), "month")


def daily_scaled(daily: DataFrame) -> DataFrame:
    return daily.select("App", "day", "avg_sentiment", rounded(F.col("avg_star") / 5, 6).alias("avg_star_scaled"))


def series_compare(daily: DataFrame, apps: list[str]) -> DataFrame:
    """Sentiment per day with one column per product, aligned by date."""
    return daily.groupBy("day").pivot("App", apps).agg(F.first("avg_sentiment"))


def kpi_rollup(df: DataFrame) -> DataFrame:
    """Products and the 'All' row in one pass; 'All' has no standard deviation."""
    return df.rollup("App").agg(
        F.grouping("App").alias("is_all"),
        F.count(F.lit(1)).alias("total_reviews"),
        mean(F.col("Star_Rating")).alias("avg_star"),
        mean(F.col("Sentiment_Polarity")).alias("avg_sentiment"),
        rounded(F.stddev_samp("Star_Rating")).alias("std_dev"),
    ).select(
        F.when(F.col("is_all") == 1, "All").otherwise(F.col("App")).alias("App"),
        "total_reviews", "avg_star", "avg_sentiment",
        F.when(F.col("is_all") == 0, F.col("std_dev")).alias("std_dev"),
    )


def weighted_all(published: DataFrame) -> DataFrame:
    """The 'All' row from a published overview: means weighted by review counts."""
    n = F.col("total_reviews")
    return published.agg(
        F.sum(n).alias("total_reviews"),
        rounded(F.sum(F.col("avg_star") * n) / F.sum(n)).alias("avg_star"),
        rounded(F.sum(F.col("avg_sentiment") * n) / F.sum(n)).alias("avg_sentiment"),
    )


def star_shares(df: DataFrame) -> DataFrame:
    star, n = F.col("Star_Rating"), F.count(F.lit(1))
    return df.groupBy("App").agg(
        percent(F.count_if(star == 5), n).alias("five_star_pct"),
        percent(F.count_if(star == 1), n).alias("one_star_pct"))


def star_bands(df: DataFrame) -> DataFrame:
    star = F.col("Star_Rating")
    return df.groupBy("App").agg(
        F.count_if(star >= fv.POSITIVE_MIN_STAR).alias("positive"),
        F.count_if(star <= fv.NEGATIVE_MAX_STAR).alias("negative"),
        F.count_if(star == 1).alias("one_star"),
        F.count_if(star == 5).alias("five_star"))


def top_theme(counts: DataFrame, exclude: tuple[str, ...] = (fv.DEFAULT_THEME,)) -> DataFrame:
    """The most frequent theme per product; ``exclude=()`` lets the default theme win."""
    # the exclusion stays inside the aggregate: as a filter it would be pushed down to the reviews
    # and classify every text a second time
    theme, n = F.col("Review_Theme"), F.col("n")
    kept = ~theme.isin(list(exclude)) if exclude else F.lit(True)
    # equal counts: the theme that sorts first
    best = F.min(F.when(kept, F.struct((-n).alias("a"), theme.alias("b"))))
    return counts.groupBy("App").agg(best.alias("t")).where("t IS NOT NULL").select(
        "App", F.col("t.b").alias("top_theme"), (-F.col("t.a")).alias("theme_reviews"))


def product_ranking(published: DataFrame) -> DataFrame:
    """Rank by mean star. One row per product, so one window task is enough."""
    window = Window.orderBy(F.desc("avg_star"), F.asc("App"))
    return published.withColumn("rank", F.row_number().over(window)).select("rank", *published.columns)


def polarisation_ranking(published: DataFrame) -> DataFrame:
    window = Window.orderBy(F.desc("std_dev"), F.asc("App"))
    return published.select(F.row_number().over(window).alias("rank"), "App", "std_dev")


def uplift_vs_median(published: DataFrame) -> DataFrame:
    median = published.agg(F.median("avg_star").alias("m")).scalar()
    return published.select("App", "avg_star", rounded(median).alias("median_star"),
                            percent(F.col("avg_star") - median, median, 2).alias("uplift_pct"))


def market_overview(published: DataFrame, counts: DataFrame) -> DataFrame:
    """Overview with the top pain point and its share of the product's reviews."""
    pain = top_theme(counts)
    return published.join(pain, "App", "left").select(
        "App", "avg_star", "avg_sentiment", F.col("top_theme").alias("top_pain_point"),
        percent(F.col("theme_reviews"), F.col("total_reviews")).alias("pain_share_pct"))


def star_sentiment_corr(df: DataFrame) -> DataFrame:
    """Correlation of star and sentiment per product and over all, over rows that have both."""
    both = df.where("Star_Rating IS NOT NULL AND Sentiment_Polarity IS NOT NULL")
    return both.rollup("App").agg(
        F.grouping("App").alias("is_all"),
        rounded(F.corr(F.col("Star_Rating").cast("double"), F.col("Sentiment_Polarity"))).alias("corr"),
        F.count(F.lit(1)).alias("n"),
    ).select(F.when(F.col("is_all") == 1, "All").otherwise(F.col("App")).alias("App"), "corr", "n")


def zero_share(df: DataFrame) -> DataFrame:
    zero = F.col("Sentiment_Polarity") == 0
    return df.groupBy("App").agg(percent(F.count_if(zero), F.count("Sentiment_Polarity"), 2).alias("zero_pct"))


def sample_reviews(df: DataFrame, n: int = fv.SAMPLES_PER_SIDE, chars: int = fv.SAMPLE_TEXT_CHARS) -> DataFrame:
    """The n most negative one-star and n most positive five-star reviews per product, the text
    cut to ``chars`` for display."""
    star = F.col("Star_Rating")
    sides = df.where(star.isin(1, 5)).withColumn("side", F.when(star == 1, "negative").otherwise("positive"))
    signed = F.when(star == 1, F.col("Sentiment_Polarity")).otherwise(-F.col("Sentiment_Polarity"))
    order = [signed.asc_nulls_last(), F.col("Review_Date").asc_nulls_last(), F.col("review_id").asc()]
    chosen = first_n(
        sides.select("App", "side", "Star_Rating", "Sentiment_Polarity", "Review_Date", "review_id",
                     F.left("Review_Text", F.lit(chars)).alias("text")),
        ["App", "side"], order, n)
    return chosen.select("App", "side", "rank", F.col("Star_Rating").alias("star"), "text", "review_id")


def most_negative(df: DataFrame, n: int = fv.MOST_NEGATIVE) -> DataFrame:
    """The n one-star reviews of each product with the lowest sentiment."""
    order = [F.col("Sentiment_Polarity").asc_nulls_last(), F.col("Review_Date").asc_nulls_last(), F.col("review_id").asc()]
    return first_n(df.where("Star_Rating = 1"), ["App"], order, n)


def viral(df: DataFrame, at_least: int = fv.VIRAL_MIN) -> DataFrame:
    return df.where(F.col("Thumbs_Up_Count") >= at_least)


def viral_head(df: DataFrame, at_least: int = fv.VIRAL_MIN, n: int = fv.VIRAL_HEAD) -> DataFrame:
    return (
        viral(df, at_least).select("App", "Star_Rating", "Thumbs_Up_Count", "Review_Theme", "review_id")
        .orderBy(F.desc("Thumbs_Up_Count"), F.asc("review_id")).limit(n)
    )


def sample_union(samples: DataFrame) -> DataFrame:
    """Both sides of all products as one list."""
    neg = samples.where("side = 'negative'")
    return neg.unionByName(samples.where("side = 'positive'")).select("App", "side", "rank", "star", "text")
