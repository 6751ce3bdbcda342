"""Tables and text lines behind the weekly reports. Inputs are published tables: one row per
product, or n ranked keywords per product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions import formatting as fm
from starlens.operators import aggregate as A
from starlens.operators import keywords as K


def ranking_rows(published: DataFrame) -> DataFrame:
    return A.product_ranking(published).select(
        "rank", fm.product_label(F.col("App")).alias("product"),
        fm.star_glyphs(F.col("avg_star")).alias("stars"),
        fm.fixed(F.col("avg_star"), 2).alias("rating"),
        fm.fixed(F.col("avg_sentiment"), 3).alias("sentiment"),
        fm.sentiment_band(F.col("avg_sentiment")).alias("band"),
        fm.thousands(F.col("total_reviews")).alias("reviews"))


def kpi_cards(rollup: DataFrame) -> DataFrame:
    """Long form of the KPI blocks, 'All' included; there is no spread card for 'All'."""
    cells = F.array(
        F.struct(F.lit("Total Reviews").alias("label"), fm.thousands(F.col("total_reviews")).alias("value")),
        F.struct(F.lit("Avg Star Rating").alias("label"), fm.fixed(F.col("avg_star"), 2).alias("value")),
        F.struct(F.lit("Avg Sentiment").alias("label"), fm.fixed(F.col("avg_sentiment"), 3).alias("value")),
        F.struct(F.lit("Rating Std Dev").alias("label"),
                 F.when(F.col("App") != "All", fm.fixed(F.col("std_dev"), 2)).alias("value")),
    )
    return rollup.select("App", F.inline(F.filter(cells, lambda c: c["value"].isNotNull())))


def leader_card(published: DataFrame, top: DataFrame, k: int = 6) -> DataFrame:
    """The best rated product with its KPIs and first k positive keywords."""
    leader = A.product_ranking(published).where("rank = 1")
    return leader.join(K.first_words(top, users_say=("positive", k)), "App", "left").select(
        fm.product_label(F.col("App")).alias("product"), fm.fixed(F.col("avg_star"), 2).alias("rating"),
        fm.fixed(F.col("avg_sentiment"), 3).alias("sentiment"),
        fm.thousands(F.col("total_reviews")).alias("reviews"), "users_say")


def concern_rows(published: DataFrame, top: DataFrame, k: int = 3) -> DataFrame:
    """First k negative keywords per product."""
    return published.select("App").join(K.first_words(top, concerns=("negative", k)), "App", "left").select(
        fm.product_label(F.col("App")).alias("product"), "concerns")


def context_lines(published: DataFrame, counts: DataFrame, top: DataFrame) -> DataFrame:
    """One text block per product and report: (report, App, block)."""
    theme = A.top_theme(counts, exclude=())
    themes = counts.groupBy("App").agg(
        F.expr("listagg(concat(Review_Theme, ': ', n), ', ') WITHIN GROUP (ORDER BY n DESC, Review_Theme)").alias("themes"))
    first = K.first_words(top, positive5=("positive", 5), negative5=("negative", 5),
                          positive6=("positive", 6), negative6=("negative", 6))
    rows = published.join(theme, "App", "left").join(themes, "App", "left").join(first, "App", "left")
    label = fm.product_label(F.col("App"))
    star2, star_dev = fm.fixed(F.col("avg_star"), 2), fm.fixed(F.col("std_dev"), 2)
    mood, n = fm.fixed(F.col("avg_sentiment"), 3), fm.thousands(F.col("total_reviews"))
    head = F.concat(label, F.lit(": "), star2, F.lit("★ | sentiment "), mood, F.lit(" | "), n, F.lit(" reviews"))

    def words(c):
        return F.coalesce(F.col(c), F.lit(""))

    def block(*lines):
        return F.concat_ws("\n", *lines)

    def tagged(tag, value):
        return F.concat(F.lit(tag), value)

    blocks = {
        "weekly": block(
            head,
            F.concat(F.lit("  Top theme: "), F.col("top_theme"), F.lit(" ("), fm.thousands(F.col("theme_reviews")), F.lit(" reviews)")),
            tagged("  Top positive keywords: ", words("positive5")),
            tagged("  Top negative keywords: ", words("negative5"))),
        "mail": block(
            head, tagged("  Top theme: ", F.col("top_theme")),
            tagged("  Positive keywords: ", words("positive5")),
            tagged("  Negative keywords: ", words("negative5"))),
        "bot": block(
            tagged("## ", label),
            F.concat(F.lit("- Average Star Rating: "), star2, F.lit(" / 5")),
            tagged("- Average Sentiment Polarity: ", mood),
            tagged("- Rating Std Dev: ", star_dev),
            tagged("- Total Reviews: ", n),
            tagged("- Review Themes: ", F.col("themes")),
            tagged("- Top Positive Keywords: ", words("positive6")),
            tagged("- Top Negative Keywords: ", words("negative6"))),
        "script": F.concat(label, F.lit(": "), star2, F.lit("★, sentiment "), mood, F.lit(", "), n, F.lit(" reviews")),
    }
    cells = F.array(*[F.struct(F.lit(name).alias("report"), b.alias("block")) for name, b in blocks.items()])
    return rows.select("App", F.inline(cells))


def negative_digest(most_negative: DataFrame) -> DataFrame:
    """The n most negative texts of each product as one bulleted block under a request line.

    ``most_negative`` holds at most n rows per product. Null texts are left out.
    """
    joined = F.expr("listagg(Review_Text, '\n- ') WITHIN GROUP (ORDER BY rank)")
    return most_negative.groupBy("App").agg(
        F.count("Review_Text").alias("n_reviews"), joined.alias("_block")
    ).select(
        "App", "n_reviews",
        F.concat(F.lit("Product: "), fm.product_label(F.col("App")),
                 F.lit("\nName the recurring complaints in these one-star reviews and how often each occurs.\n- "),
                 F.coalesce("_block", F.lit(""))).alias("digest"))
