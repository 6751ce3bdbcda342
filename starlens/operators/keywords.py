"""Keyword tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starlens.functions import fixed_values as fv
from starlens.functions import text as tx, words
from starlens.operators.topn import first_n
from starlens.session import map_arrow, written

#: Letters that a keyword has at least, as in ``functions.text.long_tokens``.
KEYWORD_LETTERS = 4


def star_band():
    star = F.col("Star_Rating")
    return F.when(star >= fv.POSITIVE_MIN_STAR, "positive").when(star <= fv.NEGATIVE_MAX_STAR, "negative")


def word_frequency(df: DataFrame) -> DataFrame:
    """Count of every ASCII token of the table."""
    each = df.select(F.explode(tx.tokens(F.col("Review_Text"))).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def keyword_counts(df: DataFrame, stop_words=fv.STOP_WORDS, by: Sequence[str] = ("App", "polarity")) -> DataFrame:
    """(App, polarity, word, n) over reviews with 4-5 stars (positive) and 1-2 (negative)."""
    keys, stop = list(by), list(stop_words)
    rows = df.select("App", star_band().alias("polarity"), "Review_Text").where("polarity IS NOT NULL").select(
        *keys, F.lower("Review_Text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from words.added_up(part for batch in batches for part in words.batch_counts(batch, keys, "text", KEYWORD_LETTERS, stop))

    # a task's counts of a word, not its occurrences, reach the aggregation
    found = map_arrow(rows, count, StructType([rows.schema[k] for k in keys]).add("word", "string").add("n", "long"))
    return found.groupBy(*keys, "word").agg(F.sum("n").alias("n"))


def top_keywords(df: DataFrame, n: int = fv.KEYWORDS_PER_SIDE, stop_words=fv.STOP_WORDS) -> DataFrame:
    """The n most frequent words per product and polarity, ties in word order."""
    return first_n(keyword_counts(df, stop_words), ["App", "polarity"], [F.desc("n"), F.asc("word")], n)


def merged_cloud(top: DataFrame, n: int = fv.MERGED_CLOUD_SIZE) -> DataFrame:
    """Per-product lists added up over products, then cut to n per polarity: approximate, since a
    word outside a product's list adds nothing for that product."""
    merged = top.groupBy("polarity", "word").agg(F.sum("n").alias("n"))
    return first_n(merged, ["polarity"], [F.desc("n"), F.asc("word")], n)


def exact_cloud(df: DataFrame, n: int = fv.MERGED_CLOUD_SIZE, stop_words=fv.STOP_WORDS) -> DataFrame:
    """The same list from the full counts."""
    return first_n(keyword_counts(df, stop_words, ["polarity"]), ["polarity"], [F.desc("n"), F.asc("word")], n)


def cloud_from_counts(counts: DataFrame, n: int = fv.MERGED_CLOUD_SIZE) -> DataFrame:
    """The list of ``exact_cloud`` from stored (App, polarity, word, n), which is not added up as a whole.

    A threshold algorithm in three passes. The products' own lists of n words give a count that the n-th word has at
    least (``floor``); a word below ``floor`` / products in every product can't reach it. Then only counts of that
    size are added up: with what the others can add at most, few words are left. Their counts are added exactly.
    Filters and the few words reach the scan of the stored counts; ties of the last place are kept until ranked.
    """
    best = [F.desc("n"), F.asc("word")]

    def nth(sums: DataFrame) -> DataFrame:
        return first_n(sums, ["polarity"], best, n).where(F.col("rank") == n).select("polarity", F.col("n").alias("floor"))

    lists = first_n(counts, ["App", "polarity"], best, n)
    products = counts.select("App", "polarity").distinct().groupBy("polarity").agg(F.count(F.lit(1)).alias("products"))
    floor = nth(lists.groupBy("polarity", "word").agg(F.sum("n").alias("n")))
    # one row per polarity; a side of fewer than n words has no floor, so all its counts are added up
    least = written(products.join(floor, "polarity", "left").select(
        "polarity", "products", F.ceil(F.coalesce("floor", F.lit(0)) / F.col("products")).alias("least")), "least")
    large = counts.join(F.broadcast(least), "polarity").where(F.col("n") >= F.col("least"))
    unseen = (F.first("products") - F.count(F.lit(1))) * F.greatest(F.first("least") - 1, F.lit(0))
    sums = written(large.groupBy("polarity", "word").agg(F.sum("n").alias("n"), (F.sum("n") + unseen).alias("most")), "sums")
    left = written(sums.join(F.broadcast(nth(sums)), "polarity", "left").where(
        F.col("floor").isNull() | (F.col("most") >= F.col("floor"))).select("polarity", "word"), "left")
    exact = counts.join(left, ["polarity", "word"], "left_semi").groupBy("polarity", "word").agg(F.sum("n").alias("n"))
    return first_n(exact, ["polarity"], best, n)


def cloud_weights(cloud: DataFrame) -> DataFrame:
    """Font size 0.8..2.4 and opacity 0.55..1 from the counts of a cut list."""
    side = Window.partitionBy("polarity")  # a list of at most n words
    low, high = F.min("n").over(side), F.max("n").over(side)
    share = (F.col("n") - low) / F.when(high > low, high - low).otherwise(F.lit(1))
    return cloud.select(
        "polarity", "rank", "word", "n",
        F.round(F.when(high == low, F.lit(1.4)).otherwise(F.lit(0.8) + share * 1.6), 6).alias("size"),
        F.round(F.lit(0.55) + share * 0.45, 6).alias("opacity"))


def first_words(top: DataFrame, **lists: tuple[str, int]) -> DataFrame:
    """(App, one column per name): the first k words of a side as one comma-separated string.

    ``lists`` maps a column name to (polarity, k); all columns come from one pass over ``top``.
    """
    def column(name, polarity, k):
        return F.expr(
            f"listagg(CASE WHEN polarity = '{polarity}' AND rank <= {int(k)} THEN word END, ', ') "
            "WITHIN GROUP (ORDER BY rank)").alias(name)

    return top.groupBy("App").agg(*[column(name, polarity, k) for name, (polarity, k) in lists.items()])


def keyword_prefix(top: DataFrame, k: int) -> DataFrame:
    """(App, polarity, words): the first k words of every list."""
    return top.where(F.col("rank") <= k).groupBy("App", "polarity").agg(
        F.expr("listagg(word, ', ') WITHIN GROUP (ORDER BY rank)").alias("words"))
