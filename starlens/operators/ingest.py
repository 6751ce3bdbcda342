"""From raw payload to new review rows: normalise, window, dedup by id, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.functions import dates, text as tx
from starlens.functions import fixed_values as fv
from starlens.operators.topn import SMALL, first_n, first_n_by_cut, first_one


def normalize(raw: DataFrame, *more: str) -> DataFrame:
    """Raw payload -> review columns, and those in ``more`` as they are; missing fields get their defaults, null text counts 0 words."""
    return raw.select(
        F.col("reviewId").alias("review_id"),
        "App",
        dates.utc(F.col("at")).alias("Review_Date"),
        F.col("score").alias("Star_Rating"),
        F.col("content").alias("Review_Text"),
        tx.word_count(F.col("content")).alias("Word_Count"),
        tx.char_length(F.col("content")).alias("Review_Length_Chars"),
        F.coalesce("thumbsUpCount", F.lit(0)).cast("bigint").alias("Thumbs_Up_Count"),
        F.coalesce("appVersion", F.lit("Unknown")).alias("App_Version"),
        F.lit(None).cast("double").alias("Sentiment_Polarity"),
        F.lit(None).cast("string").alias("Review_Theme"),
        *more,
    )


def time_window(df: DataFrame, after, until=None, at: str = "Review_Date") -> DataFrame:
    """One window for every product: after < at <= until."""
    return df.where(dates.in_window(F.col(at), after, until))


def newest_n(df: DataFrame, n: int) -> DataFrame:
    """The newest n reviews of each product, as the store feed delivers them."""
    order = [F.col("Review_Date").desc_nulls_last(), F.col("review_id").asc()]
    if n <= SMALL:
        return first_n(df, ["App"], order, n)
    return first_n_by_cut(df, ["App"], -F.unix_micros("Review_Date"), order, n)


def balanced_sample(df: DataFrame, n: int, seed: int = fv.SEED) -> DataFrame:
    """n reviews per product in the order of a seeded hash of the id: the same rows every run."""
    digest = F.md5(F.concat(F.col("review_id"), F.lit(f"-{seed}")))
    order = [digest, F.col("review_id")]
    if n <= SMALL:
        return first_n(df, ["App"], order, n)
    # rows without an id come first here, as nulls do in ``order``
    lead = F.coalesce(F.conv(F.left(digest, F.lit(15)), 16, 10).cast("bigint"), F.lit(-1))
    return first_n_by_cut(df, ["App"], lead, order, n)


def has_id(column: str = "review_id") -> Column:
    return F.col(column).isNotNull() & (F.trim(column) != "")


def split_bad_ids(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with an id, rows to set aside). Blank ids would all count as one review."""
    return df.where(has_id()), df.where(~has_id())


def unique_ids(df: DataFrame, digest: Column | None = None) -> DataFrame:
    """One row per id inside a batch: the newest; a digest of the whole row (``digest``, if it is stored) decides between rows alike so far."""
    digest = F.xxhash64(*df.columns) if digest is None else digest
    order = [F.col("Review_Date").desc_nulls_last(), F.col("App"), F.col("Star_Rating"), digest]
    return first_one(df, ["review_id"], order)


def new_reviews(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose id is not stored yet. Only the id column of ``existing`` is read;
    the join strategy is left to runtime statistics."""
    known = existing.select("review_id").where(has_id())
    return unique_ids(batch.where(has_id())).join(known, "review_id", "left_anti")


def batch_metrics(new_rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Rows added per listed product, 0 where nothing came."""
    counts = new_rows.groupBy("App").agg(F.count(F.lit(1)).alias("added"))
    return dimension.select("App").join(counts, "App", "left").select(
        "App", F.coalesce("added", F.lit(0)).alias("added"))


def observed(df: DataFrame, observation, name_missing: str = "missing") -> DataFrame:
    """Count rows and rows to back-fill while another job reads ``df``: no extra pass."""
    return df.observe(observation, F.count(F.lit(1)).alias("rows"),
                      F.count_if(F.col("Sentiment_Polarity").isNull() | F.col("Review_Theme").isNull()).alias(name_missing))


def fill_unknown(df: DataFrame) -> DataFrame:
    return df.na.fill({"App_Version": "Unknown"})
