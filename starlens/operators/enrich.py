"""Back-filling sentiment and theme."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.functions import fixed_values as fv
from starlens.functions import text as tx


def missing(df: DataFrame) -> DataFrame:
    return df.where(F.col("Sentiment_Polarity").isNull() | F.col("Review_Theme").isNull())


def missing_report(df: DataFrame) -> DataFrame:
    """Rows to update; zero means there is nothing to do."""
    lacks_polarity, lacks_theme = F.col("Sentiment_Polarity").isNull(), F.col("Review_Theme").isNull()
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(lacks_polarity | lacks_theme).alias("missing_rows"),
        F.count_if(lacks_polarity).alias("missing_polarity"),
        F.count_if(lacks_theme).alias("missing_theme"),
    )


def backfill(df: DataFrame, rules=None, lexicon=None, modifiers=None) -> DataFrame:
    """Fill only null cells. Texts of rows that have a value are not searched, and a second run
    changes nothing. Stateless: the same call works on a stream."""
    def text_without(column):
        return F.when(F.col(column).isNull(), F.col("Review_Text"))

    return df.withColumns({
        "Sentiment_Polarity": F.coalesce("Sentiment_Polarity", tx.polarity(text_without("Sentiment_Polarity"), lexicon, modifiers)),
        "Review_Theme": F.coalesce("Review_Theme", tx.theme(text_without("Review_Theme"), rules)),
    })


def backfill_to(df: DataFrame, new_path: str) -> int:
    """Write the back-filled table as a new version and give the number of rows that were filled;
    with none to fill nothing is written."""
    to_fill = missing_report(df).first()["missing_rows"]
    if to_fill:
        backfill(df).write.mode("errorifexists").partitionBy("App").parquet(new_path)
    return to_fill


def with_theme(df: DataFrame, rules=None) -> DataFrame:
    return df.withColumn("Review_Theme", F.coalesce("Review_Theme", tx.theme(F.col("Review_Text"), rules)))


def lexicon_table(spark, lexicon=None) -> DataFrame:
    lexicon = fv.POLARITY_WORDS if lexicon is None else lexicon
    rows = [(w, float(p)) for p, words in lexicon.items() for w in words]
    return spark.createDataFrame(rows, "word string, polarity double")


def modifier_words(spark, modifiers=None) -> DataFrame:
    modifiers = tx.modifier_table() if modifiers is None else modifiers
    rows = [(w, float(f)) for f, words in modifiers.items() for w in words]
    return spark.createDataFrame(rows, "word string, factor double")


def opinion_hits(df: DataFrame, lexicon: DataFrame, modifiers: DataFrame) -> DataFrame:
    """One row per opinion word found: (review_id, App, word, score).

    The join form of ``text.polarity`` for lexicons kept as tables of any size. Each token
    travels with the token before it, so no window over a review is needed, and tokens are
    matched before anything is shuffled when the lexicon is small enough to be broadcast
    (Spark decides from its size).
    """
    words = F.col("_words")
    before = F.concat(F.array(F.lit(None).cast("string")), words)  # one longer: its last pair has no word
    found = (
        df.select("review_id", "App", tx.tokens(F.col("Review_Text")).alias("_words"))
        .select("review_id", "App", F.inline(F.arrays_zip(words.alias("word"), before.alias("before"))))
        .join(lexicon, "word")
    )
    factors = modifiers.withColumnRenamed("word", "before")
    return found.join(factors, "before", "left").select(
        "review_id", "App", "word",
        (F.col("polarity") * F.coalesce("factor", F.lit(1.0))).alias("score"))
