"""One pass over the reviews for all cards of a report.

Each review gives one row for its cell (App, day, star, theme), each slice of texts one for each of its keywords,
and a single aggregation adds both up. The table that is left grows with products, days and words, not with
reviews; overview, ratings, themes, series and keyword lists are read from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from starlens.functions import dates
from starlens.functions import fixed_values as fv
from starlens.functions import words
from starlens.functions.formatting import rounded
from starlens.operators import aggregate as A
from starlens.operators.keywords import KEYWORD_LETTERS, star_band
from starlens.operators.topn import first_n
from starlens.session import map_arrow, written


def cube(reviews: DataFrame, stop_words=fv.STOP_WORDS) -> DataFrame:
    """Sums and counts by (App, day, star, theme), and counts by (App, polarity, word), stored in the shared folder.

    ``reviews`` have a ``Review_Theme`` and a ``Review_Text``; null days, stars and themes are cells of their own.
    """
    star, feeling = F.col("Star_Rating"), F.col("Sentiment_Polarity")
    stop = list(stop_words)
    rows = reviews.select("App", dates.day_key(F.col("Review_Date")).alias("day"), star.alias("star"), feeling.alias("feeling"),
                          F.col("Review_Theme").alias("theme"), star_band().alias("polarity"),
                          F.when(star_band().isNotNull(), F.lower("Review_Text")).alias("text"))
    # words have no day, star and theme, so every column may be null
    schema = StructType([StructField(f.name, f.dataType) for f in rows.schema if f.name != "text"]).add("word", "string").add("n", "long")
    arrow = to_arrow_schema(schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield filled(pa.Table.from_batches([batch.select(["App", "day", "star", "feeling", "theme"])]).append_column("n", pa.array(np.ones(len(batch), np.int64))))
            judged = batch.filter(pc.is_valid(batch.column("polarity")))
            for found in words.batch_counts(judged, ["App", "polarity"], "text", KEYWORD_LETTERS, stop):
                yield filled(pa.Table.from_batches([found]))

    def filled(table: pa.Table) -> pa.RecordBatch:
        """With nulls in the columns that the rows don't have."""
        n = len(table)
        columns = [table[f.name].combine_chunks().cast(f.type) if f.name in table.column_names else pa.nulls(n, f.type) for f in arrow]
        return pa.RecordBatch.from_arrays(columns, names=arrow.names)

    each = map_arrow(rows, split, schema)
    summed = each.groupBy("App", "word", "day", "star", "theme", "polarity").agg(
        F.sum("n").alias("n"), F.count("star").alias("n_star"), F.sum("star").alias("sum_star"), F.sum(F.col("star") * F.col("star")).alias("sum_squares"),
        F.count("feeling").alias("n_sentiment"), F.sum("feeling").alias("sum_sentiment"))
    # the order of equal keys is left to the aggregation; every reader adds up
    return written(summed, "cube")


def cells(table: DataFrame) -> DataFrame:
    return table.where("word IS NULL")


def overview(table: DataFrame) -> DataFrame:
    """``aggregate.overview`` from the cells."""
    total = cells(table).groupBy("App").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in ("n_star", "sum_star", "sum_squares", "n_sentiment", "sum_sentiment")))
    n, s, q = F.col("n_star"), F.col("sum_star").cast("double"), F.col("sum_squares").cast("double")
    spread = F.sqrt(F.greatest(F.try_divide(q - s * s / n, n - 1), F.lit(0.0)))
    return total.select("App", F.col("n").alias("total_reviews"), rounded(F.try_divide(s, n)).alias("avg_star"),
                        rounded(F.try_divide(F.col("sum_sentiment"), F.col("n_sentiment"))).alias("avg_sentiment"),
                        F.when(n > 1, rounded(spread)).alias("std_dev"))


def rating_distribution(table: DataFrame) -> DataFrame:
    """``aggregate.rating_distribution`` from the cells."""
    wide = cells(table).groupBy("App").agg(*[F.sum(F.when(F.col("star") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in A.STARS])
    return wide.select("App", F.inline(F.array(*[F.struct(F.lit(s).alias("star"), F.col(f"s{s}").alias("n")) for s in A.STARS])))


def theme_counts(table: DataFrame) -> DataFrame:
    """``aggregate.theme_counts`` from the cells."""
    return cells(table).where("theme IS NOT NULL").groupBy("App", F.col("theme").alias("Review_Theme")).agg(F.sum("n").alias("n"))


def series_parts(table: DataFrame) -> DataFrame:
    """``aggregate.series_parts`` by day from the cells."""
    return cells(table).where("day IS NOT NULL").groupBy("App", "day").agg(
        F.sum("sum_sentiment").alias("sum_sentiment"), F.sum("n_sentiment").alias("n_sentiment"),
        F.sum("sum_star").cast("double").alias("sum_star"), F.sum("n_star").alias("n"))


def top_keywords(table: DataFrame, n: int = fv.KEYWORDS_PER_SIDE) -> DataFrame:
    """``keywords.top_keywords`` from the words."""
    counts = table.where("word IS NOT NULL").select("App", "polarity", "word", "n")
    return first_n(counts, ["App", "polarity"], [F.desc("n"), F.asc("word")], n)
