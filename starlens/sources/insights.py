"""The published insights document: built from tables, read back into tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens import schema as S
from starlens.operators import aggregate as A
from starlens.operators import cube as C


def _ordered_map(order, key, value, keep=None):
    """A map whose JSON entries follow ``order``."""
    entry = F.struct(order.alias("o"), key.alias("k"), value.alias("v"))
    rows = F.array_sort(F.collect_list(entry if keep is None else F.when(keep, entry)))
    return F.map_from_entries(F.transform(rows, lambda r: F.struct(r["k"], r["v"])))


def _samples(side):
    rows = F.array_sort(F.collect_list(F.when(F.col("side") == side, F.struct("rank", "star", "text"))))
    return F.transform(rows, lambda r: F.struct(r["star"].alias("star"), r["text"].alias("text")))


def _series(series: DataFrame, bucket: str, name: str) -> DataFrame:
    """Parallel arrays per product in date order. A product has one row per calendar bucket."""
    rows = F.array_sort(F.collect_list(F.struct(bucket, "avg_sentiment", "avg_star", "n")))
    return series.groupBy("App").agg(rows.alias("r")).select(
        "App",
        F.struct(F.col(f"r.{bucket}").alias(name), F.col("r.avg_sentiment").alias("avg_sentiment"),
                 F.col("r.avg_star").alias("avg_star"), F.col("r.n").alias("count")).alias("s"))


def insights_document(reviews: DataFrame) -> DataFrame:
    """One row ``document``: the whole JSON text.

    Every collected list is bounded: themes, five stars, 30 keywords, 5 samples, days, products.
    """
    table, samples = C.cube(reviews), A.sample_reviews(reviews)  # the only two passes over the texts
    counts, stars, top, per_app = C.theme_counts(table), C.rating_distribution(table), C.top_keywords(table), C.overview(table)
    per_app = per_app.join(counts.groupBy("App").agg(
        _ordered_map(F.struct((-F.col("n")).alias("a"), F.col("Review_Theme").alias("b")),
                     F.col("Review_Theme"), F.col("n")).alias("Theme_Counts")), "App", "left")
    per_app = per_app.join(stars.groupBy("App").agg(
        _ordered_map(F.col("star"), F.col("star").cast("string"), F.col("n")).alias("Rating_Distribution")), "App", "left")
    def words(side):
        return _ordered_map(F.col("rank"), F.col("word"), F.col("n"), F.col("polarity") == side)

    per_app = per_app.join(top.groupBy("App").agg(
        words("positive").alias("Keywords_Positive"), words("negative").alias("Keywords_Negative")), "App", "left")
    per_app = per_app.join(samples.groupBy("App").agg(
        _samples("negative").alias("Sample_Reviews_Neg"), _samples("positive").alias("Sample_Reviews_Pos")), "App", "left")

    daily_parts = C.series_parts(table)
    daily = _series(A.series_from_parts(daily_parts, "day"), "day", "dates")
    monthly = _series(A.monthly_from_daily(daily_parts), "month", "months")
    per_app = per_app.join(daily.withColumnRenamed("s", "daily"), "App", "left")
    per_app = per_app.join(monthly.withColumnRenamed("s", "monthly"), "App", "left")

    entry = F.struct(
        F.col("App").alias("App"), F.col("avg_star").alias("Avg_Star"), F.col("avg_sentiment").alias("Avg_Sentiment"),
        F.col("std_dev").alias("Std_Dev"), "Theme_Counts", "Rating_Distribution",
        F.col("total_reviews").alias("Total_Reviews"), "Keywords_Positive", "Keywords_Negative",
        "Sample_Reviews_Neg", "Sample_Reviews_Pos")
    # one element per product, in name order
    rows = F.collect_list(F.struct("App", entry.alias("entry"), "daily", "monthly"))
    by_name = F.array_sort(rows, lambda x, y: F.when(x["App"] < y["App"], -1).otherwise(1))

    def members(part):
        return F.map_from_entries(F.transform("r", lambda x: F.struct(x["App"], x[part])))

    root = per_app.agg(by_name.alias("r"))
    return root.select(F.to_json(F.struct(
        F.col("r.App").alias("apps"), F.col("r.entry").alias("overview"),
        members("daily").alias("time_series_daily"), members("monthly").alias("time_series_monthly"),
    )).alias("document"))


def write_document(document: DataFrame, path: str) -> None:
    document.coalesce(1).write.mode("errorifexists").text(path)


def read_document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.INSIGHTS).option("multiLine", "true").json(path)


def document_rows(doc: DataFrame) -> DataFrame:
    """Back to rows (App, section, key, place, value): every number and text of the document.

    ``place`` is the 1-based position inside its ordered list.
    """
    apps = doc.select(F.explode("overview").alias("o"))

    def entries(section, source):
        return apps.select(F.col("o.App").alias("App"), F.lit(section).alias("section"), F.posexplode(source)) \
            .select("App", "section", F.col("key"), (F.col("pos") + 1).alias("place"), F.col("value").cast("string").alias("value"))

    def samples(section, source):
        return apps.select(F.col("o.App").alias("App"), F.lit(section).alias("section"), F.posexplode(source).alias("pos", "x")) \
            .select("App", "section", F.col("x.star").cast("string").alias("key"), (F.col("pos") + 1).alias("place"),
                    F.col("x.text").alias("value"))

    def series(section, source, bucket):
        zipped = F.arrays_zip(F.col(f"s.{bucket}").alias("k"), F.col("s.count").alias("n"))
        return doc.select(F.explode(source).alias("App", "s")) \
            .select("App", F.lit(section).alias("section"), F.posexplode(zipped).alias("pos", "x")) \
            .select("App", "section", F.col("x.k").alias("key"), (F.col("pos") + 1).alias("place"),
                    F.col("x.n").cast("string").alias("value"))

    parts = [
        apps.select(F.col("o.App").alias("App"), F.lit("total").alias("section"), F.lit("Total_Reviews").alias("key"),
                    F.lit(1).alias("place"), F.col("o.Total_Reviews").cast("string").alias("value")),
        entries("theme", "o.Theme_Counts"), entries("rating", "o.Rating_Distribution"),
        entries("positive", "o.Keywords_Positive"), entries("negative", "o.Keywords_Negative"),
        samples("sample_negative", "o.Sample_Reviews_Neg"), samples("sample_positive", "o.Sample_Reviews_Pos"),
        series("daily", "time_series_daily", "dates"), series("monthly", "time_series_monthly", "months"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
