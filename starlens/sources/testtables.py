"""The review relation over the test tables (see FIXTURES.md section 3).

One row per ``events`` row; the text is a fixed phrase followed by a whole document. Queries
that never look at the text leave the join out (``with_text=False``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.functions import text as tx
from starlens.functions.dates import second_text
from starlens.session import configure

PHRASES = [
    "terrible app, the subscription is a waste",
    "slow performance and annoying lag",
    "okay but not working sometimes",
    "very good and helpful",
    "I love this app, it is amazing",
    "it keeps crashing, awful",
    "wrong answers and inaccurate",
    "average, nothing special",
    "useful but expensive to upgrade",
    "excellent, not bad at all",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _phrase(k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (k % 10 + 1).cast("int"))


def reviews_from_events(events: DataFrame, documents: DataFrame | None) -> DataFrame:
    """``events`` (batch or stream) as reviews; without ``documents`` the text columns are left out."""
    k = F.col("k")
    star = (1 + k % 5).cast("int")
    polarity = (star - 3) / F.lit(2.0) + (F.col("event_id") % 21 - 10) / F.lit(100.0)
    bounded = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), polarity))
    base = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    columns = {
        "review_id": F.col("event_id").cast("string"),
        "App": F.col("event_type"),
        "Review_Date": F.col("ts").cast("timestamp"),
        "Star_Rating": star,
        "Thumbs_Up_Count": F.floor("value").cast("bigint"),
        "App_Version": F.when(k % 7 != 0, F.concat(F.lit("v"), (k % 4).cast("string"))),
        "Sentiment_Polarity": F.when(F.col("event_id") % 4 != 0, bounded),
        "Review_Theme": F.lit(None).cast("string"),
    }
    if documents is not None:
        n_docs = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
        # documents grow with the data, so this join always shuffles, never broadcasts
        docs = documents.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).hint("merge")
        base = base.withColumn("_doc", F.col("event_id") % n_docs).join(docs, "_doc", "left")
        text = (
            F.when(k % 25 == 24, F.lit(None).cast("string"))
            .when(k % 25 == 12, F.lit(""))
            .otherwise(F.concat(_phrase(k), F.lit(" "), F.col("_text")))
        )
        columns["Review_Text"] = text
    out = base.select(*[c.alias(name) for name, c in columns.items()])
    if documents is not None:
        out = out.withColumns({
            "Word_Count": tx.word_count(F.col("Review_Text")),
            "Review_Length_Chars": tx.char_length(F.col("Review_Text")),
        })
    return out


def reviews(spark: SparkSession, sf_dir: str, with_text: bool = True) -> DataFrame:
    documents = table(spark, sf_dir, "documents") if with_text else None
    return reviews_from_events(table(spark, sf_dir, "events"), documents)


def reviews_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-free reviews over several years, for calendar months."""
    star = (1 + F.col("o_orderkey") % 5).cast("int")
    polarity = (star - 3) / F.lit(2.0) + (F.col("o_custkey") % 21 - 10) / F.lit(100.0)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("review_id"),
        F.col("o_orderpriority").alias("App"),
        F.col("o_orderdate").cast("timestamp").alias("Review_Date"),
        star.alias("Star_Rating"),
        F.greatest(F.lit(-1.0), F.least(F.lit(1.0), polarity)).alias("Sentiment_Polarity"),
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text, label): every labelled document."""
    labels = table(spark, sf_dir, "labels").where("quality IS NOT NULL")
    return labels.join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.col("quality").cast("int").alias("label"))


def raw_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same reviews in the shape the store feed delivers them (RAW_REVIEW)."""
    return reviews(spark, sf_dir).select(
        "App",
        F.col("review_id").alias("reviewId"),
        second_text(F.col("Review_Date")).alias("at"),
        F.col("Star_Rating").alias("score"),
        F.col("Review_Text").alias("content"),
        F.col("Thumbs_Up_Count").alias("thumbsUpCount"),
        F.col("App_Version").alias("appVersion"),
    )
