"""Every operator as a query over the test tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starlens.functions import dates, formatting as fm, text as tx
from starlens.operators import (
    aggregate as A, classify as C, compare as X, cube as B, distribution as D, duplicates as U, enrich as E,
    ingest as I, intervals as V, keywords as K, profile as P, quantiles as Q, report as R, sketches as H, svc as L,
)
from starlens.session import work_path, written
from starlens.sources import insights as N, reviews as S, searchindex as Z, testtables as T
from starlens.streaming import jobs as J, refresh as G

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _plain(spark, sf):
    """Reviews without the text columns."""
    return T.reviews(spark, sf, with_text=False)


def _themed(spark, sf):
    return E.with_theme(T.reviews(spark, sf))


def _scored_texts(spark, sf):
    """Reviews whose text is null where the star is: both come from ``k``, but Spark's generated code takes ``element_at`` with a null place for a value."""
    return T.reviews(spark, sf).withColumn("Review_Text", F.when(F.col("Star_Rating").isNotNull(), F.col("Review_Text")))


def _at(column: str = "Review_Date"):
    return dates.second_text(F.col(column)).alias(column)


# sources and sinks -------------------------------------------------------------------------

@query
def scan_reviews(spark, sf):
    path = work_path(spark, "reviews_csv")
    reviews = T.reviews(spark, sf)
    S.write_reviews_csv(reviews.select(*[f.name for f in S.S.REVIEWS]), path, "gzip")
    return S.scan_reviews_csv(spark, path).select(
        "review_id", "App", _at(), "Star_Rating", "Review_Text", "Word_Count", "Review_Length_Chars",
        "Thumbs_Up_Count", "App_Version", "Sentiment_Polarity")


@query
def scan_raw(spark, sf):
    path = work_path(spark, "raw_json")
    S.land_raw(T.raw_payload(spark, sf), path)
    return S.scan_raw(spark, path).select("App", "reviewId", "at", "score", "content", "thumbsUpCount", "appVersion")


@query
def newest_n_per_app(spark, sf):
    return I.newest_n(_plain(spark, sf), 500).select("App", "review_id", "rank")


@query
def newest_5000_per_app(spark, sf):
    return I.newest_n(_plain(spark, sf), 5000).select("App", "review_id", "rank")


@query
def union_schema_drift(spark, sf):
    reviews = _plain(spark, sf)
    cut = F.lit("2024-01-11").cast("timestamp")
    legacy = reviews.where(F.col("Review_Date") < cut).drop("review_id")
    live = reviews.where(F.col("Review_Date") >= cut)
    return S.union_drift(live, legacy).select("review_id", "App", _at(), "Star_Rating", "Thumbs_Up_Count")


@query
def append_reviews(spark, sf):
    path = work_path(spark, "reviews")
    reviews = T.reviews(spark, sf)
    cut = F.lit("2024-01-16").cast("timestamp")
    S.append_reviews(reviews.where(F.col("Review_Date") < cut), path, batch=0)
    for _ in range(2):  # the second batch is handed in twice
        S.append_reviews(reviews.where(F.col("Review_Date") >= cut), path, batch=1)
    return S.scan_reviews(spark, path).groupBy("App").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Word_Count").alias("words"), F.sum("Review_Length_Chars").alias("chars"))


@query
def scan_reviews_window(spark, sf):
    path = work_path(spark, "stored")
    S.append_reviews(_plain(spark, sf), path)
    return S.scan_reviews(spark, path, "2024-01-10 00:00:00", "2024-01-20 00:00:00").select("review_id", "App", _at(), "Star_Rating")


@query
def rewrite_reviews(spark, sf):
    path = work_path(spark, "reviews_v2")
    S.rewrite_reviews(E.backfill(T.reviews(spark, sf)), path)
    return S.scan_reviews(spark, path).groupBy("App", "Review_Theme").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("Sentiment_Polarity").isNull()).alias("still_missing"))


@query
def insights_document(spark, sf):
    return N.insights_document(_themed(spark, sf))


@query
def insights_explode(spark, sf):
    path = work_path(spark, "insights")
    N.write_document(N.insights_document(_themed(spark, sf)), path)
    return N.document_rows(N.read_document(spark, path))


@query
def watermark_state(spark, sf):
    path = work_path(spark, "marked")
    reviews = _plain(spark, sf)
    S.append_reviews(reviews.where(F.col("Review_Date") <= F.lit("2024-01-10").cast("timestamp")), path, batch=0)
    for _ in range(2):
        S.append_reviews(I.time_window(reviews, "2024-01-10 00:00:00", "2024-01-20 00:00:00"), path, batch=1)
    mark = F.lit(S.stored_mark(spark, path)).cast("timestamp")
    after = reviews.where(F.col("Review_Date") > mark).agg(F.count(F.lit(1)).alias("rows_after"))
    return after.withColumn("last_run", dates.second_text(mark))


@query
def batch_metrics(spark, sf):
    added = I.time_window(_plain(spark, sf), "2024-01-20 00:00:00")
    return I.batch_metrics(added, S.products(spark, WATCH_LIST, {}))


WATCH_LIST = {a: f"store.{a}" for a in ("click", "error", "purchase", "refund", "signup", "view")}
COLOURS = {"click": "#10a37f", "error": "#d97757", "purchase": "#4285f4", "signup": "#0078d4"}


@query
def dim_product_join(spark, sf):
    dimension = S.products(spark, {a: p for a, p in WATCH_LIST.items() if a != "view"}, COLOURS)
    return S.with_product(A.overview(_plain(spark, sf)).select("App", "total_reviews"), dimension)


# projections and filters --------------------------------------------------------------------

@query
def normalize_reviews(spark, sf):
    return I.normalize(T.raw_payload(spark, sf)).select(
        "review_id", "App", _at(), "Star_Rating", "Review_Text", "Word_Count", "Review_Length_Chars",
        "Thumbs_Up_Count", "App_Version")


@query
def word_count(spark, sf):
    return T.reviews(spark, sf).select("review_id", tx.word_count(F.col("Review_Text")).alias("Word_Count"))


@query
def char_length(spark, sf):
    return T.reviews(spark, sf).select("review_id", tx.char_length(F.col("Review_Text")).alias("Review_Length_Chars"))


@query
def parse_date_coerce(spark, sf):
    text = F.when(F.col("Thumbs_Up_Count") % 9 == 0, F.lit("not a date")).otherwise(dates.second_text(F.col("Review_Date")))
    return _plain(spark, sf).select("review_id", dates.second_text(dates.parse_coerce(text)).alias("parsed"))


@query
def date_keys(spark, sf):
    at = F.col("Review_Date")
    return _plain(spark, sf).select("review_id", dates.day_key(at).alias("day"), dates.month_key(at).alias("month"))


@query
def fill_unknown(spark, sf):
    return I.fill_unknown(_plain(spark, sf)).groupBy("App_Version").agg(F.count(F.lit(1)).alias("n"))


@query
def binary_label(spark, sf):
    return C.label(_plain(spark, sf)).select("review_id", "label")


@query
def winsorize_p99(spark, sf):
    return D.winsorize(_plain(spark, sf)).select("review_id", fm.rounded(F.col("Thumbs_Up_Capped")).alias("Thumbs_Up_Capped"))


@query
def time_window_filter(spark, sf):
    return I.time_window(_plain(spark, sf), "2024-01-10 00:00:00", "2024-01-20 00:00:00").groupBy("App").agg(
        F.count(F.lit(1)).alias("n"), dates.second_text(F.min("Review_Date")).alias("first_at"),
        dates.second_text(F.max("Review_Date")).alias("last_at"))


@query
def missing_rows(spark, sf):
    known = F.when(F.col("Star_Rating") == 5, "General")
    return E.missing_report(_plain(spark, sf).withColumn("Review_Theme", known))


@query
def star_bands(spark, sf):
    return A.star_bands(_plain(spark, sf))


@query
def viral_reviews(spark, sf):
    return A.viral_head(_plain(spark, sf), at_least=200).select("App", "Star_Rating", "Thumbs_Up_Count", "review_id")


@query
def viral_count(spark, sf):
    return A.viral(_plain(spark, sf), at_least=200).groupBy("App").agg(F.count(F.lit(1)).alias("n"))


@query
def search_reviews(spark, sf):
    return T.reviews(spark, sf).where(tx.matches(F.col("Review_Text"), " Expensive ")).select(
        "review_id", "App", "Star_Rating", "Review_Text")


@query
def search_reviews_indexed(spark, sf):
    """The rows of ``search_reviews``, by the index of character triples."""
    folder = work_path(spark, "searched")
    rows = T.reviews(spark, sf).select("review_id", "App", "Star_Rating", "Review_Text")
    Z.add(rows, folder)
    return Z.search(spark, folder, rows.schema, " Expensive ")


@query
def search_one_product(spark, sf):
    return T.reviews(spark, sf).where((F.col("App") == "click") & tx.matches(F.col("Review_Text"), "crashing")).select(
        "review_id", "Star_Rating", "Review_Text")


@query
def search_conversations(spark, sf):
    return T.table(spark, sf, "conversations").where(tx.matches(F.col("text"), "The")).select("conv_id", "turn", "role", "text")


@query
def search_highlight(spark, sf):
    found = T.reviews(spark, sf).where(tx.matches(F.col("Review_Text"), "not working"))
    return found.select("review_id", tx.highlight(F.col("Review_Text"), "not working").alias("highlighted"))


# text ----------------------------------------------------------------------------------------

@query
def theme_classify(spark, sf):
    return T.reviews(spark, sf).select("review_id", tx.theme(F.col("Review_Text")).alias("theme"))


@query
def sentiment_lexicon(spark, sf):
    return _scored_texts(spark, sf).select("review_id", fm.rounded(tx.polarity(F.col("Review_Text"))).alias("polarity"))


@query
def opinion_words(spark, sf):
    hits = E.opinion_hits(T.reviews(spark, sf), E.lexicon_table(spark), E.modifier_words(spark))
    return hits.groupBy("App", "word").agg(F.count(F.lit(1)).alias("hits"), fm.mean(F.col("score")).alias("mean_score"))


@query
def backfill_enrich(spark, sf):
    return E.backfill(T.reviews(spark, sf)).select(
        "review_id", fm.rounded(F.col("Sentiment_Polarity")).alias("Sentiment_Polarity"), "Review_Theme")


@query
def tokens(spark, sf):
    return K.word_frequency(T.reviews(spark, sf))


@query
def document_tokens(spark, sf):
    return K.word_frequency(T.table(spark, sf, "documents").withColumnRenamed("text", "Review_Text"))


@query
def keywords_topk(spark, sf):
    return K.top_keywords(T.reviews(spark, sf))


@query
def keywords_merge_topk(spark, sf):
    return K.merged_cloud(K.top_keywords(T.reviews(spark, sf)))


@query
def keywords_exact_topk(spark, sf):
    return K.exact_cloud(T.reviews(spark, sf))


@query
def keywords_exact_from_counts(spark, sf):
    """The exact merged list from stored counts per product."""
    return K.cloud_from_counts(written(K.keyword_counts(T.reviews(spark, sf)), "keyword_counts"))


@query
def cloud_weights(spark, sf):
    return K.cloud_weights(K.merged_cloud(K.top_keywords(T.reviews(spark, sf))))


@query
def keyword_prefix(spark, sf):
    return K.keyword_prefix(K.top_keywords(T.reviews(spark, sf)), 5)


@query
def negative_digest(spark, sf):
    return R.negative_digest(A.most_negative(T.reviews(spark, sf)))


# aggregates ----------------------------------------------------------------------------------

@query
def overview(spark, sf):
    return A.overview(_plain(spark, sf))


@query
def rating_distribution(spark, sf):
    return A.rating_distribution(_plain(spark, sf))


@query
def rating_rollup(spark, sf):
    return A.rating_rollup(_plain(spark, sf))


@query
def theme_counts(spark, sf):
    return A.theme_counts(_themed(spark, sf))


@query
def theme_rollup(spark, sf):
    return A.theme_rollup(A.theme_counts(_themed(spark, sf)))


@query
def theme_share(spark, sf):
    return A.theme_share(A.theme_counts(_themed(spark, sf)))


@query
def daily_series(spark, sf):
    return A.daily_series(_plain(spark, sf)).orderBy("App", "day")


@query
def monthly_series(spark, sf):
    return A.monthly_series(T.reviews_from_orders(spark, sf)).orderBy("App", "month")


@query
def monthly_from_daily(spark, sf):
    parts = A.series_parts(T.reviews_from_orders(spark, sf), dates.day_key(F.col("Review_Date")), "day")
    return A.monthly_from_daily(parts)


@query
def daily_scaled(spark, sf):
    return A.daily_scaled(A.daily_series(_plain(spark, sf)))


@query
def series_compare(spark, sf):
    return A.series_compare(A.daily_series(_plain(spark, sf)), ["click", "error", "purchase", "signup", "view"])


@query
def kpi_rollup(spark, sf):
    return A.kpi_rollup(_plain(spark, sf))


@query
def kpi_weighted_all(spark, sf):
    return A.weighted_all(A.overview(_plain(spark, sf)))


@query
def star_shares(spark, sf):
    return A.star_shares(_plain(spark, sf))


@query
def top_pain_point(spark, sf):
    return A.top_theme(A.theme_counts(_themed(spark, sf)))


@query
def top_theme(spark, sf):
    return A.top_theme(A.theme_counts(_themed(spark, sf)), exclude=())


@query
def product_ranking(spark, sf):
    return A.product_ranking(A.overview(_plain(spark, sf)))


@query
def polarisation_ranking(spark, sf):
    return A.polarisation_ranking(A.overview(_plain(spark, sf)))


@query
def uplift_vs_median(spark, sf):
    return A.uplift_vs_median(A.overview(_plain(spark, sf)))


@query
def market_overview(spark, sf):
    return A.market_overview(A.overview(_plain(spark, sf)), A.theme_counts(_themed(spark, sf)))


@query
def star_sentiment_corr(spark, sf):
    return A.star_sentiment_corr(_plain(spark, sf))


@query
def zero_share(spark, sf):
    return A.zero_share(E.backfill(_scored_texts(spark, sf)))


@query
def sample_reviews(spark, sf):
    return A.sample_reviews(T.reviews(spark, sf))


@query
def sample_union(spark, sf):
    return A.sample_union(A.sample_reviews(T.reviews(spark, sf)))


@query
def top50_negative(spark, sf):
    return A.most_negative(T.reviews(spark, sf)).select("App", "rank", "review_id", "Review_Text")


@query
def balanced_sample(spark, sf):
    return I.balanced_sample(_plain(spark, sf), 100).select("App", "rank", "review_id")


@query
def balanced_sample_5000(spark, sf):
    return I.balanced_sample(_plain(spark, sf), 5000).select("App", "rank", "review_id")


# comparison and reports ------------------------------------------------------------------------

@query
def compare_two(spark, sf):
    return X.compare_two(_themed(spark, sf), "click", "view")


@query
def compare_top2(spark, sf):
    return X.compare_top2(_themed(spark, sf))


@query
def theme_compare(spark, sf):
    return X.theme_compare(A.theme_counts(_themed(spark, sf)), "click", "view")


@query
def insight_banner(spark, sf):
    return X.insight_banner(A.overview(_plain(spark, sf)))


@query
def product_banner(spark, sf):
    return X.product_banner(_themed(spark, sf))


@query
def ranking_rows(spark, sf):
    return R.ranking_rows(A.overview(_plain(spark, sf)))


@query
def kpi_cards(spark, sf):
    return R.kpi_cards(A.kpi_rollup(_plain(spark, sf)))


@query
def leader_card(spark, sf):
    return R.leader_card(A.overview(_plain(spark, sf)), K.top_keywords(T.reviews(spark, sf)))


@query
def concern_rows(spark, sf):
    return R.concern_rows(A.overview(_plain(spark, sf)), K.top_keywords(T.reviews(spark, sf)))


@query
def context_lines(spark, sf):
    table = B.cube(_themed(spark, sf))
    return R.context_lines(B.overview(table), B.theme_counts(table), B.top_keywords(table))


@query
def overview_from_cube(spark, sf):
    return B.overview(B.cube(_themed(spark, sf)))


@query
def daily_from_cube(spark, sf):
    return A.series_from_parts(B.series_parts(B.cube(_themed(spark, sf))), "day")


@query
def distinct_from_sketches(spark, sf):
    """Distinct reviews of a span of days from stored states, held against the exact count."""
    path = work_path(spark, "states")
    H.sketched(_plain(spark, sf)).write.parquet(path)
    span = spark.read.parquet(path).where("day BETWEEN '2024-01-05' AND '2024-01-25'")
    got = H.merged(span).select("App", H.distinct_count().alias("estimate"))
    day = dates.day_key(F.col("Review_Date"))
    exact = _plain(spark, sf).where(day.between("2024-01-05", "2024-01-25")).groupBy("App").agg(F.count_distinct("review_id").alias("exact"))
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), H.DISTINCT_ERROR * F.col("exact"))
    return exact.join(got, "App").select("App", "exact", near.alias("within_bound"))


@query
def median_from_sketches(spark, sf):
    """The median of thumbs per product from merged daily states: the share of rows below and up to it is about one half."""
    path = work_path(spark, "states")
    H.sketched(_plain(spark, sf)).write.parquet(path)
    got = H.merged(spark.read.parquet(path)).select("App", H.quantile(0.5).alias("estimate"))
    value = F.col("Thumbs_Up_Count")
    ranks = _plain(spark, sf).join(got, "App").groupBy("App").agg(
        F.count(value).alias("n"), F.avg((value < F.col("estimate")).cast("double")).alias("below"), F.avg((value <= F.col("estimate")).cast("double")).alias("upto"))
    return ranks.select("App", "n", ((F.col("below") <= 0.5 + H.RANK_ERROR) & (F.col("upto") >= 0.5 - H.RANK_ERROR)).alias("within_bound"))


# duplicates ------------------------------------------------------------------------------------

@query
def new_reviews_anti(spark, sf):
    reviews = _plain(spark, sf)
    batch = reviews.where(F.col("Review_Date") > F.lit("2024-01-15").cast("timestamp"))
    stored = reviews.where(F.col("Review_Date") <= F.lit("2024-01-20").cast("timestamp"))
    # every new row arrives twice
    return I.new_reviews(batch.unionByName(batch), stored).select("review_id", "App")


@query
def quarantined_ids(spark, sf):
    """Rows without an id, kept apart from those that have one."""
    blank = F.when(F.col("Thumbs_Up_Count") % 10 == 0, F.lit(" ")).otherwise(F.col("review_id"))
    reviews = _plain(spark, sf).withColumn("review_id", F.when(F.col("Thumbs_Up_Count") % 10 != 1, blank))
    kept, aside = I.split_bad_ids(reviews)
    return kept.select("App", F.lit("kept").alias("side")).unionByName(
        aside.select("App", F.lit("aside").alias("side"))).groupBy("App", "side").agg(F.count(F.lit(1)).alias("n"))


@query
def dedup_keep_last(spark, sf):
    reviews = T.reviews(spark, sf).select("review_id", "App", "Review_Date", "Star_Rating", "Review_Text")
    return U.dedup_keep_last(reviews).drop("Review_Date")


@query
def duplicate_rows(spark, sf):
    reviews = T.reviews(spark, sf).select("review_id", "App", "Review_Date", "Star_Rating", "Review_Text")
    return U.duplicate_rows(reviews).select("review_id", "App", _at(), "Star_Rating", "Review_Text")


@query
def duplicate_listing(spark, sf):
    reviews = T.reviews(spark, sf).select("review_id", "App", "Review_Date", "Star_Rating", "Review_Text")
    return U.duplicate_listing(reviews).select("App", _at(), "Star_Rating", "Review_Text", "review_id")


@query
def duplicate_patterns(spark, sf):
    return U.duplicate_patterns(T.reviews(spark, sf), within_minutes=60)


@query
def dup_row_count(spark, sf):
    return U.full_row_duplicates(_plain(spark, sf).select(
        "App", dates.day_key(F.col("Review_Date")).alias("day"), "Star_Rating", "Thumbs_Up_Count", "App_Version"))


@query
def dup_text_count(spark, sf):
    return U.text_duplicates(T.reviews(spark, sf))


@query
def dup_document_count(spark, sf):
    return U.text_duplicates(T.table(spark, sf, "documents").withColumnRenamed("text", "Review_Text"))


# profiles ----------------------------------------------------------------------------------------

@query
def null_counts(spark, sf):
    return P.null_counts(T.reviews(spark, sf))


@query
def nunique(spark, sf):
    return P.distinct_counts(T.reviews(spark, sf).drop("Review_Date"))


@query
def distinct_values(spark, sf):
    return P.distinct_values(_themed(spark, sf), ["App", "Review_Theme"])


@query
def category_counts(spark, sf):
    reviews = _themed(spark, sf)
    return P.category_counts(reviews, P.categorical_columns(reviews))


@query
def profile_columns(spark, sf):
    return P.profile_columns(T.reviews(spark, sf))


@query
def describe_numeric(spark, sf):
    reviews = T.reviews(spark, sf)
    return P.describe_numeric(reviews, P.numeric_columns(reviews))


@query
def row_listing(spark, sf):
    return _plain(spark, sf).select("review_id", "App", "Star_Rating", "Thumbs_Up_Count").orderBy("Review_Date", "review_id").limit(5)


@query
def p99(spark, sf):
    return D.cap_value(_plain(spark, sf), "Thumbs_Up_Count").select(fm.rounded(F.col("cap")).alias("p99"))


@query
def quantiles_by_app(spark, sf):
    quartiles = Q.quantiles(_plain(spark, sf), ["App"], "Sentiment_Polarity", Q.QUARTILES)
    return quartiles.select("App", *[fm.rounded(F.col(name)).alias(name) for name, _ in Q.QUARTILES])


@query
def p99_approximate(spark, sf):
    return Q.approximate_quantiles(_plain(spark, sf), ["App"], "Thumbs_Up_Count", [("p99", 0.99)])


@query
def nunique_approximate(spark, sf):
    return P.approx_distinct_counts(_plain(spark, sf))


@query
def box_stats_by_star(spark, sf):
    return D.box_stats(_plain(spark, sf), "Star_Rating", "Sentiment_Polarity")


@query
def box_stats_thumbs(spark, sf):
    thumbs = F.col("Thumbs_Up_Count").cast("double")
    return D.box_stats(_plain(spark, sf).select(F.lit("Thumbs_Up_Count").alias("column"), thumbs.alias("value")), "column", "value")


@query
def mean_thumbs_ci(spark, sf):
    return V.mean_normal_interval(D.winsorize(_plain(spark, sf)), ["App"], "Thumbs_Up_Capped")


@query
def mean_thumbs_bootstrap(spark, sf):
    return V.mean_sliced_interval(D.winsorize(_plain(spark, sf)), ["App"], "Thumbs_Up_Capped", "review_id")


@query
def star_by_app_theme(spark, sf):
    return V.mean_normal_interval(_themed(spark, sf), ["App", "Review_Theme"], "Star_Rating")


@query
def star_by_app_theme_bootstrap(spark, sf):
    return V.mean_sliced_interval(_themed(spark, sf), ["App", "Review_Theme"], "Star_Rating", "review_id")


@query
def histogram_20(spark, sf):
    return D.histogram(T.reviews(spark, sf), D.NUMERIC, 20)


@query
def histogram_zoom(spark, sf):
    return D.histogram_zoom(_plain(spark, sf))


@query
def histogram_log(spark, sf):
    return D.histogram_log(_plain(spark, sf))


@query
def kde_grid(spark, sf):
    return D.kde(_plain(spark, sf), "Sentiment_Polarity")


@query
def kde_grid_binned(spark, sf):
    return D.kde_binned(_plain(spark, sf), "Sentiment_Polarity")


# classification ------------------------------------------------------------------------------------

@query
def ml_dataset(spark, sf):
    return C.dataset(T.reviews(spark, sf))


@query
def ml_split(spark, sf):
    return C.split(T.labelled_documents(spark, sf)).select("id", "label", "is_test")


@query
def ml_idf(spark, sf):
    train = C.with_words(C.split(T.labelled_documents(spark, sf)).where("NOT is_test"))
    return C.vocabulary(train).select("word", "term_count", "df", fm.rounded(F.col("idf"), 6).alias("idf"))


@query
def ml_tfidf(spark, sf):
    parts = C.with_words(C.split(T.labelled_documents(spark, sf)))
    return C.fit_tfidf(parts.where("NOT is_test")).transform(parts).select("id", "label", "is_test", "features")


@query
def ml_tfidf_weights(spark, sf):
    parts = C.with_words(C.split(T.labelled_documents(spark, sf)))
    weights = C.term_weights(C.fit_tfidf(parts.where("NOT is_test")), parts)
    return weights.select("id", "word", fm.rounded(F.col("weight"), 6).alias("weight"))


@query
def ml_logreg(spark, sf):
    return C.train_and_predict(T.labelled_documents(spark, sf), "logreg")


@query
def ml_rf(spark, sf):
    return C.train_and_predict(T.labelled_documents(spark, sf), "forest")


@query
def ml_svc(spark, sf):
    return C.train_and_predict(T.labelled_documents(spark, sf), "svc")


@query
def ml_svc_squared(spark, sf):
    return L.train_and_predict(T.labelled_documents(spark, sf))


@query
def ml_logreg_report(spark, sf):
    return C.classification_report(C.train_and_predict(T.labelled_documents(spark, sf), "logreg"))


def _label_pairs(spark, sf):
    """Two 0/1 judgements of each document, read as label and prediction."""
    return T.table(spark, sf, "labels").select(F.col("quality").alias("label"), F.col("toxic").alias("prediction"))


@query
def classification_report(spark, sf):
    return C.classification_report(_label_pairs(spark, sf))


@query
def confusion_matrix(spark, sf):
    return C.confusion_matrix(_label_pairs(spark, sf))


# streams --------------------------------------------------------------------------------------------

def _event_stream(spark, sf):
    """The events file as a stream of text-free reviews."""
    schema = T.table(spark, sf, "events").schema
    # a pattern, since the table may be a file or a folder of files
    events = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet")
    return T.reviews_from_events(events, None)


def _landed(spark, sf):
    path = work_path(spark, "feed")
    S.land_raw(T.raw_payload(spark, sf), path)
    return path


def _run(spark, stream, name):
    out = work_path(spark, name)
    J.run_available(stream, out, work_path(spark, name + "_log"))
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_ingest(spark, sf):
    rows = J.ingested(J.raw_stream(spark, _landed(spark, sf), max_files=16), "2024-01-01 00:00:00", "2024-01-25 00:00:00")
    return _run(spark, rows, "ingested").select("review_id", "App", _at(), "Star_Rating", "Word_Count")


@query
def stream_dedup(spark, sf):
    rows = _event_stream(spark, sf)
    # every review arrives twice
    return _run(spark, J.deduplicated(rows.union(_event_stream(spark, sf))), "deduplicated").select("review_id", "App", "Star_Rating")


@query
def stream_new_only(spark, sf):
    stored = _plain(spark, sf).where(F.col("Review_Date") <= F.lit("2024-01-20").cast("timestamp"))
    return _run(spark, J.not_stored(_event_stream(spark, sf), stored), "new_only").select("review_id", "App")


@query
def stream_enrich(spark, sf):
    rows = J.enriched(J.ingested(J.raw_stream(spark, _landed(spark, sf))))
    return _run(spark, rows, "enriched").select(
        "review_id", fm.rounded(F.col("Sentiment_Polarity")).alias("Sentiment_Polarity"), "Review_Theme")


def _published(spark, sf):
    folder = work_path(spark, "daily")
    J.publish_daily(_event_stream(spark, sf), folder, work_path(spark, "daily_log"))
    return J.daily_parts(spark, folder)


@query
def stream_daily(spark, sf):
    return A.series_from_parts(_published(spark, sf), "day")


@query
def stream_monthly(spark, sf):
    return A.monthly_from_daily(_published(spark, sf))


def _ingested_exactly(spark, sf):
    """Every review is landed, some of them again."""
    path, folder = _landed(spark, sf), work_path(spark, "exact")
    S.land_raw(T.raw_payload(spark, sf).where(F.col("thumbsUpCount") % 3 == 0), path)
    J.ingest_exact(J.raw_stream(spark, path, max_files=16), folder, work_path(spark, "exact_log"))
    return folder


@query
def stream_exact_ingest(spark, sf):
    stored = J.read_batches(spark, _ingested_exactly(spark, sf) + "/reviews", J.REVIEWS)
    return stored.select("review_id", "App", _at(), "Star_Rating", "Word_Count")


@query
def stream_ingest_metrics(spark, sf):
    metrics = J.ingest_metrics(spark, _ingested_exactly(spark, sf))
    return metrics.groupBy("App").agg(F.sum("added").alias("added"))


@query
def quarantine(spark, sf):
    path = work_path(spark, "feed_lines")
    thumbs = F.col("thumbsUpCount")
    raw = T.raw_payload(spark, sf).withColumn("reviewId", F.when(thumbs % 50 != 1, F.col("reviewId")).otherwise(F.lit("")))
    line = F.to_json(F.struct(*raw.columns))
    # a cut line is not valid JSON
    raw.select(F.when(thumbs % 50 == 0, F.left(line, F.lit(40))).otherwise(line).alias("value")).write.options(**S.feed_options()).text(path)
    bad = _run(spark, J.quarantine(J.raw_stream(spark, path)), "quarantine")
    return bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def incremental_refresh(spark, sf):
    reviews = _plain(spark, sf)
    cut = F.lit("2024-01-20 12:00:00").cast("timestamp")
    path = work_path(spark, "daily_parts")
    G.store_refresh(spark, path, reviews.where(F.col("Review_Date") <= cut), 0)
    for _ in range(2):  # the second batch is handed in twice
        G.store_refresh(spark, path, reviews.where(F.col("Review_Date") > cut), 1)
    return G.published(spark, path)
