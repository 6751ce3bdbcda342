"""Files, marks, documents and streams."""

import json

import pytest
from pyspark.sql import functions as F

from starlens.operators import aggregate as A, enrich as E
from starlens.session import work_path
from starlens.sources import insights as N, reviews as S, testtables as T
from starlens.streaming import jobs as J, refresh as G
from test_operators import review, reviews


def test_csv_keeps_quotes_lines_and_odd_words(spark):
    texts = ['say "hi", twice', "two\nlines", "NA", "null", "None", "nan", None, "comma, here", "back\\slash", "é ★"]
    df = reviews(spark, [review(f"r{i}", text=t) for i, t in enumerate(texts)])
    path = work_path(spark, "csv")
    full = df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.S.REVIEWS])
    S.write_reviews_csv(full, path)
    back = {r["review_id"]: r["Review_Text"] for r in S.scan_reviews_csv(spark, path).collect()}
    assert back == {f"r{i}": t for i, t in enumerate(texts)}


def test_malformed_csv_rows_are_kept_aside(spark, tmp_path):
    (tmp_path / "r.csv").write_text("review_id,App,Review_Date,Star_Rating,Review_Text,Word_Count,Review_Length_Chars,"
                                    "Thumbs_Up_Count,App_Version,Sentiment_Polarity,Review_Theme\n"
                                    "a,A,2026-04-01 00:00:00,5,ok,1,2,0,v1,0.5,General\n"
                                    "b,A,2026-04-01 00:00:00,five,ok,1,2,0,v1,NaN,General\n")
    rows = {r["review_id"]: r for r in S.scan_reviews_csv(spark, str(tmp_path)).cache().collect()}
    assert rows["a"]["_corrupt_record"] is None and rows["a"]["Star_Rating"] == 5
    assert rows["b"]["_corrupt_record"] and rows["b"]["Star_Rating"] is None and rows["b"]["Sentiment_Polarity"] is None


def test_mark_starts_empty_and_takes_the_newest(spark):
    path = work_path(spark, "mark")
    spark.createDataFrame([], S.S.HIGH_WATER_MARK).write.parquet(path)
    assert S.load_mark(spark, path).first()["last_run"] is None
    for stamp in ("2026-04-01 00:00:00", "2026-04-27 10:17:02", "2026-04-12 00:00:00"):
        S.save_mark(spark, path, stamp)
    assert S.load_mark(spark, path).select(F.date_format("last_run", "yyyy-MM-dd HH:mm:ss")).first()[0] == "2026-04-27 10:17:02"


def test_products_off_the_list_keep_their_rows(spark):
    df = spark.createDataFrame([("ChatGPT", 1), ("Other", 2)], "App string, n int")
    rows = {r["App"]: r["colour"] for r in S.with_product(df, S.products(spark)).collect()}
    assert rows == {"ChatGPT": "#10a37f", "Other": "#666"}


def test_document_is_json_in_rank_order(spark, sf_dir):
    df = E.with_theme(T.reviews(spark, sf_dir))
    doc = json.loads(N.insights_document(df).first()["document"])
    assert doc["apps"] == sorted(doc["apps"]) and [o["App"] for o in doc["overview"]] == doc["apps"]
    for o in doc["overview"]:
        assert sum(o["Theme_Counts"].values()) == sum(o["Rating_Distribution"].values()) == o["Total_Reviews"]
        assert list(o["Rating_Distribution"]) == ["1", "2", "3", "4", "5"]
        counts = list(o["Keywords_Positive"].values())
        assert counts == sorted(counts, reverse=True) and len(counts) == 30
        assert len(o["Sample_Reviews_Neg"]) == len(o["Sample_Reviews_Pos"]) == 5
        assert all(len(s["text"]) <= 200 for s in o["Sample_Reviews_Pos"] if s.get("text"))
        daily = doc["time_series_daily"][o["App"]]
        assert sum(daily["count"]) == o["Total_Reviews"] and daily["dates"] == sorted(daily["dates"])
        assert doc["time_series_monthly"][o["App"]]["avg_star"] == [o["Avg_Star"]]


def land(spark, df, path):
    S.land_raw(df, path)
    return path


def test_stream_in_several_runs_equals_one_batch(spark, sf_dir):
    raw = T.raw_payload(spark, sf_dir)
    feed, out, log = (work_path(spark, n) for n in ("feed", "out", "log"))
    third = F.abs(F.xxhash64("reviewId")) % 3
    sizes = []
    for part in range(3):
        land(spark, raw.where(third == part), feed)
        J.run_available(J.ingested(J.raw_stream(spark, feed)), out, log)
        sizes.append(spark.read.parquet(out).count())
    J.run_available(J.ingested(J.raw_stream(spark, feed)), out, log)  # nothing new: nothing changes
    stored = spark.read.parquet(out)
    assert sizes[0] < sizes[1] < sizes[2] == stored.count() == raw.count()
    assert stored.select("review_id").distinct().count() == raw.count()


def test_refresh_in_steps_equals_a_rebuild(spark, sf_dir):
    df = T.reviews(spark, sf_dir, with_text=False)
    part = F.abs(F.xxhash64("review_id")) % 4
    stored = G.parts_of(df.where(part == 0))
    for p in (1, 2, 3):
        stored = G.merge_parts(stored, df.where(part == p))
    stepwise = A.series_from_parts(stored, "day")
    assert stepwise.exceptAll(A.daily_series(df)).count() == 0
    assert stepwise.count() == A.daily_series(df).count()


def test_every_day_is_published_and_late_rows_are_noted(spark):
    import datetime as dt
    feed, folder, log = (work_path(spark, n) for n in ("late", "late_out", "late_log"))

    def arrive(*days):
        reviews(spark, [review(f"d{d}", at=dt.datetime(2026, 4, d, 12)) for d in days]).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(reviews(spark, [review("x")]).schema).parquet(feed)
        J.publish_daily(stream, folder, log)

    arrive(1, 5)
    arrive(2, 4)  # one of them more than a day behind
    arrive(9)
    days = {r["day"]: r["n"] for r in J.daily_parts(spark, folder).collect()}
    assert days == {f"2026-04-0{d}": 1 for d in (1, 2, 4, 5, 9)}
    assert [(r["day"], r["n"]) for r in J.late_days(spark, folder).collect()] == [("2026-04-02", 1)]


def test_streams_read_a_table_stored_as_a_folder(spark, sf_dir, tmp_path):
    from starlens.plans.queries import _event_stream

    T.table(spark, sf_dir, "events").repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    out = work_path(spark, "folder")
    J.run_available(_event_stream(spark, str(tmp_path)), out, work_path(spark, "folder_log"))
    assert spark.read.parquet(out).count() == T.table(spark, sf_dir, "events").count()


def test_exact_ingest_takes_an_id_once_over_batches_and_runs(spark):
    feed, folder, log = (work_path(spark, n) for n in ("exact_feed", "exact", "exact_log"))
    schema = "App string, reviewId string, `at` string, score int, content string, thumbsUpCount bigint, appVersion string"

    def arrive(ids, day):
        rows = [("A", i, f"2026-04-{day:02} 10:00:00", 5, f"text {i}", 0, None) for i in ids]
        S.land_raw(spark.createDataFrame(rows, schema).coalesce(1), feed)
        J.ingest_exact(J.raw_stream(spark, feed, max_files=1), folder, log)

    arrive(["a", "b", "b", ""], 20)
    arrive(["b", "c"], 2)  # older than what is stored
    arrive(["a", "c"], 21)
    stored = J.read_batches(spark, f"{folder}/reviews", J.REVIEWS)
    assert sorted(r["review_id"] for r in stored.collect()) == ["a", "b", "c"]
    assert [r["reason"] for r in J.read_batches(spark, f"{folder}/set_aside", J.SET_ASIDE).collect()] == ["no id"]
    assert [(r["added"], r["total"]) for r in J.ingest_metrics(spark, folder).orderBy("batch").collect()] == [(2, 2), (1, 3)]


def test_refresh_is_stored_and_keeps_other_days(spark, sf_dir):
    df = T.reviews(spark, sf_dir, with_text=False)
    path, cut = work_path(spark, "parts"), F.lit("2024-01-20 12:00:00").cast("timestamp")
    G.parts_of(df.where(F.col("Review_Date") <= cut)).write.partitionBy("day").parquet(path)
    G.store_refresh(spark, path, df.where(F.col("Review_Date") > cut))
    assert G.published(spark, path).exceptAll(A.daily_series(df)).count() == 0
    assert G.published(spark, path).count() == A.daily_series(df).count()


def test_a_window_reads_its_months_only(spark):
    import datetime as dt
    path = work_path(spark, "months")
    df = reviews(spark, [review(f"m{m}", at=dt.datetime(2026, m, 5)) for m in range(1, 7)])
    full = df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.S.REVIEWS])
    S.append_reviews(full, path)
    rows = S.scan_reviews(spark, path, "2026-02-10 00:00:00", "2026-04-30 00:00:00")
    assert sorted(r["review_id"] for r in rows.collect()) == ["m3", "m4"]
    assert "PartitionFilters: [isnotnull(Review_Month" in rows._jdf.queryExecution().executedPlan().toString()


def test_quarantine_takes_what_good_leaves(spark, tmp_path):
    lines = ['{"App":"A","reviewId":"1","at":"2026-04-01 00:00:00","score":5}', '{"App":"A","reviewId":"', '{"App":"A","reviewId":""}']
    (tmp_path / "f.json").write_text("\n".join(lines) + "\n")
    for name, keep, n in (("good", J.good, 1), ("bad", J.quarantine, 2)):
        out = work_path(spark, name)
        J.run_available(keep(J.raw_stream(spark, str(tmp_path))), out, work_path(spark, name + "_log"))
        assert spark.read.parquet(out).count() == n


@pytest.mark.parametrize("name", ["overview", "keywords_topk", "duplicate_rows", "new_reviews_anti", "theme_classify", "kde_grid",
                                  "histogram_20", "sentiment_lexicon", "winsorize_p99", "watermark_state", "top50_negative"])
def test_plans_have_no_cross_join_and_no_python(spark, sf_dir, name):
    from starlens.plans.queries import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"):
        assert bad not in plan


def test_text_free_queries_do_not_read_documents(spark, sf_dir):
    from starlens.plans.queries import QUERIES

    plan = QUERIES["overview"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "ReadSchema: struct<event_id:bigint,event_type:string,props:string>" in plan


@pytest.mark.parametrize("name", ["dedup_keep_last", "top50_negative", "keywords_topk", "sample_reviews", "new_reviews_anti"])
def test_groups_are_cut_before_the_shuffle(spark, sf_dir, name):
    from starlens.plans.queries import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "WindowGroupLimit" in plan


def test_back_filling_does_not_shuffle(spark):
    df = reviews(spark, [review("a", polarity=None, theme=None)])
    assert "Exchange" not in E.backfill(df)._jdf.queryExecution().executedPlan().toString()
