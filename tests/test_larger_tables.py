"""What a larger table asks of the steps that many queries share."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from starlens import schema as S
from starlens.functions import text as tx, words
from starlens.operators import classify as C, cube as B, duplicates as U, keywords as K
from starlens.sources import reviews as R, searchindex as Z, versioned as V
from starlens.streaming import jobs as J


def _reviews(spark, rows):
    return spark.createDataFrame(rows, "App string, Review_Date timestamp, Star_Rating int, Sentiment_Polarity double, Review_Text string")


def test_words_are_counted_per_batch(spark):
    batch = pa.record_batch({"App": ["a", None, "a"], "text": ["hello of hello", None, "hello world"]})
    assert [r for part in words.batch_counts(batch, ["App"], "text", 4, ["world"]) for r in part.to_pylist()] == [{"App": "a", "word": "hello", "n": 3}]
    rows = _reviews(spark, [("a", None, 5, None, "Hello hello, I")] * 50 + [("a", None, 1, None, None), (None, None, 2, None, "hello")])
    counts = K.keyword_counts(rows)
    assert sorted(map(tuple, counts.collect()), key=str) == [("a", "positive", "hello", 100), (None, "negative", "hello", 1)]
    plan = counts._jdf.queryExecution().toString()
    assert "Generate" not in plan  # no row per occurrence of a word


def test_cube_of_themes_that_are_never_null(spark):
    rows = _reviews(spark, [("a", None, 5, 0.5, "hello crash")] * 3).withColumn("Review_Theme", tx.theme(F.col("Review_Text")))
    table = B.cube(rows)
    assert [tuple(r) for r in B.theme_counts(table).collect()] == [("a", "Bugs/Performance", 3)]
    assert {(r["word"], r["n"]) for r in B.top_keywords(table).collect()} == {("hello", 3), ("crash", 3)}


def test_theme_seeks_all_phrases_at_once(spark):
    rows = spark.createDataFrame([("x a.b",), ("AxB",), (None,), ("A.B lag",)], "t string")
    rules = [("dot", ["a.b"]), ("lag", ["lag"])]
    got = rows.select(tx.theme(F.col("t"), rules, "none").alias("x"))
    assert [r["x"] for r in got.collect()] == ["dot", "none", "none", "dot"]
    assert not got.schema["x"].nullable
    assert "Contains" not in got._jdf.queryExecution().toString() and "CASE WHEN" not in got._jdf.queryExecution().toString()


def test_landed_files_are_compressed_and_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "FEED_ROWS", 40)
    rows = spark.range(100).coalesce(1).select(F.lit("a").alias("App"), F.col("id").cast("string").alias("reviewId"), F.lit("2024-01-01 00:00:00").alias("at"),
                                               F.lit(1).alias("score"), F.lit("t").alias("content"), F.lit(0).cast("long").alias("thumbsUpCount"), F.lit(None).cast("string").alias("appVersion"))
    R.land_raw(rows, str(tmp_path / "feed"))
    assert len(list((tmp_path / "feed/App=a").glob("*.json.gz"))) == 3
    assert R.scan_raw(spark, str(tmp_path / "feed")).count() == 100


def test_csv_is_written_as_several_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "CSV_ROWS", 30)
    R.write_reviews_csv(spark.range(100).coalesce(1).select(F.col("id").cast("string").alias("review_id"), F.lit('a "b"\nc').alias("App")), str(tmp_path / "csv"))
    assert len(list((tmp_path / "csv").glob("*.csv"))) == 4
    schema = StructType([StructField(f.name, f.dataType) for f in S.REVIEWS][:2])
    assert R.scan_reviews_csv(spark, str(tmp_path / "csv"), schema).where(F.col("App") == 'a "b"\nc').count() == 100


def test_csv_may_be_compressed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "CSV_ROWS", 30)
    rows = spark.range(100).coalesce(1).select(F.col("id").cast("string").alias("review_id"), F.lit('a "b"\nc').alias("App"))
    R.write_reviews_csv(rows, str(tmp_path / "csv"), "gzip")
    assert len(list((tmp_path / "csv").glob("*.csv.gz"))) == 4
    schema = StructType([StructField(f.name, f.dataType) for f in S.REVIEWS][:2])
    assert sorted(R.scan_reviews_csv(spark, str(tmp_path / "csv"), schema).select("review_id", "App").collect()) == sorted(rows.collect())


def test_scan_of_reviews_lands_compressed_files(spark, sf_dir):
    from starlens.plans.queries import QUERIES

    files = QUERIES["scan_reviews"](spark, sf_dir).inputFiles()
    assert files and all(f.endswith(".csv.gz") for f in files)


def test_no_text_is_shuffled_to_find_duplicate_rows(spark):
    rows = spark.createDataFrame([("1", "a", None, None, "x"), ("2", "b", None, 5, None), ("3", None, None, None, "x"), ("4", "a", None, 1, "y"),
                                  ("4", "a", None, 1, None), (None, None, None, None, ""), ("5", "a", None, 1, "")],
                                 "review_id string, App string, Review_Date timestamp, Star_Rating int, Review_Text string")
    found = U.duplicate_rows(rows)
    assert sorted((str(r["review_id"]), str(r["Review_Text"])) for r in found.collect()) == [
        ("1", "x"), ("2", "None"), ("3", "x"), ("4", "None"), ("5", ""), ("None", "")]
    assert "Exchange hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_index_lists_a_triple_once_per_block(spark, tmp_path):
    batch = pa.record_batch({"text": ["abcd", "a", "", "zabc", "éñ\U0001F600x", "bcd"], "file": ["f"] * 4 + ["g"] * 2, "block": pa.array([0, 0, 0, 1, 0, 0], pa.int64())})
    got = {(r["gram"], r["file"]): r["blocks"] for part in Z.listed_grams(iter([batch])) for r in part.to_pylist()}
    assert got == {("abc", "f"): [0, 1], ("bcd", "f"): [0], ("zab", "f"): [1], ("bcd", "g"): [0], ("éñ\U0001F600", "g"): [0], ("ñ\U0001F600x", "g"): [0]}
    rows = spark.createDataFrame([("1", "Too Expensive now"), ("2", None), ("3", ""), ("4", "cheap")], "review_id string, Review_Text string")
    Z.add(rows, str(tmp_path))
    assert [r["review_id"] for r in Z.search(spark, str(tmp_path), rows.schema, "expensive").collect()] == ["1"]


def test_forest_statistics_fit_beside_the_rows(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(C, "RandomForestClassifier", lambda **params: asked.update(params) or type("F", (), {"fit": lambda self, rows: rows})())
    C.fit_forest(spark.range(1))
    assert asked["maxMemoryInMB"] <= 256


def test_forest_keeps_the_nodes_of_its_rows(spark, monkeypatch):
    """The same trees, without taking all rows down all trees in every pass."""
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(k % 2, Vectors.dense([k % 4, k % 7, k % 3])) for k in range(80)], ["label", "features"])
    model = C.fit_forest(rows, trees=3, depth=4)
    assert model.getCacheNodeIds() and spark.sparkContext.getCheckpointDir()
    plain = C.RandomForestClassifier(numTrees=3, maxDepth=4, featureSubsetStrategy="sqrt", seed=C.fv.SEED, maxMemoryInMB=256).fit(rows)
    assert model.toDebugString.split("\n")[1:] == plain.toDebugString.split("\n")[1:]


def test_large_parts_are_not_merged_and_retired_ones_go(spark, tmp_path):
    folder = str(tmp_path / "t")
    for batch in range(2):
        V.append(spark.range(10), folder, "rows", batch=batch)
    assert V.compact(spark, folder, "rows", "id long", fan=2, enough=1) == []
    retired = V.compact(spark, folder, "rows", "id long", fan=2)
    assert len(retired) == 2 and V.scan(spark, folder, "rows", "id long").count() == 20
    V.remove(spark, folder, retired)
    assert len(list((tmp_path / "t/data").glob("part=*"))) == 1 and V.scan(spark, folder, "rows", "id long").count() == 20


def test_ingest_keeps_no_copy_of_its_batches(spark, tmp_path):
    from starlens.session import _work_folder
    import glob

    raw = [("a", str(i), "2024-01-01 00:00:00", 1, "t", 0, None) for i in range(20)]
    rows = spark.createDataFrame(raw, S.RAW_REVIEW)
    before = set(glob.glob(_work_folder(spark).removeprefix("file:") + "/batch-*"))
    for k in range(3):
        R.land_raw(rows, str(tmp_path / "feed"))
        J.ingest_exact(J.raw_stream(spark, str(tmp_path / "feed")), str(tmp_path / "t"), str(tmp_path / "log"))
    assert J.read_batches(spark, str(tmp_path / "t") + "/reviews", J.REVIEWS).count() == 20
    assert set(glob.glob(_work_folder(spark).removeprefix("file:") + "/batch-*")) == before


def test_polarity_and_word_count_run_in_batches(spark):
    rows = spark.createDataFrame([("very good  bad",), (None,), ("",), ("VERY",), ("good x\u0085y z",), ("GOODİ Kind",)], "t string")
    got = rows.select(tx.polarity(F.col("t")).alias("p"), tx.word_count(F.col("t")).alias("n"))
    assert [(round(r["p"], 4), r["n"]) for r in got.collect()] == [(0.105, 3), (0.0, 0), (0.0, 0), (0.0, 1), (0.7, 4), (0.0, 2)]
    plan = got._jdf.queryExecution().toString().lower()
    assert "regexp_count" not in plan and "split(" not in plan and "lambda" not in plan
    assert not got.schema["p"].nullable and not got.schema["n"].nullable


def test_scores_follow_the_first_list_and_stay_in_their_text():
    texts = pa.array(["really", "meh meh", None, "nice meh"])
    assert words.mean_scores(texts, {"meh": -0.5, "nice": 1.0}, {"really": 2.0, "meh": 3.0}).tolist() == [0.0, -1.0, 0.0, 0.25]
    assert tx._values({0.5: ["a", "b"], -0.5: ["b"]}) == {"a": 0.5, "b": 0.5}
    assert words.word_counts(pa.array([], pa.string())).tolist() == [] and words.mean_scores(pa.array([None], pa.string()), {}, {}).tolist() == [0.0]


def test_a_task_sends_a_word_once(spark):
    part = pa.record_batch({"App": ["a", None, "a"], "word": ["x", "x", "y"], "n": pa.array([1, 2, 3], pa.int64())})
    once = [r for x in words.added_up(iter([part] * 5)) for r in x.to_pylist()]
    assert sorted(map(str, once)) == sorted(map(str, [{"App": "a", "word": "x", "n": 5}, {"App": None, "word": "x", "n": 10}, {"App": "a", "word": "y", "n": 15}]))
    assert sum(r["n"] for x in words.added_up(iter([part] * 5), held_bytes=1) for r in x.to_pylist()) == 30
    assert list(words.added_up(iter([]))) == []
    groups, word, n = words.counted(pa.array(["abcd abc abcde", "abcd", None]), np.array([0, 1, 1]), 4, ["abcde"])
    assert (groups.tolist(), word.to_pylist(), n.tolist()) == ([0, 1], ["abcd", "abcd"], [1, 1])
    assert words.counted(pa.array([None], pa.string()), np.array([0]), 4, [])[1].to_pylist() == []


def test_exact_cloud_counts_no_products(spark):
    rows = _reviews(spark, [("a", None, 5, None, "hello"), ("b", None, 5, None, "hello world"), (None, None, 1, None, "hello")])
    cloud = K.exact_cloud(rows)
    assert sorted((r["polarity"], r["word"], r["n"]) for r in cloud.collect()) == [("negative", "hello", 1), ("positive", "hello", 2), ("positive", "world", 1)]
    assert "App" not in cloud._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]


def test_dedup_sorts_and_shuffles_no_text(spark, monkeypatch):
    from starlens.operators import duplicates as U

    rows = spark.range(70_000).repartition(3).select(
        F.lit("a").alias("App"), F.col("id").cast("string").alias("review_id"), F.timestamp_seconds("id").alias("Review_Date"),
        F.when(F.col("id") % 50 != 0, F.concat(F.lit("t"), (F.col("id") % 40_000).cast("string"))).alias("Review_Text"))
    want = {str(i) for i in range(70_000) if i % 50 and (i >= 30_000)} | {"69950"}
    for most in (U.BLOCKS, 0):
        monkeypatch.setattr(U, "BLOCKS", most)
        kept = U.dedup_keep_last(rows)
        got = [r["review_id"] for r in kept.collect()]
        assert len(got) == len(want) and set(got) == want and kept.columns == rows.columns
        plan = kept._jdf.queryExecution().toString()
        assert "Window" not in plan and ("strategy=broadcast" in plan) == bool(most)
