"""Selection by cut-offs, versioned tables, the id index and their streams against plain versions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from starlens.operators import aggregate as A, ingest as I
from starlens.operators.topn import cuts, first_n_by_cut
from starlens.session import work_path
from starlens.sources import idindex, reviews as S, testtables as T, versioned as V
from starlens.streaming import jobs as J, refresh as G
from test_operators import review, reviews

ROWS = "App string, lead long, id long"


def ranked(rows, n):
    out = []
    for app in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == app), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        out += [(*r, k) for k, r in enumerate(mine[:n], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("n,buckets,spare", [(40, 64, 0), (40, 1024, 1000), (1, 4096, 0), (3000, 64, 0)])
def test_first_n_by_cut_with_ties_nulls_and_few_rows(spark, n, buckets, spare):
    rng = random.Random(n)
    rows = [("hot", rng.choice([5, 5, rng.randrange(-10**15, 10**15)]), i) for i in range(2500)]
    rows += [("ties", 7, i) for i in range(90)] + [("few", -3, 9000), ("few", None, 9001)] + [(None, rng.randrange(100), 9100 + i) for i in range(70)]
    rows += [("nulls", None, 9300 + i) for i in range(60)] + [("wide", x, 9400 + i) for i, x in enumerate((-2**61, 2**61, 0, 1, 2) * 12)]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = first_n_by_cut(df, ["App"], F.col("lead"), [F.col("lead").asc_nulls_last(), F.col("id")], n, buckets=buckets, spare=spare)
    assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(rows, n)


def test_few_rows_pass_the_cut(spark):
    """Of 20,000 rows of one group, little more than n are left before any shuffle."""
    df = spark.range(20_000).select(F.lit("A").alias("App"), F.pmod(F.xxhash64("id"), F.lit(10**12)).alias("lead"))
    row = cuts(df, ["App"], F.col("lead"), 100, buckets=64, spare=20).first()
    assert 100 <= df.where(F.col("lead") <= row["cut"]).count() <= 100 + 12 + 20 and row["total"] == 20_000
    assert cuts(df.limit(0), ["App"], F.col("lead"), 100).count() == 0


def test_newest_and_balanced_by_cut_are_those_of_the_window(spark, sf_dir, monkeypatch):
    df = T.reviews(spark, sf_dir, with_text=False)
    df = df.withColumn("Review_Date", F.date_trunc("hour", "Review_Date")).unionByName(df.limit(3).withColumn("Review_Date", F.lit(None).cast("timestamp")))
    want = [I.newest_n(df, 30).collect(), I.balanced_sample(df, 30).collect()]
    monkeypatch.setattr(I, "SMALL", 0)
    monkeypatch.setattr("starlens.operators.topn.SPARE", 0)
    assert [sorted(map(str, x)) for x in (I.newest_n(df, 30).collect(), I.balanced_sample(df, 30).collect())] == [sorted(map(str, x)) for x in want]


# versioned tables -----------------------------------------------------------------------------------

def full(spark, rows):
    df = reviews(spark, rows)
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in S.S.REVIEWS])


def ids(df):
    return sorted(r["review_id"] for r in df.collect())


def test_a_batch_counts_once_and_moves_the_mark_with_its_rows(spark):
    path = work_path(spark, "versions")
    assert S.stored_mark(spark, path) is None and ids(S.scan_reviews(spark, path)) == []
    first = full(spark, [review("a", at=dt.datetime(2026, 4, 2)), review("b", at=dt.datetime(2026, 5, 3, 4, 5, 6))])
    assert S.append_reviews(first, path, 0) and not S.append_reviews(first, path, 0)
    assert S.append_reviews(full(spark, [review("c", at=dt.datetime(2026, 4, 1))]), path, 1)
    assert ids(S.scan_reviews(spark, path)) == ["a", "b", "c"] and S.stored_mark(spark, path) == "2026-05-03 04:05:06.000000"
    assert S.append_reviews(full(spark, [review("d", at=dt.datetime(2026, 4, 1))]), path, 0, writer="other")
    S.rewrite_reviews(S.scan_reviews(spark, path).where("review_id <> 'b'"), path)
    assert ids(S.scan_reviews(spark, path)) == ["a", "c", "d"] and not S.append_reviews(first, path, 1)


def test_a_run_that_breaks_before_its_manifest_leaves_nothing(spark, monkeypatch):
    path = work_path(spark, "broken")
    S.append_reviews(full(spark, [review("a")]), path, 0)

    def stop(*_):
        raise OSError("stopped")

    more = full(spark, [review("b", at=dt.datetime(2027, 1, 1))])
    with monkeypatch.context() as m:
        m.setattr(V, "commit", stop)
        with pytest.raises(OSError):
            S.append_reviews(more, path, 1)
    assert ids(S.scan_reviews(spark, path)) == ["a"] and not S.stored_mark(spark, path).startswith("2027")
    assert S.append_reviews(more, path, 1) and ids(S.scan_reviews(spark, path)) == ["a", "b"]
    assert V.sweep(spark, path) == 1 and ids(S.scan_reviews(spark, path)) == ["a", "b"]


def test_of_two_writers_of_one_version_one_gives_up(spark):
    path = work_path(spark, "two")
    state = V.manifest(spark, path)
    part = V.write_part(spark.range(1).select(F.lit("x").alias("review_id")), path, "k")
    V.add(spark, path, state, [part])
    with pytest.raises(V.Conflict):
        V.add(spark, path, state, [part, part])
    assert V.manifest(spark, path)["version"] == 1 and V.scan(spark, path, "k", "review_id string").count() == 1


def test_a_bound_with_an_offset_finds_the_month_of_its_moment(spark):
    path = work_path(spark, "offset")
    S.append_reviews(full(spark, [review("a", at=dt.datetime(2024, 2, 29, 23, 0)), review("b", at=dt.datetime(2024, 2, 29, 22, 0))]), path)
    assert ids(S.scan_reviews(spark, path, "2024-03-01T00:30:00+02:00")) == ["a"]
    assert ids(S.scan_reviews(spark, path, None, "2024-03-01T00:30:00+02:00")) == ["b"]


def test_many_small_batches_leave_few_parts(spark):
    path = work_path(spark, "levels")
    for k in range(14):
        V.append(spark.range(k, k + 1).withColumn("one", F.lit(1)), path, "n", "w", k)
        V.append(spark.range(k, k + 1).withColumn("one", F.lit(1)), path, "n", "w", k)
        V.compact(spark, path, "n", "id long, one int", lambda x: x.coalesce(1), fan=3)
        assert sorted(r["id"] for r in V.scan(spark, path, "n", "id long, one int").collect()) == list(range(k + 1))
    parts = V.manifest(spark, path)["parts"]
    assert len(parts) <= 6 and max(p["level"] for p in parts) == 2
    before = len(parts)
    V.sweep(spark, path, keep=1)
    assert V.scan(spark, path, "n", "id long, one int").count() == 14 and len(V.manifest(spark, path)["parts"]) == before


def test_refresh_counts_a_batch_once_and_merges_parts(spark, sf_dir):
    df, path = T.reviews(spark, sf_dir, with_text=False), work_path(spark, "parts")
    slot = F.pmod(F.xxhash64("review_id"), F.lit(6))
    for k in range(6):
        for _ in range(2):
            assert G.store_refresh(spark, path, df.where(slot == k), k, fan=2) == (_ == 0)
    want = A.daily_series(df)
    assert G.published(spark, path).exceptAll(want).count() == 0 and G.published(spark, path).count() == want.count()
    assert len(V.manifest(spark, path)["parts"]) <= 3


# the id index ---------------------------------------------------------------------------------------

def index_of(spark, batches, buckets):
    path = work_path(spark, "ids")
    for k, names in enumerate(batches):
        V.add(spark, path, V.manifest(spark, path), idindex.parts_for(spark.createDataFrame([(n,) for n in names], "review_id string"), path, buckets), "w", k)
    return path


@pytest.mark.parametrize("buckets", [1, 16])
def test_strangers_are_those_no_batch_had(spark, buckets, monkeypatch):
    """Also with a filter so small that most answers are false alarms."""
    old = [[f"id{i}" for i in range(a, b)] for a, b in ((0, 300), (300, 301), (250, 900))]
    asked = [f"id{i}" for i in range(0, 1500, 7)] + ["é", ""]
    want = sorted(set(asked) - {n for names in old for n in names})
    for blocks in (idindex.BLOCKS, 2):
        monkeypatch.setattr(idindex, "BLOCKS", blocks)
        path = index_of(spark, old, buckets)
        rows = spark.createDataFrame([(n, 1) for n in asked], "review_id string, x int")
        for fan in (8, 2):
            got = idindex.strangers(rows, spark, path, V.manifest(spark, path), buckets)
            assert got.columns == ["review_id", "x"] and ids(got) == want
            idindex.compact(spark, path, fan)
        maybe = idindex.possible(idindex.placed(rows, buckets), idindex.merged_filters(V.scan(spark, path, idindex.FILTERS, idindex.FILTER_SCHEMA)))
        n = maybe.where("maybe").count()
        assert n >= len(asked) - len(want) and (blocks == 2 or n < len(asked) - len(want) + 20) and (blocks != 2 or buckets != 1 or n > len(asked) * 0.8)


def test_only_the_buckets_of_a_batch_are_read(spark):
    path = index_of(spark, [[f"id{i}" for i in range(500)]], 64)
    rows = spark.createDataFrame([("id3", 1), ("new", 1)], "review_id string, x int")
    found = idindex.strangers(rows, spark, path, V.manifest(spark, path), 64)
    assert ids(found) == ["new"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    mine = idindex.touched(idindex.placed(rows, 64))
    assert "PartitionFilters" in plan and len(mine) == 2 and all(str(m) in plan for m in mine)
    first = idindex.strangers(rows, spark, work_path(spark, "no_ids"), {"parts": []}, 64)
    assert first.count() == 2 and idindex.strangers(rows.limit(0), spark, path, V.manifest(spark, path), 64).count() == 0


def test_exact_ingest_reads_no_review_of_other_batches(spark, tmp_path):
    """Three batches with repeats; ids, rows and numbers are one step, and a broken one is made up for."""
    feed, folder, log = (work_path(spark, n) for n in ("feed", "store", "log"))
    schema = "App string, reviewId string, `at` string, score int, content string, thumbsUpCount bigint, appVersion string"
    seen = []
    for k, names in enumerate((["a", "b"], ["b", "c", "c"], ["a", "d"])):
        S.land_raw(spark.createDataFrame([("A", i, f"2026-04-0{k + 1} 10:00:00", 5, f"t {i}", 0, None) for i in names], schema).coalesce(1), feed)
        J.ingest_exact(J.raw_stream(spark, feed, max_files=1), folder, log, buckets=8, fan=2)
        seen.append(ids(J.read_batches(spark, f"{folder}/reviews", J.REVIEWS)))
    assert seen == [["a", "b"], ["a", "b", "c"], ["a", "b", "c", "d"]]
    assert ids(V.scan(spark, folder, idindex.IDS, idindex.ID_SCHEMA)) == ["a", "b", "c", "d"]
    state = V.manifest(spark, folder)
    assert state["batches"] == {log: 2} and state["mark"].startswith("2026-04-03") and json.dumps(state)


def test_daily_parts_stay_few_over_many_batches(spark):
    feed, folder, log = (work_path(spark, n) for n in ("daily_feed", "daily", "daily_log"))
    for d in range(1, 11):
        reviews(spark, [review(f"d{d}", at=dt.datetime(2026, 4, d, 12))]).coalesce(1).write.mode("append").parquet(feed)
    stream = spark.readStream.schema(reviews(spark, [review("x")]).schema).option("maxFilesPerTrigger", 1).parquet(feed)
    J.publish_daily(stream, folder, log, fan=3)
    assert {r["day"]: r["n"] for r in J.daily_parts(spark, folder).collect()} == {f"2026-04-{d:02}": 1 for d in range(1, 11)}
    assert len([p for p in V.manifest(spark, folder)["parts"] if p["kind"] == G.PARTS]) <= 4


def test_small_index_parts_are_few_files(spark, tmp_path):
    """A folder per bucket and part made hundreds of files a batch, however few ids came."""
    path = str(tmp_path / "ids")
    rows = spark.createDataFrame([(f"id{i}",) for i in range(500)], "review_id string")
    V.add(spark, path, V.manifest(spark, path), idindex.parts_for(rows, path, 64), "w", 0)
    files = list((tmp_path / "ids/data").rglob("*.parquet"))
    assert 2 <= len(files) <= 16 and not list((tmp_path / "ids/data").rglob("bucket=*"))
    held = V.scan(spark, path, idindex.IDS, idindex.ID_SCHEMA)
    assert held.exceptAll(idindex.placed(rows, 64).select("review_id", "bucket")).count() == 0 and held.count() == 500


def test_an_index_of_folders_is_still_asked(spark):
    path = work_path(spark, "old_ids")
    rows = spark.createDataFrame([(f"id{i}",) for i in range(20)], "review_id string")
    old = [V.write_part(idindex.placed(rows, 4).select("review_id", "bucket"), path, "ids", ["bucket"]),
           V.write_part(idindex.filter_rows(rows, 4), path, "id_filters", ["bucket"])]
    V.add(spark, path, V.manifest(spark, path), old, "w", 0)
    V.add(spark, path, V.manifest(spark, path), idindex.parts_for(spark.createDataFrame([("x",)], "review_id string"), path, 4), "w", 1)
    asked = spark.createDataFrame([("id3",), ("x",), ("new",)], "review_id string")
    assert ids(idindex.strangers(asked, spark, path, V.manifest(spark, path), 4)) == ["new"]


def test_a_batch_is_judged_in_one_pass(spark, tmp_path):
    """As ``ingested`` and ``quarantine`` have it; values of lines that are set aside are never cast."""
    lines = ['{"reviewId":"1","at":"2026-04-01 00:00:00","score":5,"content":"a b","thumbsUpCount":2}', '{"reviewId":"', '{"reviewId":"","at":"x y"}',
             '{"reviewId":"2","at":"2026-05-01 00:00:00"}', '{"reviewId":"3","at":null,"content":""}', '{"at":"2026-04-01 00:00:00"}']
    (tmp_path / "App=a").mkdir()
    (tmp_path / "App=a/f.json").write_text("\n".join(lines) + "\n")
    raw = S.scan_raw(spark, str(tmp_path)).cache()
    for window in ((None, None), ("2026-03-31 00:00:00", "2026-04-02 00:00:00")):
        rows = J.judged(raw, *window)
        good = J.ingested(raw, *window)
        assert sorted(map(str, rows.where("reason IS NULL").select(*good.columns).collect())) == sorted(map(str, good.collect()))
        bad = rows.where("reason IS NOT NULL").select(*(F.col(J.RAW + c).alias(c) for c in raw.columns), "reason")
        assert sorted(map(str, bad.collect())) == sorted(map(str, J.quarantine(raw).collect())) and bad.count() == 3
    assert rows.where("reason IS NULL").count() == 1


def test_exact_ingest_parses_a_batch_once(spark, tmp_path, monkeypatch):
    feed, folder, log = (work_path(spark, n) for n in ("once_feed", "once", "once_log"))
    schema = "App string, reviewId string, `at` string, score int, content string, thumbsUpCount bigint, appVersion string"
    S.land_raw(spark.createDataFrame([("A", f"i{k % 7}", f"2026-04-0{k % 5 + 1} 10:00:00", k, f"t {k}", 0, None) for k in range(20)], schema), feed)
    seen = spark.sparkContext.accumulator(0)
    raw = J.raw_stream(spark, feed)
    count = F.udf(lambda x: seen.add(1) or x)
    J.ingest_exact(raw.withColumn("content", count("content")).select(*raw.columns), folder, log)
    assert seen.value == 20
    got = sorted((r["review_id"], r["Star_Rating"]) for r in J.read_batches(spark, f"{folder}/reviews", J.REVIEWS).collect())
    # the newest of an id; of equal dates the least star
    want = {}
    for k in range(20):
        want.setdefault(f"i{k % 7}", []).append((-(k % 5), k))
    assert got == sorted((i, min(x)[1]) for i, x in want.items())
