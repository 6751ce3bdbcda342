"""The cube, the search index and the sketches against the operators they stand for."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from starlens.functions import text as tx
from starlens.operators import aggregate as A, cube as B, enrich as E, keywords as K, sketches as H
from starlens.session import work_path
from starlens.sources import searchindex as Z, testtables as T
from test_operators import review, reviews


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def themed(spark, sf_dir):
    odd = reviews(spark, [review("n1", star=None), review("n2", text=None, theme=None), review("n3", at=None), review("n4", polarity=None, text="")])
    base = E.with_theme(T.reviews(spark, sf_dir))
    return base.select(*odd.columns).unionByName(odd).cache()


def test_cards_from_the_cube_are_those_from_the_reviews(themed):
    table = B.cube(themed)
    assert rows(B.overview(table)) == rows(A.overview(themed))
    assert rows(B.rating_distribution(table)) == rows(A.rating_distribution(themed))
    assert rows(B.theme_counts(table)) == rows(A.theme_counts(themed))
    assert rows(B.top_keywords(table)) == rows(K.top_keywords(themed))
    assert rows(A.series_from_parts(B.series_parts(table), "day")) == rows(A.daily_series(themed))


def test_an_empty_cube(themed):
    table = B.cube(themed.limit(0))
    assert [f(table).count() for f in (B.overview, B.rating_distribution, B.theme_counts, B.series_parts, B.top_keywords)] == [0] * 5


def test_few_passes_over_the_texts(spark, sf_dir):
    """Everything but the samples is read from the stored cube."""
    table = B.cube(E.with_theme(T.reviews(spark, sf_dir)))
    for f in (B.overview, B.theme_counts, B.top_keywords):
        assert "documents.parquet" not in f(table)._jdf.queryExecution().executedPlan().toString()


TEXTS = ["A slow day", "SLOW!", None, "", "ab", "slo w", "été à Paris", "ÉTÉ", "100% sure", "100 sure", "a.b", "axb", "😀😀 ok", "line\nbreak", "  spaces  "]


@pytest.mark.parametrize("query", ["slow", " Slow ", "ab", "a", "", "été", "100%", "a.b", "😀😀", "line\nb", "nowhere", "e b", "\nbr"])
def test_search_by_the_index_finds_what_a_scan_finds(spark, searched, query):
    folder, df = searched
    got = Z.search(spark, folder, df.schema, query)
    assert got.columns == df.columns and rows(got) == rows(df.where(tx.matches(F.col("Review_Text"), query)))


@pytest.fixture(scope="module")
def searched(spark):
    rng = random.Random(4)
    filler = [" ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(8)) for _ in range(600)]
    data = [(f"r{i}", t) for i, t in enumerate([*TEXTS, *filler, *TEXTS])]
    df = spark.createDataFrame(data, "review_id string, Review_Text string").repartition(6, "review_id").cache()
    folder = work_path(spark, "search")
    half = F.pmod(F.xxhash64("review_id"), F.lit(2))
    for k in (0, 1):
        assert Z.add(df.where(half == k), folder, batch=k) and not Z.add(df.where(half == k), folder, batch=k)
    return folder, df


def test_only_candidate_files_are_opened(spark, searched):
    folder, df = searched
    found = Z.search(spark, folder, df.schema, "été à paris")
    used = {r[0] for r in Z.candidates(spark, folder, "été à paris").select("file").collect()}
    assert found.count() == 2 and 1 <= len(used) <= 2
    assert {f.split("/data/")[1] for f in found.inputFiles()} == used


def test_many_candidates_are_scanned(spark, searched, monkeypatch):
    monkeypatch.setattr(Z, "FILES", 0)
    folder, df = searched
    assert rows(Z.search(spark, folder, df.schema, "three")) == rows(df.where(tx.matches(F.col("Review_Text"), "three")))


def test_merged_states_keep_their_bounds(spark):
    """Any span of days; values of any distribution."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 4)).alias("App"),
        F.date_add(F.lit(dt.date(2026, 1, 1)), (F.col("id") % 20).cast("int")).cast("timestamp").alias("Review_Date"),
        (F.col("id") % 15_013).cast("string").alias("review_id"), (F.pmod(F.xxhash64("id"), F.lit(1000)) * F.pmod(F.xxhash64("id"), F.lit(1000))).alias("Thumbs_Up_Count"))
    states = H.sketched(df)
    for low, high in (("2026-01-01", "2026-01-20"), ("2026-01-05", "2026-01-06")):
        span = states.where(F.col("day").between(low, high))
        exact = {r["App"]: r for r in df.where(F.date_format("Review_Date", "yyyy-MM-dd").between(low, high)).groupBy("App").agg(
            F.count_distinct("review_id").alias("d"), F.sort_array(F.collect_list("Thumbs_Up_Count")).alias("v")).collect()}
        quantiles = [0.01, 0.25, 0.5, 0.99]
        for r in H.merged(span).select("App", "n", H.distinct_count().alias("d"), *(H.quantile(q).alias(f"q{q}") for q in quantiles)).collect():
            e = exact[r["App"]]
            assert abs(r["d"] - e["d"]) <= H.DISTINCT_ERROR * e["d"] and r["n"] == len(e["v"])
            for q in quantiles:
                below, upto = (sum(f(v) for v in e["v"]) / len(e["v"]) for f in (lambda v: v < r[f"q{q}"], lambda v: v <= r[f"q{q}"]))
                assert below <= q + H.RANK_ERROR and upto >= q - H.RANK_ERROR
