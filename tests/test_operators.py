"""Operators against brute force, with hot groups and the special cases of the review data."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from starlens.functions import dates
from starlens.functions import formatting as fm
from starlens.operators import (
    aggregate as A, classify as C, compare as P, distribution as D, duplicates as U, enrich as E, ingest as I, intervals as V,
    keywords as K, quantiles as Q,
)
from starlens.operators.topn import first_n
from starlens.session import work_path

START = dt.datetime(2026, 4, 1)
REVIEW = ("review_id string, App string, Review_Date timestamp, Star_Rating int, Review_Text string, "
          "Thumbs_Up_Count bigint, Sentiment_Polarity double, Review_Theme string")


def review(i, app="A", at=START, star=5, text="fine", thumbs=0, polarity=0.5, theme="General"):
    return (i, app, at, star, text, thumbs, polarity, theme)


def reviews(spark, rows):
    return spark.createDataFrame(rows, REVIEW)


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows belong to one product and share one text."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        hot = rng.random() < 0.66
        rows.append(review(
            f"r{i:05d}", "Hot" if hot else rng.choice("BCD"), START + dt.timedelta(seconds=rng.randrange(0, 20 * 86400, 600)),
            rng.randint(1, 5), "same" if hot else rng.choice(["x", "y", None, "", f"only {i}"]),
            int(rng.paretovariate(0.9)), round(rng.uniform(-1, 1), 3) if rng.random() < 0.9 else None))
    return rows


# top n -----------------------------------------------------------------------------------------

@pytest.mark.parametrize("partitions, n", [(1, 3), (40, 3), (40, 5000)])
def test_first_n_is_exact_for_a_hot_group(spark, skewed, partitions, n):
    df = reviews(spark, skewed).repartition(partitions)
    got = first_n(df, ["App"], [F.desc("Thumbs_Up_Count"), F.asc("review_id")], n)
    got = {(r["App"], r["rank"], r["review_id"]) for r in got.collect()}
    want = set()
    for app in {r[1] for r in skewed}:
        ranked = sorted((r for r in skewed if r[1] == app), key=lambda r: (-r[5], r[0]))
        want |= {(app, k + 1, r[0]) for k, r in enumerate(ranked[:n])}
    assert got == want


def test_first_n_merges_salts_in_rounds(spark, skewed):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        df = reviews(spark, skewed).repartition(200)
        got = first_n(df, ["App"], [F.asc("review_id")], 2).where("App = 'Hot'").orderBy("rank").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert [r["review_id"] for r in got] == sorted(r[0] for r in skewed if r[1] == "Hot")[:2]


def test_null_polarity_ranks_last(spark):
    df = reviews(spark, [review("a", star=1, polarity=None), review("b", star=1, polarity=0.9)])
    assert [r["review_id"] for r in A.most_negative(df, 2).orderBy("rank").collect()] == ["b", "a"]


# quantiles --------------------------------------------------------------------------------------

@pytest.mark.parametrize("seed", range(4))
def test_quantiles_match_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    values = {"a": rng.integers(0, 5, 400).astype(float), "b": rng.normal(size=333), "c": np.array([2.5]),
              "d": np.repeat([1.0, 9.0], [500, 1])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [("p0", 0.0), ("p10", 0.1), ("p50", 0.5), ("p99", 0.99), ("p100", 1.0)]
    got = {r["g"]: r for r in Q.quantiles(df, ["g"], "v", probs).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        for name, p in probs:
            assert got[g][name] == pytest.approx(np.quantile(vs, p)), (g, name)


def test_quantile_of_published_example(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (10,)], "Thumbs_Up_Count int")
    assert D.cap_value(df, "Thumbs_Up_Count").first()["cap"] == pytest.approx(9.79)
    assert max(r[0] for r in D.winsorize(df).select("Thumbs_Up_Capped").collect()) == pytest.approx(9.79)


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    df = spark.createDataFrame([(0.0, 3.0), (1.0, 3.0), (9.9, 3.0), (10.0, 3.0), (None, 3.0)], "v double, constant double")
    rows = D.histogram(df, ["v", "constant"], 10).collect()
    bins = {r["bin"]: r["n"] for r in rows if r["column"] == "v"}
    assert bins == {0: 1, 1: 1, **{b: 0 for b in range(2, 9)}, 9: 2}
    assert sum(r["n"] for r in rows if r["column"] == "constant") == 5


def test_kde_matches_direct_sum(spark):
    rng = np.random.default_rng(1)
    values = np.round(rng.normal(size=300), 1)
    got = D.kde(spark.createDataFrame([(float(v),) for v in values], "v double"), "v", points=20).orderBy("point").collect()
    h = values.std(ddof=1) * len(values) ** -0.2
    for r, x in zip(got, np.linspace(values.min(), values.max(), 20)):
        want = np.exp(-0.5 * ((x - values) / h) ** 2).sum() / (len(values) * h * np.sqrt(2 * np.pi))
        assert r["density"] == pytest.approx(want, abs=1e-5)


def test_bootstrap_interval_is_near_the_normal_one_and_repeatable(spark, skewed):
    df = reviews(spark, skewed)
    boot = {r["App"]: r for r in V.mean_bootstrap_interval(df, ["App"], "Star_Rating").collect()}
    again = {r["App"]: r for r in V.mean_bootstrap_interval(df.repartition(13), ["App"], "Star_Rating").collect()}
    normal = {r["App"]: r for r in V.mean_normal_interval(df, ["App"], "Star_Rating").collect()}
    assert boot == again
    for app, r in boot.items():
        assert r["mean"] == normal[app]["mean"]
        assert r["ci_low"] == pytest.approx(normal[app]["ci_low"], abs=0.05)
        assert r["ci_high"] == pytest.approx(normal[app]["ci_high"], abs=0.05)


# duplicates ---------------------------------------------------------------------------------------

@pytest.mark.parametrize("hot_share", [1000, 2, 1])  # many hot texts, one, none
def test_duplicate_rows_with_a_hot_text(spark, skewed, monkeypatch, hot_share):
    monkeypatch.setattr(U, "HOT_SHARE", hot_share)
    got = sorted(r["review_id"] for r in U.duplicate_rows(reviews(spark, skewed)).collect())
    frame = pd.DataFrame(skewed).rename(columns={0: "id", 4: "text"})
    want = sorted(frame[frame.duplicated(subset=["text"], keep=False)]["id"])
    assert got == want


def test_dedup_keep_last(spark, skewed):
    got = sorted(r["review_id"] for r in U.dedup_keep_last(reviews(spark, skewed)).collect())
    frame = pd.DataFrame(skewed).rename(columns={0: "id", 1: "app", 2: "at", 4: "text"})
    want = sorted(frame.sort_values(["at", "id"]).drop_duplicates(["app", "text"], keep="last")["id"])
    assert got == want


def test_a_null_date_counts_as_last(spark):
    df = reviews(spark, [review("a", at=None), review("b", at=START)])
    assert [r["review_id"] for r in U.dedup_keep_last(df).collect()] == ["a"]


def test_duplicate_patterns_match_a_plain_walk(spark, skewed):
    got = {r["pattern"]: r["links"] for r in U.duplicate_patterns(reviews(spark, skewed), 60).collect()}
    by_text, want = {}, {}
    for r in skewed:
        if r[4] is not None:
            by_text.setdefault(r[4], []).append((r[2], r[1], r[3]))
    for copies in by_text.values():
        copies.sort()
        for (t0, a0, s0), (t1, a1, s1) in zip(copies, copies[1:]):
            near = (t1 - t0).total_seconds() <= 3600
            kind = ("spam" if near else "ambiguous") if a0 != a1 else "updated" if s0 != s1 else "repeated"
            want[kind] = want.get(kind, 0) + 1
    assert got == want


# ingest ---------------------------------------------------------------------------------------------

def test_window_is_open_below_and_closed_above(spark):
    rows = [review(i, at=START + dt.timedelta(days=d)) for i, d in (("a", 0), ("b", 1), ("c", 2), ("d", 3))]
    df = reviews(spark, rows)
    kept = I.time_window(df, "2026-04-01 00:00:00", "2026-04-03 00:00:00")
    assert sorted(r["review_id"] for r in kept.collect()) == ["b", "c"]
    assert I.time_window(df, "2026-04-01 00:00:00").count() == 3


def test_new_reviews_drops_known_repeated_and_blank_ids(spark):
    stored = reviews(spark, [review("a"), review(None)])
    batch = reviews(spark, [review("a"), review("b"), review("b", star=1), review(""), review(None), review("c")])
    assert sorted(r["review_id"] for r in I.new_reviews(batch, stored).collect()) == ["b", "c"]
    kept, aside = I.split_bad_ids(batch)
    assert (kept.count(), aside.count()) == (4, 2)


def test_normalize_defaults(spark):
    raw = spark.createDataFrame(
        [("A", "i", "2026-04-01T10:00:00+02:00", 5, None, None, None)],
        "App string, reviewId string, at string, score int, content string, thumbsUpCount bigint, appVersion string")
    r = I.normalize(raw).first()
    assert (r["Word_Count"], r["Review_Length_Chars"], r["Thumbs_Up_Count"], r["App_Version"]) == (0, 0, 0, "Unknown")
    assert r["Sentiment_Polarity"] is None and r["Review_Theme"] is None
    assert I.normalize(raw).select(dates.second_text(F.col("Review_Date"))).first()[0] == "2026-04-01 08:00:00"


def test_dates_coerce_or_raise(spark):
    df = spark.createDataFrame([("nope",)], "t string")
    assert df.select(dates.parse_coerce(F.col("t"))).first()[0] is None
    with pytest.raises(Exception, match="CANNOT_PARSE_TIMESTAMP|CAST_INVALID_INPUT"):
        df.select(dates.parse_strict(F.col("t"))).collect()


def test_balanced_sample_does_not_depend_on_partitioning(spark, skewed):
    df = reviews(spark, skewed)
    first = {r["review_id"] for r in I.balanced_sample(df, 20).collect()}
    assert first == {r["review_id"] for r in I.balanced_sample(df.repartition(17), 20).collect()}
    assert len(first) == 80


def test_backfill_is_idempotent_and_keeps_values(spark):
    df = reviews(spark, [review("a", text="terrible", polarity=None, theme=None), review("b", text="bug", polarity=0.1, theme="Kept")])
    once = E.backfill(df)
    rows = {r["review_id"]: (r["Sentiment_Polarity"], r["Review_Theme"]) for r in once.collect()}
    assert rows == {"a": (-1.0, "General"), "b": (0.1, "Kept")}
    assert E.backfill(once).exceptAll(once).count() == 0
    report = E.missing_report(once).first()
    assert (report["total_rows"], report["missing_rows"]) == (2, 0)


def test_nothing_is_written_when_nothing_is_missing(spark):
    path = work_path(spark, "filled")
    df = reviews(spark, [review("a", text="terrible", polarity=None), review("b")])
    assert E.backfill_to(df, path) == 1
    filled = spark.read.schema(df.schema).parquet(path)
    assert E.backfill_to(filled, work_path(spark, "never")) == 0
    assert filled.where("review_id = 'a'").first()["Sentiment_Polarity"] == -1.0


def test_metrics_are_observed_without_another_pass(spark):
    seen = Observation("batch")
    df = I.observed(reviews(spark, [review("a", theme=None), review("b")]), seen)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 2, "missing": 1}


# aggregates ---------------------------------------------------------------------------------------------

def test_one_row_group_has_no_spread(spark):
    r = A.overview(reviews(spark, [review("a", star=4)])).first()
    assert r["std_dev"] is None and r["avg_star"] == 4.0


def test_means_skip_nulls_and_null_dates_are_dropped(spark):
    df = reviews(spark, [review("a", polarity=None), review("b", polarity=0.25), review("c", at=None)])
    assert A.overview(df).first()["avg_sentiment"] == 0.375
    rows = A.daily_series(df).collect()
    assert [(r["day"], r["n"], r["avg_sentiment"]) for r in rows] == [("2026-04-01", 2, 0.25)]


def test_rating_distribution_has_all_stars(spark):
    rows = A.rating_distribution(reviews(spark, [review("a", star=5)])).collect()
    assert {r["star"]: r["n"] for r in rows} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1}


def test_top_theme_with_and_without_the_default(spark):
    df = reviews(spark, [review("a"), review("b"), review("c", theme="Bugs/Performance"), review("d", app="B")])
    counts = A.theme_counts(df)
    assert {r["App"]: r["top_theme"] for r in A.top_theme(counts).collect()} == {"A": "Bugs/Performance"}
    assert {r["App"]: r["top_theme"] for r in A.top_theme(counts, ()).collect()} == {"A": "General", "B": "General"}


def test_rounding_is_half_up_and_glyphs_half_even(spark):
    df = spark.createDataFrame([(0.12345, 4.5, 3.5)], "a double, b double, c double")
    r = df.select(fm.rounded(F.col("a")).alias("a"), fm.star_glyphs(F.col("b")).alias("b"), fm.star_glyphs(F.col("c")).alias("c"),
                  fm.thousands(F.lit(1234567)).alias("n"), fm.product_label(F.lit("Google_Gemini")).alias("p")).first()
    assert (r["a"], r["b"], r["c"], r["n"], r["p"]) == (0.1235, "★★★★☆", "★★★★☆", "1,234,567", "Google Gemini")


def test_invariants_of_the_published_tables(spark, skewed):
    df = E.with_theme(reviews(spark, skewed))
    total = {r["App"]: r["total_reviews"] for r in A.overview(df).collect()}

    def sums(table):
        return {r["App"]: r["s"] for r in table.groupBy("App").agg(F.sum("n").alias("s")).collect()}

    assert sums(A.theme_counts(df)) == sums(A.rating_distribution(df)) == sums(A.daily_series(df)) == total
    everything = A.kpi_rollup(df).where("App = 'All'").first()
    assert everything["total_reviews"] == len(skewed) and everything["std_dev"] is None
    weighted = A.weighted_all(A.overview(df)).first()
    assert weighted["avg_star"] == pytest.approx(everything["avg_star"], abs=1e-4)


def test_merged_cloud_is_cut_per_product_first(spark):
    top = spark.createDataFrame([("A", "positive", "word", 3, 1), ("B", "positive", "word", 2, 1), ("B", "positive", "other", 2, 2)],
                                "App string, polarity string, word string, n bigint, rank int")
    rows = K.merged_cloud(top).orderBy("rank").collect()
    assert [(r["word"], r["n"]) for r in rows] == [("word", 5), ("other", 2)]
    sizes = {r["word"]: (r["size"], r["opacity"]) for r in K.cloud_weights(K.merged_cloud(top)).collect()}
    assert sizes == {"word": (2.4, 1.0), "other": (0.8, 0.55)}
    single = K.cloud_weights(K.merged_cloud(top.where("App = 'A'"))).first()
    assert (single["size"], single["opacity"]) == (1.4, 0.55)


# classification --------------------------------------------------------------------------------------------

def test_report_on_a_known_table(spark):
    pairs = [(1, 1)] * 6 + [(1, 0)] * 2 + [(0, 0)] * 3 + [(0, 1)]
    rows = {r["class"]: r for r in C.classification_report(spark.createDataFrame(pairs, "label int, prediction int")).collect()}
    assert (rows["1"]["precision"], rows["1"]["recall"], rows["1"]["support"]) == (0.8571, 0.75, 8)
    assert (rows["0"]["precision"], rows["0"]["recall"], rows["0"]["support"]) == (0.6, 0.75, 4)
    assert rows["accuracy"]["f1"] == 0.75 and rows["macro avg"]["support"] == 12
    matrix = {r["label"]: (r["predicted_0"], r["predicted_1"]) for r in
              C.confusion_matrix(spark.createDataFrame(pairs, "label int, prediction int")).collect()}
    assert matrix == {1: (2, 6), 0: (3, 1)}


def test_label_of_a_null_star_is_zero(spark):
    rows = C.label(reviews(spark, [review("a", star=None), review("b", star=4), review("c", star=3)])).collect()
    assert {r["review_id"]: r["label"] for r in rows} == {"a": 0, "b": 1, "c": 0}


def test_tfidf_weights(spark):
    docs = spark.createDataFrame([(1, "Red red blue", 1), (2, "blue the", 0)], "id bigint, text string, label int")
    worded = C.with_words(docs)
    fitted = C.fit_tfidf(worded)
    assert fitted.words == ["blue", "red"]
    vector = fitted.transform(worded).where("id = 1").first()["features"].toArray()
    raw = np.array([1 * 1.0, 2 * (np.log(3 / 2) + 1)])
    assert vector == pytest.approx(raw / np.linalg.norm(raw))


@pytest.mark.parametrize("kind", ["logreg", "svc", "forest"])
def test_models_learn_an_obvious_rule(spark, kind):
    rows = [(i, f"{'great superb' if i % 2 else 'awful broken'} item number{i % 7}", i % 2) for i in range(200)]
    out = C.train_and_predict(spark.createDataFrame(rows, "id bigint, text string, label int"), kind)
    scored = [(r["label"], r["prediction"]) for r in out.collect()]
    assert 20 <= len(scored) <= 70
    assert all(a == b for a, b in scored)


def test_bootstrap_of_tiny_groups(spark):
    df = spark.createDataFrame([("a", 5), ("b", 1), ("b", 3)], "App string, v int")
    rows = {r["App"]: r for r in V.mean_bootstrap_interval(df, ["App"], "v", replicas=200).collect()}
    assert rows["a"]["ci_low"] == rows["a"]["ci_high"] == 5.0
    assert rows["b"]["ci_low"] == 1.0 and rows["b"]["ci_high"] == 3.0


@pytest.mark.parametrize("values", [[], [2.0], [2.0, 2.0, None]])
def test_a_column_without_spread_has_no_density(spark, values):
    assert D.kde(spark.createDataFrame([(v,) for v in values], "v double"), "v", points=5).count() == 0


def test_shares_of_nothing_are_null(spark):
    df = reviews(spark, [review("a", polarity=None), review("b", app="B", polarity=0.0)])
    assert {r["App"]: r["zero_pct"] for r in A.zero_share(df).collect()} == {"A": None, "B": 100.0}


def test_cards_count_any_stored_theme(spark):
    themes = ["Shipping", "Shipping", "Bugs/Performance", "General", "General", "General"]
    df = reviews(spark, [review(f"r{i}", theme=t, star=1 + i % 5) for i, t in enumerate(themes)] + [review("x", app="B", theme=None)])
    cards = {r["App"]: r for r in P.product_cards(df).collect()}
    assert cards["A"]["top_pain_point"] == "Shipping" and cards["B"]["top_pain_point"] is None
    overview = {r["App"]: r for r in A.overview(df).collect()}
    for app, card in cards.items():
        assert all(card[c] == overview[app][c] for c in ("total_reviews", "avg_star", "avg_sentiment", "std_dev"))


def test_of_rows_alike_up_to_the_text_the_same_one_stays(spark):
    rows = [review("r", text=t) for t in ("one", "two", "three")]
    kept = {I.unique_ids(reviews(spark, order).repartition(n)).first()["Review_Text"] for order in (rows, rows[::-1]) for n in (1, 3)}
    assert len(kept) == 1
