"""Quality rules, language identification and toxicity: exact counts, and accuracy on rows not learned from."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from starlens.llm import language, quality, toxicity
from starlens.llm.common import documents

SF = "/root/testdata/sf0.01"


def test_counts_of_every_text(spark, docs, corpus):
    extra = [(300, "a b c d e f g h " * 3 + "x"), (301, "L1\nL1\n\n \nl2\nL1\n"), (302, "A# b$ ## é%\x0bz|<>\r\n&*")]
    rows = {r["doc_id"]: r for r in quality.counts(docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string")).withColumn("n_words", F.lit("mine"))).collect()}
    for doc_id, text in corpus + extra:
        text, r = text or "", rows[doc_id]
        words = [w for w in text.replace("\n", " ").replace("\t", " ").replace("\x0b", " ").replace("\r", " ").split(" ") if w]
        lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
        assert (r["n_words"], r["word_chars"]) == (len(words), sum(map(len, words)))
        assert r["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert (r["n_lines"], r["n_dup_lines"]) == (len(lines), len(lines) - len(set(lines)))
        assert r["n_repeat_words"] == brute.repeated_words(text)


def test_em_finds_the_share_of_good_texts(spark):
    rng = np.random.default_rng(1)
    good = rng.random(4000) < 0.8
    names = [f"vote_{i}" for i in range(5)]
    right_good, right_bad = 0.99, [0.7, 0.6, 0.5, 0.65, 0.4]
    columns = [np.where(rng.random(4000) < 0.1, 0, np.where(good, np.where(rng.random(4000) < right_good, 1, -1), np.where(rng.random(4000) < b, -1, 1))) for b in right_bad]
    voted = spark.createDataFrame([tuple(int(c[i]) for c in columns) for i in range(4000)], ", ".join(f"{n} int" for n in names))
    prior, _, bad = quality.learn(voted, names, 40)
    assert abs(prior - good.mean()) < 0.03
    assert all(abs(bad[n] - b) < 0.08 for n, b in zip(names, right_bad))


def test_verdicts_agree_with_labels(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.judge(documents(spark, SF)).join(labels, "doc_id").collect()
    junk = [r for r in rows if r["quality"] == 0]
    fine = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    assert sum(not r["kept"] for r in junk) >= 0.95 * len(junk)
    assert sum(r["kept"] for r in fine) >= 0.98 * len(fine)
    # the estimates follow the labels, and none ends at a bound
    names = [f"vote_{r.name}" for r in quality.RULES]
    voted = quality.judge(documents(spark, SF)).where("not base_failed")
    prior, good, bad = quality.learn(voted, names)
    assert 0.8 < prior < 0.95
    seen = voted.join(labels.where("quality = 1"), "doc_id").collect()
    for n in names:
        votes = [r[n] for r in seen if r[n]]
        assert abs(good[n] - sum(v == 1 for v in votes) / len(votes)) < 0.015, (n, good[n])
        assert 0 < bad[n] < 1 and 1 - good[n] < bad[n], (n, good[n], bad[n])


def test_odd_tables_are_judged(spark, none):
    assert quality.judge(none).count() == 0
    rows = quality.judge(spark.createDataFrame([(1, None), (1, ""), (2, "few words"), (None, "a b " * 50)], "doc_id long, text string")).collect()
    assert len(rows) == 4 and not any(r["kept"] for r in rows)


@pytest.fixture(scope="module")
def model(spark):
    return language.train(documents(spark, SF))


def test_languages_of_held_out_documents(spark, model):
    docs = documents(spark, SF)
    rows = language.predicted(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held) > 100
    assert language.recognised(docs, model).count() >= 0.99 * len(rows)
    # neither language, source nor id enters a prediction
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit("s"))
    assert {r["doc_id"]: r["lang_pred"] for r in language.predicted(other, model).collect()} == {r["doc_id"]: r["lang_pred"] for r in rows}


def test_mixed_foreign_and_empty_texts(spark, model, none):
    docs = {r["lang"]: r["text"] for r in documents(spark, SF).where(F.length("text").between(400, 3000)).select("lang", "text").collect()}
    mixed = docs["en"] + " | " + docs["de"]
    rows = {r["doc_id"]: r for r in language.predicted(spark.createDataFrame(
        [(1, mixed), (2, None), (3, ""), (4, "12 !? 3"), (5, "Привет всем"), (6, docs["fr"] * 300), (6, docs["fr"])], "doc_id long, text string"), model).collect()}
    assert {s["lang"] for s in rows[1]["spans"]} >= {"de", "en"} and rows[1]["spans"][-1]["lang"] == "de"
    at = max(s["start"] for s in rows[1]["spans"] if s["lang"] == "de" and s["start"] <= len(docs["en"]) + 20)
    assert at >= len(docs["en"]) - 40
    assert all((rows[k]["lang_pred"], rows[k]["score"], rows[k]["spans"]) == ("und", 0.0, []) for k in (2, 3, 4))
    assert rows[5]["score"] == 0.0 and rows[6]["lang_pred"] == "fr"
    kept = language.recognised(spark.createDataFrame([(1, docs["en"], "k"), (2, None, "k"), (5, "Привет", "k")], "doc_id long, text string, spans string"), model)
    assert [tuple(r) for r in kept.collect()] == [(1, docs["en"], "k")]
    assert language.predicted(none, model).count() == 0
    untaught = language.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert [r["lang_pred"] for r in language.predicted(spark.createDataFrame([(1, "text")], "doc_id long, text string"), untaught).collect()] == ["und"]


def test_scripts_narrow_the_candidates(spark):
    rows = [(i, text, lang) for i in range(100) for text, lang in (("the cat and the dog", "en"), ("кот и собака", "ru"), ("кіт та собака це", "uk"))]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    _, can = model.scores(language.words(["cat кот"]))
    assert model.languages == ("en", "ru", "uk") and can.tolist() == [[True, False, False], [False, True, True]]


def test_the_short_way_is_the_best_labelling():
    rng = np.random.default_rng(5)
    for many in (1, 2, 4):
        text = np.sort(rng.integers(0, 30, 900))
        scores = rng.normal(0, 2, (900, many)) + np.where(rng.random(900)[:, None] < 0.5, np.eye(many)[text % many] * 3, 0)
        got = language.labelled(scores, text, 4.0)

        def worth(rows, labels):
            return scores[rows, labels].sum() - 4.0 * (np.diff(labels) != 0).sum()

        for t in np.unique(text):
            rows = np.flatnonzero(text == t)
            assert abs(worth(rows, got[rows]) - worth(rows, language.viterbi(scores[rows], 4.0))) < 1e-6


def test_toxic_documents_not_learned_from(spark):
    large = "/root/testdata/sf0.1"
    docs, labels = documents(spark, large), spark.read.parquet(f"{large}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    model = toxicity.train(docs, labels.where(~held))
    rows = toxicity.scored(docs.withColumn("toxic", F.lit("mine")), model).withColumnRenamed("toxic", "flag").join(labels.where(held), "doc_id").collect()
    toxic, clean = [r for r in rows if r["toxic"]], [r for r in rows if not r["toxic"]]
    assert sum(r["flag"] for r in toxic) >= 0.85 * len(toxic) > 50
    assert sum(not r["flag"] for r in clean) >= 0.98 * len(clean)
    assert np.mean([r["severity"] for r in toxic]) > 10 * np.mean([r["severity"] for r in clean])


def test_thresholds_are_ordered_and_weights_shared():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    x = rng.random((3000, 3)) * 3
    score = x @ np.array([2.0, -1.0, 0.5]) + rng.logistic(size=3000)
    grade = np.digitize(score, [0.5, 2.0, 4.0])
    weights, thresholds = toxicity.fit(grade, pa.array([[0, 1, 2]] * 3000, pa.list_(pa.int32())), pa.array(x.tolist(), pa.list_(pa.float64())), 3, 4)
    assert np.allclose(weights, [2.0, -1.0, 0.5], atol=0.25) and np.allclose(thresholds, [0.5, 2.0, 4.0], atol=0.35)
    none = toxicity.fit(np.zeros(0, np.int64), pa.array([], pa.list_(pa.int32())), pa.array([], pa.list_(pa.float64())), 2, 3)
    assert (np.diff(none[1]) > 0).all()


def test_toxicity_of_odd_texts(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(none, labels)
    rows = toxicity.scored(spark.createDataFrame([(1, None), (1, ""), (None, "x " * 50000)], "doc_id long, text string"), model).collect()
    assert len(rows) == 3 and not any(r["toxic"] for r in rows) and toxicity.scored(none, model).count() == 0


def test_words_with_marks_are_seen_when_scored():
    """The same rule finds words when they are chosen and when they are scored."""
    vocabulary = {w: i for i, w in enumerate(["हिन्दी", "مُحَمَّد", "ภาษาไทย", "plain"])}
    assert [i for i, _ in toxicity.features("यह हिन्दी, مُحَمَّد ภาษาไทย PLAIN", vocabulary)] == [0, 1, 2, 3]


def test_without_labelled_rows_all_texts_with_letters_stay(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "12 34", None), (3, None, None), (4, "и ещё", None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert {r["doc_id"] for r in language.recognised(docs, model).collect()} == {1, 4}
    assert language.recognised(docs.limit(0), model).count() == 0


def test_character_tables_take_little_memory():
    import tracemalloc

    language.tables.cache_clear()
    tracemalloc.start()
    script, lower = language.tables()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32_000_000  # all characters as strings took over 80 MB in every worker
    assert script[ord("1")] == -1 and script[ord("é")] == language.SCRIPTS.index("Latin") and lower[ord("É")] == ord("é")
