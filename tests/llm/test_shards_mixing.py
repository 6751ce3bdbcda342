"""Extendible hashing and Poisson replication against plain versions."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from starlens.llm import mixing, sharding
from starlens.session import work_path


def leaves(docs, limit):
    """Splitting bucket by bucket."""
    bits = {i: format(int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16), "060b") for i, _ in docs}
    out, open_ = {}, [("", docs)]
    while open_:
        prefix, rows = open_.pop()
        if sum(len((t or "").encode()) for _, t in rows) <= limit or len({bits[i] for i, _ in rows}) == 1:
            out.update({(i, t): prefix for i, t in rows})
        else:
            open_ += [(prefix + b, part) for b in "01" if (part := [r for r in rows if bits[r[0]].startswith(prefix + b)])]
    return out


@pytest.mark.parametrize("limit", [1 << 30, 5000, 700, 10])
def test_shards_are_the_split_buckets(docs, corpus, limit):
    rows = sharding.shards(docs.withColumn("shard", F.lit("mine")).withColumn("depth", F.lit(1)), limit).collect()
    want = leaves(corpus, limit)
    text = dict(corpus)
    assert {r["doc_id"]: r["shard"] for r in rows} == {i: p for (i, _), p in want.items()} and len(rows) == len(corpus)
    total = Counter()
    for r in rows:
        total[r["shard"]] += len((text[r["doc_id"]] or "").encode())
    assert all(r["shard_bytes"] == total[r["shard"]] and r["shard_depth"] == len(r["shard"]) for r in rows)
    assert all(n <= limit or sum(r["shard"] == s for r in rows) == 1 for s, n in total.items())


def test_a_hot_id_is_one_shard(spark, none):
    rows = [(7, "x" * 100)] * 40 + [(i, "y" * 100) for i in range(20)] + [(None, "z" * 300)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id long, text string"), 250).collect()
    assert len(got) == 61 and len({r["shard"] for r in got if r["doc_id"] == 7}) == 1
    assert sharding.shards(none, 250).count() == 0


def test_written_shards_hold_every_row(spark, docs, corpus):
    target = work_path(spark, "shards")
    sharding.write_shards(docs, target, 5000)
    back = spark.read.option("basePath", target).parquet(target)
    assert back.select("doc_id", "text").exceptAll(docs).count() == 0 and back.count() == len(corpus)


@pytest.fixture(scope="module")
def sourced(docs):
    return docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").when(F.col("doc_id") % 7 == 1, F.lit(None)).otherwise(F.concat(F.lit("s"), F.col("doc_id") % 5)))


@pytest.mark.parametrize("few", [10_000, 2])
def test_copies_match_inverted_draws(sourced, few, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", few)
    rows = sourced.collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len((r["text"] or "").encode())
    scale = 1.5 * sum(size.values()) / sum(b ** 0.7 for b in size.values())
    mixed = mixing.mix(sourced.withColumn("rate", F.lit("mine")).withColumn("_n", F.lit(1)), epochs=1.5).collect()
    got = Counter(r["doc_id"] for r in mixed)
    assert dict(got) == {r["doc_id"]: n for r in rows if (n := brute.poisson(r["doc_id"], scale * size[r["source"]] ** 0.7 / size[r["source"]]))}
    assert all(r["text"] == t for t, r in [(dict(map(tuple, [(x["doc_id"], x["text"]) for x in rows]))[m["doc_id"]], m) for m in mixed])
    assert len({r["shuffle_key"] for r in mixed}) == len(mixed) and {r["_n"] for r in mixed} == {1}


def test_target_weights_are_met_on_average(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("x" * 10).alias("text"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"))
    copies = {r["source"]: r["count"] for r in mixing.mix(docs, {"big": 1, "small": 3, "absent": 9}, epochs=2.0).groupBy("source").count().collect()}
    # 'absent' has no rows, so the others share the mix
    assert abs(copies["big"] - 10000) < 500 and abs(copies["small"] - 30000) < 900
    only = mixing.mix(docs, {"small": 1.0}).select("source").distinct().collect()
    assert [r["source"] for r in only] == ["small"]


def test_large_rates_and_nothing(spark, none):
    rate = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in (0.001, 3.0, 900.0)])).alias("rate")).withColumn("cdf", mixing.cumulative(F.col("rate"))).collect()
    for r in rate:
        assert abs(r["cdf"][-1] - 1) < 1e-9 and all(a <= b for a, b in zip(r["cdf"], r["cdf"][1:]))
    assert mixing.mix(none.withColumn("source", F.lit("s"))).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert mixing.mix(blank).count() >= 0
