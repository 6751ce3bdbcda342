"""Token ids, packing and token files: exact round trips."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from starlens.llm import packing, tokenfiles, tokens
from starlens.session import work_path


@pytest.fixture(scope="module")
def ids():
    plain = Tokenizer.from_file(tokens.default_path())
    return lambda text: plain.encode(text or "", add_special_tokens=False).ids + [2]


def test_parts_give_the_ids_of_the_whole(monkeypatch):
    encoder, plain = tokens.Encoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    monkeypatch.setattr(tokens, "SLICE_BYTES", 500)
    monkeypatch.setattr(tokens, "CACHED_PARTS", 300)
    rng = random.Random(1)
    letters = " \n\t　\xa0ab'1.é漢😀|s \x1c\x85\r  ​#<"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    texts += [None, "", " ", "  ", "a " * 5, "<|endoftext|>", " <|endoftext|> x", "start <|endoftext|> end", "a  <|endoftext|>b\n<|endoftext|>", "y" * 3000]
    seen = 0
    for begin, got, edges in encoder.encode(pa.array(texts)):
        assert begin == seen
        for k in range(len(edges) - 1):
            assert got[edges[k]:edges[k + 1]].tolist() == plain.encode(texts[begin + k] or "", add_special_tokens=False).ids
        seen += len(edges) - 1
    assert seen == len(texts)


@pytest.mark.parametrize("lengths", [[], [1], [1024], [512, 512, 1], [600, 500, 400, 300, 124], [1] * 3000, list(range(1, 1025))])
def test_bins_hold_every_item_once(lengths):
    bins = packing.best_two_fit(np.array(lengths, dtype=np.int64), 1024)
    assert (bins >= 0).all() and len(bins) == len(lengths)
    if lengths:
        assert np.bincount(bins, weights=lengths).max() <= 1024 and set(bins) == set(range(bins.max() + 1))


def test_two_items_replace_the_smallest_where_they_fit_better():
    # greedy: 600 + 350 leaves 74; 350 makes room for 214 + 210
    lengths = np.array([600, 350, 214, 210])
    bins = packing.best_two_fit(lengths, 1024)
    assert bins.tolist() == [0, 1, 0, 0]


def test_packing_is_tight():
    lengths = np.random.default_rng(3).integers(1, 600, 5000)
    assert packing.best_two_fit(lengths, 1024).max() + 1 <= 1.002 * -(-lengths.sum() // 1024)


def check_packed(rows, texts, ids, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"]
    for doc_id, text in texts:
        pieces = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        assert np.frombuffer(b"".join(r["ids"] for r in pieces), "<u4").tolist() == ids(text)
        assert all(r["length"] == capacity for r in pieces[1:])
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity


def test_documents_are_packed_whole(spark, docs, corpus, ids):
    wider = docs.withColumn("ids", F.lit("mine")).withColumn("piece", F.lit(7)).withColumn("sequence_id", F.lit("x"))
    placed = packing.pack_documents(wider).cache()
    rows = placed.collect()
    check_packed(rows, corpus, ids, 1024)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= -(-total // 1024) + 2
    put = {r["sequence_id"]: r for r in packing.sequences(placed).collect()}
    for r in rows:
        assert put[r["sequence_id"]]["ids"][4 * r["offset"]:4 * (r["offset"] + r["length"])] == r["ids"]


def test_groups_are_packed_apart_and_repeatably(docs, corpus, ids):
    cut = packing.pieces(docs, tokens.default_path(), 64)
    one = packing.packed(cut, 4, 64)
    check_packed(one.collect(), corpus, ids, 64)
    again = packing.packed(cut.repartition(7), 4, 64)
    assert sorted(map(str, one.collect())) == sorted(map(str, again.collect()))


def test_repeated_rows_are_packed_each(spark, ids):
    rows = packing.pack_documents(spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows) == [("1", len(ids("a b")))] * 2 + [("None", len(ids("c")))]


def test_null_and_equal_ids_and_equal_rows_make_no_large_group(spark, ids, monkeypatch):
    texts = [(None if k % 3 == 0 else 7, f"text {k % 900} of many " * 3) for k in range(1800)] + [(5, "always the same")] * 1000
    rows = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    cut = packing.pieces(rows, tokens.default_path(), 64)
    placed = packing.packed(cut, 4, 64, group_bytes=1 << 14).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in placed) == sorted((str(i), np.array(ids(t), "<u4").tobytes()) for i, t in texts)
    by_sequence = {}
    for r in placed:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in by_sequence.values():
        members.sort()
        assert [o for o, _ in members] == [sum(n for _, n in members[:k]) for k in range(len(members))] and sum(n for _, n in members) <= 64
    tasks = {}
    for r in placed:
        tasks[r["sequence_id"] >> 40] = tasks.get(r["sequence_id"] >> 40, 0) + 1
    assert len(tasks) == 4 and max(tasks.values()) < 1000 + 900


def test_nothing_packs_to_nothing(none):
    assert packing.pack_documents(none).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(2)
    for text in ([], [5], [7] * 5000, rng.integers(0, 30, 20000).tolist(), ([1, 2, 3, 4] * 3000)):
        ids = np.array(text, dtype=np.uint32)
        cuts = np.unique(np.concatenate([[0], np.sort(rng.integers(0, len(ids) + 1, 5)), [len(ids)]]))
        sizes = np.concatenate([np.diff(cuts), [0]])
        row = tokenfiles.compress(ids, sizes)
        u4 = {k: np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("symbols", "rules", "rule_sizes", "doc_symbols")}
        rules = u4["rules"].reshape(-1, 2)
        assert (tokenfiles.expand(u4["symbols"], row["base"], rules, u4["rule_sizes"]) == ids).all()
        held, at = u4["doc_symbols"], 0
        for k, size in enumerate(sizes):  # every document on its own
            own = tokenfiles.expand(u4["symbols"][at:at + held[k]], row["base"], rules, u4["rule_sizes"])
            assert (own == ids[sizes[:k].sum():sizes[:k].sum() + size]).all()
            at += held[k]
        if len(ids) >= 5000:
            assert len(u4["symbols"]) < len(ids) // 2 or len(set(text)) > 20


def test_no_pair_is_left_that_occurs_often(monkeypatch):
    monkeypatch.setattr(tokenfiles, "BUCKETS", 4)  # nearly every pair hides behind another
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 12, 3000), np.tile(np.arange(20, 60), 16)]).astype(np.uint32)
    row = tokenfiles.compress(ids, np.array([len(ids)]))
    symbols = np.frombuffer(row["symbols"], "<u4").tolist()
    used = {}
    at = 0
    for pair in set(zip(symbols, symbols[1:], strict=False)):
        n = at = 0
        while at < len(symbols) - 1:
            hit = (symbols[at], symbols[at + 1]) == pair
            n, at = n + hit, at + 1 + hit
        used[pair] = n
    assert max(used.values()) < tokenfiles.LEAST
    rules = np.frombuffer(row["rules"], "<u4").astype(np.int64).reshape(-1, 2)
    sizes = np.frombuffer(row["rule_sizes"], "<u4").astype(np.int64)
    assert (tokenfiles.expand(np.array(symbols), row["base"], rules, sizes) == ids).all()


def test_files_hold_all_ids_in_order(spark, docs, corpus, ids, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SHARD_BYTES", 4000)
    target = work_path(spark, "tokens")
    tokenfiles.write_tokens(docs.withColumn("start", F.lit(1)), target)
    assert spark.read.parquet(target).count() > 3
    rows = {r["doc_id"]: r for r in tokenfiles.read_tokens(spark, target).collect()}
    at = 0
    for doc_id, text in sorted(corpus):
        want = ids(text)
        assert (rows[doc_id]["start"], rows[doc_id]["n_tokens"]) == (at, len(want))
        assert np.frombuffer(rows[doc_id]["ids"], "<u4").tolist() == want
        at += len(want)
    some = {r["doc_id"]: r for r in tokenfiles.fetch(spark, target, [3, 114, 99999]).collect()}
    assert some == {k: rows[k] for k in (3, 114)}


def test_shards_part_rows_of_one_id(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SHARD_BYTES", 4000)
    target = work_path(spark, "tokens")
    tokenfiles.write_tokens(spark.createDataFrame([(None, f"text {k}") for k in range(3000)], "doc_id long, text string"), target)
    sizes = [r["n"] for r in spark.read.parquet(target).groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()]
    assert len(sizes) > 3 and max(sizes) < sum(sizes) / 3
    starts = sorted((r["start"], r["n_tokens"]) for r in tokenfiles.read_tokens(spark, target).collect())
    assert len(starts) == 3000 and all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))


def test_files_with_null_ids_repeated_rows_and_nothing(spark, none, ids):
    target = work_path(spark, "tokens")
    tokenfiles.write_tokens(spark.createDataFrame([(None, "a"), (4, "b"), (4, "b"), (2, None)], "doc_id long, text string"), target)
    rows = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in tokenfiles.read_tokens(spark, target).collect()))
    assert [r[1:] for r in rows] == [(None, len(ids("a"))), (2, 1), (4, len(ids("b"))), (4, len(ids("b")))]
    empty = work_path(spark, "tokens")
    tokenfiles.write_tokens(none, empty)
    assert tokenfiles.read_tokens(spark, empty).count() == 0


def test_blocks_get_their_places_without_a_shuffle_of_their_own(spark, monkeypatch):
    target = work_path(spark, "placed")
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(50)], "doc_id long, text string")
    tokenfiles.write_tokens(docs, target)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        blocks = tokenfiles._blocks(spark, target)
        plan = blocks._jdf.queryExecution().sparkPlan().toString()
        sent = tokenfiles.read_tokens(spark, target).orderBy("doc_id").collect()
        monkeypatch.setattr(tokenfiles, "SENT_BLOCKS", 0)
        joined = tokenfiles.read_tokens(spark, target).orderBy("doc_id").collect()
    finally:
        spark.conf.set(threshold, before)
    assert "BroadcastHashJoin [shard" in plan and len(sent) == 50 and sent == joined
