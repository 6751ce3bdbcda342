"""SimHash groups, repeated strings and Order MinHash against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from starlens.llm import components, orderhash, simhash, suffixes

SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("block", [simhash.BLOCK, 5])
def test_groups_match_all_pairs(docs, corpus, block, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, simhash.GROUPS, block))
    monkeypatch.setattr(simhash, "SCANNED", 256 if block > 5 else 3)
    rows = simhash.grouped(docs.withColumn("fp", F.lit("mine"))).collect()
    assert sorted((r["doc_id"], r["fp"] % 2 ** 64, r["component_id"]) for r in rows) == sorted(brute.groups(corpus))


def test_one_row_of_each_group_stays(spark, docs, corpus):
    rows = simhash.deduplicated(docs.withColumn("key_id", F.lit("mine"))).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted({c for _, _, c in brute.groups(corpus, n=5, radius=7)})
    assert {r["key_id"] for r in rows} == {"mine"}
    twice = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "d e f"), (2, None), (3, "")], SCHEMA)
    assert sorted(str(r["doc_id"]) for r in simhash.deduplicated(twice).collect()) == ["1", "2", "None"]


@pytest.mark.parametrize("radius,groups", [(simhash.RADIUS, simhash.GROUPS), (7, 10), (0, 2)])
def test_the_embedding_is_a_lower_bound(radius, groups):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2 ** 64, 2000, dtype=np.uint64)
    flips = [sum(1 << int(b) for b in rng.choice(64, int(n), replace=False)) for n in rng.integers(0, 10, 2000)]
    b = a ^ np.array(flips, dtype=np.uint64)
    counts = lambda x: np.stack([np.bitwise_count((x >> np.uint64(2 * i)) & np.uint64(3)).astype(int) for i in range(32)])
    manhattan = np.abs(counts(a) - counts(b)).sum(axis=0)
    assert (np.bitwise_count(simhash.embedded(a) ^ simhash.embedded(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()
    # within the radius, some grid puts the two into one cell
    masks = [np.uint64(m % 2 ** 64) for m in simhash.masks(radius, groups)]
    near = np.bitwise_count(a ^ b) <= radius
    shared = np.array([(simhash.embedded(a) & m) == (simhash.embedded(b) & m) for m in masks]).any(axis=0)
    assert shared[near].all()


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [(7, 7), (-5, 200), (200, -9)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{100 + k: 100 for k in range(1, 40)}, -5: -9, 200: -9}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [suffixes.CONTEXTS, 2])
def test_removed_bytes_match_counting_every_string(docs, corpus, most, monkeypatch):
    monkeypatch.setattr(suffixes.spans, "__defaults__", ("doc_id", "text", most))
    rows = suffixes.removed(docs.withColumn("spans", F.lit("mine"))).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept"]) for r in rows)
    assert got == sorted((*x[:4], bytearray(x[4])) for x in brute.removed(corpus))


def test_triggers_own_every_string_once(corpus, monkeypatch):
    raw = "".join(t or "" for _, t in corpus).encode()
    place, first, last, _ = suffixes.triggers(raw)
    assert first[0] == 0 and last[-1] == len(raw) - suffixes.LENGTH and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place - first < suffixes.PLACES)).all()
    monkeypatch.setattr(suffixes, "CHUNK", 777)
    assert all((a == b).all() for a, b in zip(suffixes.triggers(raw), (place, first, last, _)))


def test_rows_repeated_with_their_id_lose_all(spark, none):
    text = "é" * 30 + "word " * 60
    rows = suffixes.removed(spark.createDataFrame([(1, text), (1, text), (None, "short"), (2, "z" * 199)], SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in rows) == [("1", 360), ("1", 360), ("2", 0), ("None", 0)]
    assert suffixes.removed(none).count() == 0


def test_cleaned_texts_keep_their_columns(spark, docs, corpus):
    rows = suffixes.cleaned(docs.withColumn("n_chars", F.lit(0).cast("long")).withColumn("key_id", F.lit("mine"))).collect()
    want = {i: kept for i, *_, kept in brute.removed(corpus)}
    for r in rows:
        assert r["key_id"] == "mine" and r["n_chars"] == (None if r["text"] is None else len(r["text"]))
        assert (r["text"] or "") == want[r["doc_id"]].decode("utf-8", "ignore")
    assert len(rows) == len(corpus)


def test_next_documents_and_edited_texts(docs, corpus, monkeypatch):
    monkeypatch.setattr(orderhash, "TASK_BYTES", 4000)
    rows = {r["doc_id"]: r for r in orderhash.against_next(docs.withColumn("part", F.lit(1))).collect()}
    order = sorted(corpus, reverse=True)
    assert len(rows) == len(order)

    def sign(text):
        return orderhash.signature(orderhash.kmers(orderhash.code_points(text)))

    for k, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        third = len(text) // 3
        edited = text[:len(text) - third] + after[:third]
        r = rows[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (orderhash.shown(sign(text)), orderhash.shown(sign(edited)))
        assert r["near_edited"] == orderhash.likeness(sign(text), sign(edited)) and r["near_next"] == orderhash.likeness(sign(text), sign(after))


def test_order_minhash_by_definition():
    """Elements are numbered k-mers; a sketch keeps the least LEAST of its own, in text order, or draws from all if it has fewer."""
    for text in ("abcabcabcabcxyzabcabc" * 9, "a short text of some forty characters ...", "abcabcabcabcabcab", "ab", "".join(chr(97 + k % 23) + str(k) for k in range(60))):
        check_signature(text)


def check_signature(text):
    hashes = orderhash.kmers(orderhash.code_points(text))
    seen, elements = {}, []
    for h in hashes.tolist():
        n = seen[h] = seen.get(h, -1) + 1
        e = h if n == 0 else int(orderhash.mixed(np.array([h], np.uint64) + np.array([n], np.uint64) * np.uint64(0xD1B54A32D192ED03))[0])
        elements.append(e)
    assert orderhash.numbered(hashes).tolist() == elements
    want = []
    for s in range(orderhash.SKETCHES):
        own = sorted((e, i) for i, e in enumerate(elements) if e % orderhash.SKETCHES == s)[:orderhash.LEAST]
        if len(own) < orderhash.LEAST:
            salt = np.uint64((s + 1) * 0xA24BAED4963EE407 % 2 ** 64)
            own = sorted((int(orderhash.mixed(np.array([e], np.uint64) + salt)[0]), i) for i, e in enumerate(elements))[:orderhash.LEAST]
        total = np.zeros(1, np.uint64)
        for j, (_, i) in enumerate(sorted(own, key=lambda x: x[1])):
            total = orderhash.mixed(total * np.uint64(31) + np.uint64(elements[i]) + np.uint64(j + 1))
        want.append(max(int(total[0]) >> 32, 1) if own else 0)
    assert orderhash.signature(hashes).tolist() == want


def test_short_texts_with_swapped_halves_are_unlike():
    """A sketch of a single k-mer carries no order; sketches that would hold one draw from all."""
    import random

    rng = random.Random(8)
    for size in (40, 70, 100, 150):
        alike, edited = [], []
        for _ in range(60):
            text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(size))
            half, at = size // 2, rng.randrange(size - 1)
            a, b, c = (orderhash.signature(orderhash.kmers(orderhash.code_points(t))) for t in (text, text[half:] + text[:half], text[:at] + "#" + text[at + 1:]))
            alike.append(orderhash.likeness(a, b))
            edited.append(orderhash.likeness(a, c))
        assert np.mean(alike) < 0.42 and np.mean(edited) > np.mean(alike), (size, np.mean(alike), np.mean(edited))


def test_likeness_follows_edits(spark, none):
    import random

    rng = random.Random(4)
    text = "".join(rng.choice("abcdefgh ") for _ in range(4000))
    swapped = text[2000:] + text[:2000]
    few = text[:1000] + "###" + text[1003:]

    def sign(t):
        return orderhash.signature(orderhash.kmers(orderhash.code_points(t)))

    near, order, other = (orderhash.likeness(sign(text), sign(t)) for t in (few, swapped, text[::-1]))
    assert near > 0.9 > order > other == 0.0  # the same k-mers in another order are less alike
    assert orderhash.against_next(none).count() == 0
    alone = orderhash.against_next(spark.createDataFrame([(5, text)], SCHEMA)).collect()
    assert [(r["doc_id"], r["near_edited"] > 0, r["near_next"]) for r in alone] == [(5, True, 1.0)]
    prints = {r["fingerprint"] for r in orderhash.fingerprints(spark.createDataFrame([(1, None), (2, "")], SCHEMA)).collect()}
    assert prints == {"0" * 8 * orderhash.SKETCHES}
