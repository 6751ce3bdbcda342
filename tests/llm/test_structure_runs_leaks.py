"""Conversation repair, repeated runs and benchmark leaks against plain versions."""

import hashlib
import heapq
import random
import re
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from starlens.llm import conversations, decontaminate, queries, repeats

NO_HASH = hashlib.sha256(b"").hexdigest()


# conversations ------------------------------------------------------------------------------------

def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        row = (turn, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
        kept += [] if h == 0 else [row] * (2 if h == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def legal(initials):
    return re.fullmatch("(s?(ua)+)?", initials) is not None


def repair(rows):
    """(cost, audit, repaired lines): every edit sequence in order of cost and audit, until one gives legal roles."""
    kinds = faults(rows)
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, k, last, lines = heapq.heappop(queue)
        if k == len(rows) and last in ("", "a"):
            return cost, audit, lines
        if (k, last) in done:
            continue
        done.add((k, last))

        def step(price, letter, at, role, line, cost=cost, audit=audit, last=last, lines=lines):
            initial = role[:1]
            if line is None or (last, initial) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                heapq.heappush(queue, (cost + price, audit + letter, at, last if line is None else initial, lines if line is None else (*lines, line)))

        for role in ("user", "assistant"):
            step(2, "I", k, role, f"{role}:")
        if k < len(rows):
            _, role, text = rows[k]
            step(3, "D", k + 1, role, None)
            if kinds[k] not in ("blank", "duplicate"):
                more = kinds[k] == "truncated"
                step(more, "K", k + 1, role, f"{role}:{text}")
                for other in ("user", "assistant"):
                    step(2 + more, "R", k + 1, other, f"{other}:{text}")
    raise AssertionError


def report(rows):
    """The rows of the registered query, for rows without two of one turn."""
    out = {}
    for conv, kept in damage(rows).items():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = {t for t, *_ in kept if t is not None}
        kinds, initials = faults(kept), [r[:1] for _, r, _ in kept]
        cost, audit, lines = repair(kept)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(kinds.count(x) for x in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def talks(seed=11, n=70):
    rng, rows = random.Random(seed), []
    for conv in [*range(n), None]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 8, 13])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "Why?", "and then", "", " \n", None, f"Word {turn}.", f"é {turn} ?\t", "x" * 3000 + "."])
            rows.append((conv, turn * rng.choice([1, 1, 1, 3]), role, text))
        if conv is not None and conv % 7 == 0:
            rows.append((conv, None, "system", "Start."))
    return rows


TALKS = "conv_id long, turn long, role string, text string"


def found(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def unique_turns():
    rows, seen = [], set()
    for r in talks():
        if r[:2] not in seen:
            seen.add(r[:2])
            rows.append(r)
    return rows


@pytest.mark.parametrize("long,piece", [(20_000, 2048), (3, 1), (2, 4), (0, 3)])
def test_reports_equal_those_of_all_edit_sequences(spark, unique_turns, long, piece):
    """Whole, and cut into pieces that lie in several parts."""
    rows = queries.damaged(spark.createDataFrame(unique_turns, TALKS).repartition(5))
    got = found(conversations.repair(rows, dropped="dropped", long=long, piece=piece))
    assert got == report(unique_turns)


def test_repaired_rows_give_the_reported_hash(spark, unique_turns):
    rows = queries.damaged(spark.createDataFrame(unique_turns, TALKS))
    want = {c: r[-1] for c, r in report(unique_turns).items()}
    for long in (20_000, 2):
        lines = {}
        for r in sorted(conversations.repair(rows, dropped="dropped", turns=True, long=long, piece=2).collect(), key=lambda r: (r["part"], r["place"])):
            lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
        assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in want} == want


def test_a_conversation_of_many_equal_rows(spark):
    """Equal rows go over several pieces; all but the first are duplicates."""
    rows = spark.range(3000).selectExpr("cast(1 AS string) AS conv_id", "cast(NULL AS long) AS turn", "'user' AS role", "'Hi.' AS text", "5 AS part", "6 AS _tie")
    for long in (20_000, 100):
        got = found(conversations.repair(rows, long=long, piece=64))
        assert got == {"1": (0, 0, 2999, 0, 2999, 2999 * 3 + 2, "K" + "D" * 2999 + "I", hashlib.sha256(b"user:Hi.\nassistant:").hexdigest())}


def test_no_conversations_and_only_dropped_rows(spark):
    none = spark.createDataFrame([], TALKS)
    assert found(conversations.repair(none)) == {}
    gone = spark.createDataFrame([(1, 1, "user", "A.", True), (1, 2, "assistant", "B.", True)], TALKS + ", away boolean")
    for long in (20_000, 1):
        assert found(conversations.repair(gone, dropped="away", long=long)) == {1: (0, 0, 0, 0, 0, 0, "", NO_HASH)}


# runs ---------------------------------------------------------------------------------------------

def periodic(words):
    """(start, length, least period) of all runs, by comparing all words at all distances."""
    best = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(12, 2 * p) and j > i:
                best.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in best.items())


def repeated(doc_id, text):
    words = (text or "").encode().split()
    h = crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = periodic(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_runs_of_all_distances(spark, tmp_path):
    rng = random.Random(12)
    docs = [(None, "a b " * 20), (0, None), (1, ""), (2, " \n"), (3, "one"), (4, "x " * 5000), (5, "x " * 11), (6, "x " * 12), (7, "a b " * 3000 + "c"),
            (8, "word " * 6 + "other " * 6), (9, " a b " * 12)]
    for i in range(10, 160):
        words = [rng.choice("abcdefgh"[:rng.choice([1, 2, 3, 8])]) for _ in range(rng.randint(0, 250))]
        for _ in range(rng.randint(0, 3)):
            a, p = rng.randrange(len(words) + 1), rng.randint(1, 30)
            for k in range(a + p, min(len(words), a + rng.randint(2, 150))):
                words[k] = words[k - p]
        docs.append((i, " ".join(words)))
    docs += docs[20:25]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in queries.op12_repeated_runs(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, *repeated(i, t)) for i, t in docs), key=str)
    assert sum(r[1] for r in got) > 100


def test_runs_of_real_texts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars < 6000").select("doc_id", "text").collect()
    got = {r[0]: tuple(r)[1:] for r in queries.op12_repeated_runs(spark, sf_dir).collect()}
    assert {i: got[i] for i, _ in docs} == {i: repeated(i, t) for i, t in docs}


def test_long_repeats_inside_repeats(spark):
    """Nonterminals of many levels, in several places."""
    rng = random.Random(2)
    block = [str(rng.randrange(4)) for _ in range(40)]
    words = (block * 30 + ["end"]) * 3 + ["a", "b"] * 400 + block * 4
    got = repeats.runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in got["runs"]] == periodic(words)


def test_no_documents_have_no_runs(spark, none):
    assert repeats.runs(none).count() == 0


# benchmark leaks ----------------------------------------------------------------------------------

def leaks(docs, items, window=10):
    def words(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)

    where = {}
    for item, text in items:
        w = words(text)
        for k in range(max(len(w) - window + 1, 1) if w else 0):
            where.setdefault(tuple(w[k:k + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(x) for x in where}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in where:
                    hit |= set(range(k, k + n))
                    names |= where[tuple(w[k:k + n])]
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def leaky():
    rng = random.Random(13)

    def prose(n):
        return " ".join(rng.choice(["der", "Haus", "été", "9", "q", "zwei"]) + str(rng.randrange(40)) for _ in range(n))

    items = [(k, prose(rng.choice([3, 9, 10, 11, 25, 60]))) for k in range(30)]
    items += [(30, None), (31, " .,!"), (32, items[0][1]), (33, items[5][1] + " " + items[6][1]), (34, items[5][1].upper())]
    docs = [(None, items[3][1]), (1, None), (2, ""), (3, "... !"), (4, items[4][1].replace(" ", " -- ").upper())]
    for k in range(5, 70):
        text = prose(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            text += ", " + items[rng.randrange(30)][1] + " " + prose(rng.randint(0, 5))
        docs.append((k, text))
    return docs + docs[10:14] + [docs[0]], items


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST, 0])
def test_leaks_by_all_windows(spark, leaky, limit):
    """Through the broadcast set, and through the shuffled join."""
    docs, items = leaky
    table = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, w int, hash int").repartition(4)
    bench = spark.createDataFrame([(*d, 1) for d in items], "item_id long, text string, length int")
    got = decontaminate.judged(table, bench, broadcast=limit).select(
        "doc_id", "n_words", "n_hit", F.size("items"), F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0)
    assert sorted(map(tuple, got.collect()), key=str) == leaks(docs, items)


def test_cleaned_texts_have_no_leak_left_of_their_own(spark, leaky):
    docs, items = leaky
    table = spark.createDataFrame([(*d, k) for k, d in enumerate(docs)], "doc_id long, text string, hits int").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    spans = {r["hits"]: r["text"] for r in decontaminate.cleaned(table, bench).collect()}
    assert len(spans) == len(docs)
    for k, (doc, text) in enumerate(docs):
        n = leaks([(doc, text)], items)[0]
        if not n[2]:
            assert spans[k] == text
        else:
            assert leaks([(doc, spans[k])], [])[0][1] == n[1] - n[2]
    plain = spark.createDataFrame([(1, "one, two; three (four) FIVE. six")], "doc_id long, text string")
    two = spark.createDataFrame([(1, "Two three"), (2, "five six")], "item_id long, text string")
    assert decontaminate.cleaned(plain, two).first()["text"] == "one, four) "
    left = decontaminate.cleaned(table, bench, documents=True, share=0.5)
    assert {r["hits"] for r in left.collect()} == {k for k, d in enumerate(docs) if 2 * leaks([d], items)[0][2] <= leaks([d], items)[0][1]}


def test_no_documents_no_benchmark(spark, none, leaky):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.judged(none, bench).count() == 0
    table = spark.createDataFrame(leaky[0], "doc_id long, text string")
    assert decontaminate.judged(table, bench).agg(F.sum("n_hit"), F.count("*")).first() == (0, len(leaky[0]))
    assert decontaminate.cleaned(table, bench).exceptAll(table).isEmpty()
