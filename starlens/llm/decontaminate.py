"""Benchmark decontamination: documents that hold word windows of benchmark items.

An item's windows are its runs of WINDOW consecutive words; a shorter item is one window. Their
hashes are a broadcast hash set, which every window of the documents meets in the same pass that
made it. What meets it is verified word by word, so only true hits leave the pass, beside one row
per document. The set is counted first: with more than BROADCAST windows, or more than
BROADCAST_BYTES of them, it is joined by a shuffle instead, salted, since a frequent window may be
in a third of all documents.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import row_key, written

WINDOW = 10
#: A word of a text in lower case: ASCII digits and letters, and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Limits of the broadcast set.
BROADCAST = 500_000
BROADCAST_BYTES = 64_000_000
SALTS = 16


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def benchmark_windows(items: DataFrame, window: int = WINDOW, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(hash, length, window, items): each different window with the sorted ids of its items. A null id is left out of the list."""
    found = items.select(F.col(id_column).cast("string").alias("item"), words(F.col(text_column)).alias("w"))
    n = F.size("w")
    places = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1))))
    one = found.select("item", F.explode(F.transform(places, lambda i: F.slice("w", i, window))).alias("window"))
    return one.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items")) \
        .select(F.xxhash64("window").alias("hash"), F.size("window").alias("length"), "window", "items")


def covered(hits: Column) -> Column:
    """Words under the hits (start, length), which are ascending."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(state: Column, hit: Column) -> Column:
        end = hit["start"] + hit["length"]
        fresh = F.greatest(end - F.greatest(hit["start"], state["end"]), F.lit(0))
        return F.struct((state["n"] + fresh).alias("n"), F.greatest(end, state["end"]).alias("end"))

    return F.aggregate(hits, start, add, lambda s: s["n"])


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
         item_id: str = "item_id", item_text: str = "text", broadcast: int = BROADCAST, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, key_id, key_text, rows, n_words, n_hit, hits, items) per different row of ids and texts.

    ``rows`` is how often the row is there, ``hits`` the ascending (start, length) of its windows in
    words from 0, ``n_hit`` the words under them, ``items`` the sorted ids of the items they are from.
    A null text has no words. Other columns are ignored; an empty benchmark hits nothing.
    """
    wanted = written(benchmark_windows(items, window, item_id, item_text), "benchmark_windows")
    size = wanted.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.concat_ws(" ", "window")) + F.octet_length(F.concat_ws(" ", "items")) + 100).alias("bytes"),
                      F.array_sort(F.collect_set("length")).alias("lengths")).first()
    lengths = size["lengths"] or [window]  # as many as WINDOW at most
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).alias("doc_id"), *row_key(F.col(id_column), text), words(text).alias("w"))
    # a row for the document, then one for each place and length of a window
    places = F.sequence(F.lit(0), F.size("w"))
    rows = rows.withColumn("n_words", F.size("w")).select("*", F.explode(places).alias("place"))
    if len(lengths) == 1:
        rows = rows.withColumn("length", F.lit(lengths[0]))
    else:
        every = F.array(*(F.lit(n) for n in lengths))
        rows = rows.select("*", F.explode(F.when(F.col("place") == 0, F.slice(every, 1, 1)).otherwise(every)).alias("length"))
    inside = (F.col("place") > 0) & (F.col("place") + F.col("length") <= F.col("n_words") + 1)
    rows = rows.where((F.col("place") == 0) | inside)
    piece = F.slice("w", F.col("place"), F.col("length"))
    digest = F.when(F.col("place") > 0, F.xxhash64(piece)).otherwise(F.col("key_text"))  # keys of the documents' rows spread them
    rows = rows.withColumn("digest", digest)
    right = wanted.select("hash", F.col("length").alias("_length"), F.col("window").alias("_window"), F.col("items").alias("_items"))
    same = (F.col("digest") == F.col("hash")) & (F.col("place") > 0) & (F.col("length") == F.col("_length"))
    verified = F.slice("w", F.greatest(F.col("place"), F.lit(1)), F.col("length")) == F.col("_window")
    if size["n"] <= broadcast and (size["bytes"] or 0) <= broadcast_bytes:
        met = rows.join(F.broadcast(right), same & verified, "left")
    else:
        salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = rows.withColumn("_salt", F.pmod("key_text", F.lit(SALTS)).cast("int")) \
            .join(salted.hint("shuffle_hash"), same & verified & (F.col("_salt") == F.col("salt")), "left")
    hit = F.when(F.col("place") > 0, F.struct((F.col("place") - 1).alias("start"), "length"))
    left = met.where((F.col("place") == 0) | F.col("hash").isNotNull()).select("doc_id", "key_id", "key_text", "n_words", "place", hit.alias("hit"), "_items")
    found = left.groupBy("doc_id", "key_id", "key_text").agg(
        F.count_if(F.col("place") == 0).alias("rows"), F.max("n_words").cast("long").alias("n_words"),
        F.sort_array(F.collect_set("hit")).alias("hits"), F.collect_set("_items").alias("_lists"))
    return found.select("doc_id", "key_id", "key_text", "rows", "n_words", covered(F.col("hits")).cast("long").alias("n_hit"), "hits",
                        F.array_sort(F.array_distinct(F.flatten("_lists"))).alias("items"))


def judged(docs: DataFrame, items: DataFrame, window: int = WINDOW, **names) -> DataFrame:
    """(doc_id, n_words, n_hit, hits, items) for every row of ``docs``, repeated rows as often as they are there."""
    found = hits(docs, items, window, **names)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))
    return found.select("doc_id", "n_words", "n_hit", "hits", "items", copies.alias("_copy")).drop("_copy")


def cleaned(docs: DataFrame, items: DataFrame, window: int = WINDOW, documents: bool = False, share: float = 0.0, id_column: str = "doc_id",
            text_column: str = "text", **names) -> DataFrame:
    """``docs`` without what they share with the benchmark; all columns stay.

    With ``documents`` the documents go of whose words more than ``share`` are hit. Otherwise hit words
    go from the texts, each with what follows it up to the next word. Null texts stay null.
    """
    found = hits(docs, items, window, id_column=id_column, text_column=text_column, **names).where("n_hit > 0") \
        .select(F.struct("key_id", "key_text").alias("_decontaminate_key"), F.struct("n_words", "n_hit", "hits").alias("_decontaminate_hits"))
    keyed = docs.withColumn("_decontaminate_key", F.struct(*row_key(F.col(id_column), F.col(text_column).cast("string"))))
    both = keyed.join(found, "_decontaminate_key", "left")
    hit = F.col("_decontaminate_hits")
    if documents:
        both = both.where(hit.isNull() | (hit["n_hit"] <= share * hit["n_words"]))
    else:
        text = F.col(text_column)
        taken = F.regexp_extract_all(text, F.lit(WORD_ANY_CASE), F.lit(0))
        between = F.split(text, WORD_ANY_CASE, -1)
        gone = F.array_distinct(F.flatten(F.transform(hit["hits"], lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
        kept = F.array_except(F.sequence(F.lit(0), hit["n_words"].cast("int") - 1), gone)
        rest = F.transform(kept, lambda k: F.concat(F.get(taken, k), F.get(between, k + 1)))
        both = both.withColumn(text_column, F.when(hit.isNull(), text).otherwise(F.concat(F.get(between, F.lit(0)), F.array_join(rest, ""))))
    return both.select(*docs.columns)


def hits_sql(window: int = WINDOW) -> str:
    """The registered query's rows in DuckDB SQL."""
    split = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}')"
    return f"""
WITH items AS (SELECT cast(item_id AS VARCHAR) AS item, {split} AS w FROM benchmark),
wanted AS (SELECT DISTINCT item, least(len(w), {window}) AS n, w[p:p + {window - 1}] AS win
           FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {window - 1}, 1) + 1)) AS p FROM items WHERE len(w) > 0)),
docs AS (SELECT row_number() OVER () AS k, doc_id, {split} AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM wanted),
places AS (SELECT k, n, p, w[p:p + n - 1] AS win FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM docs, sizes)),
met AS (SELECT DISTINCT k, n, p, item FROM places JOIN wanted USING (n, win)),
hit AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM met) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT k, item FROM met) GROUP BY k)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (k) LEFT JOIN named USING (k)"""
