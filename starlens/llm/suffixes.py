"""Removal of byte strings that occur twice in a corpus, by prefix-free parsing and suffix order.

Parsing: a rolling hash over GRAM bytes picks triggers, and the text between two of them is a
phrase. So that every string of LENGTH bytes has a trigger, the trigger of a string is its place
of least hash (the first of equal ones), a function of the string alone. A trigger owns the strings
it is picked by, which start at neighbouring places, and its context is the bytes they cover: the
end of the phrase before it (the dictionary side) and the text from it on (the parse side).

Equal strings have triggers with the same gram, so only triggers whose gram occurs twice go on.
Contexts that are equal as a whole are counted; what they own occurs twice. The other contexts of a
gram meet in one task, where the suffix array of the phrase ends and that of the parse, both with
common lengths, combine into the order of the corpus: strings are equal where both sides agree long
enough. Grams with very many different contexts are settled by hashes of ever shorter ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starlens.llm.common import map_arrow, mixed, row_key, written

LENGTH = 200
#: Bytes of the rolling hash, a power of two; and the places where a string's trigger can be.
GRAM = 64
PLACES = LENGTH - GRAM + 1
#: Starts of strings looked at together; their places fit PLACE_BITS with room for the last string.
CHUNK, PLACE_BITS = 1 << 19, 20
#: Different contexts that a task orders together, some 300 bytes each, and of one gram at most; of more
#: than these, ranges of so many strings are hashed.
TOGETHER, CONTEXTS, STEPS = 4096, 1 << 16, (16, 4, 1)


def rolling(raw: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes at each place."""
    h, size, base = raw.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(base) + h[size:]
        size, base = 2 * size, base * base % (1 << 64)
    return mixed(h)


def triggers(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Triggers in order: place, first and last start of the strings owned, and the gram's hash."""
    data = np.frombuffer(raw, dtype=np.uint8)
    strings = len(data) - LENGTH + 1
    found: list[list[np.ndarray]] = [[], [], [], []]
    low = np.uint64((1 << PLACE_BITS) - 1)
    for begin in range(0, max(0, strings), CHUNK):
        h = rolling(data[begin:min(begin + CHUNK, strings) + LENGTH - 1])
        least, size = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * size <= PLACES:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < PLACES:
            least = np.minimum(least[:size - PLACES], least[PLACES - size:])
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
        last = np.append(first[1:], len(place)) - 1
        place = place[first]
        for held, x in zip(found, (place + begin, first + begin, last + begin, h[place]), strict=True):
            held.append(x)
    if not found[0]:
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty.astype(np.uint64)
    place, first, last, gram = (np.concatenate(x) for x in found)
    new = np.append(True, place[1:] != place[:-1])  # a chunk's edge may part a trigger's strings
    return place[new], first[new], last[np.append(np.flatnonzero(new)[1:], len(new)) - 1], gram[new]


def _raw(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string")
    return docs.select(*row_key(F.col(id_column), text), text.alias("text"))


KEYS = ["key_id", "key_text"]


def grams(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row its different grams and how often each is a trigger."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(triggers(_raw(x.as_py()))[3].view(np.int64), return_counts=True) for x in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([g for g, _ in found], pa.list_(pa.int64())),
                                   pa.array([n for _, n in found], pa.list_(pa.int64()))], names=[*KEYS, "grams", "times"])

    return map_arrow(_rows(docs, id_column, text_column), run, "key_id long, key_text long, grams array<long>, times array<long>")


def contexts(rows: DataFrame) -> DataFrame:
    """Rows (keys, text, grams: those that occur twice) as their different contexts.

    ``context`` covers all strings that a trigger owns, ``before`` of its bytes are in front of the
    trigger; ``starts`` lists the places of the text where it begins. ``class`` identifies both.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key_id, key_text, text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = _raw(text)
                place, first, last, gram = triggers(raw)
                gram = gram.view(np.int64)
                held: dict[bytes, tuple] = {}
                for i in np.flatnonzero(np.isin(gram, np.array(wanted, dtype=np.int64))).tolist():
                    start, before = int(first[i]), int(place[i] - first[i])
                    context = raw[start:int(last[i]) + LENGTH]
                    name = xxhash.xxh3_128_digest(context, seed=before)
                    if name in held:
                        held[name][3].append(start)
                    else:
                        held[name] = (key_id, key_text, name, [start], int(gram[i]), before, context)
                out += held.values()
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.int64(), pa.int32(), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[*KEYS, "class", "starts", "gram", "before", "context"])

    return map_arrow(rows, run, "key_id long, key_text long, class binary, starts array<int>, gram long, before int, context binary")


def common(strings: list[bytes], order: list[int], group: np.ndarray) -> np.ndarray:
    """For each place of ``order`` the common length with the one before it; -1 at a group's first."""
    sizes = np.array([len(strings[i]) for i in order])
    table = np.zeros((len(order), max(1, int(sizes.max()))), dtype=np.uint8)
    for row, i in zip(table, order, strict=True):
        row[:len(strings[i])] = np.frombuffer(strings[i], dtype=np.uint8)
    differ = table[1:] != table[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
    same = np.minimum(same, np.minimum(sizes[1:], sizes[:-1]))
    number = group[order]
    return np.concatenate([[-1], np.where(number[1:] == number[:-1], same, -1)])


def twice(group: np.ndarray, before: np.ndarray, context: list[bytes]) -> np.ndarray:
    """For each context and d below PLACES, whether the string that starts d bytes in front of the
    trigger occurs in another context of its group.

    The phrase ends, read backwards, and the texts from the trigger on are put into suffix order
    once, with common lengths between neighbours. For each d the first order falls into classes of
    equal last d bytes and the second into classes of equal first LENGTH - d bytes; strings are
    equal where both classes are.
    """
    many = len(context)
    ends = [c[:b][::-1] for c, b in zip(context, before.tolist(), strict=True)]
    texts = [c[b:] for c, b in zip(context, before.tolist(), strict=True)]
    numbers = group.tolist()
    by_end = sorted(range(many), key=lambda i: (numbers[i], ends[i]))
    by_text = sorted(range(many), key=lambda i: (numbers[i], texts[i]))
    end_common, text_common = common(ends, by_end, group), common(texts, by_text, group)
    owned = np.array([len(c) for c in context]) - LENGTH + 1
    out = np.zeros((many, PLACES), dtype=bool)
    end_class, text_class = np.zeros(many, dtype=np.int64), np.zeros(many, dtype=np.int64)
    for d in range(int(max(0, (before - owned + 1).min())), int(before.max()) + 1):
        live = np.flatnonzero((before >= d) & (before - d < owned))
        if len(live) < 2:
            continue
        end_class[by_end] = np.cumsum(end_common < d)
        text_class[by_text] = np.cumsum(text_common < LENGTH - d)
        _, which, times = np.unique(end_class[live] * (many + 1) + text_class[live], return_inverse=True, return_counts=True)
        out[live, d] = times[which] > 1
    return out


RANGES = "class binary, from array<int>, to array<int>"


def _ranges(found: list[tuple[bytes, np.ndarray]]) -> pa.RecordBatch:
    """Classes with the starts (ascending) of repeated strings in them, as ranges."""
    froms, tos = [], []
    for _, starts in found:
        edge = np.flatnonzero(np.diff(starts) > 1)
        froms.append(starts[np.append(0, edge + 1)])
        tos.append(starts[np.append(edge, len(starts) - 1)])
    kind = pa.list_(pa.int32())
    return pa.record_batch([pa.array([c for c, _ in found], pa.binary()), pa.array(froms, kind), pa.array(tos, kind)], names=["class", "from", "to"])


def ordered(classes: DataFrame) -> DataFrame:
    """Repeated strings of contexts that occur once, by suffix order within each gram's contexts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= TOGETHER:
                table = pa.Table.from_batches(held).combine_chunks()
                gram = table["gram"].to_numpy()
                cut = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
                if cut:
                    yield settle(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                rows = table.num_rows - cut
        if rows:
            yield settle(pa.Table.from_batches(held))

    def settle(table: pa.Table) -> pa.RecordBatch:
        before = table["before"].to_numpy().astype(np.int64)
        found = twice(table["gram"].to_numpy(), before, table["context"].to_pylist())
        open_ = found.any(axis=1) & (table["n"].to_numpy() == 1)
        names = table["class"]
        return _ranges([(names[int(i)].as_py(), np.sort(before[i] - np.flatnonzero(found[i]))) for i in np.flatnonzero(open_)])

    dealt = classes.select("gram", "class", "n", "before", "context").repartition("gram").sortWithinPartitions("gram", "class")
    return map_arrow(dealt, run, RANGES)


def hashed(classes: DataFrame) -> DataFrame:
    """The same for grams with more contexts than a task should hold: no group is ever put together.

    Strings are taken in ranges by their distance d from the trigger. If all bytes of a range occur
    twice, so do its strings; if the bytes that all of them share occur once, none does. Ranges in
    between are cut into shorter ones, one context standing for all that agree in the range.
    """
    def cut(step: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for name, n, before, context, near, far in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for part in range(near // step, far // step + 1):
                        a, b = max(near, step * part), min(far, step * part + step - 1)
                        whole = xxhash.xxh3_128_digest(context[before - b:before - a + LENGTH], seed=PLACES * a + b)
                        shared = xxhash.xxh3_128_digest(context[before - step * part:before - step * part - step + 1 + LENGTH], seed=part)
                        out.append((name, n, a, b, before - b, before - a, whole, shared))
                columns = list(zip(*out, strict=True)) or [()] * 8
                kinds = [pa.binary(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["class", "n", "near", "far", "from", "to", "whole", "shared"])

        return run

    schema = "class binary, n long, near int, far int, from int, to int, whole binary, shared binary"
    first = F.greatest(F.lit(0), F.col("before") - F.length("context") + LENGTH)
    parts = classes.select("class", "n", "before", "context", first.alias("near"), F.col("before").alias("far")).repartition("class")
    sure = None
    for step in STEPS:
        ranges = written(map_arrow(parts, cut(step), schema), "ranges")
        alike = ranges.groupBy("whole").agg(F.sum("n").alias("n"), F.first(F.struct("class", "near", "far", "shared")).alias("one"))
        found = ranges.where("n = 1").join(alike.where("n > 1").select("whole"), "whole", "left_semi").select("class", "from", "to")
        sure = found if sure is None else sure.unionByName(found)
        if step > 1:
            open_ = alike.groupBy(F.col("one.shared").alias("shared")).agg(F.sum("n").alias("all"), F.count_if(F.col("n") == 1).alias("once")).where("all > 1 and once > 0")
            left = alike.select("n", "one.*").join(open_, "shared", "left_semi").select("class", "n", "near", "far")
            parts = classes.select("class", "before", "context").join(left, "class").select("class", "n", "before", "context", "near", "far")
    return sure.groupBy("class").agg(F.collect_set(F.struct("from", "to")).alias("r")).select("class", F.col("r")["from"].alias("from"), F.col("r")["to"].alias("to"))


def spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = CONTEXTS) -> DataFrame:
    """Per row key the byte ranges to remove, not merged: (key_id, key_text, spans)."""
    sampled = written(grams(docs, id_column, text_column), "grams")
    repeated = sampled.select(F.explode(F.arrays_zip("grams", "times")).alias("x")).groupBy(F.col("x.grams").alias("gram")) \
        .agg(F.sum("x.times").alias("n")).where("n > 1").select("gram")
    wanted = sampled.select(*KEYS, F.explode("grams").alias("gram")).join(repeated, "gram", "left_semi") \
        .groupBy(*KEYS).agg(F.collect_set("gram").alias("grams"))
    rows = _rows(docs, id_column, text_column).join(wanted, KEYS).select(*KEYS, "text", "grams")
    found = written(contexts(rows), "contexts")
    classes = written(found.groupBy("class").agg(F.sum(F.size("starts")).alias("n"), F.first("gram").alias("gram"), F.first("before").alias("before"), F.first("context").alias("context")), "classes")
    per_gram = classes.groupBy("gram").agg(F.count("*").alias("many"), F.count_if(F.col("n") == 1).alias("once"))
    mixed_up = classes.join(per_gram.where("many > 1 and once > 0"), "gram")
    whole = classes.where("n > 1").select("class", F.array(F.lit(0)).alias("from"), F.array(F.length("context") - LENGTH).alias("to"))
    result = whole.unionByName(ordered(mixed_up.where(F.col("many") <= most)))
    if per_gram.where((F.col("many") > most) & (F.col("once") > 0)).limit(1).count():
        result = result.unionByName(hashed(mixed_up.where(F.col("many") > most)))
    ranges = F.flatten(F.transform("starts", lambda s: F.transform(F.arrays_zip("from", "to"), lambda r: F.struct((s + r["from"]).alias("start"), (s + r["to"] + LENGTH).alias("end")))))
    return found.select(*KEYS, "class", "starts").join(result, "class").select(*KEYS, ranges.alias("ranges")) \
        .groupBy(*KEYS).agg(F.flatten(F.collect_list("ranges")).alias("spans"))


def merged(ranges: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted((r["start"], r["end"]) for r in ranges or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _rest(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in gone for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def removed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row ``n_bytes``, ``n_removed``, the removed ``spans`` (of bytes, merged) and the ``kept`` bytes.

    Removed is every byte of a LENGTH-byte string that starts anywhere else too, in the same text
    or another; all judged on the input. A null text is empty; shorter texts keep all; a row
    repeated with its id loses all of LENGTH bytes and more. Other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, ranges in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw, gone = _raw(text), merged(ranges)
                out.append((doc_id, len(raw), sum(b - a for a, b in gone), [{"start": a, "end": b} for a, b in gone], _rest(raw, gone)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), *row_key(F.col(id_column), text), text.alias("text"))
    joined = rows.join(spans(docs, id_column, text_column), KEYS, "left").select("doc_id", "text", "spans")
    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")


def cleaned(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """All rows and columns, the texts without their repeated strings; ``n_chars`` counts anew where it is there.

    A character that a removed span cuts through goes as a whole. A null text stays null.
    """
    names = docs.columns
    place = names.index(text_column)
    plain = docs.withColumn(text_column, F.col(text_column).cast("string"))
    keys = row_key(F.col(id_column), F.col(text_column))
    joined = plain.select(*[F.col(c) for c in names], *[k.alias(f"_dedup_{n}") for k, n in zip(keys, KEYS, strict=True)]) \
        .join(spans(docs, id_column, text_column).select(F.col("key_id").alias("_dedup_key_id"), F.col("key_text").alias("_dedup_key_text"), F.col("spans").alias("_dedup_spans")), ["_dedup_key_id", "_dedup_key_text"], "left") \
        .select(*names, "_dedup_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not r else _rest(_raw(t), merged(r)).decode("utf-8", "ignore")
                     for t, r in zip(batch.column(place).to_pylist(), batch.column(len(names)).to_pylist(), strict=True)]
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, batch.schema.field(place).type)
            yield pa.record_batch(columns, names=names)

    out = map_arrow(joined, run, StructType(plain.schema.fields))
    return out.withColumn("n_chars", F.length(text_column).cast("long")) if "n_chars" in names else out


def removed_sql(length: int = LENGTH) -> str:
    """For DuckDB over ``documents``: every string of ``length`` bytes (as hex digits) is counted."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT r, p, md5(substr(h, 2 * p + 1, {2 * length})) AS m FROM (SELECT r, h, unnest(range(0, length(h) // 2 - {length - 1})) AS p FROM d WHERE length(h) >= {2 * length})),
    twice AS (SELECT m FROM w GROUP BY m HAVING count(*) > 1),
    s AS (SELECT r, p, CASE WHEN p - lag(p) OVER (PARTITION BY r ORDER BY p) <= {length} THEN 0 ELSE 1 END AS new FROM w SEMI JOIN twice USING (m)),
    k AS (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM s),
    spans AS (SELECT r, min(p) AS a, max(p) + {length} AS b FROM k GROUP BY r, k),
    parts AS (SELECT r, a, b, substr(h, 2 * before + 1, 2 * (a - before)) AS part, h FROM (SELECT *, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM spans) JOIN d USING (r)),
    e AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(part, '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM parts GROUP BY r)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256 FROM d LEFT JOIN e USING (r)"""
