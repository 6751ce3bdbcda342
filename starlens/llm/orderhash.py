"""Document fingerprints by Order MinHash: likeness that follows the edit distance.

K-mers (K code points) are numbered by occurrence, so repeats are different elements. Each of
SKETCHES sketches selects the LEAST elements of smallest hash, puts them back into text order and
hashes the tuple: two texts agree in a sketch if they share these k-mers in this order. The elements
are dealt over the sketches by one hash (one permutation); a sketch that gets fewer than LEAST of them
so draws from all elements, hashed anew for it, since a single k-mer carries no order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starlens.llm.common import map_arrow, mixed, written

K, SKETCHES, LEAST = 8, 64, 2
#: Bytes of text per task.
TASK_BYTES = 8 << 20


def kmers(points: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of the k code points at each place; of all of them if there are fewer."""
    if not len(points):
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(max(1, len(points) - k + 1), dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    for j in range(min(k, len(points))):
        out = out * base + points[j:j + len(out)]
    return mixed(out + np.uint64(1))


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Elements: a k-mer's hash, for its second and further places mixed with the number of the place."""
    # most k-mers are alone in a bucket of their leading bits; only the others are sorted
    bits = max(10, len(hashes).bit_length() + 3)
    bucket = (hashes >> np.uint64(64 - bits)).astype(np.int64)
    place = np.flatnonzero((np.bincount(bucket) > 1)[bucket])
    if not len(place):
        return hashes
    place = place[np.argsort(hashes[place], kind="stable")]
    value = hashes[place]
    begins = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
    occurrence = (np.arange(len(value)) - np.repeat(begins, np.diff(np.append(begins, len(value))))).astype(np.uint64)
    out = hashes.copy()
    out[place] = np.where(occurrence > 0, mixed(value + occurrence * np.uint64(0xD1B54A32D192ED03)), value)
    return out


def signature(hashes: np.ndarray, sketches: int = SKETCHES, least: int = LEAST) -> np.ndarray:
    """A 32-bit hash per sketch, 0 only for a text without elements."""
    total = np.zeros(sketches, dtype=np.uint64)
    if not len(hashes):
        return total.astype(np.uint32)
    element = numbered(hashes)
    # the smallest of a sketch are nearly always among the smallest of all; if not, all are looked at
    few = 6 * least * sketches
    place = np.flatnonzero(element < np.uint64(2 ** 64 // len(element) * few)) if len(element) > few else np.arange(len(element))
    sketch = element[place] % np.uint64(sketches)
    if len(place) < len(element) and np.bincount(sketch.astype(np.int64), minlength=sketches).min() < least:
        place = np.arange(len(element))
        sketch = element % np.uint64(sketches)
    by = np.lexsort((element[place], sketch))
    sketch = sketch[by].astype(np.int64)
    rank = np.arange(len(by)) - np.searchsorted(sketch, np.arange(sketches))[sketch]
    place, sketch = place[by][rank < least], sketch[rank < least]
    # back into text order within each sketch
    by = np.lexsort((place, sketch))
    place, sketch = place[by], sketch[by]
    at = np.arange(len(by)) - np.searchsorted(sketch, np.arange(sketches))[sketch]
    for j in range(least):
        here = at == j
        total[sketch[here]] = mixed(total[sketch[here]] * np.uint64(31) + element[place[here]] + np.uint64(j + 1))
    lacking = np.flatnonzero(np.bincount(sketch, minlength=sketches) < least)
    if len(lacking):  # in texts of some hundred characters; a long one misses no sketch
        again = mixed(element + (lacking.astype(np.uint64) + np.uint64(1))[:, None] * np.uint64(0xA24BAED4963EE407))
        drawn = np.sort(np.argsort(again, axis=1, kind="stable")[:, :least], axis=1)
        total[lacking] = 0
        for j in range(drawn.shape[1]):
            total[lacking] = mixed(total[lacking] * np.uint64(31) + element[drawn[:, j]] + np.uint64(j + 1))
    return np.where(total > 0, np.maximum(total >> np.uint64(32), np.uint64(1)), np.uint64(0)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of equal sketches among those that either text fills; 1 for two empty texts."""
    filled = (a != 0) | (b != 0)
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def shown(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every whole text; a null text is an empty one. Other columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shown(signature(kmers(code_points(x.as_py())))) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, fingerprint string")


COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def compared(doc_id: int | None, one: np.ndarray, own: np.ndarray, other: np.ndarray, next_own: np.ndarray) -> tuple:
    """A document, its edited text (the last third replaced from the next document's start), and the next document."""
    third = len(one) // 3
    edited = np.concatenate([one[:len(one) - third], other[:third]])
    changed = signature(kmers(edited))
    text = edited.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    return (doc_id, len(one), hashlib.sha256(text).hexdigest(), shown(own), shown(changed), likeness(own, changed), likeness(own, next_own))


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.record_batch([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def against_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text against its edited text and the next document in descending id order; after the last comes the first.

    Rows are range-partitioned by id and sorted, so the next document is the next row of the task.
    A task's first and last rows come back with their texts, two per task, and are matched by a
    join on the tasks' order. Rows of one id follow each other by the hash of the text; null ids
    come last; a null text is empty; a single row follows itself. Other columns are ignored.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    schema = COMPARED + ", part int, edge string, edge_id long, edge_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        none = (None,) * 7
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points = code_points(text)
                own = signature(kmers(points))
                if last is None:
                    out.append((*none, part, "first", doc_id, text))
                else:
                    out.append((*compared(last[0], last[2], last[3], points, own), part, None, None, None))
                last = (doc_id, text, points, own)
            yield _table(out, schema)
        if last is not None:
            yield _table([(*none, part, "last", last[0], last[1])], schema)

    dealt = rows.repartitionByRange(max(1, -(-total // TASK_BYTES)), *order).sortWithinPartitions(*order)
    done = written(map_arrow(dealt, run, schema), "neighbours")
    # one small row per task puts the tasks in order; the texts meet by an equal join
    tasks = done.where("edge = 'first'").select("part", (F.row_number().over(Window.orderBy("part")) - 1).alias("place"))
    n = tasks.agg(F.count("*").alias("n")).scalar()
    edges = done.where("edge is not null").select("part", "edge", "edge_id", "edge_text").join(tasks, "part")
    lasts = edges.where("edge = 'last'").select("edge_id", "edge_text", ((F.col("place") + 1) % n).alias("place"))
    firsts = edges.where("edge = 'first'").select(F.col("edge_text").alias("next_text"), "place")

    def at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one, two = code_points(text), code_points(other)
                out.append(compared(doc_id, one, signature(kmers(one)), two, signature(kmers(two))))
            yield _table(out, COMPARED)

    matched = map_arrow(lasts.join(firsts, "place").select("edge_id", "edge_text", "next_text"), at_edges, COMPARED)
    return done.where("edge is null").select(*[x.split()[0] for x in COMPARED.split(", ")]).unionByName(matched)
