"""Near-duplicate groups by SimHash fingerprints, joined by a segment-popcount embedding.

A fingerprint's segments of two bits become bit counts. The Manhattan distance of two such vectors
is at most the Hamming distance of the fingerprints, so fingerprints within RADIUS bits have vectors
within RADIUS, and these differ in at most RADIUS of GROUPS groups of coordinates: the two share a
cell of at least one grid over GROUPS - RADIUS of the groups. Pairs in a cell pass the Manhattan
bound and then the exact distance. Links, not all pairs, leave a cell: as many as join what it links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import map_arrow, row_key, written
from starlens.llm.components import components

RADIUS = 3
#: More groups make more grids and smaller cells; the result is the same.
GROUPS = 6
#: Fingerprints compared in one go; a cell with more is dealt in blocks, each pair of blocks a task.
BLOCK = 4096
SCANNED = 256
EVEN = 0x5555555555555555


def fingerprint(text: str | None, words: int) -> int:
    """64 bits; 0 for a text without words. Bit i is set if it is in over half the shingles' hashes."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    shingles = list(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False))) or [b" ".join(found)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), dtype="<u8", count=len(shingles))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int.from_bytes(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(shingles), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, key_id, key_text, fp) per row; ``fp`` holds the 64 bits as a signed long. A null text has no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py(), words) for x in batch.column(3)], dtype=np.uint64)
            yield pa.record_batch([*batch.columns[:3], pa.array(fps.view(np.int64))], names=["doc_id", "key_id", "key_text", "fp"])

    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), *row_key(F.col(id_column), text), text.alias("text"))
    return map_arrow(rows, run, "doc_id long, key_id long, key_text long, fp long")


def embedded(fps: np.ndarray) -> np.ndarray:
    """The counts of all segments of two bits, in unary, so that the Manhattan distance is a bit count."""
    even, odd = fps & np.uint64(EVEN), (fps >> np.uint64(1)) & np.uint64(EVEN)
    return (even | odd) | ((even & odd) << np.uint64(1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int, groups: int) -> list[int]:
    """For each choice of groups - radius groups of coordinates, their bits in the embedding."""
    edges = [2 * (32 * g // groups) for g in range(groups + 1)]
    group = [(1 << b) - (1 << a) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return [_signed(sum(group[g] for g in chosen)) for chosen in combinations(range(groups), groups - radius)]


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of places in ``fps`` that join all that links of ``radius`` bits join: one less than each part has."""
    codes, left, links = embedded(fps), np.arange(1, len(fps)), []
    queue = [0]
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        x = queue.pop()
        near = np.bitwise_count(codes[left] ^ codes[x]) <= radius  # the lower bound
        near[near] = np.bitwise_count(fps[left[near]] ^ fps[x]) <= radius
        links += [(x, int(y)) for y in left[near]]
        queue += left[near].tolist()
        left = left[~near]
    return links


def runs_with_links(fps: np.ndarray, edges: np.ndarray, radius: int) -> np.ndarray:
    """The runs (fps[edges[k]:edges[k + 1]]) to look for links in: all longer than SCANNED, and the shorter ones
    that have one, found for all of them at once, distance by distance."""
    codes, size = embedded(fps), np.diff(edges)
    run = np.repeat(np.arange(len(size)), size)
    found = size > SCANNED
    here = np.flatnonzero(~found[run])
    last = edges[run + 1]
    for step in range(1, SCANNED):
        here = here[here + step < last[here]]
        if not len(here):
            break
        near = here[np.bitwise_count(codes[here] ^ codes[here + step]) <= radius]  # the lower bound
        found[run[near[np.bitwise_count(fps[near] ^ fps[near + step]) <= radius]]] = True
    return np.flatnonzero(found)


def links(fps: DataFrame, radius: int = RADIUS, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """(a, b) of distinct fingerprints ``fp`` within ``radius`` bits: enough of these to connect whatever they connect."""
    even, odd = F.col("fp").bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(EVEN))
    code = even.bitwiseOR(odd).bitwiseOR(F.shiftleft(even.bitwiseAND(odd), 1))
    grids = F.array(*[F.struct(F.lit(i).alias("grid"), F.col("_code").bitwiseAND(F.lit(m)).alias("cell")) for i, m in enumerate(masks(radius, groups))])
    cells = fps.withColumn("_code", code).select("fp", F.inline(grids))
    shared = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    tasks = cells.join(shared, ["grid", "cell"]).withColumn("blocks", blocks).withColumn("mine", mine) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("grid", "cell", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "fp")
    keys = ["grid", "cell", "i", "j"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(5)], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            new = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1)) + 1
            cut = int(new[-1]) if len(new) else 0
            held = rows[cut:]  # the last run may go on in the next batch
            if cut:
                yield linked(rows[:cut], np.concatenate([[0], new]))
        if held is not None and len(held):
            yield linked(held, np.array([0, len(held)]))

    def linked(rows: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
        fps = np.ascontiguousarray(rows[:, 4]).view(np.uint64)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for run in runs_with_links(fps, edges, radius):
            start, end = edges[run], edges[run + 1]
            found = np.array(forest(fps[start:end], radius), dtype=np.int64).reshape(-1, 2) + start
            a.append(rows[found[:, 0], 4])
            b.append(rows[found[:, 1], 4])
        return pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    dealt = tasks.repartition(*keys).sortWithinPartitions(*keys)
    found = map_arrow(dealt, compare, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def grouped(docs: DataFrame, words: int = 3, radius: int = RADIUS, groups: int = GROUPS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``fp``, ``component_id`` (the smallest id in its group), and the group's first row by key.

    Equal fingerprints are one node, so copies cost nothing beyond their own rows. Null ids come last
    within a group; a group of null ids only has a null ``component_id``. Other columns are ignored.
    """
    rows = written(fingerprints(docs, words, id_column, text_column), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_id", "key_text")).alias("first")
    nodes = written(rows.groupBy("fp").agg(first), "nodes")
    roots = components(links(nodes.select("fp"), radius, groups))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    labels = rooted.select("fp", "root").join(firsts, "root").select("fp", "first")
    return rows.join(labels, "fp").withColumn("component_id", F.col("first")["doc_id"])


def deduplicated(docs: DataFrame, words: int = 5, radius: int = 7, groups: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group: that of the smallest id; rows repeated under one id and text become one.

    Seven bits of 64 are a Jaccard similarity of the five-word shingles of about 0.9.
    """
    kept = grouped(docs, words, radius, groups, id_column, text_column).where((F.col("key_id") == F.col("first")["key_id"]) & (F.col("key_text") == F.col("first")["key_text"]))
    names = ["_dedup_id", "_dedup_text"]
    keys = [k.alias(n) for k, n in zip(row_key(F.col(id_column), F.col(text_column).cast("string")), names, strict=True)]
    left = kept.select(F.col("key_id").alias(names[0]), F.col("key_text").alias(names[1])).distinct()
    return docs.select("*", *keys).join(left, names, "left_semi").dropDuplicates(names).drop(*names)
