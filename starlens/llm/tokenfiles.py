"""Token ids stored in files by Re-Pair grammar compression, and read back.

A file row is a block: some documents in ascending id order. Frequent pairs of neighbouring symbols
are replaced by new symbols, again and again; the row holds the rules, how many ids each rule
expands to, what is left of the sequence, and per document its numbers of ids and of symbols.
Pairs never reach over a document's end, so any document is decoded from its own symbols.
The files are Parquet: Spark's writer commits whole tasks, on any file system.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starlens.llm import tokens
from starlens.llm.common import map_arrow, tasks_for

#: Bytes of text per shard, and ids per block of a shard (a longer document makes a block of its own).
SHARD_BYTES = 32 << 20
BLOCK_IDS = 1 << 20
#: Pairs replaced together in a round, and how often one must occur: a rule takes three numbers in the file.
PAIRS, LEAST = 4096, 16
BUCKETS = 20
#: Places of at most so many blocks are broadcast, some 10 MB.
SENT_BLOCKS = 100_000

BLOCK = ("shard int, block int, low long, high long, n_ids long, base int, doc_ids binary, doc_nulls binary, "
         "doc_sizes binary, doc_symbols binary, rules binary, rule_sizes binary, symbols binary")


def _frequent(left: np.ndarray, right: np.ndarray, exact: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of neighbours: which may occur LEAST times, the places among these of the at most PAIRS most
    frequent ones, each place's pair by number, and the pairs.

    A bucket of a hash stands for the pair that comes first in it, the others wait for a later round.
    ``exact`` sorts the pairs of buckets with LEAST and more instead, so none is hidden behind another.
    """
    bits = min(BUCKETS, len(left).bit_length() + 1)
    bucket = ((left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)).astype(np.int64)
    seen = np.bincount(bucket, minlength=1 << bits)
    often = seen[bucket] >= LEAST
    left, right, which = left[often], right[often], bucket[often]
    if exact:
        keys, which, seen = np.unique((left.astype(np.uint64) << np.uint64(32)) | right, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(seen >= LEAST)
    if len(chosen) > PAIRS:
        chosen = np.sort(chosen[np.argpartition(seen[chosen], -PAIRS)[-PAIRS:]])
    number = np.full(len(seen), -1, dtype=np.int32)
    number[chosen] = np.arange(len(chosen))
    which = number[which]
    held = np.flatnonzero(which >= 0)
    which = which[held]
    firsts, seconds = left[held], right[held]
    pairs = np.zeros((len(chosen), 2), np.uint32)
    pairs[which[::-1], 0], pairs[which[::-1], 1] = firsts[::-1], seconds[::-1]
    if not exact:
        same = (pairs[which, 0] == firsts) & (pairs[which, 1] == seconds)
        held, which = held[same], which[same]
    return often, held, which, pairs


def compress(ids: np.ndarray, sizes: np.ndarray) -> dict:
    """Re-Pair of documents that follow each other in ``ids``. Several frequent pairs go in one round; it ends
    when no pair of neighbours in one document can be replaced LEAST times."""
    base = int(ids.max()) + 1 if len(ids) else 1
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), dtype=bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    rules: list[np.ndarray] = []
    fresh = base
    # pairs of symbols that were there before only become rarer: once rare, a place is looked at again beside a new symbol only
    alive, exact = ~last, False
    while True:
        place = np.flatnonzero(alive)
        often, held, which, pairs = _frequent(symbols[place], symbols[place + 1], exact)
        alive[place[~often]] = False
        place = place[often][held]
        # of pairs that share symbols, every second one from the left
        begins = np.diff(place, prepend=-2) != 1
        since = np.arange(len(place)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        place, which = place[since % 2 == 0], which[since % 2 == 0]
        good = np.bincount(which, minlength=len(pairs)) >= LEAST
        if not good.any():
            if exact:
                break
            exact = True
            continue
        place, which = place[good[which]], which[good[which]]
        new = np.zeros(len(pairs), dtype=np.uint32)
        new[good] = fresh + np.arange(good.sum())
        rules.append(pairs[good])
        keep = np.ones(len(symbols), dtype=bool)
        keep[place + 1] = False
        symbols[place] = new[which]
        last[place] = last[place + 1]
        symbols, last, alive = symbols[keep], last[keep], alive[keep]
        fresh += int(good.sum())
        # each place moves left by the places before it
        place = place - np.arange(len(place))
        alive[place] = ~last[place]
        before = place[place > 0] - 1
        alive[before] = ~last[before]
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    lengths = np.ones(base + len(table), dtype=np.int64)
    for start, stop in _rounds(rules, base):
        lengths[start:stop] = lengths[table[start - base:stop - base, 0]] + lengths[table[start - base:stop - base, 1]]
    ends = np.flatnonzero(last)
    held = np.zeros(len(sizes), dtype=np.int64)
    held[sizes > 0] = np.diff(ends, prepend=-1)
    return {"base": base, "n_ids": len(ids), "doc_sizes": sizes.astype("<u4").tobytes(), "doc_symbols": held.astype("<u4").tobytes(),
            "rules": table.astype("<u4").tobytes(), "rule_sizes": lengths[base:].astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes()}


def _rounds(rules: list[np.ndarray], base: int) -> Iterator[tuple[int, int]]:
    start = base
    for r in rules:
        yield start, start + len(r)
        start += len(r)


def expand(symbols: np.ndarray, base: int, rules: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ids that ``symbols`` stand for, by the rules and their stored expansion lengths."""
    size = np.ones(len(symbols), dtype=np.int64)
    high = symbols >= base
    size[high] = sizes[symbols[high] - base]
    out = np.zeros(int(size.sum()), dtype=np.uint32)
    at = np.cumsum(size) - size
    while len(symbols):
        high = symbols >= base
        out[at[~high]] = symbols[~high]
        symbols, at = symbols[high], at[high]
        pair = rules[symbols - base]
        step = np.ones(len(pair), dtype=np.int64)
        deep = pair[:, 0] >= base
        step[deep] = sizes[pair[deep, 0] - base]
        symbols, at = np.concatenate([pair[:, 0], pair[:, 1]]), np.concatenate([at, at + step])
    return out


def write_tokens(docs: DataFrame, target: str, path: str | None = None, end_id: int = 2,
                 id_column: str = "doc_id", text_column: str = "text") -> None:
    """Encodes whole texts (null: empty), puts ``end_id`` behind each, and writes them in ascending id order.

    Null ids come first; rows of one id follow each other by a hash of the text. Shards are cut by both, so
    rows of one id or of null ids fill several; equal rows share one, whose blocks stay as small as any.
    Other columns are ignored.
    """
    path = path or tokens.default_path()
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0

    def block(shard: int, number: int, held: list) -> pa.RecordBatch:
        doc_ids = pa.concat_arrays([x[0] for x in held])
        sizes = np.concatenate([x[2] for x in held])
        row = compress(np.concatenate([x[1] for x in held]), sizes)
        nulls = doc_ids.is_null().to_numpy(zero_copy_only=False)
        numbers = doc_ids.fill_null(0).to_numpy()
        low, high = (None, None) if nulls.all() else (int(numbers[~nulls].min()), int(numbers[~nulls].max()))
        row |= {"shard": shard, "block": number, "low": low, "high": high, "doc_ids": numbers.astype("<i8").tobytes(), "doc_nulls": np.packbits(nulls).tobytes()}
        types = dict(x.split() for x in BLOCK.split(", "))
        kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
        return pa.record_batch({k: pa.array([row[k]], kinds[t]) for k, t in types.items()})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = tokens.encoder(path), TaskContext.get().partitionId()
        held, n, number = [], 0, 0
        for batch in batches:
            for begin, ids, edges in encoder.encode(batch.column(1)):
                rows = len(edges) - 1
                ids = np.insert(ids, edges[1:], end_id)
                edges = edges + np.arange(rows + 1)
                if held and n + len(ids) > BLOCK_IDS:
                    yield block(shard, number, held)
                    held, n, number = [], 0, number + 1
                held.append((batch.column(0).slice(begin, rows), ids, np.diff(edges)))
                n += len(ids)
        if held:
            yield block(shard, number, held)

    order = [F.col("doc_id"), F.xxhash64("text")]
    sorted_docs = docs.repartitionByRange(tasks_for(docs.sparkSession, total, SHARD_BYTES), *order).sortWithinPartitions(*order)
    map_arrow(sorted_docs, encode, BLOCK).write.option("compression", "zstd").parquet(target)


DECODED = "doc_id long, start long, n_tokens long, ids binary"


def _decode(blocks: DataFrame, wanted: set[int] | None = None) -> DataFrame:

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                u4 = {k: np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("doc_sizes", "doc_symbols", "rules", "rule_sizes", "symbols")}
                doc_ids = np.frombuffer(row["doc_ids"], "<i8")
                nulls = np.unpackbits(np.frombuffer(row["doc_nulls"], np.uint8))[:len(doc_ids)].astype(bool)
                sizes, held, symbols = u4["doc_sizes"], u4["doc_symbols"], u4["symbols"]
                start = row["start"] + np.cumsum(sizes) - sizes
                if wanted is not None:
                    pick = np.isin(doc_ids, list(wanted)) & ~nulls
                    symbols = symbols[np.repeat(pick, held)]
                    doc_ids, nulls, sizes, start = doc_ids[pick], nulls[pick], sizes[pick], start[pick]
                ids = expand(symbols, row["base"], u4["rules"].reshape(-1, 2), u4["rule_sizes"])
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]) * 4, pa.int32())
                raw = pa.Array.from_buffers(pa.binary(), len(sizes), [None, offsets.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.record_batch({"doc_id": pa.array(doc_ids, pa.int64(), mask=nulls), "start": pa.array(start, pa.int64()),
                                       "n_tokens": pa.array(sizes, pa.int64()), "ids": raw})

    return map_arrow(blocks, decode, DECODED)


def _blocks(spark: SparkSession, target: str) -> DataFrame:
    """Blocks with ``start``, the ids before them: a running sum over one row per shard, then one inside each shard."""
    blocks = spark.read.schema(BLOCK).parquet(target)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    places = blocks.select("shard", "block", inside.alias("inside")).join(shards, "shard")
    starts = places.select("shard", "block", (F.col("before") + F.col("inside")).alias("start"))
    # three numbers a block: sent to the blocks, unless there are very many, so that the blocks stay where they are read
    return blocks.join(F.broadcast(starts) if blocks.count() <= SENT_BLOCKS else starts, ["shard", "block"])


def read_tokens(spark: SparkSession, target: str) -> DataFrame:
    """Every document of the files: its id, the ids before it, its number of ids, and its ids (end id included)."""
    return _decode(_blocks(spark, target))


def fetch(spark: SparkSession, target: str, doc_ids: Iterable[int]) -> DataFrame:
    """Some documents: reads only blocks that may hold them and expands only their symbols."""
    wanted = set(doc_ids)
    in_reach = F.lit(False)
    for i in wanted:
        in_reach = in_reach | ((F.col("low") <= i) & (F.col("high") >= i))
    return _decode(_blocks(spark, target).where(in_reach), wanted)
