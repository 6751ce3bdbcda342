"""Best-two-fit packing of tokenised documents into sequences of bounded length."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm import tokens
from starlens.llm.common import map_arrow, tasks_for

#: Bytes of text that a task is given, and bytes of ids that are packed together; a task with more packs several groups.
GROUP_BYTES = 16 << 20

PIECES = "doc_id long, piece int, start long, length int, ids binary"


def best_two_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item (lengths 1 to ``capacity``); items are taken in order within a length.

    A bin is filled greedily, the longest item that fits first. If a gap stays, the bin's smallest
    item makes room for two unpacked ones, when some two fill the widened gap better than it did;
    of these the two that fill it best. The smallest item goes back to the unpacked ones.
    """
    order = np.argsort(lengths, kind="stable")
    edges = np.searchsorted(lengths[order], np.arange(capacity + 2))
    stacks = [order[a:b][::-1].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)]
    there = np.array([bool(s) for s in stacks])
    bins = np.full(len(lengths), -1, dtype=np.int64)

    def take(size: int) -> int:
        item = stacks[size].pop()
        there[size] = bool(stacks[size])
        return item

    def best_pair(least: int, most: int) -> tuple[int, int] | None:
        for total in range(most, least, -1):
            half = total // 2
            both = there[1:half + 1] & there[total - 1:total - half - 1 if total > half + 1 else 0:-1][:half]
            if total % 2 == 0 and half and len(stacks[half]) < 2:
                both[half - 1] = False
            found = np.flatnonzero(both)
            if len(found):
                return int(found[0]) + 1, total - int(found[0]) - 1
        return None

    left, number = len(lengths), 0
    while left:
        gap, inside = capacity, []
        while gap and len(fits := np.flatnonzero(there[:gap + 1])):
            inside.append((int(fits[-1]), take(int(fits[-1]))))
            gap -= inside[-1][0]
        if gap:
            size, item = inside[-1]
            pair = best_pair(size, gap + size)
            if pair:
                inside.pop()
                inside += [(pair[0], take(pair[0])), (pair[1], take(pair[1]))]
                stacks[size].append(item)
                there[size] = True
        for _, item in inside:
            bins[item] = number
        left -= len(inside)
        number += 1
    return bins


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: a document's ids and the end id, cut into ``capacity`` ids if there are more.

    Of a cut document the first piece holds the rest and the others are full. A null text is empty.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(path)
        for batch in batches:
            doc_ids = batch.column(0)
            for begin, ids, edges in encoder.encode(batch.column(1)):
                n = len(edges) - 1
                ids = np.insert(ids, edges[1:], end_id)
                edges = edges + np.arange(n + 1)
                size = np.diff(edges)
                count = -(-size // capacity)
                doc = np.repeat(np.arange(n), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                head = (size - 1) % capacity + 1
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                # pieces follow each other without a gap, so their ends cut the ids' own buffer
                offsets = pa.array(np.concatenate([[0], np.cumsum(length)]) * 4, type=pa.int32())
                raw = pa.Array.from_buffers(pa.binary(), len(doc), [None, offsets.buffers()[1], pa.py_buffer(ids.astype("<u4").tobytes())])
                yield pa.record_batch({
                    "doc_id": doc_ids.take(pa.array(begin + doc)), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int32()), "ids": raw})

    return map_arrow(docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")), cut, PIECES)


def packed(cut: DataFrame, tasks: int, capacity: int = 1024, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``, their place in a sequence of ``capacity`` ids at most.

    Pieces are dealt by a hash of id, place and ids into ``tasks`` tasks and sorted by it; a task packs
    them in groups of ``group_bytes`` of ids, one after the other, and holds one group at a time. So
    neither rows of one or of null ids nor equal rows, which do share a task, make a group too large.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId() << 40
        for batch in batches:
            batch, held_bytes = batch.drop_columns("_deal"), 4 * pc.sum(batch.column("length")).as_py()
            if held and size + held_bytes > group_bytes:
                out, number = group(held, number)
                yield from out
                held, size = [], 0
            held.append(batch)
            size += held_bytes
        if held:
            yield from group(held, number)[0]

    def group(held: list[pa.RecordBatch], number: int) -> tuple[list[pa.RecordBatch], int]:
        table = pa.Table.from_batches(held).combine_chunks()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        lengths = table["length"].to_numpy().astype(np.int64)
        bins = best_two_fit(lengths, capacity)
        order = np.argsort(bins, kind="stable")
        lengths, bins = lengths[order], bins[order]
        before = np.cumsum(lengths) - lengths
        first = np.flatnonzero(np.diff(bins, prepend=-1))
        offset = before - np.repeat(before[first], np.diff(np.append(first, len(bins))))
        out = table.take(pa.array(order)).append_column("sequence_id", pa.array(number + bins, pa.int64()))
        out = out.append_column("offset", pa.array(offset, pa.int64())).to_batches(max_chunksize=4096)
        return out, number + int(bins[-1]) + 1

    # the hash sorts, so a rerun of the task gets its pieces in the same order, whatever came first
    deal = F.xxhash64("doc_id", "piece", "ids")
    dealt = cut.withColumn("_deal", deal).repartition(tasks, "_deal").sortWithinPartitions("_deal", "doc_id", "piece")
    return map_arrow(dealt, pack, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 2,
                   id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Documents as pieces with their ids (unsigned 32-bit, little-endian) and their places in sequences.

    Repeated rows are packed each on their own; other columns are ignored; no rows give no rows.
    """
    total = docs.select(F.sum(F.octet_length(F.col(text_column).cast("string"))).alias("n")).first()["n"] or 0
    cut = pieces(docs, path or tokens.default_path(), capacity, end_id, id_column, text_column)
    return packed(cut, tasks_for(docs.sparkSession, total, GROUP_BYTES), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """The training sequences themselves: their ids put together in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(0), lambda n, p: n + p["length"]).alias("length"),
        F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"])).alias("ids"))
