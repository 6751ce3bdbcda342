"""Conversation structure repair: the cheapest edits that give every conversation alternating turns.

A conversation is well formed if its roles' initials are ``(s?(ua)+)?``. A state says what came last
(nothing, system, user, assistant); a row is kept, given another role or deleted, and rows of empty
text may be inserted. The costs from every (row, state) to the end are suffix products of 4 x 4
matrices over (min, +), made by doubling. The edits on some cheapest way are the optimal arcs, and
their nodes are ranked by the least audit of 1, 2, 4, ... letters that starts there; the ranks
choose one arc of each node, and doubled pointers mark the nodes of the least way. The edits of a
node have different letters, so a node has one least audit of each length and needs one pointer.

Conversations of up to LONG rows and LONG_BYTES of text are dealt whole. Longer ones are cut into
pieces of at most PIECE rows: a piece is summed up by one matrix and a few counts, which are put
together over the pieces of a part and over the parts, so no task holds a long conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from starlens.llm.common import map_arrow, parts, written

LONG = 20_000
LONG_BYTES = 16_000_000
PIECE = 2048
#: Rows and bytes of text whose edits are found in one go.
SLICE = 8192
SLICE_BYTES = 8_000_000

DELETE, INSERT, KEEP, REROLE = range(4)  # as their letters are ordered
LETTERS = np.frombuffer(b"DIKR", np.uint8)
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The role that an inserted or renamed row has after each state.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: The state after a kept row, by state and the row's initial (other, s, u, a); -1: it can't be kept.
KEPT = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
LEGAL = np.zeros((4, 4), bool)
LEGAL[[1, 2, 3], [2, 3, 2]] = True
NAMES = [b"", b"system", b"user", b"assistant"]
FAR = 1 << 40
#: The cost of inserts that lead from one state to another, and from a state to the end.
INSERTS = np.array([[0, FAR, 2, 4], [FAR, 0, 2, 4], [FAR, FAR, 0, 2], [FAR, FAR, 2, 0]])
END = np.array([0, 4, 2, 0])

REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix products over (min, +)."""
    return (a[..., :, :, None] + b[..., None, :, :]).min(axis=-2)


def matrices(initial: np.ndarray, gone: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Per row the costs from state to state: inserts, then the row's own edit."""
    out = np.full((len(initial), STATES, STATES), FAR)
    rows = np.arange(len(initial))
    for q in range(STATES):
        out[:, q, q] = 3
        stay = ~gone
        out[rows[stay], q, NEXT[q]] = np.minimum(out[rows[stay], q, NEXT[q]], 2 + cut[stay])
        can = stay & (KEPT[q, initial] >= 0)
        target = KEPT[q, initial[can]]
        out[rows[can], q, target] = np.minimum(out[rows[can], q, target], cut[can])
    return product(INSERTS, out)


def suffix_products(steps: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Per row the product of the matrices from it to the end of its piece."""
    out, last, step = steps.copy(), np.repeat(edges[1:], np.diff(edges)), 1
    here = np.arange(len(steps))
    while True:
        here = here[here + step < last[here]]
        if not len(here):
            return out
        out[here] = product(out[here], out[here + step])
        step *= 2


class Edits:
    """The least cheapest edits of pieces: rows ``edges[k]:edges[k + 1]`` with the costs ``ends[k]`` beyond their last."""

    def __init__(self, initial: np.ndarray, gone: np.ndarray, cut: np.ndarray, edges: np.ndarray, ends: np.ndarray, last: np.ndarray):
        n, m = len(initial), len(edges) - 1
        piece = np.repeat(np.arange(m), np.diff(edges))
        place, stop = np.arange(n) + piece, edges[1:] + np.arange(m)  # the nodes of a piece's end follow those of its rows
        self.starts, self.piece = edges[:-1] + np.arange(m), np.zeros(n + m, np.int64)
        self.piece[place], self.piece[stop] = piece, np.arange(m)
        self.row = np.zeros(n + m, np.int64)
        self.row[place] = np.arange(n)
        costs = np.empty((n + m, STATES), np.int64)
        costs[place] = (suffix_products(matrices(initial, gone, cut), edges) + ends[piece][:, None, :]).min(axis=2)
        costs[stop] = ends
        self.costs = costs

        target = np.tile(np.arange(STATES * (n + m)).reshape(-1, STATES, 1), (1, 1, 4))
        best = np.zeros((n + m, STATES, 4), bool)
        open_ = np.concatenate([place, stop[last]])
        for q in range(STATES):
            target[open_, q, INSERT] = STATES * open_ + NEXT[q]
            best[open_, q, INSERT] = 2 + costs[open_, NEXT[q]] == costs[open_, q]
            target[place, q, DELETE] = STATES * (place + 1) + q
            best[place, q, DELETE] = 3 + costs[place + 1, q] == costs[place, q]
            target[place, q, REROLE] = STATES * (place + 1) + NEXT[q]
            best[place, q, REROLE] = ~gone & (2 + cut + costs[place + 1, NEXT[q]] == costs[place, q])
            after = KEPT[q, initial]
            target[place, q, KEEP] = STATES * (place + 1) + after
            best[place, q, KEEP] = ~gone & (after >= 0) & (cut + costs[place + 1, after] == costs[place, q])
        target, best = target.reshape(-1, 4), best.reshape(-1, 4)
        end = ~best.any(axis=1)
        rank = ranks(target, best, end)
        key = np.where(best, np.arange(4) * (rank.max() + 1) + rank[target], np.iinfo(np.int64).max)
        self.choice = key.argmin(axis=1)
        self.next = np.where(end, np.arange(len(end)), target[np.arange(len(end)), self.choice])
        self.end, self.jumps = end, [self.next]
        self.left = (~end).astype(np.int64)
        while not end[self.jumps[-1]].all():
            jump = self.jumps[-1]
            self.left = self.left + self.left[jump]
            self.jumps.append(jump[jump])
        # once more, since the last doubling only found the ends
        self.left = self.left + self.left[self.jumps[-1]]

    def exits(self) -> np.ndarray:
        """(pieces, states): the state at the end of a piece that is entered in each state."""
        return self.jumps[-1][STATES * self.starts[:, None] + np.arange(STATES)] % STATES

    def path(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(piece, edit, row, state after) of the edits from the entry states on, in order."""
        on = np.zeros(len(self.end), bool)
        on[STATES * self.starts + entry] = True
        for jump in reversed(self.jumps):
            on[jump[np.flatnonzero(on)]] = True
        nodes = np.flatnonzero(on & ~self.end)
        piece = self.piece[nodes // STATES]
        order = np.lexsort((-self.left[nodes], piece))
        nodes, piece = nodes[order], piece[order]
        return piece, self.choice[nodes], self.row[nodes // STATES], self.next[nodes] % STATES


def ranks(target: np.ndarray, best: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Per node the rank of its least audit among those of all nodes; that of length 2k follows from two of length k."""
    first = best.argmax(axis=1)
    pointer = np.where(end, np.arange(len(end)), target[np.arange(len(end)), first])
    rank = np.where(end, 0, first + 1)
    while True:
        rank = np.unique(rank * (rank.max() + 1) + rank[pointer], return_inverse=True)[1]
        if end[pointer].all():
            return rank
        pointer = pointer[pointer]


class Rows:
    """Rows of one or more pieces, with their faults. ``again`` holds the places of rows known from earlier pieces."""

    def __init__(self, roles: list[str], texts: list[str], edges: list[int], again: set[int] = frozenset()):
        self.roles = [r.encode("utf-8", "surrogatepass") for r in roles]
        self.texts = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.edges = np.array(edges)
        n = len(roles)
        self.initial = np.fromiter(({115: 1, 117: 2, 97: 3}.get(r[0], 0) if r else 0 for r in self.roles), np.int64, n)
        bare = [t.strip(b" \t\n\x0b\x0c\r") for t in self.texts]
        self.blank = np.fromiter((not b for b in bare), bool, n)
        self.duplicate = np.zeros(n, bool)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            seen = set()
            for k in range(a, b):
                row = self.roles[k], self.texts[k]
                self.duplicate[k] = k in again or row in seen
                seen.add(row)
        self.duplicate &= ~self.blank
        self.gone = self.blank | self.duplicate
        self.cut = (np.fromiter((b[-1:] not in (b".", b"!", b"?") for b in bare), bool, n) & ~self.gone).astype(np.int64)

    def counted(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.edges[1:]] - total[self.edges[:-1]]

    def illegal(self) -> np.ndarray:
        bad = np.zeros(len(self.initial), bool)
        bad[1:] = ~LEGAL[self.initial[:-1], self.initial[1:]]
        bad[self.edges[:-1][np.diff(self.edges) > 0]] = False
        return self.counted(bad)

    def lines(self, edit: np.ndarray, row: np.ndarray, state: np.ndarray) -> list[tuple[bytes, bytes]]:
        """(role, text) of what the edits leave."""
        out = []
        for e, k, q in zip(edit.tolist(), row.tolist(), state.tolist(), strict=True):
            if e == KEEP:
                out.append((self.roles[k], self.texts[k]))
            elif e != DELETE:
                out.append((NAMES[q], self.texts[k] if e == REROLE else b""))
        return out


def gaps(turns: list[int | None]) -> int:
    known = [t for t in turns if t is not None]
    return max(known) - min(known) + 1 - len(set(known)) if known else 0


def ordered(rows: DataFrame, dropped: str | None) -> DataFrame:
    """(conv_id, turn, role, text, dropped, place): nulls of role and text as one space; ``place`` orders the rows of a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    gone = F.coalesce(F.col(dropped), F.lit(False)) if dropped else F.lit(False)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role, text, gone.alias("dropped")) \
        .withColumn("place", F.when(~F.col("dropped"), F.xxhash64("text")))


ORDER = ["turn", "role", "place", "text"]  # ascending, nulls first


# whole conversations ------------------------------------------------------------------------------

def repaired_whole(rows: DataFrame, turns: bool) -> DataFrame:
    """Conversations dealt by their id, some SLICE rows repaired at a time."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def flush(ids: list, edges: list[int], number: list, roles: list, texts: list, id_type: pa.DataType) -> pa.RecordBatch:
        found = Rows(roles, texts, edges)
        m = len(ids)
        edits = Edits(found.initial, found.gone, found.cut, found.edges, np.tile(END, (m, 1)), np.arange(m))
        piece, edit, row, state = edits.path(np.zeros(m, np.int64))
        cuts = np.searchsorted(piece, np.arange(m + 1))
        audits, left = [], []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            audits.append(LETTERS[edit[a:b]].tobytes().decode())
            left.append(found.lines(edit[a:b], row[a:b], state[a:b]))
        if turns:
            return turn_batch(ids, left, [0] * m, id_type)
        counts = [[gaps(number[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)],
                  *(found.counted(x) for x in (found.blank, found.duplicate, found.cut)), found.illegal(), edits.costs[edits.starts, START]]
        digests = [hashlib.sha256(b"\n".join(r + b":" + t for r, t in x)).hexdigest() for x in left]
        return pa.record_batch([pa.array(ids, id_type), *(pa.array(c, pa.int64()) for c in counts), pa.array(audits), pa.array(digests)],
                               names=["conv_id", *REPORT, "audit", "repaired_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, edges, held, size, id_type = [], [0], [[], [], []], 0, None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, t, r, x, gone in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if not ids or i != ids[-1]:
                    if len(held[0]) >= SLICE or size >= SLICE_BYTES or len(ids) >= SLICE:
                        yield flush(ids, edges, *held, id_type)
                        ids, edges, held, size = [], [0], [[], [], []], 0
                    ids.append(i)
                    edges.append(edges[-1])
                if not gone:
                    edges[-1] += 1
                    size += len(x)
                    for column, value in zip(held, (t, r, x), strict=True):
                        column.append(value)
        if ids:
            yield flush(ids, edges, *held, id_type)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).drop("place")
    return map_arrow(dealt, run, turn_schema(kind) if turns else report_schema(kind))


def report_schema(kind: str) -> str:
    return f"conv_id {kind}, " + ", ".join(f"{c} long" for c in REPORT) + ", audit string, repaired_sha256 string"


def turn_schema(kind: str) -> str:
    return f"conv_id {kind}, part long, place long, role string, text string"


def turn_batch(ids: list, left: list[list[tuple[bytes, bytes]]], part: list[int], id_type: pa.DataType) -> pa.RecordBatch:
    number = [len(x) for x in left]
    flat = [row for x in left for row in x]
    columns = [pa.array(np.repeat(part, number), pa.int64()), pa.array([k for n in number for k in range(n)], pa.int64()),
               *(pa.array([row[k].decode("utf-8", "replace") for row in flat], pa.string()) for k in range(2))]
    return pa.record_batch([pa.array([i for i, n in zip(ids, number, strict=True) for _ in range(n)], id_type), *columns],
                           names=["conv_id", "part", "place", "role", "text"])


# long conversations in pieces ---------------------------------------------------------------------

#: A piece or a run of pieces: 16 costs, then counts and what a neighbour needs.
SUMMARY = ["blank", "duplicate", "truncated", "illegal", "n", "first", "last", "turns", "low", "high"]


def joined(a: list[int], b: list[int]) -> list[int]:
    """The summary of two runs of pieces that follow each other."""
    cost = product(np.array(a[:16]).reshape(4, 4), np.array(b[:16]).reshape(4, 4)).ravel().tolist()
    x, y = dict(zip(SUMMARY, a[16:], strict=True)), dict(zip(SUMMARY, b[16:], strict=True))
    out = {k: x[k] + y[k] for k in ("blank", "duplicate", "truncated", "illegal", "n", "turns")}
    if x["n"] and y["n"] and not LEGAL[x["last"], y["first"]]:
        out["illegal"] += 1
    if x["turns"] and y["turns"] and x["high"] == y["low"]:
        out["turns"] -= 1
    out["first"], out["last"] = x["first"] if x["n"] else y["first"], y["last"] if y["n"] else x["last"]
    out["low"], out["high"] = x["low"] if x["turns"] else y["low"], y["high"] if y["turns"] else x["high"]
    return cost + [out[k] for k in SUMMARY]


def in_runs(df: DataFrame, keys: list[str], order: list[str], function: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``function`` of the rows that share ``keys``, in order, for rows and runs that are small."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and any(held[0][k] != row[k] for k in keys):
                    yield pa.RecordBatch.from_pylist(function(held), schema=target)
                    held = []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(function(held), schema=target)

    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys, *order), run, schema)


def cut_into_pieces(rows: DataFrame, size: int) -> DataFrame:
    """(conv_id, part, seq, turns, roles, texts): at most ``size`` rows each, in order by part and seq.

    Rows are dealt by their order, so a conversation goes over as many parts as its share of all rows
    asks for; repeated rows are told apart by where they were read, and may lie in several parts.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parts(rows.sparkSession), "conv_id", *ORDER[:3], "_tie") \
        .withColumn("part", F.spark_partition_id().cast("long")).sortWithinPartitions("conv_id", *ORDER) \
        .select("conv_id", "turn", "role", "text", "dropped", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seq, weight, id_type = None, 0, 0, None

        def batch_of(piece: list) -> pa.RecordBatch:
            i, part, *columns = piece
            kinds = (pa.int64(), pa.string(), pa.string())
            return pa.record_batch([pa.array([i], id_type), pa.array([part], pa.int64()), pa.array([seq], pa.int64()),
                                    *(pa.array([c], pa.list_(k)) for c, k in zip(columns, kinds, strict=True))],
                                   names=["conv_id", "part", "seq", "turns", "roles", "texts"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, t, r, x, gone, part in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if held is None or held[0] != i or len(held[2]) >= size or weight >= SLICE_BYTES:
                    if held is not None:
                        yield batch_of(held)
                        seq += 1
                    held, weight = [i, part, [], [], []], 0
                if not gone:
                    weight += len(x)
                    for column, value in zip(held[2:], (t, r, x), strict=True):
                        column.append(value)
        if held is not None:
            yield batch_of(held)

    return map_arrow(dealt, run, f"conv_id {kind}, part long, seq long, turns array<long>, roles array<string>, texts array<string>")


def seen_before(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, seq, again): the places of rows that an earlier piece of the conversation holds.

    A piece sends each of its different rows once, so a row that fills a conversation comes from its pieces only.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                first: dict[bytes, int] = {}
                for place, (r, t) in enumerate(zip(batch.column(3)[k].as_py(), batch.column(4)[k].as_py(), strict=True)):
                    digest = hashlib.sha256(f"{len(r)}:{r}:{t}".encode("utf-8", "surrogatepass")).digest()
                    first.setdefault(digest, place)
                n = len(first)
                yield pa.record_batch([*(pa.array([batch.column(j)[k].as_py()] * n, batch.schema.field(j).type) for j in range(3)),
                                       pa.array(list(first), pa.binary()), pa.array(list(first.values()), pa.int64())],
                                      names=["conv_id", "part", "seq", "digest", "place"])

    rows = map_arrow(pieces.select("conv_id", "part", "seq", "roles", "texts"), run, f"conv_id {kind}, part long, seq long, digest binary, place long")
    rows = rows.withColumn("piece", F.struct("part", "seq"))
    first = rows.groupBy("conv_id", "digest").agg(F.min("piece").alias("first"), F.count("*").alias("n")).where("n > 1")
    same = rows.alias("r").join(first.alias("f"), (F.col("r.conv_id").eqNullSafe(F.col("f.conv_id"))) & (F.col("r.digest") == F.col("f.digest")))
    return same.where("r.piece <> f.first").groupBy("r.conv_id", "r.part", "r.seq").agg(F.collect_list("r.place").alias("again"))


def with_pieces(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys that may be null."""
    renamed = right.select(*(F.col(k).alias(f"_{k}") if k in keys else F.col(k) for k in right.columns))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = left.join(renamed, same, how)
    return out.drop(*(f"_{k}" for k in keys))


def summed(pieces: DataFrame) -> DataFrame:
    """(conv_id, part, seq, summary) per piece."""
    kind = pieces.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k in range(batch.num_rows):
                turns, roles, texts, again = (batch.column(j)[k].as_py() for j in range(3, 7))
                rows = Rows(roles, texts, [0, len(roles)], set(again or ()))
                steps = matrices(rows.initial, rows.gone, rows.cut)
                cost = suffix_products(steps, rows.edges)[0] if len(roles) else np.where(np.eye(4, dtype=bool), 0, FAR)
                known = [t for t in turns if t is not None]
                n = len(roles)
                counts = [int(rows.blank.sum()), int(rows.duplicate.sum()), int(rows.cut.sum()), int(rows.illegal()[0]), n,
                          int(rows.initial[0]) if n else 0, int(rows.initial[-1]) if n else 0,
                          len(set(known)), known[0] if known else 0, known[-1] if known else 0]
                out.append(cost.ravel().tolist() + counts)
            yield pa.record_batch([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], names=["conv_id", "part", "seq", "summary"])

    return map_arrow(pieces.select("conv_id", "part", "seq", "turns", "roles", "texts", "again"), run,
                     f"conv_id {kind}, part long, seq long, summary array<long>")


def folded(rows: list[dict]) -> list[int]:
    total = rows[0]["summary"]
    for row in rows[1:]:
        total = joined(total, row["summary"])
    return total


def ends_of(rows: list[dict], end: list[int], last: bool) -> list[tuple[list[int], bool]]:
    """Per run of pieces, the costs beyond it, and whether nothing follows."""
    out, after = [], np.array(end)
    for k, row in enumerate(reversed(rows)):
        out.append((after.tolist(), last and k == 0))
        after = (np.array(row["summary"][:16]).reshape(4, 4) + after).min(axis=1)
    return out[::-1]


def repaired_long(rows: DataFrame, turns: bool, size: int) -> DataFrame:
    """Conversations of any length, in pieces of ``size`` rows; see the module's text."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    cut = written(cut_into_pieces(rows, size), "conversation_pieces")
    key = ["conv_id", "part", "seq"]
    pieces = written(with_pieces(cut, seen_before(cut), key, "left"), "conversation_pieces")
    sums = written(summed(pieces), "conversation_sums")

    # up: pieces to parts to conversations; down: the costs beyond every part, then beyond every piece
    of_part = in_runs(sums, ["conv_id", "part"], ["seq"], lambda x: [{**{k: x[0][k] for k in ("conv_id", "part")}, "summary": folded(x)}],
                      f"conv_id {kind}, part long, summary array<long>")

    def of_conversation(x: list[dict]) -> list[dict]:
        total = folded(x)
        return [{"conv_id": r["conv_id"], "part": r["part"], "end": e, "last": z, "total": total if z else None}
                for r, (e, z) in zip(x, ends_of(x, END.tolist(), True), strict=True)]

    parts_ = written(in_runs(of_part, ["conv_id"], ["part"], of_conversation, f"conv_id {kind}, part long, end array<long>, last boolean, total array<long>"), "conversation_parts")

    def of_pieces(x: list[dict]) -> list[dict]:
        return [{**{k: r[k] for k in key}, "end": e, "last": z} for r, (e, z) in zip(x, ends_of(x, x[0]["end"], x[0]["last"]), strict=True)]

    ends = in_runs(with_pieces(sums, parts_.drop("total"), key[:2]), key[:2], ["seq"], of_pieces, f"conv_id {kind}, part long, seq long, end array<long>, last boolean")
    pieces = written(with_pieces(pieces, ends, key), "conversation_pieces")

    # the state in which each piece is entered, from the states it leads to
    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [edits_of(row)[1].exits()[0].tolist() for row in batch.to_pylist()]
            yield pa.record_batch([*batch.columns[:3], pa.array(out, pa.list_(pa.int64()))], names=[*key, "exits"])

    leads = written(map_arrow(pieces, exits, f"conv_id {kind}, part long, seq long, exits array<long>"), "conversation_exits")

    def through(x: list[dict]) -> list[dict]:
        at = [0, 1, 2, 3]
        for r in x:
            at = [r["exits"][q] for q in at]
        return [{"conv_id": x[0]["conv_id"], "part": x[0]["part"], "exits": at}]

    def entered(x: list[dict], at: int, names: list[str]) -> list[dict]:
        out = []
        for r in x:
            out.append({**{k: r[k] for k in names}, "entry": at})
            at = r["exits"][at]
        return out

    part_exits = in_runs(leads, key[:2], ["seq"], through, f"conv_id {kind}, part long, exits array<long>")
    part_entry = in_runs(part_exits, ["conv_id"], ["part"], lambda x: entered(x, START, key[:2]), f"conv_id {kind}, part long, entry long")
    entry = in_runs(with_pieces(leads, part_entry, key[:2]), key[:2], ["seq"], lambda x: entered(x, x[0]["entry"], key), f"conv_id {kind}, part long, seq long, entry long")
    pieces = written(with_pieces(pieces, entry, key), "conversation_pieces")
    if turns:
        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    found, edits = edits_of(row)
                    _, *path = edits.path(np.array([row["entry"]]))
                    yield turn_batch([row["conv_id"]], [found.lines(*path)], [(row["part"] << 32) + row["seq"]], batch.schema.field(0).type)

        return map_arrow(pieces, listed, turn_schema(kind))
    audits = with_pieces(read_out(pieces, kind), parts_.where("last").select("conv_id", "total"), ["conv_id"])
    total = {name: F.element_at("total", 17 + k) for k, name in enumerate(SUMMARY)}
    gap = F.when(total["turns"] > 0, total["high"] - total["low"] + 1 - total["turns"]).otherwise(0)
    cost = F.array_min(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda q: F.element_at("total", q) + F.element_at(F.array(*map(F.lit, END.tolist())), q)))
    return audits.select("conv_id", gap.alias("gaps"), *(total[k].alias(k) for k in ("blank", "duplicate", "truncated", "illegal")),
                         cost.alias("cost"), "audit", "repaired_sha256")


def edits_of(row: dict) -> tuple[Rows, Edits]:
    rows = Rows(row["roles"], row["texts"], [0, len(row["roles"])], set(row["again"] or ()))
    last = np.zeros(1 if row["last"] else 0, np.int64)
    return rows, Edits(rows.initial, rows.gone, rows.cut, rows.edges, np.array([row["end"]]), last)


def read_out(pieces: DataFrame, kind: str) -> DataFrame:
    """(conv_id, audit, repaired_sha256). Each piece's part of both is made on its own; since a hash of a whole text
    is made from its first byte to its last, one task then takes a conversation's pieces one after the other."""
    def piecewise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            audits, texts = [], []
            for row in batch.to_pylist():
                rows, edits = edits_of(row)
                _, edit, *rest = edits.path(np.array([row["entry"]]))
                audits.append(LETTERS[edit].tobytes().decode())
                texts.append(b"\n".join(r + b":" + t for r, t in rows.lines(edit, *rest)) if (edit != DELETE).any() else None)
            yield pa.record_batch([*batch.columns[:3], pa.array(audits, pa.string()), pa.array(texts, pa.binary())], names=["conv_id", "part", "seq", "audit", "text"])

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, started, audit, id_type = None, None, False, [], None

        def batch_of() -> pa.RecordBatch:
            return pa.record_batch([pa.array([held[0]], id_type), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for i, letters, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if held is None or held[0] != i:
                    if held is not None:
                        yield batch_of()
                    held, digest, started, audit = (i,), hashlib.sha256(), False, []
                audit.append(letters)
                if text.is_valid:
                    digest.update(b"\n" if started else b"")
                    digest.update(text.as_buffer())
                    started = True
        if held is not None:
            yield batch_of()

    each = map_arrow(pieces, piecewise, f"conv_id {kind}, part long, seq long, audit string, text binary")
    return map_arrow(each.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq"), along, f"conv_id {kind}, audit string, repaired_sha256 string")


# both ---------------------------------------------------------------------------------------------

def repair(rows: DataFrame, dropped: str | None = None, turns: bool = False, long: int = LONG, long_bytes: int = LONG_BYTES, piece: int = PIECE) -> DataFrame:
    """A report per ``conv_id`` of (conv_id, turn, role, text), or with ``turns`` the repaired rows.

    The report holds ``gaps`` in the turns, the rows whose first fault is ``blank``, ``duplicate`` or
    ``truncated``, ``illegal`` neighbours, the least ``cost``, the least ``audit`` of that cost and
    the hash of the repaired ``role:text`` lines. Repaired rows are (conv_id, part, place, role, text),
    ordered by part and place.

    Null ids are one conversation. A null role or text is one space; null turns come first and make
    no gap. Rows of one turn are taken by role, then by a hash of their text. Rows that the boolean
    column ``dropped`` marks only say that their conversation exists: one without any other has zeros, an
    empty audit and the hash of nothing. Other columns are ignored, repeated rows count as duplicates,
    an empty table gives no rows.
    """
    given = ordered(rows, dropped)
    size = given.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).where((F.col("n") > long) | (F.col("b") > long_bytes))
    far = written(size.select("conv_id"), "long_conversations")
    if far.isEmpty():
        return repaired_whole(given, turns)
    marked = with_pieces(given, far.withColumn("_long", F.lit(True)), ["conv_id"], "left")
    near, distant = marked.where("_long IS NULL").drop("_long"), marked.where("_long").drop("_long")
    return repaired_whole(near, turns).unionByName(repaired_long(distant, turns, piece))
