"""Periodic runs of words, found in the texts' grammars.

A run is a stretch of words with a smallest period q and a length of at least max(LEAST, 2 q) that
can't be extended. Of its pairs of words q apart, six and more in a row are equal, so a text without
a repeated string of six words has none; this cheap and exact test lets most texts pass.

The others are put together by Re-Pair: rounds replace pairs of symbols that occur twice and more
in a text by nonterminals, the most frequent of neighbouring pairs first, until no pair is left. The
rest of a text is the leaves of a balanced tree. So every place between two words of a text belongs
to one boundary of a nonterminal or of the tree, and every run lies whole in the least node that
holds it and crosses that node's boundary. At each boundary, once per nonterminal, the periods for
which six words around it recur are extended both ways by doubled hashes; the runs found go to all
places that derive the nonterminal, and intervals of one period that meet are merged.

A text is one task's work at most; texts are taken some SLICE words at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import map_arrow, mixed

LEAST = 12
#: Equal pairs of words in a row that a run has at least: length - q, and length is max(LEAST, 2 q).
GRAM = LEAST // 2
SLICE = 200_000
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes."""
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def doubled(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the strings of 1, 2, 4, ... words from each place, up to ``longest`` words."""
    out = [mixed(words.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))]
    while 2 << (len(out) - 1) <= longest:
        half, step = out[-1], 1 << (len(out) - 1)
        if step >= len(half):
            break
        out.append(np.concatenate([combined(half[:-step], half[step:]), half[-step:]]))  # the end's are never asked for
    return out


def grams(hashes: list[np.ndarray]) -> np.ndarray:
    """Hashes of the GRAM words from each place where that many are left."""
    n = len(hashes[0]) - GRAM + 1
    two, four = hashes[1], hashes[2]
    return combined(four[:n], two[4:4 + n])


def common(hashes: list[np.ndarray], i: np.ndarray, j: np.ndarray, limit: np.ndarray, back: bool = False) -> np.ndarray:
    """The number of equal words from places i and j on (or back, both included), ``limit`` at most."""
    found = np.zeros(len(i), np.int64)
    for k in range(len(hashes) - 1, -1, -1):
        size = 1 << k
        for _ in range(2 if k == len(hashes) - 1 else 1):
            can = np.flatnonzero(found + size <= limit)
            a, b = (x[can] + (1 - size - found[can] if back else found[can]) for x in (i, j))
            found[can[hashes[k][a] == hashes[k][b]]] += size
    return found


class Grammar:
    """Re-Pair of texts put one after the other; no two texts share a symbol, so none shares a pair."""

    def __init__(self, symbols: np.ndarray):
        terminals = int(symbols.max()) + 1
        self.left, self.right, self.size, self.first, self.rounds = [], [], [np.ones(terminals, np.int64)], [], [terminals]
        s, place, size = symbols, np.arange(len(symbols)), self.size[0]
        while len(s) > 1:
            number, pair, where = self.chosen(s, self.rounds[-1])
            if not number:
                break
            total = self.rounds[-1]
            firsts = np.zeros(number, np.int64)
            firsts[pair[::-1]] = where[::-1]  # the first place of each
            a, b = s[firsts], s[firsts + 1]
            self.left.append(a)
            self.right.append(b)
            self.first.append(place[firsts])
            self.size.append(size[a] + size[b])
            size = np.concatenate([size, self.size[-1]])
            self.rounds.append(total + number)
            s = s.copy()
            s[where] = total + pair
            keep = np.ones(len(s), bool)
            keep[where + 1] = False
            s, place = s[keep], place[keep]
        none = [np.zeros(0, np.int64)]
        self.sequence, self.place, self.size, self.terminals = s, place, size, terminals
        self.left, self.right, self.first = (np.concatenate(x or none) for x in (self.left, self.right, self.first))

    @staticmethod
    def chosen(s: np.ndarray, total: int) -> tuple[int, np.ndarray, np.ndarray]:
        """Places of pairs to replace, that don't overlap, and the pairs' numbers from 0; each pair has two places and more."""
        key, pair = np.unique(s[:-1] * total + s[1:], return_inverse=True)
        here = np.arange(len(pair))
        start = np.maximum.accumulate(np.where(np.concatenate([[True], pair[1:] != pair[:-1]]), here, 0))
        even = (here - start) % 2 == 0  # of a a a a, every second pair
        count = np.bincount(pair[even], minlength=len(key))
        width = max(len(key) - 1, 1).bit_length()
        rank = (count << width) | (np.arange(len(key)) * 0x9E3779B1 & ((1 << width) - 1))  # ties in no order of the text
        mine = np.where(count[pair] > 1, rank[pair], -1)
        around = np.concatenate([[-1], mine, [-1]])
        take = (mine >= 0) & even & (mine >= around[:-2]) & (mine >= around[2:])
        often = np.bincount(pair[take], minlength=len(key)) > 1
        where = np.flatnonzero(take & often[pair])
        number = np.cumsum(often) - 1
        return int(often.sum()), number[pair[where]], where

    def boundaries(self, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nonterminal or -1, first word, first word behind the boundary, end) of every node."""
        own = np.arange(len(self.left))
        at = self.first + self.size[self.left]
        text = text_of[self.place]
        opens = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        stops = np.append(opens[1:], len(text))
        run = np.repeat(np.arange(len(opens)), stops - opens)
        j = np.arange(len(text)) - opens[run]
        inner = np.flatnonzero(j)
        j, run = j[inner], run[inner]
        half = j & -j  # the node of this boundary has so many leaves on its left
        low, high = inner - half, np.minimum(inner + half, stops[run])
        beyond = self.place + self.size[self.sequence]
        return (np.concatenate([own, np.full(len(inner), -1)]), np.concatenate([self.first, self.place[low]]),
                np.concatenate([at, self.place[inner]]), np.concatenate([self.first + self.size[self.terminals:], beyond[high - 1]]))

    def derived(self, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(nonterminal, place) wherever one of the ``wanted`` (a flag for each) is derived."""
        deep = np.concatenate([np.zeros(self.terminals, bool), wanted])
        for a, b in zip(self.rounds[:-1], self.rounds[1:], strict=True):
            own = slice(a - self.terminals, b - self.terminals)
            deep[a:b] |= deep[self.left[own]] | deep[self.right[own]]
        symbol, place = self.sequence, self.place
        while True:
            go = deep[symbol]
            symbol, place = symbol[go] - self.terminals, place[go]
            if not len(symbol):
                return
            here = wanted[symbol]
            yield symbol[here], place[here]
            left, right = self.left[symbol], self.right[symbol]
            symbol, place = np.concatenate([left, right]), np.concatenate([place, place + self.size[left]])


def expanded(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) for all places of the ranges."""
    count = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + low[which]


def crossing(grammar: Grammar, hashes: list[np.ndarray], gram: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, ...]:
    """(nonterminal or -1, start, end, period) of the runs that cross the nodes' boundaries, within each node."""
    node, lo, m, hi = grammar.boundaries(text_of)
    large = hi - lo >= LEAST
    node, lo, m, hi = node[large], lo[large], m[large], hi[large]
    order = np.argsort(gram, kind="stable")
    new = np.concatenate([[True], gram[order[1:]] != gram[order[:-1]]])
    group = np.empty(len(gram), np.int64)
    group[order] = np.cumsum(new) - 1
    several = np.bincount(group)[group] > 1
    n = len(text_of) + 1
    key = group[order] * n + order
    found = [[np.zeros(0, np.int64)] for _ in range(4)]
    for ahead in (False, True):
        b, p = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(GRAM):
            at = m - 1 - k if ahead else m - k  # six words from here recur at the period's distance
            ok = np.flatnonzero((at >= lo) & (at + GRAM <= hi))
            ok = ok[several[at[ok]]]
            at = at[ok]
            if ahead:
                low, high = np.searchsorted(key, group[at] * n + at, "right"), np.searchsorted(key, group[at] * n + hi[ok] - GRAM, "right")
            else:
                low, high = np.searchsorted(key, group[at] * n + lo[ok]), np.searchsorted(key, group[at] * n + at)
            which, place = expanded(low, high)
            b.append(ok[which])
            p.append(np.abs(order[place] - at[which]))
        both = np.unique(np.concatenate(b) * n + np.concatenate(p))
        b, p = both // n, both % n
        if ahead:  # the words before the boundary and a period later
            fit = m[b] + p < hi[b]
            b, p = b[fit], p[fit]
            before = common(hashes, m[b] - 1, m[b] - 1 + p, m[b] - lo[b], back=True)
            after = common(hashes, m[b], m[b] + p, hi[b] - m[b] - p)
            start, end, cross = m[b] - before, m[b] + p + after, before > 0
        else:  # the words behind the boundary and a period earlier
            fit = m[b] - p >= lo[b]
            b, p = b[fit], p[fit]
            before = common(hashes, m[b] - p - 1, m[b] - 1, m[b] - p - lo[b], back=True)
            after = common(hashes, m[b] - p, m[b], hi[b] - m[b])
            start, end, cross = m[b] - p - before, m[b] + after, after > 0
        keep = cross & (end - start >= np.maximum(LEAST, 2 * p))
        for column, values in zip(found, (node[b], start, end, p), strict=True):
            column.append(values[keep])
    return tuple(np.concatenate(c) for c in found)


def merged(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of one period that share a period's words and more become one; of equal ones the least period stays."""
    if not len(start):
        return start, end, period
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    offset = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]])) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + offset) - offset
    new = np.concatenate([[True], (period[1:] != period[:-1]) | (start[1:] > reach[:-1] - period[:-1])])
    opens = np.flatnonzero(new)
    start, end, period = start[opens], reach[np.append(opens[1:], len(reach)) - 1], period[opens]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
    return start[first], end[first], period[first]


def found_runs(codes: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of texts put one after the other, ordered by start, then period."""
    none = (np.zeros(0, np.int64),) * 3
    if len(codes) < LEAST:
        return none
    hashes = doubled(codes, GRAM)
    gram = combined(grams(hashes), text_of[:len(codes) - GRAM + 1].astype(np.uint64))
    order = np.argsort(gram)
    twice = np.flatnonzero(gram[order[1:]] == gram[order[:-1]]) + 1
    marked = np.zeros(int(text_of[-1]) + 1, bool)
    marked[text_of[order[twice]]] = True
    keep = np.flatnonzero(marked[text_of])
    if len(keep) < LEAST:
        return none
    codes, texts = codes[keep], text_of[keep]
    symbols = np.unique(texts * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
    grammar = Grammar(symbols)
    hashes = doubled(codes, int(np.bincount(texts).max()))
    node, start, end, period = crossing(grammar, hashes, combined(grams(hashes), texts[:len(codes) - GRAM + 1].astype(np.uint64)), texts)
    own = np.flatnonzero(node >= 0)
    own = own[np.argsort(node[own], kind="stable")]
    parts = [(start[node < 0], end[node < 0], period[node < 0])]
    if len(own):
        edges = np.searchsorted(node[own], np.arange(len(grammar.left) + 1))
        wanted = edges[1:] > edges[:-1]
        for symbol, place in grammar.derived(wanted):
            which, k = expanded(edges[symbol], edges[symbol + 1])
            shift = place[which] - grammar.first[symbol[which]]
            parts.append((start[own[k]] + shift, end[own[k]] + shift, period[own[k]]))
    start, end, period = merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))
    length = end - start  # words of texts that were left out lie between texts only
    return keep[start], keep[start] + length, period


def planted_words(n: int, doc_id: int) -> np.ndarray | None:
    """Which original word each word becomes, for the test relation's planted repeats."""
    h = crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def slice_batch(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
    sizes = np.array([len(x) for x in texts])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    table: dict[bytes, int] = {}
    codes = np.fromiter((table.setdefault(w, len(table)) for w in chain.from_iterable(texts)), np.int64, int(edges[-1]))
    start, end, period = found_runs(codes, np.repeat(np.arange(len(texts)), sizes))
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change[:-1]) > 0
    cuts = np.searchsorted(start, edges)
    collapsed = []
    for k, words in enumerate(texts):
        if cuts[k + 1] > cuts[k]:
            words = [words[i] for i in np.flatnonzero(~gone[edges[k]:edges[k + 1]]).tolist()]
        collapsed.append(b" ".join(words))
    base = np.repeat(edges[:-1], np.diff(cuts))
    items = pa.StructArray.from_arrays([pa.array(start - base), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
    return pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), items),
                            pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])


def runs(docs: DataFrame, planted: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed, longest) per row.

    ``runs`` are (start, length, period) in words from 0, by start, then period; ``longest`` is the one
    of the greatest length, then the least start and period (null without runs). ``collapsed`` is the
    text without the words that a run holds behind its first period, one blank between words. Null texts
    have no words; repeated rows, ties and null ids are rows like others; other columns are ignored.
    With ``planted``, every tenth id's text is first made to repeat itself (not those of null ids).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, total = [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                if planted and i is not None and (order := planted_words(len(words), i)) is not None:
                    words = [words[k] for k in order.tolist()]
                ids.append(i)
                texts.append(words)
                total += len(words)
                if total >= SLICE:
                    yield slice_batch(ids, texts)
                    ids, texts, total = [], [], 0
            if ids:
                yield slice_batch(ids, texts)

    found = map_arrow(docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")), run, SCHEMA)
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("longest", F.when(first.isNotNull(), F.struct(first["start"].alias("start"), (-first["length"]).alias("length"), first["period"].alias("period"))))
