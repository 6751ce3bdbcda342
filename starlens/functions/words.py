"""Words of batches of texts, by numpy and Arrow inside tasks; Spark adds the batches up."""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are cut into words at a time (a longer text alone).
SLICE_BYTES = 8 << 20
#: Bytes of counts that a task adds up before it sends them on.
HELD_BYTES = 128 << 20


def slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of rows with about ``size`` bytes of text."""
    total = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        before = total[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(total, before + size, side="right")))
        yield begin, end
        begin = end


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts (null: empty) with a space after each, and where each begins and the last one ends."""
    empty, space = (pa.scalar(s, pa.large_string()) for s in ("", " "))
    texts = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), empty), empty, space)
    raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return raw[edges[0]:edges[-1]], edges - edges[0]


def letters(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are letters a-z, where the runs of them begin and how long they are; the last byte is no letter."""
    letter = (raw - np.uint8(ord("a"))) < 26  # wraps around below a
    turns = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    if len(letter) and letter[0]:
        turns = np.append(0, turns)
    return letter, turns[::2], turns[1::2] - turns[::2]  # the last byte is a space, so turns come in pairs


def letter_runs(raw: np.ndarray, least: int) -> tuple[np.ndarray, pa.Array]:
    """Where the runs of ``least`` and more letters a-z begin, and the runs; the last byte is no letter."""
    letter, begin, size = letters(raw)
    if least > 1:
        short = size < least
        at, many = begin[short], size[short]
        for k in range(least - 1):
            letter[at[many > k] + k] = False
        begin, size = begin[~short], size[~short]
    return begin, strings(raw[letter], size)


def strings(raw: np.ndarray, size: np.ndarray) -> pa.Array:
    """Strings of ``size`` bytes that follow each other in ``raw``."""
    offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


def counted(texts: pa.Array, groups: np.ndarray, least: int, stop_words: Collection[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(group, word, count) of the runs of ``least`` and more letters a-z in lower-cased texts; ``groups`` has a number per text."""
    raw, edges = raw_bytes(texts)
    begin, words = letter_runs(raw, least)
    coded = words.dictionary_encode()
    n = max(len(coded.dictionary), 1)
    # words per text from the places of the texts' ends
    pair = np.repeat(groups * n, np.diff(np.searchsorted(begin, edges))) + coded.indices.to_numpy(zero_copy_only=False)
    if (int(groups.max(initial=0)) + 1) * n <= 4 * len(pair):
        counts = np.bincount(pair)
        pairs = np.flatnonzero(counts)
        counts = counts[pairs]
    else:
        pairs, counts = np.unique(pair, return_counts=True)
    kept = ~pc.is_in(coded.dictionary, value_set=pa.array(list(stop_words), pa.large_string())).to_numpy(zero_copy_only=False)
    if len(kept):
        keep = kept[pairs % n]
        pairs, counts = pairs[keep], counts[keep]
    return pairs // n, coded.dictionary.take(pa.array(pairs % n)).cast(pa.string()), counts


#: White space of two and three bytes in UTF-8.
BLANK_2 = [int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0)]
BLANK_3 = [int.from_bytes(chr(c).encode()) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words between white space of each text; 0 for null."""
    out = [np.zeros(0, np.int32)]
    for begin, end in slices(texts):
        raw, edges = raw_bytes(texts.slice(begin, end - begin))
        # Unicode's white space of one byte and the four separator controls; differences wrap around
        blank = ((raw - np.uint8(0x09)) < 5) | ((raw - np.uint8(0x1C)) < 5)
        leads = np.flatnonzero((raw == 0xC2) | ((raw - np.uint8(0xE1)) < 3))
        if len(leads):
            after = np.append(raw, [0, 0])
            two = after[leads].astype(np.uint32) << 8 | after[leads + 1]
            three = two << 8 | after[leads + 2]
            for found, size in ((leads[np.isin(two, BLANK_2)], 2), (leads[np.isin(three, BLANK_3)], 3)):
                for k in range(size):
                    blank[found + k] = True
        begins = np.flatnonzero(np.append(True, blank[:-1]) > blank)
        out.append(np.diff(np.searchsorted(begins, edges)).astype(np.int32))
    return np.concatenate(out)


#: Longer words are told apart by their letters only.
LONG = 20


def mean_scores(texts: pa.Array, values: Mapping[str, float], factors: Mapping[str, float]) -> np.ndarray:
    """Of each lower-cased text the mean score of its words in ``values``, in [-1, 1], each times the factor of the
    run of letters just before it; 0.0 if it has none."""
    names = [w for w in dict.fromkeys([*values, *factors]) if w.isascii() and w.isalpha() and w.islower()]
    known = pa.array(names, pa.large_string())
    # most runs are set aside by their length, first and last letter
    likely = np.zeros((LONG + 1, 26, 26), dtype=bool)
    for w in names:
        likely[min(len(w), LONG), ord(w[0]) - ord("a"), ord(w[-1]) - ord("a")] = True
    # the last place stands for any other word
    scored = np.array([w in values for w in names] + [False])
    value = np.array([values.get(w, 0.0) for w in names] + [0.0])
    factor = np.array([factors.get(w, 1.0) for w in names] + [1.0])
    out = [np.zeros(0)]
    for start, stop in slices(texts):
        raw, edges = raw_bytes(texts.slice(start, stop - start))
        _, begin, size = letters(raw)
        place = np.minimum(size, LONG) * 676 + (raw[begin] - np.uint8(ord("a"))) * np.int64(26) + (raw[begin + size - 1] - np.uint8(ord("a")))
        some = np.flatnonzero(likely.ravel()[place])
        ends = np.cumsum(size[some])
        words = strings(raw[np.repeat(begin[some] - ends + size[some], size[some]) + np.arange(size[some].sum())], size[some])
        code = np.full(len(begin), len(names), dtype=np.int32)
        code[some] = pc.fill_null(pc.index_in(words, value_set=known), len(names)).to_numpy(zero_copy_only=False)
        hits = some[scored[code[some]]]
        text = np.searchsorted(edges, begin[hits], side="right") - 1
        follows = (hits > 0) & (begin[hits - 1] >= edges[text])
        score = value[code[hits]] * np.where(follows, factor[code[hits - 1]], 1.0)
        many = np.bincount(text, minlength=len(edges) - 1)
        total = np.bincount(text, weights=score, minlength=len(edges) - 1)  # adds up in the words' order
        out.append(np.where(many > 0, np.clip(total / np.maximum(many, 1), -1.0, 1.0), 0.0))
    return np.concatenate(out)


def grouped(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """A number per row for its values in ``columns`` (null is a value), and a row of each number."""
    number = np.zeros(len(columns[0]), dtype=np.int64)
    for column in columns:
        coded = column.dictionary_encode(null_encoding="encode")
        # numbers stay below the rows' count, so products never overflow
        number = np.unique(number * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    return number, np.unique(number, return_index=True)[1]


def batch_counts(batch: pa.RecordBatch, keys: list[str], text: str, least: int, stop_words: Collection[str]) -> Iterator[pa.RecordBatch]:
    """(keys, word, n) of a batch with lower-cased texts, a record batch per slice of them."""
    for begin, end in slices(batch.column(text)):
        part = batch.slice(begin, end - begin)
        number, rows = grouped([part.column(k) for k in keys])
        group, word, n = counted(part.column(text), number, least, stop_words)
        at = pa.array(rows[group])
        yield pa.record_batch({**{k: part.column(k).take(at) for k in keys}, "word": word, "n": pa.array(n, pa.int64())})


def added_up(parts: Iterable[pa.RecordBatch], count: str = "n", held_bytes: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    """``parts`` with rows that agree in all but ``count`` added up, as many at a time as ``held_bytes`` allow."""
    held, size = [], 0

    def summed() -> list[pa.RecordBatch]:
        names = held[0].schema.names
        keys = [k for k in names if k != count]
        table = pa.Table.from_batches(held).group_by(keys, use_threads=False).aggregate([(count, "sum")])
        columns = {k: table[f"{count}_sum" if k == count else k] for k in names}
        return pa.table(columns).cast(held[0].schema).to_batches()

    for part in parts:
        held.append(part)
        size += part.nbytes
        if size >= held_bytes:
            held = summed()
            size = sum(x.nbytes for x in held)
            if size > held_bytes // 2:
                yield from held
                held, size = [], 0
    if held:
        yield from summed()
