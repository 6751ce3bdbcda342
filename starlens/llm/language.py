"""Language identification of words, spans and documents.

Script ranges say which languages can own a word. A hashed letter-trigram model, learned from
labelled documents, scores each word for these. Viterbi with a penalty for every switch turns word
scores into spans; the language with the most letters is the document's.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import map_arrow

#: Labelled documents per language to learn from, at most about; chosen by a hash of their id.
SAMPLE = 5000
BUCKET_BITS = 16
#: What a switch costs, in nats; and the part of a word's score that counts, since trigrams overlap.
SWITCH, TRUST = 6.0, 0.5
#: A script belongs to a language if it writes at least this share of its letters.
SCRIPT_SHARE = 0.02
UNKNOWN = "und"
#: Letters taken at a time.
CHUNK = 1 << 18

# Ranges of code points, in order, and the scripts they belong to.
SCRIPT_RANGES = [
    (0x0041, 0x024F, "Latin"), (0x0250, 0x02AF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"),
    (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0750, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"),
    (0x0E00, 0x0E7F, "Thai"), (0x0E80, 0x0EFF, "Lao"), (0x1000, 0x109F, "Myanmar"), (0x10A0, 0x10FF, "Georgian"),
    (0x1100, 0x11FF, "Hangul"), (0x1200, 0x137F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x1E00, 0x1EFF, "Latin"),
    (0x1F00, 0x1FFF, "Greek"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3400, 0x4DBF, "Han"),
    (0x4E00, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"), (0xF900, 0xFAFF, "Han"), (0x20000, 0x2FA1F, "Han"),
]
SCRIPTS = ["", *sorted({name for _, _, name in SCRIPT_RANGES})]


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its script (-1: no letter, 0: a letter of no listed script) and its lower case."""
    n = sys.maxunicode + 1
    letter = np.fromiter((chr(i).isalpha() for i in range(n)), dtype=bool, count=n)  # never all characters at a time
    script = np.where(letter, 0, -1).astype(np.int8)
    for low, high, name in SCRIPT_RANGES:
        script[low:high + 1][letter[low:high + 1]] = SCRIPTS.index(name)
    lower = np.arange(n, dtype=np.uint32)
    for i in np.flatnonzero(letter).tolist():
        if len(x := chr(i).lower()) == 1:
            lower[i] = ord(x)
    return script, lower


@dataclass(frozen=True)
class Words:
    """The words (runs of letters) of some texts, put together."""

    text: np.ndarray  # which text
    start: np.ndarray  # code points into it
    letters: np.ndarray
    script: np.ndarray  # of the first letter
    features: np.ndarray  # one trigram bucket per letter
    first: np.ndarray  # place of the first feature


def words(texts: list[str]) -> Words:
    script, lower = tables()
    # a zero in front of and behind every text parts words and marks their edges
    raw = "\0" + "\0".join(texts) + "\0"
    points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kind = script[points]
    here = kind >= 0
    folded = np.where(here, lower[points], 0).astype(np.uint32)
    hashed = np.zeros(len(points), dtype=np.uint32)
    hashed[1:-1] = folded[:-2] * np.uint32(0x9E3779B1) + folded[1:-1] * np.uint32(0x85EBCA77) + folded[2:] * np.uint32(0xC2B2AE3D)
    hashed = (hashed ^ (hashed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    place = np.flatnonzero(here)
    start = place[np.append(True, np.diff(place) > 1)] if len(place) else place
    first = np.flatnonzero(np.append(True, np.diff(place) > 1)) if len(place) else place
    edges = np.cumsum([1] + [len(t) + 1 for t in texts])
    text = np.searchsorted(edges, start, side="right") - 1
    return Words(text, start - edges[text], np.diff(np.append(first, len(place))), kind[start],
                 (hashed[place] >> np.uint32(32 - BUCKET_BITS)).astype(np.int64), first)


@dataclass(frozen=True)
class Model:
    """Log probabilities (languages x buckets), and which script each language is written in."""

    languages: tuple[str, ...]
    table: np.ndarray
    scripts: np.ndarray

    def scores(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Per word and language the score, and whether the word's script leaves it in."""
        rows = self.table[w.features]
        out = np.add.reduceat(rows, w.first, axis=0) * TRUST if len(w.first) else np.zeros((0, len(self.languages)))
        can = self.scripts[w.script]
        # a word that no language can own tells nothing
        return np.where(can.any(axis=1)[:, None], np.where(can, out, out.min(axis=1, initial=0)[:, None] - 50), 0.0), can


def held_out(id_column: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", sample: int = SAMPLE) -> Model:
    """Learns from rows that are not held out and have a text and a language.

    About ``sample`` of each language, picked by a hash of the id; one count per language and
    bucket or script comes back. Without such rows the model knows no language.
    """
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).alias("id"), text.alias("text"), F.col(lang_column).cast("string").alias("lang")) \
        .where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")))
    share = {r["lang"]: sample / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(share))
    if not languages:
        return Model((), np.zeros((1 << BUCKET_BITS, 0), np.float32), np.zeros((len(SCRIPTS), 0), bool))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(draw < F.coalesce(*[F.when(F.col("lang") == x, float(s)) for x, s in share.items()]))
    size = 1 << BUCKET_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), size + len(SCRIPTS)), dtype=np.int64)
        for batch in batches:
            number = np.array([languages.index(x) for x in batch.column(1).to_pylist()])
            for begin, w in _chunks(batch.column(0).to_pylist()):
                lang = number[begin + w.text]
                np.add.at(total, (np.repeat(lang, w.letters), w.features), 1)
                np.add.at(total, (lang, size + w.script.astype(np.int64)), w.letters)
        lang, slot = np.nonzero(total)
        yield pa.record_batch([pa.array(lang, pa.int32()), pa.array(slot, pa.int32()), pa.array(total[lang, slot], pa.int64())], names=["lang", "slot", "n"])

    counted = map_arrow(chosen.select("text", "lang"), count, "lang int, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((len(languages), size + len(SCRIPTS)))
    total[counted["lang"].to_numpy(), counted["slot"].to_numpy()] = counted["n"].to_numpy()
    grams, by_script = total[:, :size] + 0.5, total[:, size:]
    table = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    scripts = (by_script > SCRIPT_SHARE * by_script.sum(axis=1, keepdims=True)).T
    return Model(languages, np.ascontiguousarray(table), scripts)


def _chunks(texts: list[str]) -> Iterator[tuple[int, Words]]:
    begin = 0
    while begin < len(texts):
        end, n = begin, 0
        while end < len(texts) and (end == begin or n + len(texts[end]) <= CHUNK):
            n += len(texts[end])
            end += 1
        yield begin, words(texts[begin:end])
        begin = end


def viterbi(scores: np.ndarray, switch: float) -> np.ndarray:
    """The best labelling of words by languages, each switch costing ``switch``."""
    n, many = scores.shape
    back = np.zeros((n, many), dtype=np.int32)
    best = scores[0].copy()
    for t in range(1, n):
        top = int(best.argmax())
        stay = best >= best[top] - switch
        back[t] = np.where(stay, np.arange(many), top)
        best = np.where(stay, best, best[top] - switch) + scores[t]
    out = np.zeros(n, dtype=np.int64)
    out[-1] = best.argmax()
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def labelled(scores: np.ndarray, text: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi labels of the words of several texts.

    Where no stretch of words gains more than ``switch`` by leaving the text's best single language,
    that language is the best labelling; only the other texts need the recursion.
    """
    if not len(text):
        return np.zeros(0, dtype=np.int64)
    first = np.flatnonzero(np.append(True, np.diff(text) > 0))
    size = np.diff(np.append(first, len(text)))
    one = np.add.reduceat(scores, first, axis=0).argmax(axis=1)
    out = np.repeat(one, size)
    if scores.shape[1] < 2:
        return out
    own = scores[np.arange(len(out)), out]
    rest = scores.copy()
    rest[np.arange(len(out)), out] = -np.inf
    gain = rest.max(axis=1) - own
    # best stretch: running sum less its least value before, within a text
    run = np.cumsum(gain)
    at = np.repeat(np.arange(len(first)), size)
    base = (run - gain)[first]
    inside = run - base[at]
    before = np.append(0.0, inside[:-1])
    before[first] = 0.0
    far = 2 * np.abs(inside).max() + 1
    least = np.minimum.accumulate(before - far * at) + far * at
    for k in np.flatnonzero(np.maximum.reduceat(inside - least, first) > switch - 1e-6):
        a, b = first[k], first[k] + size[k]
        out[a:b] = viterbi(scores[a:b], switch)
    return out


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<lang: string, start: int, end: int>>"


def predicted(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row ``lang_pred``, ``score`` (the share of letters in its spans, in a script it is written in) and the spans.

    Spans are in code points of the whole text. ``und``, score 0 and no span for a null text, a text
    without letters, or a model without languages. Only the text enters the prediction.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # languages x 65,536 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        many = len(model.languages)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            lang, score, spans = [UNKNOWN] * len(texts), np.zeros(len(texts)), [[] for _ in texts]
            for begin, w in _chunks(texts) if many else ():
                if not len(w.text):
                    continue
                scores, can = model.scores(w)
                label = labelled(scores, w.text)
                sure = can[np.arange(len(label)), label]
                letters = np.zeros((int(w.text[-1]) + 1, many + 1))
                np.add.at(letters, (w.text, np.where(sure, label, many)), w.letters)
                whole = np.zeros((len(letters), many))
                np.add.at(whole, (w.text, label), w.letters)
                cut = np.flatnonzero(np.append(True, (np.diff(w.text) > 0) | (np.diff(label) != 0)))
                ends = np.append(cut[1:], len(label)) - 1
                for k in np.unique(w.text):
                    top = int((letters[k, :many] + 1e-6 * whole[k]).argmax())
                    lang[begin + k] = model.languages[top]
                    score[begin + k] = letters[k, top] / letters[k].sum()
                for t, l, a, b in zip(w.text[cut].tolist(), label[cut].tolist(), w.start[cut].tolist(), (w.start[ends] + w.letters[ends]).tolist(), strict=True):
                    spans[begin + t].append({"lang": model.languages[l], "start": a, "end": b})
            kind = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lang), pa.array(score), pa.array(spans, kind)],
                                  names=["doc_id", "held_out", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), held_out(F.col(id_column)).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(rows, run, SCHEMA)


def recognised(docs: DataFrame, model: Model, least: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of whose letters recognised languages together own at least ``least``; all columns stay.

    Rows without letters go. A model without languages can't reject any other row.

    The verdict is made in the row itself by an Arrow function, so no row is joined back.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)
    place = docs.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        many = len(model.languages)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            keep = np.zeros(len(texts), dtype=bool)
            for begin, w in _chunks(texts):
                if not len(w.text):
                    continue
                if not many:
                    keep[begin + np.unique(w.text)] = True
                    continue
                scores, can = model.scores(w)
                label = labelled(scores, w.text)
                letters = np.zeros((int(w.text[-1]) + 1, many + 1))
                np.add.at(letters, (w.text, np.where(can[np.arange(len(label)), label], label, many)), w.letters)
                keep[begin:begin + len(letters)] = letters[:, :many].sum(axis=1) >= least * np.maximum(letters.sum(axis=1), 1)
            yield batch.filter(pa.array(keep))

    return map_arrow(docs, run, docs.schema)
