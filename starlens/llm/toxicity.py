"""Toxicity grades by cumulative-link ordinal regression over words.

P(grade >= k) = sigmoid(w . x - threshold k): one set of weights for all grades, ordered thresholds.
The expected severity is the sum of these probabilities.
"""

from __future__ import annotations

import regex as re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import SPACE, bound, map_arrow

#: Labelled rows to learn from, at most about, picked by a hash of their id; and words that get a weight.
SAMPLE, FEATURES = 20_000, 2000
#: A word must occur in so many labelled documents, and oftener or rarer in toxic ones by so many standard errors.
LEAST_DOCUMENTS, LEAST_Z = 5, 3.0
RIDGE, STEPS, RATE = 1e-3, 400, 0.1
#: What a share of false alarms weighs against the same share caught.
ALARM = 3.0
#: Beginnings of words of so many letters are features too, told from words by START.
BEGINNINGS, START = (5, 6, 7), "^"
WORD = re.compile(r"[\p{L}\p{M}]+")


@dataclass(frozen=True)
class Model:
    words: dict[str, int]  # and beginnings
    weights: np.ndarray
    thresholds: np.ndarray  # of grades 1 and up, ascending
    cut: float  # texts of this score and more are called toxic

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) per score and k from 1."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])

    def score(self, text: str) -> float:
        counts = features(text, self.words)
        return float(sum(self.weights[i] * x for i, x in counts))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def features(text: str, vocabulary: dict[str, int]) -> list[tuple[int, float]]:
    """Sparse features: log(1 + count) of the words and beginnings of words that have a weight.

    A longer beginning is in the vocabulary only with the shortest one.
    """
    found = []
    for w in WORD.findall(text.lower()):
        if w in vocabulary:
            found.append(vocabulary[w])
        if START + w[:BEGINNINGS[0]] in vocabulary:
            found += [vocabulary[b] for n in BEGINNINGS if len(w) >= n and (b := START + w[:n]) in vocabulary]
    return [(i, float(np.log1p(n))) for i, n in sorted(Counter(found).items())]


def _longer(n: int):
    return lambda w: F.length(w) >= n


def _beginning(n: int):
    return lambda w: F.concat(F.lit(START), F.left(w, F.lit(n)))


def severity(toxic: Column, quality: Column) -> Column:
    """The grade that labels tell: 0 not toxic, 1 toxic in an otherwise good text, 2 toxic in a bad one."""
    return F.when(toxic == 0, 0).when(quality == 0, 2).otherwise(1)


def train(docs: DataFrame, labels: DataFrame, grade: Column | None = None, grades: int = 3, sample: int = SAMPLE,
          id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Fits on a bounded sample of the labelled rows; a row without text or grade is left out.

    The sample's ids (at most about ``sample``) are broadcast to find its texts, so the documents
    aren't shuffled. Words are chosen by how much oftener they occur in graded documents than
    in the others; the sample's sparse features then come to the driver, bounded like the sample.
    """
    grade = severity(F.col("toxic"), F.col("quality")) if grade is None else grade
    graded = labels.select(F.col(id_column).alias("_id"), grade.cast("int").alias("_grade")).where("_grade is not null and _id is not null")
    n = graded.count()
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("_id")), F.lit(1 << 30)) / float(1 << 30)
    picked = graded.where(draw < sample / max(1, n)).groupBy("_id").agg(F.max("_grade").alias("_grade"))
    rows = docs.select(F.col(id_column).alias("_id"), F.lower(F.col(text_column).cast("string")).alias("_text")).join(F.broadcast(picked), "_id") \
        .where("_text is not null").select("_id", "_grade", "_text")
    # copies and near copies would make each of their words a mark of their grade: one of each stays
    words = F.split("_text", SPACE)
    shingles = bound(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 5))))
    rows = rows.groupBy("_grade", F.array_min(shingles).alias("_mark")).agg(F.min_by("_text", F.struct("_id", "_text")).alias("_text"))
    found = F.regexp_extract_all("_text", F.lit(r"[\p{L}\p{M}]+"), F.lit(0))
    begun = [F.transform(F.filter(found, _longer(n)), _beginning(n)) for n in BEGINNINGS]
    seen = rows.select((F.col("_grade") > 0).cast("int").alias("bad"), F.explode(F.array_distinct(F.concat(found, *begun))).alias("word"))
    per_word = seen.groupBy("word").agg(F.sum("bad").alias("a"), F.sum(1 - F.col("bad")).alias("b")).where(F.col("a") + F.col("b") >= LEAST_DOCUMENTS)
    both = rows.agg(F.sum((F.col("_grade") > 0).cast("int")).alias("a"), F.count("*").alias("n")).first()
    bad = both["a"] or 0
    good = (both["n"] or 0) - bad
    odds = F.ln((F.col("a") + 0.5) / (bad + 1.0)) - F.ln((F.col("b") + 0.5) / (good + 1.0))
    spread = F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    best = per_word.select("word", (odds / spread).alias("z")).where(F.abs("z") >= LEAST_Z).orderBy(F.abs("z").desc(), "word").limit(FEATURES).collect()
    chosen = dict.fromkeys(r["word"] for r in best)
    chosen.update(dict.fromkeys(w[:1 + BEGINNINGS[0]] for w in list(chosen) if w[0] == START))
    vocabulary = {w: i for i, w in enumerate(chosen)}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t, vocabulary) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32())), pa.array([[x for _, x in f] for f in found], pa.list_(pa.float64()))],
                                  names=["grade", "place", "value"])

    design = map_arrow(rows.select("_grade", "_text"), sparse, "grade int, place array<int>, value array<double>").toArrow()
    grade_of, place, value = (pa.concat_arrays(design[c].chunks or [pa.array([], design[c].type)]) for c in ("grade", "place", "value"))
    grade_of = grade_of.to_numpy().astype(np.int64)
    weights, thresholds = fit(grade_of, place, value, len(vocabulary), grades)
    score = np.bincount(_rows_of(place), weights=weights[place.flatten().to_numpy()] * value.flatten().to_numpy(), minlength=len(grade_of))
    return Model(vocabulary, weights, thresholds, best_cut(score, grade_of > 0, float(thresholds[0])))


def best_cut(score: np.ndarray, toxic: np.ndarray, otherwise: float) -> float:
    """The score that parts toxic from other texts best (share caught less ALARM times the share of false alarms); half way to the next lower one."""
    if toxic.all() or not toxic.any():
        return otherwise
    order = np.argsort(-score, kind="stable")
    caught, alarms = np.cumsum(toxic[order]) / toxic.sum(), np.cumsum(~toxic[order]) / (~toxic).sum()
    ends = np.append(score[order][1:] < score[order][:-1], True)  # equal scores fall on one side
    best = int(np.where(ends, caught - ALARM * alarms, -np.inf).argmax())
    low = score[order][min(best + 1, len(score) - 1)]
    return float((score[order][best] + low) / 2)


def _rows_of(place: pa.ListArray) -> np.ndarray:
    return np.repeat(np.arange(len(place)), np.diff(place.offsets.to_numpy()))


def fit(grade: np.ndarray, place: pa.ListArray, value: pa.ListArray, many: int, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Ridge-penalised likelihood by Adam; thresholds are a first one and positive steps, so they stay in order."""
    weights, steps = np.zeros(many), np.zeros(grades - 1)
    if not len(grade):
        return weights, np.arange(1.0, grades) * 10
    row = _rows_of(place)
    at, x = place.flatten().to_numpy(), value.flatten().to_numpy()
    above = np.array([(grade >= k).mean() for k in range(1, grades)])
    level = -np.log((above + 0.5 / len(grade)) / (1 - above + 0.5 / len(grade)))
    steps[0], steps[1:] = level[0], np.log(np.expm1(np.maximum(np.diff(level), 0.1)))
    both = np.concatenate([weights, steps])
    mean, square = np.zeros(len(both)), np.zeros(len(both))
    for t in range(1, STEPS + 1):
        weights, steps = both[:many], both[many:]
        thresholds = np.concatenate([steps[:1], steps[0] + np.cumsum(np.logaddexp(0, steps[1:]))])
        score = np.bincount(row, weights=weights[at] * x, minlength=len(grade))
        p = np.concatenate([np.ones((len(grade), 1)), _sigmoid(score[:, None] - thresholds), np.zeros((len(grade), 1))], axis=1)
        upper, lower = p[np.arange(len(grade)), grade], p[np.arange(len(grade)), grade + 1]
        own = np.maximum(upper - lower, 1e-12)
        up, down = upper * (1 - upper) / own, lower * (1 - lower) / own
        slope = (up - down) / len(grade)
        by = np.bincount(grade, weights=up, minlength=grades + 1)[1:grades] - np.bincount(grade + 1, weights=down, minlength=grades + 1)[1:grades]
        at_threshold = by / len(grade)
        tail = np.cumsum(at_threshold[::-1])[::-1]
        d_steps = np.concatenate([tail[:1], tail[1:] * _sigmoid(steps[1:])]) + RIDGE * 0.01 * steps
        gradient = np.concatenate([RIDGE * weights - np.bincount(at, weights=slope[row] * x, minlength=many), d_steps])
        mean, square = 0.9 * mean + 0.1 * gradient, 0.999 * square + 0.001 * gradient ** 2
        both = both - RATE * (mean / (1 - 0.9 ** t)) / (np.sqrt(square / (1 - 0.999 ** t)) + 1e-8)
    steps = both[many:]
    return both[:many], np.concatenate([steps[:1], steps[0] + np.cumsum(np.logaddexp(0, steps[1:]))])


def scored(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row the expected ``severity`` (0 to grades - 1), the likeliest ``grade``, ``p_toxic`` = P(grade >= 1) and ``toxic``: the score
    reaches the cut that parts the labelled texts best.

    The whole text counts; a null or empty one has no features. Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            score = np.array([model.score(t or "") for t in batch.column(1).to_pylist()], dtype=np.float64)
            above = model.at_least(score)
            each = np.diff(np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], axis=1), axis=1)
            yield pa.record_batch([batch.column(0), pa.array(above.sum(axis=1)), pa.array((-each).argmax(axis=1), pa.int32()), pa.array(above[:, 0]), pa.array(score >= model.cut)],
                                  names=["doc_id", "severity", "grade", "p_toxic", "toxic"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, severity double, grade int, p_toxic double, toxic boolean")
