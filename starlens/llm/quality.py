"""Quality rules by weak supervision, in DataFrame functions only.

Each rule looks at counts of one text and votes good (1) or bad (-1), or abstains (0). Expectation
maximisation estimates the share of good texts and, for each rule, how often it is right on good
texts and on bad ones: bad texts mostly break one rule or two and please the others, so one figure
for both would count every bad vote as a mistake. The posterior probability of being good decides,
not the agreement of all rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starlens.llm.common import SPACE, bound, written
from starlens.session import checkpointed

WINDOW = 8
ITERATIONS = 25
#: Start values: the share of good texts, and how often a rule is right on good and on bad ones.
FIRST_PRIOR, FIRST_GOOD, FIRST_BAD = 0.8, 0.99, 0.5
#: Beta priors (mean, weight in parts of the rows) of the share of good texts and of being right on good and on bad
#: ones. Rules are set so that few good texts break one: without such a belief a kind of bad text that breaks one rule
#: only looks like that rule's mistakes. Weights grow with the table, so estimates are alike at every size.
SHARE_BELIEF, GOOD_BELIEF, BAD_BELIEF = (0.9, 0.1), (0.995, 1.0), (0.2, 0.01)


@dataclass(frozen=True)
class Rule:
    """Votes bad where ``bad`` holds, else good where ``good`` holds; SQL over the counts, in ANSI."""

    name: str
    bad: str
    good: str


RULES = [
    Rule("length", "n_words < 30", "n_words >= 60"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    Rule("symbols", "20 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    Rule("duplicate_lines", "5 * n_dup_lines > n_lines", "n_dup_lines = 0 AND n_lines >= 3"),
    Rule("repeated_words", "100 * n_repeat_words > 15 * n_words", "100 * n_repeat_words <= 3 * n_words"),
    Rule("capitals", "5 * n_upper > word_chars", "12 * n_upper <= word_chars"),
    Rule("sentence_ends", "2 * n_ends > n_words", "100 * n_ends >= n_words AND 4 * n_ends <= n_words"),
]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that occur twice or more in ``words``.

    Windows are told apart by XXH64 of their words; a text of a million words mixes two up with a
    probability below 1e-7.
    """
    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(p: Column) -> Column:
            return F.filter(p, lambda x, j: (F.get(p, j - 1)["h"] == x["h"]) | F.coalesce(F.get(p, j + 1)["h"] == x["h"], F.lit(False)))

        starts = F.sort_array(F.transform(bound(pairs, twice), lambda x: x["i"]))
        # each start adds the words up to the next start, at most a window
        steps = bound(starts, lambda s: F.transform(s, lambda v, j: F.least(F.lit(window), F.coalesce(F.get(s, j + 1), v + window) - v)))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def counted(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - window + 1), lambda i: F.xxhash64(F.slice(w, i, window)))
        some = bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(0))
        return F.when(F.size(w) > window, some).otherwise(0)

    return bound(words, counted)


def counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The counts that the rules read, of every whole text (null: none). Other columns are ignored."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = F.array_remove(F.split(text, SPACE), "")
    return docs.select(
        F.col(id_column).alias("doc_id"),
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words).cast("long").alias("n_repeat_words"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("[.!?]")).cast("long").alias("n_ends"))


def votes(rule: Rule) -> Column:
    return F.when(F.expr(rule.bad), -1).when(F.expr(rule.good), 1).otherwise(0).cast("int")


def posterior(names: list[str], prior: float, good: dict[str, float], bad: dict[str, float]) -> Column:
    """Probability of good, given the votes; rules count as independent, abstaining as uninformative.

    A sum of log odds, looked up in one array by rule and vote: the plan's code stays the same from
    round to round, so Spark compiles it once.
    """
    odds = []
    for r in names:
        odds += [math.log((1 - good[r]) / bad[r]), 0.0, math.log(good[r] / (1 - bad[r]))]
    first = math.log(prior / (1 - prior))
    odds[:3] = [x + first for x in odds[:3]]
    table = F.array(*[F.lit(x) for x in odds])
    score = reduce(lambda a, b: a + b, [F.get(table, F.col(r) + (3 * j + 1)) for j, r in enumerate(names)])
    return 1 / (1 + F.exp(-score))


def believed(hits: float, tries: float, rows: int, belief: tuple[float, float]) -> float:
    """A share seen in the votes, drawn towards its prior's mean."""
    mean, weight = belief
    return (hits + weight * rows * mean) / (tries + weight * rows)


def learn(voted: DataFrame, names: list[str], iterations: int = ITERATIONS) -> tuple[float, dict[str, float], dict[str, float]]:
    """Prior and accuracies by expectation maximisation over the vote patterns.

    There are at most 3 ** rules patterns, whatever the input; a round is one small aggregation
    over them, and only the estimates come back: the likeliest ones, given votes and priors.
    No rows leave the start values.
    """
    patterns = checkpointed(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1))
    prior, good, bad = FIRST_PRIOR, dict.fromkeys(names, FIRST_GOOD), dict.fromkeys(names, FIRST_BAD)
    p = F.col("p") * F.col("n")
    q = (1 - F.col("p")) * F.col("n")
    sums = [F.sum("n").alias("n"), F.sum(p).alias("p")]
    for r in names:
        v = F.col(r)
        sums += [F.sum(F.when(v == 1, p).otherwise(0.0)).alias(f"good_{r}"), F.sum(F.abs(v) * p).alias(f"all_good_{r}"),
                 F.sum(F.when(v == -1, q).otherwise(0.0)).alias(f"bad_{r}"), F.sum(F.abs(v) * q).alias(f"all_bad_{r}")]
    for _ in range(iterations):
        row = patterns.withColumn("p", posterior(names, prior, good, bad)).agg(*sums).first()
        if not row["n"]:
            break
        prior = believed(row["p"], row["n"], row["n"], SHARE_BELIEF)
        good = {r: believed(row[f"good_{r}"], row[f"all_good_{r}"], row["n"], GOOD_BELIEF) for r in names}
        bad = {r: believed(row[f"bad_{r}"], row[f"all_bad_{r}"], row["n"], BAD_BELIEF) for r in names}
    return prior, good, bad


def judge(docs: DataFrame, rules: list[Rule] = RULES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Counts, votes, ``base_failed``, the posterior ``p_good`` and ``kept`` of every row.

    Base: at least 20 words and at most 30 % of them in repeated windows. A null or empty text has
    no words and fails it; the model learns from the others. Repeated rows are judged alike.
    """
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    names = [f"vote_{r.name}" for r in rules]
    voted = written(counts(docs, id_column, text_column).withColumn("base_failed", failed)
                    .withColumns({n: votes(r) for n, r in zip(names, rules, strict=True)}), "quality")
    estimates = learn(voted.where(~F.col("base_failed")), names)
    return voted.withColumn("p_good", posterior(names, *estimates)).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def rules_sql(rules: list[Rule] = RULES, iterations: int = ITERATIONS) -> str:
    """The same for DuckDB over ``documents``: counts by unnested windows, EM as a chain of one-row tables."""
    def vote(r: Rule) -> str:
        return f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END AS v_{r.name}"

    odds = " + ".join(f"CASE v_{r.name} WHEN 1 THEN ln(g_{r.name} / (1 - b_{r.name})) WHEN -1 THEN ln((1 - g_{r.name}) / b_{r.name}) ELSE 0 END" for r in rules)
    p = f"(1 / (1 + exp(-(ln(prior / (1 - prior)) + {odds}))))"
    chain = [f"e0 AS MATERIALIZED (SELECT {FIRST_PRIOR}::DOUBLE AS prior, " + ", ".join(f"{FIRST_GOOD}::DOUBLE AS g_{r.name}, {FIRST_BAD}::DOUBLE AS b_{r.name}" for r in rules) + ")"]
    for i in range(iterations):
        def share(hits: str, tries: str, belief: tuple[float, float]) -> str:
            return f"((sum({hits} * n) + sum(n) * {belief[1]}::DOUBLE * {belief[0]}::DOUBLE) / (sum({tries} * n) + sum(n) * {belief[1]}::DOUBLE))"

        def right(r: Rule, vote: int, weight: str, belief: tuple[float, float]) -> str:
            return share(f"CASE v_{r.name} WHEN {vote} THEN {weight} ELSE 0 END", f"abs(v_{r.name}) * {weight}", belief)

        new = ", ".join(f"{right(r, 1, 'p', GOOD_BELIEF)} AS g_{r.name}, {right(r, -1, '(1 - p)', BAD_BELIEF)} AS b_{r.name}" for r in rules)
        chain.append(f"e{i + 1} AS MATERIALIZED (SELECT {share('p', '1', SHARE_BELIEF)} AS prior, {new} FROM (SELECT *, {p} AS p FROM patterns, e{i}))")
    names = ", ".join(f"v_{r.name}" for r in rules)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row FROM documents),
    w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
    g AS (SELECT row, i, list_slice(words, i, i + {WINDOW - 1}) AS gram FROM (SELECT row, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
    again AS (SELECT row, i FROM (SELECT row, i, count(*) OVER (PARTITION BY row, gram) AS n FROM g) WHERE n > 1),
    rep AS (SELECT row, count(DISTINCT k) AS n_repeat_words FROM (SELECT row, unnest(range(i, i + {WINDOW})) AS k FROM again) GROUP BY row),
    c AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
      len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
      len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper, len(regexp_extract_all(text, '[.!?]')) AS n_ends FROM w LEFT JOIN rep USING (row)),
    v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {', '.join(vote(r) for r in rules)} FROM c),
    patterns AS MATERIALIZED (SELECT {names}, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
    {', '.join(chain)}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT base_failed AND {p} >= 0.5 AS kept FROM v, e{iterations}"""
