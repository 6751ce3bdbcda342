"""Text expressions. All are Catalyst columns but ``word_count``, ``theme`` and ``polarity``, which run on Arrow batches: no Python runs per row."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from starlens.functions import fixed_values as fv
from starlens.functions import words
from starlens.session import arrow_column

NOT_A_LETTER = "[^a-z]+"


def word_count(text: Column) -> Column:
    """Words as Python's str.split() sees them: runs free of Unicode white space and of the four separator
    controls; 0 for null."""
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(words.word_counts(texts), pa.int32())

    return F.coalesce(arrow_column(count, "int", text), F.lit(0))


def char_length(text: Column) -> Column:
    """Code points; 0 for null."""
    return F.coalesce(F.length(text), F.lit(0)).cast("int")


def text_digest(text: Column) -> Column:
    """32-byte identity of a text: group on this instead of shuffling the text itself.

    Null stays null, so null texts still fall into one group.
    """
    return F.unhex(F.sha2(text, 256))


def tokens(text: Column) -> Column:
    """ASCII letter runs of the lower-cased text, in order, repeats kept."""
    # a text that starts or ends with another character yields an empty first or last piece
    return F.array_remove(F.split(F.lower(text), NOT_A_LETTER), "")


def long_tokens(text: Column) -> Column:
    """Tokens of more than three letters: the pattern drops the others before they are built."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]{4,}"), F.lit(0))


def contains_any(lowered: Column, phrases: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [lowered.contains(p) for p in phrases])


def theme(text: Column, rules=None, default: str = fv.DEFAULT_THEME) -> Column:
    """First theme in ``rules`` with a phrase inside the lower-cased text. All phrases of a rule are sought in one pass, in Arrow batches."""
    rules = fv.THEME_RULES if rules is None else rules
    names = [name for name, _ in rules] + [default]
    patterns = ["|".join(re.escape(p) for p in phrases) for _, phrases in rules]

    @F.arrow_udf("string")
    def first(lowered: pa.Array) -> pa.Array:
        place = np.full(len(lowered), len(patterns))
        for k in range(len(patterns) - 1, -1, -1):  # the first rule has the last word
            place[pc.fill_null(pc.match_substring_regex(lowered, patterns[k]), False).to_numpy(zero_copy_only=False)] = k
        return pa.array(names, pa.string()).take(pa.array(place))

    # never null, and known not to be: filters on it vanish instead of running it again
    return F.coalesce(first(F.lower(text)), F.lit(default))


def _values(table: Mapping[float, Sequence[str]]) -> dict[str, float]:
    """word -> value; a word that stands more than once has its first value."""
    return {w: float(value) for value, listed in reversed([*table.items()]) for w in listed}


def modifier_table(intensifiers=None, negations=None, negation_factor=fv.NEGATION_FACTOR):
    table = dict(fv.INTENSIFIERS if intensifiers is None else intensifiers)
    table[negation_factor] = list(fv.NEGATIONS if negations is None else negations)
    return table


def polarity(text: Column, lexicon=None, modifiers=None) -> Column:
    """Mean score of the opinion words of a text, in [-1, 1]; 0.0 when there is none.

    The score of an opinion word is its lexicon value times the factor of the token just before
    it. A review is scored inside its own row, in Arrow batches: no explode, no shuffle, and it
    works unchanged on a stream.
    """
    values = _values(fv.POLARITY_WORDS if lexicon is None else lexicon)
    factors = _values(modifier_table() if modifiers is None else modifiers)

    def mean(lowered: pa.Array) -> pa.Array:
        return pa.array(words.mean_scores(lowered, values, factors), pa.float64())

    return F.coalesce(arrow_column(mean, "double", F.lower(text)), F.lit(0.0))


def quote_pattern(literal: str) -> str:
    """``literal`` as a regular expression that matches just itself."""
    return "".join(c if c.isalnum() or c.isspace() or ord(c) > 127 else "\\" + c for c in literal)


def matches(text: Column, query: str) -> Column:
    """Case-insensitive substring test."""
    return F.lower(text).contains(query.strip().lower())


def highlight(text: Column, query: str, before="<mark>", after="</mark>") -> Column:
    """Wrap each case-insensitive occurrence of the plain string ``query``."""
    return F.regexp_replace(text, f"(?iu)({quote_pattern(query.strip())})", f"{before}$1{after}")
