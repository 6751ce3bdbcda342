"""Text expressions on inline rows."""

import pytest
from pyspark.sql import functions as F

from starlens.functions import text as tx


def one(spark, text, expr):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(expr(F.col("t")).alias("x")).first()["x"]


@pytest.mark.parametrize("text, theme", [
    ("I hate the subscription model", "Pricing/Subscription"),
    ("This app is too expensive to upgrade", "Pricing/Subscription"),
    ("The app keeps crashing on my phone", "Bugs/Performance"),
    ("Very slow performance and lag", "Bugs/Performance"),
    ("It gives wrong answers and is inaccurate", "Accuracy/Logic Issues"),
    ("The information is misleading and unreliable", "Accuracy/Logic Issues"),
    ("I love this app", "General"),
    ("Nice app overall", "General"),
    ("", "General"),
    (None, "General"),
    ("The app crashes and subscription is expensive", "Pricing/Subscription"),
    ("Wrong answers and I had to pay for premium", "Pricing/Subscription"),
    ("a red flag", "Bugs/Performance"),  # "lag" inside "flag": substrings count
    ("the payload is fine", "Pricing/Subscription"),
    ("WRONG ANSWER", "Accuracy/Logic Issues"),
])
def test_theme(spark, text, theme):
    assert one(spark, text, tx.theme) == theme


def test_theme_rules_are_a_parameter(spark):
    rules = [("Login", ["sign in", "password"])]
    assert one(spark, "lost my PASSWORD", lambda c: tx.theme(c, rules)) == "Login"
    assert one(spark, "too expensive", lambda c: tx.theme(c, rules)) == "General"


def test_polarity_signs(spark):
    assert one(spark, "I love this app, it is amazing", tx.polarity) > 0
    assert one(spark, "This app is terrible and broken", tx.polarity) < 0
    assert -1.0 <= one(spark, "This is a test sentence", tx.polarity) <= 1.0


@pytest.mark.parametrize("text, expected", [
    ("", 0.0), (None, 0.0), ("   \n", 0.0), ("plain words", 0.0),
    ("good", 0.7), ("Good GOOD", 0.7), ("good bad", 0.0),
    ("not good", -0.35), ("don't like it", -0.15), ("very good", 0.91), ("amazing", 1.0), ("very amazing", 1.0),
    ("not very good", 0.91),  # only the token just before counts
    ("not... good", -0.35), ("goodness", 0.0), ("very", 0.0), ("so so good", 0.91),
    ("x good", 0.7), ("good x", 0.7), ("7good7", 0.7),
])
def test_polarity_values(spark, text, expected):
    assert one(spark, text, tx.polarity) == pytest.approx(expected)


def test_polarity_lexicon_is_a_parameter(spark):
    assert one(spark, "really meh", lambda c: tx.polarity(c, {-0.25: ["meh"]})) == pytest.approx(-0.325)


PYTHON_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


@pytest.mark.parametrize("text", [
    "", " ", "one", " two  words ", "tab\tand\nline", "no break", "a b　c", "x\x1cy\x1fz", "é è à",
    "word".join(PYTHON_SPACES), "zero​width", "﻿bom here",
])
def test_word_count_is_pythons(spark, text):
    assert one(spark, text, tx.word_count) == len(text.split())
    assert one(spark, text, tx.char_length) == len(text)


def test_null_text_counts_nothing(spark):
    assert one(spark, None, tx.word_count) == 0
    assert one(spark, None, tx.char_length) == 0


def test_tokens(spark):
    assert one(spark, "Don't pay_2 café OK", tx.tokens) == ["don", "t", "pay", "caf", "ok"]
    assert one(spark, "", tx.tokens) == []
    assert one(spark, "123", tx.tokens) == []


def test_long_tokens_are_the_long_ones(spark):
    text = "Abcd abc 9abcde_fghi ijk-lmnop"
    assert one(spark, text, tx.long_tokens) == [t for t in one(spark, text, tx.tokens) if len(t) > 3]


@pytest.mark.parametrize("query", ["a.b", "c++", "(x", "$1", "[", "back\\slash", "wörld"])
def test_highlight_takes_the_query_literally(spark, query):
    text = f"see {query.upper()} and {query}!"
    assert one(spark, text, lambda c: tx.matches(c, query)) is True
    assert one(spark, text, lambda c: tx.highlight(c, query)) == f"see <mark>{query.upper()}</mark> and <mark>{query}</mark>!"


def test_digest_keeps_null(spark):
    assert one(spark, None, tx.text_digest) is None
    assert one(spark, "", tx.text_digest) is not None
