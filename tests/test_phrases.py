import random
import re
from math import sqrt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from newsignal.operators import lexicon, phrases

ENTRIES = {
    "good": 1.9, "cut the mustard": 2.0, "the": 0.0, "cut": -1.1, ":)": 2.0, ":D": 2.3, "well-known": 1.2,
    "bad": -2.5, "the end of the world": -3.0, "A Well-Known fact": 0.5, "can't stand": -2.0,
}
RULES = lexicon.rules_for(
    ENTRIES, lexicon.Rules(negations=("not", "by no means"), weaker=("kind of",), stronger=("very",))
)


def tokens(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(phrases.units(F.col("text"), RULES.symbols, RULES.phrases).alias("t")).first().t


@pytest.mark.parametrize(
    "text, expected",
    [
        ("They cut the mustard.", ["They", "cut the mustard"]),
        ("cut the, Mustard", ["cut the Mustard"]),
        ("cut the mustardy", ["cut", "the", "mustardy"]),
        ("the end of the worlds", ["the", "end", "of", "the", "worlds"]),
        ("the THE END of the world", ["the", "THE END of the world"]),
        ("nice :) day", ["nice", ":)", "day"]),
        ("nice :). Day :d!", ["nice", ":)", "Day", ":d"]),
        ("nice:) x:)", ["nice", "x"]),
        ("a well-known fact, well-known", ["a well-known fact", "well-known"]),
        ("kind of good by no means", ["kind of", "good", "by no means"]),
        ("I can't stand it", ["I", "can't stand", "it"]),
        ("", []),
        (None, None),
        ("| 12 !", []),
    ],
)
def test_units(spark, text, expected):
    assert tokens(spark, text) == expected


def polarity(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    row = lexicon.lexicon_polarity(df, lexicon.lexicon_table(spark, ENTRIES), ["id"], rules=RULES).first()
    return row.lexicon_polarity


@pytest.mark.parametrize(
    "text, total",
    [
        ("They cut the mustard", 2.0),
        ("by no means good", 1.9 * -0.74),
        ("kind of good", 1.9 - 0.293),
        ("kind good", 1.9),
        ("no :)", 2.0),
        ("CUT THE MUSTARD again", 2.0 + 0.733),
        ("CUT the MUSTARD again", 2.0),
        ("a well-known fact", 0.5),
        ("not :D", 2.3 * -0.74),
        (None, 0.0),
        ("", 0.0),
    ],
)
def test_polarity_with_phrases(spark, text, total):
    assert polarity(spark, text) == pytest.approx(total / sqrt(total * total + 15))


def test_words_alone_are_cut_as_before(spark):
    text = "It's 3 o'clock, ÉTÉ-end … ok_then ''"
    df = spark.createDataFrame([(text,)], "text string")
    plain = F.array_remove(F.split("text", phrases.WORD_BREAK), "")
    with_symbol = phrases.units(F.col("text"), [":)"], ["zz zz"])
    row = df.select(phrases.units(F.col("text")).alias("a"), plain.alias("b"), with_symbol.alias("c")).first()
    assert row.a == row.b == row.c


def longest_first(words, known):
    out, i = [], 0
    while i < len(words):
        n = max((k for k in range(1, len(words) - i + 1) if k == 1 or " ".join(words[i : i + k]) in known))
        out.append(" ".join(words[i : i + n]))
        i += n
    return out


@settings(max_examples=200, deadline=None)
@given(
    st.lists(st.lists(st.sampled_from("ab"), min_size=2, max_size=4).map(" ".join), min_size=1, max_size=6),
    st.lists(st.sampled_from(["a", "b", "c", "ab"]), max_size=20),
)
def test_pattern_takes_the_longest_phrase(known, words):
    pattern = re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), phrases.phrase_pattern(known))
    found = re.findall(rf"({pattern}|[^ ]+)(?: |$)", " ".join(words))
    assert found == longest_first(words, set(known))


def test_many_phrases_and_a_long_text(spark):
    rng = random.Random(1)
    words = [f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    known = sorted({" ".join(rng.choices(words, k=rng.randint(2, 4))) for _ in range(3000)})
    text = rng.choices(words, k=200_000)
    df = spark.createDataFrame([(" ".join(text),)], "text string")
    found = df.select(phrases.units(F.col("text"), (), known).alias("t")).first().t
    by_first = set(known)
    expected, i = [], 0
    while i < len(text):
        n = max(k for k in (1, 2, 3, 4) if k == 1 or " ".join(text[i : i + k]) in by_first)
        expected.append(" ".join(text[i : i + n]))
        i += n
    assert found == expected
