from datetime import date
from math import sqrt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsignal.operators import candidates, lexicon, mentions, reshape, scoring, tokens

D = date(2024, 1, 1)


def score(spark, texts, **changes):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    table = lexicon.lexicon_table(spark, {"good": 1.9, "bad": -2.5, "great": 3.0})
    rows = lexicon.lexicon_polarity(df, table, ["id"], rules=lexicon.Rules(**changes)).orderBy("id").collect()
    assert len(rows) == len(texts)
    return [r.lexicon_polarity for r in rows]


def normal(s):
    return s / sqrt(s * s + 15)


CASES = {
    "It is good.": 1.9,
    "It is not good": 1.9 * -0.74,
    "not a very good": (1.9 + 0.293) * -0.74,
    "very good": 1.9 + 0.293,
    "very very good": 1.9 + 0.293 + 0.293 * 0.95,
    "slightly bad": -2.5 + 0.293,
    "extremely bad": -2.5 - 0.293,
    "GOOD day": 1.9 + 0.733,
    "GOOD DAY": 1.9,
    "good but bad": 1.9 * 0.5 - 2.5 * 1.5,
    "good!!": 1.9 + 2 * 0.292,
    "bad!!!!!!": -2.5 - 4 * 0.292,
    "good??": 1.9 + 2 * 0.18,
    "good????": 1.9 + 0.96,
    "no word of it fits!": 0.0,
    "": 0.0,
    "isn't good": 1.9 * -0.74,
    "not one two three good": 1.9,
}


def test_rules(spark):
    got = score(spark, list(CASES))
    assert got == pytest.approx([normal(s) for s in CASES.values()], abs=1e-6)


def test_long_lexicons_give_the_same_scores(spark, monkeypatch):
    listed = score(spark, list(CASES))
    monkeypatch.setattr(candidates, "LISTED_WORDS", 1)
    assert score(spark, list(CASES)) == listed


def test_whole_text_is_scored(spark):
    assert score(spark, ["word " * 5000 + "good"]) == pytest.approx([normal(1.9)], abs=1e-6)


def test_null_text_counts_as_neutral(spark):
    assert score(spark, [None]) == [0.0]


def test_default_lexicon_size():
    assert 50 < len(lexicon.DEFAULT_VALENCES) < 200


def test_daily_mean_and_attach(spark):
    rows = [(1, D, 0.2), (2, D, 0.4), (3, date(2024, 1, 2), -1.0), (4, None, 0.9)]
    df = spark.createDataFrame(rows, "id int, date date, lexicon_polarity double")
    assert {r.date: round(r.mean_polarity, 9) for r in lexicon.daily_mean(df).collect()} == {D: 0.3, date(2024, 1, 2): -1.0}
    assert {r.id: round(r.mean_polarity, 9) for r in lexicon.attach_daily_mean(df).collect()} == {1: 0.3, 2: 0.3, 3: -1.0}


def test_mentions(spark):
    terms = mentions.term_table(
        spark,
        [("A", "Agil", "ticker"), ("T", "ATT", "ticker"), ("AT&T", "ATT", "company"), ("J.B. Hunt", "Hunt", "company")],
    ).unionByName(mentions.generic_terms(spark))
    texts = ["A share of at&t and T; AT & T.", "a j b hunt deal on wall STREET", "walls tradesman", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = mentions.entity_mentions(df, terms, "id")
    assert sorted(tuple(r) for r in found.collect()) == [
        (0, "ATT", 4), (0, "Agil", 1), (1, "Hunt", 1), (1, "Market General", 1),
    ]
    flagged = mentions.flag_by_mentions(df, found, "id")
    assert {r.id: r.finance_flag for r in flagged.collect()} == {0: 1, 1: 1, 2: 0, 3: 0}
    substring = mentions.finance_flag(df, ["Trade"])
    assert {r.id: r.finance_flag for r in substring.collect()} == {0: 0, 1: 0, 2: 1, 3: 0}


def test_long_terms_are_found(spark):
    df = spark.createDataFrame([(1, "a one two three four five six b"), (2, "one two three four five")], "id int, text string")
    terms = mentions.term_table(spark, [("one two three four five six", "x", "company")])
    assert [tuple(r) for r in mentions.entity_mentions(df, terms, "id").collect()] == [(1, "x", 1)]


def test_terms_meet_texts_on_their_rarest_word(spark):
    texts = [(i, f"the the The name{i} of the the") for i in range(300)] + [(999, None)]
    df = spark.createDataFrame(texts, "id int, text string")
    terms = spark.range(100_000).select(
        F.concat(F.lit("The name"), F.col("id")).alias("term"), F.col("id").cast("string").alias("entity"), F.lit("company").alias("kind")
    )
    odd = mentions.term_table(
        spark, [("the The name5 of", "exact", "ticker"), ("the the name5 of", "no", "ticker"), ("...", "none", "company"), ("the absent", "z", "company")]
    )
    found = mentions.entity_mentions(df, terms.unionByName(odd), "id")
    assert sorted((r.id, r.entity, r.mentions) for r in found.collect()) == sorted(
        [(i, str(i), 1) for i in range(300)] + [(5, "exact", 1)]
    )
    tokens = df.select(F.split("text", " ").alias("_l")).select(F.transform("_l", F.lower).alias("_l"))
    filed = mentions.anchored_terms(tokens, terms)
    assert filed.where("anchor = 'the'").count() == 0 and filed.count() == 300


def test_mentions_at_the_ends_and_of_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "b c"), (3, "c"), (4, "")], "id int, text string")
    terms = mentions.term_table(spark, [("a b c", "x", "company"), ("b c", "y", "company"), ("C", "z", "ticker")])
    found = mentions.entity_mentions(df, terms, "id")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "x", 1), (1, "y", 1), (2, "y", 1)]
    assert mentions.entity_mentions(df, terms.limit(0), "id").count() == 0
    assert mentions.entity_mentions(df.limit(0), terms, "id").count() == 0


def test_token_ids(spark):
    df = spark.createDataFrame([(1, "b a, B c"), (2, "a! b é"), (3, "")], "id int, text string")
    vocab = tokens.vocabulary(df, "id")
    assert sorted((r.token_id, r.term, r.n) for r in vocab.collect()) == [
        (0, "b", 3), (1, "a", 2), (2, "c", 1), (3, "é", 1),
    ]
    want = [(1, 0, 0), (1, 1, 1), (1, 2, 0), (1, 3, 2), (2, 0, 1), (2, 1, 0), (2, 2, 3)]
    for head in (0, 2, 100):
        assert sorted(tuple(r) for r in tokens.encode(df, vocab, "id", head=head).collect()) == want


def test_score_text(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["up up down", "down", "none", None])], "id int, text string")
    load = lambda: scoring.KeywordScorer(["up"], ["down"])
    rows = scoring.score_text(df, "text", load, batch=2).orderBy("id").collect()
    assert [(r.label, round(r.score, 6)) for r in rows] == [
        ("POSITIVE", 0.333333), ("NEGATIVE", 1.0), ("UNKNOWN", 0.0), ("UNKNOWN", 0.0),
    ]
    cut = scoring.score_text(df, "text", load, max_words=1).orderBy("id").collect()
    assert cut[0].score == 1.0


def test_mini_batches(spark):
    def load():
        def scorer(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({"label": [f"n{len(texts)}"] * len(texts), "score": 1.0})

        return scorer

    df = spark.range(10).select(F.col("id").cast("string").alias("text")).coalesce(1)
    labels = [r.label for r in scoring.score_text(df, "text", load, batch=4).collect()]
    assert sorted(labels) == ["n2"] * 2 + ["n4"] * 8


def test_texts_of_like_length_are_batched_by_padded_words():
    texts = pd.Series(["a " * n for n in (9, 1, 5, 1, 50, 2, 5)] + [None])
    found = [list(b.index) for b in scoring.mini_batches(texts, 3, 12)]
    assert found == [[7, 1, 3], [5, 2], [6], [0], [4]]
    assert list(scoring.mini_batches(texts[:0], 3, 12)) == []


def test_several_models_in_one_pass(spark):
    def load():
        def scorer(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({"label": texts, "score": texts.str.len().astype("float64")}, index=texts.index)

        return scorer

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "", None, "dd  e f", "x"])], "id int, text string")
    models = {"whole": scoring.Model(load), "two": scoring.Model(load, 2)}
    out = scoring.score_texts(df.withColumn("two", F.lit("own")), "text", models, batch=2, batch_words=3)
    assert out.columns == ["id", "text", "whole", "two"]
    got = {r.id: (r.whole.label, r.two.label, r.two.score) for r in out.collect()}
    assert got == {
        0: ("a b c", "a b", 3.0), 1: ("", "", 0.0), 2: ("UNKNOWN", "UNKNOWN", 0.0), 3: ("dd  e f", "dd e", 4.0), 4: ("x", "x", 1.0)
    }
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_text_classifier(spark):
    rows = [(i, "fine grand day" if i % 2 else "poor weak night", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, text string, y int")
    fitted = scoring.text_classifier(df, "text", "y", features=64)
    out = scoring.classify_text(df.select("id", "text"), fitted).collect()
    assert all((r.label == "POSITIVE") == (r.id % 2 == 1) and r.score > 0.5 for r in out)


def test_long_form(spark):
    df = spark.createDataFrame([(1, 0.5, "x"), (2, None, "y")], "id int, a double, b string")
    long = reshape.to_long(df, ["id"], ["a", "b"])
    assert sorted((r.id, r.sentiment_type, r.value or "") for r in long.collect()) == [
        (1, "a", "0.5"), (1, "b", "x"), (2, "a", ""), (2, "b", "y"),
    ]
    assert sorted((r.id, r.value or -1) for r in reshape.slice_of(long, "a").collect()) == [(1, 0.5), (2, -1)]
