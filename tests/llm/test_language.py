import numpy as np
from newsignal.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = queries.op8_language_id(spark, SF)
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").where("held_out").collect()
    assert len(rows) > 200
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_learns_only_from_given_rows_and_rejects(documents, odd_rows):
    rows = [(i, "the and of that with this " * 4, "en") for i in range(30)]
    rows += [(100 + i, "der und nicht über eine das " * 4, "de") for i in range(30)]
    rows += [(200, None, "xx"), (201, "12 34", "yy"), (202, "the and", None)]
    model = language.train(documents(rows))
    assert model.languages == ["de", "en"]
    out = language.identify(documents(odd_rows + [(50, "und nicht über das"), (51, "12 !? 34")]), model)
    got = {r.doc_id: r.language for r in out.collect()}
    assert got[50].lang_pred == "de" and not got[50].rejected
    for i in (1, 2, 3, 51):
        assert got[i].lang_pred == "und" and got[i].score == 0 and got[i].rejected
    assert out.count() == len(odd_rows) + 2


def test_nothing_to_learn_from(documents, odd_rows):
    model = language.train(documents([]))
    assert {r.language.lang_pred for r in language.identify(documents(odd_rows), model).collect()} == {"und"}
    assert language.identify(documents([]), model).count() == 0


def test_threshold_bounds_the_risk():
    score = np.array([0.9, 0.8, 0.7, 0.6, 0.5])
    assert language.rejection_threshold(score, np.array([True] * 5), 0.01) == 0.0
    assert language.rejection_threshold(score, np.array([True, True, True, False, False]), 0.01) == 0.7
    assert language.rejection_threshold(score, np.array([False] * 5), 0.01) == 1.0


def test_own_column_of_the_same_name(documents):
    docs = documents([(1, "the and of", "en")]).withColumnRenamed("source", "language")
    model = language.train(docs)
    assert language.identify(docs, model, out="found").columns == [*docs.columns, "found"]
