"""The pipeline against a plain version of its stages on a small fixture."""

import random

import corpus_pipeline
import pytest
from newsignal.llm import language, mixing
from pyspark.sql import functions as F
from test_decontaminate import brute as windows_in
from test_near_dups import brute as groups_of
from texts import prose

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    item = prose(900, 30)
    rows = []
    for i in range(60):
        body = prose(i, 40)
        if i % 10 == 3:
            body += " " + " ".join(item.split()[5:20])
        rows.append([i, f"{prose(3000 + i, 12)}\nAll rights of page {i} are reserved here\n{body}", "en", f"s{i % 3}"])
    for i in range(60, 70):  # near copies
        words = rows[i - 60][1].split(" ")
        words[rng.randrange(len(words) - 8, len(words))] = "changed"
        rows.append([i, " ".join(words), "en", "s1"])
    rows += [[80, "12 34", "en", "s0"], [81, None, "en", "s0"], [82, "", None, None], rows[5], [None, prose(77, 50), None, "s2"]]
    path = tmp_path_factory.mktemp("pipeline")
    data = [(*r, None if r[1] is None else len(r[1])) for r in rows]
    docs = spark.createDataFrame(data, DOCUMENTS).withColumns({"language": F.lit("own"), "gone": F.lit(1), "digest": F.lit(2)})
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage_and_the_whole(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, before, folder).cache()
        assert docs.columns == columns and docs.schema == before.schema
        got = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        if name == "language_id":
            texts = [(i, t) for i, t in texts if language.has_letter(t)]
        elif name == "line_dedup":
            texts = [
                (i, "\n".join(x for x in t.split("\n") if not x.startswith("All rights of page"))) for i, t in texts
            ]
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        elif name == "near_duplicates":
            root = {i: g for i, (_, g) in groups_of(texts, 5).items()}
            texts = list(dict.fromkeys((i, t) for i, t in texts if i is None or root[i] == i))
            assert len(texts) < 75
        elif name == "decontamination":
            item = spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text
            texts = [(i, t) for i, t in texts if windows_in(t, [(1, item)])[1] == 0]
            assert len(texts) < 60
        assert got == sorted(texts, key=str), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.columns[: len(columns)] == columns
    chosen = {str(r.doc_id) for r in mixing.mix(docs).where("sampled").collect()}
    got = sorted(str(r.doc_id) for r in last.collect())
    assert set(got) == chosen
    assert sorted(str(r.doc_id) for r in corpus_pipeline.run(spark, folder).collect()) == got


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
