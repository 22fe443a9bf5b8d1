"""Quality rules, mixing and line dedup: odd input, edge cases and what they promise."""

import pytest
from newsignal.llm import line_dedup, mixing, quality
from pyspark.sql import functions as F
from texts import prose


def python_nodes(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [w for w in ("Python", "Arrow", "Pandas") if w in plan]


def test_quality_counts(documents):
    eight = "a b c d e f g h"
    rows = [
        (1, f"{eight} x {eight} y"),
        (2, "line one\n\nline one\n \nline two\nline one"),
        (3, "Go #1 *now* <b> 50% & | $"),
        (4, eight + " i"),
        (5, "z " * 30),
    ]
    got = {r.doc_id: r for r in quality.quality_rules(documents(rows)).collect()}
    assert got[1].n_repeat_words == 16 and got[1].n_words == 18
    assert got[2].n_dup_lines == 2 and got[2].n_words == 8
    assert got[3].n_symbols == 9
    assert got[4].n_repeat_words == 0
    assert got[5].n_repeat_words == 30 and got[5].base_failed and not got[5].kept


def test_quality_adapts_to_the_group(documents):
    rows = [(i, prose(i, 50), "en", "plain", 0) for i in range(300)]
    rows += [(1000 + i, prose(i, 50).replace(" ", "# "), "en", "code", 0) for i in range(300)]
    rows += [(5000, prose(1, 50).replace(" ", "# "), "en", "plain", 0), (5001, prose(2, 50).replace("w", "wwwwwwwww"), "en", "rare", 0)]
    got = {r.doc_id: r for r in quality.quality_rules(documents(rows)).collect()}
    assert all(got[i].kept for i in range(300)) and all(got[1000 + i].kept for i in range(300))
    assert got[5000].failed_rules == "symbols" and not got[5000].kept
    assert not got[5001].kept  # takes the fences of its language


def test_quality_odd_rows(documents, odd_rows):
    found = quality.quality_rules(documents(odd_rows))
    assert found.count() == len(odd_rows)
    assert {r.base_failed for r in found.where("doc_id in (1, 2, 3, 4)").collect()} == {True}
    assert quality.quality_rules(documents([])).count() == 0
    clash = documents(odd_rows).withColumn("n_words", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("grams", F.lit(1))
    assert quality.quality_rules(clash).count() == len(odd_rows)
    assert python_nodes(found) == []


def mixed_rows():
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else f"s{i % 5}"
        topic = " license" if i // 2 % 4 == 0 else " price" if i // 2 % 7 == 0 else ""
        rows.append((i, prose(i, 20 + i % 30) + topic, ("en", "de")[i % 2], source, 0))
    return rows


def test_mix_meets_the_marginals(documents):
    wanted = {"hot": 0.2, "s0": 0.2, "s1": 0.2, "s2": 0.2, "s3": 0.1, "s4": 0.1, "unseen": 0.5}
    found = mixing.mix(documents(mixed_rows()), source_targets=wanted, lang_targets={"en": 1.0, "de": 3.0}, share=0.4).cache()
    assert found.count() == 900 and python_nodes(found) == []
    expected = found.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("e")).collect()
    total = sum(r.e for r in expected)
    for r in expected:
        assert r.e / total == pytest.approx(wanted[r.source], abs=1e-4)
    langs = {r.lang: r.e for r in found.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("e")).collect()}
    assert langs["de"] / langs["en"] == pytest.approx(3, abs=1e-3)
    drawn = found.where("sampled").agg(F.sum("n_tokens")).first()[0]
    assert drawn == pytest.approx(total, rel=0.15)
    assert found.agg(F.max("probability")).first()[0] <= 1
    assert {r.topic for r in found.select("topic").distinct().collect()} == {"licensing", "commerce", "other"}


def test_mix_odd_rows(documents, odd_rows):
    found = mixing.mix(documents(odd_rows))
    assert found.count() == len(odd_rows)
    assert found.where("n_tokens = 0 and sampled").count() == 0
    assert {r.source for r in found.where("doc_id is null and n_tokens = 0").collect()} == {"(none)"}
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mix(documents([]), sampled_rows=True).count() == 0
    clash = documents(odd_rows).withColumns({"at": F.lit(1), "weight": F.lit(2), "facts": F.lit(3), "mix_row": F.lit(4), "topic": F.lit(5)})
    rows = mixing.mix(clash, sampled_rows=True)
    assert rows.columns == [*clash.columns, "mix_topic", "mix_tokens", "mix_weight", "mix_probability"]
    chosen = sorted(str(r.doc_id) for r in found.where("sampled").collect())
    assert sorted(str(r.doc_id) for r in rows.collect()) == chosen


def boilerplate_docs():
    rows = []
    for i in range(12):
        rows.append((i, f"{prose(i, 30)}\nCopyright (c) {1990 + i} Example Press {i * 7} all rights reserved\n{prose(50 + i, 30)}"))
    body = "\n".join(prose(500 + k, 25) for k in range(6))
    for i in range(8):  # near copies of one document
        rows.append((100 + i, f"{body}\nchanged w{i}a w{i}b w{i}c w{i}d"))
    rows += [(200, body), (201, body), (202, body)]
    # A table of numbers has no constant fields, so its lines are no template.
    return rows + [(300 + i, "\n".join(f"{i * 31 + k} {k * 7 + i} {k}.5 {i}.25" for k in range(9)) + "\n" + prose(700 + i, 40)) for i in range(9)]


def test_recurring_templates_go_and_copies_stay(documents):
    docs = documents(boilerplate_docs())
    found = line_dedup.drop_recurring_lines(docs)
    assert python_nodes(found) == []
    got = {r.doc_id: r for r in found.collect()}
    for i, text in boilerplate_docs():
        if i < 12:
            lines = text.split("\n")
            assert got[i].text == f"{lines[0]}\n{lines[2]}" and (got[i].n_lines, got[i].n_dropped) == (3, 1)
        else:
            assert got[i].text == text and got[i].n_dropped == 0


def test_a_leaf_has_many_templates(documents):
    ends = ["here now please", "on our pages", "in the archive", "before you leave"]
    lines = [f"read more about name{k}x{'abcdefghijklmnopqrstuvwxyz'[i]} {e}" for k, e in enumerate(ends) for i in range(20)]
    lines = [x.replace(f"name{k}x", "nm" + "pqrs"[k]) for k in range(4) for x in lines if f"name{k}x" in x]
    rows = [(i, f"{prose(900 + i, 40)}\n{line}\n{prose(2000 + i, 40)}", "en", "a", 1) for i, line in enumerate(lines)]
    rows += [(500 + i, f"{prose(900 + i, 40)}\nread more about single{'abcd'[i]} {'qwer'[i]}x {'asdf'[i]}y {'zxcv'[i]}z", "en", "a", 1) for i in range(4)]
    found = line_dedup.drop_recurring_lines(documents(rows))
    assert python_nodes(found) == []
    got = {r.doc_id: r.n_dropped for r in found.collect()}
    assert [got[i] for i in range(80)] == [1] * 80 and [got[500 + i] for i in range(4)] == [0] * 4


def test_short_lines_recur_too(documents):
    rows = [(i, f"{prose(i, 30)}\n\nAll rights\treserved\n{prose(60 + i, 30)}", "en", "a", 1) for i in range(20)]
    rows += [(100, f"{prose(100, 30)}\nNo rights reserved\nrare", "en", "a", 1)]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(documents(rows)).collect()}
    assert [got[i].n_dropped for i in range(20)] == [1] * 20 and got[100].n_dropped == 0
    assert got[3].text == f"{prose(3, 30)}\n\n{prose(63, 30)}"
    longer = line_dedup.drop_recurring_lines(documents(rows), least_tokens=4)
    assert longer.where("n_dropped > 0").count() == 0


def test_lines_odd_rows(documents, odd_rows):
    docs = documents(odd_rows)
    got = line_dedup.drop_recurring_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sorted(str(r.text) for r in got.collect()) == sorted(str(r[1]) for r in odd_rows)
    assert {r.n_lines for r in got.where("text is null").collect()} == {0}
    assert line_dedup.drop_recurring_lines(documents([])).count() == 0
    clash = documents(boilerplate_docs()).withColumns({"digest": F.lit(1), "positions": F.lit(2), "n_lines": F.lit("x")})
    again = line_dedup.drop_recurring_lines(clash, n_lines="a", n_dropped="b")
    assert again.columns == [*clash.columns, "a", "b"] and again.where("b > 0").count() == 12
