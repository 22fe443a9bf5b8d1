import random
import re

from newsignal.llm import decontaminate
from texts import prose

ITEMS = "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    doc, hit, names = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(window, len(w))
        if item is None or not n:
            continue
        wanted = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for p in range(len(doc) - n + 1):
            if tuple(doc[p : p + n]) in wanted:
                hit |= set(range(p, p + n))
                names.add(str(item))
    return len(doc), len(hit), sorted(names)


def result(found):
    return sorted((str(r.doc_id), r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in found.collect())


def planted():
    rng = random.Random(5)
    items = [(i, prose(1000 + i, rng.randrange(1, 45), 60)) for i in range(40)]
    items += [(50, "Über-Straße, 12"), (51, None), (52, "..."), (None, "waba waca"), (53, items[3][1]), (3, prose(77, 14))]
    docs = []
    for i in range(60):
        body = prose(i, rng.randrange(0, 120), 60).split()
        for _ in range(rng.randrange(3)):
            source = (rng.choice(items)[1] or "").split()
            at, cut = rng.randrange(len(body) + 1), rng.randrange(len(source) + 1)
            body[at:at] = [w.upper() for w in source[cut : cut + rng.randrange(8, 30)]]
        docs.append((i, ", ".join(body)))
    return docs + [(90, None), (91, ""), (92, "a STRAße ÜBER straße 12"), (93, "x Über straße 12"), (5, docs[5][1])], items


def test_equals_brute_force(spark, documents):
    docs, items = planted()
    wanted = sorted((str(i), *brute(t, items)) for i, t in docs)
    for block_rows in (200_000, 40):
        found = decontaminate.contamination(documents(docs), spark.createDataFrame(items, ITEMS), block_rows=block_rows)
        assert result(found) == [(i, n, h, names) for i, n, h, names in wanted]


def test_only_contaminated_rows_go(spark, documents):
    docs, items = planted()
    left = decontaminate.without_contaminated(documents(docs), spark.createDataFrame(items, ITEMS))
    clean = sorted(i for i, t in docs if brute(t, items)[1] == 0)
    assert sorted(r.doc_id for r in left.collect()) == clean and len(left.columns) == 5


def test_odd_rows(spark, documents, odd_rows):
    nothing = spark.createDataFrame([], ITEMS)
    found = decontaminate.contamination(documents(odd_rows), nothing)
    assert found.count() == len(odd_rows) and found.where("size(spans) > 0").count() == 0
    long_text = odd_rows[9][1]
    assert len(long_text) > 290_000
    some = spark.createDataFrame([(1, long_text[280_000:280_200])], ITEMS)
    assert {r.doc_id for r in decontaminate.contamination(documents(odd_rows), some).where("size(spans) > 0").collect()} == {6}
    assert decontaminate.contamination(documents([]), some).count() == 0


def test_passage_deep_in_a_text_of_several_megabytes(spark, documents):
    passage = prose(78, 15, 500)
    docs = documents([(1, prose(79, 700_000, 9_000) + " " + passage.upper() + " end"), (2, prose(80, 700_000, 9_000))])
    items = spark.createDataFrame([(5, passage)], ITEMS)
    found = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert [(s.start, s.end) for s in found[1].spans] == [(700_000, 700_015)] and not found[2].spans
    assert [r.doc_id for r in decontaminate.without_contaminated(docs, items).collect()] == [2]
