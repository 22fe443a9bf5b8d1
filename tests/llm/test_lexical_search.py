import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest
from texts import prose

from newsignal.llm import lexical_search as ls

ITEMS = "item_id long, text string"


def plain_terms(text):
    small = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", small)


def plain_search(docs, items, k=10):
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, n_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, Counter()).update(plain_terms(text))
    out = []
    for item, terms in wanted.items():
        scores = []
        for d, c in counted:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t, q in terms.items()
                if c[t]
            )
            if score > 0:
                scores.append((-score, d is None, d or 0, d))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def searched(spark, docs, items, **more):
    index = ls.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    found = ls.search(index, spark.createDataFrame(items, ITEMS), **more)
    return sorted([tuple(r) for r in found.collect()], key=repr)


@pytest.mark.parametrize("rows, block", [(1 << 15, 200_000), (40, 30)])
def test_equals_plain_search(spark, monkeypatch, rows, block):
    monkeypatch.setattr(ls, "SEGMENT_ROWS", rows)
    monkeypatch.setattr(ls, "BLOCK_TERMS", block)
    rng = random.Random(2)
    docs = [(i, prose(i, rng.choice([1, 5, 40, 300]), 250)) for i in range(400)]
    docs += [(1000 + i, docs[3][1]) for i in range(30)] + [(3, docs[3][1])] * 2
    items = [(i, prose(9000 + i, rng.choice([1, 6, 60]), 260)) for i in range(25)]
    assert searched(spark, docs, items) == plain_search(docs, items)


def test_odd_rows(spark, odd_rows):
    docs = [(r[0], r[1]) for r in odd_rows] + [(11, "A-b_c ÉTÉ été x2"), (12, "...")]
    items = [(1, "ONE one"), (None, "été Été"), (2, None), (3, ""), (4, "absent"), (5, "w"), (6, prose(3, 50, 9_000))]
    items += [(7, "one"), (7, "été"), (8, "c B")]
    got = searched(spark, docs, items, k=3)
    assert got == plain_search(docs, items, 3)
    assert {r[0] for r in got} >= {1, None, 6, 7, 8} and not {r[0] for r in got} & {2, 3, 4}


def test_empty_tables(spark):
    assert searched(spark, [], [(1, "a")]) == []
    assert searched(spark, [(1, None), (2, "?!")], [(1, "a")]) == []
    assert searched(spark, [(1, "a")], []) == []


def test_own_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2)], "doc_id long, text string, score string, terms int")
    items = spark.createDataFrame([("q", "a", 1, 2)], "item_id string, text string, rank int, term int")
    out = ls.search(ls.build_index(docs), items)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert [(r.item_id, r["rank"], r.doc_id) for r in out.collect()] == [("q", 1, 1)]


def test_written_segments_do_not_pile_up(spark, monkeypatch):
    """A task with many segments writes row groups of some MB each, and none leaves its values as statistics."""
    monkeypatch.setattr(ls, "SEGMENT_BYTES", 1 << 20)
    rng = random.Random(4)
    docs = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(2_000))) for i in range(700)]
    index = ls.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in index.segments.inputFiles()]
    groups = [m.row_group(g) for m in files for g in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) > 12 and sum(g.total_byte_size for g in groups) > 20 << 20
    assert max(g.total_byte_size for g in groups) <= 10 << 20
    assert not any(g.column(c).is_stats_set for g in groups for c in range(g.num_columns))
    found = ls.search(index, spark.createDataFrame([(i, docs[i][1][-60:]) for i in (0, 350, 699)], ITEMS), k=1)
    assert sorted((r.item_id, r.doc_id) for r in found.collect()) == [(0, 0), (350, 350), (699, 699)]
