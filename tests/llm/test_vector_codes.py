import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsignal.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, parts, entries, rounds):
    """Every part against every entry, in Python integers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[math.floor(256 * float(np.float32(x))) for x in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def assign():
        out = []
        for v in cut:
            out.append([min((sum((a - b) ** 2 for a, b in zip(v[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)])
        return out

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut[i][p] for i in range(len(cut)) if found[i][p][1] == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    return kept, assign(), books


def codes_of(found):
    return "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)


def test_equals_plain_search(spark):
    rng = random.Random(5)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(i, [rng.gauss(c, 0.3) for c in rng.choice(centres)], i % 3) for i in range(300)]
    rows += [(300 + i, list(rows[i % 4][1]), None) for i in range(40)]  # copies: ties everywhere
    kept, want, books = plain_codes(rows, 4, 16, 2)
    coded, found = vc.vector_codes(spark.createDataFrame(rows, SCHEMA).repartition(5), parts=4, entries=16)
    got = {r.vec_id: (r.code, r.error) for r in coded.collect()}
    assert got == {r[0]: codes_of(f) for r, f in zip(kept, want)}
    text = ",".join(str(x) for p in books for e in p for x in e)
    assert found.digest() == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_bounds_never_hide_the_nearest(seed):
    rng = np.random.default_rng(seed)
    parts = rng.integers(-3, 4, (500, 2)) * (1 if seed % 2 else 10**8)  # many ties; large numbers
    entries = parts[rng.integers(0, 500, 32)]
    pivots = vc.spread_pivots(entries, 3)
    near = vc.distances(parts, pivots).astype(np.float32)
    index, far = vc.nearest(parts, near, entries, pivots)
    gap = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (index == gap.argmin(1)).all() and (far == gap.min(1)).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.0, 1.0, 2.0, 3.0], 1),
        (1, [0.0, 1.0, 2.0, 3.0], 1),
        (None, [0.5, 1.0, 2.0, -3.0], None),
        (2, None, 1),
        (3, [1.0, None, 2.0, 3.0], 1),
        (4, [nan, 1.0, 2.0, 3.0], 1),
        (5, [1.0, inf, 2.0, 3.0], 1),
        (6, [1.0, 2.0], None),
        (7, [], 2),
        (8, [3e38, 0.0, 0.0, 0.0], 1),
        (9, [-0.001, -1.001, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit("own")).withColumn("row", F.lit("kept"))
    coded, books = vc.vector_codes(df, parts=2, entries=8)
    out = coded.collect()
    assert coded.columns == ["vec_id", "label", "row", "code", "error"]
    assert sorted((r.vec_id or 0, r.code is None) for r in out) == [(0, False), (1, False), (1, False), (6, True), (7, True), (8, True), (9, False)]
    assert all(r.error is None for r in out if r.code is None) and {r.row for r in out} == {"kept"}
    assert books.entries.shape == (2, 4, 2)
    totals = vc.with_group_total(coded, "label", "error", "label_error").collect()
    assert len(totals) == len(out)
    assert {r.label_error for r in totals if r.label is None} == {sum(r.error or 0 for r in out if r.label is None)}
    assert [r.label_error for r in totals if r.label == 2] == [None]


def test_empty_tables_and_nothing_usable(spark):
    for rows in ([], [(1, None, 1)], [(1, [float("nan")], 1)]):
        coded, books = vc.vector_codes(spark.createDataFrame(rows, SCHEMA), parts=2)
        assert coded.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()
    coded, _ = vc.vector_codes(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1)], SCHEMA), parts=2)
    assert [(r.vec_id, r.code, r.error) for r in coded.collect()] == [(1, None, None)]


def test_small_groups_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(vc, "LARGE_GROUPS", 2)
    df = spark.createDataFrame([(i, i % 7 if i % 7 else None, i) for i in range(70)], "vec_id long, label int, error long")
    got = {(r.label, r.t) for r in vc.with_group_total(df, "label", "error", "t").collect()}
    assert got == {(k or None, sum(i for i in range(70) if i % 7 == k)) for k in range(7)}
