import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from newsignal.operators import ordered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("chunk", ["week", "month", "year"])
def test_position_numbers_each_key(spark, chunk):
    rng = random.Random(3)
    rows = []
    for key, n in (("hot", 400), ("b", 3), ("c", 1)):
        days = rng.sample(range(3000), n)
        rows += [(key, date(2015, 1, 1) + timedelta(d)) for d in days]
    rows += [(None, date(2015, 1, 1)), ("b", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, d date")
    got = {(r.k, r.d): r._pos for r in ordered.with_position(df, "k", "d", chunk=chunk).collect()}
    want = {}
    for key in ("hot", "b", "c"):
        for i, d in enumerate(sorted(d for k, d in rows if k == key and d)):
            want[key, d] = i
    assert got == want


@pytest.mark.parametrize("rows,before,after", [(10, 3, 2), (4, 9, 9), (1, 0, 1), (100, 5, 5)])
def test_blocks_hold_their_neighbours(spark, rows, before, after):
    n = 37
    df = spark.range(n).select(F.col("id").alias("_pos"))
    got = ordered.in_blocks(df, rows, before, after).collect()
    assert sorted(r._pos for r in got if r._core) == list(range(n))
    have = {}
    for r in got:
        have.setdefault(r._block, set()).add(r._pos)
    for p in range(n):
        near = set(range(max(0, p - before), min(n, p + after + 1)))
        assert near <= have[p // rows]


def test_block_totals_before_two_levels(spark):
    rng = random.Random(5)
    values = [rng.randrange(100) for _ in range(50)]
    df = spark.createDataFrame([("a", b, v) for b, v in enumerate(values)] + [("z", 0, 7)], "k string, _block long, v long")
    got = {(r.k, r._block): r.v for r in ordered.block_totals_before(df, "k", "v", fan=4).collect()}
    assert got == {**{("a", b): sum(values[:b]) for b in range(50)}, ("z", 0): 0}


def test_totals_before_is_exact_for_any_number_of_ranges(spark):
    rng = random.Random(7)
    values = {round(rng.gauss(0, 1), 3): rng.randrange(9) for _ in range(300)}
    df = spark.createDataFrame(list(values.items()), "v double, m long")
    want = {v: sum(m for u, m in values.items() if u < v) for v in values}
    for ranges in (2, 16, 128):
        got = ordered.totals_before(df, "v", ["m"], ranges)
        assert got.columns == ["v", "m", "before_m"]
        assert {r.v: r.before_m for r in got.collect()} == want
        assert "SinglePartition" not in plan(got)


def test_batches_are_full_and_ordered(spark):
    df = spark.range(0, 5000, 7).select((F.col("id") * 13 % 9001).alias("key"))
    got = sorted((r.key, r.batch_id) for r in ordered.batch_ids(df, "key", 100).collect())
    assert [b for _, b in got] == [i // 100 for i in range(len(got))]
    assert "SinglePartition" not in plan(ordered.batch_ids(df, "key", 100))


def test_batches_of_text_keys_hold_nulls_and_ties(spark):
    keys = [None, None, None, "b", "b", "b", "a", "ü", "", "zz"]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    got = sorted(ordered.row_index(df, "k", ranges=4).collect(), key=lambda r: r.row_index)
    assert [r.row_index for r in got] == list(range(10))
    assert [r.k for r in got] == [None] * 3 + ["", "a", "b", "b", "b", "zz", "ü"]
    assert {r.i for r in got} == set(range(10))
    assert {r.batch_id for r in ordered.batch_ids(df, "k", 3).collect()} == {0, 1, 2, 3}


def test_empty_and_infinite_values(spark):
    empty = spark.createDataFrame([], "v double, m long")
    assert ordered.totals_before(empty, "v", ["m"]).count() == 0
    df = spark.createDataFrame([(float("-inf"), 1), (0.0, 2), (float("inf"), 4), (None, 8)], "v double, m long")
    assert {r.v: r.before_m for r in ordered.totals_before(df, "v", ["m"]).collect()} == {float("-inf"): 0, 0.0: 1, float("inf"): 3}
