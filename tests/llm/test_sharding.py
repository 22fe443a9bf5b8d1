import zlib
from collections import Counter

from pyspark.sql import functions as F

from newsignal.llm import sharding

EQUAL = {s: 1.0 for s in range(8)}


def shards(df, weights, **more):
    return {r.doc_id: r for r in sharding.assign(df, "doc_id", weights, **more).collect()}


def test_weights_and_moves(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    weights = {0: 1.0, 1: 2.0, 5: 5.0}
    before = shards(df, weights, added={9: 2.0})
    count = Counter(r.shard for r in before.values())
    for s, w in weights.items():
        assert abs(count[s] / 20_000 - w / 8) < 0.015
    after = shards(df, weights | {9: 2.0})
    moved = {k for k in before if before[k].shard != after[k].shard}
    assert {after[k].shard for k in moved} == {9} and abs(len(moved) / 20_000 - 0.2) < 0.015
    assert all(before[k].grown_shard == after[k].shard for k in before)
    less = shards(df, {0: 1.0, 5: 5.0})
    assert all(less[k].shard == before[k].shard for k in before if before[k].shard != 1)


def test_slots_are_gapless_with_many_copies(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 64)
    rows = [(7, "copy")] * 900 + [(i, f"t{i}") for i in range(500)] + [(None, None)] * 3 + [(8, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("hash", F.lit(1)).withColumn("n", F.lit(None).cast("int"))
    placed = sharding.assign(df, "doc_id", EQUAL)
    out = sharding.shard_slots(placed, "doc_id").collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    by_shard = {}
    for r in out:
        by_shard.setdefault(r.shard, []).append(r.slot)
        assert r.hash == 1 and r.n is None
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    again = sharding.shard_slots(placed.repartition(7), "doc_id").collect()
    assert Counter(again) == Counter(out)


def test_query_columns_on_odd_rows(spark, documents, odd_rows, tmp_path):
    from newsignal.llm import queries

    documents(odd_rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = queries.op12_sharding(spark, str(tmp_path)).collect()
    text = {(r[0], r[1]) for r in odd_rows}
    want = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in text}
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == want and len(out) == len(odd_rows)
    assert all(r.grown_shard in (r.shard, 16) for r in out)
    assert len({r.shard for r in out if r.doc_id is None}) == 1


def test_empty_table_and_own_columns(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, shard string, best int")
    out = sharding.assign(empty, "doc_id", EQUAL, added={8: 1.0})
    assert out.count() == 0 and set(out.columns) == {"doc_id", "shard", "best", "grown_shard"}
    assert sharding.shard_slots(out, "doc_id").count() == 0
    df = spark.createDataFrame([(1, "x", 5), (2, "y", 6)], "doc_id long, shard string, best int")
    placed = sharding.assign(df, "doc_id", EQUAL)
    assert {(r.doc_id, r.best) for r in placed.collect()} == {(1, 5), (2, 6)}
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r.doc_id, r.shard) for r in back.collect()} == {(r.doc_id, r.shard) for r in placed.collect()}
