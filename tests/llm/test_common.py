from pyspark.sql import functions as F

from newsignal.llm import common


def test_bitmap_never_misses_a_key(spark, monkeypatch):
    df = spark.range(2000).select("id", F.col("id").cast("string").alias("word"), F.lit(1).alias("bits"))
    keys = spark.range(0, 2000, 7)
    for bits in (1 << 25, 1 << 9):  # the small one rules next to nothing out
        monkeypatch.setattr(common, "BITMAP_BITS", bits)
        marked = common.maybe_in(df, "id", keys, "maybe")
        assert marked.columns == ["id", "word", "bits", "maybe"] and marked.count() == 2000
        assert marked.where("id % 7 = 0 and not maybe").count() == 0
        left = common.without_keys(df, "id", keys)
        assert left.columns == df.columns
        assert sorted(r.id for r in left.collect()) == [i for i in range(2000) if i % 7]


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3), ("b", 3)], "k string, maybe int")
    keys = spark.createDataFrame([("b",), (None,)], "gone string")
    assert sorted(r.maybe for r in common.without_keys(df, "k", keys).collect()) == [1, 2]
    assert common.without_keys(df, "k", keys.limit(0)).count() == 4
    assert common.without_keys(df.limit(0), "k", keys).count() == 0
