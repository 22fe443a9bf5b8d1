from datetime import date

from pyspark.sql import functions as F

from newsignal.operators import cleaning

D = date(2024, 1, 1)


def test_clean_articles(spark):
    rows = [
        (1, D, "good text"),
        (2, D, "good text"),
        (3, date(2024, 1, 2), "good text"),
        (4, D, ""),
        (5, D, "None"),
        (6, D, None),
        (7, None, "no date"),
        (8, D, "403 forbidden"),
        (9, D, "Forbidden is fine"),
        (10, D, "  \n"),
        (11, D, "  padded "),
        (12, D, "x" * 10_005),
        (13, D, " " * 10_000 + "late"),
    ]
    df = spark.createDataFrame(rows, "id int, date date, text string")
    out = {r.id: r for r in cleaning.clean_articles(df, "id").collect()}
    assert sorted(out) == [1, 3, 9, 11, 12, 13]
    assert out[13].trimmed_text == "" and out[13].text.endswith("late")
    assert out[11].trimmed_text == "padded" and out[11].text == "  padded "
    assert len(out[12].trimmed_text) == 10_000 and len(out[12].text) == 10_005
    assert {r.exception_flag for r in out.values()} == {0}


def test_dedupe_hot_copies_and_nulls(spark):
    copies = spark.range(3000).select("id", F.lit("a").alias("k"), F.lit("same").alias("text"))
    rest = spark.createDataFrame([(5000, "a", None), (5001, "a", None), (5002, "b", "same")], "id long, k string, text string")
    once = cleaning.dedupe(copies.unionByName(rest), "id", wide=["text"])
    assert sorted(once.collect()) == sorted(cleaning.dedupe(once, "id", wide=["text"]).collect())
    assert sorted(r.id for r in once.collect()) == [0, 5000, 5002]


def test_date_flags(spark):
    names = ["20160225.a.zip", "20160226.a.zip", "20180101.a.zip", "20221110.a.zip", "index"]
    df = spark.createDataFrame([(n,) for n in names], "text string")
    out = cleaning.date_flags(df, "2016-02-26", "2022-11-10", "2017-10-31").orderBy("date").collect()
    assert [(r.text[:8], r.recent, r.before_late, r.before_stop) for r in out] == [
        ("20160226", 1, 1, 1),
        ("20180101", 1, 0, 1),
    ]


def test_clean_bars(spark):
    rows = [
        ("2024-01-02 00:00:00-05:00", "1", "2", "0.5", "1.5", "100.0", "AA"),
        ("2024-01-03", "1", "2", "0.5", "n/a", "100", "AA"),
        ("2024-01-03", "x", "2", "0.5", "7", None, "AA"),
        ("2024-01-02", "1", "2", "0.5", "1.5", "100", "BRK.B"),
    ]
    df = spark.createDataFrame(rows, "date string, open string, high string, low string, close string, volume string, ticker string")
    out = cleaning.clean_bars(df).orderBy("date").collect()
    assert [(r.date, r.open, r.close, r.volume) for r in out] == [
        (date(2024, 1, 2), 1.0, 1.5, 100),
        (date(2024, 1, 3), None, 7.0, None),
    ]


def test_small_operators(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "Ohio")], "id int, place string")
    assert cleaning.null_profile(df).first().asDict() == {"row_count": 3, "id_nulls": 0, "place_nulls": 1}
    assert [r.id for r in cleaning.keep_any_of(df, "place").collect()] == [3]
    assert [r.id for r in cleaning.latest(df, 2, "id").collect()] == [3, 2]
    assert [r.id for r in cleaning.page(df, 1, 1, "id").collect()] == [2]
    union = cleaning.union_all(df, df.select("id"), df.withColumn("x", F.lit(1)))
    assert union.count() == 9 and union.columns == ["id", "place", "x"]
    assert union.drop("absent").columns == union.columns
    assert len(set(cleaning.US_PLACES)) == 53


def test_days_before_today(spark):
    df = spark.sql("select date_sub(current_date(), d) as date, d from values (0), (10), (11), (-3), (null) t(d)")
    assert sorted(r.d for r in cleaning.since_days(df, 10).collect()) == [-3, 0, 10]
