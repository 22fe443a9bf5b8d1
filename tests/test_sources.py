import csv
import os
import time
import uuid
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from newsignal.functions import html
from newsignal.operators import cleaning
from newsignal.sources import files, sinks


def write_csv(path, header, *rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f).writerows([header, *rows])


def test_article_files(spark, tmp_path):
    texts = ['two\nlines, "quoted"\r\nand ""more""', "", "None", "ü plain", " padded "]
    for i, t in enumerate(texts):
        write_csv(tmp_path / f"a%{i},?=<UDIV>text.csv", ["Date", "Text"], ["2016-02-26", t])
    (tmp_path / "notes.txt").write_text("not an article")
    out = files.read_articles(spark, str(tmp_path))
    assert out.count() == 5
    got = {r.text for r in out.collect()}
    assert got == {None, *[t for t in texts if t]} or {g.replace("\r\n", "\n") if g else g for g in got} == {
        None, *[t.replace("\r\n", "\n") for t in texts if t]
    }
    assert {r.date for r in out.collect()} == {date(2016, 2, 26)}


def test_bar_files(spark, tmp_path):
    header = ["Date", "Open", "High", "Low", "Close", "Volume", "Ticker"]
    write_csv(tmp_path / "AA.csv", header, ["2024-01-02", 1, 2, 0.5, 1.5, 10, "AA"], ["2024-01-03", 1, 2, 0.5, "x", 10, "AA"])
    write_csv(tmp_path / "BB.csv", header, ["2024-01-02", 1, 2, 0.5, 2.5, 10, "BB"])
    out = cleaning.clean_bars(files.read_bars(spark, str(tmp_path)))
    assert sorted((r.ticker, r.close) for r in out.collect()) == [("AA", 1.5), ("BB", 2.5)]


def test_bar_columns_are_found_by_name(spark, tmp_path):
    header = ["Volume", "Ticker", "Close", "Date", "Open", "High", "Low", "Adj"]
    write_csv(tmp_path / "AA.csv", header, [10, "AA", 1.5, "2024-01-02", 1, 2, 0.5, 9])
    row = files.read_bars(spark, str(tmp_path)).first()
    assert tuple(row) == ("2024-01-02", "1", "2", "0.5", "1.5", "10", "AA")


def test_files_with_different_headers(spark, tmp_path):
    write_csv(tmp_path / "a.csv", ["Date", "Close", "High", "Low", "Open", "Ticker"], ["2024-01-02", 1, 2, 3, 4, "A"])
    write_csv(tmp_path / "b.csv", ["Date", "Open", "High", "Low", "Close", "Ticker"], ["2024-01-02", 5, 6, 7, 8, "B"])
    write_csv(tmp_path / "c.csv", ["ticker", "VOLUME", "Adj Close", "date"], ["C", 9, 10, "2024-01-03"], ["D", 11, 12, "2024-01-04"])
    write_csv(tmp_path / "d.csv", ["Date", "Open", "High", "Low", "Close", "Ticker"])
    (tmp_path / "empty.csv").write_text("")
    rows = sorted(tuple(r) for r in files.read_bars(spark, str(tmp_path)).select("ticker", "open", "close", "volume", "date").collect())
    assert rows == [
        ("A", "4", "1", None, "2024-01-02"), ("B", "5", "8", None, "2024-01-02"),
        ("C", None, None, "9", "2024-01-03"), ("D", None, None, "11", "2024-01-04"),
    ]
    assert len(files.files_by_header(spark, str(tmp_path))) == 3
    whole = files.read_csvs(spark, str(tmp_path))
    assert set(whole.columns) == {"date", "open", "high", "low", "close", "ticker", "volume", "adj close"}
    write_csv(tmp_path / "e.csv", ["Date", "date"], [1, 2])
    with pytest.raises(ValueError, match="repeated"):
        files.read_bars(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no file"):
        files.read_csvs(spark, str(tmp_path / "empty.csv"))


def test_archive_members_are_partitions_and_read_as_streams(spark, tmp_path, monkeypatch):
    from newsignal.sources import archives

    line = "\t".join(["{day}", "x", "x", "x", "Texas;{n}", *"pondu", "http://a.com/{n}"])
    for day in ("20160226", "20160227", "20160228"):
        with zipfile.ZipFile(tmp_path / f"{day}.gkg.csv.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("folder/", "")
            for part in range(2):
                with z.open(f"folder/{part}.csv", "w") as member:
                    for n in range(2500):
                        member.write((line.format(day=day, n=part * 2500 + n) + "\r\n").encode())
    (tmp_path / "other.txt").write_text("x")
    index = files.read_zipped_index(spark, str(tmp_path))
    assert index.count() == 15_000 and index.rdd.getNumPartitions() == 6
    assert index.select("locations").distinct().count() == 5000
    two = files.read_zipped_index(spark, str(tmp_path), start="20160227", stop="20160228")
    assert {r.date for r in two.select("date").distinct().collect()} == {"20160227"} and two.rdd.getNumPartitions() == 2
    one = files.read_zipped_index(spark, str(tmp_path / "20160226.gkg.csv.zip"), {10: "u", 20: "none"} | {0: "date"})
    assert one.columns == ["u", "none", "date"] and one.where("none is null and u is not null").count() == 5000
    monkeypatch.setattr(archives, "ROWS_PER_BATCH", 100)
    reader = archives.MemberReader({"path": str(tmp_path)}, {0: "date", 10: "url"})
    batches = reader.read(reader.partitions()[0])
    first = next(batches)
    assert first.num_rows == 100 and first.column(1)[99].as_py() == "http://a.com/99"
    assert sum(b.num_rows for b in batches) == 2400


def test_index_rows_without_address_stay(spark):
    rows = [("20160226", "Texas", None), ("20160226", "Iowa", "http://a.com<UDIV>http://b.com")]
    out = files.combine_index(spark.createDataFrame(rows, "date string, locations string, source_urls string"))
    assert sorted((r.locations, r.url or "", r.domain or "") for r in out.collect()) == [
        ("Iowa", "http://a.com", "a.com"), ("Iowa", "http://b.com", "b.com"), ("Texas", "", "")
    ]


def test_a_day_can_be_written_again(spark, tmp_path):
    df = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 1, 2))], "id int, date date")
    sinks.write_parquet(df, str(tmp_path / "days"))
    sinks.write_parquet(df.where("id = 2").withColumn("id", F.lit(9)), str(tmp_path / "days"), days_only=True)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "days")).collect()) == [1, 9]
    sinks.write_parquet(df.where("id = 2"), str(tmp_path / "days"))
    assert [r.id for r in spark.read.parquet(str(tmp_path / "days")).collect()] == [2]


def test_bucketed_tables_join_without_exchange(spark, tmp_path):
    spark.sql(f"create database if not exists bucketed location '{tmp_path}/db'")
    df = spark.range(1000).select((F.col("id") % 17).cast("string").alias("ticker"), F.col("id").alias("day"))
    try:
        sinks.write_bucketed(df, "bucketed.one", "ticker", "day", 4)
        sinks.write_bucketed(df.withColumn("x", F.col("day") * 2), "bucketed.two", "ticker", "day", 4)
        one, two = spark.table("bucketed.one"), spark.table("bucketed.two")
        rows = one.groupBy("ticker").agg(F.count("*").alias("n"))
        joined = rows.hint("merge").join(two.groupBy("ticker").agg(F.sum("x").alias("x")), "ticker")
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in text and "SortMergeJoin" in text
        assert joined.agg(F.sum("x")).first()[0] == 999 * 1000
    finally:
        spark.sql("drop database bucketed cascade")


def test_zipped_index_keeps_quotes_and_rows_without_date(spark, tmp_path):
    lines = ["\t".join(["20160226", "1", "c", "t", '"Texas', *"pondu", "http://a.com/1"]), "\t".join(["", *["x"] * 9, "http://b.com/2"])]
    with zipfile.ZipFile(tmp_path / "day.zip", "w") as z:
        z.writestr("day.csv", "\n".join(lines))
    rows = {r.source_urls: r.locations for r in files.read_zipped_index(spark, str(tmp_path)).collect()}
    assert rows == {"http://a.com/1": '"Texas', "http://b.com/2": "x"}


def test_zipped_index(spark, tmp_path):
    for day in ("20160226", "20160227"):
        lines = ["\t".join(["DATE", *[f"h{i}" for i in range(1, 11)]])]
        for n in range(3):
            fields = [day, "1", "c", "t", f"Texas;{n}", "p", "o", "tone", "cameo", "s", f"http://a.com/{n}<UDIV>https://www.b.org/{day}"]
            lines.append("\t".join(fields))
        with zipfile.ZipFile(tmp_path / f"{day}.index.csv.zip", "w") as z:
            z.writestr(f"{day}.csv", "\n".join(lines) + "\n")
    index = files.read_zipped_index(spark, str(tmp_path))
    assert index.count() == 6 and index.columns == ["date", "locations", "source_urls"]
    combined = files.combine_index(index)
    assert combined.count() == 12
    assert {r.domain for r in combined.collect()} == {"a.com", "b.org"}
    assert {r.date for r in combined.collect()} == {date(2016, 2, 26), date(2016, 2, 27)}
    assert cleaning.keep_any_of(combined, "locations").count() == 12
    keys = {(r.url, r.url_key) for r in combined.collect()}
    assert len({k for _, k in keys}) == len({u for u, _ in keys}) == 5


def test_fetch_turns_failures_into_rows(spark):
    def fetcher(url):
        if "slow" in url:
            raise TimeoutError("too slow")
        return (404, "") if "gone" in url else (200, f"<p> {url} </p><p>end</p>")

    urls = spark.createDataFrame([("http://ok",), ("http://gone",), ("http://slow",), ("http://ok2",)], "url string")
    pages = files.fetch_outcome(files.fetch_pages(urls, fetcher))
    tally = {r.outcome: r["count"] for r in pages.groupBy("outcome").count().collect()}
    assert tally == {"Success": 2, "Failed: 404": 1, "Error: too slow": 1}
    texts = pages.where("status = 200").select(html.article_text(F.col("html")).alias("t"))
    assert {r.t for r in texts.collect()} == {"http://ok end", "http://ok2 end"}


def test_fetch_keeps_the_other_columns(spark):
    urls = spark.createDataFrame([("http://ok", date(2024, 1, 1)), ("http://ok", date(2024, 1, 2))], "link string, date date")
    pages = files.fetch_pages(urls, lambda url: (200, "x"), "link").collect()
    assert sorted((r.url, r.status, r.html, r.error, r.date) for r in pages) == [
        ("http://ok", 200, "x", None, date(2024, 1, 1)), ("http://ok", 200, "x", None, date(2024, 1, 2))
    ]
    with pytest.raises(ValueError):
        files.fetch_pages(urls.withColumn("html", F.lit("")), None, "link")


def test_slow_pages_of_a_task_overlap(spark, tmp_path):
    log = str(tmp_path)

    def fetcher(url):
        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{time.time()} ")
            time.sleep(1)
            f.write(f"{time.time()} {url}")
        return 200, url

    urls = spark.range(12).select(F.concat(F.lit("u"), "id").alias("url"), "id").coalesce(1)
    rows = files.fetch_pages(urls, fetcher, at_once=6).collect()
    assert [(r.url, r.html, r.id) for r in rows] == [(f"u{i}", f"u{i}", i) for i in range(12)]
    spans = [p.read_text().split() for p in tmp_path.iterdir()]
    first, last = min(float(s[0]) for s in spans), max(float(s[1]) for s in spans)
    assert len(spans) == 12 and last - first < 6
    inside = [sum(float(a) <= float(s[0]) < float(b) for a, b, _ in spans) for s in spans]
    assert max(inside) <= 6


def test_a_repeated_address_is_fetched_once(spark, tmp_path):
    log = str(tmp_path)

    def fetcher(url):
        open(f"{log}/{uuid.uuid4().hex}", "w").close()
        if url == "bad":
            raise OSError("gone")
        return 200, f"page of {url}"

    named = spark.range(1003).select("id", F.when(F.col("id") < 1000, "hot").when(F.col("id") == 1000, "bad").when(F.col("id") == 1001, "x").alias("link"))
    pages = files.fetch_once(named, fetcher, "link")
    assert pages.columns == ["url", "status", "html", "error", "id"]
    assert pages.count() == 1003 and pages.where("html = 'page of hot'").count() == 1000
    assert len(list(tmp_path.iterdir())) == 3
    rest = {r.id: (r.url, r.status, r.html, r.error) for r in pages.where("id >= 1000").collect()}
    assert rest == {1000: ("bad", None, None, "gone"), 1001: ("x", 200, "page of x", None), 1002: (None, None, None, None)}
    assert files.fetch_once(named.limit(0), fetcher, "link").count() == 0


def test_parquet_round_trip_and_file_names(spark, tmp_path):
    df = spark.createDataFrame([(1, date(2024, 1, 1)), (2, date(2024, 1, 2))], "id int, date date")
    sinks.write_parquet(df, str(tmp_path / "by_day"))
    assert sorted(os.listdir(tmp_path / "by_day"))[-2:] == ["date=2024-01-01", "date=2024-01-02"]
    back = spark.read.parquet(str(tmp_path / "by_day"))
    assert sorted(back.select(*df.columns).collect()) == sorted(df.collect())
    pruned = back.where("date = date'2024-01-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in pruned
    sinks.write_parquet(df, str(tmp_path / "flat"), by=None)
    names = files.read_parquet(spark, str(tmp_path / "flat"))
    assert all(r.file_stem.startswith("part-") and not r.file_stem.endswith(".parquet") for r in names.collect())
    assert files.read_parquet(spark, str(tmp_path / "flat"), drop_names_like="part-").count() == 0


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("AA", 'say "hi", ok'), ("BB", "plain")], "ticker string, note string")
    sinks.write_csv(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.select("ticker", "note").collect()) == sorted(tuple(r) for r in df.collect())


def test_spread_only_when_splits_are_few(spark):
    slots = spark.sparkContext.defaultParallelism
    few, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, slots)
    assert files.spread(few, "id").rdd.getNumPartitions() == slots
    assert files.spread(many, "id") is many


def test_positions(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert files.select_positions(df, {2: "x", 0: "y"}).columns == ["x", "y"]
    with pytest.raises(IndexError):
        files.select_positions(df, {9: "x"})
