"""Readers."""

from __future__ import annotations

import csv
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from newsignal.functions.text import compact_day, domain, split_urls, url_key
from newsignal.schemas import ARTICLE, FETCHED_PAGE, INDEX_COLUMNS, RAW_BAR
from newsignal.session import materialise
from newsignal.sources.archives import IndexArchives


def read_articles(spark: SparkSession, *paths: str) -> DataFrame:
    """Article CSVs: header, quoted text with line breaks and doubled quotes."""
    return (
        spark.read.schema(ARTICLE)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("pathGlobFilter", "*.csv")
        .csv(list(paths))
    )


def files_by_header(spark: SparkSession, *paths: str, pattern: str = "*.csv") -> dict[str, list[str]]:
    """The files of each header line. Files are listed here, as Spark itself lists them; rows are not."""
    lines = (
        spark.read.option("pathGlobFilter", pattern)
        .text(list(paths))
        .select("value", "_metadata.file_path", F.monotonically_increasing_id().alias("place"))
        .where(F.col("_metadata.file_block_start") == 0)
    )
    first = lines.groupBy("file_path").agg(F.min_by("value", "place").alias("header"))
    groups = first.groupBy("header").agg(F.array_sort(F.collect_list("file_path")).alias("files"))
    return {r["header"]: r["files"] for r in groups.collect()}


def read_csvs(spark: SparkSession, *paths: str, pattern: str = "*.csv") -> DataFrame:
    """CSV files with headers as one table of text columns, whatever columns each file has, in any order.

    Files are read in one scan per header line and united by name in small
    letters; a column that a file lacks is NULL. Names that differ in case only
    are an error within a file. Files without a row and without a header have no
    rows; without any file with a header there is no table to return, an error.
    """
    named = []
    for header, files in sorted(files_by_header(spark, *paths, pattern=pattern).items()):
        small = [c.strip().lower() or f"_c{i}" for i, c in enumerate(next(csv.reader([header])))]
        if len(set(small)) < len(small):
            raise ValueError(f"repeated column names: {header}")
        named.append(spark.read.option("header", True).option("escape", '"').csv(files).toDF(*small))
    if not named:
        raise ValueError(f"no file with a header in {paths}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def read_bars(spark: SparkSession, *paths: str) -> DataFrame:
    """Price CSVs as text columns, for `operators.cleaning.clean_bars`.

    Columns are found by the names in each file's own header, whatever their case
    and order; see `read_csvs`. A column that no file has is NULL.
    """
    named = read_csvs(spark, *paths)
    missing = F.lit(None).cast("string")
    return named.select(
        *[(F.col(f.name) if f.name in named.columns else missing).alias(f.name) for f in RAW_BAR]
    )


def read_parquet(spark: SparkSession, *paths: str, drop_names_like: str | None = None) -> DataFrame:
    """Parquet files as one table with `file_stem`, the file name without suffix.

    `drop_names_like` leaves out files whose name contains the text.
    """
    table = spark.read.parquet(*paths).withColumn("_file", F.col("_metadata.file_name"))
    if drop_names_like:
        table = table.where(~F.col("_file").contains(drop_names_like))
    return table.withColumn("file_stem", F.regexp_replace("_file", r"\.parquet$", "")).drop("_file")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Input with fewer splits than task slots, redistributed by a unique key.

    Meant for text work on a freshly read table. Large inputs have more splits
    than slots and pass unchanged; a few big files would leave slots idle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots, key)


def select_positions(df: DataFrame, names: dict[int, str]) -> DataFrame:
    """Keeps and names columns by position."""
    return df.select(*[F.col(df.columns[i]).alias(n) for i, n in names.items()])


def read_zipped_index(
    spark: SparkSession, path: str, keep: dict[int, str] = INDEX_COLUMNS, start: str | None = None, stop: str | None = None
) -> DataFrame:
    """Daily index archives: every member is a tab-separated file without header.

    Each member is a partition of its own and is inflated as a stream, so neither
    the archive nor a member has to fit into memory. Quotation marks are plain
    characters. `start` and `stop` (YYYYMMDD, half-open) skip archives by the day
    in their names. A leading line of column names is removed by value; rows
    without a date stay.
    """
    spark.dataSource.register(IndexArchives)
    reader = spark.read.format("index_archives").option("columns", ",".join(f"{i}:{n}" for i, n in keep.items()))
    for name, day in (("start", start), ("stop", stop)):
        if day is not None:
            reader = reader.option(name, day)
    return without_header(reader.load(path))


def without_header(index: DataFrame) -> DataFrame:
    """Removes lines of column names by value; a line's place says nothing in a table."""
    return index.where("date is null or upper(date) <> 'DATE'")


def combine_index(index: DataFrame) -> DataFrame:
    """(date, url, locations, domain, url_key): one row per URL of each index row.

    Rows without a URL stay, with NULL url, domain and key.
    """
    return index.select(
        compact_day(F.col("date")).alias("date"),
        F.explode_outer(split_urls(F.col("source_urls"))).alias("url"),
        "locations",
    ).withColumns({"domain": domain(F.col("url")), "url_key": url_key(F.col("url"))})


# A fetcher maps one URL to (status, html).
Fetcher = Callable[[str], tuple[int, str]]


def fetch_pages(urls: DataFrame, fetcher: Fetcher, url: str = "url", at_once: int = 8) -> DataFrame:
    """Fetches every URL in parallel tasks; failures become rows, not errors.

    A task waits for up to `at_once` pages at a time, so `fetcher` must be safe to
    call from several threads; it hands on pages as they come and holds no more
    than twice that many. A URL that several rows name is fetched for each; see
    `fetch_once`. NULL is not fetched: its status, html and error are NULL.

    Other columns of `urls`, such as the date, follow url, status, html and error,
    whose names they must not use.
    """
    carried = [c for c in urls.columns if c != url]
    if clash := set(carried) & set(FETCHED_PAGE.names):
        raise ValueError(f"columns named like the result: {sorted(clash)}")

    def visit(link: str | None) -> tuple[int | None, str | None, str | None]:
        if link is None:
            return None, None, None
        try:
            status, html = fetcher(link)
            return status, html, None
        except Exception as error:  # noqa: BLE001 - every failure is a result row
            return None, None, str(error)

    named = urls.select(F.col(url).alias("url"), *carried)
    schema = T.StructType([*FETCHED_PAGE, *[named.schema[c] for c in carried]])
    arrow = to_arrow_schema(schema)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rows = (row for batch in batches for row in batch.to_pylist())
        with ThreadPoolExecutor(at_once) as pool:
            waiting: deque = deque()
            while True:
                for row in islice(rows, 2 * at_once - len(waiting)):
                    waiting.append((row, pool.submit(visit, row["url"])))
                if not waiting:
                    return
                row, page = waiting.popleft()
                yield row | dict(zip(("status", "html", "error"), page.result(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = visits(batches)
        while some := list(islice(done, at_once)):
            yield pa.RecordBatch.from_pylist(some, schema=arrow)

    return named.mapInArrow(run, schema)


def fetch_once(urls: DataFrame, fetcher: Fetcher, url: str = "url", at_once: int = 8) -> DataFrame:
    """Every row of `urls` with its page, each different URL being fetched once.

    Columns are those of `fetch_pages`. The pages are written before they are
    joined back, so that no later action fetches anything again. Rows without a
    URL stay, without a page.
    """
    carried = [c for c in urls.columns if c != url]
    if clash := set(carried) & set(FETCHED_PAGE.names):
        raise ValueError(f"columns named like the result: {sorted(clash)}")
    named = urls.select(F.col(url).alias("url"), *carried)
    distinct = named.where("url is not null").select("url").distinct()
    pages = materialise(fetch_pages(distinct, fetcher, at_once=at_once))
    return named.join(pages, "url", "left").select(*FETCHED_PAGE.names, *carried)


def fetch_outcome(pages: DataFrame) -> DataFrame:
    """Adds `outcome`: Success, Failed: <status> or Error: <text>."""
    failed = F.concat(F.lit("Failed: "), F.col("status").cast("string"))
    return pages.withColumn(
        "outcome",
        F.when(F.col("error").isNotNull(), F.concat(F.lit("Error: "), F.col("error")))
        .when(F.col("status") == 200, "Success")
        .otherwise(failed),
    )
