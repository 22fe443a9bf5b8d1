"""Joins of sentiment and price tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from newsignal.session import materialise

ROWS_PER_SALT = 100_000


def per_day(df: DataFrame) -> DataFrame:
    """Marks a table grouped by `date` for broadcast.

    A date column has under four million values (years 1 to 9999), which bounds
    the table at some 50 MB; real calendars have thousands. Any other key type
    has no such bound and is left to the planner.
    """
    return F.broadcast(df) if isinstance(df.schema["date"].dataType, DateType) else df


def one_per_day(df: DataFrame) -> DataFrame:
    """The rows with a date, marked for broadcast; a second row of a day is an error."""
    twice = F.raise_error(F.concat(F.lit("more than one row for "), F.col("date").cast("string")))
    checked = [F.when(F.count("*") > 1, twice).otherwise(F.max(c)).alias(c) for c in df.columns if c != "date"]
    return per_day(df.where("date is not null").groupBy("date").agg(*checked))


def left_join_series(bars: DataFrame, series: DataFrame | None, name: str, value: str = "value") -> DataFrame:
    """Adds a daily series as column `name`; without a series it is NULL.

    A series has one row per calendar day, so it is broadcast and bars are not
    shuffled; a repeated day is an error.
    """
    if series is None:
        return bars.withColumn(name, F.lit(None).cast("double"))
    return bars.join(one_per_day(series.select("date", F.col(value).alias(name))), "date", "left")


def day_sizes(articles: DataFrame) -> DataFrame:
    """(date, articles): one row per calendar day."""
    return articles.groupBy("date").agg(F.count("*").alias("articles"))


def join_by_day(
    articles: DataFrame,
    stocks: DataFrame,
    key: str,
    sizes: DataFrame | None = None,
    rows_per_salt: int = ROWS_PER_SALT,
) -> DataFrame:
    """Every article of a day with every stock row of that day.

    News days differ in size by orders of magnitude. A day with more than
    `rows_per_salt` articles is cut into salts by article key, and its stock
    rows are repeated once per salt; quiet days keep one salt and nothing is
    repeated. The result is the plain inner join. `sizes` may come from a
    cheaper table with the same days, such as the articles before scoring; days
    it lacks are treated as quiet.
    """
    sizes = day_sizes(articles) if sizes is None else sizes
    salts = F.ceil(F.max("articles") / rows_per_salt).cast("int")
    days = per_day(sizes.groupBy("date").agg(salts.alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    left = (
        articles.join(days, "date", "left")
        .withColumn("_salt", F.pmod(F.xxhash64(key), salts).cast("int"))
        .drop("_salts")
    )
    right = (
        stocks.join(days, "date", "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("_salts")
    )
    return left.join(right, ["date", "_salt"]).drop("_salt")


def join_daily(daily: DataFrame, stocks: DataFrame) -> DataFrame:
    """Stock rows with the aggregated sentiment of their day; no fan-out.

    `daily` has one row per calendar day and is broadcast; a repeated day is an error.
    """
    return stocks.join(one_per_day(daily), "date")


def day_statistics(articles: DataFrame, value: str) -> DataFrame:
    """(date, articles, mean, minimum, maximum, deviation): one row per calendar day.

    Counts the articles with a value; the deviation is that of a sample, NULL for one article.
    """
    v = F.col(value)
    return articles.where("date is not null").groupBy("date").agg(
        F.count(v).alias("articles"),
        F.avg(v).alias("mean"),
        F.min(v).alias("minimum"),
        F.max(v).alias("maximum"),
        F.stddev_samp(v).alias("deviation"),
    )


def join_statistics(articles: DataFrame, stocks: DataFrame, value: str) -> DataFrame:
    """Stock rows with the statistics of the articles they would be paired with.

    The join of every article with every stock row of its day repeats each day's
    articles once per stock row. What a row needs to know of them is the same for
    all stock rows of a day, so it is aggregated once and broadcast; no pair is
    made. Days without articles have no rows, as in the join.
    """
    return join_daily(day_statistics(articles, value), stocks)


def join_moments(articles: DataFrame, stocks: DataFrame, left: Sequence[str], right: Sequence[str]) -> DataFrame:
    """One row of statistics over all pairs of `join_by_day`, without making the pairs.

    pairs; mean_<column> and std_<column> (of the population) for the columns
    `left` of the articles and `right` of the stocks; cov_<l>_<r> for each two of
    them. A pair counts if none of its values is missing.

    A day with n articles and m stock rows has n * m pairs: its left sums count m
    times, its right sums n times, and sums of products are products of sums.
    Two passes over one row per day, the second around the means.
    """

    def per_side(df: DataFrame, columns: Sequence[str], n: str) -> DataFrame:
        sums = [f(c).alias(f"{p}_{c}") for c in columns for p, f in (("s", F.sum), ("q", F.var_pop))]
        return per_day(df.na.drop(subset=["date", *columns]).groupBy("date").agg(F.count("*").alias(n), *sums))

    def day_means(columns: Sequence[str], n: str) -> list[Column]:
        return [(F.col(f"s_{c}") / F.col(n)).alias(f"m_{c}") for c in columns]

    days = per_side(articles, left, "_n").join(per_side(stocks, right, "_m"), "date")
    days = days.select("*", *day_means(left, "_n"), *day_means(right, "_m"), (F.col("_n") * F.col("_m")).alias("_p"))
    days = materialise(days)
    first = days.agg(F.sum("_p"), *[F.sum(F.col(f"m_{c}") * F.col("_p")) for c in (*left, *right)]).first()
    pairs = first[0] or 0
    means = {c: v / pairs if pairs else None for c, v in zip((*left, *right), first[1:])}

    def off(column: str) -> Column:
        return F.col(f"m_{column}") - F.lit(means[column]).cast("double")

    spread = {c: F.sum(F.col("_p") * (F.col(f"q_{c}") + off(c) * off(c))) for c in (*left, *right)}
    return days.agg(
        F.lit(pairs).cast("long").alias("pairs"),
        *[F.lit(means[c]).cast("double").alias(f"mean_{c}") for c in (*left, *right)],
        *[F.sqrt(s / F.sum("_p")).alias(f"std_{c}") for c, s in spread.items()],
        *[(F.sum(F.col("_p") * off(a) * off(b)) / F.sum("_p")).alias(f"cov_{a}_{b}") for a in left for b in right],
    )
