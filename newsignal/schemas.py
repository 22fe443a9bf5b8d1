"""Explicit schemas; no source infers types."""

from pyspark.sql import types as T

ARTICLE = T.StructType(
    [T.StructField("date", T.DateType()), T.StructField("text", T.StringType())]
)

# Price files arrive as text and are repaired by `operators.cleaning.clean_bars`.
RAW_BAR = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("date", "open", "high", "low", "close", "volume", "ticker")
    ]
)

# Positions of the three columns kept from a headerless daily index file.
INDEX_COLUMNS = {0: "date", 4: "locations", 10: "source_urls"}

COMBINED = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("url", T.StringType()),
        T.StructField("locations", T.StringType()),
        T.StructField("domain", T.StringType()),
    ]
)

FETCHED_PAGE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("html", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)

SCORE = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]
)
