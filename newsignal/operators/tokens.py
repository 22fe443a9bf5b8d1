"""Integer token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.operators.ordered import row_index
from newsignal.session import materialise

HEAD_TERMS = 10_000
HEAD_LENGTH = 100


def token_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, term): lower-case letter runs, 0-based position."""
    parts = F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}]+"), "")
    return df.select(key, F.posexplode(parts).alias("pos", "term"))


def vocabulary(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(term, n, token_id): ids 0.. by falling count, then term.

    Terms are counted once and numbered in ranges of (count, term), so that the
    many terms that occur once, or that begin alike, share no task.
    """
    counts = materialise(token_rows(df, key, text).groupBy("term").agg(F.count("*").alias("n")))
    keyed = counts.withColumn("_rank", F.struct((-F.col("n")).alias("less"), "term"))
    return row_index(keyed, "_rank", "token_id").select("term", "n", "token_id")


def encode(df: DataFrame, vocab: DataFrame, key: str, text: str = "text", head: int = HEAD_TERMS) -> DataFrame:
    """(key, pos, token_id) for every token of every text.

    The `head` most frequent terms of ordinary length, a table of bounded size,
    are broadcast, so that common words are never shuffled. The rest is
    shuffled by term; none of those is frequent.
    """
    ids = vocab.select("term", "token_id")
    in_head = (F.col("token_id") < head) & (F.length("term") <= HEAD_LENGTH)
    common = F.broadcast(ids.where(in_head))
    known = token_rows(df, key, text).join(common, "term", "left")
    rare = (
        known.where("token_id is null")
        .drop("token_id")
        .join(ids.where(~in_head), "term")
    )
    return (
        known.where("token_id is not null")
        .select(key, "pos", "token_id")
        .unionByName(rare.select(key, "pos", "token_id"))
    )
