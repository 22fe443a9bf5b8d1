"""Documents to training text, stage by stage.

A stage gets the documents that its predecessor kept and returns the columns of
its input; the last one adds what it knows about the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.llm import decontaminate, language, line_dedup, mixing, near_dups
from newsignal.llm.common import table, unused
from newsignal.session import materialise


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that language identification rejects.

    The model learns from labelled documents outside the held-out third.
    """
    held_out = language.fold(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) == 1
    model = language.train(docs.where(~held_out))
    found = unused(docs, "language")
    return language.identify(docs, model, out=found).where(~F.col(f"{found}.rejected")).drop(found)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts lines of recurring templates out of the texts and corrects n_chars; every document stays."""
    n_lines, n_dropped = unused(docs, "n_lines"), unused(docs, "n_dropped")
    cut = line_dedup.drop_recurring_lines(docs, n_lines=n_lines, n_dropped=n_dropped)
    length = F.when(F.col(n_dropped) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).drop(n_lines, n_dropped)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words, similarity 0.8."""
    return near_dups.without_near_duplicates(docs, "doc_id", "text")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a window of a benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents so that tokens follow the targets for source, language and topic."""
    return mixing.mix(docs, sampled_rows=True)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_recurring_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

# The first stage predicts with a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
