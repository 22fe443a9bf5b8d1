"""Quality rules with thresholds taken from mergeable quantile sketches."""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsignal.llm.common import same
from newsignal.session import materialise

SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
REPEAT = 8
LEAST_WORDS = 20
REPEAT_PERCENT = 30

# Measures in thousandths, each with the least spread that the fences allow for.
MEASURES = {
    "word_length": 500,
    "symbols": 50,
    "capitals": 100,
    "repeated": 50,
    "duplicate_lines": 50,
}
# Measures that may also be too low.
TWO_SIDED = ("word_length",)
FENCE = 4
GAMMA = 1.02
LEAST_ROWS = 200


def repeat_words(grams: Column) -> Column:
    """Words inside windows whose hash occurs twice or more in the array of window hashes.

    Windows are sorted with their position, so equal ones are neighbours; the
    lengths that they add are summed in order of position.
    """

    def positions(s: Column) -> Column:
        marked = F.transform(
            s,
            lambda x, i: F.when((x["g"] == F.get(s, i - 1)["g"]) | (x["g"] == F.get(s, i + 1)["g"]), x["p"]),
        )
        return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))

    ordered = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("p"))))
    state = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        same(ordered, "p", positions),
        state,
        lambda a, p: F.struct(
            (p + REPEAT).alias("end"), (a["n"] + p + REPEAT - F.greatest(a["end"], p)).alias("n")
        ),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0).cast("long")).otherwise(covered)


def text_facts(docs: DataFrame) -> DataFrame:
    """`docs` (id, lang, source, text) with counts and the measures, without the text."""
    body = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(body, SPACES), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(WORD))
    split = docs.select("id", "lang", "source", body.alias("text"), words.alias("words"), lines.alias("lines"))

    codes = F.transform("words", lambda w: F.xxhash64(w))
    counted = split.select(
        "id",
        "lang",
        "source",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", ""))).cast("long").alias("n_capitals"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        codes.alias("codes"),
    )
    last = F.size("codes") - (REPEAT - 1)
    grams = F.when(
        last > 0,
        same(
            F.col("codes"),
            "g",
            lambda c: F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(c, i, REPEAT))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    facts = counted.withColumn("grams", grams).withColumn("n_repeat_words", repeat_words(F.col("grams")))

    def per(n: str, of: str) -> Column:
        return F.floor(F.col(n) * 1000 / F.greatest(F.col(of), F.lit(1))).cast("long")

    return facts.drop("codes", "grams").withColumns(
        {
            "word_length": per("word_chars", "n_words"),
            "symbols": per("n_symbols", "n_words"),
            "capitals": per("n_capitals", "n_words"),
            "repeated": per("n_repeat_words", "n_words"),
            "duplicate_lines": per("n_dup_lines", "n_lines"),
        }
    )


def sketches(facts: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n: counts of values in buckets of geometric width.

    A bucket holds values within 1 % of each other, so a quantile read from the
    counts is off by 1 % at most, and two sketches merge by adding counts.
    """
    measure = F.explode(
        F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in MEASURES])
    )
    bucket = F.when(F.col("m.value") > 0, F.ceil(F.log(F.col("m.value")) / log(GAMMA))).otherwise(-1).cast("int")
    return (
        facts.select("lang", "source", measure.alias("m"))
        .groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket.alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, rows, low, high from the quartiles of the sketch merged over `keys`."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")
    upto = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("bucket") < 0, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (1 + GAMMA))
    ranked = merged.select(*keys, "measure", value.alias("value"), upto.alias("upto"), F.sum("n").over(group).alias("rows"))

    def quantile(q: float) -> Column:
        return F.min(F.when(F.col("upto") >= F.col("rows") * q, F.col("value")))

    found = ranked.groupBy(*keys, "measure").agg(
        F.max("rows").alias("rows"), quantile(0.25).alias("q1"), quantile(0.75).alias("q3")
    )
    least = reduce(lambda c, m: F.when(F.col("measure") == m, MEASURES[m]).otherwise(c), MEASURES, F.lit(None))
    width = FENCE * F.greatest(F.col("q3") - F.col("q1"), least)
    return found.select(*keys, "measure", "rows", (F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))


def thresholds(sketch: DataFrame, least_rows: int) -> DataFrame:
    """lang, source, measure, low, high.

    A group of fewer than `least_rows` rows takes the fences of its language,
    a language of fewer those of all rows.
    """
    own = fences(sketch, ["lang", "source"]).alias("o")
    lang = fences(sketch, ["lang"]).alias("l")
    every = fences(sketch, []).alias("e")
    joined = own.join(
        lang, F.expr("o.lang <=> l.lang and o.measure = l.measure"), "left"
    ).join(every, F.expr("o.measure = e.measure"), "left")

    def pick(c: str) -> Column:
        return (
            F.when(F.col("o.rows") >= least_rows, F.col(f"o.{c}"))
            .when(F.col("l.rows") >= least_rows, F.col(f"l.{c}"))
            .otherwise(F.col(f"e.{c}"))
        )

    return joined.select("o.lang", "o.source", "o.measure", pick("low").alias("low"), pick("high").alias("high"))


def quality_rules(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    least_rows: int = LEAST_ROWS,
) -> DataFrame:
    """One row per row of `docs`: the counts, base_failed, kept, failed_rules.

    A document fails the base rule with fewer than 20 words or with more than
    30 % of its words in repeated windows of 8. The others are measured: mean
    word length, symbols and capitals per word, repeated words, repeated lines.
    For each language and source the quartiles of each measure are read from
    sketches; a document is dropped where a measure lies outside the quartiles
    by more than `FENCE` times their distance (at least the spread in
    MEASURES). `failed_rules` names the measures, in order.

    NULL and empty texts have no words and fail the base rule. NULL languages
    and sources are groups of their own. Repeated rows each get their row.
    Windows are compared by 64-bit hashes of their words.
    """
    plain = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text")
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    facts = materialise(text_facts(plain).withColumn("base_failed", failed))
    sketch = materialise(sketches(facts.where("not base_failed")))
    limits = thresholds(sketch, least_rows)
    wide = materialise(
        limits.groupBy("lang", "source").agg(
            *[F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in MEASURES for c in ("low", "high")]
        )
    )
    broken = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col(m) > F.col(f"{m}_high")) | (F.col(m) < F.col(f"{m}_low") if m in TWO_SIDED else F.lit(False)),
                    F.lit(m),
                )
                for m in MEASURES
            ]
        )
    )
    joined = facts.alias("f").join(wide.alias("w"), F.expr("f.lang <=> w.lang and f.source <=> w.source"), "left")
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size(broken) == 0)).alias("kept"),
        F.when(F.col("base_failed"), F.lit("")).otherwise(F.array_join(broken, ",")).alias("failed_rules"),
    )
