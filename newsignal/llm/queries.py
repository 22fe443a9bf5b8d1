"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.llm import (
    chat,
    decontaminate,
    importance,
    language,
    lexical_search,
    line_dedup,
    mixing,
    near_dups,
    pii,
    quality,
    sharding,
    sql,
    vector_codes,
    warc,
)
from newsignal.llm.common import table
from newsignal.session import materialise


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = warc.write_archives(table(spark, sf_dir, "pages"), warc.new_folder(spark))
    records = warc.checked(warc.read_archives(written))

    def page(name: str):
        return F.regexp_extract(name, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")

    return records.select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
    )


def op4_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean labelled documents are the target; as many are sampled as are of good quality by the labels."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    good = labels.agg(F.avg((F.col("quality") == 1).cast("int"))).first()[0]
    target = labels.where("quality = 1 and coalesce(toxic, 0) = 0")
    return importance.importance_sample(table(spark, sf_dir, "documents"), target, good or 0.0)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontaminate.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        count("email"),
        count("ip"),
        count("card"),
        count("phone"),
        F.sha2(pii.spans_text(base), 256).alias("base_sha256"),
        pii.spans_text(F.col("spans")).alias("spans"),
    )


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = language.fold(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) == 1
    model = language.train(docs.where(~held_out))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        "language.lang_pred",
        "language.score",
        "language.rejected",
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", "text")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], turns.schema)
    turns = turns.unionByName(added).withColumn("parts", chat.text_parts(F.col("text")))
    return chat.digests(chat.format_turns(turns)).withColumnRenamed("conv", "conv_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    coded, books = vector_codes.vector_codes(vectors)
    totals = vector_codes.with_group_total(materialise(coded), "label", "error", "label_error")
    return totals.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    placed = sharding.assign(docs, "doc_id", {s: 1.0 for s in range(16)}, added={16: 1.0})
    text = F.coalesce("text", F.lit(""))
    rows = placed.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "shard",
        "grown_shard",
    )
    slots = sharding.shard_slots(rows, "doc_id")
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical_search.build_index(table(spark, sf_dir, "documents"))
    return lexical_search.search(index, table(spark, sf_dir, "benchmark"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_mix_sources": op2_mix_sources,
        "op3_warc": op3_warc,
        "op4_importance_resampling": op4_importance_resampling,
        "op5_decontaminate": op5_decontaminate,
        "op6_near_duplicates": op6_near_duplicates,
        "op7_pii": op7_pii,
        "op8_language_id": op8_language_id,
        "op9_line_dedup": op9_line_dedup,
        "op10_chat_format": op10_chat_format,
        "op11_vector_codes": op11_vector_codes,
        "op12_sharding": op12_sharding,
        "op13_lexical_search": op13_lexical_search,
    }


def oracle() -> dict[str, str]:
    return {
        "op1_quality_rules": sql.QUALITY,
        "op2_mix_sources": sql.mixing(
            mixing.TOPICS, mixing.OTHER, {"source": 0.7, "lang": 0.8, "topic": 0.9}, 0.5, 25, "mix"
        ),
        "op3_warc": sql.WARC,
        "op5_decontaminate": sql.DECONTAMINATE,
        "op9_line_dedup": sql.LINES,
        "op10_chat_format": sql.CHAT,
        "op11_vector_codes": sql.vector_codes(parts=16, entries=64, rounds=2),
        "op12_sharding": sql.sharding(shards=16),
        "op13_lexical_search": sql.SEARCH,
    }
