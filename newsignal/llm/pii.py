"""Personal data: patterns, and terms whose co-occurrence reveals the entities found by them."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.llm.common import unused
from newsignal.session import materialise

KINDS = ("email", "ip", "card", "phone", "remove", "generalise")

# The patterns, in forms that read each character a bounded number of times.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TERM = re.compile(r"\w{3,}")

WINDOW_WORDS = 10
HELD_TERMS = 300_000


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        value = int(d) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """A local part ends at an @; it starts where its characters or the last match end."""
    last = 0
    for found in DOMAIN.finditer(text):
        start = found.start()
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < found.start():
            yield start, found.end()
            last = found.end()


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for found in IP.finditer(text):
        parts = [p.lstrip("0") for p in found[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield found.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for found in CARD.finditer(text):
        digits = re.sub("[ -]", "", found[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield found.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for found in PHONE.finditer(text):
        if 8 <= len(re.sub("[^0-9]", "", found[0])) <= 15:
            yield found.span()


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones}
# A text without the character has no match.
NEEDED = {"email": "@", "phone": "+", "ip": "."}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans by kind as listed, then start."""
    return [
        (kind, start, end)
        for kind, find in FINDERS.items()
        if NEEDED.get(kind, "") in text
        for start, end in find(text)
    ]


def entity(kind: str, found: str) -> str:
    """What is the same for all ways to write one entity."""
    return f"{kind}:" + (found.lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", found))


def contexts(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    """entity, term, start, end for the terms next to each entity that lie in no span themselves.

    The terms of the text and the merged spans are sorted once and looked up by
    bisection, so a text with many entities takes time in proportion to them.
    """
    cover: list[list[int]] = []
    for start, end in sorted((s, e) for _, s, e in spans):
        if cover and start < cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], end)
        else:
            cover.append([start, end])
    terms = [m.span() for m in TERM.finditer(text)]
    opens, ends = [s for s, _ in cover], [e for _, e in terms]
    begins = [s for s, _ in terms]
    free = []
    for s, e in terms:
        at = bisect_left(opens, e) - 1  # the last span that starts before the term ends
        free.append(at < 0 or cover[at][1] <= s)
    words = [text[s:e].lower() if f else "" for (s, e), f in zip(terms, free)]
    out = []
    for kind, start, end in spans:
        name = entity(kind, text[start:end])
        before, after = bisect_right(ends, start), bisect_left(begins, end)
        for i in (*range(max(0, before - WINDOW_WORDS), before), *range(after, min(len(terms), after + WINDOW_WORDS))):
            if free[i]:
                out.append({"entity": name, "term": words[i], "start": terms[i][0], "end": terms[i][1]})
    return out


def scanned(docs: DataFrame) -> DataFrame:
    """id, digest, base spans and contexts of every document; `docs` has id, text."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    near = pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, found, around = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                digests.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).digest())
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                around.append(contexts(text, spans) if spans else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(digests, pa.binary()),
                    pa.array(found, pa.list_(span)),
                    pa.array(around, pa.list_(near)),
                ],
                ["id", "digest", "spans", "near"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(
        scan,
        f"id {kind}, digest binary, spans array<struct<kind: string, start: int, end: int>>, "
        "near array<struct<entity: string, term: string, start: int, end: int>>",
    )


def term_counts(docs: DataFrame) -> DataFrame:
    """term and the number of documents with it, over whole texts; counts are summed in the task first."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"]
            )
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update({t.lower() for t in TERM.findall(text or "")})
                if len(held) > HELD_TERMS:
                    yield flush()
        yield flush()

    return docs.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))


def revealing_terms(facts: DataFrame, docs: DataFrame, generalise: float, remove: float) -> DataFrame:
    """entity, term, action for terms that disclose too much of an entity.

    The pointwise mutual information of a term and an entity, over the
    information of the entity, is the share of it that the term gives away: 1
    for a term that occurs with this entity only.
    """
    total = facts.count()
    each = facts.where(F.size("near") > 0).select(
        "digest", F.explode(F.array_distinct(F.transform("near", lambda c: F.struct(c["entity"].alias("entity"), c["term"].alias("term"))))).alias("p")
    )
    # Two different texts at least: a single one, or its copies, estimates nothing.
    pairs = materialise(
        each.groupBy("p.entity", "p.term")
        .agg(F.count("*").alias("n_both"), F.min("digest").alias("x"), F.max("digest").alias("y"))
        .where("x <> y")
        .drop("x", "y")
    )
    names = facts.select(
        F.explode(F.array_distinct(F.transform("near", lambda c: c["entity"]))).alias("entity")
    ).groupBy("entity").agg(F.count("*").alias("n_entity"))
    counts = term_counts(docs).join(pairs.select("term").distinct(), "term")
    information = F.log2(F.lit(float(max(total, 1))) / F.col("n_entity"))
    shared = F.log2(F.col("n_both") * F.lit(float(max(total, 1))) / (F.col("n_entity") * F.col("n_term")))
    ratio = F.when(information > 0, shared / information).otherwise(0.0)
    return (
        pairs.join(names, "entity")
        .join(counts, "term")
        .withColumn("disclosed", F.least(ratio, F.lit(1.0)))
        .where(F.col("disclosed") >= generalise)
        .select("entity", "term", "disclosed", F.when(F.col("disclosed") >= remove, "remove").otherwise("generalise").alias("action"))
    )


def personal_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    generalise: float = 0.7,
    remove: float = 0.9,
) -> DataFrame:
    """id_col, digest (MD5 of the text), spans (kind, start, end) for every row of `docs`.

    Spans of e-mail addresses, IPv4 addresses, payment cards and phone numbers
    are found by pattern. They name protected entities. A term among the ten
    words before or after an entity is one more span where corpus co-occurrence
    says that it discloses at least `generalise` of the entity's information;
    from `remove` on its kind is remove, else generalise. Counts run over all
    documents; a pair needs two different texts.

    Spans count code points, ends exclusive, and are ordered by kind as in
    KINDS, then start. A NULL text is empty. Repeated rows each get their row
    and count as documents of their own. Other columns are not read.
    """
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    facts = materialise(scanned(plain))
    revealing = materialise(revealing_terms(facts, plain, generalise, remove))
    near = facts.select("digest", F.explode("near").alias("c")).select("digest", "c.*")
    added = (
        near.join(revealing, ["entity", "term"])
        .groupBy("digest", "start", "end")
        .agg(F.max("action").alias("kind"))
        .groupBy("digest")
        .agg(F.array_sort(F.collect_list(F.struct(F.when(F.col("kind") == "remove", 4).otherwise(5).alias("order"), "start", "end", "kind"))).alias("more"))
    )
    added = materialise(
        added.select("digest", F.transform("more", lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))).alias("more"))
    )
    return facts.join(added, "digest", "left").select(
        F.col("id").alias(id_col),
        "digest",
        F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more")).alias("spans"),
    )


def spans_text(spans):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def replaced(text: str, spans: list) -> str:
    """The text with every span cut or replaced by what kind of thing it was; of overlapping spans the first counts."""
    out, at = [], 0
    for span in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        start, end = max(span["start"], at), span["end"]
        if end <= at:
            continue
        out.append(text[at:start])
        if span["kind"] == "generalise":
            found = text[start:end]
            out.append("[NUMBER]" if any(c.isdigit() for c in found) else "[NAME]" if found[0].isupper() else "[TERM]")
        elif span["kind"] != "remove" and start == span["start"]:
            out.append(f"[{span['kind'].upper()}]")
        at = end
    return "".join(out) + text[at:]


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "sanitised", **settings) -> DataFrame:
    """`docs` with the column `out`, the text without its personal spans; NULL texts stay NULL.

    An own column `out` is replaced.
    """
    found = personal_spans(docs, id_col, text_col, **settings).where(F.size("spans") > 0)
    key, cut = unused(docs, "digest"), unused(docs, "spans")
    found = found.select(F.col("digest").alias(key), F.col("spans").alias(cut)).dropDuplicates([key])

    @F.pandas_udf("string")
    def replace(texts, spans):
        return texts.combine(spans, lambda t, s: t if t is None or s is None else replaced(t, list(s)))

    joined = docs.withColumn(key, F.unhex(F.md5(F.col(text_col)))).join(found, key, "left")
    return joined.withColumn(out, replace(F.col(text_col), F.col(cut))).drop(key, cut)
