"""Ranked lexical search over index segments whose documents are grouped by length."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from newsignal.session import arrow_batches, materialise

# A term is a run of ASCII letters, digits and characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SHARE = 75
GAIN = 1_000_000_000

SEGMENT_ROWS = 1 << 15
SEGMENT_BYTES = 4 << 20
BLOCK_TERMS = 200_000

# Segments are rows of some MB, so whatever holds rows must hold few: Parquet writes a
# row group out at that many bytes, not after its usual 100 rows, and batches for
# Python end there too. Terms go back to Spark in batches of `TERM_ROWS`.
GROUP_BYTES = 8 << 20
ROW_GROUPS = {
    "parquet.block.size": GROUP_BYTES,
    "parquet.page.size.row.check.min": 1,
    "parquet.page.size.row.check.max": 1,
    "parquet.column.statistics.enabled": False,  # they would keep the values of all row groups until the file's end
    "parquet.enable.dictionary": False,  # would hold each value once more
}
TERM_ROWS = 8192

# Bytes that end a term become blanks, A to Z become small; bytes beyond ASCII stay.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()

SEGMENT = (
    "ids array<long>, m array<long>, stratum_end array<int>, term_bytes binary, term_at binary, df binary, "
    "term_end binary, group_stratum binary, group_tf binary, group_end binary, postings binary"
)


class Index(NamedTuple):
    """`segments` in the shared folder, the number of documents with terms and of all their terms."""

    segments: DataFrame
    n_docs: int
    n_terms: int


def impact(tf, m):
    """What one occurrence count adds per unit of weight in a document of normaliser m."""
    return (GAIN * tf) // (1000 * tf + 8 * m)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def corpus_size(texts: DataFrame) -> tuple[int, int]:
    """The documents with a term and all their terms; each task sends its two sums."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs = terms = 0
        for batch in batches:
            for text in batch.column(0):
                n = len(terms_of(text.as_py() or b""))
                docs, terms = docs + (n > 0), terms + n
        yield pa.RecordBatch.from_arrays([pa.array([docs]), pa.array([terms])], ["docs", "terms"])

    sums = texts.select("text").mapInArrow(counted, "docs long, terms long").agg(F.sum("docs"), F.sum("terms"))
    with arrow_batches(texts.sparkSession, GROUP_BYTES):
        docs, terms = sums.first()
    return docs or 0, terms or 0


class Numbers(dict):
    """Term to number, counted up as terms appear."""

    def __missing__(self, term: bytes) -> int:
        value = self[term] = len(self)
        return value


def term_blobs(terms: Iterable[bytes]) -> tuple[bytes, bytes]:
    """The bytes of all terms and where each begins, as Arrow holds strings."""
    clean = [t.decode("utf-8", "replace").encode() for t in terms]
    ends = np.cumsum([0, *map(len, clean)])
    return b"".join(clean), ends.astype("<i4").tobytes()


def term_array(term_bytes: pa.Scalar, term_at: pa.Scalar) -> pa.Array:
    """The terms of one segment."""
    at = pa.py_buffer(term_at.as_py())
    return pa.StringArray.from_buffers(at.size // 4 - 1, at, term_bytes.as_buffer())


def segment_row(ids: list, lists: list[np.ndarray], numbers: Numbers, n_docs: int, n_terms: int) -> list:
    """One index segment: documents in the order of m, postings by term, stratum and tf.

    A stratum is all documents of equal m. Inside a stratum the postings of a
    term lie in groups of equal tf, ascending, so the last one bounds the rest.
    """
    lengths = np.array([len(x) for x in lists])
    m = np.array([100 - SHARE + SHARE * int(n) * n_docs // n_terms for n in lengths], np.int64)
    order = np.argsort(m, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    strata, stratum, sizes = np.unique(m[order], return_inverse=True, return_counts=True)
    spots = np.concatenate(lists) * len(ids) + np.repeat(place, lengths)
    spots, tf = np.unique(spots, return_counts=True)
    term, doc = np.divmod(spots, len(ids))
    widest = int(tf.max()) + 1
    key = (term * len(strata) + stratum[doc]) * widest + tf
    by_group = np.argsort(key, kind="stable")
    key, start = np.unique(key[by_group], return_index=True)
    group_term = key // widest // len(strata)
    return [
        [ids[i] for i in order],
        strata,
        np.cumsum(sizes),
        *term_blobs(numbers),
        np.bincount(term, minlength=len(numbers)).astype("<u4").tobytes(),
        np.cumsum(np.bincount(group_term, minlength=len(numbers))).astype("<u4").tobytes(),
        (key // widest % len(strata)).astype("<u2").tobytes(),
        (key % widest).astype("<u4").tobytes(),
        np.append(start[1:], len(doc)).astype("<u4").tobytes(),
        doc[by_group].astype("<u2").tobytes(),
    ]


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Indexes every document with a term, in segments of at most 32,768 documents and some 4 MB of text.

    A task cuts its documents into segments; nothing is shuffled. Whole texts
    are read, a very long one fills a segment of its own. NULL texts and texts
    without terms are not found by any search and are left out; repeated rows
    and NULL ids are indexed like others. Ids are integers. Other columns are
    not read. An empty table makes an empty index.
    """
    plain = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    binary = plain.select("id", F.col("text").cast("binary"))
    n_docs, n_terms = corpus_size(binary)

    def segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("ids", pa.list_(pa.int64())), ("m", pa.list_(pa.int64())), ("stratum_end", pa.list_(pa.int32())),
                *[(c, pa.binary()) for c in ("term_bytes", "term_at", "df", "term_end", "group_stratum", "group_tf", "group_end", "postings")],
            ]
        )
        ids: list = []
        lists: list[np.ndarray] = []
        numbers, held = Numbers(), 0

        def flushed() -> pa.RecordBatch:
            row = segment_row(ids, lists, numbers, n_docs, n_terms)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py() or b""
                words = terms_of(raw)
                if not words:
                    continue
                ids.append(i)
                lists.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                held += len(raw)
                if len(ids) >= SEGMENT_ROWS or held >= SEGMENT_BYTES:
                    yield flushed()
                    ids, lists, numbers, held = [], [], Numbers(), 0
        if ids:
            yield flushed()

    with arrow_batches(docs.sparkSession, GROUP_BYTES):
        return Index(materialise(binary.mapInArrow(segments, SEGMENT), **ROW_GROUPS), n_docs, n_terms)


def document_frequencies(index: Index) -> DataFrame:
    """(term, df) of every segment."""

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for term_bytes, term_at, df in zip(*batch.columns):
                terms, counts = term_array(term_bytes, term_at), np.frombuffer(df.as_py(), "<u4").astype(np.int64)
                for at in range(0, len(terms), TERM_ROWS):
                    rows = [terms.slice(at, TERM_ROWS), pa.array(counts[at : at + TERM_ROWS])]
                    yield pa.RecordBatch.from_arrays(rows, ["term", "df"])

    return index.segments.select("term_bytes", "term_at", "df").mapInArrow(listed, "term string, df long")


def weighted_items(index: Index, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, terms): each item's terms that the index holds, with weight times repeats."""
    fold = F.translate(F.col(f"`{text_col}`"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Written, so that the planner knows its size and broadcasts it where it is small.
    wanted = materialise(
        items.select(F.col(f"`{id_col}`").alias("item"), F.explode(F.regexp_extract_all(fold, F.lit(TERM), 0)).alias("term"))
        .groupBy("item", "term")
        .agg(F.count("*").alias("repeats"))
    )
    found = (
        document_frequencies(index)
        .join(wanted.select("term"), "term", "left_semi")
        .groupBy("term")
        .agg(F.sum("df").alias("df"))
    )
    weight = F.floor(1000 * F.ln(F.lit(2.0 * index.n_docs + 2) / (2 * F.col("df") + 1)))
    return (
        wanted.join(found, "term")
        .groupBy("item")
        .agg(F.collect_list(F.struct("term", (weight * F.col("repeats")).alias("weight"))).alias("terms"))
    )


def in_blocks(rows: Iterable, least: int) -> Iterator[list]:
    """Lists of rows that hold `least` terms each, or end the input."""
    block, held = [], 0
    for row in rows:
        block.append((row["item"], [(t["term"], t["weight"]) for t in row["terms"]]))
        held += len(row["terms"])
        if held >= least:
            yield block
            block, held = [], 0
    if block:
        yield block


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + length, length)


class Best:
    """The `k` best (score, id) found so far: higher scores first, then smaller ids, NULL ids last."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.empty(0, np.int64)
        self.id = np.empty(0, np.int64)
        self.null = np.empty(0, bool)

    def least(self) -> int:
        """A score below this cannot enter."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        score, ids, null = (
            np.concatenate(pair) for pair in ((self.score, score), (self.id, ids), (self.null, null))
        )
        order = np.lexsort((ids, null, -score))[: self.k]
        self.score, self.id, self.null = score[order], ids[order], null[order]


class Segment:
    """The postings of the wanted terms of one segment."""

    def __init__(self, row: dict[str, pa.Array], wanted: pa.Array):
        ids = row["ids"].values
        self.null = np.asarray(ids.is_null())
        self.ids = np.asarray(ids.fill_null(0))
        m = np.asarray(row["m"].values)
        at = np.asarray(pc.index_in(wanted, value_set=term_array(row["term_bytes"], row["term_at"])).fill_null(-1))
        blobs = {c: np.frombuffer(row[c].as_py(), kind) for c, kind in
                 (("term_end", "<u4"), ("group_stratum", "<u2"), ("group_tf", "<u4"), ("group_end", "<u4"), ("postings", "<u2"))}
        term_end = blobs["term_end"].astype(np.int64)
        # Groups of the wanted term k: first[k] up to last[k].
        self.last = np.where(at >= 0, term_end[at], 0)
        self.first = np.where(at > 0, term_end[at - 1], 0)
        self.stratum = blobs["group_stratum"]
        self.impact = impact(blobs["group_tf"].astype(np.int64), m[self.stratum])
        self.end = blobs["group_end"].astype(np.int64)
        self.begin = np.concatenate([[0], self.end[:-1]])
        self.postings = blobs["postings"]
        self.n_strata = len(m)
        self.scores = np.zeros(len(self.ids), np.int64)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Adds the documents that beat `best`.

        A stratum's bound is the sum over the terms of weight and largest impact
        in it. Strata are visited in the order of their bounds, a few more each
        time, until the next bound is below the k-th score.
        """
        length = self.last[terms] - self.first[terms]
        groups = ranges(self.first[terms], length)
        if not len(groups):
            return
        value = np.repeat(weights, length) * self.impact[groups]
        stratum = self.stratum[groups].astype(np.int64)
        term = np.repeat(np.arange(len(terms)), length)
        tops = np.append((stratum[1:] != stratum[:-1]) | (term[1:] != term[:-1]), True)
        bound = np.zeros(self.n_strata, np.int64)
        np.add.at(bound, stratum[tops], value[tops])
        visits = np.argsort(-bound, kind="stable")
        turn = np.empty(len(visits), np.int64)
        turn[visits] = np.arange(len(visits))
        by_turn = np.argsort(turn[stratum], kind="stable")
        groups, value, turns = groups[by_turn], value[by_turn], turn[stratum[by_turn]]
        done, step = 0, 2
        while done < len(visits):
            least = best.least()
            ahead = bound[visits[done : done + step]]
            reach = int((ahead >= least).sum())  # bounds fall, so these come first
            if not reach:
                return
            low, high = np.searchsorted(turns, [done, done + reach])
            part = groups[low:high]
            size = self.end[part] - self.begin[part]
            docs = self.postings[ranges(self.begin[part], size)].astype(np.int64)
            np.add.at(self.scores, docs, np.repeat(value[low:high], size))
            seen = np.unique(docs)
            score = self.scores[seen]
            good = score >= least
            best.add(score[good], self.ids[seen[good]], self.null[seen[good]])
            self.scores[seen] = 0
            done, step = done + reach, step * 2
            if reach < len(ahead):
                return


def search_block(segments: DataFrame, block: list, item_type: DataType, k: int) -> DataFrame:
    """Each task's `k` best documents for the items of a block."""
    kind, arrow_kind = item_type.simpleString(), to_arrow_type(item_type)
    words = sorted({t for _, terms in block for t, _ in terms})
    number = {t: i for i, t in enumerate(words)}
    queries = [
        (item, np.array([number[t] for t, _ in terms]), np.array([w for _, w in terms], np.int64)) for item, terms in block
    ]

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, best = pa.array(words, pa.string()), [Best(k) for _ in queries]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(c)[i] for c, name in enumerate(batch.schema.names)}
                segment = Segment(row, wanted)
                for (_, terms, weights), top in zip(queries, best):
                    segment.search(terms, weights, top)
        items = [item for (item, _, _), top in zip(queries, best) for _ in top.score]
        ids = [None if n else int(i) for top in best for i, n in zip(top.id, top.null)]
        scores = [int(s) for top in best for s in top.score]
        yield pa.RecordBatch.from_arrays(
            [pa.array(items, arrow_kind), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["item", "doc", "score"]
        )

    return segments.drop("df").mapInArrow(found, f"item {kind}, doc long, score long")


def search(
    index: Index, items: DataFrame, item_col: str = "item_id", text_col: str = "text", doc_col: str = "doc_id", k: int = 10
) -> DataFrame:
    """(item, rank, document, score): the `k` documents with the highest scores above 0 for each item.

    Equal scores are ranked by ascending id, NULL ids last, and repeated
    documents each take a rank. Rows of one item id, NULLs together, are one
    item. Items without a term that is indexed have no rows; NULL and empty
    texts have no terms.

    Items pass through the driver in blocks of some 200,000 terms, each sent to
    all tasks; one pass over the index answers a block. A task keeps `k`
    documents per item over all its segments and sends only those.
    """
    kind = items.schema[item_col].dataType
    with arrow_batches(items.sparkSession, GROUP_BYTES):
        weighted = materialise(weighted_items(index, items, item_col, text_col))
    none = items.sparkSession.createDataFrame([], f"item {kind.simpleString()}, doc long, score long")
    out = none
    for block in in_blocks(weighted.toLocalIterator(), BLOCK_TERMS):
        with arrow_batches(items.sparkSession, GROUP_BYTES):
            out = out.unionByName(materialise(search_block(index.segments, block, kind, k)))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return (
        out.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select(F.col("item").alias(item_col), "rank", F.col("doc").alias(doc_col), "score")
    )
