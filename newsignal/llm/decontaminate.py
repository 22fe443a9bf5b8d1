"""Benchmark decontamination: prefix-filtered containment join of item windows and documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.llm.common import unused, without_keys
from newsignal.session import materialise, scratch

WINDOW = 10
SHINGLE = 3
# Windows that one pass over the documents looks for; they fit in some 50 MB.
BLOCK_ROWS = 200_000
LONGEST_BATCH = 1 << 22
SPANS = "array<struct<start: int, end: int>>"
# Lower case for A-Z, a space for all other ASCII but a-z and digits.
PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(PLAIN).split()


def merged(starts: np.ndarray, ends: np.ndarray) -> list[dict]:
    """The union of half-open spans, in order."""
    order = np.argsort(starts, kind="stable")
    out: list[dict] = []
    for s, e in zip(starts[order].tolist(), ends[order].tolist()):
        if out and s <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], e)
        else:
            out.append({"start": s, "end": e})
    return out


class Windows:
    """Item windows of one block, ready to be looked up in documents.

    Words are numbered; a document's other words are 0. A shingle of up to three
    words has one number. Every window is filed under one of its shingles, its
    prefix: to contain the window, a document must contain all of its shingles,
    so one is necessary, and the rarest one meets the fewest documents.
    """

    def __init__(self, rows: list[tuple[str, bytes]]):
        by_window: dict[bytes, list[str]] = {}
        for item, window in rows:
            by_window.setdefault(window, []).append(item)
        self.items = list(by_window.values())
        split = [w.split() for w in by_window]
        self.number = {w: i + 1 for i, w in enumerate(sorted({w for words in split for w in words}))}
        self.size = len(self.number) + 1
        if SHINGLE * self.size**SHINGLE >= 1 << 63:
            raise ValueError("too many different words for one block; lower block_rows")
        self.length = np.array([len(words) for words in split], np.int32)
        self.ids = np.zeros((len(split), max(self.length, default=1)), np.int64)
        for i, words in enumerate(split):
            self.ids[i, : len(words)] = [self.number[w] for w in words]
        self.codes = [self.shingles(self.ids[i, :n]) for i, n in enumerate(self.length)]
        self.known = np.unique(np.concatenate(self.codes)) if self.codes else np.empty(0, np.int64)
        self.widths = sorted({min(SHINGLE, int(n)) for n in self.length})

    def shingles(self, ids: np.ndarray) -> np.ndarray:
        return self.coded(ids, min(SHINGLE, len(ids)))

    def coded(self, ids: np.ndarray, width: int) -> np.ndarray:
        """One number for each run of `width` words; runs with another word than the windows' get 0."""
        n = len(ids) - width + 1
        if n <= 0:
            return np.empty(0, np.int64)
        code, known = ids[:n].copy(), ids[:n] > 0
        for k in range(1, width):
            code *= self.size
            code += ids[k : k + n]
            known &= ids[k : k + n] > 0
        code[~known] = 0
        # Each width has number ranges of its own.
        return code * SHINGLE + (width - 1) * (code > 0)

    def numbered(self, text: bytes | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.number.get, words, repeat(0)), np.int64, len(words))

    def found(self, ids: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, indexes into wanted) of the wanted shingles in a document."""
        for width in self.widths:
            code = self.coded(ids, width)
            at = np.flatnonzero(code)
            if len(at) and len(wanted):
                place = np.minimum(np.searchsorted(wanted, code[at]), len(wanted) - 1)
                hit = wanted[place] == code[at]
                yield at[hit], place[hit]

    def file_under_rarest(self, counts: dict[int, int]) -> None:
        """Orders each window's shingles by corpus count and files the window under the first."""
        prefix = []
        for codes in self.codes:
            offset = min(range(len(codes)), key=lambda k: (counts.get(int(codes[k]), 0), k))
            prefix.append((int(codes[offset]), offset))
        order = sorted(range(len(prefix)), key=lambda i: prefix[i])
        self.filed = np.array(order, np.int64)
        self.offset = np.array([prefix[i][1] for i in order], np.int64)
        self.prefixes, self.first = np.unique(np.array([prefix[i][0] for i in order], np.int64), return_index=True)
        self.many = np.diff(np.append(self.first, len(order)))
        self.codes = []

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of every occurrence of a window."""
        starts, windows = [], []
        for at, place in self.found(ids, self.prefixes):
            many = self.many[place]
            which = np.repeat(self.first[place] - np.cumsum(many) + many, many) + np.arange(many.sum())
            window = self.filed[which]
            start = np.repeat(at, many) - self.offset[which]
            fits = (start >= 0) & (start + self.length[window] <= len(ids))
            start, window = start[fits], window[fits]
            for begin in range(0, len(start), LONGEST_BATCH // WINDOW):
                s, w = start[begin : begin + LONGEST_BATCH // WINDOW], window[begin : begin + LONGEST_BATCH // WINDOW]
                equal = np.ones(len(s), bool)
                for k in range(self.ids.shape[1]):
                    inside = np.flatnonzero(equal & (k < self.length[w]))
                    equal[inside] = ids[s[inside] + k] == self.ids[w[inside], k]
                starts.append(s[equal])
                windows.append(w[equal])
        if not starts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(starts), np.concatenate(windows)


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct (item, window); `items` has item, text. Words are joined by spaces."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                n = min(window, len(words))
                last = len(words) - n + 1 if words else 0
                for begin in range(0, last, 10_000):
                    part = [b" ".join(words[i : i + n]) for i in range(begin, min(last, begin + 10_000))]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], ["item", "window"]
                    )

    plain = items.where("item is not null").select(F.col("item").cast("string"), F.col("text").cast("binary"))
    return plain.mapInArrow(cut, "item string, window binary").distinct()


def shingle_counts(docs: DataFrame, windows: Windows) -> dict[int, int]:
    """How often each shingle of a block occurs in all documents; one number per shingle of the block."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(windows))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = cloudpickle.loads(shared.value)
        total = np.zeros(len(block.known), np.int64)
        for batch in batches:
            for text in batch.column(1).to_pylist():
                for _, place in block.found(block.numbered(text), block.known):
                    total += np.bincount(place, minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(block.known[met]), pa.array(total[met])], ["shingle", "n"])

    counted = docs.mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(counted.column("shingle").to_pylist(), counted.column("n").to_pylist()))


def block_hits(docs: DataFrame, windows: Windows, all_rows: bool) -> DataFrame:
    """id, digest of the text, n_words, spans, items; `all_rows` also yields documents without a hit."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(windows))

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = cloudpickle.loads(shared.value)
        for batch in batches:
            keep, counts, spans, items = [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = block.numbered(text)
                start, window = block.occurrences(ids)
                if len(start) or all_rows:
                    keep.append(row)
                    counts.append(len(ids))
                    spans.append(merged(start, start + block.length[window]))
                    items.append(sorted({i for w in np.unique(window).tolist() for i in block.items[w]}))
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            taken = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    taken.column(0),
                    taken.column(2),
                    pa.array(counts, pa.int64()),
                    pa.array(spans, pa.list_(span)),
                    pa.array(items, pa.list_(pa.string())),
                ],
                ["id", "digest", "n_words", "spans", "items"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(probe, f"id {kind}, digest binary, n_words long, spans {SPANS}, items array<string>")


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """id_col, n_words, spans, items for every row of `docs`.

    Words are runs of letters a-z, digits and non-ASCII characters after A-Z are
    lower cased. A window is `window` consecutive words of an item, or all words
    of a shorter item. `spans` are the word ranges [start, end) that occurrences
    of windows cover, in order and disjoint; `items` the ids, as strings and in
    order, of items with an occurring window.

    The windows are dealt to blocks of about `block_rows`; each block is
    broadcast and all documents are read once to count its shingles and once to
    probe them. One block is enough for a usual benchmark. The driver holds one
    block at a time.

    NULL and wordless texts have no words and no hits. Items without an id or
    without words are left out; rows of one item id are one item. Repeated
    documents each get their row. Other columns are not read.
    """
    plain = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.lit(None).cast("binary").alias("digest")
    )
    cut = materialise(
        item_windows(items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")), window)
    )
    blocks = max(1, -(-cut.count() // block_rows))
    dealt = cut.withColumn("block", F.pmod(F.xxhash64("item", "window"), F.lit(blocks)))

    def block(number: int) -> Windows:
        rows = dealt.where(F.col("block") == number).select("item", "window").toArrow()
        found = Windows(list(zip(rows.column("item").to_pylist(), rows.column("window").to_pylist())))
        found.file_under_rarest(shingle_counts(plain, found))
        return found

    if blocks == 1:
        return block_hits(plain, block(0), True).select(F.col("id").alias(id_col), "n_words", "spans", "items")

    # A result depends on the text alone, so partial results meet by its digest.
    keyed = plain.withColumn("digest", F.unhex(F.sha2("text", 256)))
    parts = [materialise(block_hits(keyed, block(b), False).drop("id").dropDuplicates(["digest"])) for b in range(blocks)]
    hits = reduce(DataFrame.unionByName, parts).groupBy("digest").agg(
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )

    @F.pandas_udf(SPANS)
    def union(spans):
        return spans.map(lambda s: merged(np.array([x["start"] for x in s]), np.array([x["end"] for x in s])))

    hits = hits.select("digest", union("spans").alias("spans"), "items")
    nothing = Windows([])
    nothing.file_under_rarest({})
    counted = block_hits(keyed, nothing, True).select("id", "digest", "n_words")
    none = F.array().cast(SPANS)
    return counted.join(materialise(hits), "digest", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **settings) -> DataFrame:
    """The rows of `docs`, all their columns, whose text holds no window of an item; NULL texts stay."""
    key = unused(docs, "digest")
    keyed = docs.withColumn(key, F.sha2(F.col(text_col), 256))
    with scratch(docs.sparkSession) as keep:
        found = contamination(keyed, items, id_col=key, text_col=text_col, **settings)
        hit = keep(found.where(F.size("spans") > 0).select(key).distinct())
    return without_keys(keyed, key, hit).drop(key)


def hit_words(spans: str = "spans"):
    """The number of words that the spans cover."""
    return F.aggregate(F.col(spans), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
