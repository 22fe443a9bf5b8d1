"""Near-duplicate documents: MinHash, banding, exact confirmation, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsignal.llm.common import maybe_in, runs, unused, without_keys
from newsignal.session import materialise, scratch

CHUNK_ROWS = 1024
CHUNK_BYTES = 8 << 20
CACHED_WORDS = 500_000
# A pair passes the signature test at this many standard errors below the threshold.
# At similarity 0.8 and 128 minima, 75 of them must agree: missed by a chance below 1e-8.
MARGIN = 6.0


class WordHashes(dict):
    """Word to 64-bit hash; computed when first asked for."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: bytes | None, words_each: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(words_each, len(words))
    last = len(words) - width + 1
    joined = np.full(last, width, np.uint64)
    for k in range(width):
        joined = mixed(joined + each[k : k + last])
    return np.unique(joined)


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of n universal hash functions of 32-bit values."""
    draws = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, (2, n), dtype=np.uint64)
    return draws[0] | np.uint64(1), draws[1]


def minima(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """For each function the smallest hash of the set, 32 bits."""
    a, b = family
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    values = shingles >> np.uint64(32)
    for start in range(0, len(values), 128):
        block = values[start : start + 128, None] * a
        block += b
        np.minimum(low, block.min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signed_documents(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """id, n, digest of the set, one hash per band, signature (one byte per minimum).

    Documents without words get n = 0 and NULLs. `docs` has the columns id, text.
    """

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, family = WordHashes(), hash_family(bands * rows)
        for batch in batches:
            counts, digests, banded, signatures = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text, shingle, hashes)
                counts.append(len(found))
                if not len(found):
                    digests.append(None)
                    banded.append(None)
                    signatures.append(None)
                    continue
                low = minima(found, family)
                keys = np.full(bands, 0, np.uint64) + np.arange(bands, dtype=np.uint64)
                for k in range(rows):
                    keys = mixed(keys + low[k::rows].astype(np.uint64) + np.uint64(k + 1))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                banded.append(keys.astype(np.int64))
                signatures.append((low & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(banded, pa.list_(pa.int64())),
                    pa.array(signatures, pa.binary()),
                ],
                ["id", "n", "digest", "bands", "signature"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(
        sign, f"id {kind}, n long, digest binary, bands array<bigint>, signature binary"
    )


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """id and the whole set as 8-byte values."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(t, shingle, hashes).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "members"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", F.col("text").cast("binary").alias("text")).mapInArrow(cut, f"id {kind}, members binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for two sorted sets."""
    n, m = len(a), len(b)
    if 100 * min(n, m) < percent * max(n, m):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (n + m - common)


def least_agreement(percent: int, hashes: int) -> int:
    """Equal minima that a pair at the threshold reaches but for a negligible chance."""
    p = percent / 100
    return int(np.floor(hashes * p - MARGIN * np.sqrt(hashes * p * (1 - p))))


def components(links: DataFrame) -> DataFrame:
    """id and root, the smallest id reachable, for every id in `links` (a, b).

    Alternates the large-star and the small-star step until nothing changes. A
    step groups edges by node to find the smallest neighbour, which partial
    sums shrink before the shuffle, and joins it back, so that no task holds
    the neighbours of one node.
    """
    edges = materialise(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct())
        lowest = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u")
        edges = materialise(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = state(edges)
        if after == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = after


def pivot_links(members: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between the members of a bucket and its smallest member.

    A bucket of n documents costs n - 1 comparisons. `members` has bucket, id, pivot.
    """

    @F.pandas_udf("int")
    def agreement(x, y):
        import pandas as pd

        wide = len(x.iloc[0]) if len(x) else 1
        left = np.frombuffer(b"".join(x), np.uint8).reshape(-1, wide)
        right = np.frombuffer(b"".join(y), np.uint8).reshape(-1, wide)
        return pd.Series((left == right).sum(1), dtype="int32")

    @F.pandas_udf("boolean")
    def confirmed(x, y):
        import pandas as pd

        return pd.Series(
            [linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(x, y)],
            dtype="bool",
        )

    pairs = members.where("id <> pivot").select("id", "pivot").distinct()
    left = signatures.select("id", F.col("signature").alias("mine"), F.length("signature").alias("hashes"))
    right = signatures.select(F.col("id").alias("pivot"), F.col("signature").alias("its"))
    percent_of = F.col("hashes") * percent / 100
    floor = F.floor(percent_of - MARGIN * F.sqrt(percent_of * (100 - percent) / 100))
    likely = materialise(
        pairs.join(left, "id").join(right, "pivot").where(agreement("mine", "its") >= floor).select("id", "pivot")
    )
    return (
        likely.join(sets.select("id", F.col("members").alias("mine")), "id")
        .join(sets.select(F.col("id").alias("pivot"), F.col("members").alias("its")), "pivot")
        .where(confirmed("mine", "its"))
        .select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    )


class Block:
    """The documents of one block of a bucket: one chunk, or two to compare with each other."""

    def __init__(self, rows: pa.Table, percent: int):
        self.rows = rows
        self.ids = rows.column("id").to_pylist()
        self.root = np.unique(rows.column("root").to_pylist(), return_inverse=True)[1]
        side = np.asarray(rows.column("chunk").to_pylist())
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        self.one_chunk = low == high
        self.left, self.right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        signatures = rows.column("signature").to_pylist()
        self.signature = np.frombuffer(b"".join(signatures), np.uint8).reshape(len(side), -1)
        self.bands = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(len(side), -1)
        self.band = rows.column("band")[0].as_py()
        self.least = least_agreement(percent, self.signature.shape[1])

    def likely(self) -> Iterator[tuple[int, np.ndarray]]:
        """(row, partners): different components, similar signatures, met in no earlier band."""
        for i in self.left:
            others = self.right[self.right > i] if self.one_chunk else self.right
            others = others[self.root[others] != self.root[i]]
            if len(others):
                others = others[(self.signature[others] == self.signature[i]).sum(1) >= self.least]
            if len(others) and self.band:
                met = (self.bands[others, : self.band] == self.bands[i, : self.band]).any(1)
                others = others[~met]
            if len(others):
                yield i, others


def block_links(blocks: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between documents of one bucket that are not yet in one component.

    `blocks` has band, bucket, low, high, chunk, id, root, bands, signature. The
    first pass compares signatures and keeps documents that have a likely
    partner; the second gets their sets and confirms. A pair is compared in the
    first band that its documents share.
    """
    keys = ["band", "bucket", "low", "high"]

    def together(df: DataFrame) -> DataFrame:
        return df.repartition(*keys).sortWithinPartitions(*keys)

    def screen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, keys):
            wanted = np.zeros(rows.num_rows, bool)
            for i, others in Block(rows, percent).likely():
                wanted[i] = True
                wanted[others] = True
            if wanted.any():
                yield from rows.filter(pa.array(wanted)).to_batches()

    def confirm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, keys):
            block = Block(rows, percent)
            members = [np.frombuffer(m, np.uint64) for m in rows.column("members").to_pylist()]
            top = list(range(len(members)))

            def find(x: int) -> int:
                while top[x] != x:
                    top[x] = top[top[x]]
                    x = top[x]
                return x

            first: dict[int, int] = {}
            for i, root in enumerate(block.root.tolist()):
                top[i] = first.setdefault(root, i)
            found = []
            for i, others in block.likely():
                for j in others.tolist():
                    x, y = find(i), find(j)
                    if x != y and linked(members[i], members[j], percent):
                        top[x] = y
                        found.append((block.ids[i], block.ids[j]))
            if found:
                kind = rows.schema.field("id").type
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], kind), pa.array([f[1] for f in found], kind)], ["a", "b"]
                )

    kind = blocks.schema["id"].dataType.simpleString()
    likely = materialise(together(blocks).mapInArrow(screen, blocks.schema))
    return together(likely.join(sets, "id")).mapInArrow(confirm, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
) -> DataFrame:
    """id_col, n_shingles, component_id, kept for every row of `docs`.

    A document's set holds its distinct shingles of `shingle` words, A-Z lower
    cased; a shorter text is one shingle. Two documents are linked where the
    intersection is at least `percent` per cent of the union, confirmed on full
    sets. A component is named after its smallest id.

    `bands` * `rows` universal hash minima make a signature. With 32 bands of 4
    a pair at similarity 0.8 shares no band with a chance below 5e-8, and fails
    the screen by signatures with a chance below 1e-8; more similar pairs are
    missed less often still.

    Equal sets are one class from the start. In each bucket all members are
    compared with the smallest one. Where a bucket still holds several
    components, its members are dealt to blocks of bounded size, and block by
    block every pair from different components is compared. So a large group of
    similar copies costs one comparison each, and no link is lost.

    NULL and blank texts: n_shingles 0, a component of their own, kept. NULL
    ids: component_id NULL, kept, linked with nothing. Rows that share an id
    and a text are one document and get equal results; rows that share an id
    but not the text are each linked by their own text. Other columns of
    `docs` are not read.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    facts = materialise(signed_documents(plain, shingle, bands, rows))
    named = facts.where("id is not null and digest is not null")
    classes = materialise(
        named.groupBy("digest").agg(
            F.min("id").alias("id"), F.max("bands").alias("bands"), F.max("signature").alias("signature")
        )
    )

    banded = classes.select("id", F.posexplode("bands").alias("band", "bucket"))
    shared = materialise(
        banded.groupBy("band", "bucket").agg(F.count("*").alias("size"), F.min("id").alias("pivot")).where("size > 1")
    )
    members = materialise(banded.join(shared, ["band", "bucket"]))

    wanted = materialise(members.select("id").distinct())
    # A bitmap lets a few others through, whose sets are of no use and no harm.
    sets = materialise(shingle_sets(maybe_in(plain, "id", wanted, "maybe").where("maybe"), shingle))
    signatures = classes.select("id", "signature").join(wanted, "id", "left_semi")
    links = materialise(pivot_links(members, signatures, sets, percent))
    roots = components(links)

    placed = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    placed = materialise(placed.join(sets.select("id", F.length("members").alias("bytes")), "id"))
    open_buckets = materialise(
        placed.groupBy("band", "bucket")
        .agg(F.count("*").alias("n"), F.sum("bytes").alias("all_bytes"), F.min("root").alias("x"), F.max("root").alias("y"))
        .where("x <> y")
        .select(
            "band",
            "bucket",
            F.greatest(F.ceil(F.col("n") / CHUNK_ROWS), F.ceil(F.col("all_bytes") / CHUNK_BYTES)).cast("int").alias("chunks"),
        )
    )
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")
    blocks = (
        placed.join(open_buckets, ["band", "bucket"])
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "band",
            "bucket",
            F.least("chunk", "other").alias("low"),
            F.greatest("chunk", "other").alias("high"),
            "chunk",
            "id",
            "root",
        )
        .join(classes.select("id", "bands", "signature"), "id")
    )
    more = materialise(block_links(blocks, sets, percent))
    if not more.isEmpty():
        roots = components(links.unionByName(more))

    by_digest = classes.select("digest", F.col("id").alias("first")).join(
        roots.select(F.col("id").alias("first"), "root"), "first", "left"
    )
    by_digest = materialise(by_digest.select("digest", F.coalesce("root", "first").alias("component_id")))
    out = facts.select("id", F.col("n").alias("n_shingles"), "digest").join(by_digest, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )


def without_near_duplicates(docs: DataFrame, id_col: str, text_col: str, **settings) -> DataFrame:
    """`docs`, all its columns, with one document of each group.

    Of repeated rows of the one that stays, one row stays. Rows without an id
    or without words stay. Whole rows are shuffled only where a bitmap of the
    ids that go, or stay more than once, does not rule them out.
    """
    with scratch(docs.sparkSession) as keep:
        found = near_duplicates(docs, id_col, text_col, **settings)
        named = found.where(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0))
        per_id = named.groupBy(F.col(id_col).alias("id")).agg(
            F.bool_or(~F.col("kept")).alias("lost"), F.count("*").alias("n")
        )
        marked = keep(per_id.where("lost or n > 1").select("id", "lost"))
    rest = without_keys(docs, id_col, marked.where("lost").select("id"))
    again = marked.where("not lost").select("id")
    maybe, one = unused(docs, "maybe"), unused(docs, "one")
    sorted_out = maybe_in(rest, id_col, again, maybe)
    near = sorted_out.where(F.col(maybe)).drop(maybe)
    match = F.col(f"`{id_col}`") == F.col(one)
    again = again.select(F.col("id").alias(one))
    once = near.join(again, match, "left_semi").dropDuplicates([id_col, text_col])
    return (
        sorted_out.where(~F.col(maybe)).drop(maybe).unionByName(near.join(again, match, "left_anti")).unionByName(once)
    )
