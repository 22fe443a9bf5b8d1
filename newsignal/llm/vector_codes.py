"""Vector codes: parts of integer vectors by learned codebooks, searched under pivot bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, FloatType, LongType, StringType, StructField, StructType

from newsignal.session import materialise

SCALE = 256.0
LARGE_GROUPS = 1000


class Codebooks(NamedTuple):
    """`entries` by part, entry and position; `pivots` by part, pivot and position. All integers."""

    entries: np.ndarray
    pivots: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """No vector missing, no component missing, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite


def largest_component(length: int) -> int:
    """Integers up to this keep squared distances of whole vectors below 2**63."""
    return (isqrt((1 << 63) // length) - 1) // 2


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x), as doubles that hold whole numbers."""
    return np.floor(SCALE * values.astype(np.float64))


def distances(parts: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of parts (n, w) to points (k, w)."""
    gap = parts[:, None, :] - points[None, :, :]
    return np.sqrt(np.einsum("nkw,nkw->nk", gap, gap, dtype=np.float64))


def spread_pivots(entries: np.ndarray, n: int) -> np.ndarray:
    """`n` entries far from each other: each next one has the largest distance to those before."""
    chosen = [0]
    gap = distances(entries, entries[:1])[:, 0]
    while len(chosen) < min(n, len(entries)):
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


def nearest(parts: np.ndarray, near: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest entry of each part; ties go to the lower index.

    `near` are the distances of the parts to the pivots. By the triangle
    inequality |near - distance of pivot and entry| bounds the distance of part
    and entry from below. Entries are evaluated in integers in the order of
    their bounds until the next bound exceeds the best distance found. The
    bounds are lowered by more than their rounding error.
    """
    n, k = len(parts), len(entries)
    between = distances(entries, pivots).astype(np.float32)
    bound = np.zeros((n, k), np.float32)
    for p in range(pivots.shape[0]):
        np.maximum(bound, np.abs(near[:, p, None] - between[None, :, p]), out=bound)
    slack = (near.max(1) + between.max()) * np.float32(2.0**-20)
    bound = np.maximum(bound - slack[:, None], 0).astype(np.float64)
    order = np.argsort(bound, axis=1)
    best = np.full(n, np.iinfo(np.int64).max)
    index = np.full(n, k)
    open_rows = np.arange(n)
    for step in range(k):
        entry = order[open_rows, step]
        reach = bound[open_rows, entry]
        go = reach * reach <= best[open_rows]
        open_rows, entry = open_rows[go], entry[go]
        if not len(open_rows):
            break
        gap = parts[open_rows] - entries[entry]
        found = np.einsum("nw,nw->n", gap, gap)
        better = (found < best[open_rows]) | ((found == best[open_rows]) & (entry < index[open_rows]))
        best[open_rows[better]] = found[better]
        index[open_rows[better]] = entry[better]
    return index, best


def part_table(vectors: DataFrame, vector_col: str, length: int, pivots: np.ndarray) -> DataFrame:
    """`row` (all other columns), `ints` and `near`, the distances of each part to its pivots.

    Both are NULL where the vector has another length or a component is too large.
    """
    n_parts, _, width = pivots.shape
    others = [c for c in vectors.columns if c != vector_col]
    row = F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")
    source = vectors.select(row, F.col(f"`{vector_col}`").alias("vector"))
    limit = largest_component(length)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column(1)
            right = np.asarray(vector.value_lengths()) == length
            values = vector.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
            whole = integers(values)
            fits = (np.abs(whole) <= limit).all(1)
            right[right] = fits
            ints = whole[fits].astype(np.int64)
            parts = ints.reshape(-1, n_parts, width)
            near = np.concatenate([distances(parts[:, p], pivots[p]) for p in range(n_parts)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    spread_lists(right, ints.astype(np.int32)),
                    spread_lists(right, near.astype(np.float32)),
                ],
                ["row", "ints", "near"],
            )

    schema = StructType(
        [
            StructField("row", source.schema["row"].dataType),
            StructField("ints", ArrayType(IntegerType())),
            StructField("near", ArrayType(FloatType())),
        ]
    )
    return materialise(source.mapInArrow(measured, schema))


def spread_lists(present: np.ndarray, values: np.ndarray) -> pa.Array:
    """A list per row of `present`: the next row of `values` where true, NULL where false."""
    ends = np.concatenate([[0], np.cumsum(np.where(present, values.shape[1], 0))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array(~present))


def assigned(batch: pa.RecordBatch, books: Codebooks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which rows have integers, their parts (n, parts, width), and index and distance by part."""
    n_parts, _, width = books.entries.shape
    n_pivots = books.pivots.shape[1]
    ints, near = batch.column(1), batch.column(2)
    present = np.asarray(ints.is_valid())
    parts = ints.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, n_parts, width)
    near = near.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_parts, n_pivots)
    found = [nearest(parts[:, p], near[:, p], books.entries[p], books.pivots[p]) for p in range(n_parts)]
    return present, parts, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def moved(table: DataFrame, books: Codebooks) -> Codebooks:
    """Every used entry replaced by the floor of the mean of its parts.

    A task sends one row per entry: the count and the sums of its parts.
    """
    n_parts, n_entries, width = books.entries.shape

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(n_parts * n_entries, np.int64)
        total = np.zeros((n_parts * n_entries, width), np.int64)
        for batch in batches:
            _, parts, index, _ = assigned(batch, books)
            place = (index + np.arange(n_parts) * n_entries).ravel()
            count += np.bincount(place, minlength=len(count))
            np.add.at(total, place, parts.reshape(-1, width))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(count[used]), spread_lists(np.ones(len(used), bool), total[used])],
            ["place", "n", "sums"],
        )

    added = (
        table.mapInArrow(sums, "place long, n long, sums array<long>")
        .groupBy("place")
        .agg(F.sum("n"), *[F.sum(F.col("sums")[j].cast("decimal(38,0)")) for j in range(width)])
    )
    entries = books.entries.copy()
    for place, n, *total in added.collect():  # at most one row per entry
        entries[place // n_entries, place % n_entries] = [int(t) // n for t in total]
    return Codebooks(entries, books.pivots)


def vector_codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    parts: int = 16,
    entries: int = 64,
    rounds: int = 2,
    pivots: int = 4,
    code: str = "code",
    error: str = "error",
) -> tuple[DataFrame, Codebooks]:
    """Vectors as codes of two hex digits per part, and the codebooks.

    Rows whose vector is NULL, or has a NULL or non-finite component, go. A
    component x becomes floor(256 * x). A part's codebook starts as that part of
    the `entries` smallest ids (equal ids by their vectors, NULL ids last; fewer
    rows make fewer entries). Each round assigns every part to its nearest entry
    and moves used entries to the floor of their parts' mean. Returned are all
    columns but the vector, with `code` and `error`, the sum of squared distances;
    own columns of these names are replaced.

    The usable length is the commonest one that `parts` divides (ties: the
    shorter). Vectors of another length, and those with an integer too large for
    64-bit distances, stay with NULL code and error. Repeated rows each count.
    An empty table gives an empty table and empty codebooks.

    Distances to the pivots, which are fixed, are computed once and written;
    rounds read that table. Nothing is shuffled but one row per entry and task.
    The driver gets `entries` vectors at first and the codebooks each round.
    """
    if not 1 <= entries <= 256 or parts < 1 or pivots < 1:
        raise ValueError("1 to 256 entries, and at least one part and pivot")
    kept = vectors.where(usable(F.col(f"`{vector_col}`")))
    kept = kept.drop(*[c for c in kept.columns if c in (code, error) and c not in (id_col, vector_col)])
    size = F.size(f"`{vector_col}`")
    lengths = kept.where((size > 0) & (size % parts == 0)).groupBy(size.alias("n")).count()
    usual = lengths.orderBy(F.desc("count"), "n").first()
    length = usual["n"] if usual else parts
    limit = largest_component(length)
    scaled = F.transform(f"`{vector_col}`", lambda x: x.cast("double") * SCALE)
    fits = F.forall(scaled, lambda y: (y >= -limit) & (y < limit + 1))
    first = (
        kept.where((size == length) & fits)
        .select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
        .orderBy(F.asc_nulls_last("id"), "v")
        .limit(entries)
        .collect()
    )
    seeds = integers(np.array([r["v"] for r in first]).reshape(len(first), length)).astype(np.int64)
    start = np.ascontiguousarray(seeds.reshape(len(first), parts, length // parts).swapaxes(0, 1))
    fixed = [spread_pivots(start[p], pivots) for p in range(parts)] if first else []
    books = Codebooks(start, np.stack(fixed) if fixed else np.zeros((parts, 0, length // parts), np.int64))
    fields = [f for f in kept.schema if f.name != vector_col]
    schema = StructType([*fields, StructField(code, StringType()), StructField(error, LongType())])
    if not first:  # no vector has a length to learn from
        none = {code: F.lit(None).cast("string"), error: F.lit(None).cast("long")}
        return kept.drop(vector_col).withColumns(none), books
    table = part_table(kept, vector_col, length, books.pivots)
    for _ in range(rounds):
        books = moved(table, books)
    final = books

    def coded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            present, _, index, far = assigned(batch, final)
            codes = np.full(len(present), None, object)
            codes[present] = [row.tobytes().hex() for row in index.astype(np.uint8)]
            errors = np.zeros(len(present), np.int64)
            errors[present] = far.sum(1)
            yield pa.RecordBatch.from_arrays(
                [*batch.column(0).flatten(), pa.array(codes, pa.string()), pa.array(errors, mask=~present)],
                schema.names,
            )

    return table.mapInArrow(coded, schema), books


def with_group_total(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """`df` with `out`, the sum of `value` over the rows of equal `group`, NULLs being one group.

    The totals of the 1,000 largest groups are broadcast, so their rows stay where
    they are; each other group has under a thousandth of the rows and is joined
    by its key. A sum of NULLs alone, or beyond 64 bits, is NULL. `df` is read
    twice and should be a written table.
    """
    totals = materialise(df.groupBy(F.col(group).alias("_g")).agg(F.try_sum(value).alias(out), F.count("*").alias("_n")))
    large = totals.orderBy(F.desc("_n"), "_g").limit(LARGE_GROUPS)
    ids = large.select(F.col("_g").alias("_large"))
    small = totals.join(F.broadcast(ids), F.col("_g").eqNullSafe(F.col("_large")), "left_anti")
    match = F.col(group).eqNullSafe(F.col("_g"))
    here = df.join(F.broadcast(large), match)
    there = df.join(F.broadcast(large), match, "left_anti").join(small, match)
    return here.unionByName(there).drop("_g", "_n")
