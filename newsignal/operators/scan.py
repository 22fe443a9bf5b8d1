"""Running values y -> factor * y + value over long series, in blocks.

A row is a map of the running value; rows without a value are the identity.
Maps compose: the rows of a block make one map, so a block enters with what the
maps of the blocks before it make of the starting value, and every block is
evaluated on its own. Exponential means (factor < 1) and running totals
(factor 1) are both scans.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from newsignal.operators.ordered import block_window

FAN = 256


class Scan(NamedTuple):
    """`value` is a column of the blocked rows; the running value starts at 0, or with
    `from_first` at the first known `value` divided by 1 - factor."""

    name: str
    value: str
    factor: float = 1.0
    from_first: bool = False


def _so_far(key: str) -> WindowSpec:
    return block_window(key).rowsBetween(Window.unboundedPreceding, 0)


def _known(scan: Scan) -> Column:
    """The value of the block's own rows."""
    return F.when(F.col("_core"), F.col(scan.value))


def _folded(maps: Column, scan: Scan) -> Column:
    """The maps of a list of blocks as one map, from left to right."""
    a, b = f"a_{scan.name}", f"b_{scan.name}"
    return F.aggregate(
        maps,
        F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b")),
        lambda y, m: F.struct((y["a"] * m[a]).alias("a"), (y["b"] * m[a] + m[b]).alias("b")),
    )


def block_maps(blocked: DataFrame, key: str, scans: Sequence[Scan]) -> DataFrame:
    """(key, _block, a_<scan>, b_<scan>, n_<scan>, first_<scan>): the map of each block.

    `blocked` has `_pos`, `_block` and `_core`. Totals keep the type of their values.
    """
    counts = {f"_c_{s.name}": F.count(_known(s)).over(_so_far(key)) for s in scans if 0 < s.factor < 1}
    parts = []
    for s in scans:
        value, place = _known(s), F.when(_known(s).isNotNull(), F.col("_pos"))
        if s.factor == 1:
            b = F.sum(value)
        elif s.factor == 0:
            b = F.coalesce(F.max_by(value, place), F.lit(0.0))
        else:
            b = F.sum(value * F.pow(F.lit(s.factor), -F.col(f"_c_{s.name}"))) * F.pow(F.lit(s.factor), F.count(value))
        parts += [
            F.pow(F.lit(s.factor), F.count(value)).alias(f"a_{s.name}"),
            F.coalesce(b, F.lit(0)).alias(f"b_{s.name}"),
            F.count(value).alias(f"n_{s.name}"),
            F.min_by(value, place).alias(f"first_{s.name}"),
        ]
    return blocked.withColumns(counts).groupBy(key, "_block").agg(*parts)


def block_carries(maps: DataFrame, key: str, scans: Sequence[Scan]) -> DataFrame:
    """(key, _block, _in_<scan>, _n_<scan>): the running value that enters a block and the values before it.

    Blocks are folded in groups of 256 and groups per key, so that the longest
    list a task holds is one of a key's groups, rows / 256 / block rows.
    """
    names = [f"{p}_{s.name}" for s in scans for p in ("a", "b", "n", "first")]
    maps = maps.withColumn("_group", F.floor(F.col("_block") / FAN)).withColumn("_map", F.struct("_block", *names))
    inside = Window.partitionBy(key, "_group").orderBy("_block")
    across = Window.partitionBy(key).orderBy("_group")

    def earlier(w: WindowSpec) -> WindowSpec:
        return w.rowsBetween(Window.unboundedPreceding, -1)

    def sums(prefix: str, w: WindowSpec) -> dict[str, Column]:
        """Values before, and totals before for scans of factor 1."""
        out = {f"{prefix}n_{s.name}": F.coalesce(F.sum(f"n_{s.name}").over(earlier(w)), F.lit(0)) for s in scans}
        return out | {
            f"{prefix}b_{s.name}": F.coalesce(F.sum(f"b_{s.name}").over(earlier(w)), F.lit(0))
            for s in scans
            if s.factor == 1
        }

    groups = maps.groupBy(key, "_group").agg(
        F.array_sort(F.collect_list("_map")).alias("_maps"),
        *[F.sum(f"n_{s.name}").alias(f"n_{s.name}") for s in scans],
        *[F.sum(f"b_{s.name}").alias(f"b_{s.name}") for s in scans if s.factor == 1],
        *[F.min_by(f"first_{s.name}", F.when(F.col(f"n_{s.name}") > 0, F.col("_block"))).alias(f"first_{s.name}") for s in scans],
    )
    decaying = [s for s in scans if s.factor != 1]
    folded = {f"_f_{s.name}": _folded(F.col("_maps"), s) for s in decaying}
    groups = groups.withColumns(folded).drop("_maps") if decaying else groups.drop("_maps")

    def entering(s: Scan) -> Column:
        """The value that enters a group."""
        whole = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        start = F.first(f"first_{s.name}", ignorenulls=True).over(whole) / (1 - s.factor) if s.from_first else F.lit(0.0)
        before = F.collect_list(F.struct(F.col(f"_f_{s.name}.a").alias(f"a_{s.name}"), F.col(f"_f_{s.name}.b").alias(f"b_{s.name}")))
        folded = _folded(before.over(earlier(across)), s)
        return folded["a"] * start + folded["b"]

    groups = groups.withColumns({**sums("_outer_", across), **{f"_outer_{s.name}": entering(s) for s in decaying}})
    groups = groups.select(key, "_group", *[c for c in groups.columns if c.startswith("_outer_")])
    local = maps.withColumns(
        {**sums("_inner_", inside), **({"_maps": F.collect_list("_map").over(earlier(inside))} if decaying else {})}
    )
    joined = local.join(groups, [key, "_group"])
    carried = {}
    for s in scans:
        if s.factor == 1:
            carried[f"_in_{s.name}"] = F.col(f"_inner_b_{s.name}") + F.col(f"_outer_b_{s.name}")
        else:
            folded = _folded(F.col("_maps"), s)
            carried[f"_in_{s.name}"] = folded["a"] * F.col(f"_outer_{s.name}") + folded["b"]
        carried[f"_n_{s.name}"] = F.col(f"_inner_n_{s.name}") + F.col(f"_outer_n_{s.name}")
    return joined.select(key, "_block", *[c.alias(n) for n, c in carried.items()])


def with_scans(blocked: DataFrame, carries: DataFrame, key: str, scans: Sequence[Scan]) -> DataFrame:
    """`blocked` with a column per scan; NULL until the first known value of the key."""
    so_far = _so_far(key)
    out = blocked.join(carries, [key, "_block"])
    out = out.withColumns({f"_c_{s.name}": F.count(_known(s)).over(so_far) for s in scans})
    columns = {}
    for s in scans:
        carry, count = F.col(f"_in_{s.name}"), F.col(f"_c_{s.name}")
        if s.factor == 1:
            value = F.coalesce(F.sum(_known(s)).over(so_far), F.lit(0)) + carry
        elif s.factor == 0:
            value = F.coalesce(F.last(_known(s), ignorenulls=True).over(so_far), carry)
        else:
            scaled = F.sum(_known(s) * F.pow(F.lit(s.factor), -count)).over(so_far)
            value = (F.coalesce(scaled, F.lit(0.0)) + carry) * F.pow(F.lit(s.factor), count)
        columns[s.name] = F.when(count + F.col(f"_n_{s.name}") > 0, value)
    extra = [c for s in scans for c in (f"_c_{s.name}", f"_in_{s.name}", f"_n_{s.name}")]
    return out.withColumns(columns).drop(*extra)
