"""Time as address: slot numbers of (time, tenant), over epochs with different numbers of tenants, and packed points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slots of a page: 16 bytes each, and 8 bytes each.
SLOTS, SMALL_SLOTS = 509, 1018


def slot(t: Column, tenant: Column, scale: int) -> Column:
    return t * scale + tenant


def slot_address(at: Column, scale: int) -> tuple[Column, Column]:
    """(t, tenant) of a slot."""
    return F.floor(at / scale).cast("long"), F.pmod(at, F.lit(scale))


def block(at: Column, slots: int = SLOTS) -> tuple[Column, Column]:
    """(page, place in it) of a slot, from 0."""
    return F.floor(at / slots).cast("long"), F.pmod(at, F.lit(slots))


Epochs = list[tuple[int, int, int]]


def _by_epoch(known: Column, firsts: list[int], each: list[Column]) -> Column:
    """The value of the last epoch whose first is at most `known`; before all, that of the first epoch."""
    return reduce(lambda rest, x: F.when(known >= x[0], x[1]).otherwise(rest), zip(firsts[1:], each[1:], strict=True), each[0])


def epoch_slot(t: Column, tenant: Column, epochs: Epochs) -> Column:
    """Slot in a timeline of epochs (start, scale, base), by start; times before the first and after the last use these."""
    epochs = sorted(epochs)
    return _by_epoch(t, [e[0] for e in epochs], [F.lit(base) + (t - start) * scale + tenant for start, scale, base in epochs])


def epoch_address(at: Column, epochs: Epochs) -> tuple[Column, Column]:
    """(t, tenant) of a slot in a timeline of epochs."""
    epochs, bases = sorted(epochs), [e[2] for e in sorted(epochs)]
    of = [(F.floor((at - base) / scale) + start, F.pmod(at - base, F.lit(scale))) for start, scale, base in epochs]
    return _by_epoch(at, bases, [t for t, _ in of]).cast("long"), _by_epoch(at, bases, [x for _, x in of]).cast("long")


def pack_slots(rows: DataFrame, scale: int, compact: bool = False, every: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """rows (t, tenant, value) as (slot, value), or compactly as (slot, t int, value float), with the columns of `by`.

    Negative times and tenants outside [0, scale) are left out, as their slots are those of other addresses. With `every` they
    stay, also those without a time or tenant; name in `by` what tells rows of a slot apart.
    """
    inside = rows if every else rows.where((F.col("t") >= 0) & F.col("tenant").between(0, scale - 1))
    inside = inside.withColumn("slot", slot(F.col("t"), F.col("tenant"), scale))
    return inside.select("slot", F.col("t").cast("int"), F.col("value").cast("float"), *by) if compact else inside.select("slot", "value", *by)


def scan_slots(packed: DataFrame, scale: int) -> DataFrame:
    """Every packed row as (t, tenant, value)."""
    t, tenant = slot_address(F.col("slot"), scale)
    return packed.select(t.alias("t"), tenant.alias("tenant"), "value")


def read_slot(packed: DataFrame, t: int, tenant: int, scale: int) -> DataFrame:
    """The value at an address, in no row or one: a point filter that Parquet's statistics serve."""
    return packed.where(F.col("slot") == t * scale + tenant).select("value").limit(1)


def read_slots(packed: DataFrame, points: DataFrame, scale: int, by: tuple[str, ...]) -> DataFrame:
    """The packed rows of some points (t, tenant, ...), few enough to broadcast; `by` tells rows of a slot apart."""
    at = points.select(slot(F.col("t"), F.col("tenant"), scale).alias("slot"), *by)
    return _of_points(packed, at, "slot", *by)


def _of_points(rows: DataFrame, points: DataFrame, *names: str) -> DataFrame:
    rows, points = rows.alias("r"), F.broadcast(points.select(*names).distinct()).alias("p")
    return rows.join(points, reduce(lambda a, b: a & b, [F.col(f"r.{n}").eqNullSafe(F.col(f"p.{n}")) for n in names]), "left_semi")


def page_stats(packed: DataFrame, scale: int, slots: int = SLOTS) -> DataFrame:
    """By page: rows, part of its slots filled, the addresses it spans, and whether its rows lie in slot order without gaps."""
    page, _ = block(F.col("slot"), slots)
    by = packed.groupBy(page.alias("page")).agg(F.count("*").alias("rows"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    (t0, n0), (t1, n1) = slot_address(F.col("low"), scale), slot_address(F.col("high"), scale)
    return by.select("page", "rows", (F.col("rows") / slots).alias("fill"), t0.alias("first_t"), n0.alias("first_tenant"), t1.alias("last_t"), n1.alias("last_tenant"), (F.col("high") - F.col("low") + 1 == F.col("rows")).alias("dense"))


def pack_blocks(rows: DataFrame, seconds: int = 64, by: tuple[str, ...] = ()) -> DataFrame:
    """(block, tenant, points): the (t, value) pairs of each tenant and block of seconds, with the columns of `by`, in order; lossless.

    An array holds the points of one tenant in `seconds`, so keep that short where tenants are hot.
    """
    return rows.groupBy(F.floor(F.col("t") / seconds).alias("block"), "tenant").agg(F.array_sort(F.collect_list(F.struct("t", "value", *by))).alias("points"))


def scan_blocks(blocks: DataFrame) -> DataFrame:
    """Every point as (t, tenant, value)."""
    return blocks.select("tenant", F.inline("points")).select("t", "tenant", "value")


def read_block(blocks: DataFrame, number: int, tenant: int) -> DataFrame:
    return blocks.where((F.col("block") == number) & (F.col("tenant") == tenant)).select(F.inline("points"))


def read_block_point(blocks: DataFrame, t: int, tenant: int, seconds: int = 64) -> DataFrame:
    """The value at an address, in no row or one."""
    return read_block(blocks, t // seconds, tenant).where(F.col("t") == t).select("value").limit(1)


def read_block_points(blocks: DataFrame, points: DataFrame, by: tuple[str, ...], seconds: int = 64) -> DataFrame:
    """The points of blocks at the addresses of some points (t, tenant, ...), few enough to broadcast; `by` tells those of an address apart."""
    held = _of_points(blocks, points.withColumn("block", F.floor(F.col("t") / seconds)), "block", "tenant")
    return _of_points(held.select("tenant", F.inline("points")), points, "t", "tenant", *by)
