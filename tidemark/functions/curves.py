"""Locality keys: Morton and Hilbert codes, boxes in them, and clustering by them.

Codes are made for an Arrow batch at a time: as Spark expressions the shifts of a code nest to thousands of terms a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

# fixed values: masks that spread 32 bits to every second of 64
_SPREAD = tuple((np.uint64(by), np.uint64(mask)) for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)))
# fixed values: masks that spread 21 bits to every third of 63
_SPREAD3 = tuple((np.uint64(by), np.uint64(mask)) for by, mask in ((32, 0x1F00000000FFFF), (16, 0x1F0000FF0000FF), (8, 0x100F00F00F00F00F), (4, 0x10C30C30C30C30C3), (2, 0x1249249249249249)))
_LOW32, _LOW21, _ONE = np.uint64(0xFFFFFFFF), np.uint64((1 << 21) - 1), np.uint64(1)
# fixed values: start and factor of the FNV-1a hash of 64 bits
_FNV_START, _FNV_FACTOR = 14695981039346656037, 1099511628211


def _spread(x: np.ndarray) -> np.ndarray:
    x = x & _LOW32
    for by, mask in _SPREAD:
        x = (x | x << by) & mask
    return x


def _gathered(x: np.ndarray) -> np.ndarray:
    """Every second bit of each number, from the lowest on, side by side."""
    x = x & _SPREAD[-1][1]
    for (by, _), (_, mask) in zip(_SPREAD[::-1], (*_SPREAD[-2::-1], (None, _LOW32)), strict=True):
        x = (x | x >> by) & mask
    return x


def _spread3(x: np.ndarray) -> np.ndarray:
    x = x & _LOW21
    for by, mask in _SPREAD3:
        x = (x | x << by) & mask
    return x


_DIGITS = np.frombuffer("".join(f"{b:02X}" for b in range(256)).encode(), np.uint16)
_VALUES = np.full(256, 255, np.uint8)
for _i, _c in enumerate(b"0123456789ABCDEF"):
    _VALUES[_c] = _VALUES[_c | 0x20] = _i


def _numbers(*columns: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Longs as unsigned numbers, and which rows have all of them."""
    known = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in columns])
    return [c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64) for c in columns], known


def _hex128(high: np.ndarray, low: np.ndarray, known: np.ndarray) -> pa.Array:
    """32 upper-case hex digits of two numbers of 64 bits; they sort as the unsigned 128-bit numbers do. Unknown rows are null."""
    digits = _DIGITS[np.stack([high, low], axis=1).astype(">u8").view(np.uint8)]
    ends = np.arange(0, 32 * len(high) + 1, 32, dtype=np.int32)  # a batch has some thousand rows
    lost = None if known.all() else pa.array(known).buffers()[1]
    return pa.Array.from_buffers(pa.string(), len(high), [lost, pa.py_buffer(ends), pa.py_buffer(digits)])


def _halves(codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two halves of codes, and which rows hold one: 32 hex digits."""
    known = pc.equal(pc.binary_length(codes), 32).fill_null(False)
    texts = pc.if_else(known, codes, "0" * 32)
    text = np.frombuffer("".join(texts.to_pylist()).encode(), np.uint8).reshape(-1, 32)
    values = _VALUES[text]
    known = known.to_numpy(zero_copy_only=False) & (values < 16).all(axis=1)
    halves = (values[:, ::2] << 4 | values[:, 1::2]).copy().view(">u8").astype(np.uint64)
    return halves[:, 0], halves[:, 1], known


@F.arrow_udf(StringType())
def _morton2(x: pa.Array, y: pa.Array) -> pa.Array:
    (x, y), known = _numbers(x, y)
    half = lambda a, b: _spread(a) | _spread(b) << _ONE
    return _hex128(half(x >> np.uint64(32), y >> np.uint64(32)), half(x, y), known)


def _points(codes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The two longs of each code, and which rows hold a code."""
    high, low, known = _halves(codes)
    join = lambda a, b: (_gathered(a) << np.uint64(32) | _gathered(b)).view(np.int64)
    return join(high, low), join(high >> _ONE, low >> _ONE), known


@F.arrow_udf(StructType().add("x", LongType()).add("y", LongType()))
def _demorton2(codes: pa.Array) -> pa.Array:
    x, y, known = _points(codes)
    return pa.StructArray.from_arrays([pa.array(x, mask=~known), pa.array(y, mask=~known)], ["x", "y"])


def morton2(x: Column, y: Column) -> Column:
    """128-bit code of two longs, x in even bits, as 32 upper-case hex digits."""
    return _morton2(x.cast("long"), y.cast("long"))


def demorton2(code: Column) -> tuple[Column, Column]:
    """The two longs of a code; null where there is none."""
    both = _demorton2(code)
    return both["x"], both["y"]


def fold_dims(dims: list[Column]) -> Column:
    """One number from several integer dimensions: each shifted by its place (mod 8), joined by xor; nulls are left out."""
    return reduce(lambda a, b: a.bitwiseXOR(b), [F.coalesce(F.shiftleft(d.cast("long"), i % 8), F.lit(0).cast("long")) for i, d in enumerate(dims)])


@F.pandas_udf(LongType())
def fnv64(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """64-bit FNV-1a hash of UTF-8 bytes, as a signed long; each distinct text of a batch is hashed once. Null stays null."""
    for batch in texts:
        known = {}
        for text in batch.dropna().unique():
            h = _FNV_START
            for byte in text.encode():
                h = (h ^ byte) * _FNV_FACTOR & 0xFFFF_FFFF_FFFF_FFFF
            known[text] = h - (1 << 64) if h >> 63 else h
        yield batch.map(known).astype("Int64")


def morton_text(t: Column, dims: list[Column]) -> Column:
    """Code of a time and several text dimensions, folded by their FNV-1a hashes."""
    return morton2(t.cast("long"), fold_dims([fnv64(d) for d in dims]))


def spiraling_code(t: Column, cycle: Column, lane: Column) -> Column:
    return morton_text(t, [cycle.cast("string"), lane.cast("string")])


def spiral_box(t: Column, cycle: int, size: int = 10) -> Column:
    """The box of `size` whose low corner is the place of t in its cycle and the cycle's number."""
    x, y = F.pmod(t, F.lit(cycle)).cast("double"), F.floor(t / cycle).cast("double")
    return F.struct(x.alias("x0"), y.alias("y0"), (x + size).alias("x1"), (y + size).alias("y1"))


@F.arrow_udf(StringType())
def _morton3(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
    dims, known = _numbers(x, y, z)
    # 21 bits of each make 63 of the code
    below, above = (reduce(np.bitwise_or, [_spread3(d >> by) << np.uint64(i) for i, d in enumerate(dims)]) for by in (np.uint64(0), np.uint64(21)))
    return _hex128(above >> _ONE, below | above << np.uint64(63), known)


def morton3(x: Column, y: Column, z: Column) -> Column:
    """126-bit code of the low 42 bits of three numbers, x lowest, as 32 upper-case hex digits."""
    return _morton3(x.cast("long"), y.cast("long"), z.cast("long"))


@F.arrow_udf(StringType())
def _hilbert2(x: pa.Array, y: pa.Array) -> pa.Array:
    (x, y), known = _numbers(x, y)
    halves = []
    for half in range(2):
        place = np.zeros(len(x), np.uint64)
        for i in range(63 - 32 * half, 31 - 32 * half, -1):
            a, b = x >> np.uint64(i) & _ONE, y >> np.uint64(i) & _ONE
            place = place << np.uint64(2) | a << _ONE | (a ^ b)
            turn = b - _ONE  # all bits where b is 0
            mirror = turn & (_ONE + ~a)  # all bits where b is 0 and a is 1
            swap = (x ^ y) & turn
            x, y = x ^ mirror ^ swap, y ^ mirror ^ swap
        halves.append(place)
    return _hex128(*halves, known)


def hilbert2(x: Column, y: Column) -> Column:
    """128-bit place of two longs on the Hilbert curve, as 32 upper-case hex digits.

    From the highest bit down, each pair of bits says which quarter comes next; in two of the four the
    curve runs mirrored or turned, which is applied to the lower bits.
    """
    return _hilbert2(x.cast("long"), y.cast("long"))


def box_ranges(x0: int, y0: int, x1: int, y1: int, bits: int = 32, most: int = 256) -> list[tuple[int, int]]:
    """Ranges [low, high] of Morton codes that cover the box of whole numbers, corners included.

    Quarters wholly inside are taken whole, quarters outside left out, others cut again, the largest first. With `most`
    ranges the rest is taken whole as well, so the ranges may hold points outside: keep the box's own condition.
    """
    todo, done = [(bits, 0, 0, 0)], []
    while todo:
        size, x, y, code = todo.pop(0)
        last = (1 << size) - 1
        if x > x1 or y > y1 or x + last < x0 or y + last < y0:
            continue
        inside = x >= x0 and y >= y0 and x + last <= x1 and y + last <= y1
        if inside or size == 0 or len(todo) + len(done) >= most:
            done.append((code, code + (1 << 2 * size) - 1))
            continue
        half = size - 1
        todo += [(half, x + (k & 1) * (1 << half), y + (k >> 1) * (1 << half), code + (k << 2 * half)) for k in range(4)]
    out: list[tuple[int, int]] = []
    for low, high in sorted(done):
        if out and low == out[-1][1] + 1:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def in_ranges(code: Column, ranges: list[tuple[int, int]]) -> Column:
    """Whether a code is in one of the ranges, found by binary search of their ends."""
    ranges = sorted(ranges)
    low, high = (np.array([f"{r[i]:032X}" for r in ranges], "S32") for i in (0, 1))
    # overlapping ranges count up to the highest end so far
    for i in range(1, len(ranges)):
        high[i] = max(high[i], high[i - 1])

    @F.arrow_udf(BooleanType())
    def within(codes: pa.Array) -> pa.Array:
        text = np.array(codes.cast(pa.binary()).fill_null(b"").to_pylist(), "S")
        at = low.searchsorted(text, "right") - 1
        found = (at >= 0) & (text <= high[at]) if len(low) else np.zeros(len(text), bool)
        return pa.array(found, mask=codes.is_null().to_numpy(zero_copy_only=False))

    return within(code)


def in_box(code: Column, x0: int, y0: int, x1: int, y1: int) -> Column:
    """Whether the point of a code is in the box, corners included."""

    @F.arrow_udf(BooleanType())
    def within(codes: pa.Array) -> pa.Array:
        x, y, known = _points(codes)
        return pa.array((x >= x0) & (x <= x1) & (y >= y0) & (y <= y1), mask=~known)

    return within(code)


def cluster(df: DataFrame, path: str, x: Column, y: Column, files: int) -> None:
    """Writes df with near values of x and y in the same files and row groups."""
    df.withColumn("__key", morton2(x, y)).repartitionByRange(files, "__key").sortWithinPartitions("__key").drop("__key").write.parquet(path)
