"""Byte blocks: codecs, deltas, checksums and references, in Arrow batches."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 4096


def memdelta(a: bytes, b: bytes) -> int:
    """Difference of lengths plus differing bytes of the common part."""
    n = min(len(a), len(b))
    return abs(len(a) - len(b)) + int((np.frombuffer(a[:n], np.uint8) != np.frombuffer(b[:n], np.uint8)).sum())


def memdeltas(a: pa.Array, b: pa.Array) -> pa.Array:
    """``memdelta`` of each pair of two binary arrays; null if either is. The bytes of a batch are
    compared together."""
    valid = pa.compute.and_(a.is_valid(), b.is_valid()).to_numpy(zero_copy_only=False)
    x, y = (pa.compute.fill_null(c, b"") for c in (a, b))
    nx, ny = (pa.compute.binary_length(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (x, y))
    both = np.minimum(nx, ny)

    def heads(c: pa.Array) -> np.ndarray:
        raw = b"".join(part[:n] for part, n in zip(c.to_pylist(), both.tolist(), strict=True))
        return np.frombuffer(raw, np.uint8)

    unlike = np.concatenate([[0], np.cumsum(heads(x) != heads(y))])
    ends = np.cumsum(both)
    out = np.abs(nx - ny) + unlike[ends] - unlike[ends - both]
    return pa.array(out, pa.int64(), mask=~valid)


@F.arrow_udf(T.LongType())
def memdelta_of(a: pa.Array, b: pa.Array) -> pa.Array:
    return memdeltas(a, b)


def deltas(rows: DataFrame) -> DataFrame:
    """``rows`` (file_id, blk, data, was, old) with the trimmed bytes ``new``, their lengths, how many
    bytes differ and whether the new begin with the old."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [(x or b"").rstrip(b"\0") for x in batch.column(2).to_pylist()]
            old = [(x or b"").rstrip(b"\0") for x in batch.column(4).to_pylist()]
            new_, old_ = pa.array(new, pa.binary()), pa.array(old, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), new_, old_, pa.array([len(x) for x in new], pa.int64()), pa.array([len(x) for x in old], pa.int64()), memdeltas(new_, old_), pa.array([x.startswith(y) for x, y in zip(new, old, strict=True)])],
                ["file_id", "blk", "was", "new", "old", "new_len", "old_len", "delta", "starts"],
            )

    return rows.select("file_id", "blk", "data", "was", "old").mapInArrow(run, "file_id long, blk long, was string, new binary, old binary, new_len long, old_len long, delta long, starts boolean")


@F.pandas_udf(T.BinaryType())
def stripped(data: pd.Series) -> pd.Series:
    """Without trailing zero bytes."""
    return data.map(lambda x: x.rstrip(b"\0") if x is not None else None)


def whole_chunks(data: bytes) -> list[tuple[int, bytes]]:
    """(offset, bytes) of the chunks that are not all zero, each without trailing zeros."""
    parts = ((at, data[at : at + CHUNK].rstrip(b"\0")) for at in range(0, len(data), CHUNK))
    return [(at, part) for at, part in parts if part]


def to_chunks(blocks: DataFrame) -> DataFrame:
    """(file_id, blk, rev, off, data) out of whole blocks (file_id, blk, rev, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, at, part) for i, data in enumerate(batch.column(3).to_pylist()) for at, part in whole_chunks(data or b"")]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(3)), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["file_id", "blk", "rev", "off", "data"])

    return blocks.select("file_id", "blk", "rev", "data").mapInArrow(run, "file_id long, blk long, rev long, off int, data binary")


def changed_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """Chunks to write so that ``old`` becomes ``new``; data is null where one goes. Keys: file_id,
    blk, off."""
    keys = ["file_id", "blk", "off"]
    both = new.select(*keys, F.col("data").alias("now")).join(old.select(*keys, F.col("data").alias("was")), keys, "full_outer")
    return both.where(~F.col("now").eqNullSafe(F.col("was"))).select(*keys, F.col("now").alias("data"))


def stitch(chunks: list[tuple[int, bytes]], blksize: int | None = None) -> bytes:
    """A block from its chunks, zeros between. Offsets must be unique, not negative, not overlap and
    not overrun the block."""
    out, end, before = bytearray(), 0, None
    for at, data in sorted(chunks):
        if at < 0:
            raise ValueError(f"invalid data: offset {at} < 0")
        if at == before:
            raise ValueError(f"invalid data: two chunks at {at}")
        before = at
        if at < end:
            raise ValueError(f"invalid data: chunk at {at} overlaps one that ends at {end}")
        out += bytes(at - end) + data
        end = at + len(data)
    if blksize is not None and end > blksize:
        raise ValueError(f"invalid data: it ends at {end}, behind the block's {blksize}")
    return bytes(out)


def from_chunks(chunks: DataFrame, blksize: int) -> DataFrame:
    """(file_id, blk, data): blocks of bounded size, so each group is bounded."""
    parts = chunks.groupBy("file_id", "blk").agg(F.collect_list(F.struct("off", "data")).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [stitch([(p["off"], p["data"]) for p in parts], blksize) for parts in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary())], ["file_id", "blk", "data"])

    return parts.mapInArrow(run, "file_id long, blk long, data binary")


def auto_format(blk: Column, last_blk: Column, old_len: Column, new_len: Column, starts_with_old: Column, delta: Column, blksize: int) -> Column:
    """Which codec to write: whole blocks, or chunks for small changes of blocks that are not full."""
    append = ((blk == last_blk) & starts_with_old) | ((blk == last_blk + 1) & (old_len == 0))
    few = delta < F.lit(0.5 * blksize)
    return F.when(append, F.when(few & (new_len != blksize), "ZBlk1").otherwise("ZBlk0")).otherwise(F.when(few, "ZBlk1").otherwise("ZBlk0"))


def adler32_combine(first: int, second: int, length: int) -> int:
    """adler32 of two parts joined, from each part's and the second's length."""
    base = 65521
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    return ((b1 + b2 + length * (a1 - 1)) % base) << 16 | (a1 + a2 - 1) % base


def zeros_adler32(n: int) -> int:
    """adler32 of ``n`` zero bytes: the first sum stays 1, the second counts them."""
    return (n % 65521) << 16 | 1


def adler32(blocks: DataFrame, blksize: int, per_run: int = 4096) -> int:
    """Checksum of a file of blocks (blk, data), holes as zeros. Blocks are summed where they are and
    joined by runs of ``per_run``; the driver gets one number a run that has blocks."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.adler32((x or b"").ljust(blksize, b"\0")) for x in batch.column(1).to_pylist()], pa.int64())], ["blk", "a"])

    def joined(parts: list[tuple[int, int, int]]) -> int:
        """Of (first byte, bytes, sum) in order, from byte 0 on."""
        out, end = 1, 0
        for at, n, a in parts:
            if at > end:
                out = adler32_combine(out, zeros_adler32(at - end), at - end)
            out, end = adler32_combine(out, a, n), at + n
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for g, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = g * per_run
                sums.append(joined(sorted(((p["blk"] - base) * blksize, blksize, p["a"]) for p in parts)))
            last = [max(p["blk"] for p in parts) + 1 for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(last, pa.int64()), pa.array(sums, pa.int64())], ["g", "last", "a"])

    sums = blocks.select(F.col("blk").cast("long").alias("blk"), "data").mapInArrow(one, "blk long, a long")
    runs = sums.groupBy(F.expr(f"blk div {per_run}").alias("g")).agg(F.collect_list(F.struct("blk", "a")).alias("parts")).mapInArrow(run, "g long, last long, a long")
    return joined(sorted((r["g"] * per_run * blksize, (r["last"] - r["g"] * per_run) * blksize, r["a"]) for r in runs.collect()))


def digests(blocks: DataFrame, blksize: int) -> DataFrame:
    """(blk, md5) of each block (blk, data), filled up with zeros."""
    zeros = F.unhex(F.repeat(F.lit("00"), F.lit(blksize) - F.octet_length("data")))
    return blocks.select("blk", F.md5(F.concat("data", zeros)).alias("md5"))


class InvalidArrayRef(Exception):
    """A reference that its root can't satisfy."""


@dataclass(frozen=True)
class ArrayRef:
    """A view as data: bytes [lo, hi) of a root, of which item 0 is at lo + z0."""

    root: str
    lo: int
    hi: int
    z0: int
    shape: tuple[int, ...]
    strides: tuple[int, ...]
    dtype: str

    @classmethod
    def of(cls, root_name: str, root: np.ndarray, view: np.ndarray) -> ArrayRef:
        begin = root.__array_interface__["data"][0]
        at = view.__array_interface__["data"][0] - begin
        low = at + sum(min(0, (n - 1) * s) for n, s in zip(view.shape, view.strides, strict=True) if n)
        high = at + sum(max(0, (n - 1) * s) for n, s in zip(view.shape, view.strides, strict=True) if n) + view.itemsize
        return cls(root_name, low, high, at - low, view.shape, view.strides, view.dtype.str)

    def check(self, length: int) -> None:
        """Can a root of ``length`` bytes satisfy the reference?"""
        d = np.dtype(self.dtype)
        if not 0 <= self.lo <= self.hi <= length:
            raise InvalidArrayRef(f"bytes [{self.lo}, {self.hi}) are not in the root's {length}")
        if not 0 <= self.z0 < max(1, self.hi - self.lo):
            raise InvalidArrayRef(f"item 0 at {self.z0} is outside")
        if len(self.shape) != len(self.strides):
            raise InvalidArrayRef("shape and strides differ in length")
        if any(not isinstance(n, int) or n < 0 for n in self.shape):
            raise InvalidArrayRef("the shape has to be of integers from 0")
        if prod(self.shape):
            low = self.z0 + sum(min(0, (n - 1) * s) for n, s in zip(self.shape, self.strides, strict=True))
            high = self.z0 + sum(max(0, (n - 1) * s) for n, s in zip(self.shape, self.strides, strict=True)) + d.itemsize
            if low < 0 or high > self.hi - self.lo:
                raise InvalidArrayRef("the items lie outside the bytes referred to")

    def deref(self, data: bytes) -> np.ndarray:
        self.check(len(data))
        return np.ndarray(self.shape, np.dtype(self.dtype), np.frombuffer(data, np.uint8)[self.lo : self.hi], self.z0, self.strides)
