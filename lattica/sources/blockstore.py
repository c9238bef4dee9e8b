"""Files of byte blocks under version control, each block whole or in chunks.

Rows (file_id, blk, rev, fmt, off, data): a whole block is one row at offset 0; of a block in chunks
a revision has the chunks that changed, with null data where one went. A block is as its last whole
row says, or as its last chunks since the block was first stored in chunks. Trailing zeros aren't
stored, nor are chunks of zeros; a block without rows is a hole."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import CHUNK, auto_format, deltas, stitch, to_chunks

#: Names of the formats.
WHOLE, CHUNKED, AUTO = "ZBlk0", "ZBlk1", "auto"
ROWS = "file_id long, blk long, rev long, fmt string, off int, data binary"
_KEYS = ["file_id", "blk"]


def codec(name: str) -> str:
    """A format by name; unknown names are refused."""
    if name not in (WHOLE, CHUNKED, AUTO):
        raise ValueError(f"unknown block format {name!r}; there are {WHOLE}, {CHUNKED} and {AUTO}")
    return name


def as_of(rows: DataFrame, at: int | None = None) -> DataFrame:
    """The rows that make up each block at revision ``at``, one a chunk."""
    seen = rows if at is None else rows.where(F.col("rev") <= at)
    # a row is void if the block was later stored in the other format, or (whole) once more
    last = seen.groupBy(*_KEYS).agg(F.max(F.struct("rev", "fmt")).alias("last"), F.max(F.when(F.col("fmt") == WHOLE, F.col("rev"))).alias("whole"))
    live = seen.join(last, _KEYS).where((F.col("fmt") == F.col("last.fmt")) & F.when(F.col("fmt") == WHOLE, F.col("rev") == F.col("last.rev")).otherwise(F.col("rev") > F.coalesce("whole", F.lit(-1))))
    own = live.groupBy(*_KEYS, "fmt", "off").agg(F.max(F.struct("rev", "data")).alias("x")).select(*_KEYS, F.col("x.rev").alias("rev"), "fmt", "off", F.col("x.data").alias("data"))
    return own.where("data is not null")


def read(rows: DataFrame, blksize: int, at: int | None = None) -> DataFrame:
    """(file_id, blk, rev, fmt, data): blocks as of ``at``, without trailing zeros; rev is the last change."""
    seen = rows if at is None else rows.where(F.col("rev") <= at)
    revs = seen.groupBy(*_KEYS).agg(F.max("rev").alias("rev"), F.max_by("fmt", "rev").alias("fmt"))
    parts = as_of(rows, at).groupBy(*_KEYS).agg(F.collect_list(F.struct("off", "data")).alias("parts"))  # a block's chunks
    every = revs.join(parts, _KEYS, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [stitch([(p["off"], p["data"]) for p in parts or []], blksize).rstrip(b"\0") for parts in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(data, pa.binary())], ["file_id", "blk", "rev", "fmt", "data"])

    return every.select(*_KEYS, "rev", "fmt", "parts").mapInArrow(run, "file_id long, blk long, rev long, fmt string, data binary")


def load(rows: DataFrame, blksize: int, asked: DataFrame, at: int | None = None) -> DataFrame:
    """(file_id, blk, data) of each block of ``asked`` (file_id, blk), filled up with zeros; a hole is all zeros."""
    got = read(rows.join(asked.select(*_KEYS).distinct(), _KEYS, "left_semi"), blksize, at).select(*_KEYS, "data")
    zeros = F.unhex(F.repeat(F.lit("00"), F.lit(blksize) - F.coalesce(F.octet_length("data"), F.lit(0))))
    return asked.join(got, _KEYS, "left").select(*_KEYS, F.concat(F.coalesce("data", F.lit(b"")), zeros).alias("data"))


def file_size(rows: DataFrame, blksize: int) -> DataFrame:
    """(file_id, size): up to the end of the last block."""
    return rows.groupBy("file_id").agg(((F.max("blk") + 1) * blksize).alias("size"))


def read_bytes(rows: DataFrame, blksize: int, file_id: int, lo: int, n: int, at: int | None = None) -> bytes:
    """Bytes [lo, lo + n) of a file, fewer where it ends; for ranges that fit the driver."""
    mine = rows.where(F.col("file_id") == file_id) if at is None else rows.where((F.col("file_id") == file_id) & (F.col("rev") <= at))
    size = (file_size(mine, blksize).first() or {"size": 0})["size"]
    hi = min(lo + n, size)
    if hi <= lo:
        return b""
    asked = rows.sparkSession.range(lo // blksize, (hi - 1) // blksize + 1).select(F.lit(file_id).cast("long").alias("file_id"), F.col("id").alias("blk"))
    got = load(mine, blksize, asked, at).orderBy("blk").collect()
    return b"".join(bytes(r["data"]) for r in got)[lo % blksize :][: hi - lo]


def formats(rows: DataFrame, blocks: DataFrame, blksize: int, fmt: str = AUTO) -> DataFrame:
    """(file_id, blk, fmt, was, data, old, old_blk): in which format each of ``blocks`` (file_id, blk,
    data) is to be stored, how it is stored now, and its bytes now."""
    codec(fmt)
    now = read(rows, blksize).select(*_KEYS, F.col("fmt").alias("was"), F.col("data").alias("old"))
    compared = deltas(blocks.select(*_KEYS, "data").join(now, _KEYS, "left"))
    if fmt != AUTO:
        return compared.withColumn("fmt", F.lit(fmt))
    last = rows.groupBy("file_id").agg(F.max("blk").alias("_stored"))
    # blocks are stored in ascending order: before a block, the last one is the greatest stored or written below it
    written = F.max("blk").over(_below())
    judged = compared.join(last, "file_id", "left").withColumn("_last", F.greatest(F.coalesce(F.when(F.col("_stored") < F.col("blk"), F.col("_stored")), F.when(F.col("_stored").isNotNull(), F.col("_stored")), F.lit(-1)), F.coalesce(written, F.lit(-1))))
    chosen = judged.withColumn("fmt", auto_format(F.col("blk"), F.col("_last"), F.col("old_len"), F.col("new_len"), F.col("starts"), F.col("delta"), blksize))
    # a new block at the end: the one before it, if it was changed too, is finished and stored whole
    following = F.lead(F.struct("blk", (F.col("old_len") == 0).alias("new"), "_last")).over(_order())
    closed = (following["blk"] == F.col("blk") + 1) & following["new"] & (following["_last"] == F.col("blk"))
    return chosen.withColumn("fmt", F.when(closed, F.lit(WHOLE)).otherwise(F.col("fmt"))).drop("_stored", "_last")


def _order():
    from pyspark.sql import Window

    return Window.partitionBy("file_id").orderBy("blk")


def _below():
    from pyspark.sql import Window

    return _order().rowsBetween(Window.unboundedPreceding, -1)


def store(rows: DataFrame, blocks: DataFrame, rev: int, blksize: int, fmt: str = AUTO) -> DataFrame:
    """The rows to add at ``rev`` so that ``blocks`` (file_id, blk, data) are stored. A block in chunks
    adds what differs, one that doesn't change adds nothing; a whole block is always added."""
    planned = formats(rows, blocks, blksize, fmt)
    whole = planned.where(F.col("fmt") == WHOLE).select(*_KEYS, F.lit(rev).cast("long").alias("rev"), "fmt", F.lit(0).alias("off"), F.col("new").alias("data"))
    chunked = planned.where(F.col("fmt") == CHUNKED)
    at = F.lit(rev).cast("long").alias("rev")
    new = to_chunks(chunked.select(*_KEYS, at, F.col("new").alias("data")))
    old = to_chunks(chunked.where(F.col("was") == CHUNKED).select(*_KEYS, at, F.col("old").alias("data")))
    keys = [*_KEYS, "off"]
    both = new.select(*keys, F.col("data").alias("now")).join(old.select(*keys, F.col("data").alias("then")), keys, "full_outer").where(~F.col("now").eqNullSafe(F.col("then")))
    return whole.unionByName(both.select(*_KEYS, at, F.lit(CHUNKED).alias("fmt"), "off", F.col("now").alias("data")))


@dataclass(frozen=True)
class BlockFiles:
    """Such rows with their block size and the format to store in."""

    rows: DataFrame
    blksize: int
    fmt: str = AUTO

    def __post_init__(self) -> None:
        codec(self.fmt)
        if self.blksize < 1 or self.blksize % CHUNK and self.blksize > CHUNK:
            raise ValueError(f"blocks of {self.blksize} bytes aren't made of chunks of {CHUNK}")

    def stored(self, blocks: DataFrame, rev: int) -> BlockFiles:
        return BlockFiles(self.rows.unionByName(store(self.rows, blocks, rev, self.blksize, self.fmt)), self.blksize, self.fmt)

    def blocks(self, at: int | None = None) -> DataFrame:
        return read(self.rows, self.blksize, at)
