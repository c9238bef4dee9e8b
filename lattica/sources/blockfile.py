"""OS files of fixed-size blocks as a Spark data source: ``format("blockfile")`` with ``path`` and
``blksize``; rows (blk, data). A partition reads ``partbytes`` of blocks in a row (64 MiB, unless
given). Paths must be readable and, for writing, be writable on every executor: a shared mount.

Writing (mode append) puts each block in its place and leaves the others; shorter data is filled up
with zeros. A block written again by a retried task gets the same bytes."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


class Blocks(InputPartition):
    def __init__(self, lo: int, hi: int):
        self.lo, self.hi = lo, hi


class BlockReader(DataSourceReader):
    def __init__(self, path: str, blksize: int, partbytes: int):
        self.path, self.blksize, self.run = path, blksize, max(1, partbytes // blksize)

    def partitions(self) -> list[Blocks]:
        size = os.path.getsize(self.path)
        if size % self.blksize:
            raise ValueError(f"{self.path}: {size} bytes are no multiple of {self.blksize}")
        n = size // self.blksize
        return [Blocks(lo, min(n, lo + self.run)) for lo in range(0, n, self.run)]

    def read(self, partition: Blocks) -> Iterator[tuple[int, bytes]]:
        with open(self.path, "rb") as f:
            f.seek(partition.lo * self.blksize)
            for blk in range(partition.lo, partition.hi):
                data = f.read(self.blksize)
                if len(data) < self.blksize:
                    raise EOFError(f"{self.path}: block {blk} has {len(data)} of {self.blksize} bytes")
                yield blk, data


class BlockWriter(DataSourceWriter):
    def __init__(self, path: str, blksize: int):
        self.path, self.blksize = path, blksize

    def write(self, iterator) -> WriterCommitMessage:
        fd = os.open(self.path, os.O_WRONLY | os.O_CREAT)
        try:
            for row in iterator:
                if len(row["data"]) > self.blksize:
                    raise ValueError(f"block {row['blk']} has {len(row['data'])} bytes, more than {self.blksize}")
                os.pwrite(fd, bytes(row["data"]).ljust(self.blksize, b"\0"), row["blk"] * self.blksize)
            os.fsync(fd)
        finally:
            os.close(fd)
        return WriterCommitMessage()


class BlockFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blockfile"

    def schema(self) -> str:
        return "blk long, data binary"

    def reader(self, schema) -> BlockReader:
        return BlockReader(self.options["path"], int(self.options["blksize"]), int(self.options.get("partbytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> BlockWriter:
        if overwrite:
            raise ValueError("blocks are written in place: use mode append")
        return BlockWriter(self.options["path"], int(self.options["blksize"]))
