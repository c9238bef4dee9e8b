"""Block sources of one's own: a class says how to load and store a block, Spark deals out the blocks."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BlockSource(ABC):
    """Instances are sent to the workers, so they must be picklable."""

    blksize: int

    @abstractmethod
    def load(self, blk: int) -> bytes:
        """The bytes of a block, ``blksize`` at most."""

    def store(self, blk: int, data: bytes) -> None:
        """Stores a block. It may be called again for the same block, if a task is repeated."""
        raise NotImplementedError("this source can only be read")


def loaded(source: BlockSource, asked: DataFrame) -> DataFrame:
    """(blk, data) of ``asked`` (blk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                data = [source.load(blk) for blk in part.column(0).to_pylist()]
                for x in data:
                    if len(x) > source.blksize:
                        raise ValueError(f"a block of {len(x)} bytes, more than {source.blksize}")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(data, pa.binary())], ["blk", "data"])

    return asked.select(F.col("blk").cast("long").alias("blk")).mapInArrow(run, "blk long, data binary")


def scan(spark: SparkSession, source: BlockSource, blocks: int) -> DataFrame:
    """(blk, data) of the first ``blocks`` blocks."""
    return loaded(source, spark.range(blocks).withColumnRenamed("id", "blk"))


def save(source: BlockSource, blocks: DataFrame) -> int:
    """Stores (blk, data); returns how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source.store(blk, data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return blocks.select(F.col("blk").cast("long").alias("blk"), "data").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
