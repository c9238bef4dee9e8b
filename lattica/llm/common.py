"""Plumbing shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that is sent to every executor instead of being shuffled.
BROADCAST_ROWS = 1_000_000

_staged: dict[str, object] = {}


_kept: dict[object, object] = {}


def kept(key: object, make: Callable[[], object]):
    """A model that a Python worker keeps from task to task. Only the newest stays: workers are used
    again by other operators, and the models of all of them would add up."""
    if key not in _kept:
        drop_kept()
        _kept[key] = make()
    return _kept[key]


def lean(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for work that keeps no model; its workers first drop what others left there,
    and hand back at the end of a task what it has freed."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        yield from run(batches)
        release()

    return df.mapInArrow(own, schema)


def drop_kept() -> None:
    if _kept:
        _kept.clear()
        release()


def release() -> None:
    """Return freed memory to the system: allocators keep it for a worker's next task otherwise."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a folder of our own, in local mode
    only: on a cluster executors don't share one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.gettempdir()}/lattica-{uuid.uuid4().hex}"
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_staged() -> None:
    for path, spark in list(_staged.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session has ended; its folder goes with the cluster's clean-up
            return


atexit.register(_drop_staged)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later steps neither repeat its work
    nor depend on the executors that did it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lattica-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged[path] = spark
    out = spark.read.parquet(path)
    out._staged_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables whose readers are all done."""
    for df in frames:
        path = getattr(df, "_staged_path", None)
        if path in _staged:
            _delete(_staged.pop(path), path)


def sweep(spark: SparkSession) -> None:
    """Have executors drop the broadcast tables of steps that are done. Spark's cleaner does so once
    the driver's collector has met them, which may be after many more steps: until then they fill
    the executors' heaps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def fresh(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``limit`` rows; else leave the join to shuffle.
    Only for frames of a few fixed-width columns that are cheap to count (staged ones)."""
    n = df.limit(limit + 1).agg(F.count(F.lit(1))).first()[0] if limit < 100_000 else df.count()
    return F.broadcast(df) if n <= limit else df


def crc_of_id(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode()) if doc_id is not None else 0


def crc_of_id_col(name: str = "doc_id") -> F.Column:
    """crc32 of the id as text; null ids count as crc 0, so they are held out of training."""
    return F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(0))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: F.Column, per_class: int, max_chars: int):
    """A bounded sample to fit a classifier on: at most ``per_class`` documents of either label,
    lowest hash of the id first, each cut to ``max_chars``. Null ids, labels other than 0 and 1, and
    documents without a label are not learnt from. Returns (rows, share of label 1 over
    all labels that may be learnt from)."""
    usable = labels.where(train & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("_label")).distinct()
    counts = {r["_label"]: r["count"] for r in usable.groupBy("_label").count().collect()}
    picked = None
    for value in (0, 1):
        part = usable.where(F.col("_label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * per_class rows of two integers; of texts that share an id one is learnt from
    text = docs.select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, max_chars).alias("_text"))
    rows = text.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_label").agg(F.min("_text").alias("_text")).collect()
    total = sum(counts.values())
    rows = sorted(((r["doc_id"], r["_text"], r["_label"]) for r in rows), key=lambda r: (zlib.crc32(b"order" + str(r[0]).encode()), r[0], r[1]))
    return rows, (counts.get(1, 0) / total if total else 0.5)
