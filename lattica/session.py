"""Session helpers."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that go to a Python worker at once: rows may be long texts, so their number is no bound.
BATCH_BYTES = 4 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, once for each application, and keep the
    batches that they get small."""
    sc = spark.sparkContext
    if spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        target = Path(tempfile.mkdtemp(prefix="lattica-")) / "lattica_package.zip"
        target.write_bytes(buffer.getvalue())
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return spark


def scratch(spark: SparkSession) -> str:
    """A folder for written tables: that of ``spark.checkpoint.dir``, which all executors share; in
    local mode, where that is unset, a temporary one."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lattica-')}")
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """Computed once and read from the checkpoint folder from then on: what is used several times, or
    goes round in a loop, isn't computed again and survives lost executors."""
    scratch(df.sparkSession)
    return df.checkpoint()
