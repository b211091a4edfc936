"""What the operators share: reading tables, shared storage for cut lineage, Arrow helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that a Python worker gets at once, about; rows are never cut.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession) -> None:
    """Batches for Python are bounded in bytes and not in rows alone, unless the session says how."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the driver's. Python workers are told where this package is, should they start elsewhere."""
    bounded(spark)
    home = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, known]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Where that is unset a temporary folder takes its place, but only if driver and executors are one process."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not at and not held.isDefined() and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not at:
        at = held.get() if held.isDefined() else "file://" + tempfile.mkdtemp(prefix="docloom-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: computed once, read by any executor, no lineage behind it.

    The tables of a session lie under one folder named by the application's id; drop_stored() removes it."""
    spark = df.sparkSession
    bounded(spark)
    at = f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(at)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Tables that stored() has written in this process, in order.
_WRITTEN: list[str] = []


def written() -> int:
    return len(_WRITTEN)


def drop_written(spark: SparkSession, first: int, last: int) -> None:
    """Removes the tables that stored() wrote from number first to before last; nothing that is still to be computed may need them."""
    for at in _WRITTEN[first:last]:
        _delete(spark, at)
    del _WRITTEN[first:last]


def drop_stored(spark: SparkSession) -> None:
    _delete(spark, f"{shared_dir(spark)}/tables-{spark.sparkContext.applicationId}")
    _WRITTEN.clear()


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array without copying, and its n + 1 offsets; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if col.null_count:  # a null may own bytes in theory: rebuild then
        null = np.asarray(col.is_null())
        if (np.diff(offs)[null] > 0).any():
            return bytes_of(col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else ""))
    return buf, offs


def slices(offs: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of about most bytes each; a longer text gets a range of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def cols(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns: extra ones, whatever their names, never reach an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])
