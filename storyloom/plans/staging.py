"""Staged tables: lineage cuts as Parquet in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_staged: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only in local sessions without any."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = f"file://{tempfile.mkdtemp(prefix='storyloom-')}"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def stage_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/storyloom/{name}-{uuid.uuid4().hex}"
    if not _staged:
        atexit.register(drop_staged)
    _staged.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, computes once."""
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch():
    """Staged tables of this block are removed at its end; what is needed after it must be written inside it."""
    kept = len(_staged)
    try:
        yield
    finally:
        drop_staged(kept)


def drop_staged(kept: int = 0) -> None:
    """Remove the staged tables of this process but the first ``kept`` (also runs when it exits)."""
    while len(_staged) > kept:
        spark, path = _staged.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session is gone: the cluster's own cleaning takes over
            pass


def broadcast_if_small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` (narrow) rows, else as it is."""
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= rows else df
