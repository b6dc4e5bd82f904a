"""Tables in the shared folder: they cut lineage and plans, and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` as a URI.  Where it is unset, a local session (tests) gets a temp folder, and a cluster an
    error: each of its machines would write to a disk of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors and the driver share")
        base = getattr(spark.sparkContext, "_logsieve_dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="logsieve-")
            spark.sparkContext._logsieve_dir = base
    return base if "://" in base or base.startswith("file:") else "file://" + os.path.abspath(base)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder."""
    path = f"{shared_folder(spark).rstrip('/')}/logsieve/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: lineage ends there, and a lost
    executor costs nothing that was written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def also(path: str) -> None:
    """Another path that release() deletes."""
    _made.append(path)


def sweep(spark: SparkSession, older_than_hours: float = 48) -> int:
    """Delete what processes that ended without release() left in the shared folder; how many folders went."""
    import time

    root = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark).rstrip('/')}/logsieve")
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(root):
        return 0
    limit, gone = (time.time() - older_than_hours * 3600) * 1000, 0
    for status in store.listStatus(root):
        path = status.getPath()
        if status.getModificationTime() < limit and not any(m.endswith(path.getName()) for m in _made):
            store.delete(path, True)
            gone += 1
    return gone


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession) -> None:
    """Delete all scratch folders of this process; results that read them are no longer usable."""
    while _made:
        remove(spark, _made.pop())
