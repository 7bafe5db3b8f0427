"""Intermediate tables that outlive executors.

A staged table is Parquet in the shared folder named by
``spark.checkpoint.dir``. It cuts lineage, is read back column by column, and
freezes values that depend on how the data was split (the partition id of a
range sort), which a lost and recomputed cache block would not.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"
#: Frames this package has cached, per open run; the first list belongs to no run.
_kept: list[list[DataFrame]] = [[]]
_folders: list[str] = []


def staging_root(spark: SparkSession) -> str:
    """The folder of this application's staged tables."""
    root = spark.conf.get(_CONF, None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError(f"set {_CONF} to a folder that every executor can reach")
        root = tempfile.mkdtemp(prefix="facsimile-")
        spark.conf.set(_CONF, root)
    return f"{root.rstrip('/')}/facsimile-{spark.conf.get('spark.app.id', 'app')}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write the frame once and return a frame that reads it back."""
    spark = df.sparkSession
    path = f"{_folders[-1] if _folders else staging_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, *done: DataFrame) -> None:
    """Delete staged tables that nothing reads any more, and shuffle files that only finished writes refer to.

    Spark removes those when the driver's collector finds them unused, which may be long after the disk is full.
    """
    for df in done:
        for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
            root = spark._jvm.org.apache.hadoop.fs.Path(folder)
            root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
    spark._jvm.System.gc()


def keep(df: DataFrame) -> DataFrame:
    """Cache a small frame until its run ends, or until ``release``."""
    _kept[-1].append(df.persist())
    return df


def _drop(spark: SparkSession, folder: str, frames: list[DataFrame]) -> None:
    for df in frames:
        df.unpersist()
    frames.clear()
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)


@contextmanager
def run(spark: SparkSession) -> Iterator[None]:
    """What is staged and cached inside goes at the end, and nothing else; read results before."""
    folder, frames = f"{staging_root(spark)}/run-{uuid.uuid4().hex}", []
    _folders.append(folder)
    _kept.append(frames)
    try:
        yield
    finally:
        _folders.remove(folder)
        del _kept[next(i for i, x in enumerate(_kept) if x is frames)]
        _drop(spark, folder, frames)


def release(spark: SparkSession) -> None:
    """Drop all this package has staged and cached in the application, but no frame that the caller has cached.

    Results not yet read are lost.
    """
    _drop(spark, staging_root(spark), [df for frames in _kept for df in frames])
    for frames in _kept:
        frames.clear()
