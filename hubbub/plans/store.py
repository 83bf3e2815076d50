"""Tables in the shared folder: results that several steps read are computed once and cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where that is unset, in local mode, a temporary folder, which is then set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="hubbub-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there.

    A later loss of executors reads the files again instead of recomputing. What was shuffled
    for the table is removed once that is written, as nothing reads it again.
    """
    spark, schema = df.sparkSession, df.schema
    path = new_path(spark, name)
    if scopes := _scopes():
        scopes[-1].append(path)
    with _shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def bytes_read(df: DataFrame) -> int:
    """Bytes of the files that df reads, 0 where it reads none."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the block's writes go when each ends, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before else spark.conf.unset(_CLEANUP)


_local = threading.local()


def _scopes() -> list[list[str]]:
    """This thread's open scopes, innermost last; each holds the paths stored in it."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def removed(spark: SparkSession) -> Iterator[None]:
    """Tables that the block stores are removed at its end, also when it fails.

    For steps whose result is stored before the block ends: that goes through keep(), and
    nothing else that reads the block's tables may leave it.
    """
    scopes = _scopes()
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def keep(df: DataFrame, name: str) -> DataFrame:
    """stored() for the result of the innermost block of removed(): the table belongs to what is around it."""
    scopes = _scopes()
    own = scopes.pop() if scopes else None
    try:
        return stored(df, name)
    finally:
        if own is not None:
            scopes.append(own)
