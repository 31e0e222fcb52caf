"""Intermediate tables that outlive executors: written to the shared checkpoint folder and read again."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables that materialize has written and release has not deleted, by application.
_MADE: dict[str, list[str]] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a local session without one gets a temporary folder; a cluster must name one,
    since the machines' own folders are not shared."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillspark-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table; used where a derived table feeds several joins. It stays until drop() or release()."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a write goes with it; else it stays until the driver happens to collect its garbage."""
    conf, key = spark.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables that materialize has written and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        made = _MADE.get(spark.sparkContext.applicationId, [])
        inside = {f.rpartition("/")[0].rpartition("/")[2] for f in df.inputFiles()}
        for path in [x for x in made if x.rpartition("/")[2] in inside]:
            made.remove(path)
            _delete(spark, path)


def release(spark: SparkSession) -> int:
    """Deletes the tables that materialize has written for this application, and returns how many. Results that are still to be read need
    them: call it when a query's result has been written or collected. What is published or kept for a session stays."""
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)
