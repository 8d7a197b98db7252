"""Shared scratch folder and staged tables (lineage cuts that survive executor loss)."""

from __future__ import annotations

import gc
import tempfile
import threading
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_WRITTEN = threading.local()


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="rillwork-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_dir(spark)}/rillwork/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Used before iterative fits and wherever one frame feeds several jobs: the result is columnar (later scans
    prune and push down) and does not depend on any executor staying alive.
    """
    spark = df.sparkSession
    if path is None:
        path = scratch_path(spark, label)
        if getattr(_WRITTEN, "paths", None) is not None:
            _WRITTEN.paths.append(path)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession) -> None:
    """Has Spark delete the shuffles no frame refers to any more. It does so after a collection in the driver, which may be long in coming; until then they stand beside those of the next step.

    What Python lets go reaches the driver a moment later, so the shuffles of the step just before may go at the next call only.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes what this thread stages within the block without a path of its own; results that are still read must have one."""
    outer, _WRITTEN.paths = getattr(_WRITTEN, "paths", None), []
    try:
        yield
    finally:
        paths, _WRITTEN.paths = _WRITTEN.paths, outer
        for name in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(name)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage_all(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Stage independent frames at the same time, so that their jobs share the cluster."""
    spark = next(iter(frames.values())).sparkSession
    one = inheritable_thread_target(spark)(lambda item: (item[0], stage(item[1], item[0])))
    with ThreadPoolExecutor(len(frames)) as pool:
        return dict(pool.map(one, frames.items()))
