"""A keyed table that a stream keeps up to date, bucket by bucket.

Keys are dealt to buckets by a hash. A batch reads and rewrites only the buckets it touches, into folders of its own; last of
all it writes a pointer, the list of the folder that counts for each bucket. Readers follow the newest pointer, so they see a
batch whole or not at all. A pointer carries the query and batch that made it: a batch that is replayed after a failure finds
its own pointer and does nothing. Folders that neither of the last two pointers names are removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

_POINTER = "bucket int, folder string, query string, batch long"


def pointer(spark: SparkSession, root: str) -> tuple[int, list]:
    """(number, rows) of the newest pointer; (-1, []) where there is none. A pointer has one row per bucket."""
    try:
        rows = spark.read.schema(_POINTER + ", version long").parquet(f"{root}/pointer")
    except AnalysisException:
        return -1, []
    newest = rows.agg(F.max("version")).first()[0]
    return (-1, []) if newest is None else (newest, rows.where(F.col("version") == newest).collect())


def largest(key: Sequence[str], order: str) -> Callable[[DataFrame], DataFrame]:
    """Merge that keeps of each key the row with the largest ``order``; of equal ones that with the largest hash of its columns."""
    def merge(both: DataFrame) -> DataFrame:
        rest = [c for c in both.columns if c not in key]
        pick = F.max_by(F.struct(*rest), F.struct(F.col(order), F.xxhash64(*rest)))
        return both.groupBy(*key).agg(pick.alias("b")).select(*key, "b.*")
    return merge


def apply(batch: DataFrame, root: str, key: Sequence[str], merge: Callable[[DataFrame], DataFrame], schema: T.StructType, buckets: int, query: str, number: int) -> None:
    """Merges one batch into the store."""
    spark = batch.sparkSession
    version, rows = pointer(spark, root)
    if rows and (rows[0]["query"], rows[0]["batch"]) == (query, number):
        return
    now = {r["bucket"]: r["folder"] for r in rows}
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    fresh = merge(batch).select(*[f.name for f in schema.fields]).withColumn("bucket", bucket).persist()
    try:
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most ``buckets``
        old = [now[b] for b in touched if b in now]
        both = fresh.drop("bucket")
        if old:
            both = spark.read.schema(schema).parquet(*old).unionByName(both)
        folder = f"{root}/rows/{uuid.uuid4().hex}"
        if touched:
            merged = merge(both).withColumn("bucket", bucket)
            merged.repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(folder)
    finally:
        fresh.unpersist()
    now.update({b: f"{folder}/bucket={b}" for b in touched})
    listed = [(b, f, query, number) for b, f in sorted(now.items())] or [(-1, "", query, number)]
    spark.createDataFrame(listed, _POINTER).coalesce(1).write.mode("overwrite").parquet(f"{root}/pointer/version={version + 1}")
    _remove_unnamed(spark, root, {f for _, f, _, _ in listed} | {r["folder"] for r in rows}, version)


def _remove_unnamed(spark: SparkSession, root: str, named: set[str], version: int) -> None:
    """Removes bucket folders that neither of the last two pointers names, and older pointers."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    system = path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    keep = {f.rsplit("/rows/", 1)[-1] for f in named if f}
    for load in system.listStatus(path(f"{root}/rows")) if system.exists(path(f"{root}/rows")) else []:
        name, left = load.getPath().getName(), 0
        for part in system.listStatus(load.getPath()):
            if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in keep:
                system.delete(part.getPath(), True)
            elif part.isDirectory():
                left += 1
        if not left:
            system.delete(load.getPath(), True)
    for old in system.listStatus(path(f"{root}/pointer")):
        if old.getPath().getName().startswith("version=") and int(old.getPath().getName()[8:]) < version:
            system.delete(old.getPath(), True)


def keep(stream: DataFrame, root: str, checkpoint: str, key: Sequence[str], merge: Callable[[DataFrame], DataFrame], buckets: int = 64, mode: str = "append") -> StreamingQuery:
    """Keeps the store below ``root`` up to date with a stream; loads what has arrived, then stops."""
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or checkpoint
        apply(batch, root, key, merge, schema, buckets, query, number)

    return stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The rows of the newest pointer's folders, at most one for each bucket."""
    folders = [r["folder"] for r in pointer(spark, root)[1] if r["folder"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
