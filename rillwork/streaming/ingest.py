"""Incremental ingest: work lists, pending targets, completeness, file streams, windows and snapshot upkeep."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from rillwork.sources import files
from rillwork.streaming import store

# -- work lists -------------------------------------------------------------------------------------------------


def weekly_windows(df: DataFrame, start: str, end: str) -> DataFrame:
    """Explode each row into consecutive seven-day windows between two dates (the last one may be short)."""
    days = F.explode(F.sequence(F.col(start), F.col(end), F.expr("interval 7 days"))).alias("week_start")
    out = df.select("*", days)
    return out.withColumn("week_end", F.least(F.col(end), F.date_add("week_start", 6)))


def year_targets(keys: DataFrame, first: int, last: int) -> DataFrame:
    """Every key with every year."""
    return keys.select("*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("year"))


def pending(targets: DataFrame, existing: DataFrame, on: Sequence[str]) -> DataFrame:
    """Targets that are not loaded yet."""
    return targets.join(existing.select(*on).distinct(), list(on), "left_anti")


def completeness(targets: DataFrame, existing: DataFrame, source: str, on: Sequence[str]) -> DataFrame:
    """Done, total and percent per source, with a grand total row (source is null there)."""
    done = existing.select(*on).distinct().withColumn("_done", F.lit(1))
    joined = targets.join(done, list(on), "left")
    agg = joined.rollup(source).agg(F.count(F.lit(1)).alias("total"), F.count("_done").alias("done"))
    return agg.withColumn("pct", F.round(F.col("done") / F.col("total") * 100, 1))


def load_listed(spark: SparkSession, root: str, out: str, schema: T.StructType | str, pattern: str = "*.parquet", per_load: int = 1000, most_loads: int | None = None) -> int:
    """Loads the objects below ``root`` that no earlier load has committed; returns how many loads it made.

    What is there is a listing of names, sizes and times; what is done is the table of committed loads. A load writes its rows,
    then its list of objects, which is what makes it count: after an interruption the next run goes on with the rest, and rows
    without a committed list are never read. An object whose size or time has changed is loaded anew.
    """
    loads = 0
    while most_loads is None or loads < most_loads:
        there, done = files.listing(spark, root, pattern), committed(spark, out)
        todo = there.join(done, ["path", "length", "modified"], "left_anti").select(*there.columns).orderBy("path").limit(per_load).collect()  # one load's objects
        if not todo:
            break
        name = uuid.uuid4().hex
        spark.read.schema(schema).parquet(*[r["path"] for r in todo]).withColumn("object", F.col("_metadata.file_path")).write.parquet(f"{out}/rows/load={name}")
        spark.createDataFrame(todo, there.schema).withColumn("load", F.lit(name)).coalesce(1).write.mode("append").parquet(f"{out}/done")
        loads += 1
    return loads


def committed(spark: SparkSession, out: str) -> DataFrame:
    """(path, object, length, modified, load) of every committed object; of one that was loaded again only the newest counts."""
    schema = "path string, object string, length long, modified timestamp, load string"
    try:
        rows = spark.read.schema(schema).parquet(f"{out}/done")
    except AnalysisException:
        return spark.createDataFrame([], schema)
    return rows.groupBy("path").agg(F.max_by(F.struct("object", "length", "modified", "load"), "modified").alias("o")).select("path", "o.*")


def read_loaded(spark: SparkSession, out: str, schema: T.StructType | str) -> DataFrame:
    """The rows of the newest committed load of every object."""
    rows = spark.read.schema(spark.createDataFrame([], schema).schema.add("object", "string").add("load", "string")).parquet(f"{out}/rows")
    return rows.join(committed(spark, out).select("load", "object"), ["load", "object"], "left_semi").drop("load", "object")


# -- streams ------------------------------------------------------------------------------------------------------


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                files_per_batch: int = 1000) -> DataFrame:
    """Arriving files as a stream; the checkpoint remembers which were read."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def ingest_available(stream: DataFrame, out: str, checkpoint: str,
                     transform: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Load everything that has arrived since the last run, each file once, then stop."""
    return (transform(stream).writeStream.format("parquet").option("path", out)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def weekly_measures(df: DataFrame, ts: str, value: str, keys: Sequence[str] = (), late: str = "7 days") -> DataFrame:
    """Tumbling seven-day count, sum and mean; on a stream the watermark closes a window."""
    if df.isStreaming:
        df = df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    agg = df.groupBy(F.window(ts, "7 days").alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return agg.select(F.col("w.start").alias("week_start"), *keys, "n", "total", "mean")


def upsert_measures(measures: DataFrame, out: str, checkpoint: str, keys: Sequence[str], buckets: int = 64) -> StreamingQuery:
    """Load streamed measures in update mode: every batch writes the groups it changed, open windows included.

    A group's newest row is the one with the most rows counted, as counts only grow; ``store.read`` returns the groups.
    """
    return store.keep(measures, out, checkpoint, keys, store.largest(keys, "n"), buckets, mode="update")


def merge_snapshot(current: DataFrame, batch: DataFrame, key: str, date: str) -> DataFrame:
    """Newest row per key over the stored snapshot and a batch; both sides are first reduced to one row per key."""
    cols = [c for c in current.columns if c != key]
    both = current.unionByName(batch.select(current.columns))
    pick = F.max_by(F.struct(*cols), F.struct(F.col(date), F.xxhash64(*cols)))
    return both.groupBy(key).agg(pick.alias("b")).select(key, "b.*")


def keep_snapshot(stream: DataFrame, root: str, checkpoint: str, key: str, date: str, buckets: int = 64) -> StreamingQuery:
    """Maintain the latest row per key; a batch rewrites only the buckets its keys belong to. ``store.read`` returns the rows."""
    return store.keep(stream, root, checkpoint, [key], store.largest([key], date), buckets)


def latest_rows(stream: DataFrame, key: str, date: str) -> DataFrame:
    """The second form: a stream that emits a key's row whenever a later one arrives. The state is one date per key."""
    schema = stream.schema
    names = [f.name for f in schema.fields]

    def update(_, batches, state):
        best = None
        for pdf in batches:
            row = pdf.sort_values(date, kind="stable").tail(1)
            if best is None or row[date].iloc[0] >= best[date].iloc[0]:
                best = row
        if best is not None and (not state.exists or best[date].iloc[0] > state.get[0]):
            state.update((best[date].iloc[0],))
            yield best[names]

    kind = T.StructType([T.StructField(date, schema[date].dataType)])
    return stream.groupBy(key).applyInPandasWithState(update, schema, kind, "update", GroupStateTimeout.NoTimeout)
