"""Streaming: incremental ingest, weekly windows, snapshot upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.catalog.base import query, table
from rillwork.session import scratch_path
from rillwork.streaming import ingest, store


def _arriving(spark, d):
    """Events as files of a landing folder."""
    path = scratch_path(spark, "landing")
    e = table(spark, d, "events")
    e.write.parquet(path)
    return path, e.schema


@query("x1_incremental_ingest", "SELECT event_id, user_id, event_type, value FROM events")
def x1(spark, d):
    path, schema = _arriving(spark, d)
    out, mark = scratch_path(spark, "ingested"), scratch_path(spark, "mark")
    for _ in range(2):  # the second run finds nothing new
        ingest.ingest_available(ingest.file_stream(spark, path, schema), out, mark).awaitTermination()
    return spark.read.schema(schema).parquet(out).select("event_id", "user_id", "event_type", "value")


_WEEK = "SELECT time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2"


@query("x2_weekly_windows", _WEEK)
def x2(spark, d):
    w = ingest.weekly_measures(table(spark, d, "events"), "ts", "value", ["event_type"])
    return w.select("week_start", "event_type", "n", F.round("total", 2).alias("total"))


@query("x2b_weekly_stream", _WEEK)
def x2b(spark, d):
    path, schema = _arriving(spark, d)
    out, mark = scratch_path(spark, "weekly"), scratch_path(spark, "mark")
    w = ingest.weekly_measures(ingest.file_stream(spark, path, schema), "ts", "value", ["event_type"], late="1 day")
    ingest.upsert_measures(w, out, mark, ["week_start", "event_type"], buckets=8).awaitTermination()
    got = store.read(spark, out, w.schema)
    return got.select(F.col("week_start").cast("timestamp_ntz").alias("week_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("x3_snapshot_upkeep", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS rn FROM events) WHERE rn = 1")
def x3(spark, d):
    path, schema = _arriving(spark, d)
    root, mark = scratch_path(spark, "snapshot"), scratch_path(spark, "mark")
    ingest.keep_snapshot(ingest.file_stream(spark, path, schema, files_per_batch=4), root, mark, "user_id", "ts", buckets=16).awaitTermination()
    return store.read(spark, root, schema).select("user_id", "event_id", "event_type")
