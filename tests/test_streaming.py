import os

from pyspark.sql import functions as F

from conftest import SF, rows
from rillwork.streaming import ingest, store


def test_ingest_reads_each_file_once(spark, folder):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.where("event_id < 400").write.parquet(folder + "/in/a")
    e.where("event_id >= 400").write.parquet(folder + "/later")

    def run():
        s = ingest.file_stream(spark, folder + "/in/*", e.schema)
        ingest.ingest_available(s, folder + "/out", folder + "/mark").awaitTermination()
        return spark.read.schema(e.schema).parquet(folder + "/out").count()
    assert run() == 400 and run() == 400
    spark.read.parquet(folder + "/later").write.parquet(folder + "/in/b")
    assert run() == e.count()


def test_weekly_stream_equals_batch(spark, folder):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.write.parquet(folder + "/in")
    w = ingest.weekly_measures(ingest.file_stream(spark, folder + "/in", e.schema), "ts", "value", late="1 hour")
    ingest.ingest_available(w, folder + "/out", folder + "/mark").awaitTermination()
    got = spark.read.schema(w.schema).parquet(folder + "/out").select(F.col("week_start").cast("timestamp_ntz"), "n")
    batch = ingest.weekly_measures(e, "ts", "value").select("week_start", "n")
    last = batch.agg(F.max("week_start")).first()[0]
    assert rows(got) == rows(batch.where(F.col("week_start") < F.lit(last)))  # the open week is still held back


def test_snapshot_survives_replay(spark, folder):
    schema = "k string, d int, v string"
    a = spark.createDataFrame([("x", 1, "a"), ("y", 5, "b")], schema)
    b = spark.createDataFrame([("x", 2, "c"), ("y", 4, "d"), ("z", 1, "e")], schema)
    merged = ingest.merge_snapshot(a, b, "k", "d")
    assert rows(merged) == [("x", 2, "c"), ("y", 5, "b"), ("z", 1, "e")]
    assert rows(ingest.merge_snapshot(merged, b, "k", "d")) == rows(merged)
    a.coalesce(1).write.parquet(folder + "/in/1")
    b.coalesce(1).write.parquet(folder + "/in/2")
    s = ingest.file_stream(spark, folder + "/in/*", a.schema, files_per_batch=1)
    ingest.keep_snapshot(s, folder + "/snap", folder + "/mark", "k", "d").awaitTermination()
    assert rows(store.read(spark, folder + "/snap", a.schema)) == rows(merged)
    c = spark.createDataFrame([("x", 3, "late")], schema)
    c.coalesce(1).write.parquet(folder + "/in/3")
    # a fresh checkpoint reads every file again and starts its batches at 0, over the store that is there
    again = ingest.file_stream(spark, folder + "/in/*", a.schema, files_per_batch=1)
    ingest.keep_snapshot(again, folder + "/snap", folder + "/mark2", "k", "d").awaitTermination()
    assert rows(store.read(spark, folder + "/snap", a.schema)) == [("x", 3, "late"), ("y", 5, "b"), ("z", 1, "e")]


def test_store_writes_what_a_batch_touches(spark, folder):
    schema, root, merge = "k long, d int, v string", folder + "/store", store.largest(["k"], "d")
    kind = spark.createDataFrame([], schema).schema
    first = spark.range(400).selectExpr("id AS k", "1 AS d", "'first' AS v")
    store.apply(first, root, ["k"], merge, kind, 16, "q", 0)
    before = {r["bucket"]: r["folder"] for r in store.pointer(spark, root)[1]}
    few = spark.createDataFrame([(7, 2, "new"), (7, 0, "old")], schema)
    store.apply(few, root, ["k"], merge, kind, 16, "q", 1)
    version, pointed = store.pointer(spark, root)
    after = {r["bucket"]: r["folder"] for r in pointed}
    assert len(before) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert store.read(spark, root, kind).where("v = 'new'").count() == 1 and store.read(spark, root, kind).count() == 400
    store.apply(few.withColumn("d", F.lit(9)), root, ["k"], merge, kind, 16, "q", 1)  # replayed: nothing happens
    assert store.pointer(spark, root)[0] == version
    # rows written by a batch that ended before its pointer are never read, and go with the next batch
    spark.createDataFrame([(7, 99, "lost")], schema).write.parquet(f"{root}/rows/lost/bucket=3")
    assert store.read(spark, root, kind).where("v = 'lost'").count() == 0
    for n in range(2, 5):
        store.apply(spark.createDataFrame([(7, n + 1, f"v{n}")], schema), root, ["k"], merge, kind, 16, "q", n)
    assert store.read(spark, root, kind).where("k = 7").first()["v"] == "v4" and store.read(spark, root, kind).count() == 400
    folders = [os.path.join(a, b) for a in os.listdir(f"{root}/rows") for b in os.listdir(f"{root}/rows/{a}") if b.startswith("bucket=")]
    assert "lost" not in os.listdir(f"{root}/rows") and len(folders) <= 17
    store.apply(few.limit(0), root, ["k"], merge, kind, 16, "q", 5)
    assert store.read(spark, root, kind).count() == 400


def test_latest_rows_by_state(spark, folder):
    schema = "k string, d int, v string"
    for n, part in enumerate([[("x", 1, "a"), ("y", 5, "b"), ("x", 0, "no")], [("x", 2, "c"), ("y", 4, "no")], [("z", 1, "e"), ("x", 2, "no")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{folder}/in/{n}")
    s = ingest.file_stream(spark, folder + "/in/*", spark.createDataFrame([], schema).schema, files_per_batch=1)
    out = ingest.latest_rows(s, "k", "d")
    store.keep(out, folder + "/store", folder + "/mark", ["k"], store.largest(["k"], "d"), mode="update").awaitTermination()
    assert rows(store.read(spark, folder + "/store", out.schema)) == [("x", 2, "c"), ("y", 5, "b"), ("z", 1, "e")]


def test_work_lists(spark):
    b = spark.createDataFrame([("a", "2024-01-01", "2024-01-17")], "k string, s string, e string").select("k", F.to_date("s").alias("s"), F.to_date("e").alias("e"))
    got = ingest.weekly_windows(b, "s", "e").select(F.col("week_start").cast("string"), F.col("week_end").cast("string"))
    assert rows(got) == [("2024-01-01", "2024-01-07"), ("2024-01-08", "2024-01-14"), ("2024-01-15", "2024-01-17")]
    t = ingest.year_targets(spark.createDataFrame([("s1", 1), ("s2", 2)], "source string, k int"), 2020, 2021)
    done = spark.createDataFrame([("s1", 1, 2020)], "source string, k int, year int")
    assert ingest.pending(t, done, ["source", "k", "year"]).count() == 3
    assert rows(ingest.completeness(t, done, "source", ["source", "k", "year"])) == [("s1", 2, 1, 50.0), ("s2", 2, 0, 0.0), (None, 4, 1, 25.0)]
