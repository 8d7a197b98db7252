"""Large JSON documents are cut into the same elements whatever the byte ranges are."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rillwork.sources import documents, geo, records


def put(folder, name, text, encoding="utf-8"):
    with open(os.path.join(folder, name), "w", encoding=encoding) as f:
        f.write(text)
    return os.path.join(folder, name)


@pytest.fixture(params=[150, 1 << 27])
def ranges(spark, request):
    """Files are read in ranges of so many bytes."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def nasty(seed, n=60):
    rng = random.Random(seed)
    strings = ['a"}b', "[{", "\\", '\\"', "}}]", "é日", "x" * 90, "", "\\\\", '{"k":[1,2]}', "},{"]
    return [{"commodity_desc": rng.choice(strings), "Value": rng.choice(strings) + str(i), "year": str(i), "more": {"deep": [{"a": rng.choice(strings)}, [], {}]}} for i in range(n)]


def test_array(spark, folder, ranges):
    docs = nasty(1)
    put(folder, "a.json", json.dumps(docs))
    put(folder, "b.json", "﻿ \n" + json.dumps(docs[:7], ensure_ascii=False, indent=1))
    put(folder, "c.json", "[]")
    put(folder, "d.json", "")
    put(folder, "e.json", json.dumps({"not": [{"an": "array"}]}))
    put(folder, "f.json", '[1, "two", null, {"year": "scalar"}]')
    put(folder, "g.json", '[{"year": "whole"}, {"year": "cu')
    put(folder, "h.json", '[{"year": "whole"}, {"year": 5')
    got = records.json_records(spark, folder).select("commodity_desc", "Value", "year")
    want = [(r["commodity_desc"], r["Value"], r["year"]) for r in docs + docs[:7]] + [(None, None, "scalar"), (None, None, "whole"), (None, None, "whole")]
    assert rows(got) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_order_and_spread(spark, folder):
    docs = nasty(2, 400)
    path = put(folder, "a.json", json.dumps(docs))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    try:
        found = documents.elements(spark, path)
        assert [json.loads(r.text) for r in found.orderBy("path", "start", "k").collect()] == docs
        assert documents._fragments(spark, path, "}").rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_ranges_and_states_meet_in_a_shuffle_beyond_the_bound(spark, folder, monkeypatch):
    docs = nasty(3)
    path = put(folder, "a.json", json.dumps(docs))
    monkeypatch.setattr(documents, "BROADCAST_RANGES", 0)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    try:
        assert [json.loads(r.text) for r in documents.elements(spark, path).orderBy("path", "start", "k").collect()] == docs
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_keyed_object(spark, folder, ranges):
    doc = {f"k{i}" + ('"' if i % 7 == 0 else "}"): {"elevation_ft": i + 0.5, "note": "},{\"" * (i % 3)} for i in range(40)}
    got = records.keyed_object(spark, put(folder, "k.json", json.dumps(doc)), "struct<elevation_ft: double>", "fips").select("fips", "value.elevation_ft")
    assert rows(got) == sorted((k, v["elevation_ft"]) for k, v in doc.items())
    years = records.nested_years(spark, put(folder, "y.json", json.dumps({"CA": {"2013": 1.5, "2018": 2.0}, "TX": {}})))
    assert rows(years) == [("CA", 2013, 1.5), ("CA", 2018, 2.0)]


def test_matrix(spark, folder, ranges):
    body = [[f"n{i}]", str(i)] for i in range(50)]
    put(folder, "a.json", json.dumps([["name", "v"], *body]))
    put(folder, "b.json", json.dumps([["v", "other", "name"], ["7", "x", "seven"], ["8"]]))
    want = [(a, b, None) for a, b in body] + [("seven", "7", None), (None, "8", None)]
    assert rows(records.header_matrix_rows(spark, folder, ["name", "v", "gone"])) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_series(spark, folder, ranges):
    series = [{"sourceInfo": {"siteName": f"w{i}"}, "values": [{"value": [{"value": str(i), "dateTime": "2020-01-02T00:00:00"}, {"value": "x", "dateTime": "2020-01-03"}]}]} for i in range(20)]
    path = put(folder, "g.json", json.dumps({"name": "n", "value": {"queryInfo": {"note": [{"a": 1}], "criteria": {}}, "timeSeries": series}}))
    assert rows(records.time_series(spark, path).where("value IS NOT NULL").select("site", "value")) == sorted((f"w{i}", float(i)) for i in range(20))


def test_collections(spark, folder, ranges):
    square = [[[0.04, 0.0], [2.0, 0.0], [2.0, 2.0], [0.04, 2.0]]]
    features = [{"type": "Feature", "id": f"{i:05d}", "properties": {"name": "},{" * (i % 4)}, "geometry": {"type": "Polygon", "coordinates": square}} for i in range(30)]
    doc = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}}, "bbox": [0, 0, 1, 1], "features": features, "tail": {"a": [{"b": 1}]}}
    f = geo.read_features(spark, put(folder, "g.json", json.dumps(doc)))
    assert rows(f.select("id", F.col("properties")["name"], F.size("rings"))) == [(x["id"], x["properties"]["name"], 1) for x in features]
    geo.write_collections(f.withColumn("v", F.lit(3)).repartition(4), ["v"], folder + "/out")
    parts = [json.load(open(os.path.join(folder, "out", p))) for p in os.listdir(folder + "/out") if p.startswith("part")]
    assert len(parts) > 1 and all(p["type"] == "FeatureCollection" for p in parts) and sum(len(p["features"]) for p in parts) == 30
    assert rows(geo.read_features(spark, folder + "/out").select("id")) == [(x["id"],) for x in features]


def test_missing(spark, folder):
    assert records.json_records(spark, folder + "/none").count() == 0


def test_header_matrix_sorts_and_shuffles_no_rows(spark, folder):
    """One file with all rows: they stay in the tasks that cut them."""
    with open(f"{folder}/m.json", "w") as f:
        f.write('[["b","a"],' + ",".join(f'["{i}","x{i}"]' for i in range(2000)) + "]")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = records.header_matrix_rows(spark, folder, ["a", "b", "c"])
        assert sorted(tuple(r) for r in got.collect()) == sorted((f"x{i}", str(i), None) for i in range(2000))
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
