import json
import os
import zipfile

from pyspark.sql import functions as F

from conftest import rows
from rillwork.sources import files, geo, records, tables
from rillwork.streaming import ingest


def put(folder, name, text, encoding="utf-8"):
    path = os.path.join(folder, name)
    with open(path, "w", encoding=encoding) as f:
        f.write(text)
    return path


def test_json_records(spark, folder):
    path = put(folder, "a.json", json.dumps([{"commodity_desc": "CORN", "Value": "1,200", "year": "2018"}, {"commodity_desc": "HAY", "Value": "(D)"}]))
    assert rows(records.json_records(spark, path).select("commodity_desc", "Value")) == [("CORN", "1,200"), ("HAY", "(D)")]
    assert records.json_records(spark, put(folder, "broken.json", "not json")).count() == 0
    missing = records.json_records(spark, folder + "/none.json")
    assert missing.count() == 0 and "Value" in missing.columns


def test_json_objects_skip_unreadable(spark, folder):
    sub = os.path.join(folder, "docs")
    os.mkdir(sub)
    put(sub, "1.json", json.dumps({"fips": "06001", "awc_mean": 0.1}))
    put(sub, "2.json", "{oops")
    put(sub, "3.json", json.dumps({"awc_mean": 0.2}))
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("fips", T.StringType()), T.StructField("awc_mean", T.DoubleType())])
    assert rows(records.json_objects(spark, sub, schema, "fips")) == [("06001", 0.1)]


def test_keyed_and_nested(spark, folder):
    path = put(folder, "e.json", json.dumps({"06001": {"elevation_ft": 12.5}, "06003": {"lat": 1.0}}))
    got = records.keyed_object(spark, path, "struct<elevation_ft: double>", "fips").select("fips", "value.elevation_ft")
    assert rows(got) == [("06001", 12.5), ("06003", None)]
    path = put(folder, "p.json", json.dumps({"CA": {"2013": 1.5, "2018": 2.0}, "TX": {}}))
    assert rows(records.nested_years(spark, path)) == [("CA", 2013, 1.5), ("CA", 2018, 2.0)]


def test_header_matrix(spark, folder):
    path = put(folder, "m.json", json.dumps([["NAME", "state"], ["Kern County, California", "06"], ["Cass", "38"]]))
    assert rows(records.header_matrix_rows(spark, path, ["NAME", "state", "gone"])) == [("Cass", "38", None), ("Kern County, California", "06", None)]


def test_csv_with_mark_and_other_order(spark, folder):
    path = put(folder, "c.csv", "GEOID,centerpivot_ac\n1001,5.5\n1003,x\n", "utf-8-sig")
    assert rows(records.csv_table(spark, path, "centerpivot_ac double, geoid string")) == [(5.5, "1001"), (None, "1003")]


def test_unemployment_layouts(spark, folder):
    put(folder, "a.txt", "series_id\tyear\tperiod\tvalue\nLAUCN010010000000003\t2020\tM13\t4.5\nLAUCN010010000000003\t2020\tM01\t9.9\n")
    put(folder, "b.txt", "LAUS area title\nCN0100300000000|1|3|Baldwin|2021|a|b|3.5\nshort|line\nCN1 1 5 Barbour 2019 a b 6.0\n")
    assert rows(records.unemployment_lines(spark, folder)) == [("01001", 2020, 4.5), ("01003", 2021, 3.5), ("01005", 2019, 6.0)]


def test_insurance_and_zip(spark, folder):
    line = "|".join(["2020", "6", "1", *["x"] * 8, "1,000", "250", "y", "z"])
    path = put(folder, "i.txt", line + "\nbad|row\n")
    assert rows(records.insurance_lines(spark, path)) == [("06001", 2020, 1000.0, 250.0)]
    with zipfile.ZipFile(folder + "/n.zip", "w") as z:
        z.writestr("notes.md", "x")
        z.writestr("nri.csv", "STCOFIPS,RISK_SCORE\n01001,5.5\n".encode("utf-8-sig"))
    assert rows(records.zipped_rows(spark, folder + "/n.zip", ["STCOFIPS", "RISK_SCORE", "OTHER"])) == [("01001", "5.5", None)]


def test_every_member_of_many_zips(spark, folder):
    for n in range(3):
        with zipfile.ZipFile(f"{folder}/z{n}.zip", "w", zipfile.ZIP_DEFLATED if n else zipfile.ZIP_STORED) as z:
            z.writestr("notes.md", "x")
            z.writestr("dir/", "")
            for m in range(4):
                z.writestr(f"dir/m{m}.CSV", "a,b\n" + "".join(f"{n},{m * 1000 + i}\n" for i in range(m * 500)))
            z.writestr("empty.csv", "")
    index = files.zip_members(spark, folder)
    assert index.count() == 15
    got = files.member_rows(index, ["b", "a"])
    assert got.count() == 3 * (0 + 500 + 1000 + 1500) and got.where("member = 'dir/m3.CSV'").agg(F.count_distinct("b")).first()[0] == 1500
    assert records.zipped_rows(spark, folder, ["a"], suffix="m1.csv").count() == 1500
    assert records.zipped_rows(spark, folder + "/none", ["a"]).count() == 0


def test_swept_documents(spark, folder):
    lines = ['{"fips": "1", "awc_mean": 0.5}', '{"fips": "2"', "", '{"awc_mean": 1}', '{"fips": "5", "awc_mean": null}', '{"fips": "6", "awc_mean": "oops"}', "[1]", "   ", '{"fips": "9", "awc_mean": "0.25", "more": {"x": 1}}']
    got = records.swept(spark, put(folder, "d.json", "\n".join(lines)), "fips", "awc_mean")
    want = [("1", 0.5, None), (None, None, "broken"), (None, None, "blank"), (None, 1.0, "no key"), ("5", None, "placeholder"), ("6", None, "placeholder"), (None, None, "broken"), (None, None, "blank"), ("9", 0.25, None)]
    assert [r[2] for r in rows(got.select("fips", "awc_mean", "reason"))].count(None) == 2
    assert sorted((str(r["reason"]), str(r["awc_mean"])) for r in got.collect()) == sorted((str(w[2]), str(w[1])) for w in want)
    records.quarantine(got, folder + "/out")
    bad = spark.read.parquet(folder + "/out/state=bad")
    assert bad.count() == 7 and bad.where("path IS NULL").count() == 0 and bad.where("reason = 'placeholder'").agg(F.count_distinct("fips")).first()[0] == 2
    sub = os.path.join(folder, "whole")
    os.mkdir(sub)
    put(sub, "a.json", '{"fips": "1",\n "awc_mean": 2}')
    put(sub, "b.json", '{"fips": ')
    assert rows(records.swept(spark, sub, "fips", "awc_mean", whole=True).select("fips", "awc_mean", "reason")) == [("1", 2.0, None), (None, None, "broken")]


def test_a_load_goes_on_after_an_interruption(spark, folder):
    for k in range(5):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(f"{folder}/in/k{k}")
    out = folder + "/out"
    ids = lambda: sorted(r[0] for r in ingest.read_loaded(spark, out, "id long").collect())
    assert ingest.load_listed(spark, folder + "/in", out, "id long", per_load=2, most_loads=1) == 1 and ids() == list(range(20))
    spark.range(500, 510).write.parquet(f"{out}/rows/load=lost")  # rows of a load that was never committed
    assert ingest.load_listed(spark, folder + "/in", out, "id long", per_load=2) == 2 and ids() == list(range(50))
    assert ingest.load_listed(spark, folder + "/in", out, "id long") == 0
    part = next(p for p in os.listdir(folder + "/in/k0") if p.endswith(".parquet"))
    spark.range(900, 905).coalesce(1).write.parquet(folder + "/other")
    new = next(p for p in os.listdir(folder + "/other") if p.endswith(".parquet"))
    with open(f"{folder}/other/{new}", "rb") as a, open(f"{folder}/in/k0/{part}", "wb") as b:
        b.write(a.read())
    if os.path.exists(f"{folder}/in/k0/.{part}.crc"):
        os.remove(f"{folder}/in/k0/.{part}.crc")
    assert ingest.load_listed(spark, folder + "/in", out, "id long") == 1 and ids() == [*range(10, 50), *range(900, 905)]


def test_a_listing_opens_nothing(spark, folder):
    put(folder, "a.bin", "x" * 10)
    plan = files.listing(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and rows(files.listing(spark, folder).select("length")) == [(10,)]


def test_series_documents(spark, folder):
    doc = {"value": {"timeSeries": [{"sourceInfo": {"siteName": "w1"}, "values": [{"value": [{"value": "3.5", "dateTime": "2020-01-02T00:00:00"}, {"value": "x", "dateTime": "2020-01-03"}]}]}]}}
    path = put(folder, "g.json", json.dumps(doc))
    got = records.time_series(spark, path)
    assert got.count() == 2 and got.where("value IS NOT NULL").first()["value"] == 3.5
    text = json.dumps({"Monthly Time Series": {"2020-01-31": {"4. close": "1.5", "5. volume": "7"}}, "Meta": {}})
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(records.named_series(F.col("t"), "Monthly Time Series")).alias("r"))
    assert df.select("r.close", "r.volume").first() == (1.5, 7)


def test_vegetation_and_invalid(spark):
    df = spark.createDataFrame([("06001", [("2020-01-01", 5000.0), ("2020-01-17", -3000.0)])], "fips string, ndvi array<struct<date: string, ndvi: double>>")
    assert rows(records.vegetation(df)) == [("06001", "2020-01-01", 0.5)]
    docs = spark.createDataFrame([("a", "0.1"), ("b", None), ("c", "oops")], "fips string, awc string")
    assert rows(records.invalid_documents(docs, "fips", "awc")) == [("b",), ("c",)]


def test_keyed_sink_clears_nan(spark, folder):
    df = spark.createDataFrame([("06001", float("nan"), 1.0), ("06003", 2.0, float("inf"))], "fips string, a double, b double")
    tables.write_keyed(df, "fips", folder + "/k", drop=())
    assert rows(tables.read_keyed(spark, folder + "/k", "fips", "a double, b double")) == [("06001", None, 1.0), ("06003", 2.0, None)]
    tables.write_features(df, folder + "/f")
    assert tables.read_features(spark, folder + "/f", "a").count() == 2


def test_geojson(spark, folder):
    square = [[[0.04, 0.0], [2.0, 0.0], [2.0, 2.0], [0.04, 2.0]]]
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "id": "06001", "properties": {"name": "A"}, "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "id": "06003", "properties": {"name": "B"}, "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]}
    f = geo.read_features(spark, put(folder, "g.json", json.dumps(doc)))
    got = {r["id"]: r for r in f.select("id", geo.centre(F.col("rings")).alias("c"), F.size("rings").alias("n"), geo.thin_text(F.col("kind"), F.col("coordinates")).alias("t")).collect()}
    assert (got["06001"]["c"]["lon"], got["06001"]["c"]["lat"], got["06003"]["n"]) == (1.02, 1.0, 2)
    assert json.loads(got["06003"]["t"]) == [[[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]]] * 2
    merged = geo.merge_properties(f.withColumn("fips", F.col("id")), spark.createDataFrame([("06001", 3.5)], "fips string, v double"), "fips", True)
    geo.write_feature_lines(merged, ["v"], folder + "/out")
    back = [json.loads(r[0]) for r in spark.read.text(folder + "/out").collect()]
    assert {b["id"]: b["properties"]["v"] for b in back} == {"06001": 3.5, "06003": None}
    assert rows(geo.read_feature_lines(spark, folder + "/out").select("id", "kind")) == [("06001", "Polygon"), ("06003", "MultiPolygon")]
