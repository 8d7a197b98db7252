"""Sources and sinks: every layout is written from the tables by Spark and scanned back."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F, types as T

from rillwork.catalog.base import RANKED, SERIES, WIDE, build_wide, monthly, query, ranked, table, wide
from rillwork.operators import facts
from rillwork.plans import county
from rillwork.session import scratch_path, stage
from rillwork.sources import documents, geo, records, tables
from rillwork.streaming import ingest


@query("s1_json_records", "SELECT p_type AS commodity_desc, CASE WHEN p_size <= 25 THEN '$ / BU' ELSE 'PCT' END AS unit_desc, "
       "count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1, 2")
def s1(spark, d):
    path = scratch_path(spark, "records")
    part = table(spark, d, "part").select(
        "p_partkey", F.col("p_type").alias("commodity_desc"), F.when(F.col("p_size") <= 25, "$ / BU").otherwise("PCT").alias("unit_desc"),
        F.format_number("p_retailprice", 2).alias("Value"))
    # half of the records as lines, half as arrays: one for each task that writes
    part.where("p_partkey % 2 = 0").drop("p_partkey").write.json(f"{path}/lines")
    documents.write_documents(part.where("p_partkey % 2 = 1").select(F.to_json(F.struct("commodity_desc", "unit_desc", "Value")).alias("value")), f"{path}/arrays")
    rows = records.json_records(spark, f"{path}/lines", lines=True).unionByName(records.json_records(spark, f"{path}/arrays"))
    from rillwork.functions.columns import parse_number
    return rows.groupBy("commodity_desc", "unit_desc").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(parse_number("Value")), 2).alias("total"))


@query("s2_object_files", "SELECT lpad(CAST(c_nationkey AS VARCHAR), 5, '0') AS fips, count(*)::DOUBLE AS n, round(sum(c_acctbal), 2) AS bal "
       "FROM customer GROUP BY 1")
def s2(spark, d):
    path = scratch_path(spark, "objects")
    agg = table(spark, d, "customer").groupBy(F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("fips")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("bal"))
    agg.withColumn("part", F.col("fips")).write.partitionBy("part").json(path)  # one small file per key
    schema = T.StructType([T.StructField("fips", T.StringType()), T.StructField("n", T.DoubleType()), T.StructField("bal", T.DoubleType())])
    return records.json_objects(spark, path, schema, "fips").select("fips", "n", "bal")


@query("s3_keyed_object", "SELECT lpad(CAST(c_custkey AS VARCHAR), greatest(5, length(CAST(c_custkey AS VARCHAR)))::INT, '0') AS fips, "
       "round(c_acctbal, 2) AS elevation_ft FROM customer")
def s3(spark, d):
    from rillwork.functions.columns import zfill
    path = scratch_path(spark, "keyed")
    entry = F.concat(F.to_json(F.struct(zfill("c_custkey", 5).alias("k"))).substr(F.lit(6), F.lit(100)), F.lit(":"), F.to_json(F.struct(F.round("c_acctbal", 2).alias("elevation_ft"))))
    documents.write_documents(table(spark, d, "customer").select(F.regexp_replace(entry, "}:", ":").alias("value")), path, "{", "}")
    return records.keyed_object(spark, path, "struct<elevation_ft: double>", "fips").select("fips", "value.elevation_ft")


@query("s4_header_matrix", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def s4(spark, d):
    path = scratch_path(spark, "matrix")
    row = F.to_json(F.array(F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_quantity").cast("string")))
    documents.write_documents(table(spark, d, "lineitem").select(row.alias("value")), path, '[["key","line","qty"],')
    return records.header_matrix_rows(spark, path, ["qty", "key", "line"]).select(
        F.col("key").cast("long").alias("l_orderkey"), F.col("line").cast("int").alias("l_linenumber"), F.col("qty").cast("double").alias("l_quantity"))


@query("s5_csv_table", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer")
def s5(spark, d):
    path = scratch_path(spark, "csv")
    table(spark, d, "customer").select("c_name", F.round("c_acctbal", 2).alias("C_ACCTBAL"), "c_custkey").write.option("header", True).csv(path)
    return records.csv_table(spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("s6_mixed_lines", """SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') AS fips,
CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, round(sum(round(o_totalprice, 2)), 2) AS total
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""")
def s6(spark, d):
    path = scratch_path(spark, "lines")
    o, c = table(spark, d, "orders"), table(spark, d, "customer").select("c_custkey", "c_nationkey")
    x = o.join(c, o.o_custkey == c.c_custkey)
    st, co = F.col("c_nationkey").cast("string"), (F.col("o_custkey") % 1000).cast("string")
    yr, rate = F.year("o_orderdate").cast("string"), F.format_string("%.2f", F.col("o_totalprice"))
    tab = F.concat_ws("\t", F.concat(F.lit("LAUCN"), F.lpad(st, 2, "0"), F.lpad(co, 3, "0"), F.lit("0000000003")), yr, F.lit("M13"), rate)
    monthly_row = F.concat_ws("\t", F.lit("LAUCN010010000000003"), yr, F.lit("M01"), rate)
    pipe = F.concat_ws("|", F.lit("CN"), st, co, F.lit("n"), yr, F.lit("a"), F.lit("b"), rate)
    text = F.explode(F.array(F.when(F.col("o_orderstatus") == "F", tab).otherwise(pipe), monthly_row, F.lit("series_id\tyear\tperiod\tvalue")))
    x.select(text.alias("value")).write.text(path)
    return records.unemployment_lines(spark, path).groupBy("fips", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("rate"), 2).alias("total"))


def _insurance(spark, d):
    path = scratch_path(spark, "pipes")
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    blank = [F.lit("x")] * 8
    li.select(F.concat_ws("|", F.year("l_shipdate").cast("string"), F.col("s_nationkey").cast("string"), F.col("l_linenumber").cast("string"),
                          *blank, F.format_number("l_extendedprice", 2), F.format_number(F.col("l_quantity") * 100, 1), F.lit("y"), F.lit("z"))
              .alias("value")).write.text(path)
    return records.insurance_lines(spark, path)


_RMA = """SELECT lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(l_linenumber AS VARCHAR), 3, '0') AS fips,
CAST(year(l_shipdate) AS INT) AS year, l_extendedprice AS premium, l_quantity * 100 AS indemnity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""


@query("s7_pipe_positions", f"SELECT fips, year, count(*) AS n, round(sum(premium), 2) AS premium, sum(indemnity) AS indemnity FROM ({_RMA}) WHERE length(fips) = 5 AND fips <> '00000' GROUP BY 1, 2")
def s7(spark, d):
    return _insurance(spark, d).groupBy("fips", "year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("premium"), 2).alias("premium"), F.sum("indemnity").alias("indemnity"))


@query("a8_two_level", f"""WITH r AS ({_RMA}), y AS (SELECT fips, year, round(sum(premium), 2) AS p, sum(indemnity) AS i FROM r WHERE fips <> '00000' GROUP BY 1, 2)
SELECT fips, round(sum(i) / sum(p), 3) AS insurance_loss_rate, round(sum(p) / count(*), 0) AS insurance_premium_avg FROM y GROUP BY fips HAVING sum(p) > 0""")
def a8(spark, d):
    return facts.two_level_rates(_insurance(spark, d), "fips", "year", "premium", "indemnity")


@query("s8_zip_members", "SELECT c_custkey::VARCHAR AS c_custkey, c_name FROM customer")
def s8(spark, d):
    """Every task writes a zip file of many members; every member is read by a task of its own."""
    folder = scratch_path(spark, "zips")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        for i, pdf in enumerate(batches):
            buf = io.BytesIO()
            with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("readme.md", "x")
                for lo in range(0, len(pdf), 200):
                    z.writestr(f"rows{lo}.csv", pdf.iloc[lo:lo + 200].to_csv(index=False).encode("utf-8-sig"))
            system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
            system.create_dir(path, recursive=True)
            with system.open_output_stream(f"{path}/{uuid.uuid4().hex}.zip") as f:
                f.write(buf.getvalue())
            yield pd.DataFrame({"n": [len(pdf)]})
    table(spark, d, "customer").select("c_custkey", "c_name").mapInPandas(pack, "n int").agg(F.sum("n")).collect()
    return records.zipped_rows(spark, folder, ["c_custkey", "c_name"], every=True)


def _sites(spark, d):
    """Event readings as nested time-series documents of many series each."""
    path = scratch_path(spark, "series")
    reading = F.struct(F.col("value").cast("string").alias("value"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("dateTime"))
    series = F.struct(F.struct(F.col("event_type").alias("siteName")).alias("sourceInfo"), F.array(F.struct(F.array(reading).alias("value"))).alias("values"))
    documents.write_documents(table(spark, d, "events").select(F.to_json(series).alias("value")), path, '{"name":"series","value":{"queryInfo":{"note":{}},"timeSeries":[', "]}}")
    return records.time_series(spark, path)


@query("s9_time_series", "SELECT event_type AS site, CAST(ts AS DATE) AS date, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def s9(spark, d):
    return _sites(spark, d).groupBy("site", "date").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("s10_named_series", f"""WITH {SERIES} SELECT state, month AS date, value AS close FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY month DESC) AS rn FROM monthly) WHERE rn <= 60""")
def s10(spark, d):
    entries = F.map_from_entries(F.collect_list(F.struct(F.date_format("month", "yyyy-MM-dd"), F.create_map(
        F.lit("4. close"), F.col("value").cast("string"), F.lit("5. volume"), F.lit("1")))))
    docs = monthly(spark, d).groupBy("state").agg(F.to_json(F.create_map(F.lit("Monthly Time Series"), entries)).alias("text"))
    rows = docs.select("state", F.explode(records.named_series(F.col("text"), "Monthly Time Series")).alias("r")).select("state", "r.date", "r.close")
    return facts.newest_rows(rows, "state", "date", 60)


_S11_COLS = "fips, state, crop_water_eff, composite_crop_value, crop_diversity_hhi, poverty_rate, precip_deficit_in"


@query("s11_feature_table", f"WITH {WIDE} SELECT {_S11_COLS} FROM wide WHERE crop_water_eff IS NOT NULL")
def s11(spark, d):
    path = scratch_path(spark, "cache")
    tables.write_features(build_wide(spark, d), path)  # always the full build, from the raw tables
    return tables.read_features(spark, path, "crop_water_eff").select(*_S11_COLS.split(", "))


@query("s12_json_sink", "SELECT n_name AS state, count(*) AS n, round(avg(c_acctbal), 4) AS mean FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def s12(spark, d):
    path = scratch_path(spark, "result")
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    out = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("state")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))
    tables.write_json(out, path)
    return spark.read.schema("state string, n long, mean double").json(path)


@query("s13_keyed_sink", f"WITH {WIDE} SELECT fips, crop_water_eff, awc_mean, county FROM wide")
def s13(spark, d):
    path = scratch_path(spark, "county_wide")
    tables.write_keyed(wide(spark, d), "fips", path, drop=("log_crop_water_eff",))
    return tables.read_keyed(spark, path, "fips", "crop_water_eff double, awc_mean double, county string")


def _shapes(spark, d):
    """One square per customer around (balance, key), every fifth nation as a two-part shape."""
    x, y = F.col("c_acctbal") / 100, F.col("c_nationkey").cast("double")
    ring = F.array(*[F.array(x + dx, y + dy) for dx, dy in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    multi = F.col("c_nationkey") >= 20
    coords = F.when(multi, F.to_json(F.array(F.array(ring), F.array(ring)))).otherwise(F.to_json(F.array(ring)))
    return table(spark, d, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"),
        F.when(multi, "MultiPolygon").otherwise("Polygon").alias("kind"), coords.alias("coordinates"))


def _features(spark, d):
    """Half of the shapes through feature collections, half through lines."""
    path, shapes = scratch_path(spark, "geo"), _shapes(spark, d)
    geo.write_collections(shapes.where("id % 2 = 0"), ["name", "segment"], f"{path}/collections")
    geo.write_feature_lines(shapes.where("id % 2 = 1"), ["name", "segment"], f"{path}/lines")
    return geo.read_features(spark, f"{path}/collections").unionByName(geo.read_feature_lines(spark, f"{path}/lines"))


@query("s14_geojson", "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment, CASE WHEN c_nationkey >= 20 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, "
       "CASE WHEN c_nationkey >= 20 THEN 2 ELSE 1 END::INT AS n_rings FROM customer")
def s14(spark, d):
    f = _features(spark, d)
    return f.select("id", F.col("properties")["name"].alias("name"), F.col("properties")["segment"].alias("segment"), "kind", F.size("rings").alias("n_rings"))


_CENTRE = "round(c_acctbal / 100 + 0.5, 4) AS lon, c_nationkey + 0.5::DOUBLE AS lat"


@query("c21_vertex_mean", f"SELECT c_custkey::VARCHAR AS id, {_CENTRE} FROM customer")
def c21(spark, d):
    return _features(spark, d).select("id", geo.centre(F.col("rings")).alias("c")).select("id", "c.lon", "c.lat")


@query("c20_thin_coordinates", "SELECT c_custkey::VARCHAR AS id, round(c_acctbal / 100, 1) AS lon0, round(c_nationkey::DOUBLE, 1) AS lat0 FROM customer")
def c20(spark, d):
    f = _features(spark, d).select("id", geo.thin(F.col("rings"), 1).alias("r"))
    return f.select("id", F.col("r")[0][0][0].alias("lon0"), F.col("r")[0][0][1].alias("lat0"))


@query("j6_geometry_match", f"WITH {WIDE} SELECT c_custkey::VARCHAR AS id, w.crop_water_eff, {_CENTRE} FROM customer JOIN wide w ON w.county = c_name WHERE w.crop_water_eff IS NOT NULL")
def j6(spark, d):
    f = _features(spark, d).select("id", F.col("properties")["name"].alias("county"), geo.centre(F.col("rings")).alias("c"))
    m = wide(spark, d).where("crop_water_eff IS NOT NULL").select("county", "crop_water_eff")
    return geo.merge_properties(f, m, "county", keep_unmatched=False).select("id", "crop_water_eff", "c.lon", "c.lat")


@query("s15_first_nonempty", "SELECT l_suppkey, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def s15(spark, d):
    li = table(spark, d, "lineitem")
    total = lambda df: df.groupBy("l_suppkey").agg(F.round(F.sum("l_quantity"), 2).alias("total"))
    return facts.first_nonempty([total(li.where(F.col("l_quantity") > 1e9)), total(li.where("l_returnflag = 'R'")), total(li)], keep=lambda u: stage(u, "candidates"))


@query("s16_optional_source", "SELECT n_name AS state, 0.5::DOUBLE AS good_ratio FROM nation")
def s16(spark, d):
    soil = records.optional(spark, lambda: spark.read.parquet(scratch_path(spark, "missing")), "state string, good_ratio double")
    states = table(spark, d, "nation").select(F.col("n_name").alias("state"))
    return facts.lookup_or(states, soil, "state", {"good_ratio": 0.5})


_S17 = "WITH t AS (SELECT c_custkey, unnest(range(1995, 2002))::INT AS year FROM customer), e AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INT) AS year FROM orders)"


def _targets(spark, d):
    t = ingest.year_targets(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), 1995, 2001)
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("year"))
    return t, e


@query("s17_pending_targets", f"{_S17} SELECT c_custkey, t.year FROM t WHERE NOT EXISTS (SELECT 1 FROM e WHERE o_custkey = c_custkey AND e.year = t.year)")
def s17(spark, d):
    t, e = _targets(spark, d)
    return ingest.pending(t.select("c_custkey", "year"), e, ["c_custkey", "year"])


@query("j10_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j10(spark, d):
    done = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return ingest.pending(table(spark, d, "customer").select("c_custkey"), done, ["c_custkey"])


@query("s18_week_windows", """WITH b AS (SELECT user_id, CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS z FROM events GROUP BY 1),
w AS (SELECT user_id, z, unnest(generate_series(a, z, INTERVAL 7 DAY))::DATE AS week_start FROM b)
SELECT user_id, week_start, least(z, (week_start + INTERVAL 6 DAY)::DATE) AS week_end FROM w""")
def s18(spark, d):
    b = table(spark, d, "events").groupBy("user_id").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("z"))
    return ingest.weekly_windows(b, "a", "z").select("user_id", "week_start", "week_end")


@query("s19_completeness", """WITH t AS (SELECT c_custkey, c_mktsegment, unnest(range(1995, 2002))::INT AS year FROM customer),
e AS (SELECT DISTINCT o_custkey, CAST(year(o_orderdate) AS INT) AS year FROM orders)
SELECT c_mktsegment, count(*) AS total, count(o_custkey) AS done, round(count(o_custkey) / count(*)::DOUBLE * 100, 1) AS pct
FROM t LEFT JOIN e ON o_custkey = c_custkey AND e.year = t.year GROUP BY ROLLUP (c_mktsegment)""")
def s19(spark, d):
    t, e = _targets(spark, d)
    return ingest.completeness(t, e, "c_mktsegment", ["c_custkey", "year"])


@query("s20_invalid_documents", f"WITH {WIDE} SELECT fips FROM wide WHERE awc_mean IS NULL")
def s20(spark, d):
    return records.invalid_documents(wide(spark, d).select("fips", F.col("awc_mean").cast("string").alias("awc_mean")), "fips", "awc_mean")


_SWEPT = ("SELECT *, CASE WHEN c_custkey % 11 = 0 THEN 'blank' WHEN c_custkey % 7 = 0 THEN 'broken' WHEN c_custkey % 5 = 0 THEN 'no key' WHEN c_mktsegment = 'HOUSEHOLD' OR c_custkey % 13 = 0 THEN 'placeholder' END AS reason, "
          "round(c_acctbal, 2) AS v FROM customer")


@query("s20b_quarantine", f"SELECT coalesce(reason, 'good') AS reason, count(*) AS n, count(DISTINCT CASE WHEN reason IS NULL OR reason = 'placeholder' THEN c_custkey END) AS keys, "
       f"round(sum(CASE WHEN reason IS NULL THEN v END), 2) AS total FROM ({_SWEPT}) GROUP BY 1")
def s20b(spark, d):
    """Documents of which some are broken, blank, without key or without measure, swept into good rows and a quarantine."""
    path, out = scratch_path(spark, "documents"), scratch_path(spark, "swept")
    k, good = F.col("c_custkey"), F.to_json(F.struct(F.col("c_custkey").cast("string").alias("fips"), F.round("c_acctbal", 2).alias("awc_mean")))
    text = (F.when(k % 11 == 0, "  ").when(k % 7 == 0, F.substring(good, 1, 12)).when(k % 5 == 0, '{"awc_mean": 1.5}').when(F.col("c_mktsegment") == "HOUSEHOLD", F.to_json(F.struct(k.cast("string").alias("fips"))))
            .when(k % 13 == 0, F.to_json(F.struct(k.cast("string").alias("fips"), F.lit("oops").alias("awc_mean")))).otherwise(good))
    table(spark, d, "customer").select(text.alias("value")).write.text(path)
    records.quarantine(records.swept(spark, path, "fips", "awc_mean"), out)
    kept = spark.read.schema("path string, fips string, awc_mean double, reason string, text string").parquet(out)
    return kept.groupBy(F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fips").alias("keys"), F.round(F.sum(F.when(F.col("reason").isNull(), F.col("awc_mean"))), 2).alias("total"))


@query("s17b_listed_load", "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def s17b(spark, d):
    """Order files are loaded from a listing; the first run is interrupted and the second goes on where it ended."""
    root, out = scratch_path(spark, "objects"), scratch_path(spark, "loaded")
    o = table(spark, d, "orders").select("o_totalprice", F.year("o_orderdate").alias("year"))
    o.withColumn("part", F.col("year")).write.partitionBy("part").parquet(root)
    schema = "o_totalprice double, year int"
    ingest.load_listed(spark, root, out, schema, per_load=2, most_loads=1)
    ingest.load_listed(spark, root, out, schema, per_load=4)
    rows = ingest.read_loaded(spark, out, schema)
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("s21_tagged_union", "SELECT l_returnflag AS sector, l_suppkey, l_quantity FROM lineitem")
def s21(spark, d):
    li = table(spark, d, "lineitem")
    part = lambda f: li.where(F.col("l_returnflag") == f).select("l_suppkey", "l_quantity")
    return facts.tagged_union({f: part(f) for f in ("A", "N", "R")}, "sector")


@query("a27p_well_depth", "SELECT event_type AS site, CAST(year(ts) AS INT) AS year, round(round(sum(value), 2) / count(*), 4) AS depth FROM events GROUP BY 1, 2")
def a27p(spark, d):
    return facts.mean_years(_sites(spark, d), "site", "date", "value", "depth").select("site", "year", F.round("depth", 4).alias("depth"))
