"""Cleaning, keys, labels, unit changes and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork import config
from rillwork.catalog.base import GROUPS, LINES, TYPES, WIDE, YIELDS, lines, query, table, wide
from rillwork.functions import columns as X
from rillwork.operators import facts, models


@query("c1_parse_number", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE round(c_acctbal * 10, 2) END AS v FROM customer")
def c1(spark, d):
    text = F.when(F.col("c_mktsegment") == "BUILDING", "(D)").when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.lit(" "), F.format_number(F.col("c_acctbal") * 10, 2), F.lit(" "))) \
            .otherwise(F.format_number(F.col("c_acctbal") * 10, 2))
    return table(spark, d, "customer").select("c_custkey", X.parse_number(text).alias("v"))


@query("c2_place_key", "SELECT s_suppkey, CASE WHEN length(CAST(s_suppkey % 1000 AS VARCHAR)) <= 3 AND NOT (s_nationkey = 0 AND s_suppkey % 1000 = 0) THEN "
       "lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || lpad(CAST(s_suppkey % 1000 AS VARCHAR), 3, '0') END AS fips FROM supplier")
def c2(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", X.place_key("s_nationkey", F.col("s_suppkey") % 1000).alias("fips"))


@query("c3_split_place", "SELECT c_custkey, c_name AS county, CASE WHEN c_acctbal < 0 THEN '' ELSE n_name END AS state FROM customer JOIN nation ON c_nationkey = n_nationkey")
def c3(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    name = F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.concat_ws(", ", "c_name", "n_name"))
    county, state = X.split_place(name)
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", county.alias("county"), state.alias("state"))


@query("c4_sentinel", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_custkey END AS v FROM customer")
def c4(spark, d):
    text = F.when(F.col("c_acctbal") < 0, "-666666666").otherwise(F.col("c_custkey").cast("string"))
    return table(spark, d, "customer").select("c_custkey", X.parse_count(text).alias("v"))


@query("c5_to_numeric", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_retailprice END AS price, p_size::DOUBLE AS size FROM part")
def c5(spark, d):
    raw = table(spark, d, "part").select("p_partkey", F.when(F.col("p_type") == "PROMO", "n/a").otherwise(F.col("p_retailprice").cast("string")).alias("price"),
                                         F.col("p_size").cast("string").alias("size"))
    return X.to_numeric(raw, ["price", "size"])


@query("c6_safe_ratio", "SELECT l_orderkey, l_linenumber, round(l_quantity / nullif(l_discount, 0), 4) AS r FROM lineitem")
def c6(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.finite(X.ratio("l_quantity", "l_discount")), 4).alias("r"))


@query("c7_first_filled", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE c_mktsegment END AS v FROM customer")
def c7(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.first_filled(
        F.when(F.col("c_mktsegment") == "BUILDING", " ").otherwise(F.col("c_mktsegment")), F.lit(None).cast("string"), "c_name").alias("v"))


_NAME_GROUPS = {"METAL": ["BOLT", "GEAR", "ROD", "PLATE"], "HOT": ["HOT", "RED"], "ROUND": ["RING"], "HEAVY": ["ANVIL"]}


@query("c8_keyword_group", "SELECT p_partkey, CASE WHEN regexp_matches(upper(p_name), 'BOLT|GEAR|ROD|PLATE') THEN 'METAL' WHEN regexp_matches(upper(p_name), 'HOT|RED') THEN 'HOT' "
       "WHEN upper(p_name) LIKE '%RING%' THEN 'ROUND' WHEN upper(p_name) LIKE '%ANVIL%' THEN 'HEAVY' ELSE 'OTHER' END AS grp FROM part")
def c8(spark, d):
    return table(spark, d, "part").select("p_partkey", X.keyword_group("p_name", _NAME_GROUPS).alias("grp"))


_ENTRIES = [("RED WIDGET", 4.0, "$ / TON", "A"), ("WIDGET", 3.5, "$ / BU", "B"), ("RED", 2.0, "$ / LB", "C"), ("OLD GEAR BOX", 1.0, "$ / LB", "D")]


@query("c9_entry_for_name", """SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 4.0 WHEN p_name LIKE '%widget%' THEN 3.5 WHEN p_name LIKE '%red%' THEN 2.0
WHEN 'old gear box' LIKE '%' || p_name || '%' THEN 1.0 END::DOUBLE AS rate FROM part""")
def c9(spark, d):
    return table(spark, d, "part").select("p_partkey", X.entry_for_name("p_name", _ENTRIES)["rate"].alias("rate"))


@query("j7_substring_join", """WITH e(key, ord, rate) AS (VALUES ('RED WIDGET', 0, 4.0), ('WIDGET', 1, 3.5), ('RED', 2, 2.0), ('OLD GEAR BOX', 3, 1.0))
SELECT p_name, arg_min(rate, ord)::DOUBLE AS rate, count(*) AS n_matches FROM (SELECT DISTINCT p_name FROM part) JOIN e ON contains(upper(p_name), key) OR contains(key, upper(p_name)) GROUP BY 1""")
def j7(spark, d):
    keys = spark.createDataFrame([(k, i, r) for i, (k, r, *_) in enumerate(_ENTRIES)], "key string, ord int, rate double")
    names = table(spark, d, "part").select("p_name").distinct()  # the theta join sees each name once
    up = F.upper("p_name")
    hit = names.join(F.broadcast(keys), up.contains(F.col("key")) | F.col("key").contains(up))
    return hit.groupBy("p_name").agg(F.min_by("rate", "ord").alias("rate"), F.count(F.lit(1)).alias("n_matches"))


@query("c10_region", "SELECT c_custkey, CASE WHEN c_nationkey IN (4, 6, 8, 16) THEN 'west' WHEN c_nationkey IN (17, 18, 19, 20) THEN 'midwest' "
       "WHEN c_nationkey IN (1, 5, 10, 12, 13, 21, 22, 24) THEN 'south' WHEN c_nationkey IN (9, 23) THEN 'northeast' ELSE 'other' END AS region FROM customer")
def c10(spark, d):
    return table(spark, d, "customer").select("c_custkey", X.region_of("c_nationkey").alias("region"))


@query("c11_cluster_label", f"""WITH {WIDE} SELECT fips, CASE WHEN coalesce(eto_avg_in, 0) > 85 THEN 'Extreme-Arid Low-Efficiency' WHEN coalesce(avg_farm_size_ac, 0) > 2000 AND coalesce(precip_deficit_in, 0) > 40 THEN 'Arid Large-Farm'
WHEN coalesce(log_crop_water_eff, 0) > 7.5 THEN 'High-Efficiency Grain Belt' WHEN coalesce(log_crop_water_eff, 0) > 6 AND coalesce(precip_deficit_in, 0) < 40 THEN 'Western High-Efficiency'
WHEN coalesce(poverty_rate, 0) > 16 THEN 'Resource-Constrained' ELSE 'Arid Large-Farm Low-Efficiency' END AS name FROM wide""")
def c11(spark, d):
    return wide(spark, d).select("fips", X.cluster_label("eto_avg_in", "log_crop_water_eff", "poverty_rate", "avg_farm_size_ac", "precip_deficit_in").alias("name"))


@query("c12_clip_log", "SELECT c_custkey, round(ln(1 + greatest(c_acctbal, 0)), 6) AS logv, least(greatest(c_acctbal, 0), 5000) AS clipped FROM customer")
def c12(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(X.log1p_floor("c_acctbal"), 6).alias("logv"), X.clip("c_acctbal", 0.0, 5000.0).alias("clipped"))


@query("c13_effect_pct", "SELECT l_orderkey, l_linenumber, round((exp(l_discount - l_tax) - 1) * 100, 4) AS pct FROM lineitem")
def c13(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.effect_pct(F.col("l_discount") - F.col("l_tax")), 4).alias("pct"))


_COLS = ["awc_mean", "crop_water_eff", "poverty_rate", "eto_avg_in"]


@query("c14_at_least_filled", f"WITH {WIDE} SELECT fips, awc_mean, crop_water_eff, poverty_rate, eto_avg_in FROM wide WHERE (awc_mean IS NOT NULL)::INT + (crop_water_eff IS NOT NULL)::INT + (poverty_rate IS NOT NULL)::INT + 1 >= 4")
def c14(spark, d):
    return X.at_least_filled(wide(spark, d).select("fips", *_COLS), 4, _COLS)


@query("c15_core_rows", f"WITH {WIDE} SELECT fips, state_fips FROM wide WHERE eto_avg_in IS NOT NULL AND awc_mean IS NOT NULL AND CAST(state_fips AS INT) <= 20")
def c15(spark, d):
    return X.core_rows(wide(spark, d), ["eto_avg_in", "awc_mean"], max_state=20).select("fips", "state_fips")


def _long_records(spark, d):
    return lines(spark, d).select(
        "l_orderkey", "l_linenumber", F.col("l_returnflag").alias("agg_level_desc"), F.col("l_linestatus").alias("source_desc"), F.col("year").cast("string").alias("year"),
        F.concat_ws(", ", F.upper("p_name"), F.when(F.col("l_quantity") > 25, "IRRIGATED").otherwise("TOTAL"), F.lit("ACRES")).alias("short_desc"))


@query("c16_selector", f"WITH {LINES} SELECT l_orderkey, l_linenumber FROM lines WHERE l_returnflag = 'R' AND l_linestatus = 'O' AND year >= 1998")
def c16(spark, d):
    return X.select_records(_long_records(spark, d), {"agg_level_desc": "R", "source_desc": "O"}, min_year=1998).select("l_orderkey", "l_linenumber")


@query("c17_text_filter", f"WITH {LINES} SELECT l_orderkey, l_linenumber FROM lines WHERE upper(p_name) LIKE '%RING%' AND l_quantity > 25 AND l_returnflag = 'R'")
def c17(spark, d):
    return X.select_records(_long_records(spark, d), {"agg_level_desc": "R"}, contains={"short_desc": ["IRRIGATED", "RING", "ACRE"]}).select("l_orderkey", "l_linenumber")


@query("c18_units", """SELECT l_orderkey, l_linenumber, round(l_quantity * 0.1::DOUBLE / 25.4::DOUBLE, 6) AS inches, l_quantity * 325851 AS gallons, round(l_quantity / 4046.86::DOUBLE, 8) AS acres,
round(l_quantity / 12, 6) AS feet, l_quantity * 1000 AS dollars, CASE WHEN l_quantity - 3025 > -3000 THEN round((l_quantity - 3025) * 0.0001::DOUBLE, 6) END AS ndvi FROM lineitem""")
def c18(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(X.tenth_mm_to_inch(q), 6).alias("inches"), X.acre_feet_to_gallons(q).alias("gallons"),
        F.round(X.sq_m_to_acre(q), 8).alias("acres"), F.round(X.inch_to_foot(q), 6).alias("feet"), X.thousands(q).alias("dollars"),
        F.round(X.ndvi(q - 3025), 6).alias("ndvi"))


@query("c19_label", """SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'On Offer' ELSE upper(p_type[1]) || lower(p_type[2:]) || ' Part' END AS label FROM part""")
def c19(spark, d):
    key = F.concat(F.lower("p_type"), F.lit("_part"))
    return table(spark, d, "part").select("p_partkey", X.display_label(key, {"promo_part": "On Offer"}).alias("label"))


@query("c22_exclude", "SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')")
def c22(spark, d):
    return X.without_names(table(spark, d, "part"), "p_type", ["PROMO", "SMALL"]).select("p_partkey", "p_type")


@query("c23_series_key", "SELECT o_orderkey, lpad(CAST(o_custkey % 100000 AS VARCHAR), 5, '0') AS fips FROM orders WHERE o_orderstatus = 'F'")
def c23(spark, d):
    code = F.lpad((F.col("o_custkey") % 100000).cast("string"), 5, "0")
    rows = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("LAUCN"), code, F.lit("0000000003")).alias("sid"),
                                            F.when(F.col("o_orderstatus") == "F", "M13").otherwise("M01").alias("period"))
    return rows.where(F.col("period") == "M13").select("o_orderkey", X.series_place("sid").alias("fips"))
