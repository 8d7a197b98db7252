"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.catalog.base import CROPS, FACTS, LINES, WIDE, area_records, crops, line_sums, price_records, query, table, water_records, wi_area, wide
from rillwork import config
from rillwork.operators import facts, models, profile, ranks
from rillwork.session import stage
from rillwork.functions import columns as X


def _entity_parts(spark, d):
    """Orders and their lines in one grouping: one row per customer. Lines are merged per order first, and an order without lines stays."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    per_order = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    some = lambda cond: F.nullif(F.count(F.when(cond, 1)), F.lit(0))
    per = o.join(per_order, "o_orderkey", "left").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"), F.max("o_totalprice").alias("largest"),
        F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"), some(F.col("o_orderstatus") == "F").alias("n_closed"),
        some(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"), F.sum("q").alias("qty"), F.sum("n").alias("n_lines"))
    return [per]


@query("j1_left_chain", """SELECT c_custkey, c_name, n_orders, spent, largest, first_day, last_day, n_closed, n_urgent, qty, n_lines FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent, max(o_totalprice) AS largest, min(o_orderdate)::DATE AS first_day, max(o_orderdate)::DATE AS last_day,
 nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS n_closed, nullif(count(*) FILTER (o_orderpriority = '1-URGENT'), 0) AS n_urgent FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
LEFT JOIN (SELECT o_custkey, sum(l_quantity) AS qty, count(*) AS n_lines FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1) b ON b.o_custkey = c_custkey""")
def j1(spark, d):
    return facts.chain_left(table(spark, d, "customer").select("c_custkey", "c_name"), _entity_parts(spark, d), "c_custkey")


@query("j2_lookup_default", "SELECT c_custkey, CASE WHEN n_name IN ('NATION_1', 'NATION_2') THEN 0.3 ELSE 0.05 END::DOUBLE AS share, coalesce(nullif(greatest(c_acctbal, 0), 0), 1.0) AS bal "
       "FROM customer JOIN nation ON c_nationkey = n_nationkey")
def j2(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    shares = n.where(F.col("n_name").isin("NATION_1", "NATION_2", "NATION_3")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.when(F.col("n_name") == "NATION_3", 0.0).otherwise(0.3).alias("share"))
    x = c.withColumn("bal", F.greatest("c_acctbal", F.lit(0.0)))
    return facts.lookup_or(x, shares, "c_nationkey", {"share": 0.05, "bal": 1.0}).select("c_custkey", "share", "bal")


@query("j3_full_facts", f"WITH {FACTS} SELECT coalesce(w.state, a.state) AS state, coalesce(w.crop, a.crop) AS crop, coalesce(w.year, a.year) AS year, round(wi, 6) AS wi, round(area, 6) AS area "
       "FROM wi w FULL JOIN area a ON w.state = a.state AND w.crop = a.crop AND w.year = a.year")
def j3(spark, d):
    return facts.all_facts(*wi_area(spark, d)).select("state", "crop", "year", F.round("wi", 6).alias("wi"), F.round("area", 6).alias("area"))


@query("j4_matched_facts", f"WITH {FACTS} SELECT w.state, w.crop, w.year, round(wi * area, 4) AS volume FROM wi w JOIN area a ON w.state = a.state AND w.crop = a.crop AND w.year = a.year WHERE area <> 0")
def j4(spark, d):
    return facts.matched_facts(*wi_area(spark, d)).select("state", "crop", "year", F.round(F.col("wi") * F.col("area"), 4).alias("volume"))


@query("j5_member_flags", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') THEN 1 ELSE 0 END::INT AS is_urgent, "
       "CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) THEN 1 ELSE 0 END::INT AS is_large FROM customer")
def j5(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return facts.member_flags(table(spark, d, "customer").select("c_custkey"), "c_custkey",
                              {"is_urgent": o.where("o_orderpriority = '1-URGENT'"), "is_large": o.where("o_totalprice > 400000")})


_NUM = [*config.CLIMATE, *config.SOIL, *config.HUMAN]


@query("j8_ordered_pairs", f"WITH {WIDE}, c AS (SELECT * FROM wide WHERE crop_water_eff IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in _NUM)}) " + " UNION ALL ".join(
    f"SELECT '{a}' AS feat1, '{b}' AS feat2, round(corr({a}, {b}), 6) AS r FROM c" for i, a in enumerate(_NUM) for b in _NUM[i + 1:]))
def j8(spark, d):
    x = wide(spark, d).where("crop_water_eff IS NOT NULL")
    return profile.pair_correlations(x, _NUM).select("feat1", "feat2", F.round("r", 6).alias("r"))


@query("j9_scalar_threshold", "SELECT c_custkey, c_acctbal > (SELECT quantile_cont(c_acctbal, 0.7) FROM customer) AS above FROM customer")
def j9(spark, d):
    c = table(spark, d, "customer")
    row = ranks.quantile_row(c, {"q": ("c_acctbal", 0.7)})
    return ranks.with_scalars(c, row).select("c_custkey", (F.col("c_acctbal") > F.col("q")).alias("above"))


_SOIL = """mapunit AS (SELECT p_partkey AS mukey, p_size AS lkey, floor(p_retailprice) AS muacres, p_type FROM part),
legend AS (SELECT DISTINCT p_size AS lkey, CASE WHEN p_size <= 25 THEN 'CA' ELSE 'TX' END || CAST(p_size AS VARCHAR) AS areasymbol FROM part)"""


def _soil(spark, d):
    """Part stands for map units, sizes for survey legends, lines for soil components and horizons."""
    p = table(spark, d, "part")
    mapunit = p.select(F.col("p_partkey").alias("mukey"), F.col("p_size").alias("lkey"), F.floor("p_retailprice").cast("double").alias("muacres"))
    legend = p.select(F.col("p_size").alias("lkey")).distinct().withColumn(
        "areasymbol", F.concat(F.when(F.col("lkey") <= 25, "CA").otherwise("TX"), F.col("lkey").cast("string")))
    classes = {"ECONOMY": "1", "STANDARD": " 2E ", "MEDIUM": "3s", "LARGE": "4w", "SMALL": "6"}
    agg = p.select(F.col("p_partkey").alias("mukey"), X.from_map("p_type", classes).alias("iccdcd"))
    return mapunit, legend, agg


@query("a12_soil_classes", f"""WITH {_SOIL}, j AS (SELECT left(areasymbol, 2) AS state, CASE p_type WHEN 'ECONOMY' THEN '1' WHEN 'STANDARD' THEN '2e' WHEN 'MEDIUM' THEN '3s' WHEN 'LARGE' THEN '4w' WHEN 'SMALL' THEN '6' END AS lcc, muacres
FROM mapunit m JOIN legend l ON m.lkey = l.lkey), c AS (SELECT state, lcc, round(sum(muacres), 0) AS acres FROM j WHERE lcc IS NOT NULL GROUP BY 1, 2)
SELECT state, sum(acres) AS total_acres, round(sum(CASE WHEN lcc IN ('1', '2e', '3s') THEN acres ELSE 0 END) / sum(acres), 3) AS good_ratio, max(CASE WHEN lcc = '2e' THEN acres END) AS acres_2e FROM c GROUP BY 1""")
def a12(spark, d):
    return facts.soil_classes(*_soil(spark, d)).select("state", "total_acres", "good_ratio", F.col("by_class")["2e"].alias("acres_2e"))


_HORIZON = """SELECT left(areasymbol, 2) AS state, 'County ' || CAST(o_custkey % 50 AS VARCHAR) AS areaname, round(avg(l_tax), 4) AS awc_mean, round(avg(l_quantity), 4) AS sand_pct,
round(avg(l_discount), 4) AS clay_pct, count(*) AS n"""


def _horizons(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    ch = li.select(F.col("l_orderkey").alias("cokey"), (F.col("l_linenumber") * 20).cast("double").alias("hzdepb_r"), F.col("l_tax").alias("awc_r"),
                   F.col("l_quantity").alias("sandtotal_r"), F.col("l_discount").alias("claytotal_r"), F.col("l_tax").alias("om_r"))
    co = table(spark, d, "orders").select(F.col("o_orderkey").alias("cokey"), F.col("o_custkey").alias("mukey"))
    mu = table(spark, d, "customer").select(F.col("c_custkey").alias("mukey"), F.col("c_nationkey").alias("lkey"))
    n = table(spark, d, "nation")
    le = n.select(F.col("n_nationkey").alias("lkey"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("x")).alias("areasymbol"))
    la = n.select(F.col("n_nationkey").alias("lkey"), F.lit("County or Parish").alias("areatypename"), F.col("n_name").alias("areaname"))
    other = n.select(F.col("n_nationkey").alias("lkey"), F.lit("MLRA").alias("areatypename"), F.lit("x").alias("areaname"))
    return ch, co, mu, le, la.unionByName(other)


_FIVE = """FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_linenumber * 20 <= 100"""


@query("a11_soil_horizons", f"SELECT 'R' || CAST(n_regionkey AS VARCHAR) AS state, n_name AS areaname, round(round(sum(l_tax), 2) / count(*), 4) AS awc_mean, "
       f"round(avg(l_quantity), 4) AS sand_pct, round(round(sum(l_discount), 2) / count(*), 4) AS clay_pct {_FIVE} GROUP BY 1, 2")
def a11(spark, d):
    return facts.soil_horizons(*_horizons(spark, d)).select("state", "areaname", "awc_mean", "sand_pct", "clay_pct")


@query("j11_five_way", f"SELECT n_name AS areaname, count(*) AS n, sum(l_quantity) AS qty {_FIVE} GROUP BY 1")
def j11(spark, d):
    ch, co, mu, le, la = _horizons(spark, d)
    j = (ch.where("hzdepb_r <= 100").join(co, "cokey").join(mu, "mukey").join(le.where(F.col("areasymbol").like("R%")), "lkey")
         .join(la.where("areatypename = 'County or Parish'"), "lkey"))
    return j.groupBy("areaname").agg(F.count(F.lit(1)).alias("n"), F.sum("sandtotal_r").alias("qty"))


@query("j12_double_map", "SELECT vec_id, label, 'group ' || CAST(label AS VARCHAR) AS name FROM embeddings")
def j12(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster_id"))
    centres = e.select("cluster_id").distinct().withColumn("cluster_name", F.concat(F.lit("group "), F.col("cluster_id").cast("string")))
    out = e.select("id").join(e, "id", "left").join(centres, "cluster_id", "left")
    return out.select(F.col("id").alias("vec_id"), F.col("cluster_id").alias("label"), F.col("cluster_name").alias("name"))


@query("j12b_labelled_entities")
def j12b(spark, d):
    """Entities with the cluster of the fit and its name."""
    from rillwork.catalog.statistics import _centres, _clusters
    from rillwork.operators import models
    return models.label_entities(wide(spark, d).select("fips", "county"), _clusters(spark, d), _centres(spark, d), "fips")


@query("j13_crop_presence", f"WITH {LINES}, h AS (SELECT DISTINCT state FROM lines WHERE crop = 'ECONOMY') "
       "SELECT n_name AS state, CASE WHEN h.state IS NOT NULL THEN 1 ELSE 0 END::INT AS has_crop FROM nation LEFT JOIN h ON n_name = h.state")
def j13(spark, d):
    grown = line_sums(spark, d).select("state", "crop")
    return facts.presence(table(spark, d, "nation").select(F.col("n_name").alias("state")), grown, "ECONOMY")


@query("u1_union_years", f"WITH {LINES} SELECT state, crop, year, sum(l_quantity) AS qty FROM lines WHERE year IN (1996, 1998, 2000) GROUP BY 1, 2, 3")
def u1(spark, d):
    x = stage(line_sums(spark, d).select("state", "crop", "year", "qty"), "line-sums")  # one scan of the lines for the three parts
    parts = [x.where(F.col("year") == y) for y in (1996, 1998, 2000)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("state", "crop", "year").agg(F.sum("qty").alias("qty"))


@query("u2_key_union", f"WITH {FACTS} SELECT state, crop, year FROM wi UNION SELECT state, crop, year FROM area")
def u2(spark, d):
    wi, area = wi_area(spark, d)
    keys = ["state", "crop", "year"]
    return wi.select(*keys).union(area.select(*keys)).distinct()


@query("u3_dedupe", "SELECT DISTINCT o_custkey, o_orderpriority FROM orders")
def u3(spark, d):
    cols = list(dict.fromkeys(["o_custkey", "o_orderpriority", "o_custkey"]))
    return table(spark, d, "orders").select(*cols).dropDuplicates(cols)


@query("u4_set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def u4(spark, d):
    big = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, d, "customer").select("c_custkey").distinct().join(big, "c_custkey", "left_anti")
