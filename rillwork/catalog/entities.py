"""Entity measures, policy screens and what-if tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork import config
from rillwork.catalog.base import LINES, RANKED, WIDE, build_wide, lines, query, ranked, table, target_index, wide
from rillwork.functions import columns as X
from rillwork.operators import effects, facts, metrics, ranks, screens


@query("d1_poverty_rate", "SELECT o_custkey, round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::DOUBLE / greatest(count(*), 1) * 100, 2) AS poverty_rate FROM orders GROUP BY 1")
def d1(spark, d):
    agg = table(spark, d, "orders").groupBy("o_custkey").agg(
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0)).cast("double").alias("below"), F.count(F.lit(1)).alias("population"))
    return agg.select("o_custkey", metrics.poverty_rate("below", "population").alias("poverty_rate"))


_PRICES = {"ECONOMY": 6.54, "STANDARD": 14.2, "MEDIUM": 9.0, "LARGE": 398.4, "PROMO": 12.0, "SMALL": 200.0}  # six crops feed revenue, the first four the composite value
_PER_CROP = ", ".join(f"coalesce(sum(l_quantity) FILTER (p_type = '{t}'), 0) * {v!r}::DOUBLE AS v{i}" for i, (t, v) in enumerate(_PRICES.items()))
_ALL6, _SQ6 = " + ".join(f"v{i}" for i in range(6)), " + ".join(f"v{i} * v{i}" for i in range(6))


@query("d2_crop_structure", f"""WITH z AS (SELECT l_suppkey, {_PER_CROP} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_suppkey, round(({_SQ6}) / nullif(({_ALL6}) * ({_ALL6}), 0), 3) AS crop_diversity_hhi, round((v4 + v5) / nullif({_ALL6}, 0), 3) AS high_water_crop_share FROM z""")
def d2(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    prod = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey", F.col("p_type").alias("crop")).agg(F.sum("l_quantity").alias("production"))
    return metrics.crop_structure(prod, "l_suppkey", _PRICES, ["PROMO", "SMALL"])


@query("d3_estimated_water", f"WITH {WIDE} SELECT fips, round(irrigated_area_ac * eto_avg_in / 12, 0) AS water FROM wide")
def d3(spark, d):
    return wide(spark, d).select("fips", metrics.estimated_water("irrigated_area_ac", "eto_avg_in").alias("water"))


_FOUR = list(_PRICES.items())[:4]


@query("d4_composite_value", f"""WITH q AS (SELECT l_orderkey, {", ".join(f"sum(l_quantity) FILTER (p_type = '{t}') AS v{i}" for i, (t, _) in enumerate(_FOUR))} FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT l_orderkey, CASE WHEN {" OR ".join(f"v{i} IS NOT NULL" for i in range(4))} THEN round({" + ".join(f"coalesce(v{i}, 0) * {v!r}::DOUBLE" for i, (_, v) in enumerate(_FOUR))}, 0) END AS value FROM q""")
def d4(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    q = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(
        *[F.sum(F.when(F.col("p_type") == t, F.col("l_quantity"))).alias(t) for t, _ in _FOUR])
    return q.select("l_orderkey", metrics.composite_value(dict(_FOUR)).alias("value"))


@query("d5_target", f"WITH {WIDE} SELECT fips, round(composite_crop_value / nullif(est_water_af, 0), 2) AS crop_water_eff, round(ln(1 + greatest(round(composite_crop_value / nullif(est_water_af, 0), 2), 0)), 6) AS log_crop_water_eff FROM wide WHERE est_water_af IS NOT NULL")
def d5(spark, d):
    x = metrics.add_target(wide(spark, d).where("est_water_af IS NOT NULL").drop("crop_water_eff", "log_crop_water_eff"))
    return x.select("fips", "crop_water_eff", F.round("log_crop_water_eff", 6).alias("log_crop_water_eff"))


@query("d6_climate_balance", f"WITH {WIDE} SELECT fips, round(eto_avg_in - coalesce(precip_avg_in, 0), 6) AS precip_deficit_in, round((eto_avg_in - coalesce(precip_avg_in, 0)) / nullif(eto_avg_in, 0), 3) AS drought_intensity FROM wide")
def d6(spark, d):
    x = metrics.climate_balance(wide(spark, d), pr_null="zero")
    return x.select("fips", F.round("precip_deficit_in", 6).alias("precip_deficit_in"), "drought_intensity")


@query("d7_irrigation_dependency", f"WITH {WIDE} SELECT fips, round(irrigated_area_ac / nullif(irrigated_area_ac + avg_farm_size_ac * farm_count, 0), 3) AS dep FROM wide")
def d7(spark, d):
    return wide(spark, d).select("fips", metrics.irrigation_dependency("irrigated_area_ac", "avg_farm_size_ac", "farm_count").alias("dep"))


_GRP = "CASE WHEN p_type = 'ECONOMY' THEN 'FORAGE' WHEN p_type IN ('STANDARD', 'SMALL') THEN 'GRAIN' WHEN p_type = 'MEDIUM' THEN 'OIL' WHEN p_type = 'LARGE' THEN 'VEGETABLE' ELSE 'OTHER' END"


_COUNTY = f"""b AS (SELECT o_custkey, p_type, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
t AS (SELECT o_custkey, sum(v) AS total_area, sum(CASE WHEN p_type IN ('ECONOMY', 'STANDARD', 'SMALL', 'MEDIUM') THEN v ELSE 0 END) AS low_area FROM b GROUP BY 1),
c AS (SELECT o_custkey, p_type AS top_crop, {_GRP} AS grp FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY v DESC, p_type) AS rn FROM b) WHERE rn = 1),
s AS (SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 3 THEN NULL ELSE 0.5 + n_nationkey / 10.0 END::DOUBLE AS wi, CASE WHEN n_nationkey = 4 THEN NULL ELSE 0.002 END::DOUBLE AS dpg FROM nation)
SELECT lpad(CAST(c_custkey AS VARCHAR), greatest(5, length(CAST(c_custkey AS VARCHAR)))::INT, '0') AS fips, n_name AS state, total_area, top_crop, grp AS "group", round(total_area * coalesce(wi, 1.0), 0) AS est_water_af,
round(low_area * coalesce(wi, 1.0::DOUBLE) * 325851 * greatest(0, 0.015::DOUBLE - CASE grp WHEN 'GRAIN' THEN 0.0003::DOUBLE ELSE 0.0004::DOUBLE END) / 1e6, 1) AS opp_value_m, round(coalesce(dpg, 0.001) * 100, 3) AS st_dpg_cents
FROM t JOIN c ON c.o_custkey = t.o_custkey JOIN customer ON c_custkey = t.o_custkey JOIN s ON c_nationkey = n_nationkey"""
COUNTY = _COUNTY.replace('\nSELECT lpad(', ',\ncounty AS (SELECT lpad(') + ")"


@query("d13_county_rollup", f"WITH {COUNTY} SELECT * FROM county")
def d13(spark, d):
    from rillwork.catalog.base import GROUPS
    li, p, o, c, n = (table(spark, d, t) for t in ("lineitem", "part", "orders", "customer", "nation"))
    # merge before every join on a coarser key: an order or a customer with very many lines is small by then
    merged = li.join(p.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")) \
        .groupBy("l_orderkey", "p_type").agg(F.sum("l_quantity").alias("value"))
    per_customer = merged.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")) \
        .groupBy("o_custkey", "p_type").agg(F.sum("value").alias("value"), F.max("l_orderkey").alias("ord"))
    rec = (per_customer.join(c.select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
           .join(n.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")))
    rec = rec.select(X.zfill("c_custkey", 5).alias("fips"), F.col("p_type").alias("crop"), "value", F.col("n_name").alias("state"),
                     F.col("c_name").alias("county"), "ord")
    state = n.select(F.col("n_name").alias("state"), F.when(F.col("n_nationkey") != 3, 0.5 + F.col("n_nationkey") / 10.0).alias("avg_intensity"),
                     F.when(F.col("n_nationkey") != 4, 0.002).alias("avg_dpg"))
    out = metrics.county_rollup(rec, state, GROUPS)
    return out.select("fips", "state", "total_area", "top_crop", "group", "est_water_af", F.col("opp_value_M").alias("opp_value_m"), "st_dpg_cents")


@query("d15_intervention_gain", f"WITH {WIDE} SELECT fips, CASE WHEN crop_diversity_hhi > 0.2 THEN round((crop_diversity_hhi - 0.2::DOUBLE) / greatest(1.0::DOUBLE - 0.2::DOUBLE, 0.01::DOUBLE) * 32.8::DOUBLE, 1) END AS gain FROM wide")
def d15(spark, d):
    return wide(spark, d).select("fips", metrics.intervention_gain("crop_diversity_hhi", 0.2, -32.8).alias("gain"))


# -- screens ----------------------------------------------------------------------------------------------------------

_Q = lambda c, p: f"(SELECT quantile_cont({c}, {p}) FROM dm)"
LHF = f"""lhf AS (SELECT fips, county, state, round(crop_water_eff, 2) AS crop_water_eff, round(eff_percentile, 1) AS eff_percentile, round(coalesce(precip_deficit_in, 0), 1) AS precip_deficit_in,
round(coalesce(poverty_rate, 0), 1) AS poverty_rate, round(coalesce(avg_farm_size_ac, 0), 0) AS avg_farm_size_ac, 'Low-Hanging Fruit' AS insight FROM dm
WHERE precip_deficit_in < {_Q('precip_deficit_in', 0.6)} AND coalesce(awc_mean, {_Q('awc_mean', 0.5)}) > {_Q('awc_mean', 0.4)} AND eff_percentile < 40
AND (poverty_rate > {_Q('poverty_rate', 0.6)} OR avg_farm_size_ac > {_Q('avg_farm_size_ac', 0.7)}) ORDER BY dm.crop_water_eff, fips LIMIT 200)"""
VWE = f"""vwe AS (SELECT fips, county, state, round(crop_water_eff, 2) AS crop_water_eff, round(eff_percentile, 1) AS eff_percentile, round(coalesce(precip_deficit_in, 0), 1) AS precip_deficit_in, 'Virtual Water Exporter' AS insight
FROM dm WHERE precip_deficit_in > {_Q('precip_deficit_in', 0.7)} AND irrigated_area_ac > {_Q('irrigated_area_ac', 0.65)} AND eff_percentile < 45 ORDER BY dm.precip_deficit_in DESC, fips LIMIT 200)"""
DUAL = f"""du0 AS (SELECT *, irrigated_area_ac / nullif(precip_avg_in, 0) AS ii FROM dm),
du1 AS (SELECT * FROM du0 WHERE precip_deficit_in > (SELECT quantile_cont(precip_deficit_in, 0.65) FROM du0) AND ii > (SELECT quantile_cont(ii, 0.65) FROM du0) AND eff_percentile > 30),
du2 AS (SELECT *, (precip_deficit_in - min(precip_deficit_in) OVER ()) / (max(precip_deficit_in) OVER () - min(precip_deficit_in) OVER ()) + (ii - min(ii) OVER ()) / (max(ii) OVER () - min(ii) OVER ()) AS score FROM du1),
dual AS (SELECT fips, county, state, round(crop_water_eff, 2) AS crop_water_eff, round(eff_percentile, 1) AS eff_percentile, round(coalesce(precip_deficit_in, 0), 1) AS precip_deficit_in, round(coalesce(irrigated_area_ac, 0), 0) AS irrigated_area_ac,
round(coalesce(ii, 0), 2) AS irr_intensity, 'Dual Exposure' AS insight FROM du2 ORDER BY round(score, 9) DESC, fips LIMIT 200)"""
DM = RANKED + ", dm AS (SELECT * FROM ranked WHERE crop_water_eff IS NOT NULL)"


def cuts(spark, d):
    return screens.thresholds(ranked(spark, d), index=target_index(spark, d))


@query("p1_low_hanging_fruit", f"WITH {DM}, {LHF} SELECT * FROM lhf")
def p1(spark, d):
    return screens.low_hanging_fruit(ranked(spark, d), cuts=cuts(spark, d))


@query("p2_virtual_water_exporters", f"WITH {DM}, {VWE} SELECT * FROM vwe")
def p2(spark, d):
    return screens.virtual_water_exporters(ranked(spark, d), cuts=cuts(spark, d))


@query("p3_dual_exposure", f"WITH {DM}, {DUAL} SELECT * FROM dual")
def p3(spark, d):
    return screens.dual_exposure(ranked(spark, d), cuts=cuts(spark, d))


FLAGS = """flags AS (SELECT r.*, CASE WHEN r.fips IN (SELECT fips FROM lhf) THEN 1 ELSE 0 END::INT AS is_lhf, CASE WHEN r.fips IN (SELECT fips FROM vwe) THEN 1 ELSE 0 END::INT AS is_vwe,
CASE WHEN r.fips IN (SELECT fips FROM dual) THEN 1 ELSE 0 END::INT AS is_dual FROM ranked r)"""


def flagged(spark, d):
    x, q = ranked(spark, d), cuts(spark, d)
    return screens.flagged(x, "fips", screens.low_hanging_fruit(x, cuts=q), screens.virtual_water_exporters(x, cuts=q), screens.dual_exposure(x, cuts=q))


@query("p4_flags", f"WITH {DM}, {LHF}, {VWE}, {DUAL}, {FLAGS} SELECT fips, is_lhf, is_vwe, is_dual FROM flags")
def p4(spark, d):
    return flagged(spark, d).select("fips", "is_lhf", "is_vwe", "is_dual")


@query("p5_screen_rows", f"WITH {RANKED} SELECT fips, county, state, round(coalesce(crop_water_eff, 0), 2) AS crop_water_eff, round(coalesce(eff_percentile, 0), 1) AS eff_percentile, round(coalesce(poverty_rate, 0), 1) AS poverty, 'All' AS insight FROM ranked")
def p5(spark, d):
    return screens.screen_rows(ranked(spark, d), {"poverty": ("poverty_rate", 1)}, "All")


@query("t10_policy_top", f"WITH {DM}, {LHF}, {VWE}, {DUAL} SELECT insight, count(*) AS n, min(fips) AS first_fips FROM (SELECT insight, fips FROM lhf UNION ALL SELECT insight, fips FROM vwe UNION ALL SELECT insight, fips FROM dual) GROUP BY 1")
def t10(spark, d):
    x, q = ranked(spark, d), cuts(spark, d)
    every = [s(x, cuts=q).select("insight", "fips") for s in (screens.low_hanging_fruit, screens.virtual_water_exporters, screens.dual_exposure)]
    return every[0].unionByName(every[1]).unionByName(every[2]).groupBy("insight").agg(F.count(F.lit(1)).alias("n"), F.min("fips").alias("first_fips"))


# -- what-if ------------------------------------------------------------------------------------------------------------

_LEVERS = ["centerpivot_ratio", "avg_farm_size_ac", "crop_diversity_hhi"]
_EFFECTS = [("centerpivot_ratio", 0.33, 0.3838, 46.8), ("avg_farm_size_ac", 250000.0, -0.4027, -33.2), ("crop_diversity_hhi", 0.2, -0.3981, -32.8)]
_D = {c: f"(CASE WHEN n_{c} IS NULL OR {c} IS NULL OR ({c} > {t}) = (n_{c} > {t}) THEN 0 WHEN {c} > {t} THEN {-a} ELSE {a} END)::DOUBLE" for c, t, a, _ in _EFFECTS}


@query("m17_simulate", f"""WITH {WIDE}, sc AS (SELECT unnest([0.5, 1.0, 1.5])::DOUBLE AS m), x AS (SELECT CAST(m * 2 AS BIGINT) AS scenario_id, w.*, coalesce(crop_water_eff, 0) AS cur,
round(centerpivot_ratio * m, 6) AS n_centerpivot_ratio, CASE WHEN m <> 1.0 THEN round(avg_farm_size_ac * m, 6) END AS n_avg_farm_size_ac, round(crop_diversity_hhi * m, 6) AS n_crop_diversity_hhi FROM wide w, sc),
y AS (SELECT *, {_D['centerpivot_ratio']} + {_D['avg_farm_size_ac']} + {_D['crop_diversity_hhi']} AS dl FROM x)
SELECT scenario_id, fips, round(cur, 2) AS current_efficiency, round(exp(ln(1 + greatest(cur, 0)) + dl) - 1, 2) AS simulated_efficiency, round((exp(ln(1 + greatest(cur, 0)) + dl) - 1 - cur) / greatest(cur, 1) * 100, 1) AS delta_pct,
((n_centerpivot_ratio IS NOT NULL AND centerpivot_ratio IS NOT NULL)::INT + (n_avg_farm_size_ac IS NOT NULL AND avg_farm_size_ac IS NOT NULL)::INT + (n_crop_diversity_hhi IS NOT NULL AND crop_diversity_hhi IS NOT NULL)::INT)::INT AS n_changes FROM y""")
def m17(spark, d):
    w = wide(spark, d)
    fx = spark.createDataFrame(_EFFECTS, "treatment_col string, threshold double, ate double, ate_pct_change double")
    grid = w.select("fips", *_LEVERS, F.explode(F.array(F.lit(0.5), F.lit(1.0), F.lit(1.5))).alias("m"))
    sc = grid.select((F.col("m") * 2).cast("long").alias("scenario_id"), "fips", F.round(F.col("centerpivot_ratio") * F.col("m"), 6).alias("centerpivot_ratio"),
                     F.when(F.col("m") != 1.0, F.round(F.col("avg_farm_size_ac") * F.col("m"), 6)).alias("avg_farm_size_ac"),
                     F.round(F.col("crop_diversity_hhi") * F.col("m"), 6).alias("crop_diversity_hhi"))
    out = effects.simulate(sc, fx, w, _LEVERS)
    return out.select("scenario_id", "fips", "current_efficiency", "simulated_efficiency", "delta_pct", F.size("changes").alias("n_changes"))
