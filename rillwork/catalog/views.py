"""Serving queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork import config
from rillwork.catalog.base import CROPS, RANKED, SERIES, SURVEYS, WIDE, crops, fact_table, query, ranked, table, wide
from rillwork.catalog.entities import _EFFECTS, DM, DUAL, FLAGS, LHF, VWE, cuts, flagged
from rillwork.catalog.rollups import STATES, _A5, _YR, _YV, _shared_sql, states
from rillwork.operators import facts, models, ranks, screens
from rillwork.plans import serve


@query("e1_profile", f"WITH {RANKED} SELECT fips, county, crop_water_eff, eff_percentile AS percentile, eto_avg_in, precip_deficit_in, crop_diversity_hhi, tenant_ratio FROM ranked")
def e1(spark, d):
    p = serve.profile(ranked(spark, d))
    return p.select("fips", "county", "crop_water_eff", "percentile", "climate.eto_avg_in", "climate.precip_deficit_in", "human_factors.crop_diversity_hhi", "human_factors.tenant_ratio")


@query("e1b_profile_with_attribution")
def e1b(spark, d):
    from rillwork.catalog.statistics import _shap
    shap = _shap(spark, d)[2]
    return serve.profile(ranked(spark, d), shap)


@query("e2_map_rows", f"WITH {RANKED} SELECT fips, county, state, crop_water_eff, eff_percentile AS percentile, irrigated_area_ac FROM ranked WHERE crop_water_eff IS NOT NULL")
def e2(spark, d):
    return serve.map_rows(ranked(spark, d))


@query("e3_opportunities", f"WITH {DM}, {LHF} SELECT * FROM lhf WHERE upper(state) = 'NATION_3' ORDER BY crop_water_eff, fips LIMIT 20")
def e3(spark, d):
    kinds = {"low_hanging_fruit": screens.low_hanging_fruit(ranked(spark, d), cuts=cuts(spark, d))}
    return serve.opportunities(kinds, state="nation_3", order=[F.col("crop_water_eff"), F.col("fips")])


@query("e4_full_map", f"WITH {DM}, {LHF}, {VWE}, {DUAL}, {FLAGS} SELECT fips, county, state, crop_water_eff, eff_percentile AS percentile, is_lhf, is_vwe, is_dual, eto_avg_in, crop_diversity_hhi, "
       "CASE WHEN crop_diversity_hhi > 0.2 THEN round((crop_diversity_hhi - 0.2::DOUBLE) / greatest(1.0::DOUBLE - 0.2::DOUBLE, 0.01::DOUBLE) * 32.8::DOUBLE, 1) END AS intervention_gain_pct FROM flags WHERE crop_water_eff IS NOT NULL")
def e4(spark, d):
    fx = spark.createDataFrame(_EFFECTS, "treatment_col string, threshold double, ate double, ate_pct_change double")
    return serve.full_map(flagged(spark, d), fx, extra=["is_lhf", "is_vwe", "is_dual", "eto_avg_in"])


@query("e4b_map_with_clusters")
def e4b(spark, d):
    from rillwork.catalog.statistics import _centres, _clusters
    fx = spark.createDataFrame(_EFFECTS, "treatment_col string, threshold double, ate double, ate_pct_change double")
    named = models.label_entities(flagged(spark, d), _clusters(spark, d), _centres(spark, d), "fips")
    return serve.full_map(named, fx, extra=["is_lhf", "is_vwe", "is_dual", "cluster_id", "cluster_name", "eto_avg_in"])


@query("e5b_entity_cluster")
def e5b(spark, d):
    from rillwork.catalog.statistics import _centres, _clusters
    one = serve.cluster_of(_clusters(spark, d), "7")
    return one.join(_centres(spark, d).select("cluster_id", "cluster_name", "n_entities"), "cluster_id").select("fips", "cluster_id", "cluster_name", "n_entities")


@query("e6b_full_summary")
def e6b(spark, d):
    """Target, importance shares, effects, strongest variables and fit of the national summary."""
    from rillwork.catalog.statistics import ROLES, _forest, m5, m12, m16b
    x, kept, model = _forest(spark, d)
    importances = models.importance_rows(x, model, kept, ROLES)
    w = wide(spark, d)
    return serve.metric_rows({
        "target": (w.agg(F.count("crop_water_eff").alias("n"), F.avg("crop_water_eff").alias("mean"), F.max("crop_water_eff").alias("best")), ""),
        "shares": (models.role_shares(importances), "role"), "top_variables": (importances.limit(5).select("feature", "importance"), "feature"),
        "effects": (m12(spark, d).select("treatment_col", "ate", "ate_pct_change"), "treatment_col"),
        "fit": (m5(spark, d).agg(F.max("cv_r2").alias("lasso_cv_r2")), ""), "clusters": (m16b(spark, d).select("cluster_name", "n_entities"), "cluster_name")})


@query("e5_cluster_summary", f"WITH {WIDE} SELECT count(DISTINCT CASE WHEN crop_diversity_hhi > 0.25 THEN 2 WHEN crop_diversity_hhi > 0.2 THEN 1 ELSE 0 END) AS n_clusters, count(*) AS n_entities FROM wide WHERE log_crop_water_eff IS NOT NULL")
def e5(spark, d):
    x = wide(spark, d).where("log_crop_water_eff IS NOT NULL").withColumn(
        "cluster_id", F.when(F.col("crop_diversity_hhi") > 0.25, 2).when(F.col("crop_diversity_hhi") > 0.2, 1).otherwise(0))
    return serve.cluster_summary(models.centre_rows(x, ["eto_avg_in"]))


@query("e6_summary", f"""WITH {WIDE} SELECT 'target' AS section, 'n' AS metric, count(crop_water_eff)::DOUBLE AS value FROM wide UNION ALL SELECT 'target', 'best', max(crop_water_eff) FROM wide UNION ALL
SELECT 'states', state || '.n', count(*)::DOUBLE FROM wide GROUP BY state""")
def e6(spark, d):
    x = wide(spark, d)
    return serve.metric_rows({"target": (x.agg(F.count("crop_water_eff").alias("n"), F.max("crop_water_eff").alias("best")), ""),
                              "states": (x.groupBy("state").agg(F.count(F.lit(1)).alias("n")), "state")})


@query("e7_state_years", f"{_A5}, yy AS (SELECT * FROM by_year WHERE year IN (1996, 1998, 2000) AND intensity IS NOT NULL) SELECT state, year, round(intensity, 6) AS intensity, round((intensity - lag(intensity) OVER w) / nullif(lag(intensity) OVER w, 0) * 100, 1) AS change_pct FROM yy WINDOW w AS (PARTITION BY state ORDER BY year)")
def e7(spark, d):
    return serve.state_years(facts.joint_intensity(fact_table(spark, d)), SURVEYS).withColumn("intensity", F.round("intensity", 6))


@query("e7b_state_crops", f"""WITH {CROPS}, r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY coalesce(area * wi, 0) DESC, crop)::INT AS rank FROM crops), k AS (SELECT * FROM r WHERE rank <= 8)
SELECT state, rank, crop, round(coalesce(wi, 0) / greatest(max(coalesce(wi, 0)) OVER (PARTITION BY state), 0.001), 4) AS bar FROM k""")
def e7b(spark, d):
    return serve.state_crops(crops(spark, d))


@query("e7c_state_bands", f"{STATES} SELECT state, CASE WHEN vuln_score > 2 THEN 'extreme' WHEN vuln_score > 1 THEN 'high' WHEN vuln_score > 0.5 THEN 'medium' WHEN vuln_score IS NOT NULL THEN 'low' END AS vuln_band, "
       "CASE WHEN hhi > 0.5 THEN 'concentrated' WHEN hhi > 0.25 THEN 'mixed' WHEN hhi IS NOT NULL THEN 'diverse' END AS hhi_band, CASE WHEN soil_good_ratio > 0.6 THEN 'good' WHEN soil_good_ratio > 0.35 THEN 'fair' WHEN soil_good_ratio IS NOT NULL THEN 'poor' END AS soil_band FROM states")
def e7c(spark, d):
    return serve.state_bands(states(spark, d))


@query("e7d_first_last_change", f"WITH {SERIES}, e AS (SELECT state, max(value) FILTER (year = 1995) AS a, max(value) FILTER (year = 2000) AS b FROM yearly GROUP BY 1) "
       "SELECT state, round(a, 4) AS first_value, round(b, 4) AS last_value, round((b - a) / nullif(a, 0) * 100, 1) AS change_pct FROM e")
def e7d(spark, d):
    from rillwork.catalog.base import yearly
    x = serve.first_last_change(yearly(spark, d), "state", "year", "value", 1995, 2000)
    return x.select("state", F.round("first_value", 4).alias("first_value"), F.round("last_value", 4).alias("last_value"), "change_pct")


@query("e7e_crop_metrics", f"WITH {CROPS} SELECT state, round(wi, 4) AS wi, round(area, 2) AS area, rev_per_acre, dpg_cents, breakeven, round(area * wi / nullif(sum(area * wi) OVER (PARTITION BY state), 0) * 100, 1) AS water_share_pct FROM crops QUALIFY crop = 'STANDARD'")
def e7e(spark, d):
    x = serve.crop_metrics(crops(spark, d), "STANDARD")
    return x.select("state", F.round("wi", 4).alias("wi"), F.round("area", 2).alias("area"), "rev_per_acre", "dpg_cents", "breakeven", "water_share_pct")


@query("e8_year_view", f"{STATES}, {_YV}, n AS (SELECT state, intensity_1996, intensity_1998, intensity_2000, {', '.join(_shared_sql(c) for c in _YR)} FROM states) " + " UNION ALL ".join(
    f"SELECT state, {y}::INT AS year, intensity_{y} AS value, norm_{y} AS norm FROM n" for y in SURVEYS))
def e8(spark, d):
    n = ranks.robust_norm(states(spark, d), {c: c.replace("intensity", "norm") for c in _YR}, shared=[_YR])
    return serve.year_view(n, SURVEYS)
