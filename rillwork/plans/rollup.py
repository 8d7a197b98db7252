"""State x crop x year roll-up: records to facts, state summary, trends, normalised measures, county branch."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rillwork import config
from rillwork.operators import facts, metrics, ranks

NORMS = {"avg_intensity": "norm", "avg_dpg_cents": "norm_dpg", "trend_pct": "norm_trend", "opp_value_M": "norm_opp",
         "virtual_water_B": "norm_vw", "hhi": "norm_hhi", "precip_trend_yr": "norm_precip", "vuln_score": "norm_vuln",
         "ag_per_af": "norm_eff", "intensity_2013": "norm_2013", "intensity_2018": "norm_2018", "intensity_2023": "norm_2023"}
REVERSED = ["trend_pct", "precip_trend_yr"]


def crop_table(water: DataFrame, areas: Sequence[DataFrame], prices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Raw records to (crop table, intensity facts, area facts)."""
    wi = facts.record_measure(water, "wi")
    area = facts.record_measure(reduce(DataFrame.unionByName, areas), "area")
    crops = facts.crop_value(facts.best_year(facts.all_facts(wi, area)), facts.price_means(prices))
    return crops, wi, area


def state_table(crops: DataFrame, wi: DataFrame, area: DataFrame, soil: DataFrame | None = None,
                precip: DataFrame | None = None, wells: DataFrame | None = None, sales: DataFrame | None = None,
                years: Sequence[int] = config.CENSUS_YEARS) -> DataFrame:
    """One row per state with every summary measure. Optional sources: soil (state, good_ratio, total_acres),
    precip and wells (state, year, value), sales (state, year, value)."""
    by_year = facts.weighted_intensity(wi, area)
    spark = crops.sparkSession
    series = spark.createDataFrame([], "state string, year int, value double")
    trend = facts.series_trend(precip if precip is not None else series, "state", "year", "value", years) \
        .select("state", F.col("trend").alias("precip_trend_yr"), F.col("mean").alias("avg_precip_in"),
                F.col("last").alias("precip_last"), *[F.col(f"at_{y}").alias(f"precip_{y}") for y in years])
    depth = facts.late_minus_early(wells if wells is not None else series, "state", "year", "value", out="gw_trend_ft")
    sold = (sales if sales is not None else series).groupBy("state").agg(
        *[F.max(F.when(F.col("year") == y, F.col("value"))).alias(f"_s{y}") for y in (2022, 2017)])
    out = facts.chain_left(metrics.state_measures(crops, soil), [facts.survey_table(by_year, "state", "intensity", years), trend, depth, sold], "state")
    if soil is not None:
        out = out.join(soil.select("state", F.col("total_acres").alias("soil_total_acres")), "state", "left")
    out = metrics.sales_per_water(out, "_s2022", "_s2017").drop("_s2022", "_s2017")
    return out.withColumn("vuln_score", metrics.vulnerability())


def normalized(states: DataFrame, norms: Mapping[str, str] = NORMS, years: Sequence[int] = config.CENSUS_YEARS) -> DataFrame:
    """Every measure on a robust 0-1 scale; the survey years share one scale."""
    return ranks.robust_norm(states, norms, reverse=REVERSED, shared=[[f"intensity_{y}" for y in years]])


def county_table(records: DataFrame, states: DataFrame) -> DataFrame:
    """County roll-up with robust 0-1 scales over the positive values."""
    rolled = metrics.county_rollup(records, states)
    return ranks.robust_norm(rolled, {"est_water_af": "norm_water", "opp_value_M": "norm_opp", "total_area": "norm_area"},
                             positive_only=True)
