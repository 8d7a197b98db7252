"""Domain measures: column programs over entity and state frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rillwork import config
from rillwork.functions import columns as X
from rillwork.operators import facts


def poverty_rate(below, population) -> Column:
    """Percent below the line; null without a population."""
    p = F.col(population) if isinstance(population, str) else population
    b = F.col(below) if isinstance(below, str) else below
    return F.when(p != 0, F.round(b / F.greatest(p, F.lit(1)) * 100, 2))


def crop_structure(production: DataFrame, key: str, prices: Mapping[str, float] = config.REVENUE_PRICES,
                   thirsty: Sequence[str] = config.HIGH_WATER_CROPS) -> DataFrame:
    """Revenue concentration and the revenue share of thirsty crops from (key, crop, production)."""
    rev = production.withColumn("rev", F.coalesce("production", F.lit(0.0)) * X.from_map("crop", dict(prices)))
    agg = rev.groupBy(key).agg(F.sum("rev").alias("s"), F.sum(F.col("rev") * F.col("rev")).alias("s2"),
                               F.sum(F.when(F.col("crop").isin(list(thirsty)), F.col("rev"))).alias("hw"))
    share = X.clip(X.ratio(F.coalesce("hw", F.lit(0.0)), "s"), 0.0, 1.0)
    return agg.select(key, F.round(X.ratio("s2", F.col("s") * F.col("s")), 3).alias("crop_diversity_hhi"),
                      F.round(share, 3).alias("high_water_crop_share"))


def estimated_water(area_ac, eto_in) -> Column:
    """Irrigated acres times evapotranspiration, in acre-feet."""
    return F.round(F.col(area_ac) * F.col(eto_in) / 12, 0)


def composite_value(cols: Mapping[str, float]) -> Column:
    """Price-weighted production; null when no crop is known."""
    known, total = F.lit(False), F.lit(0.0)
    for c, price in cols.items():
        known = known | F.col(c).isNotNull()
        total = total + F.coalesce(F.col(c), F.lit(0.0)) * price
    return F.when(known, F.round(total, 0))


def add_target(df: DataFrame, value: str = "composite_crop_value", water: str = "est_water_af") -> DataFrame:
    """Value per unit of water and its log."""
    df = df.withColumn(config.TARGET, F.round(X.ratio(value, water), 2))
    return df.withColumn(config.LOG_TARGET, X.log1p_floor(config.TARGET))


def climate_balance(df: DataFrame, eto: str = "eto_avg_in", pr: str = "precip_avg_in", pr_null: str = "null") -> DataFrame:
    """Deficit and drought intensity; pr_null='zero' counts a missing precipitation as none."""
    rain = F.coalesce(F.col(pr), F.lit(0.0)) if pr_null == "zero" else F.col(pr)
    df = df.withColumn("precip_deficit_in", F.col(eto) - rain)
    return df.withColumn("drought_intensity", F.round(X.ratio("precip_deficit_in", eto), 3))


def irrigation_dependency(irrigated: str, farm_size: str, farms: str) -> Column:
    """Irrigated share of irrigated plus farmed land."""
    return F.round(X.ratio(irrigated, F.col(irrigated) + F.col(farm_size) * F.col(farms)), 3)


def value_per_water(revenue, intensity) -> tuple[Column, Column, Column]:
    """Dollars per gallon, cents per gallon, break-even price per acre-foot."""
    rev, wi = X.filled(revenue), F.when(F.col(intensity) > 0, F.col(intensity))
    dpg = rev / (wi * config.GALLONS_PER_ACRE_FOOT)
    return F.round(dpg, 6), F.round(dpg * 100, 4), F.round(rev / wi, 1)


def opportunity_sums(low_groups: Sequence[str] = config.LOW_VALUE_GROUPS, exclude: Sequence[str] = config.AGGREGATE_CROPS,
                     min_acres: float = config.MIN_LOW_VALUE_ACRES, target_dpg: float = config.TARGET_DPG) -> dict[str, Column]:
    """Gain from moving low-value water to the target value, and the crop that uses most of it."""
    low = F.col("group").isin(list(low_groups)) & ~F.col("crop").isin(list(exclude)) & (F.col("area") >= min_acres)
    wi, dpg = F.coalesce("wi", F.lit(0.0)), F.coalesce("dpg", F.lit(0.0))
    gain = F.sum(F.when(low & (wi > 0) & (dpg < target_dpg),
                        F.col("area") * wi * config.GALLONS_PER_ACRE_FOOT * (target_dpg - dpg)))
    order = F.struct((-(F.col("area") * wi)).alias("m"), F.col("crop"))  # an unknown intensity counts as none
    return {"gain": gain, "opp_crop": F.min_by(F.when(low, F.col("crop")), F.when(low, order))}


def opportunity_columns(cap_m: float = config.MARKET_CAP_M) -> list[Column]:
    """Soil-adjusted, capped gain in millions; reads ``gain`` and ``good_ratio``."""
    rate = F.round(config.CONVERSION_BASE + config.CONVERSION_SLOPE
                   * F.coalesce("good_ratio", F.lit(config.DEFAULT_GOOD_RATIO)), 3)
    total = F.col("gain") * rate * config.TRANSITION_YIELD
    return [F.when(total > 0, F.round(F.least(total / 1e6, F.lit(cap_m)), 1)).alias("opp_value_M"), F.col("opp_crop")]


def with_soil(states: DataFrame, soil: DataFrame | None) -> DataFrame:
    if soil is None:
        return states.withColumn("good_ratio", F.lit(None).cast("double"))
    return states.join(soil.select("state", "good_ratio"), "state", "left")


def opportunity(crops: DataFrame, soil: DataFrame | None = None, cap_m: float = config.MARKET_CAP_M, **limits) -> DataFrame:
    """Reallocation value per state with its main crop."""
    agg = crops.groupBy("state").agg(*[e.alias(k) for k, e in opportunity_sums(**limits).items()])
    return with_soil(agg, soil).select("state", *opportunity_columns(cap_m))


def virtual_water_sum(hay: Sequence[str] = config.HAY_CROPS) -> Column:
    use = F.col("crop").isin(list(hay)) & (F.col("area") > 0) & (F.col("wi") > 0)
    return F.sum(F.when(use, F.col("area") * F.col("wi") * config.GALLONS_PER_ACRE_FOOT))


def virtual_water_column(shares: Mapping[str, float] = config.EXPORT_SHARES, default: float = config.EXPORT_SHARE_DEFAULT) -> Column:
    total = F.col("vol") * X.from_map("state", dict(shares), default) / 1e9
    return F.when(total > 0, F.round(total, 3)).alias("virtual_water_B")


def virtual_water(crops: DataFrame, shares: Mapping[str, float] = config.EXPORT_SHARES,
                  hay: Sequence[str] = config.HAY_CROPS, default: float = config.EXPORT_SHARE_DEFAULT) -> DataFrame:
    """Exported forage water per state in billion gallons; null when there is none."""
    agg = crops.groupBy("state").agg(virtual_water_sum(hay).alias("vol"))
    return agg.select("state", virtual_water_column(shares, default))


def state_measures(crops: DataFrame, soil: DataFrame | None = None, shares: Mapping[str, float] = config.EXPORT_SHARES,
                   hay: Sequence[str] = config.HAY_CROPS, be_digits: int = 1) -> DataFrame:
    """All crop-table measures of a state in one grouping: summary, concentration, reallocation, virtual water, top crop."""
    water = F.col("area") * F.col("wi")
    sums = {**facts.summary_sums(), **facts.concentration_sums(water), **opportunity_sums(), "vol": virtual_water_sum(hay),
            "top1_crop": facts.largest(F.coalesce(water, F.lit(0.0)))}
    agg = with_soil(crops.groupBy("state").agg(*[e.alias(k) for k, e in sums.items()]), soil)
    return agg.select("state", *facts.summary_columns(be_digits), facts.concentration_column(), *opportunity_columns(),
                      virtual_water_column(shares), "top1_crop", F.col("good_ratio").alias("soil_good_ratio"))


def sales_per_water(df: DataFrame, sales_2022: str, sales_2017: str) -> DataFrame:
    """Sales in millions (first year, else second) and dollars per acre-foot."""
    m = F.coalesce(X.filled(F.round(F.col(sales_2022) / 1e6, 1)), X.filled(F.round(F.col(sales_2017) / 1e6, 1)))
    water = F.when((F.col("total_irr_area") > 0) & (F.col("avg_intensity") > 0),
                   F.col("total_irr_area") * F.col("avg_intensity"))
    return df.withColumn("ag_sales_M", m).withColumn("ag_per_af", F.round(m * 1e6 / water, 1))


def vulnerability(intensity="avg_intensity", dpg_cents="avg_dpg_cents", precip_trend="precip_trend_yr",
                  gw_trend="gw_trend_ft", trend_pct="trend_pct") -> Column:
    """Intensity times the drying multipliers, divided by value per gallon where that is known."""
    one = F.lit(1.0)
    precip = F.when(F.col(precip_trend) < 0, 1.0 + F.abs(F.col(precip_trend)) * 0.5).otherwise(one)
    wells = F.when(F.col(gw_trend) > 0, 1.0 + F.col(gw_trend) * 0.10).otherwise(one)
    use = F.when(F.col(trend_pct) > 0, 1.0 + F.col(trend_pct) / 10 * 0.15).otherwise(one)
    raw = F.col(intensity) * (precip * wells * use)
    return F.round(F.when((F.col(intensity) > 0) & (F.col(dpg_cents) > 0), raw / F.col(dpg_cents))
                   .when(F.col(intensity) > 0, raw), 4)


def county_rollup(records: DataFrame, state: DataFrame, groups: Mapping[str, Sequence[str]] = config.CROP_GROUPS,
                  low_dpg: Mapping[str, float] = config.LOW_VALUE_DPG, target_dpg: float = config.TARGET_DPG) -> DataFrame:
    """Entity roll-up from (fips, crop, value, state, county, ord): dominant crop, water, reallocation value.

    Values are first merged per (entity, crop), so the wide grouping sees a handful of rows per entity.
    """
    by_crop = records.where(F.col("value") > 0).groupBy("fips", "crop").agg(
        F.sum("value").alias("v"), F.max(F.struct("ord", "state", "county")).alias("last"))
    by_crop = by_crop.withColumn("_g", X.keyword_group("crop", groups))
    low = F.col("_g").isin(list(low_dpg))
    agg = by_crop.groupBy("fips").agg(
        F.sum("v").alias("total_area"), F.sum(F.when(low, F.col("v"))).alias("low_area"),
        F.min_by("crop", F.struct((-F.col("v")).alias("m"), F.col("crop"))).alias("top_crop"), F.max("last").alias("last"))
    agg = agg.select("fips", "total_area", "low_area", "top_crop", "last.state", "last.county") \
             .withColumn("group", X.keyword_group("top_crop", groups))
    agg = facts.lookup_or(agg, state.select("state", F.col("avg_intensity").alias("st_wi"), F.col("avg_dpg").alias("st_dpg")),
                          "state", {"st_wi": 1.0, "st_dpg": 0.001})
    margin = F.greatest(F.lit(0.0), target_dpg - X.from_map("group", dict(low_dpg), 0.0004))
    gallons = F.coalesce("low_area", F.lit(0.0)) * F.col("st_wi") * config.GALLONS_PER_ACRE_FOOT
    return agg.select("fips", "state", "county", "total_area", "top_crop", "group",
                      F.round(F.col("total_area") * F.col("st_wi"), 0).alias("est_water_af"),
                      F.round(gallons * margin / 1e6, 1).alias("opp_value_M"), "st_wi",
                      F.round(F.col("st_dpg") * 100, 3).alias("st_dpg_cents"))


def drought_classes(cols: Sequence[str] = ("D0", "D1", "D2", "D3", "D4")) -> dict[str, Column]:
    """Class shares with blanks as zero, and the two cumulative shares."""
    v = {c.lower(): F.round(F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)), 1) for c in cols}
    v["drought_pct"] = F.round(v["d1"] + v["d2"] + v["d3"] + v["d4"], 1)
    v["severe_pct"] = F.round(v["d2"] + v["d3"] + v["d4"], 1)
    return v


def intervention_gain(hhi, threshold, effect) -> Column:
    """Gain in percent for entities above the threshold, growing with the distance from it."""
    c = lambda x: F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)
    h, t, e = c(hhi), c(threshold), c(effect)
    return F.when(h > t, F.round((h - t) / F.greatest(1.0 - t, F.lit(0.01)) * F.abs(e), 1))
