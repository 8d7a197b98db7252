"""Serving queries as frames over the persisted tables: profiles, map rows, lists, summaries, state views."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rillwork import config
from rillwork.functions import columns as X
from rillwork.operators import facts, metrics, ranks

CLIMATE_VIEW = ["eto_avg_in", "precip_avg_in", "precip_deficit_in", "elevation_ft"]
HUMAN_VIEW = ["centerpivot_ratio", "avg_farm_size_ac", "tenant_ratio", "crop_diversity_hhi"]


def profile(wide: DataFrame, shap: DataFrame | None = None, key: str | None = None,
            climate: Sequence[str] = CLIMATE_VIEW, human: Sequence[str] = HUMAN_VIEW) -> DataFrame:
    """Entity profiles with nested climate and human parts and, when given, the attributions."""
    df = wide if key is None else wide.where(F.col("fips") == X.zfill(F.lit(key), 5))
    out = df.select("fips", "county", "state", config.TARGET, config.LOG_TARGET, F.col("eff_percentile").alias("percentile"),
                    "irrigated_area_ac", "est_water_af", "composite_crop_value",
                    F.struct(*climate).alias("climate"), F.struct(*human).alias("human_factors"))
    if shap is None:
        return out
    packed = shap.groupBy("fips").agg(F.map_from_entries(F.collect_list(F.struct("feature", "shap"))).alias("shap_attribution"))
    return out.join(packed, "fips", "left")


def map_rows(wide: DataFrame) -> DataFrame:
    """Rows with a target, six columns."""
    return wide.where(F.col(config.TARGET).isNotNull()).select(
        "fips", "county", "state", config.TARGET, F.col("eff_percentile").alias("percentile"), "irrigated_area_ac")


def opportunities(screens: Mapping[str, DataFrame], kind: str = "low_hanging_fruit", state: str | None = None,
                  top: int = 20, order: Sequence[Column] = ()) -> DataFrame:
    """Rows of one screen, optionally of one state (any case), first ``top``."""
    rows = screens[kind]
    if state is not None:
        rows = rows.where(F.upper("state") == state.upper())
    return (rows.orderBy(*order) if order else rows).limit(top)


def full_map(wide: DataFrame, effects: DataFrame, hhi: str = "crop_diversity_hhi", threshold: float = 0.523,
             effect: float = 32.8, extra: Sequence[str] = ()) -> DataFrame:
    """Map rows with cluster, flags and the intervention gain; the effect row gives threshold and size."""
    row = effects.where(F.col("treatment_col") == hhi).agg(
        F.coalesce(F.first("threshold"), F.lit(threshold)).alias("_thr"),
        F.abs(F.coalesce(F.first("ate_pct_change"), F.lit(effect))).alias("_eff"))
    rows = ranks.with_scalars(wide.where(F.col(config.TARGET).isNotNull()), row)
    cols = [c for c in extra if c in wide.columns]
    return rows.select("fips", "county", "state", config.TARGET, F.col("eff_percentile").alias("percentile"),
                       *cols, hhi, metrics.intervention_gain(hhi, F.col("_thr"), F.col("_eff")).alias("intervention_gain_pct"))


def cluster_summary(centres: DataFrame) -> DataFrame:
    """Number of clusters and entities."""
    return centres.agg(F.count(F.lit(1)).alias("n_clusters"), F.sum("n_entities").alias("n_entities"))


def cluster_of(assigned: DataFrame, key: str) -> DataFrame:
    """Cluster of one entity."""
    return assigned.where(F.col("fips") == X.zfill(F.lit(key), 5))


def metric_rows(sections: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """National summary: every section's numbers as (section, metric, value). section -> (frame, name column or '')."""
    out = None
    for section, (df, name) in sections.items():
        numbers = [f for f in df.columns if f != name]
        ids = [name] if name else []
        rows = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot(ids, numbers, "m", "value")
        label = F.concat_ws(".", *[F.col(c) for c in ids], F.col("m"))
        rows = rows.select(F.lit(section).alias("section"), label.alias("metric"), "value")
        out = rows if out is None else out.unionByName(rows)
    return out


def state_years(by_year: DataFrame, years: Sequence[int] = config.CENSUS_YEARS) -> DataFrame:
    """Intensity of the survey years with the change from one to the next."""
    return facts.adjacent_change(by_year.where(F.col("year").isin(list(years))), "state", "intensity")


def first_last_change(series: DataFrame, key: str, year: str, value: str, first: int, last: int) -> DataFrame:
    """Values of two years and the change from one to the other in percent."""
    at = lambda y: F.max(F.when(F.col(year) == y, F.col(value)))
    out = series.where(F.col(year).isin(first, last)).groupBy(key).agg(at(first).alias("first_value"), at(last).alias("last_value"))
    return out.withColumn("change_pct", F.round(X.ratio(F.col("last_value") - F.col("first_value"), "first_value") * 100, 1))


def crop_metrics(crops: DataFrame, crop: str) -> DataFrame:
    """The view of one crop: its measures in every state and its share of the state's water."""
    water = F.col("area") * F.col("wi")
    totals = crops.groupBy("state").agg(F.sum(water).alias("_all"))
    mine = crops.where(F.col("crop") == crop).join(totals, "state")
    return mine.withColumn("water_share_pct", F.round(X.ratio(water, "_all") * 100, 1)).drop("_all")


def state_crops(crops: DataFrame, k: int = 8) -> DataFrame:
    """The k crops with the most water per state; bar is the intensity relative to the state's strongest."""
    water = F.coalesce(F.col("area") * F.col("wi"), F.lit(0.0))
    nested = facts.nested_top(crops, "state", water, ["crop", "wi"], k=k)
    rows = nested.select("state", F.posexplode("top_crops").alias("pos", "c"), "top_crops")
    top = F.greatest(F.array_max(F.transform("top_crops", lambda c: F.coalesce(c["wi"], F.lit(0.0)))), F.lit(0.001))
    return rows.select("state", (F.col("pos") + 1).alias("rank"), F.col("c.crop").alias("crop"),
                       F.round(F.coalesce("c.wi", F.lit(0.0)) / top, 4).alias("bar"))


def state_bands(states: DataFrame) -> DataFrame:
    """Colour bands of the state view (fixed cut-offs)."""
    above = lambda c, cuts, rest: _over(F.col(c), cuts, rest)
    return states.select(
        "state", above("vuln_score", [(2.0, "extreme"), (1.0, "high"), (0.5, "medium")], "low").alias("vuln_band"),
        above("hhi", [(0.5, "concentrated"), (0.25, "mixed")], "diverse").alias("hhi_band"),
        above("soil_good_ratio", [(0.6, "good"), (0.35, "fair")], "poor").alias("soil_band"))


def _over(c: Column, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    out = None
    for cut, label in cuts:
        out = F.when(c > cut, label) if out is None else out.when(c > cut, label)
    return F.when(c.isNotNull(), out.otherwise(rest))


def year_view(states: DataFrame, years: Sequence[int] = config.CENSUS_YEARS, year: int | None = None) -> DataFrame:
    """Value and norm columns of the survey years as (state, year, value, norm)."""
    rows = F.array(*[F.struct(F.lit(y).alias("year"), F.col(f"intensity_{y}").alias("value"), F.col(f"norm_{y}").alias("norm"))
                     for y in years])
    out = states.select("state", F.explode(rows).alias("e")).select("state", "e.*")
    return out if year is None else out.where(F.col("year") == year)
