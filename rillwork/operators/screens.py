"""Policy screens and ranked lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from rillwork import config
from rillwork.functions import columns as X
from rillwork.operators import ranks

TOP_N = 200


def with_percentile(df: DataFrame, target: str = config.TARGET, out: str = "eff_percentile", index: DataFrame | None = None) -> DataFrame:
    """Percentile of the target on a 0-100 scale, one decimal."""
    return ranks.rank_pct(df, target, out, scale=100.0, digits=1, index=index)


def screen_rows(df: DataFrame, extra: Mapping[str, tuple[str, int]], label: str, target: str = config.TARGET) -> DataFrame:
    """Output record: keys, target, percentile and the screen's own columns; unknown numbers show as zero."""
    z = lambda c, k: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), k)
    return df.select("fips", "county", "state", z(target, 2).alias(target), z("eff_percentile", 1).alias("eff_percentile"),
                     *[z(c, k).alias(o) for o, (c, k) in extra.items()], F.lit(label).alias("insight"))


#: Thresholds of the screens: name -> (column, probability), over the rows with a target.
CUTS = {"lhf_deficit": ("precip_deficit_in", 0.60), "soil": ("awc_mean", 0.40), "soil_mid": ("awc_mean", 0.50), "poverty": ("poverty_rate", 0.60), "size": ("avg_farm_size_ac", 0.70),
        "vwe_deficit": ("precip_deficit_in", 0.70), "irr": ("irrigated_area_ac", 0.65), "dual_deficit": ("precip_deficit_in", 0.65), "irr_intensity": ("irr_intensity", 0.65)}


def with_intensity(df: DataFrame) -> DataFrame:
    """Irrigated area per unit of rain."""
    return df.withColumn("irr_intensity", X.ratio("irrigated_area_ac", "precip_avg_in"))


def thresholds(df: DataFrame, target: str = config.TARGET, index: DataFrame | None = None) -> dict[str, Column]:
    """All thresholds of the three screens as constants, so that the comparisons reach the scan: one aggregate.

    ``index`` is the ``ranks.value_index`` of the rows with a target.
    """
    dm = with_intensity(df.where(F.col(target).isNotNull()))
    row = ranks.quantile_row(dm, CUTS, index=index, counts=["awc_mean"]).first()
    return {k: F.lit(row[k]).cast("double") for k in CUTS} | {"n_soil": F.lit(row["n_awc_mean"])}


def low_hanging_fruit(df: DataFrame, top: int = TOP_N, target: str = config.TARGET, min_soil: int = 100, cuts: Mapping[str, Column] | None = None) -> DataFrame:
    """Moderate climate and fair soil, but poverty or large farms and low efficiency; lowest efficiency first."""
    q = cuts or thresholds(df, target)
    soil_ok = (q["n_soil"] <= min_soil) | (F.coalesce(F.col("awc_mean"), q["soil_mid"]) > q["soil"])
    hit = ((F.col("precip_deficit_in") < q["lhf_deficit"]) & soil_ok & (F.col("eff_percentile") < 40)
           & ((F.col("poverty_rate") > q["poverty"]) | (F.col("avg_farm_size_ac") > q["size"])))
    sel = df.where(F.col(target).isNotNull() & hit).orderBy(target, "fips").limit(top)
    return screen_rows(sel, {"precip_deficit_in": ("precip_deficit_in", 1), "poverty_rate": ("poverty_rate", 1),
                             "avg_farm_size_ac": ("avg_farm_size_ac", 0)}, "Low-Hanging Fruit", target)


def virtual_water_exporters(df: DataFrame, top: int = TOP_N, target: str = config.TARGET, cuts: Mapping[str, Column] | None = None) -> DataFrame:
    """Dry places with large irrigation and low efficiency; driest first."""
    q = cuts or thresholds(df, target)
    hit = ((F.col("precip_deficit_in") > q["vwe_deficit"]) & (F.col("irrigated_area_ac") > q["irr"])
           & (F.col("eff_percentile") < 45))
    sel = df.where(F.col(target).isNotNull() & hit).orderBy(F.desc("precip_deficit_in"), "fips").limit(top)
    return screen_rows(sel, {"precip_deficit_in": ("precip_deficit_in", 1)}, "Virtual Water Exporter", target)


def risk_score(df: DataFrame, a: str, b: str, out: str = "risk_score") -> DataFrame:
    """Sum of two measures scaled to [0, 1] within the frame."""
    return ranks.min_max(df, {a: "_na", b: "_nb"}).withColumn(out, F.col("_na") + F.col("_nb")).drop("_na", "_nb")


def dual_exposure(df: DataFrame, top: int = TOP_N, target: str = config.TARGET, cuts: Mapping[str, Column] | None = None) -> DataFrame:
    """Dry places with much irrigation per unit of rain and real output; highest combined score first."""
    q = cuts or thresholds(df, target)
    dm = with_intensity(df.where(F.col(target).isNotNull()))
    hit = ((F.col("precip_deficit_in") > q["dual_deficit"]) & (F.col("irr_intensity") > q["irr_intensity"]) & (F.col("eff_percentile") > 30))
    sel = risk_score(dm.where(hit), "precip_deficit_in", "irr_intensity").orderBy(F.desc(F.round("risk_score", 9)), "fips").limit(top)
    return screen_rows(sel, {"precip_deficit_in": ("precip_deficit_in", 1), "irrigated_area_ac": ("irrigated_area_ac", 0),
                             "irr_intensity": ("irr_intensity", 2)}, "Dual Exposure", target)


def flagged(df: DataFrame, key: str, lhf: DataFrame, vwe: DataFrame, dual: DataFrame) -> DataFrame:
    """The screens as 0/1 columns; the lists are short by construction, so they are broadcast."""
    for name, ids in (("is_lhf", lhf), ("is_vwe", vwe), ("is_dual", dual)):
        marks = F.broadcast(ids.select(key).distinct().withColumn(name, F.lit(1)))
        df = df.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return df


# -- lists ----------------------------------------------------------------------------------------------------------


def top_list(df: DataFrame, measure: str, name: str, n: int = 12, ascending: bool = False, by_size: bool = False,
             bar: bool = False, positive: bool = False, bands: Column | None = None, extra: Sequence[str] = (),
             exclude: Sequence[str] = ()) -> DataFrame:
    """Ranked list of n names by a measure (or its absolute size), with an optional bar share and band."""
    rows = df.where(F.col(measure).isNotNull())
    if positive:
        rows = rows.where(F.col(measure) > 0)
    if exclude:
        rows = rows.where(~F.col(name).isin(list(exclude)))
    key = F.abs(measure) if by_size else F.col(measure)
    order = [key.asc() if ascending else key.desc(), F.col(name)]
    top = rows.orderBy(*order).limit(n)
    w = Window.partitionBy(F.lit(0)).orderBy(*order)  # at most n rows are left here
    top = top.withColumn("rank", F.row_number().over(w))
    if bar:
        top = top.withColumn("bar", F.round(X.ratio(measure, F.max(measure).over(Window.partitionBy(F.lit(0)))) * 100, 0))
    if bands is not None:
        top = top.withColumn("band", bands)
    return top.select("rank", name, measure, *(["bar"] if bar else []), *(["band"] if bands is not None else []), *extra)


def price_sensitivity(crops: DataFrame, prices: DataFrame, each: int = 6, name: str = "crop", be: str = "avg_breakeven",
                      exclude: Sequence[str] = config.AGGREGATE_CROPS) -> DataFrame:
    """For every price of a short grid: crops below and above it, the first ``each`` of both sides by water use."""
    rows = crops.where(F.col(be).isNotNull() & ~F.col(name).isin(list(exclude)))
    grid = prices.agg(F.sort_array(F.collect_set("price")).alias("_grid"))
    x = ranks.with_scalars(rows, grid).withColumn("price", F.explode("_grid")).drop("_grid")
    x = x.withColumn("profitable", F.col(be) <= F.col("price"))
    w = Window.partitionBy("price", "profitable").orderBy(F.desc("avg_water_int"), name)
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each) \
            .select("price", "profitable", "rank", name, be)


def sensitivity_curve(states: DataFrame, prices: DataFrame, be: str = "avg_breakeven") -> DataFrame:
    """Number of places below and above each price of a short grid."""
    grid = prices.agg(F.sort_array(F.collect_set("price")).alias("_grid"))
    x = ranks.with_scalars(states.where(F.col(be).isNotNull()), grid).withColumn("price", F.explode("_grid"))
    return x.groupBy("price").agg(F.count(F.when(F.col(be) <= F.col("price"), 1)).alias("n_profit"),
                                  F.count(F.when(F.col(be) > F.col("price"), 1)).alias("n_loss"))


def profit_flags(states: DataFrame, prices: DataFrame, key: str = "state", be: str = "avg_breakeven") -> DataFrame:
    """Whether each place breaks even at each price of a short grid, and by how much."""
    grid = prices.agg(F.sort_array(F.collect_set("price")).alias("_grid"))
    x = ranks.with_scalars(states.where(F.col(be).isNotNull()), grid).withColumn("price", F.explode("_grid"))
    return x.select(key, "price", (F.col(be) <= F.col("price")).alias("profitable"), F.round(F.col("price") - F.col(be), 4).alias("margin"))


def crop_name_lists(crops: DataFrame, key: str = "state", name: str = "crop", thirsty: float = 1.5, poor: float = 0.2,
                    rich: float = 1.0, exclude: Sequence[str] = config.AGGREGATE_CROPS) -> DataFrame:
    """Names of thirsty, low-value and high-value crops per state as joined text."""
    rows = crops.where(~F.col(name).isin(list(exclude)))
    names = lambda cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col(name)))), ", ")
    return rows.groupBy(key).agg(names(F.coalesce("wi", F.lit(0.0)) > thirsty).alias("high_water"),
                                 names(F.col("dpg_cents") < poor).alias("low_value"),
                                 names(F.col("dpg_cents") > rich).alias("high_value"))


def state_ranks(states: DataFrame, measures: Sequence[str], key: str = "state") -> DataFrame:
    """Competition rank of every place on several measures, next to the national means of the known values."""
    means = states.agg(*[F.round(F.avg(X.filled(m)), 2).alias(f"nat_avg_{m}") for m in measures])
    out = states.select(key, *[X.filled(m).alias(m) for m in measures])
    for m in measures:
        out = ranks.rank_and_share(out, m, f"rank_{m}", None)
    return ranks.with_scalars(out, means)
