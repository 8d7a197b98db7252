"""County wide table: typed sources, one row per county each, left-joined and completed with derived measures."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from rillwork import config
from rillwork.functions import columns as X
from rillwork.operators import facts, metrics, ranks


def census_base(rows: DataFrame) -> DataFrame:
    """Census records (text columns) to the entity base."""
    county, state = X.split_place("name")
    n = lambda c: X.parse_count(c).cast("double")
    out = rows.select(
        X.zfill("geoid", 5).alias("fips"), county.alias("county"), state.alias("state"),
        X.zfill("state_fips", 2).alias("state_fips"), n("total_population").alias("population"),
        n("median_household_income").alias("median_income"),
        metrics.poverty_rate(n("population_below_poverty"), n("total_population")).alias("poverty_rate"),
        n("edu_bachelors").alias("edu_bachelors"))
    return out.where((F.length("fips") == 5) & (F.col("state_fips").try_cast("int") <= 56)).dropDuplicates(["fips"])


def climate(years: DataFrame, prefer: int = 2022, pr_null: str = "null") -> DataFrame:
    """(fips, year, etr, pr): preferred year or the latest, with deficit and intensity."""
    got = facts.preferred_or_latest(years.where(F.col("etr").isNotNull()), "fips", "year", ["etr", "pr"], prefer)
    got = got.select("fips", F.round("etr", 2).alias("eto_avg_in"), F.round("pr", 2).alias("precip_avg_in"))
    return metrics.climate_balance(got, pr_null=pr_null)


def _typed_records(records: DataFrame) -> DataFrame:
    return records.select("*", X.place_key("state_fips_code", "county_code").alias("fips"),
                          X.parse_number("Value").alias("v"), F.col("year").try_cast("int").alias("y")) \
                  .where(F.col("fips").isNotNull() & F.col("v").isNotNull())


def crops(records: DataFrame, order: str | None = None) -> DataFrame:
    """Crop production records (with a ``crop`` column): first available census year, structure and production."""
    typed = _typed_records(records)
    order_col = F.col(order) if order else F.lit(0)
    last = typed.withColumn("_o", order_col).groupBy("fips", "crop", "y").agg(F.max_by("v", "_o").alias("v"))
    picked = last.groupBy("fips", "crop").agg(facts.first_of_years("v", "y", config.CROP_YEARS).alias("production"))
    known = picked.where(F.col("production").isNotNull())
    structure = metrics.crop_structure(picked, "fips")
    wide = known.groupBy("fips").agg(*[F.max(F.when(F.col("crop") == c, F.col("production"))).alias(f"{c}_prod_bu")
                                       for c in config.COMPOSITE_PRICES])
    return structure.join(wide, "fips", "left")


def farms(records: DataFrame) -> DataFrame:
    """Farm count, sales and size records (with a ``measure`` column) of recent census years."""
    typed = _typed_records(records).where(F.col("y") >= 2017)
    pick = lambda m: facts.first_of_years("v", "y", config.FARM_YEARS, F.col("measure") == m).alias(m)
    return typed.groupBy("fips").agg(pick("farm_count"), pick("farm_sales_usd"), pick("avg_farm_size_ac"))


def irrigation(census: DataFrame, survey: DataFrame, fallback: DataFrame) -> DataFrame:
    """Irrigated acres from the first source with data; the census file keeps only its top-level rows."""
    top = census.where(F.trim("short_desc") == "AG LAND, IRRIGATED - ACRES")
    totals = [_typed_records(s).where(F.col("v") > 0).groupBy("fips").agg(F.sum("v").alias("irrigated_area_ac"))
              for s in (top, survey, fallback)]
    return facts.first_nonempty(totals)


def tenure(records: DataFrame) -> DataFrame:
    typed = _typed_records(records).where(F.col("y") >= 2017).withColumn("text", F.upper("domaincat_desc"))
    return facts.tenure_ratio(typed, "fips", "v", "text")


def hazards(rows: DataFrame) -> DataFrame:
    """Hazard scores under upper- or lower-case column names; zero counts as missing."""
    have = {c.lower(): [k for k in rows.columns if k.lower() == c.lower()] for c in rows.columns}
    pick: Mapping[str, Column] = {
        out: F.coalesce(*[X.filled(F.col(c).try_cast("double")) for c in have.get(src, [])] or [F.lit(None).cast("double")])
        for out, src in (("flood_risk_score", "cfld_risks"), ("drought_risk_score", "drgt_risks"), ("overall_risk_score", "risk_score"))}
    key = X.first_filled(*have["stcofips"])
    out = rows.select(X.zfill(key, 5).alias("fips"), *[c.alias(o) for o, c in pick.items()])
    return out.where(F.length("fips") == 5).dropDuplicates(["fips"])


def soil(docs: DataFrame) -> DataFrame:
    """Soil documents with at least one known measure."""
    cols = ["awc_mean", "sand_pct", "clay_pct", "organic_matter"]
    return docs.select("fips", *cols).dropna(thresh=1, subset=["awc_mean", "clay_pct", "organic_matter"]).dropDuplicates(["fips"])


def farm_income(rows: DataFrame) -> DataFrame:
    """Farm income records in thousands; the national row and unreadable values drop out."""
    fips = X.zfill("GeoFips", 5)
    out = rows.select(fips.alias("fips"), X.thousands(X.parse_number("DataValue")).alias("bea_farm_income"))
    return out.where((F.length("fips") == 5) & (F.col("fips") != "00000")).dropna()


def wide_table(sources: Mapping[str, DataFrame]) -> DataFrame:
    """All sources on the census base. Keys: base, climate, crops, farms, irrigation, pivot, tenure, elevation,
    hazards, soil; optional: unemployment, insurance, income. Each holds one row per county."""
    optional = [sources[k] for k in ("unemployment", "insurance", "income") if k in sources]
    pivot = sources["pivot"].select("fips", F.col("centerpivot_ac").cast("double").alias("centerpivot_area_ac"))
    parts = [sources["climate"], sources["crops"], sources["farms"], sources["irrigation"], pivot, sources["tenure"],
             sources["elevation"].select("fips", "elevation_ft"), sources["hazards"], sources["soil"], *optional]
    return derive(facts.chain_left(sources["base"], parts, "fips"))


def derive(df: DataFrame) -> DataFrame:
    """Rank of pivot area, water, value, target, dependency; then the core-measure filter."""
    df = ranks.rank_pct(df, "centerpivot_area_ac", "centerpivot_ratio", digits=4)
    df = df.withColumn("est_water_af", metrics.estimated_water("irrigated_area_ac", "eto_avg_in"))
    df = df.withColumn("composite_crop_value", metrics.composite_value({f"{c}_prod_bu": p for c, p in config.COMPOSITE_PRICES.items()}))
    df = metrics.add_target(df)
    df = df.withColumn("irr_dependency", metrics.irrigation_dependency("irrigated_area_ac", "avg_farm_size_ac", "farm_count"))
    return X.core_rows(X.finite_doubles(df), ["eto_avg_in", "irrigated_area_ac"])
