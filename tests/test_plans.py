import pytest
from pyspark.sql import functions as F

from conftest import rows
from rillwork.operators import facts, metrics, profile
from rillwork.plans import county, rollup, serve


def recs(spark, data, **const):
    cols = ["state_alpha", "state_fips_code", "county_code", "county_name", "commodity_desc", "year", "Value", "unit_desc", "short_desc", "domaincat_desc", "crop", "measure"]
    return spark.createDataFrame([tuple({**const, **r}.get(c) for c in cols) for r in data], ", ".join(f"{c} string" for c in cols))


@pytest.fixture(scope="module")
def rolled(spark):
    water = recs(spark, [
        dict(state_alpha="ca", commodity_desc="HAY", year="2013", Value="3.0"), dict(state_alpha="CA", commodity_desc="HAY", year="2018", Value="4.0"),
        dict(state_alpha="CA", commodity_desc="HAY ", year="2018", Value="2.0"), dict(state_alpha="CA", commodity_desc="HAY", year="2023", Value="6.0"),
        dict(state_alpha="CA", commodity_desc="TOMATOES", year="2018", Value="2.0"), dict(state_alpha="TX", commodity_desc="QUINCE", year="2011", Value="1.0"),
        dict(state_alpha="TX", commodity_desc="QUINCE", year="2012", Value="5.0"), dict(state_alpha="CA", commodity_desc="HAY", year="2018", Value="(D)"),
        dict(state_alpha="CA", commodity_desc="HAY", year="2018", Value="0")])
    area = recs(spark, [
        dict(state_alpha="CA", commodity_desc="HAY", year="2013", Value="1,000"), dict(state_alpha="CA", commodity_desc="HAY", year="2018", Value="2,000"),
        dict(state_alpha="CA", commodity_desc="HAY", year="2023", Value="1,000"), dict(state_alpha="CA", commodity_desc="TOMATOES", year="2018", Value="500"),
        dict(state_alpha="NV", commodity_desc="CORN", year="2018", Value="700")])
    price = recs(spark, [dict(commodity_desc="HAY", unit_desc="$ / TON", Value="100"), dict(commodity_desc="HAY", unit_desc="$ / TON", Value="300"),
                         dict(commodity_desc="HAY", unit_desc="PCT", Value="9"), dict(commodity_desc="TOMATOES", unit_desc="$ / CWT", Value="20")])
    return rollup.crop_table(water, [area], price)


def test_crop_table(rolled):
    got = {(r["state"], r["crop"]): r for r in rolled[0].collect()}
    hay = got["CA", "HAY"]
    assert (hay["year"], hay["wi"], hay["area"], hay["group"], hay["rev_per_acre"], hay["breakeven"]) == (2018, 3.0, 2000.0, "FORAGE", 800.0, 266.7)
    assert hay["dpg"] == round(800 / (3 * 325851), 6)
    assert (got["TX", "QUINCE"]["year"], got["TX", "QUINCE"]["rev_per_acre"]) == (2011, None)  # no preferred year: the earliest
    assert (got["NV", "CORN"]["wi"], got["NV", "CORN"]["area"]) == (None, 700.0)               # known by area only


def test_weighted_intensity_and_fallback(rolled):
    _, wi, area = rolled
    got = {(r["state"], r["year"]): r["intensity"] for r in facts.weighted_intensity(wi, area).collect()}
    assert got["CA", 2018] == pytest.approx((3 * 2000 + 2 * 500) / 2500)
    assert got["TX", 2011] == 1.0 and got["TX", 2012] == 5.0  # years without any weight use plain means
    assert ("TX", 2018) not in got


def test_state_table(spark, rolled):
    crops, wi, area = rolled
    soil = spark.createDataFrame([("CA", 0.8, 100.0)], "state string, good_ratio double, total_acres double")
    years = [("CA", 2000 + i, 20.0 - i) for i in range(24)]
    precip = spark.createDataFrame(years + [("TX", 2000 + i, 1.0) for i in range(9)], "state string, year int, value double")
    wells = spark.createDataFrame([("CA", 2000 + i, float(i)) for i in range(8)] + [("TX", 2000 + i, 1.0) for i in range(7)], "state string, year int, value double")
    sales = spark.createDataFrame([("CA", 2022, 0.0), ("CA", 2017, 7e6)], "state string, year int, value double")
    got = {r["state"]: r for r in rollup.state_table(crops, wi, area, soil, precip, wells, sales).collect()}
    ca = got["CA"]
    assert (ca["avg_intensity"], ca["total_irr_area"], ca["n_crops"]) == (2.8, 2500.0, 2)
    assert ca["trend_pct"] == 100.0 and ca["trend_abs"] == 3.0
    assert ca["hhi"] == round((6000**2 + 1000**2) / 7000**2, 4)
    dpg = round(800 / (3 * 325851), 6)
    assert ca["opp_value_M"] == round(2000 * 3 * 325851 * (0.015 - dpg) * round(0.15 + 0.25 * 0.8, 3) * 0.7 / 1e6, 1) and ca["opp_crop"] == "HAY"
    assert ca["virtual_water_B"] == round(2000 * 3 * 325851 * 0.30 / 1e9, 3)
    assert (ca["precip_trend_yr"], ca["precip_2013"], ca["precip_last"], ca["gw_trend_ft"]) == (-1.0, 7.0, -3.0, 3.0)
    assert (ca["ag_sales_M"], ca["ag_per_af"]) == (7.0, 1000.0)  # zero counts as missing: the earlier year is used
    vuln = 2.8 * ((1 + 1.0 * 0.5) * (1 + 3.0 * 0.1) * (1 + 100 / 10 * 0.15)) / ca["avg_dpg_cents"]
    assert ca["vuln_score"] == pytest.approx(round(vuln, 4), abs=2e-4)
    tx = got["TX"]
    assert tx["precip_trend_yr"] is None and tx["gw_trend_ft"] is None and tx["avg_intensity"] is None and tx["opp_value_M"] is None
    normed = rollup.normalized(rollup.state_table(crops, wi, area, soil, precip, wells, sales))
    assert set(rollup.NORMS.values()) <= set(normed.columns) and normed.count() == 3
    assert serve.year_view(normed, year=2018).where("state = 'CA'").first()["value"] == 2.8


def test_national_needs_three_states(spark):
    rows_ = [(s, "HAY", 2018, 2.0, 10.0, "FORAGE", 1.0, 0.001, 0.1, 5.0, "#") for s in "ABC"] + [("A", "CORN", 2018, 2.0, 10.0, "GRAIN", 1.0, 0.001, 0.1, 5.0, "#")]
    crops = spark.createDataFrame(rows_, "state string, crop string, year int, wi double, area double, `group` string, rev_per_acre double, dpg double, dpg_cents double, breakeven double, color string")
    assert [r["crop"] for r in facts.national_crops(crops).collect()] == ["HAY"]


def test_county_branch(spark):
    rec = spark.createDataFrame([("06001", "HAY", 100.0, "CA", "Old", 1), ("06001", "HAY", 50.0, "CA", "New", 2), ("06001", "ALMONDS", 120.0, "CA", "Mid", 1), ("06001", "CORN", -5.0, "CA", "x", 9)],
                                "fips string, crop string, value double, state string, county string, ord int")
    states = spark.createDataFrame([("CA", 2.0, None)], "state string, avg_intensity double, avg_dpg double")
    r = rollup.county_table(rec, states).first()
    assert (r["total_area"], r["top_crop"], r["group"], r["county"], r["est_water_af"], r["st_dpg_cents"]) == (270.0, "HAY", "FORAGE", "New", 540.0, 0.1)
    assert r["opp_value_M"] == round(150 * 2.0 * 325851 * (0.015 - 0.0004) / 1e6, 1)


def test_county_wide_table(spark):
    base = county.census_base(spark.createDataFrame(
        [("6001", "Kern County, California", "6", "100", "50000", "20", "-666666666"), ("06003", "Noname", "06", "0", "1", "1", "1"), ("72001", "X, PR", "72", "5", "1", "1", "1")],
        "geoid string, name string, state_fips string, total_population string, median_household_income string, population_below_poverty string, edu_bachelors string"))
    assert rows(base.select("fips", "county", "state", "poverty_rate", "edu_bachelors")) == [("06001", "Kern County", "California", 20.0, None), ("06003", "Noname", "", None, 1.0)]
    clim = county.climate(spark.createDataFrame([("06001", 2022, 60.0, 10.0), ("06001", 2023, 1.0, 1.0), ("06003", 2020, 50.0, None), ("06003", 2021, None, 1.0)], "fips string, year int, etr double, pr double"))
    assert rows(clim.select("fips", "eto_avg_in", "precip_deficit_in", "drought_intensity")) == [("06001", 60.0, 50.0, 0.833), ("06003", 50.0, None, None)]
    k = dict(state_fips_code="6", county_code="1")
    crops = county.crops(recs(spark, [dict(crop="corn", year="2017", Value="1,000"), dict(crop="corn", year="2012", Value="5"), dict(crop="hay", year="2022", Value="10"), dict(crop="rice", year="2022", Value="(D)")], **k))
    r = crops.first()
    assert r["corn_prod_bu"] == 1000.0 and r["crop_diversity_hhi"] == round((6540**2 + 2000**2) / 8540**2, 3) and r["high_water_crop_share"] == round(2000 / 8540, 3)
    farms = county.farms(recs(spark, [dict(measure="farm_count", year="2017", Value="10"), dict(measure="avg_farm_size_ac", year="2022", Value="40"), dict(measure="avg_farm_size_ac", year="2012", Value="1")], **k))
    empty = recs(spark, []).limit(0)
    irr = county.irrigation(recs(spark, [dict(short_desc="AG LAND, IRRIGATED - ACRES", Value="600", year="2022"), dict(short_desc="AG LAND, OTHER", Value="9", year="2022")], **k), recs(spark, [dict(Value="7", year="2022")], **k), empty)
    assert rows(irr) == [("06001", 600.0)]
    assert rows(county.irrigation(empty, recs(spark, [dict(Value="7", year="2022")], **k), empty)) == [("06001", 7.0)]  # falls through to the next source
    ten = county.tenure(recs(spark, [dict(domaincat_desc="TENURE: (FULL OWNER)", year="2022", Value="50"), dict(domaincat_desc="tenure: (part owner)", year="2022", Value="30"), dict(domaincat_desc="TENURE: (TENANT)", year="2017", Value="20"), dict(domaincat_desc="TENANT", year="2012", Value="99")], **k))
    assert rows(ten) == [("06001", 0.35)]
    haz = county.hazards(spark.createDataFrame([("6001", "5.5", "0", "7")], "STCOFIPS string, CFLD_RISKS string, DRGT_RISKS string, RISK_SCORE string"))
    assert rows(haz) == [("06001", 5.5, None, 7.0)]
    soil = county.soil(spark.createDataFrame([("06001", 0.1, None, None, None), ("06003", None, 5.0, None, None)], "fips string, awc_mean double, sand_pct double, clay_pct double, organic_matter double"))
    assert [r["fips"] for r in soil.collect()] == ["06001"]
    income = county.farm_income(spark.createDataFrame([("00000", "1"), ("6001", "1,5"), ("6003", "(NA)")], "GeoFips string, DataValue string"))
    assert rows(income) == [("06001", 15000.0)]
    wide = county.wide_table({"base": base, "climate": clim, "crops": crops, "farms": farms, "irrigation": irr,
                              "pivot": spark.createDataFrame([("06001", 5.0)], "fips string, centerpivot_ac double"), "tenure": ten,
                              "elevation": spark.createDataFrame([("06001", 100.0)], "fips string, elevation_ft double"), "hazards": haz, "soil": soil, "income": income})
    r = wide.collect()
    assert len(r) == 1  # the second county lacks irrigated land
    r = r[0]
    assert (r["est_water_af"], r["composite_crop_value"], r["crop_water_eff"], r["centerpivot_ratio"]) == (3000.0, 6540.0, 2.18, 1.0)
    assert r["irr_dependency"] == 0.6 and r["bea_farm_income"] == 15000.0


def test_soil_tables(spark):
    mapunit = spark.createDataFrame([("m1", "l1", 10.0), ("m2", "l1", 30.0), ("m3", "l2", 5.0), ("m4", "l1", None)], "mukey string, lkey string, muacres double")
    legend = spark.createDataFrame([("l1", "CA001"), ("l2", "TX001")], "lkey string, areasymbol string")
    agg = spark.createDataFrame([("m1", " 2E "), ("m2", "6"), ("m3", None), ("m4", "1")], "mukey string, iccdcd string")
    got = facts.soil_classes(mapunit, legend, agg).collect()
    assert [(r["state"], r["total_acres"], r["good_ratio"], r["by_class"]) for r in got] == [("CA", 40.0, 0.25, {"2e": 10.0, "6": 30.0})]


def test_price_snapshot_without_previous_year(spark):
    df = spark.createDataFrame([("corn", "2024-05-31", 4.0), ("corn", "2024-01-31", 5.0), ("oats", "2024-01-31", 2.0), ("oats", "2023-12-31", 1.0), ("oats", "2023-01-31", 9.0)], "s string, d string, c double")
    got = {r["s"]: r for r in facts.price_snapshot(df.withColumn("d", F.to_date("d")), "s", "d", "c").collect()}
    assert got["corn"]["yr_chg_pct"] is None and got["corn"]["pct_of_hi"] == 80.0
    assert got["oats"]["yr_chg_pct"] == 100.0 and got["oats"]["hi5"] == 9.0
