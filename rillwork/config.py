"""Parameters: small tables and thresholds that every caller may replace.

The values below are fixed values of the published method, kept in their natural order.
"""

# -- fixed values: unit factors ------------------------------------------------------------------------------
GALLONS_PER_ACRE_FOOT = 325851
MM_PER_INCH = 25.4
SQ_M_PER_ACRE = 4046.86
NDVI_SCALE = 0.0001
NDVI_FILL = -3000

# -- fixed values: keyword groups, tested in this order; the first group with a contained keyword wins ---------
CROP_GROUPS = {
    "FORAGE": ["HAY", "HAYLAGE", "ALFALFA", "CLOVER", "GRASS", "PASTURE"],
    "GRAIN": ["CORN", "WHEAT", "RICE", "BARLEY", "SORGHUM", "OATS", "RYE", "SMALL GRAIN"],
    "OIL": ["SOYBEANS", "SUNFLOWER", "CANOLA", "PEANUTS", "COTTON"],
    "VEGETABLE": ["POTATOES", "TOMATOES", "LETTUCE", "ONIONS", "CARROTS", "BROCCOLI", "SPINACH", "GARLIC",
                  "PEPPERS", "CUCUMBERS", "SWEET CORN", "BEANS", "PEAS", "ASPARAGUS", "CELERY", "VEGETABLE"],
    "ORCHARD": ["ALMONDS", "WALNUTS", "PISTACHIOS", "PECANS", "ORANGES", "LEMONS", "GRAPEFRUIT", "APPLES",
                "GRAPES", "PEACHES", "CHERRIES", "STRAWBERRIES", "BLUEBERRIES", "BERRY", "ORCHARD"],
}
GROUP_COLORS = {"FORAGE": "#5a9e6f", "GRAIN": "#c8a84b", "OIL": "#d4884a",
                "VEGETABLE": "#7ab358", "ORCHARD": "#c06080", "OTHER": "#8a9ba8"}

# -- fixed values: name, yield per acre, price unit, crop whose price applies; order breaks ties ---------------
YIELDS = [
    ("HAY", 4.0, "$ / TON", "HAY"),
    ("HAY & HAYLAGE", 4.0, "$ / TON", "HAY"),
    ("ALFALFA", 4.0, "$ / TON", "HAY"),
    ("HAYLAGE", 3.5, "$ / TON", "HAY"),
    ("PASTURELAND", 2.0, "$ / TON", "HAY"),
    ("CORN", 175.0, "$ / BU", "CORN"),
    ("WHEAT", 46.0, "$ / BU", "WHEAT"),
    ("SOYBEANS", 50.0, "$ / BU", "SOYBEANS"),
    ("BARLEY", 70.0, "$ / BU", "BARLEY"),
    ("OATS", 60.0, "$ / BU", "OATS"),
    ("RICE", 75.0, "$ / CWT", "RICE"),
    ("SORGHUM", 70.0, "$ / BU", "SORGHUM"),
    ("SMALL GRAINS", 46.0, "$ / BU", "WHEAT"),
    ("COTTON", 900.0, "$ / LB", "COTTON"),
    ("CANOLA", 40.0, "$ / CWT", "CANOLA"),
    ("PEANUTS", 30.0, "$ / CWT", "PEANUTS"),
    ("SUNFLOWER", 15.0, "$ / CWT", "SUNFLOWER"),
    ("TOMATOES", 700.0, "$ / CWT", "TOMATOES"),
    ("POTATOES", 440.0, "$ / CWT", "POTATOES"),
    ("LETTUCE", 320.0, "$ / CWT", "LETTUCE"),
    ("SWEET CORN", 100.0, "$ / CWT", "SWEET CORN"),
    ("ONIONS", 430.0, "$ / CWT", "ONIONS"),
    ("BEANS", 20.0, "$ / CWT", "BEANS"),
    ("BROCCOLI", 75.0, "$ / CWT", "BROCCOLI"),
    ("CELERY", 700.0, "$ / CWT", "CELERY"),
    ("CARROTS", 27.0, "$ / TON", "CARROTS"),
    ("GARLIC", 8.0, "$ / CWT", "GARLIC"),
    ("PEPPERS", 200.0, "$ / CWT", "PEPPERS"),
    ("CUCUMBERS", 120.0, "$ / CWT", "CUCUMBERS"),
    ("ASPARAGUS", 25.0, "$ / CWT", "ASPARAGUS"),
    ("VEGETABLE TOTALS", 200.0, "$ / CWT", "LETTUCE"),
    ("ALMONDS", 1500.0, "$ / LB", "ALMONDS"),
    ("PISTACHIOS", 2000.0, "$ / LB", "PISTACHIOS"),
    ("WALNUTS", 2.5, "$ / TON", "WALNUTS"),
    ("GRAPES", 8.0, "$ / TON", "GRAPES"),
    ("APPLES", 12.5, "$ / TON", "APPLES"),
    ("PEACHES", 10.0, "$ / TON", "PEACHES"),
    ("CHERRIES", 5.0, "$ / TON", "CHERRIES"),
    ("BLUEBERRIES", 5000.0, "$ / LB", "BLUEBERRIES"),
    ("STRAWBERRIES", 160.0, "$ / CWT", "STRAWBERRIES"),
    ("BLACKBERRIES", 4000.0, "$ / LB", "BLACKBERRIES"),
    ("AVOCADOS", 5.0, "$ / TON", "AVOCADOS"),
    ("ORANGES", 400.0, "$ / BOX, PHD EQUIV", "ORANGES"),
    ("LEMONS", 200.0, "$ / BOX, PHD EQUIV", "LEMONS"),
    ("GRAPEFRUIT", 300.0, "$ / BOX, PHD EQUIV", "GRAPEFRUIT"),
    ("ORCHARDS", 8.0, "$ / TON", "GRAPES"),
    ("BERRY TOTALS", 4000.0, "$ / LB", "BLUEBERRIES"),
]

# -- fixed values: export shares of forage water, default for states not listed --------------------------------
EXPORT_SHARES = {"CA": 0.30, "AZ": 0.28, "NV": 0.25, "OR": 0.20, "WA": 0.20, "ID": 0.18, "UT": 0.18, "NM": 0.15,
                 "CO": 0.15, "MT": 0.12, "WY": 0.12, "ND": 0.08, "SD": 0.08, "KS": 0.08, "NE": 0.08}
EXPORT_SHARE_DEFAULT = 0.05
HAY_CROPS = ["HAY", "HAY & HAYLAGE", "ALFALFA", "HAYLAGE"]
AGGREGATE_CROPS = ["CROPS, OTHER", "HORTICULTURE TOTALS", "VEGETABLE TOTALS", "BERRY TOTALS", "SMALL GRAINS",
                   "FIELD CROPS", "ORCHARDS", "AG LAND", "HEMP", "PASTURELAND"]
LOW_VALUE_GROUPS = ["FORAGE", "GRAIN", "OIL"]
LOW_VALUE_DPG = {"FORAGE": 0.0004, "GRAIN": 0.0003, "OIL": 0.0004}

# -- fixed values: reallocation parameters ----------------------------------------------------------------------
TARGET_DPG = 0.015
CONVERSION_BASE, CONVERSION_SLOPE, TRANSITION_YIELD = 0.15, 0.25, 0.70
MARKET_CAP_M, MIN_LOW_VALUE_ACRES, DEFAULT_GOOD_RATIO = 2000.0, 500.0, 0.5

# -- fixed values: crop -> price per unit and unit factor; the first table feeds revenue, the second the target --
REVENUE_PRICES = {"corn": 6.54, "soy": 14.20, "wheat": 9.00, "cotton": 0.83 * 480, "rice": 12.00, "hay": 200.00}
COMPOSITE_PRICES = {"corn": 6.54, "soy": 14.20, "wheat": 9.00, "cotton": 0.83 * 480}
HIGH_WATER_CROPS = ["rice", "hay"]

# -- fixed values: year preferences -----------------------------------------------------------------------------
YEAR_PREFERENCE = [2018, 2023, 2013, 2017, 2022]
CENSUS_YEARS = [2013, 2018, 2023]
CROP_YEARS = [2022, 2017, 2012]
FARM_YEARS = [2022, 2017]

# -- fixed values: soil capability classes counted as good --------------------------------------------------------
GOOD_SOIL_CLASSES = ["1", "1e", "1s", "1w", "2", "2e", "2s", "2w", "3", "3e", "3s", "3w"]

# -- fixed values: state code -> region ---------------------------------------------------------------------------
REGIONS = {
    "west": ["04", "06", "08", "16", "30", "32", "35", "41", "49", "53", "56"],
    "midwest": ["17", "18", "19", "20", "26", "27", "29", "31", "38", "39", "46", "55"],
    "south": ["01", "05", "10", "12", "13", "21", "22", "24", "28", "37", "40", "45", "47", "48", "51", "54"],
    "northeast": ["09", "23", "25", "33", "34", "36", "42", "44", "50"],
}

# -- fixed values: feature roles and display labels ---------------------------------------------------------------
CLIMATE = ["precip_deficit_in", "drought_intensity", "elevation_ft"]
SOIL = ["awc_mean", "clay_pct", "organic_matter"]
HUMAN = ["centerpivot_ratio", "irr_dependency", "avg_farm_size_ac", "farm_count", "tenant_ratio",
         "crop_diversity_hhi", "high_water_crop_share", "median_income", "poverty_rate"]
TARGET, LOG_TARGET = "crop_water_eff", "log_crop_water_eff"
CLUSTER_FEATURES = ["eto_avg_in", "precip_deficit_in", "drought_intensity", "elevation_ft", "avg_farm_size_ac",
                    "crop_diversity_hhi", "tenant_ratio", "poverty_rate", "irr_dependency"]
# -- fixed values: treatments of the subgroup table and what they adjust for -------------------------------------
_SUBGROUP_CONTROLS = [*CLIMATE, "awc_mean", "clay_pct", "median_income"]
SUBGROUP_TREATMENTS = {
    "poverty_rate": [*_SUBGROUP_CONTROLS, "avg_farm_size_ac"],
    "avg_farm_size_ac": [*_SUBGROUP_CONTROLS, "poverty_rate"],
    "crop_diversity_hhi": [*_SUBGROUP_CONTROLS, "poverty_rate", "avg_farm_size_ac"],
}
LABELS = {
    "crop_diversity_hhi": "Crop Diversity HHI", "high_water_crop_share": "High-Water Crop Share",
    "poverty_rate": "Poverty Rate", "median_income": "Median Income", "avg_farm_size_ac": "Avg Farm Size (ac)",
    "centerpivot_ratio": "Center Pivot Ratio", "irr_dependency": "Irrigation Dependency",
    "farm_count": "Farm Count", "tenant_ratio": "Tenant Ratio", "precip_deficit_in": "Precip Deficit (in)",
    "drought_intensity": "Drought Intensity", "elevation_ft": "Elevation (ft)", "awc_mean": "Soil AWC",
    "clay_pct": "Clay %", "organic_matter": "Organic Matter %",
}
MIN_COVERAGE = 0.30
