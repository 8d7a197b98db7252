from pyspark.sql import functions as F

from conftest import rows
from rillwork import config
from rillwork.functions import columns as X
from rillwork.functions.stats import t_two_sided


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(col.alias("o")).first()[0]


def test_parse_number(spark):
    for text, want in {"1,234": 1234.0, " 12 ": 12.0, "(D)": None, "": None, "0": 0.0, "-5": -5.0, "NaN": None, "Infinity": None}.items():
        assert one(spark, X.parse_number("v"), text) == want
    assert one(spark, X.parse_number("v"), None) is None


def test_counts_and_keys(spark):
    assert one(spark, X.parse_count("v"), "-666666666") is None
    assert one(spark, X.parse_count("v"), "17") == 17
    df = spark.createDataFrame([("6", "1"), ("06", "001"), ("0", "0"), ("6", None), ("123", "456")], "s string, c string")
    assert [r[0] for r in df.select(X.place_key("s", "c")).collect()] == ["06001", "06001", None, None, None]
    assert one(spark, X.zfill("v", 2), "12345") == "12345"  # long text is kept
    assert one(spark, X.series_place("v"), "LAUCN010010000000003") == "01001"


def test_split_place(spark):
    df = spark.createDataFrame([("Kern County, California",), ("Nowhere",)], "n string")
    a, b = X.split_place("n")
    assert [tuple(r) for r in df.select(a, b).collect()] == [("Kern County", "California"), ("Nowhere", "")]


def test_keyword_groups_follow_list_order(spark):
    want = {"SWEET CORN": "GRAIN", "HAY & HAYLAGE": "FORAGE", "CROPS, OTHER": "OTHER", "almonds": "ORCHARD", "Cotton": "OIL"}
    for name, group in want.items():
        assert one(spark, X.keyword_group("v"), name) == group


def test_entry_for_name(spark):
    def entry(name):
        e = one(spark, X.entry_for_name("v", config.YIELDS), name)
        return e and (e["key"], e["price_crop"])
    assert entry(" corn ") == ("CORN", "CORN")
    assert entry("HAY, (EXCL ALFALFA)") == ("HAY", "HAY")        # first contained key in list order
    assert entry("BERRY") == ("BERRY TOTALS", "BLUEBERRIES")     # key contains the name
    assert entry("QUINCE") is None


def test_null_rules(spark):
    df = spark.createDataFrame([(None, 0.0), (-2.0, 0.0), (3.0, 2.0)], "a double, b double")
    got = df.select(X.log1p_floor("a"), X.ratio("a", "b"), X.clip("a", 0.0, 1.0)).collect()
    assert tuple(got[0]) == (None, None, None)
    assert tuple(got[1]) == (0.0, None, 0.0)
    assert got[2][1] == 1.5 and got[2][2] == 1.0


def test_row_filters(spark):
    df = spark.createDataFrame([("1", "a", None, 1.0), ("72", "b", 1.0, 1.0), ("3", "c", 1.0, None)], "state_fips string, k string, x double, y double")
    assert [r["k"] for r in X.at_least_filled(df, 2, ["x", "y"]).collect()] == ["b"]
    assert [r["k"] for r in X.core_rows(df, ["x"]).collect()] == ["c"]


def test_regions_and_labels(spark):
    assert one(spark, X.region_of("v"), "6") == "west"
    assert one(spark, X.region_of("v"), "72") == "other"
    assert one(spark, X.display_label("v"), "awc_mean") == "Soil AWC"
    assert one(spark, X.display_label("v"), "sand_pct") == "Sand Pct"


def test_t_tail_known_values():
    assert abs(t_two_sided(2.228138852, 10) - 0.05) < 1e-8
    assert abs(t_two_sided(1.959963985, 1e8) - 0.05) < 1e-6
    assert abs(t_two_sided(12.7062047, 1) - 0.05) < 1e-8
    assert t_two_sided(0.0, 5) == 1.0


def test_published_effects_are_consistent(spark):
    """Published log effects (four digits) and percentages agree under the back-transform."""
    for ate, pct in [(0.3838, 46.8), (-0.4027, -33.2), (-0.3981, -32.8), (-0.2858, -24.9), (-0.0545, -5.3), (-0.2317, -20.7)]:
        assert abs(one(spark, X.effect_pct("v"), ate, "double") - pct) < 0.06
