"""Registry, and the tables that stand in for the raw sources.

Customers stand for counties, supplier nations for states, part types for crops, ship years for census years.
Every sum is rounded on its own decimal grid before it enters a ratio, so both engines see the same doubles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from rillwork.functions import columns as X
from rillwork.operators import facts, ranks, screens
from rillwork.session import scratch_path, stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under its operator id; ``sql`` is the equivalent statement for the same tables."""
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A driver table; its schema is inferred once per path, later reads start without a footer job."""
    path = f"{d}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


# -- lines: state x crop x year -----------------------------------------------------------------------------------

TYPES = ["ECONOMY", "STANDARD", "MEDIUM", "PROMO", "LARGE", "SMALL"]
GROUPS = {"FORAGE": ["ECON"], "GRAIN": ["STAND", "SMALL"], "OIL": ["MED"], "VEGETABLE": ["LARGE"]}
YIELDS = [("STANDARD", 2.0, "$ / BU", "STANDARD"), ("MED", 3.0, "$ / BU", "MEDIUM"),
          ("LARGE SCALE", 1.5, "$ / BU", "LARGE"), ("PROMO", 0.5, "$ / BU", "SMALL"),
          ("ECONOMY", 1.0, "$ / CWT", "ECONOMY")]
PREFS = [1998, 2000, 1996, 1997, 1999]
SURVEYS = [1996, 1998, 2000]

LINES = """
lines AS (SELECT n.n_name AS state, p.p_type AS crop, p.p_name, p.p_size, CAST(year(l.l_shipdate) AS INT) AS year, l.*
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey)"""
FACTS = LINES + """,
wi AS (SELECT state, crop, year, avg(round(l_tax * 100)) AS wi FROM lines
  WHERE l_returnflag <> 'A' AND round(l_tax * 100) > 0 GROUP BY state, crop, year),
area AS (SELECT state, crop, year, avg(l_quantity * 100) AS area FROM lines
  WHERE l_linestatus = 'O' AND NOT (crop = 'ECONOMY' AND year < 1998) GROUP BY state, crop, year)"""
CROPS = FACTS + """,
prices AS (SELECT p_type AS price_crop, '$ / BU' AS price_unit, avg(p_retailprice) AS price FROM part
  WHERE p_size <= 25 GROUP BY p_type),
allf AS (SELECT coalesce(w.state, a.state) AS state, coalesce(w.crop, a.crop) AS crop, coalesce(w.year, a.year) AS year,
  wi, area FROM wi w FULL JOIN area a ON w.state = a.state AND w.crop = a.crop AND w.year = a.year),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state, crop ORDER BY
  CASE year WHEN 1998 THEN 0 WHEN 2000 THEN 1 WHEN 1996 THEN 2 WHEN 1997 THEN 3 WHEN 1999 THEN 4 ELSE 5 END, year) AS rn
  FROM allf) WHERE rn = 1),
entry AS (SELECT *, CASE crop WHEN 'STANDARD' THEN 2.0 WHEN 'MEDIUM' THEN 3.0 WHEN 'LARGE' THEN 1.5 WHEN 'PROMO' THEN 0.5
  WHEN 'ECONOMY' THEN 1.0 END::DOUBLE AS rate, CASE crop WHEN 'ECONOMY' THEN '$ / CWT' ELSE '$ / BU' END AS unit,
  CASE crop WHEN 'PROMO' THEN 'SMALL' WHEN 'SMALL' THEN NULL ELSE crop END AS pc,
  CASE crop WHEN 'ECONOMY' THEN 'FORAGE' WHEN 'STANDARD' THEN 'GRAIN' WHEN 'SMALL' THEN 'GRAIN' WHEN 'MEDIUM' THEN 'OIL'
  WHEN 'LARGE' THEN 'VEGETABLE' ELSE 'OTHER' END AS grp FROM best),
valued AS (SELECT e.*, nullif(rate * price, 0) AS rev FROM entry e LEFT JOIN prices p ON e.pc = p.price_crop AND e.unit = p.price_unit),
crops AS (SELECT state, crop, year, wi, coalesce(area, 0) AS area, grp, round(rev, 2) AS rev_per_acre,
  nullif(round(rev / (CASE WHEN wi > 0 THEN wi END * 325851), 6), 0) AS dpg,
  nullif(round(rev / (CASE WHEN wi > 0 THEN wi END * 325851) * 100, 4), 0) AS dpg_cents,
  nullif(round(rev / CASE WHEN wi > 0 THEN wi END, 1), 0) AS breakeven FROM valued)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Line items with state, crop and year. Part and supplier join by key; Catalyst broadcasts what is small."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", "p_type", "p_name", "p_size")
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return (li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
            .join(n, s.s_nationkey == n.n_nationkey)
            .withColumn("state", F.col("n_name")).withColumn("crop", F.col("p_type"))
            .withColumn("year", F.year("l_shipdate")))


def supplier_states(spark: SparkSession, d: str) -> DataFrame:
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("state"))


def line_sums(spark: SparkSession, d: str) -> DataFrame:
    """(l_suppkey, crop, year, qty, n, state): lines are merged per supplier, crop and year before they meet the suppliers."""
    li, p = table(spark, d, "lineitem"), table(spark, d, "part").select("p_partkey", F.col("p_type").alias("crop"))
    merged = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_suppkey", "crop", F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("qty"), F.count(F.lit(1)).alias("n"))
    return merged.join(supplier_states(spark, d), "l_suppkey")


def water_records(spark: SparkSession, d: str) -> DataFrame:
    """Intensity records: text values with thousands commas, one per line item."""
    return lines(spark, d).where(F.col("l_returnflag") != "A").select(
        F.col("state").alias("state_alpha"), F.col("crop").alias("commodity_desc"), F.col("year").cast("string").alias("year"),
        F.format_number(F.round(F.col("l_tax") * 100, 0), 1).alias("Value"))


def area_records(spark: SparkSession, d: str) -> DataFrame:
    """Area records; one crop is missing from the early surveys."""
    gone = (F.col("crop") == "ECONOMY") & (F.col("year") < 1998)
    return lines(spark, d).where((F.col("l_linestatus") == "O") & ~gone).select(
        F.col("state").alias("state_alpha"), F.col("crop").alias("commodity_desc"), F.col("year").cast("string").alias("year"),
        F.format_number(F.col("l_quantity") * 100, 1).alias("Value"))


def price_records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_type").alias("commodity_desc"),
        F.when(F.col("p_size") <= 25, "$ / BU").otherwise("PCT OF PARITY").alias("unit_desc"),
        F.format_number("p_retailprice", 2).alias("Value"))


def fact_plan(spark: SparkSession, d: str) -> DataFrame:
    """Both measures in one pass over the lines: (state, crop, year, wi, area).

    Lines meet the parts, are merged per (supplier, crop, year), and only these partial rows meet the suppliers.
    """
    li = table(spark, d, "lineitem")
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("crop"))
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    x = li.join(p, li.l_partkey == p.p_partkey).withColumn("year", F.year("l_shipdate"))
    gone = (F.col("crop") == "ECONOMY") & (F.col("year") < 1998)
    part = facts.partial_means(x, ["l_suppkey", "crop", "year"], {
        "wi": (F.round(F.col("l_tax") * 100, 0), F.col("l_returnflag") != "A"),
        "area": (F.col("l_quantity") * 100, (F.col("l_linestatus") == "O") & ~gone)})
    states = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("l_suppkey"), F.col("n_name").alias("state"))
    return facts.merge_means(part.join(states, "l_suppkey"), ["state", "crop", "year"], ["wi", "area"])


def fact_table(spark: SparkSession, d: str) -> DataFrame:
    """The joint fact table, staged: states x crops x years rows that several branches read."""
    return stage(fact_plan(spark, d), "facts")


def wi_area(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return facts.split_measures(fact_table(spark, d))


def crops_of(spark: SparkSession, d: str, fact: DataFrame) -> DataFrame:
    best = facts.best_year(fact, PREFS)
    return facts.crop_value(best, facts.price_means(price_records(spark, d)), YIELDS, GROUPS)


def crops(spark: SparkSession, d: str) -> DataFrame:
    return crops_of(spark, d, fact_table(spark, d))


# -- entities -------------------------------------------------------------------------------------------------------

_REV = {t: f"rev_{t.lower()}" for t in TYPES}

_SUMS = ", ".join(f"sum(CASE WHEN p_type = '{t}' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) AS {c}" for t, c in _REV.items())
_TOTALS = ", ".join(f"round(sum({c}), 4) AS {c}" for c in _REV.values())
_ALL = " + ".join(_REV.values())
_SQ = " + ".join(f"{c} * {c}" for c in _REV.values())

WIDE = f"""
per_order AS (SELECT l_orderkey, sum(l_quantity) AS qty, count(*) AS n_lines,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS rq,
  sum(CASE WHEN year(l_shipdate) >= 1999 THEN l_quantity ELSE 0 END) AS lq, sum(l_extendedprice) AS ext,
  sum(l_tax * l_quantity) AS tax, sum(l_discount * l_quantity) AS disc, {_SUMS}
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
per_cust AS (SELECT o_custkey, sum(qty) AS qty, CAST(sum(n_lines) AS BIGINT) AS n_lines, sum(rq) AS rq, sum(lq) AS lq,
  round(sum(ext), 2) AS ext, round(sum(tax), 2) AS tax, round(sum(disc), 2) AS disc, {_TOTALS}, count(*) AS n_orders,
  sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS urgent,
  sum(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS closed,
  max(o_totalprice) AS max_price, round(sum(o_totalprice), 2) AS price FROM orders JOIN per_order ON o_orderkey = l_orderkey GROUP BY o_custkey),
wide0 AS (SELECT lpad(CAST(c_custkey AS VARCHAR), greatest(5, length(CAST(c_custkey AS VARCHAR)))::INT, '0') AS fips, c_name AS county, n_name AS state,
  lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS state_fips, r_name AS region, c_acctbal, c_mktsegment,
  u.*, {_ALL} AS rev FROM customer LEFT JOIN per_cust u ON c_custkey = o_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey),
wide1 AS (SELECT *, round(rev / qty, 2) AS crop_water_eff FROM wide0),
wide AS (SELECT fips, county, state, state_fips, region, qty AS est_water_af, round(rev, 4) AS composite_crop_value,
  crop_water_eff, round(CASE WHEN crop_water_eff IS NOT NULL THEN ln(1 + greatest(crop_water_eff, 0)) END, 6) AS log_crop_water_eff,
  round(c_acctbal / 100, 4) AS eto_avg_in, round(n_lines::DOUBLE / n_orders, 9) AS precip_avg_in,
  round(round(c_acctbal / 100, 4) - round(n_lines::DOUBLE / n_orders, 9), 9) AS precip_deficit_in,
  round(disc / qty, 9) AS drought_intensity, round(ext / n_lines, 9) AS elevation_ft,
  CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN round(tax / qty, 9) END AS awc_mean,
  round(100 * rev_economy / rev, 3) AS clay_pct, round(100 * rev_standard / rev, 3) AS organic_matter,
  rq AS irrigated_area_ac, round(rq / qty, 9) AS centerpivot_ratio, round(lq / qty, 9) AS irr_dependency,
  round(price / n_orders, 9) AS avg_farm_size_ac, n_orders::DOUBLE AS farm_count, round(closed / n_orders, 9) AS tenant_ratio,
  round(({_SQ}) / (rev * rev), 4) AS crop_diversity_hhi, round((rev_promo + rev_small) / rev, 3) AS high_water_crop_share,
  max_price AS median_income, round(100 * urgent / n_orders, 9) AS poverty_rate FROM wide1)"""


def build_wide(spark: SparkSession, d: str) -> DataFrame:
    """Entity wide table from the raw tables.

    Lines are merged per order before they meet the orders (one row per order on both sides, the same key as the
    grouping, so no further shuffle of lines), and per customer after it; both groupings combine map-side, so an
    order or customer with a third of all rows is merged before it is shuffled.
    """
    li = table(spark, d, "lineitem")
    p = table(spark, d, "part").select("p_partkey", "p_type")
    q, when = F.col("l_quantity"), F.when
    rev = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per_order = li.join(p, li.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(
        F.sum(q).alias("qty"), F.count(F.lit(1)).alias("n_lines"),
        F.sum(when(F.col("l_returnflag") == "R", q).otherwise(0.0)).alias("rq"),
        F.sum(when(F.year("l_shipdate") >= 1999, q).otherwise(0.0)).alias("lq"), F.sum("l_extendedprice").alias("ext"),
        F.sum(F.col("l_tax") * q).alias("tax"), F.sum(F.col("l_discount") * q).alias("disc"),
        *[F.sum(when(F.col("p_type") == t, rev).otherwise(0.0)).alias(c) for t, c in _REV.items()])
    o = table(spark, d, "orders")
    per_cust = o.join(per_order, o.o_orderkey == per_order.l_orderkey).groupBy("o_custkey").agg(
        F.sum("qty").alias("qty"), F.sum("n_lines").alias("n_lines"), F.sum("rq").alias("rq"), F.sum("lq").alias("lq"),
        *[F.round(F.sum(c), 2).alias(c) for c in ("ext", "tax", "disc")],
        *[F.round(F.sum(c), 4).alias(c) for c in _REV.values()], F.count(F.lit(1)).alias("n_orders"),
        F.sum(when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0)).alias("urgent"),
        F.sum(when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("closed"),
        F.max("o_totalprice").alias("max_price"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    r = table(spark, d, "region")
    x = (c.join(per_cust, c.c_custkey == per_cust.o_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
         .join(r, n.n_regionkey == r.r_regionkey, "left"))
    x = x.withColumn("rev", F.expr(_ALL)).withColumn("eto", F.round(F.col("c_acctbal") / 100, 4)) \
         .withColumn("pr", F.round(F.col("n_lines") / F.col("n_orders"), 9)).withColumn("eff", F.round(F.expr("rev / qty"), 2))
    e = F.expr
    return x.select(
        X.zfill("c_custkey", 5).alias("fips"), F.col("c_name").alias("county"), F.col("n_name").alias("state"),
        X.zfill("n_nationkey", 2).alias("state_fips"), F.col("r_name").alias("region"), F.col("qty").alias("est_water_af"),
        F.round("rev", 4).alias("composite_crop_value"), F.col("eff").alias("crop_water_eff"),
        F.round(X.log1p_floor("eff"), 6).alias("log_crop_water_eff"), F.col("eto").alias("eto_avg_in"),
        F.col("pr").alias("precip_avg_in"), F.round(F.col("eto") - F.col("pr"), 9).alias("precip_deficit_in"),
        F.round(e("disc / qty"), 9).alias("drought_intensity"), F.round(e("ext / n_lines"), 9).alias("elevation_ft"),
        when(F.col("c_mktsegment") != "HOUSEHOLD", F.round(e("tax / qty"), 9)).alias("awc_mean"),
        F.round(e("100 * rev_economy / rev"), 3).alias("clay_pct"), F.round(e("100 * rev_standard / rev"), 3).alias("organic_matter"),
        F.col("rq").alias("irrigated_area_ac"), F.round(e("rq / qty"), 9).alias("centerpivot_ratio"),
        F.round(e("lq / qty"), 9).alias("irr_dependency"), F.round(e("price / n_orders"), 9).alias("avg_farm_size_ac"),
        F.col("n_orders").cast("double").alias("farm_count"), F.round(e("closed / n_orders"), 9).alias("tenant_ratio"),
        F.round(e(f"({_SQ}) / (rev * rev)"), 4).alias("crop_diversity_hhi"),
        F.round(e("(rev_promo + rev_small) / rev"), 3).alias("high_water_crop_share"),
        F.col("max_price").alias("median_income"), F.round(e("100 * urgent / n_orders"), 9).alias("poverty_rate"))


_PRODUCTS: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def product(spark: SparkSession, d: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A persisted product: staged once per session and input folder, rebuilt if its folder is gone."""
    key = (spark.sparkContext.applicationId, d, label)
    if key in _PRODUCTS:
        path, schema = _PRODUCTS[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:
            pass
    path = scratch_path(spark, label)
    out = stage(build(), label, path)
    _PRODUCTS[key] = (path, out.schema)
    return out


def wide(spark: SparkSession, d: str) -> DataFrame:
    """The feature table, read by every later step."""
    return product(spark, d, "features", lambda: build_wide(spark, d))


def ranked(spark: SparkSession, d: str) -> DataFrame:
    """Feature table with the target percentile."""
    return product(spark, d, "ranked", lambda: screens.with_percentile(wide(spark, d), index=wide_index(spark, d)))


def wide_index(spark: SparkSession, d: str) -> DataFrame:
    """Places of the values of all numeric columns of the feature table."""
    def build() -> DataFrame:
        x = wide(spark, d)
        return ranks.value_index(x, [f.name for f in x.schema.fields if f.dataType.typeName() == "double"])
    return product(spark, d, "wide-index", build)


def target_index(spark: SparkSession, d: str) -> DataFrame:
    """The same over the rows with a target, with the screens' intensity."""
    def build() -> DataFrame:
        x = screens.with_intensity(wide(spark, d).where("crop_water_eff IS NOT NULL"))
        return ranks.value_index(x, [f.name for f in x.schema.fields if f.dataType.typeName() == "double"])
    return product(spark, d, "target-index", build)


RANKED = WIDE + """,
ranked AS (SELECT *, CASE WHEN crop_water_eff IS NOT NULL THEN round((rank() OVER (ORDER BY crop_water_eff NULLS LAST)
  + (count(*) OVER (PARTITION BY crop_water_eff) - 1) / 2.0::DOUBLE) / count(crop_water_eff) OVER () * 100.0::DOUBLE, 1) END AS eff_percentile FROM wide)"""


# -- yearly and monthly series ----------------------------------------------------------------------------------------

SERIES = """
ordn AS (SELECT n_name AS state, o.* FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
monthly AS (SELECT state, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, round(sum(o_totalprice), 2) / count(*) AS value FROM ordn GROUP BY 1, 2),
yearly AS (SELECT state, CAST(year(o_orderdate) AS INT) AS year, round(sum(o_totalprice), 2) / count(*) AS value FROM ordn GROUP BY 1, 2)"""


def nation_orders(spark: SparkSession, d: str) -> DataFrame:
    o, c, n = (table(spark, d, t) for t in ("orders", "customer", "nation"))
    return (o.join(c.select("c_custkey", "c_nationkey"), o.o_custkey == F.col("c_custkey"))
            .join(n.select("n_nationkey", F.col("n_name").alias("state")), F.col("c_nationkey") == F.col("n_nationkey")))


def monthly_sums(spark: SparkSession, d: str) -> DataFrame:
    """(state, month, s, n): orders are merged per (customer, month) before they meet the customers."""
    o = table(spark, d, "orders").groupBy("o_custkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month")).agg(
        F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
    c, n = table(spark, d, "customer").select("c_custkey", "c_nationkey"), table(spark, d, "nation")
    x = o.join(c, o.o_custkey == c.c_custkey).join(n.select("n_nationkey", F.col("n_name").alias("state")), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.groupBy("state", "month").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def month_means(sums: DataFrame) -> DataFrame:
    return sums.select("state", "month", (F.round("s", 2) / F.col("n")).alias("value"))


def year_means(sums: DataFrame) -> DataFrame:
    by_year = sums.groupBy("state", F.year("month").alias("year")).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return by_year.select("state", "year", (F.round("s", 2) / F.col("n")).alias("value"))


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return month_means(monthly_sums(spark, d))


def yearly(spark: SparkSession, d: str) -> DataFrame:
    return year_means(monthly_sums(spark, d))


__all__ = [n for n in dir() if not n.startswith("__")]
