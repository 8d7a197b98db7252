"""Aggregations over state x crop x year facts, series statistics and the state roll-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork import config
from rillwork.catalog.base import (CROPS, FACTS, GROUPS, LINES, PREFS, SERIES, SURVEYS, TYPES, WIDE, YIELDS, area_records, build_wide, crops, crops_of, fact_plan, fact_table,
                                   month_means, monthly, monthly_sums, nation_orders, price_records, product, query, supplier_states, table, water_records, wi_area, wide, year_means, yearly)
from rillwork.functions import columns as X
from rillwork.operators import facts, metrics, profile, ranks
from rillwork.plans import county
from rillwork.session import stage, stage_all


@query("a1_positive_mean", f"WITH {FACTS} SELECT state, crop, year, round(wi, 6) AS wi FROM wi")
def a1(spark, d):
    return facts.record_measure(water_records(spark, d), "wi").withColumn("wi", F.round("wi", 6))


@query("a2_price_means", f"WITH {CROPS} SELECT price_crop, price_unit, round(price, 4) AS price FROM prices")
def a2(spark, d):
    return facts.price_means(price_records(spark, d)).withColumn("price", F.round("price", 4))


@query("a3_entity_totals", """SELECT o_custkey, round(sum(o_totalprice), 2) AS total, arg_max(o_orderstatus, o_orderkey) AS last_status, arg_max(o_orderpriority, o_orderkey) AS last_priority
FROM orders WHERE o_totalprice > 100000 GROUP BY 1""")
def a3(spark, d):
    o = table(spark, d, "orders").withColumn("v", F.when(F.col("o_totalprice") > 100000, F.col("o_totalprice")).otherwise(-1.0))
    out = facts.entity_totals(o, "o_custkey", "v", "o_orderkey", ["o_orderstatus", "o_orderpriority"], "total")
    return out.select("o_custkey", F.round("total", 2).alias("total"), F.col("o_orderstatus").alias("last_status"), F.col("o_orderpriority").alias("last_priority"))


@query("a4_tenure_ratio", """WITH s AS (SELECT o_custkey, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0 END) AS f, sum(CASE WHEN o_orderpriority = '2-HIGH' THEN o_totalprice ELSE 0 END) AS t,
sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN o_totalprice ELSE 0 END) AS p FROM orders GROUP BY 1) SELECT o_custkey, round((round(t, 2) + round(p, 2) * 0.5::DOUBLE) / (round(f, 2) + round(t, 2) + round(p, 2)), 3) AS tenant_ratio FROM s WHERE f + t + p > 0""")
def a4(spark, d):
    text = X.from_map("o_orderpriority", {"1-URGENT": "TENURE: (FULL OWNER)", "2-HIGH": "TENURE: (TENANT)", "3-MEDIUM": "TENURE: (PART OWNER)"}, "OTHER")
    return facts.tenure_ratio(table(spark, d, "orders").withColumn("text", text), "o_custkey", "o_totalprice", "text")


_A5 = f"""WITH {FACTS}, j AS (SELECT w.state, w.year, wi, area FROM wi w LEFT JOIN area a ON w.state = a.state AND w.crop = a.crop AND w.year = a.year),
s AS (SELECT state, year, sum(wi * area) AS wx, sum(area) AS w, avg(wi) AS plain FROM j GROUP BY 1, 2), y AS (SELECT year, max(w) AS any_w FROM s GROUP BY 1),
by_year AS (SELECT s.state, s.year, CASE WHEN any_w > 0 THEN wx / nullif(w, 0) ELSE plain END AS intensity FROM s JOIN y ON s.year = y.year)"""


@query("a5_weighted_intensity", f"{_A5} SELECT state, year, round(intensity, 6) AS intensity FROM by_year WHERE intensity IS NOT NULL")
def a5(spark, d):
    return facts.joint_intensity(fact_table(spark, d)).withColumn("intensity", F.round("intensity", 6))


@query("a5b_fallback_mean", f"WITH {FACTS} SELECT state, year, round(avg(wi), 6) AS intensity FROM wi GROUP BY 1, 2")
def a5b(spark, d):
    wi, area = wi_area(spark, d)  # no area survey at all: plain means
    return facts.weighted_intensity(wi, area.where(F.col("area") < 0)).withColumn("intensity", F.round("intensity", 6))


_SUMMARY = f"""{CROPS}, g AS (SELECT state, sum(CASE WHEN wi <> 0 AND area > 0 THEN wi * area END) AS wt, sum(CASE WHEN wi <> 0 AND area > 0 THEN area END) AS ar,
sum(CASE WHEN wi <> 0 AND area > 0 AND rev_per_acre <> 0 THEN rev_per_acre * area END) AS rv, sum(CASE WHEN wi <> 0 AND area > 0 AND rev_per_acre <> 0 THEN area END) AS ra,
avg(CASE WHEN area > 0 THEN breakeven END) AS be, count(*) AS n_crops FROM crops GROUP BY 1),
summary AS (SELECT state, round(wt / ar, 3) AS avg_intensity, round((rv / ra) / ((wt / ar) * 325851), 6) AS avg_dpg, round((rv / ra) / ((wt / ar) * 325851) * 100, 4) AS avg_dpg_cents,
round(be, 4) AS avg_breakeven, round(coalesce(ar, 0), 0) AS total_irr_area, n_crops FROM g)"""


@query("a6_state_summary", f"WITH {_SUMMARY} SELECT * FROM summary")
def a6(spark, d):
    return facts.state_summary(crops(spark, d), be_digits=4)


@query("a7_hhi", f"WITH {CROPS}, v AS (SELECT state, wi * area AS w FROM crops WHERE wi * area > 0) SELECT state, round(sum(w * w) / (sum(w) * sum(w)), 4) AS hhi FROM v GROUP BY 1")
def a7(spark, d):
    return facts.concentration(crops(spark, d), ["state"], F.col("area") * F.col("wi"))


@query("a7b_hhi_row", f"WITH {WIDE} SELECT fips, round((clay_pct * clay_pct + organic_matter * organic_matter) / ((clay_pct + organic_matter) * (clay_pct + organic_matter)), 3) AS hhi FROM wide WHERE clay_pct + organic_matter > 0")
def a7b(spark, d):
    return wide(spark, d).select("fips", facts.concentration_of(["clay_pct", "organic_matter"]).alias("hhi")).where("hhi IS NOT NULL")


@query("a9_annual_inches", "SELECT l_suppkey, CAST(year(l_shipdate) AS INT) AS year, round(sum(l_quantity) * 0.1::DOUBLE / 25.4::DOUBLE, 4) AS inches FROM lineitem GROUP BY 1, 2")
def a9(spark, d):
    return facts.annual_inches(table(spark, d, "lineitem"), "l_suppkey", "l_shipdate", "l_quantity").select("l_suppkey", "year", F.round("inches", 4).alias("inches"))


@query("a10_mean_and_latest", f"WITH {SERIES} SELECT state, round(avg(value), 2) AS price_avg, arg_max(value, year) AS price_latest FROM yearly GROUP BY 1")
def a10(spark, d):
    return facts.mean_and_latest(yearly(spark, d), "state", "year", "value", "price")


_NATIONAL = f"""{CROPS}, nat AS (SELECT crop, grp AS "group", round(avg(nullif(wi, 0)), 3) AS avg_water_int, round(avg(dpg), 6) AS avg_dpg, round(avg(dpg) * 100, 4) AS avg_dpg_cents,
round(avg(breakeven), 1) AS avg_breakeven, count(nullif(wi, 0)) AS n_states FROM crops GROUP BY 1, 2 HAVING count(nullif(wi, 0)) >= 3)"""


@query("a13_national_crops", f"WITH {_NATIONAL} SELECT * FROM nat ORDER BY avg_water_int DESC, crop LIMIT 40")
def a13(spark, d):
    return facts.national_crops(crops(spark, d), groups=GROUPS)


@query("a23_argmax_crop", f"WITH {CROPS} SELECT state, crop AS top_crop FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY coalesce(area * wi, 0) DESC, crop) AS rn FROM crops) WHERE rn = 1")
def a23(spark, d):
    return facts.top_crop(crops(spark, d), "state", F.coalesce(F.col("area") * F.col("wi"), F.lit(0.0)))


@query("a24_series_trend", f"""WITH {SERIES}, i AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY month) - 1 AS i FROM monthly)
SELECT state, round(regr_slope(value, i), 4) AS trend, round(avg(value), 1) AS mean, arg_max(value, month) AS last FROM i GROUP BY 1 HAVING count(*) >= 10""")
def a24(spark, d):
    return facts.series_trend(monthly(spark, d), "state", "month", "value").select("state", "trend", "mean", "last")


@query("a24b_short_series", f"""WITH {SERIES}, i AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY year) - 1 AS i FROM yearly)
SELECT state, CASE WHEN count(*) >= 7 THEN round(regr_slope(value, i), 4) END AS trend, CASE WHEN count(*) >= 7 THEN max(CASE WHEN year = 1998 THEN value END) END AS at_1998 FROM i GROUP BY 1""")
def a24b(spark, d):
    return facts.series_trend(yearly(spark, d), "state", "year", "value", [1998], min_points=7).select("state", "trend", "at_1998")


@query("a25_late_minus_early", f"""WITH {SERIES}, i AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY month) AS u, row_number() OVER (PARTITION BY state ORDER BY month DESC) AS z FROM monthly)
SELECT state, CASE WHEN count(*) >= 8 THEN round(avg(CASE WHEN z <= 5 THEN value END) - avg(CASE WHEN u <= 5 THEN value END), 2) END AS late_minus_early FROM i GROUP BY 1""")
def a25(spark, d):
    return facts.late_minus_early(monthly(spark, d), "state", "month", "value")


@query("a26p_station_years", """WITH s AS (SELECT n_name AS state, s_suppkey, CAST(year(l_shipdate) AS INT) AS year, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3)
SELECT state, year, round(avg(v), 4) AS inches FROM s GROUP BY 1, 2""")
def a26p(spark, d):
    merged = table(spark, d, "lineitem").groupBy("l_suppkey", F.trunc("l_shipdate", "year").alias("date")).agg(F.sum("l_quantity").alias("v"))
    return facts.station_years(merged.join(supplier_states(spark, d), "l_suppkey"), "state", "l_suppkey", "date", "v", "inches").withColumn("inches", F.round("inches", 4))


_SNAP = f"""WITH {SERIES}, k AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY month DESC) AS rn FROM monthly), p AS (SELECT * FROM k WHERE rn <= 60), y AS (SELECT state, max(year(month)) AS y FROM p GROUP BY 1)
SELECT p.state, round(arg_max(value, month), 2) AS latest, max(month) AS date, round((arg_max(value, month) / arg_max(value, month) FILTER (year(month) = y - 1) - 1) * 100, 1) AS yr_chg_pct,
round(max(value), 2) AS hi5, round(min(value), 2) AS lo5, round(arg_max(value, month) / max(value) * 100, 1) AS pct_of_hi FROM p JOIN y ON p.state = y.state GROUP BY 1"""


@query("a28_price_snapshot", _SNAP)
def a28(spark, d):
    return facts.price_snapshot(facts.newest_rows(monthly(spark, d), "state", "month"), "state", "month", "value")


# -- state roll-up ------------------------------------------------------------------------------------------------------

_SOIL_STATE = "soil AS (SELECT n_name AS state, round(0.2::DOUBLE + n_nationkey / 50.0::DOUBLE, 3) AS good_ratio FROM nation WHERE n_regionkey <> 3)"
_OPP = f"""{_SOIL_STATE}, low AS (SELECT *, coalesce(wi, 0) AS w0, coalesce(dpg, 0) AS d0 FROM crops WHERE grp IN ('FORAGE', 'GRAIN', 'OIL') AND area >= 500),
gain AS (SELECT state, sum(CASE WHEN w0 > 0 AND d0 < 0.015 THEN area * w0 * 325851 * (0.015::DOUBLE - d0) END) AS gain FROM low GROUP BY 1),
ocrop AS (SELECT state, crop AS opp_crop FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY area * w0 DESC, crop) AS rn FROM low) WHERE rn = 1),
opp AS (SELECT st.state, CASE WHEN gain * round(0.15::DOUBLE + 0.25::DOUBLE * coalesce(good_ratio, 0.5), 3) * 0.70::DOUBLE > 0 THEN
round(least(gain * round(0.15::DOUBLE + 0.25::DOUBLE * coalesce(good_ratio, 0.5), 3) * 0.70::DOUBLE / 1e6, 2000), 1) END AS opp_value_m, opp_crop
FROM (SELECT DISTINCT state FROM crops) st LEFT JOIN gain ON gain.state = st.state LEFT JOIN ocrop ON ocrop.state = st.state LEFT JOIN soil ON soil.state = st.state)"""


def soil_states(spark, d):
    return table(spark, d, "nation").where("n_regionkey <> 3").select(
        F.col("n_name").alias("state"), F.round(0.2 + F.col("n_nationkey") / 50.0, 3).alias("good_ratio"))


@query("d9_opportunity", f"WITH {CROPS}, {_OPP} SELECT * FROM opp")
def d9(spark, d):
    return metrics.opportunity(crops(spark, d), soil_states(spark, d)).withColumnRenamed("opp_value_M", "opp_value_m")


_VW = """vw AS (SELECT state, CASE WHEN sum(CASE WHEN crop IN ('ECONOMY', 'SMALL') AND area > 0 AND wi > 0 THEN area * wi * 325851 END) > 0 THEN
round(sum(CASE WHEN crop IN ('ECONOMY', 'SMALL') AND area > 0 AND wi > 0 THEN area * wi * 325851 END) * CASE state WHEN 'NATION_1' THEN 0.3::DOUBLE WHEN 'NATION_2' THEN 0.2::DOUBLE ELSE 0.05::DOUBLE END / 1e9, 3) END AS virtual_water_b FROM crops GROUP BY 1)"""


@query("d10_virtual_water", f"WITH {CROPS}, {_VW} SELECT * FROM vw")
def d10(spark, d):
    return metrics.virtual_water(crops(spark, d), {"NATION_1": 0.3, "NATION_2": 0.2}, ["ECONOMY", "SMALL"]).withColumnRenamed("virtual_water_B", "virtual_water_b")


@query("d8_value_per_water", f"WITH {CROPS} SELECT state, crop, year, round(wi, 6) AS wi, round(area, 6) AS area, rev_per_acre, dpg, dpg_cents, breakeven FROM crops")
def d8(spark, d):
    return crops(spark, d).select("state", "crop", "year", F.round("wi", 6).alias("wi"), F.round("area", 6).alias("area"), "rev_per_acre", "dpg", "dpg_cents", "breakeven")


_CHANGE = f"""{_A5}, wide_y AS (SELECT state, max(CASE WHEN year = 1996 THEN intensity END) AS a, max(CASE WHEN year = 2000 THEN intensity END) AS b, max(CASE WHEN year = 1998 THEN intensity END) AS m FROM by_year GROUP BY 1),
trend AS (SELECT state, CASE WHEN a <> 0 AND b <> 0 THEN round((b - a) / a * 100, 1) END AS trend_pct, CASE WHEN a <> 0 AND b <> 0 THEN round(b - a, 3) END AS trend_abs FROM wide_y)"""


@query("w10_survey_change", f"{_CHANGE} SELECT * FROM trend")
def w10(spark, d):
    return facts.survey_change(facts.joint_intensity(fact_table(spark, d)), "state", "intensity", 1996, 2000)


def state_measures(spark, d):
    """State roll-up measures used by the vulnerability score and the lists; staged, since several lists read it."""
    # states x crops x years and states x months rows: each is read by several branches
    staged = stage_all({"facts": fact_plan(spark, d), "prices": monthly_sums(spark, d)})
    fact, prices = staged["facts"], staged["prices"]
    by_year = facts.joint_intensity(fact)
    trend = facts.series_trend(year_means(prices), "state", "year", "value", min_points=7).select("state", (F.col("trend") / 10000).alias("precip_trend_yr"))
    late = facts.late_minus_early(month_means(prices), "state", "month", "value").select("state", (F.col("late_minus_early") / 100000).alias("gw_trend_ft"))
    measures = metrics.state_measures(crops_of(spark, d, fact), soil_states(spark, d), {"NATION_1": 0.3, "NATION_2": 0.2}, ["ECONOMY", "SMALL"], be_digits=4)
    out = facts.chain_left(measures, [facts.survey_table(by_year, "state", "intensity", SURVEYS), trend, late], "state")
    out = out.withColumnsRenamed({"opp_value_M": "opp_value_m", "virtual_water_B": "virtual_water_b"})
    return out.withColumn("vuln_score", metrics.vulnerability())


_REST = CROPS[len(FACTS):]
STATES = (_CHANGE + _REST + _SUMMARY[len(CROPS):] + f""", {_OPP}, {_VW}, {SERIES.strip()},
tr AS (SELECT state, CASE WHEN count(*) >= 7 THEN round(regr_slope(value, i), 4) END / 10000 AS precip_trend_yr FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY year) - 1 AS i FROM yearly) GROUP BY 1),
lt AS (SELECT state, CASE WHEN count(*) >= 8 THEN round(avg(CASE WHEN z <= 5 THEN value END) - avg(CASE WHEN u <= 5 THEN value END), 2) END / 100000 AS gw_trend_ft FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY month) AS u, row_number() OVER (PARTITION BY state ORDER BY month DESC) AS z FROM monthly) GROUP BY 1),
conc AS (SELECT state, round(sum(w * w) / (sum(w) * sum(w)), 4) AS hhi FROM (SELECT state, wi * area AS w FROM crops WHERE wi * area > 0) GROUP BY 1),
states0 AS (SELECT s.*, round(wy.a, 3) AS intensity_1996, round(wy.m, 3) AS intensity_1998, round(wy.b, 3) AS intensity_2000, trend_pct, trend_abs, hhi, opp_value_m, opp_crop, virtual_water_b, precip_trend_yr, gw_trend_ft, good_ratio AS soil_good_ratio
FROM summary s LEFT JOIN wide_y wy ON wy.state = s.state LEFT JOIN trend t ON t.state = s.state LEFT JOIN conc ON conc.state = s.state LEFT JOIN opp ON opp.state = s.state LEFT JOIN vw ON vw.state = s.state
LEFT JOIN tr ON tr.state = s.state LEFT JOIN lt ON lt.state = s.state LEFT JOIN soil ON soil.state = s.state),
states AS (SELECT *, round(CASE WHEN avg_intensity > 0 THEN avg_intensity * ((CASE WHEN precip_trend_yr < 0 THEN 1 + abs(precip_trend_yr) * 0.5::DOUBLE ELSE 1 END)
* (CASE WHEN gw_trend_ft > 0 THEN 1 + gw_trend_ft * 0.1::DOUBLE ELSE 1 END) * (CASE WHEN trend_pct > 0 THEN 1 + trend_pct / 10 * 0.15::DOUBLE ELSE 1 END))
/ CASE WHEN avg_dpg_cents > 0 THEN avg_dpg_cents ELSE 1 END END, 4) AS vuln_score FROM states0)""")


def states(spark, d):
    """The state roll-up as a persisted product."""
    return product(spark, d, "states", lambda: state_measures(spark, d))


@query("d12_vulnerability", f"{STATES} SELECT state, precip_trend_yr, gw_trend_ft, trend_pct, vuln_score FROM states")
def d12(spark, d):
    return state_measures(spark, d).select("state", "precip_trend_yr", "gw_trend_ft", "trend_pct", "vuln_score")


SALES = f"""{STATES}, sales AS (SELECT n_name AS state, round(sum(o_totalprice) FILTER (year(o_orderdate) = 2000 AND n_nationkey <> 4), 2) AS s1,
round(sum(o_totalprice) FILTER (year(o_orderdate) = 1997), 2) AS s2 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
m AS (SELECT s.*, coalesce(nullif(round(s1 / 1e6, 1), 0), nullif(round(s2 / 1e6, 1), 0)) AS ag_sales_m FROM states s LEFT JOIN sales ON sales.state = s.state),
paid AS (SELECT *, round(ag_sales_m * 1e6 / CASE WHEN total_irr_area > 0 AND avg_intensity > 0 THEN total_irr_area * avg_intensity END, 1) AS ag_per_af FROM m)"""


def paid_states(spark, d):
    """The state roll-up with sales per acre-foot. Orders are merged per customer before they meet the customers; one nation did not report the first year."""
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    y = F.year("o_orderdate")
    sums = {"s1": F.sum(F.when(y == 2000, F.col("o_totalprice"))), "s2": F.sum(F.when(y == 1997, F.col("o_totalprice")))}
    per = o.groupBy("o_custkey").agg(*[e.alias(k) for k, e in sums.items()])
    named = per.join(c, per.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    sales = named.groupBy(F.col("n_name").alias("state")).agg(F.round(F.sum(F.when(F.col("n_nationkey") != 4, F.col("s1"))), 2).alias("s1"), F.round(F.sum("s2"), 2).alias("s2"))
    return metrics.sales_per_water(states(spark, d).join(sales, "state", "left"), "s1", "s2").withColumnRenamed("ag_sales_M", "ag_sales_m")


@query("d11_sales_per_water", f"{SALES} SELECT state, ag_sales_m, ag_per_af FROM paid")
def d11(spark, d):
    return paid_states(spark, d).select("state", "ag_sales_m", "ag_per_af")


@query("a29_national_panel", f"""{STATES}, dr AS (SELECT event_type, round(100 * sum(value) / sum(sum(value)) OVER (), 1) AS drought_pct FROM events GROUP BY 1)
SELECT sum(total_irr_area) AS total_area, round(sum(virtual_water_b), 6) AS total_virtual_water, round(sum(opp_value_m), 3) AS total_opp, round(avg(nullif(avg_intensity, 0)), 6) AS avg_intensity,
(SELECT round(avg(drought_pct) FILTER (drought_pct > 0), 0) FROM dr) AS nat_drought_pct FROM states""")
def a29(spark, d):
    e = table(spark, d, "events")
    total = e.agg(F.sum("value").alias("t"))
    dr = ranks.with_scalars(e.groupBy("event_type").agg(F.sum("value").alias("v")), total).select(F.round(100 * F.col("v") / F.col("t"), 1).alias("drought_pct"))
    s = states(spark, d).withColumnsRenamed({"virtual_water_b": "virtual_water_B", "opp_value_m": "opp_value_M"})
    p = profile.national_panel(s, dr)
    return p.select("total_area", F.round("total_virtual_water", 6).alias("total_virtual_water"), F.round("total_opp", 3).alias("total_opp"),
                    F.round("avg_intensity", 6).alias("avg_intensity"), "nat_drought_pct")


_NORMED = {"avg_intensity": "norm", "avg_dpg_cents": "norm_dpg", "trend_pct": "norm_trend", "hhi": "norm_hhi", "opp_value_m": "norm_opp", "virtual_water_b": "norm_vw",
           "vuln_score": "norm_vuln", "precip_trend_yr": "norm_precip", "gw_trend_ft": "norm_gw"}


def _norm_sql(col: str, name: str, reverse: bool, src: str = "states") -> str:
    lo = f"(SELECT list_sort(list({col}))[CAST(floor(count({col}) * 0.05::DOUBLE) AS BIGINT) + 1] FROM {src})"
    hi = f"(SELECT list_sort(list({col}))[least(count({col}) - 1, CAST(floor(count({col}) * 0.95::DOUBLE) AS BIGINT)) + 1] FROM {src})"
    z = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({col} - {lo}) / greatest({hi} - {lo}, 1e-6)))"
    return f"CASE WHEN {col} IS NOT NULL THEN round({'1 - ' if reverse else ''}{z}, 3) END AS {name}"


@query("w7_robust_norm", f"{STATES}, ss AS (SELECT * FROM states) SELECT state, " + ", ".join(
    _norm_sql(c, n, c == "trend_pct", "(SELECT * FROM ss WHERE " + c + " IS NOT NULL)") for c, n in _NORMED.items()) + " FROM ss")
def w7(spark, d):
    return ranks.robust_norm(states(spark, d), _NORMED, reverse=["trend_pct"]).select("state", *_NORMED.values())


_YR = [f"intensity_{y}" for y in SURVEYS]


def _shared_sql(col: str) -> str:
    lo = "(SELECT list_sort(list(v))[CAST(floor(count(v) * 0.05::DOUBLE) AS BIGINT) + 1] FROM yv)"
    hi = "(SELECT list_sort(list(v))[least(count(v) - 1, CAST(floor(count(v) * 0.95::DOUBLE) AS BIGINT)) + 1] FROM yv)"
    return f"CASE WHEN {col} IS NOT NULL THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({col} - {lo}) / greatest({hi} - {lo}, 1e-6))), 3) END AS {col.replace('intensity', 'norm')}"


_YV = "yv AS (" + " UNION ALL ".join(f"SELECT {c} AS v FROM states WHERE {c} IS NOT NULL" for c in _YR) + ")"


@query("w7b_shared_scale", f"{STATES}, {_YV} SELECT state, " + ", ".join(_shared_sql(c) for c in _YR) + " FROM states")
def w7b(spark, d):
    return ranks.robust_norm(states(spark, d), {c: c.replace("intensity", "norm") for c in _YR}, shared=[_YR]).select("state", *[c.replace("intensity", "norm") for c in _YR])


@query("flagship_state_rollup", f"""{STATES}, ss AS (SELECT * FROM states), nrm AS (SELECT state, {_norm_sql('avg_intensity', 'norm', False, '(SELECT * FROM ss WHERE avg_intensity IS NOT NULL)')},
{_norm_sql('hhi', 'norm_hhi', False, '(SELECT * FROM ss WHERE hhi IS NOT NULL)')} FROM ss)
SELECT s.state, avg_intensity, avg_dpg_cents, trend_pct, hhi, opp_value_m, vuln_score, norm, norm_hhi FROM states s JOIN nrm ON nrm.state = s.state""")
def flagship(spark, d):
    s = stage(state_measures(spark, d), "states")  # one row per state; percentiles and rows read it
    n = ranks.robust_norm(s, {"avg_intensity": "norm", "hhi": "norm_hhi"})
    return n.select("state", "avg_intensity", "avg_dpg_cents", "trend_pct", "hhi", "opp_value_m", "vuln_score", "norm", "norm_hhi")
