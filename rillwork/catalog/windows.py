"""Ranks, year picks, snapshots, running shares and scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.catalog.base import CROPS, FACTS, GROUPS, PREFS, RANKED, SERIES, WIDE, crops, query, ranked, table, wi_area, wide, wide_index, yearly
from rillwork.catalog.rollups import STATES, states
from rillwork.functions import columns as X
from rillwork.operators import facts, metrics, models, ranks, screens


@query("w1_rank_pct", "SELECT c_custkey, round((rank() OVER (ORDER BY round(c_acctbal, 0)) + (count(*) OVER (PARTITION BY round(c_acctbal, 0)) - 1) / 2.0::DOUBLE) / count(*) OVER (), 6) AS pct FROM customer")
def w1(spark, d):
    c = table(spark, d, "customer").withColumn("v", F.round("c_acctbal", 0))
    return ranks.rank_pct(c, "v", "pct", digits=6).select("c_custkey", "pct")


@query("w1b_rank_pre_round", f"WITH {RANKED} SELECT fips, CASE WHEN crop_water_eff IS NOT NULL THEN round(round((rank() OVER (ORDER BY crop_water_eff NULLS LAST) + (count(*) OVER (PARTITION BY crop_water_eff) - 1) / 2.0::DOUBLE) "
       "/ count(crop_water_eff) OVER (), 3) * 100, 1) END AS pct FROM wide")
def w1b(spark, d):
    return ranks.rank_pct(wide(spark, d), "crop_water_eff", "pct", scale=100.0, digits=1, pre_round=3, index=wide_index(spark, d)).select("fips", "pct")


@query("w2_best_year", f"WITH {CROPS} SELECT state, crop, year, round(wi, 6) AS wi, round(area, 6) AS area FROM best")
def w2(spark, d):
    best = facts.best_year(facts.all_facts(*wi_area(spark, d)), PREFS)
    return best.select("state", "crop", "year", F.round("wi", 6).alias("wi"), F.round("area", 6).alias("area"))


@query("w3_preferred_or_latest", """WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)
SELECT o_custkey, year, v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (year = 1998) DESC, year DESC) AS rn FROM y) WHERE rn = 1""")
def w3(spark, d):
    y = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return facts.preferred_or_latest(y, "o_custkey", "year", ["v"], 1998)


@query("w3b_first_of_years", """WITH y AS (SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS year, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1, 2)
SELECT o_custkey, coalesce(max(CASE WHEN year = 1999 THEN v END), max(CASE WHEN year = 1997 THEN v END), max(CASE WHEN year = 1995 THEN v END)) AS v FROM y GROUP BY 1""")
def w3b(spark, d):
    y = table(spark, d, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return y.groupBy("o_custkey").agg(facts.first_of_years("v", "year", [1999, 1997, 1995]).alias("v"))


def _drought(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("user_id", "event_id", "ts", *[F.when(F.col("event_type") == t, k).otherwise("").alias(c) for c, t in zip(("D0", "D1", "D2", "D3", "D4"), ("view", "signup", "click", "purchase", "error"))])


_LATEST = """l AS (SELECT * FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"""


@query("w4_latest_snapshot", f"WITH {_LATEST} SELECT user_id, event_id, event_type, k FROM l")
def w4(spark, d):
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").try_cast("double"))
    return facts.latest_by(e, "user_id", "ts", ["event_id", "event_type", "k"], tie="event_id").select("user_id", "event_id", "event_type", "k")


@query("d14_drought_classes", f"WITH {_LATEST} SELECT user_id, CASE WHEN event_type = 'signup' THEN round(k, 1) ELSE 0 END AS d1, CASE WHEN event_type IN ('signup', 'click', 'purchase', 'error') THEN round(k, 1) ELSE 0 END AS drought_pct, "
       "CASE WHEN event_type IN ('click', 'purchase', 'error') THEN round(k, 1) ELSE 0 END AS severe_pct FROM l")
def d14(spark, d):
    last = facts.latest_by(_drought(spark, d), "user_id", "ts", ["event_id", "D0", "D1", "D2", "D3", "D4"], tie="event_id")
    v = metrics.drought_classes()
    return last.select("user_id", v["d1"].alias("d1"), v["drought_pct"].alias("drought_pct"), v["severe_pct"].alias("severe_pct"))


@query("w5_pareto", f"""WITH {WIDE}, r AS (SELECT est_water_af AS v, row_number() OVER (ORDER BY est_water_af DESC, fips) AS i, sum(est_water_af) OVER (ORDER BY est_water_af DESC, fips ROWS UNBOUNDED PRECEDING) AS cum, sum(est_water_af) OVER () AS t FROM wide WHERE est_water_af > 0)
SELECT min(CASE WHEN cum >= t * 0.5 THEN i END) AS top50pct, min(CASE WHEN cum >= t * 0.8 THEN i END) AS top80pct, count(*) AS total_entities, round(max(t), 2) AS total FROM r""")
def w5(spark, d):
    return ranks.pareto(wide(spark, d), "est_water_af", index=ranks.positive(wide_index(spark, d), "est_water_af")).withColumn("total", F.round("total", 2))


@query("w6_rank_and_share", f"WITH {WIDE} SELECT fips, CASE WHEN est_water_af IS NOT NULL THEN rank() OVER (ORDER BY est_water_af DESC NULLS LAST) END AS rank, round(est_water_af / sum(est_water_af) OVER () * 100, 6) AS share FROM wide")
def w6(spark, d):
    return ranks.rank_and_share(wide(spark, d), "est_water_af", index=wide_index(spark, d)).select("fips", "rank", F.round(F.col("share") * 100, 6).alias("share"))


@query("w7c_county_norm", f"""WITH {WIDE}, q AS (SELECT list_sort(list(irrigated_area_ac)) AS s, count(irrigated_area_ac) AS n FROM wide WHERE irrigated_area_ac > 0)
SELECT fips, CASE WHEN irrigated_area_ac IS NOT NULL THEN round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (irrigated_area_ac - s[CAST(floor(n * 0.05::DOUBLE) AS BIGINT) + 1])
/ greatest(s[least(n - 1, CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) + 1] - s[CAST(floor(n * 0.05::DOUBLE) AS BIGINT) + 1], 1e-6))), 3) END AS norm_area FROM wide, q""")
def w7c(spark, d):
    return ranks.robust_norm(wide(spark, d), {"irrigated_area_ac": "norm_area"}, positive_only=True, index=ranks.positive(wide_index(spark, d), "irrigated_area_ac")).select("fips", "norm_area")


@query("w8_min_max_risk", f"""WITH {WIDE}, m AS (SELECT *, min(precip_deficit_in) OVER () AS a, max(precip_deficit_in) OVER () AS b, min(irrigated_area_ac) OVER () AS e, max(irrigated_area_ac) OVER () AS f FROM wide WHERE irrigated_area_ac IS NOT NULL)
SELECT fips, round((precip_deficit_in - a) / (b - a) + (irrigated_area_ac - e) / (f - e), 6) AS risk_score FROM m""")
def w8(spark, d):
    return screens.risk_score(wide(spark, d).where("irrigated_area_ac IS NOT NULL"), "precip_deficit_in", "irrigated_area_ac").select("fips", F.round("risk_score", 6).alias("risk_score"))


@query("w9_state_ranks", f"""{STATES} SELECT state, rank() OVER (ORDER BY avg_intensity DESC) AS rank_avg_intensity, rank() OVER (ORDER BY hhi DESC) AS rank_hhi,
round(avg(nullif(avg_intensity, 0)) OVER (), 2) AS nat_avg_avg_intensity, round(avg(nullif(hhi, 0)) OVER (), 2) AS nat_avg_hhi FROM states""")
def w9(spark, d):
    return screens.state_ranks(states(spark, d), ["avg_intensity", "hhi"]).select("state", "rank_avg_intensity", "rank_hhi", "nat_avg_avg_intensity", "nat_avg_hhi")


@query("w10b_adjacent_change", f"WITH {SERIES} SELECT state, year, round((value - lag(value) OVER w) / nullif(lag(value) OVER w, 0) * 100, 1) AS change_pct FROM yearly WINDOW w AS (PARTITION BY state ORDER BY year)")
def w10b(spark, d):
    return facts.adjacent_change(yearly(spark, d), "state", "value").select("state", "year", "change_pct")


_CURVE = "c AS (SELECT l_linenumber AS k, round(sum(l_quantity), 2) AS cost FROM lineitem GROUP BY 1)"


def _curve(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.sum("l_quantity"), 2).alias("cost"))


@query("w11_elbow", f"""WITH {_CURVE}, x AS (SELECT k, cost, cost - lag(cost) OVER (ORDER BY k) AS d1 FROM c), y AS (SELECT *, d1 - lag(d1) OVER (ORDER BY k) AS d2 FROM x)
SELECT least((SELECT max(k) FROM c), greatest((SELECT min(k) FROM c), (SELECT k FROM y WHERE d2 IS NOT NULL ORDER BY d2 DESC, k LIMIT 1) - 1))::INT AS best_k""")
def w11(spark, d):
    return models.elbow_k(_curve(spark, d))


@query("w12_nested_top", f"""WITH {CROPS}, r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY coalesce(area * wi, 0) DESC, crop) AS rn FROM crops)
SELECT state, string_agg(crop || ':' || "year", '|' ORDER BY rn) AS top FROM r WHERE rn <= 20 GROUP BY 1""")
def w12(spark, d):
    n = facts.nested_top(crops(spark, d), "state", F.coalesce(F.col("area") * F.col("wi"), F.lit(0.0)), ["crop", "year"], k=20)
    return n.select("state", F.array_join(F.transform("top_crops", lambda s: F.concat_ws(":", s["crop"], s["year"].cast("string"))), "|").alias("top"))
