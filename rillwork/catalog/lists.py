"""Ranked lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork.catalog.base import CROPS, GROUPS, RANKED, WIDE, crops, query, ranked, table, wide
from rillwork import config
from rillwork.catalog.entities import COUNTY, d13
from rillwork.catalog.rollups import SALES, STATES, _NATIONAL, paid_states, states
from rillwork.functions import columns as X
from rillwork.operators import facts, ranks, screens


def national(spark, d):
    return facts.national_crops(crops(spark, d), groups=GROUPS)


@query("t1_thirsty_crops", f"WITH {_NATIONAL} SELECT row_number() OVER (ORDER BY avg_water_int DESC, crop)::INT AS rank, crop, avg_water_int, round(avg_water_int / max(avg_water_int) OVER () * 100, 0) AS bar FROM nat WHERE crop <> 'PROMO' ORDER BY avg_water_int DESC, crop LIMIT 12")
def t1(spark, d):
    return screens.top_list(national(spark, d), "avg_water_int", "crop", bar=True, exclude=["PROMO"])


@query("t2_valuable_crops", f"WITH {_NATIONAL} SELECT row_number() OVER (ORDER BY avg_dpg_cents DESC, crop)::INT AS rank, crop, avg_dpg_cents, round(avg_dpg_cents / max(avg_dpg_cents) OVER () * 100, 0) AS bar FROM nat WHERE avg_dpg_cents IS NOT NULL ORDER BY 1 LIMIT 12")
def t2(spark, d):
    return screens.top_list(national(spark, d), "avg_dpg_cents", "crop", bar=True)


def _state_list(measure: str, order: str, where: str = "", n: int = 12, cols: str = "") -> str:
    return (f"{STATES} SELECT row_number() OVER (ORDER BY {order}, state)::INT AS rank, state, {measure}{cols} FROM states WHERE {measure} IS NOT NULL {where} ORDER BY 1 LIMIT {n}")


@query("t3_trend_states", _state_list("trend_pct", "abs(trend_pct) DESC"))
def t3(spark, d):
    return screens.top_list(states(spark, d), "trend_pct", "state", by_size=True)


@query("t4_opportunity_states", _state_list("opp_value_m", "opp_value_m DESC", cols=", opp_crop"))
def t4(spark, d):
    return screens.top_list(states(spark, d), "opp_value_m", "state", extra=["opp_crop"])


@query("t5_vulnerable_states", _state_list("vuln_score", "vuln_score DESC", cols=", CASE WHEN vuln_score >= 40 THEN 'extreme' WHEN vuln_score >= 30 THEN 'high' WHEN vuln_score >= 20 THEN 'medium' ELSE 'low' END AS band"))
def t5(spark, d):
    bands = X.band("vuln_score", [(40, "extreme"), (30, "high"), (20, "medium")], "low")
    return screens.top_list(states(spark, d), "vuln_score", "state", bands=bands)


@query("t6_concentrated_states", _state_list("hhi", "hhi DESC"))
def t6(spark, d):
    return screens.top_list(states(spark, d), "hhi", "state")


@query("t6b_drying_states", _state_list("precip_trend_yr", "precip_trend_yr ASC", cols=", CASE WHEN precip_trend_yr < -0.3 THEN 'fast' WHEN precip_trend_yr < -0.1 THEN 'slow' ELSE 'stable' END AS band"))
def t6b(spark, d):
    bands = X.band("precip_trend_yr", [(-0.3, "fast"), (-0.1, "slow")], "stable", ascending=True)
    return screens.top_list(states(spark, d), "precip_trend_yr", "state", ascending=True, bands=bands)


@query("t6c_virtual_water_states", _state_list("virtual_water_b", "virtual_water_b DESC", "AND virtual_water_b > 0"))
def t6c(spark, d):
    return screens.top_list(states(spark, d), "virtual_water_b", "state", positive=True)


@query("t7_county_water", f"WITH {WIDE} SELECT row_number() OVER (ORDER BY est_water_af DESC, fips)::INT AS rank, fips, est_water_af, round(est_water_af / max(est_water_af) OVER () * 100, 0) AS bar, county, state FROM wide WHERE est_water_af > 0 ORDER BY 1 LIMIT 12")
def t7(spark, d):
    return screens.top_list(wide(spark, d), "est_water_af", "fips", bar=True, positive=True, extra=["county", "state"])


@query("t6d_dollars_per_af", f"{SALES} SELECT row_number() OVER (ORDER BY ag_per_af DESC, state)::INT AS rank, state, ag_per_af, round(ag_per_af / max(ag_per_af) OVER () * 100, 0) AS bar FROM paid WHERE ag_per_af > 0 ORDER BY 1 LIMIT 12")
def t6d(spark, d):
    return screens.top_list(paid_states(spark, d), "ag_per_af", "state", bar=True, positive=True)


def _county_list(measure: str, extra: str) -> str:
    return f"WITH {COUNTY} SELECT row_number() OVER (ORDER BY {measure} DESC, fips)::INT AS rank, fips, {measure}, round({measure} / max({measure}) OVER () * 100, 0) AS bar, {extra} FROM county WHERE {measure} > 0 ORDER BY 1 LIMIT 12"


@query("t7b_county_opportunity", _county_list("opp_value_m", "state, top_crop"))
def t7b(spark, d):
    return screens.top_list(d13(spark, d), "opp_value_m", "fips", bar=True, positive=True, extra=["state", "top_crop"])


@query("t7c_county_area", _county_list("total_area", 'top_crop, "group"'))
def t7c(spark, d):
    return screens.top_list(d13(spark, d), "total_area", "fips", bar=True, positive=True, extra=["top_crop", "group"])


_GRID = [200.0, 400.0, 600.0, 800.0]


@query("t8_price_sensitivity", f"""WITH {_NATIONAL}, x AS (SELECT *, unnest([200.0, 400.0, 600.0, 800.0])::DOUBLE AS price FROM nat WHERE avg_breakeven IS NOT NULL),
r AS (SELECT *, avg_breakeven <= price AS profitable, row_number() OVER (PARTITION BY price, avg_breakeven <= price ORDER BY avg_water_int DESC, crop)::INT AS rank FROM x) SELECT price, profitable, rank, crop, avg_breakeven FROM r WHERE rank <= 6""")
def t8(spark, d):
    prices = spark.createDataFrame([(p,) for p in _GRID], "price double")
    return screens.price_sensitivity(national(spark, d), prices)


@query("t8b_sensitivity_curve", f"{STATES}, x AS (SELECT avg_breakeven, unnest([200.0, 400.0, 600.0, 800.0])::DOUBLE AS price FROM states WHERE avg_breakeven IS NOT NULL) SELECT price, count(*) FILTER (avg_breakeven <= price) AS n_profit, count(*) FILTER (avg_breakeven > price) AS n_loss FROM x GROUP BY 1")
def t8b(spark, d):
    return screens.sensitivity_curve(states(spark, d), spark.createDataFrame([(p,) for p in _GRID], "price double"))


@query("t8c_profit_flags", f"{STATES} SELECT state, price, avg_breakeven <= price AS profitable, round(price - avg_breakeven, 4) AS margin FROM states, (SELECT unnest([200.0, 400.0, 600.0, 800.0])::DOUBLE AS price) WHERE avg_breakeven IS NOT NULL")
def t8c(spark, d):
    return screens.profit_flags(states(spark, d), spark.createDataFrame([(p,) for p in _GRID], "price double"))


_DROUGHT = "dr AS (SELECT event_type, round(100 * sum(value) / sum(sum(value)) OVER (), 1) AS drought_pct FROM events GROUP BY 1)"


def _ranked(name: str, source: str, key: str, measure: str, n: int, order: str, where: str) -> str:
    return (f"SELECT * FROM (SELECT '{name}' AS list, {key} AS name, {measure} AS v, row_number() OVER (ORDER BY {measure} {order}, {key})::INT AS rank "
            f"FROM {source} WHERE {where}) WHERE rank <= {n}")


@query("t9_national_lists", f"{SALES}, {_NATIONAL[len(CROPS) + 2:]}, {_DROUGHT} " + " UNION ALL ".join([
    _ranked("top", "paid", "state", "ag_per_af", 5, "DESC", "ag_per_af > 0"), _ranked("bottom", "paid", "state", "ag_per_af", 5, "ASC", "ag_per_af > 0"),
    _ranked("vulnerable", "paid", "state", "vuln_score", 5, "DESC", "vuln_score > 0"), _ranked("thirsty", "nat", "crop", "avg_water_int", 6, "DESC", "crop <> 'PROMO' AND avg_water_int > 0"),
    _ranked("drying", "paid", "state", "precip_trend_yr", 3, "ASC", "precip_trend_yr < 0 AND avg_intensity > 0"), _ranked("drought", "dr", "event_type", "drought_pct", 3, "DESC", "drought_pct > 0")]))
def t9(spark, d):
    s = paid_states(spark, d)
    e = table(spark, d, "events")
    total = e.agg(F.sum("value").alias("t"))
    dry = ranks.with_scalars(e.groupBy("event_type").agg(F.sum("value").alias("v")), total).select("event_type", F.round(100 * F.col("v") / F.col("t"), 1).alias("drought_pct"))

    def part(name, rows, measure, key="state", n=5, **kw):
        return screens.top_list(rows, measure, key, n=n, **kw).select(F.lit(name).alias("list"), F.col(key).alias("name"), F.col(measure).cast("double").alias("v"), "rank")

    lists = [part("top", s, "ag_per_af", positive=True), part("bottom", s, "ag_per_af", positive=True, ascending=True), part("vulnerable", s, "vuln_score", positive=True),
             part("thirsty", national(spark, d), "avg_water_int", "crop", 6, positive=True, exclude=["PROMO"]),
             part("drying", s.where("precip_trend_yr < 0 AND avg_intensity > 0"), "precip_trend_yr", n=3, ascending=True), part("drought", dry, "drought_pct", "event_type", 3, positive=True)]
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x)
    return out


_RANKED_FEATURES = [*config.CLIMATE, *config.SOIL, *config.HUMAN]


@query("t11_strongest", f"WITH {WIDE}, c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, log_crop_water_eff), 6) AS r FROM wide" for c in _RANKED_FEATURES)
       + ") SELECT row_number() OVER (ORDER BY abs(r) DESC, feature)::INT AS rank, feature, r FROM c WHERE r IS NOT NULL ORDER BY 1 LIMIT 5")
def t11(spark, d):
    agg = wide(spark, d).agg(*[F.round(F.corr(c, "log_crop_water_eff"), 6).alias(c) for c in _RANKED_FEATURES]).unpivot([], _RANKED_FEATURES, "feature", "r")
    return screens.top_list(agg, "r", "feature", n=5, by_size=True)


@query("t12_crop_names", f"""WITH {CROPS} SELECT state, coalesce(string_agg(crop, ', ' ORDER BY crop) FILTER (coalesce(wi, 0) > 4.5), '') AS high_water, coalesce(string_agg(crop, ', ' ORDER BY crop) FILTER (dpg_cents < 0.1), '') AS low_value,
coalesce(string_agg(crop, ', ' ORDER BY crop) FILTER (dpg_cents > 0.15), '') AS high_value FROM crops WHERE crop <> 'PROMO' GROUP BY 1""")
def t12(spark, d):
    return screens.crop_name_lists(crops(spark, d), thirsty=4.5, poor=0.1, rich=0.15, exclude=["PROMO"])
