"""Long facts and roll-ups: records to (key, year) measures, year picks, series statistics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rillwork import config
from rillwork.functions import columns as X

# -- records to facts -----------------------------------------------------------------------------------------


def positive_mean(records: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Mean of the positive values per key."""
    return records.where(F.col(value) > 0).groupBy(*keys).agg(F.avg(value).alias(out))


def partial_means(records: DataFrame, keys: Sequence[str], measures: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Sums and counts of several positive measures in one pass; measure -> (value, row condition).

    Grouping by a join key first and joining the (far fewer) partial rows afterwards moves the wide shuffle behind
    the aggregation.
    """
    aggs = []
    for name, (value, cond) in measures.items():
        v = F.when(cond & (value > 0), value)
        aggs += [F.sum(v).alias(f"_{name}_s"), F.count(v).alias(f"_{name}_n")]
    return records.groupBy(*keys).agg(*aggs)


def merge_means(partials: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Partial sums and counts to means; keys without any value drop out."""
    aggs = [X.ratio(F.sum(f"_{m}_s"), F.sum(f"_{m}_n")).alias(m) for m in measures]
    return partials.groupBy(*keys).agg(*aggs).dropna(how="all", subset=list(measures))


def split_measures(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The joint fact table as its two single facts."""
    keys = ["state", "crop", "year"]
    return (facts.where(F.col("wi").isNotNull()).select(*keys, "wi"), facts.where(F.col("area").isNotNull()).select(*keys, "area"))


def record_measure(records: DataFrame, out: str) -> DataFrame:
    """Raw record rows (state_alpha, commodity_desc, year, Value) to mean positive measure per (state, crop, year)."""
    typed = records.select(F.upper("state_alpha").alias("state"), F.upper(F.trim("commodity_desc")).alias("crop"),
                           F.col("year").try_cast("int").alias("year"), X.parse_number("Value").alias("v"))
    typed = typed.where((F.col("state") != "") & (F.col("crop") != ""))
    return positive_mean(typed, ["state", "crop", "year"], "v", out)


def price_means(records: DataFrame) -> DataFrame:
    """Mean positive price per (price_crop, price_unit) over dollar units."""
    typed = records.where(F.col("unit_desc").startswith("$")).select(
        F.upper(F.trim("commodity_desc")).alias("price_crop"), F.col("unit_desc").alias("price_unit"),
        X.parse_number("Value").alias("v"))
    return positive_mean(typed, ["price_crop", "price_unit"], "v", "price")


def last_value(records: DataFrame, keys: Sequence[str], value: str, order: str, out: str | None = None) -> DataFrame:
    """Duplicate records of a key: the one with the highest ordinal wins (an aggregate, so hot keys combine early)."""
    return records.groupBy(*keys).agg(F.max_by(value, order).alias(out or value))


def entity_totals(records: DataFrame, key: str, value: str, order: str, attrs: Sequence[str], out: str) -> DataFrame:
    """Sum of positive values per entity with the attributes of its last record."""
    return records.where(F.col(value) > 0).groupBy(key).agg(
        F.sum(value).alias(out), *[F.max_by(a, order).alias(a) for a in attrs])


def category_total(value: str, text: str, words: Sequence[str], earlier: Sequence[str] = ()) -> Column:
    """Conditional sum over rows whose text contains a word and none of the words tested before it."""
    hit = reduce(lambda a, b: a | b, [F.col(text).contains(w) for w in words])
    for w in earlier:
        hit = hit & ~F.col(text).contains(w)
    return F.sum(F.when(hit, F.col(value)))


def tenure_ratio(records: DataFrame, key: str, value: str, text: str,
                 full: str = "FULL OWNER", tenant: str = "TENANT", part: str = "PART OWNER") -> DataFrame:
    """(tenant + half of part owners) / all owned; categories are tested in this order."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    sums = records.groupBy(key).agg(
        category_total(value, text, [full]).alias("full_ac"),
        category_total(value, text, [tenant], [full]).alias("tenant_ac"),
        category_total(value, text, [part], [full, tenant]).alias("part_ac"))
    total = z("full_ac") + z("tenant_ac") + z("part_ac")
    return sums.where(total > 0).select(key, F.round((z("tenant_ac") + z("part_ac") * 0.5) / total, 3).alias("tenant_ratio"))


def two_level_rates(records: DataFrame, key: str, year: str, premium: str, indemnity: str) -> DataFrame:
    """Loss rate and mean yearly premium per key in one pass: sums and the distinct year count."""
    agg = records.groupBy(key, year).agg(F.sum(premium).alias("p"), F.sum(indemnity).alias("i")) \
                 .groupBy(key).agg(F.sum("p").alias("p"), F.sum("i").alias("i"), F.count(year).alias("years"))
    return agg.where(F.col("p") > 0).select(key, F.round(F.col("i") / F.col("p"), 3).alias("insurance_loss_rate"),
                                            F.round(F.col("p") / F.col("years"), 0).alias("insurance_premium_avg"))


def annual_inches(daily: DataFrame, key: str, date: str, value: str) -> DataFrame:
    """Daily tenth-millimetre readings to yearly inches; null when a year has no readable value."""
    return daily.groupBy(key, F.year(date).alias("year")).agg(
        X.tenth_mm_to_inch(F.sum(value)).alias("inches"), F.count(value).alias("n_readings"))


def mean_and_latest(df: DataFrame, key: str, year: str, value: str, prefix: str, digits: int = 2) -> DataFrame:
    """Mean over years and the value of the latest year."""
    return df.groupBy(key).agg(F.round(F.avg(value), digits).alias(f"{prefix}_avg"),
                               F.max_by(value, year).alias(f"{prefix}_latest"))


# -- soil -------------------------------------------------------------------------------------------------------


def soil_horizons(chorizon: DataFrame, component: DataFrame, mapunit: DataFrame, legend: DataFrame,
                  laoverlap: DataFrame, max_depth: float = 100.0) -> DataFrame:
    """Mean horizon properties to a depth, per (survey-area prefix, county): a five-way join.

    Horizons are merged per map unit before they meet the legends, of which there are few.
    """
    measures = {"awc_r": "awc_mean", "sandtotal_r": "sand_pct", "claytotal_r": "clay_pct", "om_r": "organic_matter"}
    per_unit = (chorizon.where(F.col("hzdepb_r") <= max_depth).join(component.select("cokey", "mukey"), "cokey")
                .groupBy("mukey").agg(*[e for c in measures for e in (F.sum(c).alias(f"{c}_s"), F.count(c).alias(f"{c}_n"))]))
    sums = [e for c in measures for e in (F.sum(f"{c}_s").alias(f"{c}_s"), F.sum(f"{c}_n").alias(f"{c}_n"))]
    per_legend = per_unit.join(mapunit.select("mukey", "lkey"), "mukey").groupBy("lkey").agg(*sums)
    counties = laoverlap.where(F.col("areatypename") == "County or Parish").select("lkey", "areaname")
    joined = per_legend.join(legend.select("lkey", "areasymbol"), "lkey").join(counties, "lkey")
    out = joined.groupBy(F.substring("areasymbol", 1, 2).alias("state"), "areaname").agg(*sums)
    return out.select("state", "areaname", *[F.round(X.ratio(f"{c}_s", f"{c}_n"), 4).alias(o) for c, o in measures.items()])


def soil_classes(mapunit: DataFrame, legend: DataFrame, muaggatt: DataFrame,
                 good: Sequence[str] = config.GOOD_SOIL_CLASSES) -> DataFrame:
    """Acres by capability class per state, total and the share in good classes."""
    lines = (mapunit.where(F.col("muacres").isNotNull()).join(legend, "lkey")
             .join(muaggatt.where(F.col("iccdcd").isNotNull()), "mukey"))
    by_class = lines.groupBy(F.substring("areasymbol", 1, 2).alias("state"),
                             F.lower(F.trim("iccdcd")).alias("lcc")).agg(F.round(F.sum("muacres"), 0).alias("acres"))
    by_class = by_class.where(F.col("lcc") != "")
    out = by_class.groupBy("state").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("lcc", "acres")))).alias("by_class"),
        F.sum("acres").alias("total_acres"),
        F.sum(F.when(F.col("lcc").isin(list(good)), F.col("acres"))).alias("good_acres"))
    return out.where(F.col("total_acres") > 0).select(
        "state", "by_class", "total_acres",
        F.round(F.coalesce("good_acres", F.lit(0.0)) / F.col("total_acres"), 3).alias("good_ratio"))


# -- state x crop x year ----------------------------------------------------------------------------------------


def weighted_intensity(wi: DataFrame, area: DataFrame) -> DataFrame:
    """``joint_intensity`` of two single facts."""
    return joint_intensity(wi.join(area, ["state", "crop", "year"], "left"))


def joint_intensity(facts: DataFrame) -> DataFrame:
    """Area-weighted intensity per (state, year) of the joint facts; a year in which no state has a weight falls back to plain means."""
    has = F.col("area") != 0
    per_state = facts.where(F.col("wi").isNotNull()).groupBy("state", "year").agg(
        F.sum(F.when(has, F.col("wi") * F.col("area"))).alias("wx"), F.sum(F.when(has, F.col("area"))).alias("w"),
        F.avg("wi").alias("plain"))
    weighted_year = F.max(F.when(F.col("w") > 0, 1).otherwise(0)).over(Window.partitionBy("year"))
    per_state = per_state.withColumn("weighted_year", weighted_year)
    value = F.when(F.col("weighted_year") == 1, X.ratio("wx", "w")).otherwise(F.col("plain"))
    return per_state.select("state", "year", value.alias("intensity")).where(F.col("intensity").isNotNull())


def matched_facts(wi: DataFrame, area: DataFrame) -> DataFrame:
    """Facts present on both sides with a non-zero area."""
    return wi.join(area.where(F.col("area") != 0), ["state", "crop", "year"])


def all_facts(wi: DataFrame, area: DataFrame) -> DataFrame:
    """Union of the keys of both facts with whichever measures exist."""
    return wi.join(area, ["state", "crop", "year"], "full")


def best_year(facts: DataFrame, prefs: Sequence[int] = config.YEAR_PREFERENCE) -> DataFrame:
    """One year per (state, crop): the first preferred one present, else the earliest; both measures from it."""
    pref = F.coalesce(X.from_map("year", {y: i for i, y in enumerate(prefs)}), F.lit(len(prefs)))
    pick = F.min_by(F.struct("year", "wi", "area"), F.struct(pref.alias("p"), F.col("year").alias("y")))
    return facts.groupBy("state", "crop").agg(pick.alias("b")).select("state", "crop", "b.year", "b.wi", "b.area")


def crop_value(crops: DataFrame, prices: DataFrame, yields: Sequence[tuple] = config.YIELDS,
               groups: Mapping[str, Sequence[str]] = config.CROP_GROUPS) -> DataFrame:
    """Revenue per acre, dollars per gallon and break-even water price for each (state, crop)."""
    entry = crops.withColumn("_e", X.entry_for_name("crop", yields)) \
                 .withColumn("price_crop", F.col("_e.price_crop")).withColumn("price_unit", F.col("_e.price_unit"))
    got = entry.join(prices, ["price_crop", "price_unit"], "left")
    rev = X.filled(F.col("_e.rate") * F.col("price"))
    wi = F.when(F.col("wi") > 0, F.col("wi"))
    dpg, be = rev / (wi * config.GALLONS_PER_ACRE_FOOT), rev / wi
    return got.select(
        "state", "crop", "year", "wi", F.coalesce("area", F.lit(0.0)).alias("area"),
        X.keyword_group("crop", groups).alias("group"), F.round(rev, 2).alias("rev_per_acre"),
        X.filled(F.round(dpg, 6)).alias("dpg"), X.filled(F.round(dpg * 100, 4)).alias("dpg_cents"),
        X.filled(F.round(be, 1)).alias("breakeven")) \
        .withColumn("color", X.from_map("group", config.GROUP_COLORS, config.GROUP_COLORS["OTHER"]))


def summary_sums() -> dict[str, Column]:
    """Aggregates of the state summary over the crop table."""
    used = (F.col("wi") != 0) & (F.col("area") > 0)
    with_rev = used & (F.col("rev_per_acre") != 0)
    return {"wt": F.sum(F.when(used, F.col("wi") * F.col("area"))), "ar": F.sum(F.when(used, F.col("area"))),
            "rv": F.sum(F.when(with_rev, F.col("rev_per_acre") * F.col("area"))), "ra": F.sum(F.when(with_rev, F.col("area"))),
            "be": F.avg(F.when(F.col("area") > 0, F.col("breakeven"))), "n_crops": F.count(F.lit(1))}


def summary_columns(be_digits: int = 1) -> list[Column]:
    """Area-weighted intensity and revenue, derived value per gallon, mean break-even, counts."""
    wi, rev = X.ratio("wt", "ar"), X.ratio("rv", "ra")
    dpg = rev / (F.when(wi > 0, wi) * config.GALLONS_PER_ACRE_FOOT)
    return [F.round(wi, 3).alias("avg_intensity"), F.round(dpg, 6).alias("avg_dpg"),
            F.round(dpg * 100, 4).alias("avg_dpg_cents"), F.round("be", be_digits).alias("avg_breakeven"),
            F.round(F.coalesce("ar", F.lit(0.0)), 0).alias("total_irr_area"), F.col("n_crops")]


def state_summary(crops: DataFrame, be_digits: int = 1) -> DataFrame:
    """Summary measures of the crop table per state."""
    agg = crops.groupBy("state").agg(*[e.alias(k) for k, e in summary_sums().items()])
    return agg.select("state", *summary_columns(be_digits))


def concentration_sums(weight: Column) -> dict[str, Column]:
    w = F.when(weight > 0, weight)
    return {"cs": F.sum(w), "cs2": F.sum(w * w)}


def concentration_column(out: str = "hhi", digits: int = 4) -> Column:
    return F.round(X.ratio("cs2", F.col("cs") * F.col("cs")), digits).alias(out)


def concentration(df: DataFrame, keys: Sequence[str], weight: Column, out: str = "hhi", digits: int = 4) -> DataFrame:
    """Sum of squared shares per group in one pass; groups without a positive weight drop out."""
    agg = df.groupBy(*keys).agg(*[e.alias(k) for k, e in concentration_sums(weight).items()])
    return agg.where(F.col("cs").isNotNull()).select(*keys, concentration_column(out, digits))


def concentration_of(cols: Sequence[str], digits: int = 3) -> Column:
    """Sum of squared shares across columns of a row; null when they add up to zero."""
    vs = [F.coalesce(F.col(c), F.lit(0.0)) for c in cols]
    total = reduce(lambda a, b: a + b, vs)
    squares = reduce(lambda a, b: a + b, [v * v for v in vs])
    return F.when(total != 0, F.round(squares / (total * total), digits))


def largest(measure: Column, name: str = "crop") -> Column:
    """Aggregate: name with the largest measure; ties go to the smallest name."""
    return F.min_by(name, F.struct((-measure).alias("m"), F.col(name)))


def top_crop(crops: DataFrame, key: str, measure: Column, name: str = "crop", out: str = "top_crop") -> DataFrame:
    """Name with the largest measure per key."""
    return crops.groupBy(key).agg(largest(measure, name).alias(out))


def nested_top(crops: DataFrame, key: str, measure: Column, fields: Sequence[str], k: int = 20,
               tie: str = "crop", out: str = "top_crops") -> DataFrame:
    """Top k rows per key as an ordered array of structs; the cut happens before the rows are shuffled."""
    w = Window.partitionBy(key).orderBy(measure.desc_nulls_last(), F.col(tie))
    ranked = crops.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
    packed = F.sort_array(F.collect_list(F.struct("_rn", *fields)))
    return ranked.groupBy(key).agg(F.transform(packed, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(out))


def national_crops(crops: DataFrame, min_states: int = 3, limit: int = 40,
                   groups: Mapping[str, Sequence[str]] = config.CROP_GROUPS) -> DataFrame:
    """National means per crop over states that know each measure."""
    wi = X.filled("wi")
    agg = crops.groupBy("crop").agg(F.avg(wi).alias("w"), F.count(wi).alias("n_states"), F.avg("dpg").alias("d"),
                                    F.avg("breakeven").alias("b"))
    out = agg.where(F.col("n_states") >= min_states).select(
        "crop", X.keyword_group("crop", groups).alias("group"), F.round("w", 3).alias("avg_water_int"),
        F.round("d", 6).alias("avg_dpg"), F.round(F.col("d") * 100, 4).alias("avg_dpg_cents"),
        F.round("b", 1).alias("avg_breakeven"), "n_states")
    return out.orderBy(F.desc("avg_water_int"), "crop").limit(limit)


# -- year picks -------------------------------------------------------------------------------------------------


def preferred_or_latest(df: DataFrame, key: str, year: str, cols: Sequence[str], prefer: int) -> DataFrame:
    """The row of the preferred year, else of the latest one."""
    pick = F.max_by(F.struct(year, *cols), F.struct((F.col(year) == prefer).alias("p"), F.col(year).alias("y")))
    return df.groupBy(key).agg(pick.alias("b")).select(key, f"b.{year}", *[f"b.{c}" for c in cols])


def first_of_years(value: str, year: str, years: Sequence[int], measure: Column | None = None) -> Column:
    """Aggregate: value at the first listed year that has one (optionally only for rows of one measure)."""
    cond = lambda y: (F.col(year) == y) if measure is None else (F.col(year) == y) & measure
    return F.coalesce(*[F.max(F.when(cond(y), F.col(value))) for y in years])


def latest_by(df: DataFrame, key: str, date: str, cols: Sequence[str], tie: str | None = None) -> DataFrame:
    """Latest snapshot per key as an aggregate (no per-key sort, hot keys combine early)."""
    order = F.struct(date, tie) if tie else F.col(date)
    pick = F.max_by(F.struct(date, *cols), order)
    return df.groupBy(key).agg(pick.alias("b")).select(key, f"b.{date}", *[f"b.{c}" for c in cols])


def survey_table(by_year: DataFrame, key: str, value: str, years: Sequence[int]) -> DataFrame:
    """Values of the survey years side by side, with the change from the first to the last, percentage and absolute."""
    at = lambda y: F.max(F.when(F.col("year") == y, F.col(value)))
    wide = by_year.groupBy(key).agg(*[at(y).alias(f"_y{y}") for y in years])
    a, b = F.col(f"_y{years[0]}"), F.col(f"_y{years[-1]}")
    known = (a != 0) & (b != 0)
    return wide.select(key, *[F.round(f"_y{y}", 3).alias(f"{value}_{y}") for y in years],
                       F.when(known & (a > 0), F.round((b - a) / a * 100, 1)).alias("trend_pct"),
                       F.when(known, F.round(b - a, 3)).alias("trend_abs"))


def survey_change(by_year: DataFrame, key: str, value: str, first: int, last: int) -> DataFrame:
    """Change between two survey years, percentage and absolute."""
    return survey_table(by_year, key, value, [first, last]).select(key, "trend_pct", "trend_abs")


def adjacent_change(by_year: DataFrame, key: str, value: str, out: str = "change_pct") -> DataFrame:
    """Percentage change from the previous year of the same key (one row per key and year)."""
    prev = F.lag(value).over(Window.partitionBy(key).orderBy("year"))
    return by_year.withColumn(out, F.round(X.ratio(F.col(value) - prev, prev) * 100, 1))


# -- series statistics --------------------------------------------------------------------------------------------


def series_trend(series: DataFrame, key: str, order: str, value: str, marks: Sequence[int] = (),
                 min_points: int = 10) -> DataFrame:
    """Least-squares slope over the position in the series, mean, last value and the values of chosen years.

    ``series`` has one row per key and period, so a key's window is as long as the calendar.
    """
    i = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    agg = series.withColumn("_i", i).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(value, "_i").alias("slope"), F.avg(value).alias("mean"),
        F.max_by(value, order).alias("last"),
        *[F.max(F.when(F.col(order) == m, F.col(value))).alias(f"at_{m}") for m in marks])
    ok = lambda c: F.when(F.col("n") >= min_points, c)
    return agg.select(key, ok(F.round("slope", 4)).alias("trend"), ok(F.round("mean", 1)).alias("mean"),
                      ok(F.col("last")).alias("last"), *[ok(F.col(f"at_{m}")).alias(f"at_{m}") for m in marks])


def late_minus_early(series: DataFrame, key: str, order: str, value: str, span: int = 5, min_points: int = 8,
                     out: str = "late_minus_early") -> DataFrame:
    """Mean of the last ``span`` periods minus the mean of the first; short series give null."""
    up = F.row_number().over(Window.partitionBy(key).orderBy(order))
    down = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    agg = series.withColumn("_u", up).withColumn("_d", down).groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("_u") <= span, F.col(value))).alias("early"),
        F.avg(F.when(F.col("_d") <= span, F.col(value))).alias("late"))
    return agg.select(key, F.when(F.col("n") >= min_points, F.round(F.col("late") - F.col("early"), 2)).alias(out))


def station_years(obs: DataFrame, group: str, station: str, date: str, value: str, out: str) -> DataFrame:
    """Observations to yearly group values: sum per station, then mean across stations."""
    per_station = obs.groupBy(group, station, F.year(date).alias("year")).agg(F.sum(value).alias("v"))
    return per_station.groupBy(group, "year").agg(F.avg("v").alias(out))


def mean_years(obs: DataFrame, group: str, date: str, value: str, out: str) -> DataFrame:
    """Daily values to yearly group means."""
    return obs.groupBy(group, F.year(date).alias("year")).agg(F.avg(value).alias(out))


def newest_rows(series: DataFrame, key: str, date: str, keep: int = 60) -> DataFrame:
    """The newest ``keep`` rows per key."""
    w = Window.partitionBy(key).orderBy(F.desc(date))
    return series.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def price_snapshot(prices: DataFrame, key: str, date: str, close: str) -> DataFrame:
    """Latest close, change against the newest close of the year before, range and share of the high."""
    by_year = prices.groupBy(key, F.year(date).alias("_y")).agg(
        F.max_by(close, date).alias("c"), F.max(date).alias("d"), F.max(close).alias("hi"), F.min(close).alias("lo"))
    closes = F.map_from_entries(F.collect_list(F.struct("_y", "c")))  # one entry per calendar year
    agg = by_year.groupBy(key).agg(F.max_by("c", "d").alias("latest"), F.max("d").alias("date"), F.max("hi").alias("hi"),
                                   F.min("lo").alias("lo"), F.try_element_at(closes, F.max("_y") - 1).alias("ago"))
    return agg.select(key, F.round("latest", 2).alias("latest"), "date",
                      F.round((X.ratio("latest", "ago") - 1) * 100, 1).alias("yr_chg_pct"),
                      F.round("hi", 2).alias("hi5"), F.round("lo", 2).alias("lo5"),
                      F.round(X.ratio("latest", "hi") * 100, 1).alias("pct_of_hi"))


# -- joins with defaults ----------------------------------------------------------------------------------------


def lookup_or(df: DataFrame, table: DataFrame, key: str | Sequence[str], defaults: Mapping[str, float]) -> DataFrame:
    """Left lookup; missing, null or zero values take the default."""
    out = df.join(table, key, "left")
    return out.withColumns({c: F.coalesce(X.filled(c), F.lit(d)) for c, d in defaults.items()})


def chain_left(base: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Left-join reduced sources (one row per key) onto the base; equal keys keep one partitioning throughout."""
    return reduce(lambda acc, part: acc.join(part, key, "left"), parts, base)


def presence(states: DataFrame, crops: DataFrame, crop: str, out: str = "has_crop") -> DataFrame:
    """Flag the states that grow a crop."""
    have = crops.where(F.col("crop") == crop).select("state").distinct().withColumn(out, F.lit(1))
    return states.join(have, "state", "left").withColumn(out, F.coalesce(out, F.lit(0)))


def member_flags(df: DataFrame, key: str, lists: Mapping[str, DataFrame]) -> DataFrame:
    """0/1 membership flags from id lists."""
    for name, ids in lists.items():
        marks = ids.select(key).distinct().withColumn(name, F.lit(1))
        df = df.join(marks, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return df


def first_nonempty(sources: Sequence[DataFrame], keep: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Rows of the first source, in order, that has any; one tagged union, no driver-side test. ``keep`` may stage the union, so that every source is read once."""
    tagged = [s.withColumn("_rank", F.lit(i)) for i, s in enumerate(sources)]
    union = keep(reduce(DataFrame.unionByName, tagged))
    return union.where(F.col("_rank") == union.agg(F.min("_rank")).scalar()).drop("_rank")


def tagged_union(parts: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union of per-sector frames with the sector as a column."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])
