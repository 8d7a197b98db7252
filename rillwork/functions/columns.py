"""Column expressions: parsing, keys, labels, unit changes. All stay inside generated JVM code."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rillwork import config


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# -- numbers ------------------------------------------------------------------------------------------------

def finite(x) -> Column:
    """NaN and infinities become null, so that no later aggregate or percentile meets them."""
    c = _c(x)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def parse_number(x) -> Column:
    """Text with thousands commas and blanks to double; suppression marks and other text become null."""
    return finite(F.trim(F.translate(_c(x), ",", "")).try_cast("double"))


def parse_count(x) -> Column:
    """Integer text to long; negative sentinels mean missing."""
    n = F.trim(_c(x)).try_cast("long")
    return F.when(n >= 0, n)


def to_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Coerce the named columns to finite doubles, leaving the others alone."""
    return df.withColumns({c: finite(F.col(c).try_cast("double")) for c in cols})


def finite_doubles(df: DataFrame) -> DataFrame:
    """Clear NaN and infinities from every floating column."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(c) for c in floats})


def ratio(a, b) -> Column:
    """a / b, null where b is zero or null."""
    d = _c(b)
    return _c(a) / F.when(d != 0, d)


def filled(x) -> Column:
    """The value unless it is null or zero (parity with 'value or default' rules)."""
    c = _c(x)
    return F.when(c != 0, c)


def first_filled(*xs) -> Column:
    """First non-blank of several column spellings."""
    return F.coalesce(*[F.when(F.trim(_c(x).cast("string")) != "", _c(x)) for x in xs])


def clip(x, lo=None, hi=None) -> Column:
    """Bound a value; nulls stay null."""
    c = _c(x)
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(lo))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(hi))
    return F.when(c.isNotNull(), out)


def log1p_floor(x) -> Column:
    """log(1 + max(x, 0)), null for null."""
    return F.log1p(clip(x, lo=0.0))


def effect_pct(x) -> Column:
    """Log-scale effect to a percentage change."""
    return F.expm1(_c(x)) * 100


def literal(v) -> str:
    """A Python constant as SQL text; constant tables reach the plan in one expression instead of one call per cell."""
    if isinstance(v, bool) or v is None:
        return str(v).lower() if v is not None else "NULL"
    if isinstance(v, (int, float)):
        return f"{v!r}D" if isinstance(v, float) else str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


# -- keys and text --------------------------------------------------------------------------------------------

def zfill(x, n: int) -> Column:
    """Left-pad with zeros; longer text is kept whole."""
    c = _c(x).cast("string")
    return F.when(F.length(c) < n, F.lpad(c, n, "0")).otherwise(c)


def place_key(state, county) -> Column:
    """Two-digit state plus three-digit county; null unless five characters and not the national row."""
    key = F.concat(zfill(F.trim(_c(state)), 2), zfill(F.trim(_c(county)), 3))
    return F.when((F.length(key) == 5) & (key != "00000"), key)


def split_place(x) -> tuple[Column, Column]:
    """'County, State' to its two parts; a missing part is an empty string."""
    parts = F.split(_c(x), ", ")
    return F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")), \
        F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))


def series_place(series_id) -> Column:
    """Five-digit place code inside a 20-character series id (five-letter prefix first)."""
    return F.substring(_c(series_id), 6, 5)


def keyword_group(x, groups: Mapping[str, Sequence[str]] = config.CROP_GROUPS, default: str = "OTHER") -> Column:
    """First group, in order, with a keyword contained in the name."""
    name = F.upper(_c(x))
    out = None
    for label, words in groups.items():
        hit = name.rlike("|".join(re.escape(w) for w in words))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def from_map(x, mapping: Mapping, default=None) -> Column:
    """Look a value up in a small constant mapping."""
    m = F.expr(f"map({', '.join(literal(v) for kv in mapping.items() for v in kv)})")
    got = F.try_element_at(m, _c(x))
    return got if default is None else F.coalesce(got, F.lit(default))


def region_of(state_code, regions: Mapping[str, Sequence[str]] = config.REGIONS, default: str = "other") -> Column:
    """State code to region."""
    code = zfill(state_code, 2)
    out = None
    for name, codes in regions.items():
        hit = code.isin(list(codes))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def display_label(x, labels: Mapping[str, str] = config.LABELS) -> Column:
    """Human-readable column label: the given text, else title case."""
    c = _c(x)
    return F.coalesce(from_map(c, labels), F.initcap(F.translate(c, "_", " ")))


def cluster_label(eto, eff, poverty, farm, deficit) -> Column:
    """Name a cluster centre by ordered thresholds (the published cut-offs)."""
    z = lambda c: F.coalesce(_c(c), F.lit(0.0))
    eto, eff, poverty, farm, deficit = z(eto), z(eff), z(poverty), z(farm), z(deficit)
    return (F.when(eto > 85, "Extreme-Arid Low-Efficiency")
            .when((farm > 2000) & (deficit > 40), "Arid Large-Farm")
            .when(eff > 7.5, "High-Efficiency Grain Belt")
            .when((eff > 6) & (deficit < 40), "Western High-Efficiency")
            .when(poverty > 16, "Resource-Constrained")
            .otherwise("Arid Large-Farm Low-Efficiency"))


def band(x, cuts: Sequence[tuple[float, str]], default: str, ascending: bool = False) -> Column:
    """Ordered bands: 'at least cut' from the top, or 'below cut' from the bottom."""
    c = _c(x)
    out = None
    for cut, label in cuts:
        hit = (c < cut) if ascending else (c >= cut)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return F.when(c.isNotNull(), out.otherwise(default))


def entry_for_name(x, entries: Sequence[tuple]) -> Column:
    """Reference row for a name: exact key, else the first key that contains or is contained in the name.

    ``entries`` is a short ordered list of (key, ...) tuples; it is a constant array inside the plan, so the
    lookup needs no join and keeps the list order.
    """
    name = F.upper(F.trim(_c(x)))
    cell = "named_struct('key', {}, 'rate', {}, 'price_unit', {}, 'price_crop', {})"
    table = F.expr("array(" + ", ".join(cell.format(literal(e[0]), literal(float(e[1])), literal(e[2]), literal(e[3])) for e in entries) + ")")
    exact = F.filter(table, lambda e: e["key"] == name)
    near = F.filter(table, lambda e: name.contains(e["key"]) | e["key"].contains(name))
    return F.coalesce(F.try_element_at(exact, F.lit(1)), F.try_element_at(near, F.lit(1)))


# -- units ------------------------------------------------------------------------------------------------------

def tenth_mm_to_inch(x) -> Column:
    return _c(x) * 0.1 / config.MM_PER_INCH


def acre_feet_to_gallons(x) -> Column:
    return _c(x) * config.GALLONS_PER_ACRE_FOOT


def sq_m_to_acre(x) -> Column:
    return _c(x) / config.SQ_M_PER_ACRE


def inch_to_foot(x) -> Column:
    return _c(x) / 12


def thousands(x) -> Column:
    return _c(x) * 1000


def ndvi(x) -> Column:
    """Scaled vegetation index; fill values become null."""
    c = _c(x)
    return F.when(c > config.NDVI_FILL, c * config.NDVI_SCALE)


# -- geometry -------------------------------------------------------------------------------------------------------

def round_ring(points, digits: int) -> Column:
    """Round each [lon, lat] of a ring."""
    return F.transform(points, lambda p: F.transform(p, lambda v: F.round(v, digits)))


def vertex_mean(points, digits: int = 4) -> Column:
    """Plain mean of all vertices as struct(lon, lat)."""
    n = F.size(points)
    total = lambda i: F.aggregate(points, F.lit(0.0), lambda acc, p: acc + p[i])
    return F.when(n > 0, F.struct(F.round(total(0) / n, digits).alias("lon"), F.round(total(1) / n, digits).alias("lat")))


# -- row filters ------------------------------------------------------------------------------------------------------

def at_least_filled(df: DataFrame, k: int, subset: Sequence[str] | None = None) -> DataFrame:
    """Rows with at least k non-null values among the columns."""
    return df.dropna(thresh=k, subset=list(subset or df.columns))


def core_rows(df: DataFrame, core: Sequence[str], state_code: str = "state_fips", max_state: int = 56) -> DataFrame:
    """Drop rows lacking a core measure and places outside the state-code range."""
    return df.where(F.col(state_code).try_cast("int") <= max_state).dropna(subset=list(core))


def select_records(df: DataFrame, equals: Mapping[str, object], min_year: int | None = None,
                   contains: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Descriptor-equality and text-contains selection over the long record table; all predicates push down."""
    for name, value in equals.items():
        df = df.where(F.col(name).isin(list(value)) if isinstance(value, (list, tuple)) else F.col(name) == value)
    if min_year is not None:
        df = df.where(F.col("year").try_cast("int") >= min_year)
    for name, words in (contains or {}).items():
        for w in words:
            df = df.where(F.col(name).contains(w))
    return df


def without_names(df: DataFrame, col: str, names: Sequence[str] = config.AGGREGATE_CROPS) -> DataFrame:
    """Drop the listed aggregate names."""
    return df.where(~F.col(col).isin(list(names)))
