"""Order statistics over frames of any size: prefix sums, ranks, quantiles, shares, normalisation.

Spark runs ``Window.orderBy`` without a partition, and exact ``percentile``, in one task. Here equal values are first
merged into (value, count), so that a value held by a third of all rows is one row; the merged values are dealt to
value ranges and staged; the counts of the ranges, one row each, give every range its offset; and windows run inside
a range only. The same plan serves every size: there are as many ranges as shuffle partitions.

``value_index`` keeps the result for all columns of a frame. Functions that take ``index`` then read the few columns and
rows they need from it, without a shuffle of the frame's values and without writing anything.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from rillwork.session import stage

SALTS = 256


def _number(col: Column) -> Column:
    """As a double: NaN to null, -0.0 to 0.0."""
    d = col.cast("double")
    return F.when(~F.isnan(d), d + F.lit(0.0))


# -- merged values in ranges ------------------------------------------------------------------------------------

def _offsets(long: DataFrame, by: Sequence[str], descending: bool = False, sums: bool = False) -> DataFrame:
    """One row per distinct ``v`` of every group: ``n``, ``n_before`` and ``n_total``; with ``sums`` also ``s`` (value times count), ``s_before`` and ``s_total``."""
    adds = ["n", "s"] if sums else ["n"]
    measures = [F.count(F.lit(1)).alias("n")] + ([F.sum("v").alias("s")] if sums else [])
    merged = long.where(F.col("v").isNotNull()).groupBy(*by, "v").agg(*measures)
    parts = int(long.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(merged.repartitionByRange(parts, *by, "v").withColumn("_r", F.spark_partition_id()), "value-ranges")
    way = F.desc if descending else F.asc
    per_range = ranged.groupBy(*by, "_r").agg(*[F.sum(a).alias(f"_{a}") for a in adds])
    whole, upto = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(way("_r"))
    for a in adds:
        per_range = per_range.withColumn(f"_{a}_start", F.sum(f"_{a}").over(upto) - F.col(f"_{a}")).withColumn(f"{a}_total", F.sum(f"_{a}").over(whole))
    same = [F.col(f"l.{g}").eqNullSafe(F.col(f"o.{g}")) for g in by] + [F.col("l._r") == F.col("o._r")]
    extra = [F.col(f"o._{a}_start") for a in adds] + [F.col(f"o.{a}_total") for a in adds]
    joined = ranged.alias("l").join(per_range.alias("o"), same).select("l.*", *extra)
    inside = Window.partitionBy(*by, "_r").orderBy(way("v"))
    for a in adds:
        joined = joined.withColumn(f"{a}_before", F.col(f"_{a}_start") + F.sum(a).over(inside) - F.col(a))
    return joined.drop("_r", *[f"_{a}_start" for a in adds])


def value_index(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Places of all values of ``cols``: feature, v, n, s (value times count), and their sums before the value and in total."""
    return _offsets(_long(df, cols), ["feature"], sums=True)


def positive(index: DataFrame, col: str) -> DataFrame:
    """The index of the positive values of one column alone."""
    mine = _of(index, [col])
    below = mine.where("v <= 0").agg(F.coalesce(F.max(F.col("n_before") + F.col("n")), F.lit(0)).alias("_n"), F.coalesce(F.sum("s"), F.lit(0.0)).alias("_s"))
    x = with_scalars(mine.where("v > 0"), below)
    return x.select("feature", "v", "n", "s", *[(F.col(f"{a}_{k}") - F.col(f"_{a}")).alias(f"{a}_{k}") for a in ("n", "s") for k in ("before", "total")])


def _of(index: DataFrame, cols: Sequence[str]) -> DataFrame:
    return index.where(F.col("feature").isin(list(dict.fromkeys(cols))))


# -- quantiles ------------------------------------------------------------------------------------------------

def _pick(feature: str, p: float, rule: str) -> Column:
    """Aggregate over merged values: the quantile ``p`` of one feature."""
    mine = F.col("feature") == feature
    n = F.max(F.when(mine, F.col("n_total")))
    last, share = F.col("n_total") - 1, F.lit(float(p))
    at = F.floor(F.col("n_total") * share) if rule == "index" else F.floor(last * share)
    lo = F.greatest(F.lit(0), F.least(last, at))
    value = lambda pos: F.max(F.when(mine & (F.col("n_before") <= pos) & (pos < F.col("n_before") + F.col("n")), F.col("v")))
    if rule == "index":
        return value(lo)
    low, high = value(lo), value(F.least(last, lo + 1))
    part = (n - 1) * share - F.floor((n - 1) * share)
    return F.when(part > 0, low + (high - low) * part).otherwise(low)


def _long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    pieces = F.array(*[F.struct(F.lit(c).alias("feature"), _number(F.col(c)).alias("v")) for c in cols])
    return df.select(*by, F.explode(F.filter(pieces, lambda e: e["v"].isNotNull())).alias("e")).select(*by, "e.feature", "e.v")


def quantile_row(df: DataFrame, wanted: Mapping[str, tuple[str, float]], rule: str = "linear", index: DataFrame | None = None, counts: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles as one row. ``wanted``: output name -> (column, probability); ``counts``: columns whose known values are counted as n_<column>.

    rule='linear' interpolates between neighbours; rule='index' takes the value at floor(n*p), clamped to the last.
    ``index`` is the ``value_index`` of these rows.
    """
    cols = list(dict.fromkeys([*(c for c, _ in wanted.values()), *counts]))
    merged = _of(index, cols) if index is not None else _offsets(_long(df, cols), ["feature"])
    known = [F.coalesce(F.max(F.when(F.col("feature") == c, F.col("n_total"))), F.lit(0)).alias(f"n_{c}") for c in counts]
    return merged.agg(*[_pick(c, p, rule).alias(name) for name, (c, p) in wanted.items()], *known)


def group_quantiles(df: DataFrame, by: str, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """Exact quantiles per group: (by, names...), one row per group with a known value."""
    merged = _offsets(_long(df, list(dict.fromkeys(c for c, _ in wanted.values())), [by]), [by, "feature"])
    return merged.groupBy(by).agg(*[_pick(c, p, "linear").alias(name) for name, (c, p) in wanted.items()])


def with_scalars(df: DataFrame, row: DataFrame) -> DataFrame:
    """Attach a one-row frame of constants to every row.

    The frame becomes a scalar subquery: it runs once, Spark fails if it has a second row, and no join is planned.
    """
    cols = row.columns
    constants = row.select(F.struct(*cols).alias("_row")).scalar()
    return df.withColumn("_row", constants).select(*df.columns, *[F.col("_row")[c].alias(c) for c in cols])


# -- prefix sums over distinct values ------------------------------------------------------------------------------

def value_prefix(df: DataFrame, col: str, descending: bool = False, sums: bool = False, index: DataFrame | None = None) -> DataFrame:
    """One row per distinct value of ``col``: its count ``n``, rows before it ``n_before``, ``n_total``; with ``sums`` also s, s_before, s_total."""
    if index is not None:
        adds = ["n", "s"] if sums else ["n"]
        before = lambda a: (F.col(f"{a}_total") - F.col(f"{a}_before") - F.col(a) if descending else F.col(f"{a}_before")).alias(f"{a}_before")
        return _of(index, [col]).select(F.col("v").alias(col), *[x for a in adds for x in (F.col(a), before(a), F.col(f"{a}_total"))])
    return _offsets(df.select(_number(F.col(col)).alias("v")), [], descending, sums).withColumnRenamed("v", col)


def _row_salt(df: DataFrame) -> Column:
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(SALTS)).cast("int")


def attach_by_value(df: DataFrame, col: str, lookup: DataFrame, outs: Sequence[str]) -> DataFrame:
    """Left-join per-value results back to rows.

    The lookup has one row per value, so adaptive execution may split the rows of a hot value; rows without a value match
    nothing and are spread by a salt.
    """
    key = _number(F.col(col))
    left = df.withColumn("_key", key).withColumn("_salt", F.when(key.isNotNull(), F.lit(0)).otherwise(_row_salt(df)))
    right = lookup.select(F.col(col).alias("_key"), F.lit(0).alias("_salt"), *[F.col(o).alias(f"_got_{o}") for o in outs])
    return left.join(right, ["_key", "_salt"], "left").select(*df.columns, *[F.col(f"_got_{o}").alias(o) for o in outs])


def rank_pct(df: DataFrame, col: str, out: str, scale: float = 1.0, digits: int | None = None, pre_round: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """Percentile rank: ties share their average rank, divided by the non-null count; nulls stay null."""
    pct = (F.col("n_before") + (F.col("n") + 1) / 2) / F.col("n_total")
    if pre_round is not None:
        pct = F.round(pct, pre_round)
    pct = pct * scale
    if digits is not None:
        pct = F.round(pct, digits)
    return attach_by_value(df, col, value_prefix(df, col, index=index).select(col, pct.alias(out)), [out])


def rank_and_share(df: DataFrame, col: str, rank_out: str = "rank", share_out: str | None = "share", index: DataFrame | None = None) -> DataFrame:
    """Competition rank from the top and, optionally, the share of the grand total."""
    outs = {rank_out: F.col("n_before") + 1}
    if share_out:
        outs[share_out] = F.col(col) / F.when(F.col("s_total") != 0, F.col("s_total"))
    d = value_prefix(df, col, descending=True, sums=share_out is not None, index=index)
    return attach_by_value(df, col, d.select(col, *[e.alias(k) for k, e in outs.items()]), list(outs))


def pareto(df: DataFrame, col: str, shares: Sequence[float] = (0.5, 0.8), index: DataFrame | None = None) -> DataFrame:
    """How many of the largest entities reach each share of the total: one row."""
    d = value_prefix(df, col, descending=True, sums=True, index=index)
    aggs = []
    for share in shares:
        goal = F.col("s_total") * share
        steps = F.greatest(F.lit(1), F.ceil((goal - F.col("s_before")) / F.when(F.col(col) != 0, F.col(col))))
        reached = F.col("s_before") + F.col("s") >= goal
        aggs.append(F.min(F.when(reached, F.col("n_before") + steps)).cast("long").alias(f"top{round(share * 100)}pct"))
    return d.agg(*aggs, F.max("n_total").alias("total_entities"), F.max("s_total").alias("total"))


# -- normalisation -----------------------------------------------------------------------------------------------

def robust_norm(df: DataFrame, cols: Mapping[str, str], lo: float = 0.05, hi: float = 0.95,
                reverse: Sequence[str] = (), positive_only: bool = False, digits: int = 3,
                shared: Sequence[Sequence[str]] = (), index: DataFrame | None = None) -> DataFrame:
    """Scale to [0, 1] between two index percentiles, clamped; ``reverse`` columns run the other way.

    ``cols``: column -> output name. ``positive_only`` leaves zeros and negatives out of the percentile set.
    ``shared``: lists of columns that use one common scale. ``index`` is the ``value_index`` of the percentile set.
    """
    source = {c: c for c in cols}
    for i, grp in enumerate(shared):
        source.update({c: f"_shared{i}" for c in grp})
    as_value = lambda c: F.when(F.col(c) > 0, F.col(c)) if positive_only else F.col(c)
    names = list(dict.fromkeys(source.values()))
    if shared:
        # stack the columns of a shared scale under one name before taking percentiles
        pieces = F.array(*[F.struct(F.lit(source[c]).alias("f"), as_value(c).cast("double").alias("v")) for c in cols])
        long = df.select(F.explode(pieces).alias("e")).select("e.*")
        base = long.select(*[F.when(F.col("f") == s, F.col("v")).alias(s) for s in names])
    else:
        base = df.select(*[as_value(c).cast("double").alias(c) for c in cols])
    wanted = {f"_{s}_{k}": (s, p) for s in names for k, p in (("lo", lo), ("hi", hi))}
    out = with_scalars(df, quantile_row(base, wanted, rule="index", index=index))
    for c, name in cols.items():
        s = source[c]
        width = F.greatest(F.col(f"_{s}_hi") - F.col(f"_{s}_lo"), F.lit(1e-6))
        z = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - F.col(f"_{s}_lo")) / width))
        z = 1 - z if c in reverse else z
        out = out.withColumn(name, F.when(F.col(c).isNotNull() & F.col(f"_{s}_lo").isNotNull(), F.round(z, digits)))
    return out.drop(*wanted)


def min_max(df: DataFrame, cols: Mapping[str, str]) -> DataFrame:
    """Plain min-max scaling of several columns, zero where a column does not vary."""
    row = df.agg(*[f(c).alias(f"_{c}_{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    out = with_scalars(df, row)
    for c, name in cols.items():
        width = F.col(f"_{c}_hi") - F.col(f"_{c}_lo")
        out = out.withColumn(name, F.when(width > 0, (F.col(c) - F.col(f"_{c}_lo")) / width)
                             .when(F.col(c).isNotNull(), F.lit(0.0)))
    return out.drop(*[f"_{c}_{n}" for c in cols for n in ("lo", "hi")])
