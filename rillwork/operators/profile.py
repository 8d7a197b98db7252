"""Distribution, coverage, correlation and collinearity profiles."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, functions as F

from rillwork import config
from rillwork.functions import columns as X
from rillwork.functions.stats import pearson_p
from rillwork.operators import ranks


def distribution(df: DataFrame, col: str, digits: int = 2, index: DataFrame | None = None) -> DataFrame:
    """n, mean, median, sample deviation and five percentiles: one row."""
    q = ranks.quantile_row(df, {"median": (col, 0.5), **{f"p{p}": (col, p / 100) for p in (10, 25, 50, 75, 90)}}, index=index)
    m = df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"))
    return ranks.with_scalars(m, q).select(
        "n", *[F.round(c, digits).alias(c) for c in ("mean", "median", "std", "p10", "p25", "p50", "p75", "p90")])


def coverage(df: DataFrame, cols: Sequence[str], roles: Mapping[str, str] | None = None,
             minimum: float = config.MIN_COVERAGE) -> DataFrame:
    """Non-null count and share per column, with the low-coverage flag: one aggregate, then rows."""
    agg = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in cols])
    rows = agg.unpivot(["_n"], list(cols), "feature", "n")
    share = X.ratio("n", "_n")
    out = rows.select("feature", "n", F.round(share * 100, 1).alias("pct"),
                      F.coalesce(share < minimum, F.lit(True)).alias("low_coverage"))
    return out.withColumn("role", X.from_map("feature", dict(roles), "")) if roles else out


def usable_columns(df: DataFrame, cols: Sequence[str], dropped: Sequence[str] = (),
                   minimum: float = config.MIN_COVERAGE) -> list[str]:
    """Columns that exist, are well covered and were not dropped as collinear, in order and without repeats."""
    cand = [c for c in dict.fromkeys(cols) if c in df.columns and c not in dropped]
    if not cand:
        return []
    low = {r["feature"] for r in coverage(df, cand, minimum=minimum).where("low_coverage").collect()}
    return [c for c in cand if c not in low]


def correlations(df: DataFrame, features: Sequence[str], target: str, min_n: int = 50) -> DataFrame:
    """Pearson r of each feature with the target on pairwise complete rows, p-value, ordered by strength."""
    pair = lambda c: F.when(F.col(c).isNotNull() & F.col(target).isNotNull(), F.lit(1))
    agg = df.agg(*[F.corr(c, target).alias(f"r_{i}") for i, c in enumerate(features)],
                 *[F.count(pair(c)).alias(f"n_{i}") for i, c in enumerate(features)])
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"r_{i}").alias("r"), F.col(f"n_{i}").alias("n"))
                     for i, c in enumerate(features)])
    long = agg.select(F.explode(rows).alias("e")).select("e.*").where(F.col("n") >= min_n)
    long = long.withColumn("p", pearson_p("r", "n"))
    return long.select("feature", F.round("r", 3).alias("r"), "n", F.round("p", 4).alias("p"),
                       (F.col("p") < 0.05).alias("significant")).orderBy(F.desc(F.abs("r")), "feature")


def correlation_matrix(df: DataFrame, features: Sequence[str], min_n: int = 100) -> tuple[list[str], np.ndarray]:
    """Correlation matrix over complete rows of the well-filled features (a features x features array)."""
    counts = df.agg(*[F.count(c).alias(c) for c in features]).first()
    keep = [c for c in features if counts[c] >= min_n]
    rows = df.select(*[F.col(c).cast("double") for c in keep]).dropna()
    vec = VectorAssembler(inputCols=keep, outputCol="v").transform(rows).select("v")
    return keep, Correlation.corr(vec, "v").first()[0].toArray()


def matrix_rows(df: DataFrame, features: Sequence[str], matrix: np.ndarray) -> DataFrame:
    """Correlation matrix as (i, j, feat1, feat2, r)."""
    rows = [(i, j, a, b, float(matrix[i, j])) for i, a in enumerate(features) for j, b in enumerate(features)]
    return df.sparkSession.createDataFrame(rows, "i int, j int, feat1 string, feat2 string, r double")


def pair_correlations(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Upper triangle of the correlation matrix over complete rows as (feat1, feat2, r), in one aggregate."""
    rows = df.select(*[F.col(c).cast("double") for c in features]).dropna()
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1:]]
    agg = rows.agg(*[F.corr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(pairs)])
    packed = F.array(*[F.struct(F.lit(a).alias("feat1"), F.lit(b).alias("feat2"), F.col(f"r{k}").alias("r"))
                       for k, (a, b) in enumerate(pairs)])
    return agg.select(F.explode(packed).alias("e")).select("e.*")


def high_pairs(pairs: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Pairs whose |r| exceeds the threshold, strongest first."""
    return pairs.where(F.abs("r") > threshold).select("feat1", "feat2", F.round("r", 3).alias("r")) \
                .orderBy(F.desc(F.abs("r")), "feat1", "feat2")


def vif_prune(features: Sequence[str], matrix: np.ndarray, limit: float = 10.0) -> tuple[list[tuple[str, float]], list[str]]:
    """Variance inflation from the correlation matrix; drop the worst feature while it exceeds the limit."""
    idx, dropped = list(range(len(features))), []
    while len(idx) > 1:
        sub = matrix[np.ix_(idx, idx)]
        try:
            vif = np.diag(np.linalg.inv(sub))
            vif = np.where((vif < 1) | ~np.isfinite(vif), 1e9, vif)
        except np.linalg.LinAlgError:
            vif = np.array([1.0 / max(1e-9, 1 - _r2(sub, k)) for k in range(len(idx))])
        worst = int(np.argmax(vif))
        if vif[worst] <= limit:
            break
        dropped.append(features[idx[worst]])
        idx.pop(worst)
    sub = matrix[np.ix_(idx, idx)]
    vif = np.diag(np.linalg.pinv(sub))
    rows = sorted(((features[i], round(float(v), 2)) for i, v in zip(idx, vif)), key=lambda t: -t[1])
    return rows, dropped


def _r2(corr: np.ndarray, k: int) -> float:
    others = [i for i in range(len(corr)) if i != k]
    beta = np.linalg.pinv(corr[np.ix_(others, others)]) @ corr[others, k]
    return float(corr[others, k] @ beta)


def high_low(df: DataFrame, target: str, features: Sequence[str], lo: float = 0.33, hi: float = 0.66, first: int = 10, index: DataFrame | None = None) -> DataFrame:
    """Medians of features in the top and the bottom third of the target, and their ratio."""
    feats = list(features)[:first]
    cut = ranks.quantile_row(df, {"_lo": (target, lo), "_hi": (target, hi)}, index=index).first()
    split = df.select(*[F.when(F.col(target) >= cut["_hi"], F.col(c)).alias(f"h{i}") for i, c in enumerate(feats)],
                      *[F.when(F.col(target) <= cut["_lo"], F.col(c)).alias(f"l{i}") for i, c in enumerate(feats)])
    med = ranks.quantile_row(split, {f"{s}{i}": (f"{s}{i}", 0.5) for s in "hl" for i in range(len(feats))})
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"h{i}").alias("h"), F.col(f"l{i}").alias("l"))
                     for i, c in enumerate(feats)])
    long = med.select(F.explode(rows).alias("e")).select("e.*").where(F.col("h").isNotNull() & (F.col("l") != 0))
    return long.select("feature", F.round("h", 3).alias("high_eff_median"), F.round("l", 3).alias("low_eff_median"),
                       F.round(F.col("h") / F.col("l"), 2).alias("ratio"))


def histogram(df: DataFrame, col: str, bins: int = 60, clip_q: float | None = 0.99, index: DataFrame | None = None) -> DataFrame:
    """Equal-width counts between the smallest value and the (clipped) largest; the last bin is closed."""
    base = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    if clip_q is not None:
        top = ranks.quantile_row(base, {"_top": (col if index is not None else "v", clip_q)}, index=index)
        base = ranks.with_scalars(base, top).select(F.least("v", "_top").alias("v"))
    edge = base.agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    x = ranks.with_scalars(base, edge)
    width = (F.col("_b") - F.col("_a")) / bins
    at = F.least(F.floor(X.ratio(F.col("v") - F.col("_a"), width)), F.lit(bins - 1))
    return x.groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def kernel_density(df: DataFrame, col: str, points: int = 500, bandwidth: float = 0.25, height: float = 0.38) -> DataFrame:
    """Gaussian kernel density on an even grid, scaled to a maximum height, with the sign side and the mean.

    Every task adds up its own rows over the grid and emits ``points`` partial sums, so only those are shuffled.
    """
    base = df.select(F.col(col).cast("double").alias("v")).where(F.col("v").isNotNull())
    s = base.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.stddev_samp("v").alias("sd"),
                 F.avg("v").alias("mean"), F.count("v").alias("n")).first()
    schema = "g int, x double, height double, side string, mean double"
    if not s["n"] or s["n"] < 5 or not s["sd"] or s["sd"] < 1e-9:
        return df.sparkSession.createDataFrame([], schema)
    h = bandwidth * s["sd"]
    # grid point -1 is the mean, where the marker stands
    grid = np.append(np.linspace(s["a"], s["b"], points), s["mean"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(grid))
        for pdf in batches:
            v = pdf["v"].to_numpy()
            for i in range(0, len(v), 2048):
                z = (grid[:, None] - v[None, i:i + 2048]) / h
                total += np.exp(-0.5 * z * z).sum(axis=1)
        yield pd.DataFrame({"g": np.arange(len(grid), dtype="int32"), "d": total})

    sums = base.mapInPandas(partial, "g int, d double").groupBy("g").agg(F.sum("d").alias("d"))
    peak = sums.where(F.col("g") < points).agg(F.max("d").alias("_peak"))
    x = F.when(F.col("g") == points, F.lit(s["mean"])).otherwise(
        F.lit(s["a"]) + F.col("g") * F.lit((s["b"] - s["a"]) / (points - 1)))
    out = ranks.with_scalars(sums, peak)
    return out.select(F.when(F.col("g") == points, F.lit(-1)).otherwise(F.col("g")).cast("int").alias("g"), x.alias("x"),
                      (F.col("d") / F.col("_peak") * height).alias("height")) \
              .withColumn("side", F.when(F.col("x") < 0, "negative").when(F.col("x") > 0, "positive").otherwise("both")) \
              .withColumn("mean", F.lit(float(s["mean"])))


def national_panel(states: DataFrame, drought: DataFrame) -> DataFrame:
    """Totals, mean of the known intensities, mean drought over states that have any: one row."""
    z = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    a = states.agg(z("total_irr_area").alias("total_area"), z("virtual_water_B").alias("total_virtual_water"),
                   z("opp_value_M").alias("total_opp"), F.avg(X.filled("avg_intensity")).alias("avg_intensity"))
    d = drought.agg(F.round(F.avg(F.when(F.col("drought_pct") > 0, F.col("drought_pct"))), 0).alias("nat_drought_pct"))
    return ranks.with_scalars(a, d)


def size_guards(df: DataFrame, group: str, treated: str, min_n: int, min_arm: int) -> DataFrame:
    """Which groups are large enough for an estimate, with the reason when not."""
    t, c = F.sum(F.when(F.col(treated) == 1, 1).otherwise(0)), F.sum(F.when(F.col(treated) == 0, 1).otherwise(0))
    agg = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), t.cast("long").alias("n_treat"), c.cast("long").alias("n_ctrl"))
    return agg.withColumn("reason", F.when(F.col("n") < min_n, "too few rows")
                          .when((F.col("n_treat") < min_arm) | (F.col("n_ctrl") < min_arm), "arm too small")
                          .otherwise("ok"))
