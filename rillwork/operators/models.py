"""Design matrices, forests, L1 regression, k-means: Spark ML with the published settings as defaults."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window, functions as F

from rillwork import config
from rillwork.functions import columns as X
from rillwork.operators import gram, lloyd, ranks
from rillwork.operators.forests import RandomForest


def impute_medians(df: DataFrame, cols: Sequence[str], index: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """Fill nulls with exact column medians; columns without any value are left out of the returned list."""
    med = ranks.quantile_row(df, {c: (c, 0.5) for c in cols}, index=index).first()
    kept = [c for c in cols if med[c] is not None]
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(med[c])) for c in kept}), kept


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "") -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Zero mean, unit population deviation; returns the moments for the way back. Constant columns become zero."""
    m = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
               *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    moments = {c: (m[f"m{i}"] or 0.0, m[f"s{i}"] or 1.0) for i, c in enumerate(cols)}
    return df.withColumns({c + suffix: (F.col(c) - mu) / sd for c, (mu, sd) in moments.items()}), moments


def unstandardize(df: DataFrame, moments: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Back to raw units."""
    return df.withColumns({c: F.col(c) * sd + mu for c, (mu, sd) in moments.items()})


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out).transform(df)


def contiguous_folds(df: DataFrame, order: str, k: int = 5, out: str = "fold") -> DataFrame:
    """k contiguous folds along a numeric key, cut at exact positions; no global sort of the rows."""
    cut = ranks.quantile_row(df, {f"c{i}": (order, i / k) for i in range(1, k)}, rule="index").first()
    fold = F.lit(0)
    for v in cut:
        fold = fold + F.when(F.col(order) >= v, 1).otherwise(0)
    return df.withColumn(out, fold.cast("int"))


def hashed_folds(df: DataFrame, key: str, k: int, out: str = "fold") -> DataFrame:
    """k random-like folds that depend on the key alone."""
    return df.withColumn(out, F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(k)).cast("int"))


def forest(target: str, trees: int = 500, depth: int = 8, min_leaf: int = 5, seed: int = 42) -> RandomForest:
    return RandomForest(target, trees, depth, min_leaf, seed)


def cv_r2(df: DataFrame, estimator: RandomForest, target: str, fold: str = "fold") -> tuple[float, float]:
    """Mean and deviation of out-of-fold R2."""
    ev = RegressionEvaluator(labelCol=target, predictionCol="prediction", metricName="r2")
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())
    scores = [ev.evaluate(estimator.fit(df.where(F.col(fold) != i)).transform(df.where(F.col(fold) == i))) for i in folds]
    return float(np.mean(scores)), float(np.std(scores))


def importance_rows(df: DataFrame, model, features: Sequence[str], roles: Mapping[str, str]) -> DataFrame:
    """(feature, role, importance), strongest first."""
    values = model.featureImportances.toArray()
    rows = [(f, roles.get(f, ""), float(v)) for f, v in zip(features, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, role string, importance double") \
             .orderBy(F.desc("importance"), "feature")


def role_shares(importances: DataFrame) -> DataFrame:
    """Share of the total importance per role."""
    total = importances.agg(F.sum("importance").alias("_t"))
    by_role = importances.groupBy("role").agg(F.sum("importance").alias("s"))
    return ranks.with_scalars(by_role, total).select("role", (F.col("s") / F.col("_t")).alias("share"))


def lasso(df: DataFrame, features: Sequence[str], target: str, block: str = "block", folds: int = 5, grid: int = 100, eps: float = 1e-3) -> tuple[float, np.ndarray, float]:
    """L1 regression on standardised columns: (penalty, coefficients, cross-validated R2), all from one scan.

    ``block`` numbers the rows' consecutive blocks, ``folds`` squared of them, so that the folds inside a training part are whole blocks too.
    """
    parts = gram.collect_moments(df, [*features, target], block)
    alpha, coefs = gram.lasso_cv(parts, folds, grid, eps)
    return alpha, coefs, gram.lasso_r2(parts, folds, grid=grid, eps=eps)


def coefficient_rows(df: DataFrame, coefs: Sequence[float], features: Sequence[str], roles: Mapping[str, str]) -> DataFrame:
    """Non-zero coefficients, strongest first, with the sign."""
    rows = [(f, roles.get(f, ""), float(c)) for f, c in zip(features, coefs) if c != 0]
    out = df.sparkSession.createDataFrame(rows, "feature string, role string, coef double")
    return out.withColumn("direction", F.when(F.col("coef") > 0, "positive").otherwise("negative")) \
              .orderBy(F.desc(F.abs("coef")), "feature")


def top_effects(coefs: DataFrame, role: str = "human", k: int = 5) -> DataFrame:
    """Strongest k coefficients of a role on each side of zero."""
    w = Window.partitionBy("direction").orderBy(F.desc(F.abs("coef")), "feature")
    ranked = coefs.where(F.col("role") == role).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= k)


def halves(df: DataFrame, by: str, high: str = "arid", low: str = "humid") -> dict[str, DataFrame]:
    """Median split of the rows, taken before any row is dropped."""
    med = ranks.quantile_row(df, {"m": (by, 0.5)}).first()["m"]
    return {high: df.where(F.col(by) > med), low: df.where(F.col(by) <= med)}


def half_importances(df: DataFrame, by: str, features: Sequence[str], target: str, trees: int = 200, depth: int = 6,
                     k: int = 5, min_n: int = 50) -> DataFrame:
    """Top importances of a forest fitted to each half."""
    out = None
    for name, half in halves(df, by).items():
        sub = half.where(F.col(target).isNotNull()).select(*features, target)
        sub = X.at_least_filled(sub, max(3, len(features) // 2))
        n = sub.count()
        if n < min_n:
            continue
        filled, kept = impute_medians(sub, features)
        model = forest(target, trees, depth).fit(assemble(filled, kept))
        rows = importance_rows(df, model, kept, {}).limit(k).select(
            F.lit(name).alias("half"), F.lit(n).cast("long").alias("n"), "feature", F.round("importance", 4).alias("importance"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else df.sparkSession.createDataFrame([], "half string, n long, feature string, importance double")


# -- clusters ----------------------------------------------------------------------------------------------------


def elbow(costs: Mapping[int, float]) -> int:
    """k with the largest second difference of the cost curve, shifted by one and clamped to the searched range."""
    ks = sorted(costs)
    second = np.diff(np.diff([costs[k] for k in ks]))
    at = int(np.argmax(second)) + ks[0] + 1
    return max(ks[0], min(ks[-1], at))


def elbow_table(curve: DataFrame) -> DataFrame:
    """(k, cost) to relative cost and second difference; the curve has one row per searched k."""
    w = Window.partitionBy(F.lit(0)).orderBy("k")
    d1 = F.col("cost") - F.lag("cost").over(w)
    x = curve.withColumn("_d1", d1).withColumn("second_diff", F.col("_d1") - F.lag("_d1").over(w))
    first = F.first("cost").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return x.withColumn("cost_pct", F.col("cost") / first * 100).drop("_d1")


def elbow_k(curve: DataFrame) -> DataFrame:
    """The chosen k as a one-row frame, computed in SQL."""
    t = elbow_table(curve)
    pick = t.where(F.col("second_diff").isNotNull()).agg(F.min_by("k", F.struct((-F.col("second_diff")).alias("d"), "k")).alias("k2"))
    span = curve.agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    # the second difference of position i sits two rows further on: i + k_min + 1 = (row's k) - 1
    return ranks.with_scalars(pick, span).select(
        F.least(F.col("hi"), F.greatest(F.col("lo"), F.col("k2") - 1)).cast("int").alias("best_k"))


def centre_rows(df: DataFrame, features: Sequence[str], cluster: str = "cluster_id") -> DataFrame:
    """Cluster centres in raw units with sizes and rule-based names."""
    names = {c: c for c in ("eto_avg_in", config.LOG_TARGET, "poverty_rate", "avg_farm_size_ac", "precip_deficit_in")}
    col = lambda c: F.col(c) if c in features else F.lit(0.0)
    agg = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_entities"), *[F.round(F.avg(c), 4).alias(c) for c in features])
    return agg.withColumn("cluster_name", X.cluster_label(col(names["eto_avg_in"]), col(config.LOG_TARGET), col("poverty_rate"),
                                                          col("avg_farm_size_ac"), col("precip_deficit_in")))


def label_entities(df: DataFrame, assigned: DataFrame, centres: DataFrame, key: str) -> DataFrame:
    """Entity -> cluster -> name; the centres are at most k rows."""
    named = assigned.select(key, "cluster_id").join(F.broadcast(centres.select("cluster_id", "cluster_name")), "cluster_id", "left")
    return df.join(named, key, "left")


def cluster_entities(df: DataFrame, key: str, features: Sequence[str], target: str, k_range: Sequence[int] = range(2, 13),
                     restarts: int = 10, final_restarts: int = 20, stage: Callable[[DataFrame], DataFrame] = lambda d: d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Impute, standardise, search k by the elbow, fit: (entities with cluster, centres, cost curve)."""
    base = df.select(key, *features, target).where(F.col(target).isNotNull())
    base = X.at_least_filled(base, int(len(features) * 0.4))
    filled, kept = impute_medians(base, features)
    cols = [*kept, target]
    scaled, _ = standardize(filled, cols, "_z")
    data = stage(scaled.select(key, *cols, F.array(*[c + "_z" for c in cols]).alias("features")))
    costs = {k: cost for k, (_, cost) in lloyd.best_of(data, key, list(k_range), restarts).items()}
    k = elbow(costs)
    centres = lloyd.best_of(data, key, [k], final_restarts, seed=43)[k][0]
    centres = centres[np.lexsort(np.round(centres, 6).T)]  # numbered by the target's centre, so that a rerun gives the same ids
    assigned = stage(lloyd.assigned(data, centres).select(key, *cols, "cluster_id"))
    curve = df.sparkSession.createDataFrame(sorted(costs.items()), "k int, cost double")
    return assigned, centre_rows(assigned, cols), curve
