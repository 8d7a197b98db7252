"""Additive attributions of tree ensembles (path-dependent TreeSHAP, Lundberg et al. 2018) as a distributed map."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from rillwork.operators.forests import RandomForestModel
from rillwork.session import scratch_path


def leaf_paths(spark, model) -> tuple[list[tuple[float, float, list[tuple[int, float, float, float]]]], float]:
    """Leaves of all trees as (value, weight, [(feature, low, high, cover ratio)]), and the mean prediction.

    Repeated splits on one feature are merged: the interval is intersected and the cover ratios are multiplied.
    The node table has at most trees x 2^(depth+1) rows.
    """
    if isinstance(model, RandomForestModel):
        nodes = model.nodes()
    else:
        path = scratch_path(spark, "forest")
        model.write().save(path)
        nodes = spark.read.parquet(f"{path}/data").select(
            "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
            "nodeData.rightChild", F.col("nodeData.split.featureIndex").alias("f"),
            F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("t")).collect()
    trees: dict[int, dict[int, object]] = {}
    for n in nodes:
        trees.setdefault(n["treeID"], {})[n["id"]] = n
    weights = list(model.treeWeights)
    leaves, base = [], 0.0
    for tid, tree in trees.items():
        scale = weights[tid] / (len(trees) if type(model).__name__.startswith("RandomForest") else 1.0)
        total = float(tree[0]["impurityStats"][0])
        stack = [(0, {})]
        while stack:
            nid, conds = stack.pop()
            node = tree[nid]
            if node["leftChild"] < 0:
                cover = float(node["impurityStats"][0])
                base += scale * node["prediction"] * cover / total
                leaves.append((scale * node["prediction"], cover, [(f, lo, hi, z) for f, (lo, hi, z) in conds.items()]))
                continue
            for child, low, high in ((node["leftChild"], -np.inf, node["t"]), (node["rightChild"], node["t"], np.inf)):
                lo, hi, z = conds.get(node["f"], (-np.inf, np.inf, 1.0))
                ratio = float(tree[child]["impurityStats"][0]) / float(node["impurityStats"][0])
                stack.append((child, {**conds, node["f"]: (max(lo, low), min(hi, high), z * ratio)}))
    return leaves, base


#: Leaves share a table while they ask for at most so many different thresholds.
BITS = 9
#: Rows explained with one table at hand, and in one step.
BLOCK, STEP = 65_536, 4_096


class Tables:
    """Leaves in groups of neighbours. What a leaf adds depends only on which thresholds a row exceeds, so a group has one row of attributions for each combination.

    A leaf gives feature j the integral over t in 0..1 of value (o_j - z_j) prod_{i != j} (z_i (1 - t) + o_i t), where o tells which
    conditions the row passes and z are the cover ratios: the weighted count of feature subsets. Its degree is below the number of
    conditions, so Gauss-Legendre nodes give it exactly.
    """

    def __init__(self, leaves, width: int):
        self.width, seats = width, {}
        self.groups = []
        held: list = []
        asked: dict[tuple[int, float], int] = {}
        for value, _, conds in leaves:
            if not conds:
                continue
            own = [(f, t) for f, lo, hi, _ in conds for t in (lo, hi) if np.isfinite(t)]
            if held and len(asked.keys() | set(own)) > BITS:
                self._close(held, asked, seats)
                held, asked = [], {}
            for o in own:
                asked.setdefault(o, len(asked))
            held.append((value, conds))
        if held:
            self._close(held, asked, seats)
        self.feature = np.array([f for f, _ in seats], int)
        self.threshold = np.array([t for _, t in seats], float)
        #: Rows whose comparisons take at most 64 MB.
        self.block = int(np.clip((64 << 20) // max(1, 2 * len(seats)), STEP, BLOCK))

    def _close(self, held, asked, seats) -> None:
        m, d = len(asked), max(len(c) for _, c in held)
        shape = (len(held), d)
        z, low, high, of = np.ones(shape), np.full(shape, m), np.full(shape, m), np.zeros(shape, int)
        for i, (_, conds) in enumerate(held):
            for j, (f, lo, hi, ratio) in enumerate(conds):
                z[i, j], of[i, j] = ratio, f
                low[i, j], high[i, j] = asked.get((f, lo), m), asked.get((f, hi), m)
        at = np.array([seats.setdefault(o, len(seats)) for o in asked], int)
        self.groups.append((at, np.array([v for v, _ in held]), z, low, high, of))

    def _rows(self, group, above: np.ndarray) -> np.ndarray:
        """Attributions for columns of ``above``: which thresholds of the group are exceeded."""
        at, value, z, low, high, of = group
        none = np.zeros((1, above.shape[1]), bool)
        passed = np.concatenate([above, ~none])[low] & ~np.concatenate([above, none])[high]  # leaves x conditions x columns
        t, w = _nodes((z.shape[1] + 1) // 2)
        g0 = z[:, :, None] * (1 - t)
        g1 = g0 + t
        product = np.repeat((value[:, None] * w)[:, :, None], above.shape[1], axis=2)
        for i in range(z.shape[1]):
            product *= np.where(passed[:, i, None, :], g1[:, i, :, None], g0[:, i, :, None])
        parts = np.where(passed, ((1 - z)[:, :, None] / g1) @ product, (-z[:, :, None] / g0) @ product)
        place = np.zeros((of.size, self.width))
        place[np.arange(of.size), of.ravel()] = 1
        return parts.reshape(of.size, -1).T @ place

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Attributions for rows of features."""
        phi = np.zeros((len(x), self.width))
        for lo in range(0, len(x), self.block):
            self._add(x[lo:lo + self.block], phi[lo:lo + self.block])
        return phi

    def _add(self, x: np.ndarray, phi: np.ndarray) -> None:
        above = np.empty((len(self.feature), len(x)), np.uint16)
        columns = np.ascontiguousarray(x.T)
        for i, (f, t) in enumerate(zip(self.feature, self.threshold)):
            np.logical_not(columns[f] <= t, out=above[i], casting="unsafe")
        for group in self.groups:
            at = group[0]
            m = len(at)
            direct = m > BITS or len(x) < 1 << m
            table = None if direct else self._rows(group, (np.arange(1 << m) >> np.arange(m)[:, None] & 1).astype(bool))
            for lo in range(0, len(x), STEP):
                part = slice(lo, lo + STEP)
                if direct:
                    phi[part] += self._rows(group, above[at, part].astype(bool))
                    continue
                which = above[at[0], part].copy()
                for i in range(1, m):
                    which |= above[at[i], part] << np.uint16(i)
                phi[part] += table.take(which, axis=0)


@lru_cache(None)
def _nodes(n: int) -> tuple[np.ndarray, np.ndarray]:
    t, w = np.polynomial.legendre.leggauss(n)
    return (t + 1) / 2, w / 2


def _joined(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Batches put together up to about ``most`` rows, so that tables are made once for many rows."""
    held, n = [], 0
    for pdf in batches:
        if len(pdf):
            held.append(pdf)
            n += len(pdf)
        if n >= most:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def shap_values(df: DataFrame, model, key: str, features: Sequence[str], key_type: str = "string") -> tuple[DataFrame, float]:
    """(key, feature, shap) for every row and feature, and the base value; base + sum(shap) is the prediction."""
    spark = df.sparkSession
    leaves, base = leaf_paths(spark, model)
    names = list(features)
    shared = spark.sparkContext.broadcast(Tables(leaves, len(names)))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = shared.value
        for pdf in _joined(batches, tables.block):
            phi = tables.contributions(pdf[names].to_numpy(dtype=float))
            for lo in range(0, len(pdf), STEP):
                keys = pdf[key].to_numpy()[lo:lo + STEP]
                yield pd.DataFrame({"key": np.repeat(keys, len(names)), "feature": np.tile(names, len(keys)), "shap": phi[lo:lo + STEP].ravel()})

    rows = df.select(F.col(key).cast(key_type).alias(key), *[F.col(c).cast("double") for c in names])
    out = rows.mapInPandas(explain, f"key {key_type}, feature string, shap double").withColumnRenamed("key", key)
    return out, base


def mean_absolute(df: DataFrame, model, features: Sequence[str], chosen: Sequence[str], digits: int = 5) -> DataFrame:
    """Mean absolute attribution of the chosen features, strongest first. Every task sends one sum per feature; attributions of rows are not written."""
    spark = df.sparkSession
    names = list(features)
    shared = spark.sparkContext.broadcast(Tables(leaf_paths(spark, model)[0], len(names)))

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, np.zeros(len(names))
        for pdf in _joined(batches, shared.value.block):
            n += len(pdf)
            total += np.abs(shared.value.contributions(pdf.to_numpy(dtype=float))).sum(axis=0)
        yield pd.DataFrame({"feature": names, "n": n, "total": total})

    sums = df.select(*[F.col(c).cast("double") for c in names]).mapInPandas(explain, "feature string, n long, total double").groupBy("feature").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = sums.where(F.col("feature").isin(list(chosen))).select("feature", F.round(F.col("total") / F.nullif("n", F.lit(0)), digits).alias("mean_abs_shap"))
    return out.orderBy(F.desc("mean_abs_shap"), "feature")


def shap_ranking(shap: DataFrame, features: Sequence[str], digits: int = 5) -> DataFrame:
    """Mean absolute attribution of the chosen features, strongest first."""
    return shap.where(F.col("feature").isin(list(features))).groupBy("feature").agg(
        F.round(F.avg(F.abs("shap")), digits).alias("mean_abs_shap")).orderBy(F.desc("mean_abs_shap"), "feature")


def extremes(predicted: DataFrame, shap: DataFrame, key: str, prediction: str = "prediction", k: int = 10) -> DataFrame:
    """Best and worst entity by prediction with their k strongest attributions."""
    pick = predicted.agg(F.min_by(key, F.struct((-F.col(prediction)).alias("p"), F.col(key))).alias("best"),
                         F.min_by(key, F.struct(prediction, key)).alias("worst"))
    ids = pick.select(F.explode(F.array(F.struct(F.lit("best").alias("which"), F.col("best").alias(key)),
                                        F.struct(F.lit("worst").alias("which"), F.col("worst").alias(key)))).alias("e")).select("e.*")
    w = Window.partitionBy("which").orderBy(F.desc(F.abs("shap")), "feature")
    rows = shap.join(F.broadcast(ids), key).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return rows.withColumn("sign", F.when(F.col("shap") >= 0, "+").otherwise("-"))
