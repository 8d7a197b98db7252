"""Forests against trees grown one by one from the same draws."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillwork.operators import forests, models


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=900), (rng.random(900) < 0.02).astype(float)  # b: two values, one of them rare
    y = np.where(a > 0.3, 2.0, 0.0) + 5.0 * b + 0.1 * rng.normal(size=900) + 100
    c = rng.integers(0, 5, 900).astype(float)
    return models.assemble(spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, y)], "a double, b double, c double, y double"), ["a", "b", "c"])


def gains(x, y, w, rows, min_leaf):
    """(feature, cut) -> variance reduction of the allowed cuts of a node."""
    out, mean = {}, np.average(y[rows], weights=w[rows])
    for f in range(len(x)):
        for cut in range(x[f].max()):
            parts = [rows[x[f, rows] <= cut], rows[x[f, rows] > cut]]
            if min(w[p].sum() for p in parts) >= min_leaf:
                out[f, cut] = sum(w[p].sum() * (np.average(y[p], weights=w[p]) - mean) ** 2 for p in parts)
    return out


@pytest.mark.parametrize("block", [10_000, 400])
def test_trees_equal_those_grown_alone(sample, monkeypatch, block):
    monkeypatch.setattr(forests, "BLOCK", block)
    packed, kept = forests.RandomForest._packed, []
    monkeypatch.setattr(forests.RandomForest, "_packed", lambda self, *a: kept.append(packed(self, *a)) or kept[-1])
    model = models.forest("y", trees=6, depth=4).fit(sample)
    blocks = {r["block"]: r for r in kept[0].collect()}
    assert len(blocks) == -(-900 // block)
    y = np.concatenate([np.frombuffer(r["y"]) for r in blocks.values()])
    x = np.concatenate([np.frombuffer(r["x"], np.uint8).reshape(3, -1) for r in blocks.values()], axis=1)
    keys = np.concatenate([np.arange(len(r["y"]) // 8, dtype=np.uint64) + np.uint64(b << 32) for b, r in blocks.items()])
    all_y = np.array([r[0] for r in sample.select("y").collect()])
    for tree in range(6):
        w, todo, seen = forests.draws(forests._mix(keys), tree, 42).astype(float), [(0, np.arange(len(y)))], 0
        while todo:
            node, rows = todo.pop()
            seen += 1
            assert model.cover[tree, node] == w[rows].sum()
            assert model.value[tree, node] == pytest.approx(all_y.mean() + all_y.std() * np.average(y[rows], weights=w[rows]))
            f, cut = model.feature[tree, node], model.cut[tree, node]
            allowed = gains(x, y, w, rows, 5) if node < 2 ** 4 - 1 else {}
            if f < 0:
                assert max(allowed.values(), default=0) < 1e-9
                continue
            assert allowed[f, cut] == pytest.approx(max(allowed.values())) and model.gain[tree, node] == pytest.approx(allowed[f, cut])
            todo += [(2 * node + 1, rows[x[f, rows] <= cut]), (2 * node + 2, rows[x[f, rows] > cut])]
        assert np.count_nonzero(model.cover[tree]) == seen
    assert model.featureImportances[1] > 0.05  # the rare value is cut off, although no quantile falls between the two


def test_predictions_are_the_leaves_that_rows_reach(sample):
    model = models.forest("y", trees=4, depth=4).fit(sample)
    nodes = {(n["treeID"], n["id"]): n for n in model.nodes()}

    def leaf(tree, x):
        n = nodes[tree, 0]
        while n["leftChild"] >= 0:
            n = nodes[tree, n["leftChild"] if x[n["f"]] <= n["t"] else n["rightChild"]]
        return n["prediction"]

    for r in model.transform(sample).limit(200).collect():
        assert r["prediction"] == pytest.approx(np.mean([leaf(t, r["features"]) for t in range(4)]), abs=1e-9)


def test_draws_are_poisson_counts():
    d = forests.draws(forests._mix(np.arange(200_000, dtype=np.uint64)), 3, 42)
    assert d.mean() == pytest.approx(1, abs=0.01) and d.var() == pytest.approx(1, abs=0.02) and (d == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    other = forests.draws(forests._mix(np.arange(200_000, dtype=np.uint64)), 4, 42)
    assert abs(np.corrcoef(d, other)[0, 1]) < 0.01


def test_constant_targets_tiny_tables_and_nulls(spark, sample):
    flat = models.forest("one", trees=3, depth=3).fit(sample.withColumn("one", F.lit(0.1)))
    assert (flat.feature < 0).all() and flat.featureImportances.toArray().tolist() == [0, 0, 0]
    assert flat.transform(sample.limit(3)).select("prediction").distinct().count() == 1
    one = models.forest("y", trees=3, depth=3).fit(sample.limit(1))
    assert one.transform(sample.limit(1)).where(F.abs(F.col("prediction") - F.col("y")) < 1e-9).count() == 1
    for bad in (sample.where("false"), sample.withColumn("y", F.when(F.col("a") > 0, F.col("y")))):
        with pytest.raises(ValueError):
            models.forest("y", trees=2, depth=2).fit(bad)
