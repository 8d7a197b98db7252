import math

import numpy as np

from rillwork.llm import forest

SCHEMA = "vec_id long, embedding array<float>, label int, id string, vector string, code string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def brute(rows, least=0.98):
    """(vec_id, n_links, component) of every row."""
    def ok(v):
        return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)

    def unit(v):
        v = np.array(v, np.float32).astype(float)
        return v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max())

    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, v, s) in enumerate(rows):
        for j in range(i):
            _, w, t = rows[j]
            if s is not None and s == t and ok(v) and ok(w) and len(v) == len(w) and unit(v) @ unit(w) >= least:
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        low.setdefault(root(i), []).append(r[0])
    return sorted((str(r[0]), n[i], str(min((x for x in low[root(i)] if x is not None), default=None))) for i, r in enumerate(rows))


def check(spark, rows, **options):
    out = forest.near_vectors(frame(spark, rows), **options).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in out) == brute(rows)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)


def test_deep_trees_find_all_links(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 32))
    rows = []
    for i in range(500):
        v = centres[i % 60] + rng.normal(size=32) * rng.choice([0.0, 0.05, 0.2])
        rows.append((i, [float(x) for x in v], i % 2))
    rows += [(500 + i, rows[7][1], 1) for i in range(40)]  # equal vectors
    rows += [(600 + i, [float(x + 0.001 * rng.normal()) for x in centres[3]], 1) for i in range(60)]  # a group too dense to cut
    check(spark, rows, leaf=16, sample=256, block=20)


def test_odd_rows(spark):
    v, nan = [1.0, 2.0, 3.0], float("nan")
    rows = [(1, v, 1), (2, v, None), (3, None, 1), (4, [], 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, nan, 3.0], 1), (7, [1.0, None, 3.0], 1), (8, [1e30, 2e30, 3e30], 1), (9, [1.0, 2.0], 1),
            (10, [-0.0, 1.0, 0.0], 2), (11, [0.0, 1.0, -0.0], 2), (12, [1e-30, 2e-30, 3e-30], 1), (13, v, 2), (14, [float("inf"), 1.0, 1.0], 1), (1, v, 1), (15, [2.0, 4.0, 6.0], 1)]
    check(spark, rows)


def test_null_ids_and_empty(spark):
    out = forest.near_vectors(frame(spark, [(None, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (None, None, 1)])).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in out) == [("4", 1, "4", True), ("None", 0, "None", False), ("None", 1, "4", False)]
    assert forest.near_vectors(frame(spark, [])).count() == 0


def test_descend_reaches_both_sides_once():
    x, fresh = forest.normal(list(np.random.default_rng(2).normal(size=(200, 8)))), np.zeros(200, bool)
    cuts = forest.grow(x, fresh, 0, 99, 4, 0.05)
    leaves = forest.descend(x, fresh, 0, 99, cuts, 0.05)
    count = np.bincount(np.concatenate([a for _, a, _ in leaves]), minlength=200)
    assert len(leaves) > 4 and set(count.tolist()) == {1, 2}
    spilt = {int(i) for _, a, s in leaves for i, now in zip(a, s) if now}
    assert spilt == set(np.flatnonzero(count == 2).tolist())
