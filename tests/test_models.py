import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from rillwork.functions.stats import poisson_counts, poisson_one, t_p_value, t_two_sided
from rillwork.operators import attribution, effects, gram, lloyd, models, newton, profile, raster, screens
from rillwork.session import stage


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    n = 600
    x1, x2, x3 = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    t = 0.7 * x1 + rng.normal(size=n)
    y = 2.0 * (t > np.median(t)) + 1.5 * x1 - x2 + 0.1 * rng.normal(size=n)
    data = [(f"{i:05d}", i, float(a), float(b), float(c), float(d), float(e)) for i, (a, b, c, d, e) in enumerate(zip(x1, x2, x3, t, y))]
    return stage(spark.createDataFrame(data, "fips string, key long, x1 double, x2 double, x3 double, t double, y double"), "sample")


def test_shap_adds_up_and_matches_brute_force(spark, sample):
    feats = ["x1", "x2", "x3", "t"]
    vec = models.assemble(sample, feats)
    model = models.forest("y", trees=3, depth=3).fit(vec)
    shap, base = attribution.shap_values(sample, model, "fips", feats)
    total = shap.groupBy("fips").agg(F.sum("shap").alias("s")).join(model.transform(vec).select("fips", "prediction"), "fips")
    assert total.agg(F.max(F.abs(F.col("s") + base - F.col("prediction")))).first()[0] < 1e-9

    leaves, _ = attribution.leaf_paths(spark, model)
    row = sample.orderBy("fips").first()
    x = np.array([row[f] for f in feats])

    def value(subset):  # expected prediction when only the subset is known
        out = 0.0
        for v, _, conds in leaves:
            w = 1.0
            for f, lo, hi, z in conds:
                w *= float(lo < x[f] <= hi) if f in subset else z
            out += v * w
        return out

    got = {r["feature"]: r["shap"] for r in shap.where(F.col("fips") == row["fips"]).collect()}
    for j, name in enumerate(feats):
        others, phi = [k for k in range(4) if k != j], 0.0
        for size in range(4):
            for s in itertools.combinations(others, size):
                phi += math.factorial(size) * math.factorial(3 - size) / 24 * (value({*s, j}) - value(set(s)))
        assert got[name] == pytest.approx(phi, abs=1e-9)
    means = {r["feature"]: r["mean_abs_shap"] for r in attribution.mean_absolute(sample, model, feats, ["x1", "t"]).collect()}
    assert means == {r["feature"]: r["mean_abs_shap"] for r in attribution.shap_ranking(shap, ["x1", "t"]).collect()}
    worst = attribution.extremes(model.transform(vec), shap, "fips", k=2)
    assert worst.count() == 4


def test_importances_and_folds(spark, sample):
    x = models.contiguous_folds(sample, "key", 5)
    assert rows(x.groupBy("fold").agg(F.count("key"), F.min("key"))) == [(i, 120, i * 120) for i in range(5)]
    model = models.forest("y", trees=5, depth=3).fit(models.assemble(x, ["x1", "x2"]))
    shares = models.role_shares(models.importance_rows(x, model, ["x1", "x2"], {"x1": "climate", "x2": "human"}))
    assert shares.agg(F.sum("share")).first()[0] == pytest.approx(1.0)
    r2, _ = models.cv_r2(models.assemble(x, ["x1", "x2", "t"]), models.forest("y", trees=5, depth=4), "y")
    assert r2 > 0.5


def test_lasso_finds_the_support(sample):
    z, _ = models.standardize(models.contiguous_folds(sample, "key", 25), ["x1", "x2", "x3"])
    _, c, r2 = models.lasso(z, ["x1", "x2", "x3"], "y", "fold", grid=20)
    assert c[0] > 1 and c[1] < -0.7 and abs(c[2]) < 0.2 and 0.5 < r2 < 1


def proximal_lasso(x, y, alpha):
    """Another way to the same minimum: accelerated proximal gradient steps on centred data."""
    xc, yc, n = x - x.mean(0), y - y.mean(), len(y)
    step, b, v, t = n / np.linalg.norm(xc, 2) ** 2, np.zeros(x.shape[1]), np.zeros(x.shape[1]), 1.0
    for _ in range(20000):
        g = v + step * xc.T @ (yc - xc @ v) / n
        new = np.sign(g) * np.maximum(np.abs(g) - step * alpha, 0)
        t, old = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v, b = new + (old - 1) / t * (new - b), new
    return b


def test_lasso_from_moments_equals_row_fits(sample):
    cols = ["x1", "x2", "x3", "t"]
    z, _ = models.standardize(models.contiguous_folds(sample, "key", 25), cols)
    parts = gram.collect_moments(z, [*cols, "y"], "fold")
    data = np.array([[*r] for r in z.orderBy("key").select(*cols, "y", "fold").collect()])
    x, y, block = data[:, :4], data[:, 4], data[:, 5].astype(int)
    alphas = gram.penalties(gram.total(parts), 30, 1e-3)
    assert len(parts) == 25 and alphas[0] == pytest.approx(np.abs((x - x.mean(0)).T @ (y - y.mean())).max() / len(y))
    errors = np.zeros((5, 30))
    for f in range(5):
        out = (block // 5) == f
        path = gram.lasso_path(gram.total([p for i, p in enumerate(parts) if i // 5 != f]), alphas)
        for k in (0, 7, 15, 29):
            b = proximal_lasso(x[~out], y[~out], alphas[k])
            assert path[k] == pytest.approx(b, abs=1e-6)
        for k, b in enumerate(path):
            errors[f, k] = ((y[out] - (y[~out].mean() - x[~out].mean(0) @ b) - x[out] @ b) ** 2).mean()
    alpha, coefs = gram.lasso_cv(parts, grid=30)
    assert alpha == pytest.approx(alphas[errors.mean(0).argmin()])
    assert coefs == pytest.approx(proximal_lasso(x, y, alpha), abs=1e-6)


def numpy_logistic(x, t, strength):
    x1, b = np.column_stack([np.ones(len(t)), x]), np.zeros(x.shape[1] + 1)
    pen = np.r_[0.0, np.full(x.shape[1], 1 / strength)]
    for _ in range(200):
        mu = 1 / (1 + np.exp(-x1 @ b))
        b = b - 0.5 * np.linalg.solve((x1 * (mu * (1 - mu))[:, None]).T @ x1 + np.diag(pen + 1e-12), x1.T @ (mu - t) + pen * b)
    return b


def test_grouped_newton_equals_single_fits(spark):
    rng, rows_, data = np.random.default_rng(8), [], {}
    for m, n in (("a", 300), ("b|x", 120), ("c", 40)):
        x = rng.normal(size=(n, 3))
        t = (x @ [1.0, -0.5, 0.0] + rng.normal(size=n) > 0.3).astype(float)
        fold = rng.integers(0, 5, n)
        data[m] = (x, t, fold)
        rows_ += [(m, int(f), float(a), [float(v) for v in r]) for f, a, r in zip(fold, t, x)]
    frame = spark.createDataFrame(rows_, "model string, fold int, t double, x array<double>").repartition(7)
    strengths = list(np.logspace(-4, 4, 10))
    fits = newton.logistic_fits(frame, list(data), 3, strengths, 5)
    for m, (x, t, fold) in data.items():
        for c in (0, 4, 7):
            for f in (0, -1):
                use = fold != f
                assert fits[m][c, f] == pytest.approx(numpy_logistic(x[use], t[use], strengths[c]), abs=1e-6)
    for m, (strength, b) in newton.chosen_fits(frame, list(data), 3, strengths).items():
        x, t, fold = data[m]
        right = [[((np.column_stack([np.ones((fold == f).sum()), x[fold == f]]) @ fits[m][c, f] > 0) == (t[fold == f] > 0.5)).mean() for f in range(5)] for c in range(10)]
        assert strength == strengths[int(np.argmax(np.round(np.mean(right, axis=1), 12)))]
        assert b == pytest.approx(numpy_logistic(x, t, strength), abs=1e-6)


def test_separable_arms_do_not_stop_the_fits(spark):
    frame = spark.createDataFrame([("m", i % 5, float(i >= 20), [float(i), 0.0]) for i in range(40)] + [("one", i % 5, 1.0, [float(i), 1.0]) for i in range(10)], "model string, fold int, t double, x array<double>")
    fits = newton.chosen_fits(frame, ["m", "one"], 2, [0.01, 1e3])
    assert all(np.isfinite(b).all() for _, b in fits.values()) and fits["m"][1][1] > 0


def test_many_models_equal_single_ones(spark, sample):
    df = sample.withColumn("group", F.when(F.col("x3") > 0, "hi").otherwise("lo")).withColumn("x4", F.when(F.col("x1") > -1, F.col("x2") * 2)).withColumn("void", F.lit(None).cast("double"))
    plan = {"t": ["x1", "x2", "x4", "void"], "x3": ["x1", "x2", "t"]}
    both = {(r["treatment_col"], r["group"]): r for r in effects.weighted_models(df, "fips", "y", plan, group="group", estimator="hajek", replicates=20, min_n=40, min_arm=15, strengths=[0.1, 10.0]).collect()}
    assert set(both) == {(t, g) for t in plan for g in ("hi", "lo")}
    assert all(r["ate_se"] > 0 for r in both.values())
    for t, g in (("t", "hi"), ("x3", "lo")):
        r = both[t, g]
        one = effects.ipw(df.where(F.col("group") == g), "fips", t, "y", plan[t], estimator="hajek", strengths=[0.1, 10.0])
        assert {k: one[k] for k in one} == {k: r[k] for k in one}
    pdf = df.where("group = 'hi'").toPandas()
    cut = pdf["t"].median()
    x = pdf[["x1", "x2", "x4"]].fillna(pdf[["x1", "x2", "x4"]].median()).to_numpy()
    x = (x - x.mean(0)) / x.std(0)
    t, y = (pdf["t"] > cut).to_numpy(float), pdf["y"].to_numpy()
    best = None
    for strength in (0.1, 10.0):
        b = numpy_logistic(x, t, strength)
        ps = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
        w = np.where(t == 1, 1 / ps, 1 / (1 - ps))
        w = np.minimum(w, np.percentile(w, 95))
        ate = round(float(np.average(y[t == 1], weights=w[t == 1]) - np.average(y[t == 0], weights=w[t == 0])), 4)
        best = best or ate == pytest.approx(both["t", "hi"]["ate"], abs=2e-4)
    assert best  # the effect under one of the strengths; which one is chosen is tested above


def test_bootstrap_error_matches_resampling(spark):
    rng = np.random.default_rng(3)
    n = 400
    t, y = np.arange(n) % 2, rng.normal(size=n) * (1 + np.arange(n) % 3)
    df = spark.createDataFrame([(f"{i:05d}", "g", float(t[i] + i * 1e-6), float(y[i] + t[i])) for i in range(n)], "fips string, group string, t double, y double")
    got = effects.group_effects(df, "group", ["g"], "t", "y", key="fips", replicates=400).first()
    draws = []
    for _ in range(2000):
        w = rng.poisson(1, n)
        draws.append(np.average((y + t)[t == 1], weights=w[t == 1]) - np.average((y + t)[t == 0], weights=w[t == 0]))
    assert got["ate_se"] == pytest.approx(np.std(draws, ddof=1), rel=0.12)
    counts = spark.range(40000).select(poisson_one("id", "id").alias("k")).groupBy("k").count().collect()
    for r in counts:
        if r["k"] < 5:
            assert r["count"] / 40000 == pytest.approx(math.exp(-1) / math.factorial(r["k"]), abs=0.01)


def test_p_values_without_python(spark):
    cases = [(t, dof) for t in (0.0, 1e-4, -0.3, 1.0, 1.7, 1.75, -2.5, 4.0, 9.0, 30.0) for dof in (1, 2, 3, 7, 30, 398, 10 ** 5, 10 ** 7, 10 ** 9)]
    got = spark.createDataFrame([(float(t), float(d)) for t, d in cases], "t double, d double").select("t", "d", t_p_value(F.col("t"), F.col("d")).alias("p")).collect()
    for r in got:
        # with very many degrees of freedom it is the normal tail, which needs no difference of large logarithms
        want = math.erfc(abs(r["t"]) / math.sqrt(2)) if r["d"] == 1e9 else t_two_sided(r["t"], r["d"])
        assert r["p"] == pytest.approx(want, rel=1e-6, abs=1e-14)
    odd = spark.createDataFrame([(None, 3.0), (1.0, None), (1.0, 0.0), (float("inf"), 4.0), (float("nan"), 4.0)], "t double, d double").select(t_p_value(F.col("t"), F.col("d")).alias("p"))
    assert [r["p"] for r in odd.collect()] == [None, None, None, 0.0, None]


def test_batched_lloyd_equals_single_runs(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 0.8, size=(80, 3)) for c in (0, 3, 6)])
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, features array<double>").repartition(5)
    starts = {s: lloyd.spread_starts(x, k, rng) for s, k in enumerate([2, 3, 4, 3])}
    starts[4] = np.array([[0.0, 0, 0], [99.0, 99, 99]])
    for s, (centres, cost) in lloyd.lloyd(frame, starts).items():
        c = starts[s].copy()
        for _ in range(100):
            near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
            c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
        assert centres == pytest.approx(c, abs=1e-6) and cost == pytest.approx(((x - c[((x[:, None] - c[None]) ** 2).sum(2).argmin(1)]) ** 2).sum())
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        assert [r["cluster_id"] for r in lloyd.assigned(frame, centres).orderBy("id").collect()] == near.tolist()
    best = lloyd.best_of(frame, "id", [2, 3], 5)
    assert best[3][1] < best[2][1]


def test_standardize_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 2.0)], "a double, b double")
    z, m = models.standardize(df, ["a", "b"])
    assert rows(z) == [(-1.0, 0.0), (1.0, 0.0)]
    assert rows(models.unstandardize(z, m)) == [(1.0, 2.0), (3.0, 2.0)]


def test_elbow():
    costs = {2: 100.0, 3: 60.0, 4: 30.0, 5: 25.0, 6: 21.0}
    assert models.elbow(costs) == 2 + 1 + 1  # sharpest bend between 3-4 and 4-5


def test_elbow_sql_agrees(spark):
    costs = {2: 100.0, 3: 60.0, 4: 30.0, 5: 25.0, 6: 21.0}
    curve = spark.createDataFrame(list(costs.items()), "k int, cost double")
    assert models.elbow_k(curve).first()[0] == models.elbow(costs)


def test_clusters_recover_blobs(spark):
    rng = np.random.default_rng(1)
    pts = [(f"{i:05d}", float(rng.normal(c * 10, 0.3)), float(rng.normal(-c * 10, 0.3)), float(c)) for i, c in enumerate(np.repeat([0, 1, 2], 60))]
    df = spark.createDataFrame(pts, "fips string, eto_avg_in double, precip_deficit_in double, log_crop_water_eff double")
    got, centres, curve = models.cluster_entities(df, "fips", ["eto_avg_in", "precip_deficit_in"], "log_crop_water_eff", range(2, 6), 2, 2)
    costs = [r["cost"] for r in curve.orderBy("k").collect()]
    assert costs[1] < costs[0] * 0.2 and centres.agg(F.sum("n_entities")).first()[0] == 180
    assert models.label_entities(df, got, centres, "fips").where("cluster_name IS NULL").count() == 0


def test_equal_arms_give_half_the_difference(spark):
    rng = np.random.default_rng(2)
    data = spark.createDataFrame([(str(i), float(rng.normal() + (i % 2)), float(i % 2), 0.5) for i in range(200)], "fips string, _y double, _t double, _ps double")
    naive = data.agg(F.avg(F.when(F.col("_t") == 1, F.col("_y"))) - F.avg(F.when(F.col("_t") == 0, F.col("_y")))).first()[0]
    assert effects.weighted_effect(data, "signed").first()["ate"] == pytest.approx(naive / 2, abs=1e-4)
    assert effects.weighted_effect(data, "hajek").first()["ate"] == pytest.approx(naive, abs=1e-4)


def test_effects_adjust_for_confounding(sample):
    naive = effects.naive_effects(sample, ["t"], "y").first()
    assert naive["n_treated"] == 300 and naive["naive_ate"] > 2.4 and naive["naive_p"] < 1e-4
    adj = effects.ipw(sample, "fips", "t", "y", ["x1", "x2"], estimator="hajek", strengths=[1.0])
    assert abs(adj["ate"] - 2.0) < abs(naive["naive_ate"] - 2.0)
    assert effects.ipw(sample.limit(40), "fips", "t", "y", ["x1"]) is None
    dr = effects.doubly_robust(sample, "fips", "t", "y", ["x1", "x2"], half_by="x3", folds=2, trees=10, depth=5, boost=5, boost_depth=2).first()
    assert abs(dr["ate"] - 2.0) < 0.5 and dr["n"] == 600


def test_simulation_crosses_thresholds(spark):
    fx = spark.createDataFrame([("a", 0.5, 0.4), ("b", 10.0, -0.2)], "treatment_col string, threshold double, ate double")
    ent = spark.createDataFrame([("1", 100.0, 0.2, 20.0, 1.0), ("2", None, 0.5, None, 1.0)], "fips string, crop_water_eff double, a double, b double, c double")
    sc = spark.createDataFrame([(1, "1", 0.6, 5.0, 2.0), (2, "1", 0.5, None, None), (3, "2", 0.7, 5.0, None), (4, "9", 0.1, 1.0, None)], "scenario_id int, fips string, a double, b double, c double")
    got = {r["scenario_id"]: r for r in effects.simulate(sc, fx, ent, ["a", "b", "c"]).collect()}
    assert got[1]["simulated_efficiency"] == round(math.expm1(math.log1p(100) + 0.4 + 0.2), 2)
    assert [c["feature"] for c in got[1]["changes"]] == ["a", "b"]          # no effect is known for c
    assert got[2]["delta_pct"] == 0.0                                        # a value equal to the threshold is not treated
    assert got[3]["simulated_efficiency"] == round(math.expm1(0.4), 2) and len(got[3]["changes"]) == 1
    assert 4 not in got


def test_vif_and_pairs(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=400), rng.normal(size=400)
    df = spark.createDataFrame([(float(x), float(y), float(x + y + 0.01 * z)) for x, y, z in zip(a, b, rng.normal(size=400))], "a double, b double, c double")
    cols, m = profile.correlation_matrix(df, ["a", "b", "c"])
    assert np.allclose(m, np.corrcoef(np.array(df.collect()).T))
    kept, dropped = profile.vif_prune(cols, m)
    assert len(dropped) == 1 and all(v < 10 for _, v in kept)
    assert profile.high_pairs(profile.pair_correlations(df, ["a", "b", "c"]), 0.99).count() == 0


def test_coverage_threshold(spark):
    df = spark.createDataFrame([(1.0 if i < 29 else None, 1.0 if i < 30 else None, None) for i in range(100)], "low double, edge double, none double")
    assert profile.usable_columns(df, ["low", "edge", "none", "edge", "absent"]) == ["edge"]


def test_opening_matches_untiled(spark):
    rng = np.random.default_rng(4)
    mask = rng.random((60, 50)) < 0.93
    mask[10:25, 5:30] = True
    cells = spark.createDataFrame([(int(x), int(y), 5 if mask[x, y] else 90, "z1" if x < 30 else "z2") for x in range(60) for y in range(50)], "x long, y long, class int, zone string")
    got = raster.opened_cells(cells, radius=2, tile=16).cache()
    want = raster._opening(mask, 2)
    assert got.count() == int(mask.sum())
    assert {(r["x"], r["y"]) for r in got.where("kept").collect()} == set(zip(*(int(v) if np.isscalar(v) else v.tolist() for v in np.nonzero(want))))
    again = raster.opened_cells(got.where("kept").withColumn("class", F.lit(1)), radius=2, tile=16)
    assert again.where("NOT kept").count() == 0  # opening twice changes nothing
    share = raster.zonal_share(got, cell_m2=4046.86, min_acres=0)
    assert {r["zone"]: r["total_crop_ac"] for r in share.collect()} == {"z1": float(mask[:30].sum()), "z2": float(mask[30:].sum())}


def test_findings(spark):
    df = spark.createDataFrame([("t", "A", 1.0, 0.01), ("t", "B", 9.0, 0.05), ("t", "[C]", 99.0, 0.0), ("u", "A", 1.0, 0.01), ("u", "B", 2.0, 0.01)], "treatment_col string, group string, ate_pct double, p_value double")
    assert rows(effects.findings(df).select("treatment_col", "min_group", "max_group", "gap")) == [("t", "A", "B", 8.0)]


def test_attribution_tables_equal_subset_sums(monkeypatch):
    rng, leaves = np.random.default_rng(3), []
    cuts = np.round(rng.normal(size=(12, 4)), 1)
    for n in (0, 1, 2, 5, 8, 8, 8, 11):  # the last one asks for more thresholds than a table has
        conds = []
        for f in rng.permutation(12)[:n]:
            lo, hi = sorted(rng.choice(cuts[f], 2, replace=False))
            conds.append((int(f), *[(lo, hi), (-np.inf, hi), (lo, np.inf)][rng.integers(3)], float(rng.uniform(0.1, 0.9))))
        leaves.append((float(rng.normal()), 1.0, conds))
    x = np.vstack([rng.normal(size=(3000, 12)), cuts.T])

    def expected(row):
        phi = np.zeros(12)
        for value, _, conds in leaves:
            d = len(conds)
            for j, (f, lo, hi, z) in enumerate(conds):
                others = [c for k, c in enumerate(conds) if k != j]
                poly = np.array([1.0])  # by the size of the subset: products of passing inside and of ratios outside
                for g, a, b, r in others:
                    poly = np.convolve(poly, [r, float(a < row[g] <= b)])
                weight = [1 / (d * math.comb(d - 1, s)) for s in range(d)]
                phi[f] += value * (poly @ weight) * (float(lo < row[f] <= hi) - z)
        return phi

    tables = attribution.Tables(leaves, 12)
    assert any(len(g[0]) > attribution.BITS for g in tables.groups) and len(tables.groups) < 7
    got = tables.contributions(x)
    for i in (0, 1, 2999, 3000, 3003):
        assert got[i] == pytest.approx(expected(x[i]), abs=1e-12)
    assert tables.contributions(x[:5]) == pytest.approx(got[:5], abs=1e-12) and tables.contributions(x[:0]).shape == (0, 12)

    few = attribution.Tables(leaves[:-1], 12)
    calls, make = [], few._rows
    monkeypatch.setattr(few, "_rows", lambda *a: calls.append(1) or make(*a))
    few.contributions(np.tile(x[:1000], (8, 1)))
    assert len(calls) == len(few.groups)  # a table serves all rows


def test_scan_of_sets_of_several_sizes(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(700, 3)), 1)
    sets = {i: x[rng.choice(700, k, replace=False)] for i, k in enumerate((3, 2, 5, 3, 2))}
    sets[5] = np.vstack([sets[1], sets[1]])  # equal centres: the first one gets the rows
    one = lloyd._nearest(np.array([[[1.0, 2.0], [1.0, 0.5]]]), np.array([[1.0, 0.5]]))
    assert one.tolist() == [[[True, False], [False, True]]]
    got = lloyd._sums(spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(3), sets, "features")
    for s, centres in sets.items():
        away = ((x[:, None] - centres[None]) ** 2).sum(2)
        near, (n, cost, total) = away.argmin(1), got[s]
        assert cost == pytest.approx(away.min(1).sum()) and n.sum() == 700
        if s < 5:
            tied = (np.sort(away, 1)[:, 1] - np.sort(away, 1)[:, 0] < 1e-9).sum()
            assert np.abs(n - np.bincount(near, minlength=len(centres))).sum() <= 2 * tied
        assert total.sum(0) == pytest.approx(x.sum(0))


def test_rows_are_not_shuffled_by_group_or_model(spark, sample):
    """What belongs to a group or model is one row and goes to the rows, whatever sizes the optimizer assumes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        by_group = effects.group_effects(sample.withColumn("group", F.substring("fips", 3, 1)), "group", ["0", "1"], "t", "y", with_p=False)
        weighted, _ = effects.weighted_rows(sample, "fips", "y", {"t": ["x1", "x2"]}, strengths=[1.0], stage=lambda d: stage(d, "ipw"))
        for df, n in ((by_group, 2), (weighted, 600)):
            assert df.count() == n
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert re.search(r"BroadcastHashJoin \[(group|model)#\d+\],", plan)  # the quantiles have joins of their own
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_counts_of_all_replicates_are_those_of_one(spark):
    keys = spark.range(200).select(F.when(F.col("id") != 7, F.format_string("%05d", "id")).alias("k"))
    each = keys.withColumn("seed", F.xxhash64("k")).withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn("n", poisson_one("k", "r")).toPandas()
    table = each.pivot(index="seed", columns="r", values="n")
    assert (poisson_counts(table.index.to_numpy(), 30) == table.to_numpy()).all() and table.to_numpy().max() > 3


def test_replicates_are_not_rows(spark):
    """Counts are drawn inside the tasks: no plan with a row for each row and replicate."""
    rows_ = [(f"{i:05d}", "ab"[i % 2], float(i % 2), float(i % 3 == 0), 1.0 + i % 5) for i in range(300)]
    df = spark.createDataFrame(rows_, "key string, model string, _y double, _t double, _w double").repartition(5)
    for estimator in ("signed", "hajek"):
        got = effects.bootstrap(df, "model", "key", 25, *effects._parts(estimator))
        assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
        drawn = df.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(25)))).withColumn("_n", poisson_one("key", "r")).where("_n > 0").withColumn("_w", F.col("_w") * F.col("_n"))
        want = drawn.groupBy("model", "r").agg(effects._estimate(estimator).alias("e")).groupBy("model").agg(F.stddev_samp("e").alias("se"))
        assert {r["model"]: r["se"] for r in got.collect()} == pytest.approx({r["model"]: r["se"] for r in want.collect()})


def test_scans_read_packed_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5000, 3))
    frame = spark.createDataFrame([(v.tolist(),) for v in x], "features array<double>").repartition(2)
    sets = {0: x[:3], 1: x[5:7], 2: x[9:12]}
    packed, scan, read = lloyd._packed(frame, "features"), lloyd._sums, []
    assert packed.count() < 10
    for s, (n, cost, total) in lloyd._sums(packed, sets, "block").items():
        rows_n, rows_cost, rows_total = lloyd._sums(frame, sets, "features")[s]
        assert n.tolist() == rows_n.tolist() and cost == pytest.approx(rows_cost) and total == pytest.approx(rows_total)
    monkeypatch.setattr(lloyd, "_sums", lambda data, centres, vector: read.append(data.schema[vector].dataType.typeName()) or scan(data, centres, vector))
    lloyd.lloyd(frame, sets, most=3)
    assert set(read) == {"binary"}
    assert lloyd._sums(lloyd._packed(frame.limit(0), "features"), sets, "block")[0][0].sum() == 0
