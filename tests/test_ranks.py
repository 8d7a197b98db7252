import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rillwork.operators import ranks


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 6000
    a = np.where(rng.random(n) < 0.35, 7.0, np.round(rng.lognormal(3, 2, n), 2))  # a third of the rows share one value
    pdf = pd.DataFrame({"id": np.arange(n), "a": a, "b": np.round(rng.normal(size=n), 1), "g": rng.choice(["x", "y"], n, p=[0.8, 0.2])})
    pdf.loc[rng.random(n) < 0.1, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.when(~F.isnan("a"), F.col("a"))).cache()
    return pdf, df


def test_quantiles_match_pandas(data):
    pdf, df = data
    wanted = {f"{c}{p}": (c, p) for c in "ab" for p in (0.0, 0.05, 0.33, 0.5, 0.9, 1.0)}
    got = ranks.quantile_row(df, wanted).first()
    for name, (c, p) in wanted.items():
        assert got[name] == pytest.approx(pdf[c].quantile(p), abs=1e-9)
    index = ranks.quantile_row(df, wanted, rule="index").first()
    for name, (c, p) in wanted.items():
        s = np.sort(pdf[c].dropna().to_numpy())
        assert index[name] == s[min(len(s) - 1, int(len(s) * p))]


def test_group_quantiles(data):
    pdf, df = data
    got = {r["g"]: r["m"] for r in ranks.group_quantiles(df, "g", {"m": ("b", 0.25)}).collect()}
    assert got == pytest.approx(pdf.groupby("g")["b"].quantile(0.25).to_dict())


def test_rank_pct_uses_average_rank(data):
    pdf, df = data
    got = ranks.rank_pct(df, "a", "p").toPandas().sort_values("id")
    assert len(got) == len(pdf)
    want = pdf["a"].rank(pct=True).to_numpy()
    assert np.allclose(got["p"].to_numpy(dtype=float), want, equal_nan=True, atol=1e-12)


def test_rank_share_and_pareto(data):
    pdf, df = data
    got = ranks.rank_and_share(df, "a").toPandas().sort_values("id")
    assert np.allclose(got["rank"].to_numpy(dtype=float), pdf["a"].rank(method="min", ascending=False).to_numpy(), equal_nan=True)
    assert got["share"].sum() == pytest.approx(1.0)
    s = np.sort(pdf["a"].dropna().to_numpy())[::-1]
    cum = s.cumsum()
    p = ranks.pareto(df, "a").first()
    assert (p["top50pct"], p["top80pct"]) == (int(np.argmax(cum >= cum[-1] * 0.5)) + 1, int(np.argmax(cum >= cum[-1] * 0.8)) + 1)


def test_windows_run_inside_value_ranges(data):
    _, df = data
    plan = ranks.rank_pct(df, "a", "p")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_r#" in line or "sum(_n#" in line for line in windows)  # inside a range, or over one row per range


def test_robust_norm_edges(spark):
    df = spark.createDataFrame([(i, float(i), None) for i in range(21)], "id int, v double, empty double")
    out = {r["id"]: r for r in ranks.robust_norm(df, {"v": "up", "empty": "none"}).collect()}
    assert out[0]["up"] == 0.0 and out[20]["up"] == 1.0 and out[10]["up"] == 0.5 and out[3]["none"] is None
    down = {r["id"]: r["d"] for r in ranks.robust_norm(df, {"v": "d"}, reverse=["v"]).collect()}
    assert down[0] == 1.0 and down[20] == 0.0


def test_min_max_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    assert [tuple(r)[2:] for r in ranks.min_max(df, {"a": "x", "b": "y"}).orderBy("a").collect()] == [(0.0, 0.0), (1.0, 0.0)]
