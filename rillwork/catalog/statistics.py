"""Profiles, correlations, models, attributions, effects, clusters and the raster opening."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillwork import config
from rillwork.catalog.base import LINES, RANKED, WIDE, lines, product, query, ranked, table, target_index, wide, wide_index
from rillwork.functions import columns as X
from rillwork.operators import attribution, effects, gram, lloyd, models, profile, ranks, raster
from rillwork.session import stage

FEATURES = [*config.CLIMATE, *config.SOIL, *config.HUMAN]
ROLES = {**{c: "climate" for c in config.CLIMATE}, **{c: "soil" for c in config.SOIL}, **{c: "human" for c in config.HUMAN}}
LOG = config.LOG_TARGET


def modelled(spark, d):
    """Rows with a target, numeric key for contiguous folds."""
    return wide(spark, d).where(F.col(LOG).isNotNull()).withColumn("key", F.col("fips").cast("long"))


def _label(df, label):
    return stage(df, label)


_keep = lambda label: (lambda df: stage(df, label))

# -- profiles ---------------------------------------------------------------------------------------------------------

_P = ", ".join(f"round(quantile_cont(crop_water_eff, {p / 100}), 6) AS p{p}" for p in (10, 25, 50, 75, 90))


@query("a14_distribution", f"WITH {WIDE} SELECT count(crop_water_eff) AS n, round(avg(crop_water_eff), 6) AS mean, round(median(crop_water_eff), 6) AS median, round(stddev_samp(crop_water_eff), 6) AS std, {_P} FROM wide")
def a14(spark, d):
    return profile.distribution(wide(spark, d), "crop_water_eff", digits=6, index=wide_index(spark, d))


@query("a15_coverage", f"WITH {WIDE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count({c}) AS n, round(count({c}) / count(*)::DOUBLE * 100, 1) AS pct, count({c}) / count(*) < 0.3 AS low_coverage, '{ROLES[c]}' AS role FROM wide" for c in FEATURES))
def a15(spark, d):
    return profile.coverage(wide(spark, d), FEATURES, ROLES)


@query("a16_correlations", f"WITH {WIDE}, c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, {LOG}) AS r, count(*) FILTER ({c} IS NOT NULL AND {LOG} IS NOT NULL) AS n FROM wide" for c in FEATURES)
       + ") SELECT feature, round(r, 3) AS r, n FROM c WHERE n >= 50")
def a16(spark, d):
    return profile.correlations(wide(spark, d), FEATURES, LOG).select("feature", "r", "n")


def _p_sql(t: str, dof: str) -> str:
    """Two-sided p-value of Student's t by the log-gamma function and the continued fraction; expressions over columns."""
    a, q = f"({dof} / 2.0::DOUBLE)", f"({t} * {t})"
    front = f"exp(lgamma({a} + 0.5) - lgamma({a})) / sqrt(pi()) * exp(-{a} * ln(1 + {q} / {dof})) * sqrt({q} / ({dof} + {q}))"
    cf = lambda a, b, x: (f"(1 / list_reduce(list_prepend(1.0::DOUBLE, list_transform(range(0, 120), lambda k: (120 - k)::DOUBLE)), lambda v, n: 1 + (CASE WHEN n % 2 = 0 THEN floor(n / 2) * ({b} - floor(n / 2)) * {x} "
                          f"/ (({a} + 2 * floor(n / 2) - 1) * ({a} + 2 * floor(n / 2))) ELSE -({a} + floor(n / 2)) * ({a} + {b} + floor(n / 2)) * {x} / (({a} + 2 * floor(n / 2)) * ({a} + 2 * floor(n / 2) + 1)) END) / v))")
    return (f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, CASE WHEN {q} > 3 THEN {front} * {cf(a, '0.5::DOUBLE', f'({dof} / ({dof} + {q}))')} / {a} "
            f"ELSE 1 - 2 * {front} * {cf('0.5::DOUBLE', a, f'({q} / ({dof} + {q}))')} END))")


@query("a16p_correlation_tests", f"WITH {WIDE}, c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, corr({c}, {LOG}) AS r, count(*) FILTER ({c} IS NOT NULL AND {LOG} IS NOT NULL) AS n FROM wide" for c in FEATURES)
       + f"), t AS (SELECT *, abs(r) * sqrt((n - 2) / (1 - r * r)) AS t, (n - 2)::DOUBLE AS d FROM c WHERE n >= 50), p AS (SELECT *, {_p_sql('t', 'd')} AS p0 FROM t) SELECT feature, round(r, 3) AS r, n, round(p0, 4) AS p, p0 < 0.05 AS significant FROM p")
def a16p(spark, d):
    return profile.correlations(wide(spark, d), FEATURES, LOG)


_NONNULL = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)


@query("a17_correlation_matrix", f"WITH {WIDE}, c AS (SELECT * FROM wide WHERE {_NONNULL}) " + " UNION ALL ".join(
    f"SELECT {i}::INT AS i, {j}::INT AS j, " + ("1.0::DOUBLE AS r" if i == j else f"round(corr({a}, {b}), 6) AS r FROM c")
    for i, a in enumerate(FEATURES) for j, b in enumerate(FEATURES)))
def a17(spark, d):
    x = wide(spark, d)
    cols, m = profile.correlation_matrix(x, FEATURES)
    return profile.matrix_rows(x, cols, m).select("i", "j", F.round("r", 6).alias("r"))


@query("a18_vif")
def a18(spark, d):
    x = wide(spark, d).withColumn("deficit_twice", F.col("precip_deficit_in") * 2 + F.col("drought_intensity"))
    cols, m = profile.correlation_matrix(x, [*FEATURES, "deficit_twice"])
    kept, dropped = profile.vif_prune(cols, m)
    rows = [(f, v, False) for f, v in kept] + [(f, None, True) for f in dropped]
    return spark.createDataFrame(rows, "feature string, vif double, dropped boolean")


_PAIR = FEATURES


@query("a19_high_pairs", f"WITH {WIDE}, c AS (SELECT * FROM wide WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _PAIR)}), p AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS feat1, '{b}' AS feat2, corr({a}, {b}) AS r FROM c" for i, a in enumerate(_PAIR) for b in _PAIR[i + 1:]) + ") SELECT feat1, feat2, round(r, 3) AS r FROM p WHERE abs(r) > 0.7")
def a19(spark, d):
    return profile.high_pairs(profile.pair_correlations(wide(spark, d), _PAIR))


@query("a20_high_low", f"WITH {WIDE}, q AS (SELECT quantile_cont({LOG}, 0.33) AS lo, quantile_cont({LOG}, 0.66) AS hi FROM wide), m AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT median({c}) FROM wide, q WHERE {LOG} >= hi) AS h, (SELECT median({c}) FROM wide, q WHERE {LOG} <= lo) AS l" for c in config.HUMAN)
    + ") SELECT feature, round(h, 3) AS high_eff_median, round(l, 3) AS low_eff_median, round(h / l, 2) AS ratio FROM m WHERE l <> 0 AND h IS NOT NULL")
def a20(spark, d):
    return profile.high_low(wide(spark, d), LOG, config.HUMAN, index=wide_index(spark, d))


@query("a21_histogram", f"""WITH {WIDE}, v AS (SELECT least(crop_water_eff, (SELECT quantile_cont(crop_water_eff, 0.99) FROM wide)) AS v FROM wide WHERE crop_water_eff IS NOT NULL),
e AS (SELECT min(v) AS a, max(v) AS b FROM v) SELECT least(floor((v - a) / ((b - a) / 60)), 59)::INT AS bin, count(*) AS n FROM v, e GROUP BY 1""")
def a21(spark, d):
    return profile.histogram(wide(spark, d), "crop_water_eff", index=wide_index(spark, d))


@query("a21b_log_histogram", f"""WITH {WIDE}, v AS (SELECT {LOG} AS v FROM wide WHERE {LOG} IS NOT NULL), e AS (SELECT min(v) AS a, max(v) AS b FROM v)
SELECT least(floor((v - a) / ((b - a) / 60)), 59)::INT AS bin, count(*) AS n FROM v, e GROUP BY 1""")
def a21b(spark, d):
    return profile.histogram(wide(spark, d), LOG, clip_q=None)


@query("a22b_mean_marker", """WITH v AS (SELECT c_acctbal AS v FROM customer), s AS (SELECT min(v) AS a, max(v) AS b, avg(v) AS mean, 0.25 * stddev_samp(v) AS h FROM v), g AS (SELECT a + i * (b - a) / 499 AS x FROM s, range(0, 500) AS r(i)),
k AS (SELECT x, sum(exp(-0.5 * ((x - v) / h) * ((x - v) / h))) AS d FROM g, s, v GROUP BY x), m AS (SELECT mean, sum(exp(-0.5 * ((mean - v) / h) * ((mean - v) / h))) AS d FROM s, v GROUP BY mean)
SELECT round(mean, 4) AS x, round(m.d / (SELECT max(d) FROM k) * 0.38, 6) AS height, CASE WHEN mean < 0 THEN 'negative' WHEN mean > 0 THEN 'positive' ELSE 'both' END AS side FROM m""")
def a22b(spark, d):
    k = profile.kernel_density(table(spark, d, "customer"), "c_acctbal", points=500)
    return k.where("g = -1").select(F.round("x", 4).alias("x"), F.round("height", 6).alias("height"), "side")


@query("a22_kernel_density", """WITH v AS (SELECT c_acctbal AS v FROM customer), s AS (SELECT min(v) AS a, max(v) AS b, 0.25 * stddev_samp(v) AS h FROM v), g AS (SELECT unnest(range(0, 500))::INT AS g),
k AS (SELECT g, a + g * (b - a) / 499 AS x, sum(exp(-0.5 * ((a + g * (b - a) / 499 - v) / h) * ((a + g * (b - a) / 499 - v) / h))) AS d FROM g, s, v GROUP BY g, a, b)
SELECT g, round(x, 4) AS x, round(d / (SELECT max(d) FROM k) * 0.38, 6) AS height, CASE WHEN x < 0 THEN 'negative' WHEN x > 0 THEN 'positive' ELSE 'both' END AS side FROM k""")
def a22(spark, d):
    k = profile.kernel_density(table(spark, d, "customer"), "c_acctbal", points=500)
    return k.where("g >= 0").select("g", F.round("x", 4).alias("x"), F.round("height", 6).alias("height"), "side")


@query("a30_size_guards", """WITH x AS (SELECT o_custkey AS g, CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS t FROM orders), a AS (SELECT g, count(*) AS n, CAST(sum(t) AS BIGINT) AS n_treat, CAST(sum(1 - t) AS BIGINT) AS n_ctrl FROM x GROUP BY 1)
SELECT *, CASE WHEN n < 8 THEN 'too few rows' WHEN n_treat < 2 OR n_ctrl < 2 THEN 'arm too small' ELSE 'ok' END AS reason FROM a""")
def a30(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("g"), F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("t"))
    return profile.size_guards(o, "g", "t", 8, 2)


# -- design matrices ----------------------------------------------------------------------------------------------------


@query("m1_impute_medians", f"WITH {WIDE} SELECT fips, " + ", ".join(f"round(coalesce({c}, (SELECT median({c}) FROM wide)), 6) AS {c}" for c in FEATURES) + " FROM wide")
def m1(spark, d):
    x, kept = models.impute_medians(wide(spark, d).select("fips", *FEATURES), FEATURES, index=wide_index(spark, d))
    return x.select("fips", *[F.round(c, 6).alias(c) for c in kept])


@query("m2_standardize", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 6) AS z, round(c_acctbal, 4) AS back FROM customer")
def m2(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    z, moments = models.standardize(c, ["c_acctbal"])
    back = models.unstandardize(z.withColumn("z", F.col("c_acctbal")), moments)
    return back.select("c_custkey", F.round("z", 6).alias("z"), F.round("c_acctbal", 4).alias("back"))


def design(spark, d, blocks=5):
    """Imputed design matrix with contiguous folds, staged before the fits. Rows need half of the columns."""
    x = models.contiguous_folds(X.at_least_filled(modelled(spark, d), len(FEATURES) // 2, [*FEATURES, LOG]), "key", blocks)
    filled, kept = models.impute_medians(x, FEATURES)
    return stage(filled.select("fips", "key", "fold", *kept, LOG), "design"), kept


@query("m3_forest_cv")
def m3(spark, d):
    x, kept = design(spark, d)
    vectors = stage(models.assemble(x, kept).select("features", "fold", LOG), "vectors")
    r2, sd = models.cv_r2(vectors, models.forest(LOG), LOG)
    return spark.createDataFrame([(round(r2, 3), round(sd, 3), len(kept))], "r2 double, r2_sd double, n_features int")


_FORESTS: dict[tuple, tuple] = {}


def _forest(spark, d, refit=False, **settings):
    """A forest on all rows, by default the published one: (design rows, columns, model). Queries of a session share it."""
    key = (spark.sparkContext.applicationId, d, *sorted(settings.items()))
    if refit or key not in _FORESTS:
        x, kept = design(spark, d)
        _FORESTS[key] = x, kept, models.forest(LOG, **settings).fit(models.assemble(x, kept))
    return _FORESTS[key]


@query("m4_importance_shares")
def m4(spark, d, **settings):
    x, kept, model = _forest(spark, d, **settings)
    return models.role_shares(models.importance_rows(x, model, kept, ROLES))


def _scaled(spark, d):
    x, kept = design(spark, d, blocks=25)
    z, _ = models.standardize(x, kept)
    return stage(z, "scaled"), kept


_BLOCKS = [*FEATURES, LOG]
_Z = ", ".join(f"(v{i} - avg(v{i}) OVER ()) / stddev_pop(v{i}) OVER () AS z{i}" for i in range(len(FEATURES)))
_V = ", ".join(f"coalesce({c}, (SELECT median({c}) FROM kept)) AS v{i}" for i, c in enumerate(FEATURES))
_CUTS = " + ".join(f"CASE WHEN seat >= floor(total * ({i / 25!r}::DOUBLE)) THEN 1 ELSE 0 END" for i in range(1, 25))


@query("m5g_block_moments", f"""WITH {WIDE}, kept AS (SELECT * FROM wide WHERE {LOG} IS NOT NULL AND {' + '.join(f'({c} IS NOT NULL)::INT' for c in FEATURES)}  + 1 >= {len(FEATURES) // 2}),
place AS (SELECT *, row_number() OVER (ORDER BY fips::BIGINT) - 1 AS seat, count(*) OVER () AS total FROM kept), v AS (SELECT ({_CUTS})::INT AS block, {LOG} AS z{len(FEATURES)}, {_V} FROM place),
z AS (SELECT block, 1.0::DOUBLE AS one, z{len(FEATURES)}, {_Z} FROM v), """ + "long AS (" + " UNION ALL ".join(
    f"SELECT block, {i}::INT AS i, {j}::INT AS j, sum({'one' if i < 0 else f'z{i}'} * {'one' if j < 0 else f'z{j}'}) AS s FROM z GROUP BY block" for i in range(-1, len(_BLOCKS)) for j in range(i, len(_BLOCKS)))
    + ") SELECT block, i, j, round(s, 6) + 0.0 AS s FROM long")
def m5g(spark, d):
    z, kept = _scaled(spark, d)
    return gram.block_moments(z.withColumnRenamed("fold", "block"), [*kept, LOG], "block").select("block", "i", "j", (F.round("s", 6) + 0.0).alias("s"))


@query("m5_lasso")
def m5(spark, d):
    z, kept = _scaled(spark, d)
    alpha, coefs, r2 = models.lasso(z, kept, LOG, "fold")
    top = models.top_effects(models.coefficient_rows(z, coefs, kept, ROLES))
    return top.withColumn("penalty", F.lit(round(alpha, 6))).withColumn("cv_r2", F.lit(round(r2, 3)))


@query("m6_half_importances")
def m6(spark, d):
    return models.half_importances(wide(spark, d), "precip_deficit_in", config.HUMAN, LOG)


# -- effects -------------------------------------------------------------------------------------------------------------

_TREAT = list(config.HUMAN)


def _naive_sql(t: str) -> str:
    src = f"(SELECT {t} AS x, {LOG} AS y, (SELECT median({t}) FROM wide WHERE {LOG} IS NOT NULL) AS m FROM wide WHERE {t} IS NOT NULL AND {LOG} IS NOT NULL)"
    return (f"SELECT '{t}' AS treatment_col, round(max(m), 4) AS threshold, count(*) FILTER (x > m) AS n_treated, count(*) FILTER (x <= m) AS n_control, round(avg(y) FILTER (x > m) - avg(y) FILTER (x <= m), 4) AS naive_ate, "
            f"round((avg(y) FILTER (x > m) - avg(y) FILTER (x <= m)) / sqrt(((count(*) FILTER (x > m) - 1) * var_samp(y) FILTER (x > m) + (count(*) FILTER (x <= m) - 1) * var_samp(y) FILTER (x <= m)) / (count(*) - 2) "
            f"* (1.0::DOUBLE / count(*) FILTER (x > m) + 1.0::DOUBLE / count(*) FILTER (x <= m))), 4) AS t_stat FROM {src}")


@query("m7_naive_effects", f"WITH {WIDE} " + " UNION ALL ".join(_naive_sql(t) for t in _TREAT))
def m7(spark, d):
    return effects.naive_effects(wide(spark, d), _TREAT, LOG, with_p=False, index=target_index(spark, d))


@query("m7p_naive_tests", f"WITH {WIDE}, e AS (" + " UNION ALL ".join(_naive_sql(t).replace("round(avg(y)", "(avg(y)").replace(", 4) AS naive_ate", ") AS naive_ate").replace("round((avg(y)", "((avg(y)").replace(", 4) AS t_stat", ") AS t_stat") for t in _TREAT) + f"), f AS (SELECT *, (n_treated + n_control - 2)::DOUBLE AS d FROM e) "
    f"SELECT treatment_col, threshold, n_treated, n_control, round(naive_ate, 4) AS naive_ate, round(t_stat, 4) AS t_stat, round({_p_sql('t_stat', 'd')}, 4) AS naive_p FROM f")
def m7p(spark, d):
    return effects.naive_effects(wide(spark, d), _TREAT, LOG, index=target_index(spark, d))


@query("m8_inverse_propensity")
def m8(spark, d):
    plan = {"crop_diversity_hhi": [*config.CLIMATE, *config.SOIL, *[c for c in config.HUMAN if c != "crop_diversity_hhi"]]}
    clipped, _ = effects.weighted_rows(modelled(spark, d), "fips", LOG, plan, stage=_keep("ipw"))
    both = [effects.effect_row(clipped, est).withColumn("estimator", F.lit(est)) for est in ("signed", "hajek")]
    return both[0].unionByName(both[1])


def _spread(x, spark):
    """Rows over all tasks: attributions cost far more than moving them. A task makes the tables of the trees once, so it gets some thousand rows if there are."""
    tasks = max(spark.sparkContext.defaultParallelism, min(int(spark.conf.get("spark.sql.shuffle.partitions")), x.count() // 16_384))
    return x.repartition(tasks, "fips")


def _shap(spark, d):
    x, kept, model = _forest(spark, d)
    shap = product(spark, d, "shap", lambda: attribution.shap_values(_spread(x, spark), model, "fips", kept)[0])
    return models.assemble(x, kept), model, shap


@query("m9_tree_shap")
def m9(spark, d, **settings):
    x, kept, model = _forest(spark, d, **settings)
    return attribution.mean_absolute(_spread(x, spark), model, kept, [c for c in kept if ROLES[c] == "human"])


@query("m10_extreme_entities")
def m10(spark, d):
    x, model, shap = _shap(spark, d)
    return attribution.extremes(model.transform(x).select("fips", "prediction"), shap, "fips")


@query("m11_doubly_robust")
def m11(spark, d):
    return effects.doubly_robust(modelled(spark, d), "fips", "crop_diversity_hhi", LOG, [*config.CLIMATE, *config.SOIL, *[c for c in config.HUMAN if c != "crop_diversity_hhi"]],
                                 half_by="precip_deficit_in", stage=_keep("dr"))


@query("m12_every_treatment")
def m12(spark, d):
    return effects.every_treatment(modelled(spark, d), "fips", LOG, config.HUMAN, [*config.CLIMATE, *config.SOIL], stage=_keep("ipw"))


_GROUPS = ["Arid", "Humid", "Good Soil", "Poor Soil", "AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
_MEMBERS = f"""{WIDE}, md AS (SELECT median(precip_deficit_in) AS c, median(awc_mean) AS s FROM wide), mem AS (
SELECT 'Arid' AS grp, w.* FROM wide w, md WHERE precip_deficit_in > c UNION ALL SELECT 'Humid', w.* FROM wide w, md WHERE precip_deficit_in <= c UNION ALL
SELECT 'Good Soil', w.* FROM wide w, md WHERE awc_mean > s UNION ALL SELECT 'Poor Soil', w.* FROM wide w, md WHERE awc_mean <= s UNION ALL SELECT region, w.* FROM wide w),
rows0 AS (SELECT grp, poverty_rate AS x, {LOG} AS y FROM mem WHERE poverty_rate IS NOT NULL AND {LOG} IS NOT NULL), cut AS (SELECT grp AS g, median(x) AS m FROM rows0 GROUP BY 1),
arm AS (SELECT grp, count(*) AS n, count(*) FILTER (x > m) AS n1, count(*) FILTER (x <= m) AS n0, avg(y) FILTER (x > m) AS m1, avg(y) FILTER (x <= m) AS m0, var_samp(y) FILTER (x > m) AS v1, var_samp(y) FILTER (x <= m) AS v0
FROM rows0 JOIN cut ON grp = g GROUP BY 1)"""


@query("m13_subgroup_effects", f"WITH {_MEMBERS} SELECT grp AS \"group\", 'poverty_rate' AS treatment_col, round(m1 - m0, 4) AS naive_ate, round((exp(m1 - m0) - 1) * 100, 1) AS ate_pct, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)), 4) AS t_stat, "
       "n, n1 AS n_treat, n0 AS n_ctrl FROM arm WHERE n >= 40 AND n1 >= 15 AND n0 >= 15")
def m13(spark, d):
    mem, labels = effects.memberships(wide(spark, d), region="region", min_region=1, min_soil=0, index=wide_index(spark, d))
    return effects.group_effects(mem, "group", labels, "poverty_rate", LOG, with_p=False)


@query("m13s_subgroup_errors")
def m13s(spark, d):
    mem, labels = effects.memberships(wide(spark, d), region="region", min_region=1, min_soil=0, index=wide_index(spark, d))
    return effects.group_effects(stage(mem, "members"), "group", labels, "poverty_rate", LOG, key="fips")


def _subgroups(spark, d):
    named = models.label_entities(modelled(spark, d), _clusters(spark, d), _centres(spark, d), "fips")
    mem, labels = effects.memberships(named, region="region", cluster="cluster_name")
    return effects.subgroup_effects(stage(mem, "members"), "fips", labels, config.SUBGROUP_TREATMENTS, LOG, stage=_keep("ipw"))


@query("m13b_subgroup_ipw")
def m13b(spark, d):
    return product(spark, d, "subgroups", lambda: _subgroups(spark, d))


@query("m14_findings", f"""WITH {_MEMBERS}, e AS (SELECT 'poverty_rate' AS treatment_col, grp AS g, round((exp(m1 - m0) - 1) * 100, 1) AS ate_pct,
abs((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2) * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0))) AS t, (n1 + n0 - 2)::DOUBLE AS d FROM arm WHERE n >= 40 AND n1 >= 15 AND n0 >= 15),
v AS (SELECT * FROM (SELECT *, round({_p_sql('t', 'd')}, 4) AS p FROM e) WHERE p < 0.1) SELECT treatment_col, count(*) AS n_groups, arg_min(g, (ate_pct, g)) AS min_group, min(ate_pct) AS min_pct,
(SELECT g FROM v ORDER BY ate_pct DESC, g LIMIT 1) AS max_group, max(ate_pct) AS max_pct, round(max(ate_pct) - min(ate_pct), 1) AS gap
FROM v GROUP BY 1 HAVING count(*) >= 2 AND abs(round(max(ate_pct) - min(ate_pct), 1)) > 5.0""")
def m14(spark, d):
    mem, labels = effects.memberships(wide(spark, d), region="region", min_region=1, min_soil=0, index=wide_index(spark, d))
    return effects.findings(effects.group_effects(mem, "group", labels, "poverty_rate", LOG))


@query("m14b_ipw_findings")
def m14b(spark, d):
    return effects.findings(m13b(spark, d))


# -- clusters ---------------------------------------------------------------------------------------------------------------


def _fitted(spark, d):
    assigned, centres, curve = models.cluster_entities(wide(spark, d), "fips", config.CLUSTER_FEATURES, LOG, stage=_keep("clusters"))
    return {"clusters": assigned, "cluster-centres": centres, "cluster-curve": models.elbow_table(curve)}


def _part(spark, d, label):
    """One of the three tables of the fit; the fit runs once per session and input."""
    def build():
        parts = _fitted(spark, d)
        for other in parts:
            if other != label:
                product(spark, d, other, lambda: parts[other])
        return parts[label]
    return product(spark, d, label, build)


def _clusters(spark, d):
    return _part(spark, d, "clusters")


def _centres(spark, d):
    return _part(spark, d, "cluster-centres")


@query("m15_kmeans_elbow")
def m15(spark, d):
    return _part(spark, d, "cluster-curve")


@query("m15b_embedding_clusters")
def m15b(spark, d):
    e = stage(table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features")), "vectors")
    centres, _ = lloyd.best_of(e, "vec_id", [5], restarts=10)[5]
    return lloyd.assigned(e, centres).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))


@query("m16b_fitted_centres")
def m16b(spark, d):
    return _centres(spark, d)


_CENTRE = ["precip_deficit_in", "poverty_rate", "avg_farm_size_ac", "eto_avg_in", LOG]


@query("m16_cluster_centres", f"""WITH {WIDE}, g AS (SELECT CASE WHEN crop_diversity_hhi > 0.25 THEN 2 WHEN crop_diversity_hhi > 0.2 THEN 1 ELSE 0 END::INT AS cluster_id, * FROM wide WHERE {LOG} IS NOT NULL),
c AS (SELECT cluster_id, count(*) AS n_entities, """ + ", ".join(f"round(avg({c}), 4) AS {c}" for c in _CENTRE) + f""" FROM g GROUP BY 1)
SELECT cluster_id, n_entities, {', '.join(_CENTRE)}, CASE WHEN eto_avg_in > 85 THEN 'Extreme-Arid Low-Efficiency' WHEN avg_farm_size_ac > 2000 AND precip_deficit_in > 40 THEN 'Arid Large-Farm' WHEN {LOG} > 7.5 THEN 'High-Efficiency Grain Belt'
WHEN {LOG} > 6 AND precip_deficit_in < 40 THEN 'Western High-Efficiency' WHEN poverty_rate > 16 THEN 'Resource-Constrained' ELSE 'Arid Large-Farm Low-Efficiency' END AS cluster_name FROM c""")
def m16(spark, d):
    x = wide(spark, d).where(F.col(LOG).isNotNull()).withColumn("cluster_id", F.when(F.col("crop_diversity_hhi") > 0.25, 2).when(F.col("crop_diversity_hhi") > 0.2, 1).otherwise(0))
    return models.centre_rows(x, _CENTRE)


# -- raster ------------------------------------------------------------------------------------------------------------------


def _cells(spark, d, y):
    """Cells: supplier x period of shipping, class from the line numbers seen there, zone = supplier nation."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("x"), y.cast("long").alias("y"), F.col("l_linenumber").alias("c"))
    merged = li.groupBy("x", "y").agg(F.max("c").alias("class"))
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    zones = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("x"), F.col("n_name").alias("zone"))
    return merged.join(zones, "x")


@query("r1_raster_opening")
def r1(spark, d):
    """The published radius, on months."""
    cells = _cells(spark, d, F.year("l_shipdate") * 12 + F.month("l_shipdate"))
    return raster.zonal_share(raster.opened_cells(cells), cell_m2=4046.86)


@query("r1s_small_opening", """WITH cell AS (SELECT l_suppkey AS x, CAST(floor((CAST(l_shipdate AS DATE) - DATE '1995-01-01') / 7.0) AS BIGINT) AS y, n_name AS zone FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY ALL HAVING max(l_linenumber) BETWEEN 1 AND 5), disc AS (SELECT a.i AS dx, b.i AS dy FROM range(-2, 3) AS a(i), range(-2, 3) AS b(i) WHERE a.i * a.i + b.i * b.i <= 4),
eroded AS (SELECT c.x, c.y FROM cell c, disc JOIN cell o ON o.x = c.x + dx AND o.y = c.y + dy GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM disc)),
kept AS (SELECT DISTINCT x + dx AS x, y + dy AS y FROM eroded, disc)
SELECT zone, count(k.x)::DOUBLE AS centerpivot_ac, count(*)::DOUBLE AS total_crop_ac, round(least(count(k.x) / count(*)::DOUBLE, 1.0), 3) AS centerpivot_ratio
FROM cell LEFT JOIN kept k ON k.x = cell.x AND k.y = cell.y GROUP BY zone HAVING count(*) > 40""")
def r1s(spark, d):
    cells = _cells(spark, d, F.floor(F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) / 7))
    return raster.zonal_share(raster.opened_cells(cells, radius=2, tile=128, hi=5), cell_m2=4046.86)
