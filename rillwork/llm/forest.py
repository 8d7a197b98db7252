"""Near-duplicate vectors by a forest of random-projection trees.

Vectors of one label are split along random directions, again and again, at the median of their projections. A vector
whose projection lies near the median goes down both sides (spill), so that near vectors rarely part in one tree, and
hardly ever in all of many trees. A vector does so once in a tree, so it reaches two leaves of a tree at most, however
deep the trees are. Vectors that share a leaf are compared exactly.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import NO_ID, back, components, mix, table, whole
from rillwork.session import stage


def normal(rows: list) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that neither large nor small components overflow."""
    x = np.array([np.asarray(r, np.float64) for r in rows]).reshape(len(rows), -1)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed(column: str) -> Column:
    """Each vector as the bytes of its unit vector, which tasks read without a conversion."""
    @F.pandas_udf("binary")
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([normal([r])[0].tobytes() for r in rows], dtype=object)

    return run(column)


def unpacked(rows) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def direction(tree: int, node: int, dim: int) -> np.ndarray:
    """The random unit direction of a node, made from its number wherever it is needed."""
    seed = int(mix(np.array([node], np.uint64) * np.uint64(64) + np.uint64(tree))[0])
    r = np.random.default_rng(seed).standard_normal(dim)
    return r / np.linalg.norm(r)


def child(node: int, side: int) -> int:
    return int(mix(np.array([node], np.uint64) * np.uint64(2) + np.uint64(side + 5))[0]) >> 1


def split(p: np.ndarray, spilt: np.ndarray, cut: float, spill: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """(which vectors, whether they have been on both sides before or are now) of either side of a cut."""
    both = (np.abs(p - cut) <= spill) & ~spilt
    return [(side, (spilt | both)[side]) for side in ((p <= cut) | both, (p > cut) | both)]


def grow(x: np.ndarray, spilt: np.ndarray, tree: int, root: int, depth: int, spill: float) -> dict[int, tuple[float, int]]:
    """Thresholds of the nodes below ``root``, fitted to a sample: {node: (threshold, depth)}. A node with over three quarters of its vectors near the cut stays a leaf."""
    out, todo = {}, [(root, np.arange(len(x)), spilt, 0)]
    while todo:
        node, at, done, level = todo.pop()
        if level >= depth or len(at) < 8:
            continue
        p = x[at] @ direction(tree, node, x.shape[1])
        cut = float(np.median(p))
        if (np.abs(p - cut) <= spill).mean() > 0.75:
            continue
        out[node] = (cut, level)
        todo += [(child(node, side), at[which], now, level + 1) for side, (which, now) in enumerate(split(p, done, cut, spill))]
    return out


def descend(x: np.ndarray, spilt: np.ndarray, tree: int, root: int, cuts: dict[int, tuple[float, int]], spill: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(leaf, indexes of its vectors, whether they have spilt) of all vectors sent down from ``root``."""
    out, todo = [], [(root, np.arange(len(x)), spilt)]
    while todo:
        node, at, done = todo.pop()
        if not len(at):
            continue
        if node not in cuts:
            out.append((node, at, done))
            continue
        p = x[at] @ direction(tree, node, x.shape[1])
        todo += [(child(node, side), at[which], now) for side, (which, now) in enumerate(split(p, done, cuts[node][0], spill))]
    return out


def plant(vectors: DataFrame, trees: int, leaf: int, sample: int, spill: float) -> DataFrame:
    """(tree, leaf, id) of every vector (id, label, unit): the leaves it reaches in every tree.

    A round cuts every node of over ``leaf`` vectors into many: a task fits thresholds to a sample of about ``sample`` of the
    node's vectors, those with the smallest hashes, and all of them descend. Rounds go on until no node can be cut, so the trees
    deepen with the data while what a task fits stays bounded. Nodes of near-equal vectors stay as they are.
    """
    start = vectors.select("id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.shiftright(F.xxhash64("label"), 1).bitwiseAND(F.lit((1 << 62) - 1)).alias("node"), F.lit(False).alias("spilt"))
    done, now = [], stage(start.select("id", "tree", "node", "spilt"), "roots")
    while True:
        count = now.groupBy("tree", "node").agg(F.count("*").alias("m"))
        large = stage(count.where(F.col("m") > leaf), "large")
        done.append(now.join(large.select("tree", "node"), ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "id"))
        if large.isEmpty():
            break
        big = now.join(large, ["tree", "node"])
        share = F.col("m") / F.lit(float(sample))
        drawn = big.where(F.pmod(F.xxhash64("id", "tree", F.lit(3)), F.lit(1 << 30)) < F.lit(float(1 << 30)) / F.greatest(share, F.lit(1.0)))

        def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            depth = max(1, math.ceil(math.log2(max(2.0, 2 * float(pdf["m"].iloc[0]) / leaf))))
            pdf = pdf.sort_values("id")
            cuts = grow(unpacked(pdf["unit"].tolist()), pdf["spilt"].to_numpy(bool), int(key[0]), int(key[1]), min(depth, int(math.log2(sample / 16))), spill)
            return pd.DataFrame({"tree": [key[0]], "node": [key[1]], "cuts": [pickle.dumps(cuts) if cuts else None]})

        fitted = drawn.join(vectors.select("id", "unit"), "id").select("tree", "node", "m", "id", "unit", "spilt").groupBy("tree", "node").applyInPandas(
            fit, "tree int, node long, cuts binary")
        fitted = stage(fitted, "cuts")
        cut = fitted.where("cuts IS NOT NULL")

        def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                ids, trees_, leaves, spilt = [], [], [], []
                for (tree, node), part in pdf.groupby(["tree", "node"]):
                    cuts, own = pickle.loads(part["cuts"].iloc[0]), part["id"].to_numpy()
                    for leaf_, at, now_ in descend(unpacked(part["unit"].tolist()), part["spilt"].to_numpy(bool), int(tree), int(node), cuts, spill):
                        ids.append(own[at])
                        spilt.append(now_)
                        trees_.append(np.full(len(at), tree, np.int32))
                        leaves.append(np.full(len(at), leaf_, np.int64))
                if ids:
                    yield pd.DataFrame({"id": np.concatenate(ids), "tree": np.concatenate(trees_), "node": np.concatenate(leaves), "spilt": np.concatenate(spilt)})

        stuck = fitted.where("cuts IS NULL").select("tree", "node")
        done.append(now.join(stuck, ["tree", "node"]).select("tree", F.col("node").alias("leaf"), "id"))
        now = stage(big.join(cut, ["tree", "node"]).join(vectors.select("id", "unit"), "id").select("id", "tree", "node", "spilt", "unit", "cuts").sortWithinPartitions("tree", "node").mapInPandas(
            send, "id long, tree int, node long, spilt boolean"), "nodes")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def compare(rows: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """(id, n, root) of the vectors in each leaf (or pair of its blocks) of a sorted partition.

    n counts the vectors linked to it through pairs whose first shared leaf, by (tree, leaf), is this one, so a pair that
    shares many leaves counts once; root is the smallest id of its component in the leaf. As many rows come out as go in.
    """
    held: list[pd.DataFrame] = []
    key = ["tree", "leaf", "x", "y"]

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        v, ids, copies, block = unpacked(group["unit"].tolist()), group["id"].to_numpy(), group["copies"].to_numpy(), group["block"].to_numpy()
        tree, code, m = int(group["tree"].iloc[0]), int(group["code"].iloc[0]), len(group)
        # the one or two leaves of every vector in each tree up to this one; a second leaf it does not have is a number of its own
        leaves = np.repeat(-1 - np.arange(m)[:, None], 2 * (tree + 1), 1)
        size = group["codes"].map(len).to_numpy()
        flat, of = np.concatenate(group["codes"].tolist()), np.repeat(np.arange(m), size)
        place = 2 * (flat >> 58)
        place[1:] += (flat[1:] >> 58 == flat[:-1] >> 58) & (of[1:] == of[:-1])
        seen = place < 2 * (tree + 1)
        leaves[of[seen], place[seen]] = flat[seen]
        n, root = np.zeros(m, np.int64), np.arange(m)

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        across = int(group["x"].iloc[0]) != int(group["y"].iloc[0])
        for lo in range(0, m, 256):
            mine = np.arange(lo, min(lo + 256, m))
            near = v[mine] @ v.T >= least
            near[np.arange(len(mine)), mine] = False
            if across:
                near &= block[mine][:, None] != block[None]
            if near.any():
                earlier = np.zeros(near.shape, bool)
                for k in range(tree):
                    for a in (2 * k, 2 * k + 1):
                        for b in (2 * k, 2 * k + 1):
                            earlier |= leaves[mine, a][:, None] == leaves[None, :, b]
                for a in (2 * tree, 2 * tree + 1):  # a smaller leaf of this tree that both have
                    low = leaves[mine, a]
                    earlier |= ((low >= 0) & (low < code))[:, None] & ((low[:, None] == leaves[None, :, 2 * tree]) | (low[:, None] == leaves[None, :, 2 * tree + 1]))
                n[mine] += (near & ~earlier) @ copies
            for a, b in zip(*(z[(near.any(axis=1))] for z in (mine, near.argmax(axis=1)))):  # one link of each vector, then all others by component
                x, y = find(int(a)), find(int(b))
                root[max(x, y)] = min(x, y)
            names = np.array([find(i) for i in range(m)])
            for i, row in zip(mine, near):
                for other in np.unique(names[row]):
                    x, y = find(int(i)), find(int(other))
                    if x != y:
                        root[max(x, y)] = min(x, y)
        names = np.array([find(i) for i in range(m)])
        return pd.DataFrame({"id": ids, "n": n, "root": ids[names]})

    for pdf in rows:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        parts = np.split(np.arange(len(pdf)), np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1)
        if held and (held[-1][key].iloc[0].to_numpy() != k[0]).any():
            yield solve(pd.concat(held))
            held = []
        for part in parts[:-1]:
            yield solve(pd.concat([*held, pdf.iloc[part]]))
            held = []
        held.append(pdf.iloc[parts[-1]])
    if held:
        yield solve(pd.concat(held))


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98, trees: int = 8, leaf: int = 256, sample: int = 8192,
                 spill: float = 0.8, block: int = 2048) -> DataFrame:
    """One row per vector: vec_id, n_links (other vectors of its label with cosine ``least`` or more), component_id (smallest vec_id that links reach), kept (its own).

    Vectors that are null, empty, zero or hold null or non-finite components, and null labels, link with nothing; so do
    vectors of different lengths. Equal vectors stand in as one; each row counts, so rows that repeat a vec_id link with
    each other. A null vec_id stays null and is kept by no one; its component is that of the ids it reaches, if any. An empty table gives no
    rows; other columns are not read. ``spill`` is the half width of the overlap in standard deviations of the projected
    distance of two vectors at the threshold. Nodes of more than ``block`` vectors that cannot be cut are compared
    in pairs of blocks, each in a task of its own, without dropping any pair.
    """
    v = F.col(vector)
    number = v.cast("array<double>")
    good = F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(number, lambda x: x != 0)
    rows = vectors.select(whole(vec_id).alias("vec_id"), F.coalesce(good, F.lit(False)).alias("good"), F.col(label).cast("string").alias("label"), F.transform(number, lambda x: x + F.lit(0.0)).alias("vector"))
    rows = stage(rows, "vectors")
    key = F.sha2(F.concat_ws("|", F.size("vector").cast("string"), F.col("label"), F.to_json("vector")), 256)
    keyed = stage(rows.where("good").select("vec_id", "label", "vector", key.alias("key")), "keyed")
    classes = keyed.groupBy("key").agg(F.coalesce(F.min(back("vec_id")), F.lit(NO_ID)).alias("low"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    # a class is named by its smallest vec_id; classes that share it (equal ids, other vectors) get numbers of their own
    one = stage(classes.withColumn("id", F.xxhash64("key")).withColumn("unit", packed("vector")).withColumn("label", F.concat_ws("|", F.size("vector").cast("string"), "label")), "classes")
    dim = one.agg(F.max(F.size("vector"))).first()[0] or 1
    half = spill * math.sqrt(2 - 2 * least) / math.sqrt(dim)
    leaves = stage(plant(one.select("id", "label", "unit"), trees, leaf, sample, half), "leaves")
    code = F.shiftleft(F.col("tree").cast("long"), 58).bitwiseOR(F.col("leaf").bitwiseAND(F.lit((1 << 58) - 1)))
    coded = leaves.withColumn("code", code)
    codes = coded.groupBy("id").agg(F.sort_array(F.collect_set("code")).alias("codes"))  # two of a tree at most
    full = coded.groupBy("code").agg(F.count("*").alias("m")).where("m > 1")
    shared = coded.join(full, "code").join(codes, "id").join(one.select("id", "unit", "copies"), "id")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a given number is not merged into fewer tasks
    blocks = F.ceil(F.col("m") / block).cast("int")
    shared = shared.withColumn("block", F.pmod(F.xxhash64("id", F.lit(5)), blocks).cast("int"))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    shaped = shared.select("tree", "leaf", "x", "y", "block", "code", "codes", "id", "copies", "unit").repartition(tasks, "code", "x", "y").sortWithinPartitions("tree", "leaf", "x", "y")
    found = stage(shaped.mapInPandas(lambda it: compare(it, least), "id long, n long, root long"), "found")
    linked = found.groupBy("id").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = one.select("id", "low", "copies", "key").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = named.groupBy("root").agg(F.coalesce(F.min(back("low")), F.lit(NO_ID)).alias("component_id"))
    result = named.join(lowest, "root").join(linked, "id", "left").select("key", "copies", "component_id", F.coalesce("n", F.lit(0)).alias("n"))
    got = keyed.select("vec_id", "key").join(result, "key").select("vec_id", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return got.unionByName(alone).select(back("vec_id"), "n_links", back("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op1_projection_forest(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op1_projection_forest": op1_projection_forest}
ORACLES = {"op1_projection_forest": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
     g AS (SELECT vec_id, label, e, sqrt(list_inner_product(e, e)) AS s FROM v
           WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0),
     l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.s * b.s) >= 0.98),
     r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, min(r.c) AS component_id, min(r.c) = v.vec_id AS kept
FROM v JOIN r USING (vec_id) GROUP BY v.vec_id"""}
