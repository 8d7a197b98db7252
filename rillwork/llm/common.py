"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.session import stage

#: A word: a run of anything but space and the control characters 9 to 13. ``bytes.split()`` finds the same words.
WORD = r"[^\x20\x09-\x0D]+"

#: Stands for a null id inside Python workers, where a null would turn whole numbers into floats.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(column) -> Column:
    """A long column for Python workers, without nulls; ``back`` restores them."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def back(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(column)


def raw(text) -> bytes:
    """UTF-8 bytes of a text; a null is empty."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs give equal outputs, near ones unrelated outputs."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def worker_store() -> dict:
    """A dictionary that lives as long as the Python worker, so that lookups made by one task serve the next."""
    module = sys.modules.setdefault("_rillwork_worker_store", types.ModuleType("_rillwork_worker_store"))
    return module.__dict__.setdefault("kept", {})


def trim() -> None:
    """Gives what a task has freed back to the system; a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if give_back:
        give_back(0)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(s, s + n)`` over all pairs."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph as (id, root): root is the smallest id that links reach.

    Only ids that have a link to another id are returned. Large-star and small-star steps alternate until the edges
    no longer change; each step is a grouping with a map-side minimum and a join with one row per id, so a node with
    very many links is split by adaptive execution. Rounds are staged in the shared folder. Nulls link nothing.
    """
    x, y = F.col(a), F.col(b)
    links = (edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    now, mark = stage(links, "links"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root"))
        mark = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        narrow = wide.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage(narrow.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
