"""Mixing sources to target weights by cube-method balanced sampling.

Every document of a source is wanted ``target / source size`` times on average. The whole part of that ratio is taken
outright; the fraction is an inclusion probability. The flight moves the probabilities of three documents at a time
along the null space of the two balancing constraints (number of words, number of documents) until one of them is 0
or 1, so both totals stay exact. A block of documents ends with at most two undecided ones; the undecided ones of all
blocks fly again together, until one block per source is left and a landing settles its last two documents.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.common import WORD, back, table, whole
from rillwork.session import stage

ROW = "doc_id long, size long, source string, code long, p double, settled boolean"


def targets(sizes: DataFrame, weights: list[float], share: float, ceiling: float) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sizes`` has (source, size). Sources in code-point order, a null last, take ``weights`` in turn and divide
    ``share`` times all words; none gets over ``ceiling`` times its own, and what is cut is shared again by weight.
    That ends where all uncut sources stand at one level per weight: cut sources are those with the least size per weight.
    The windows run over one row per source, after a grouping with map-side sums.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).withColumn("most", F.col("source_size") * F.lit(float(ceiling)))
    all_rows = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = ((F.sum("source_size").over(all_rows) * F.lit(float(share)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
             / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    cut = per.withColumn("level", level).withColumn("under", F.col("level") * F.col("weight") <= F.col("most"))
    final = cut.withColumn("final", F.min(F.when(F.col("under"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(all_rows))
    return final.select("source", "source_size", F.coalesce(F.least("most", F.col("final.level") * F.col("weight")), "most").alias("target"))


def flight(sizes: list[float], p: list[float], low: float = 1e-9) -> None:
    """Moves ``p`` in place until at most two entries lie strictly between 0 and 1; sums of p and of p * size are kept."""
    active: list[int] = []
    for k in range(len(p)):
        if not low < p[k] < 1 - low:
            p[k] = float(round(p[k]))
            continue
        active.append(k)
        while len(active) == 3:
            a, b, c = active
            u = (sizes[b] - sizes[c], sizes[c] - sizes[a], sizes[a] - sizes[b])
            if not any(u):  # equal sizes: any move that keeps the count will do
                u = (1.0, -1.0, 0.0)
            step = min((1 - p[i] if v > 0 else p[i]) / abs(v) for i, v in zip(active, u) if v)
            for i, v in zip((a, b, c), u):
                p[i] += step * v
                if not low < p[i] < 1 - low:
                    p[i] = float(round(p[i]))
                    active.remove(i)


def land(sizes: list[float], p: list[float]) -> None:
    """Settles at most two fractional entries: of all their roundings, the one nearest in words, then in documents."""
    open_ = [k for k, x in enumerate(p) if 0 < x < 1]
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum((((m >> j) & 1) - p[k]) * sizes[k] for j, k in enumerate(open_))),
                                                      abs(sum(((m >> j) & 1) - p[k] for j, k in enumerate(open_))), m))
    for j, k in enumerate(open_):
        p[k] = float((best >> j) & 1)


def sample(rows: DataFrame, block: int = 4096) -> DataFrame:
    """Settles p of every row to 0 or 1. ``rows``: doc_id, size, source, p; the result has the same rows, p whole.

    Rows are dealt to blocks of about ``block`` by a hash, so that a hot source is many blocks, and fly in the order of
    a second hash; equal rows are interchangeable, so reruns agree. Each round leaves two rows of 4096 at most.
    """
    at = rows.withColumn("code", F.xxhash64("doc_id", "size", F.lit(7))).withColumn("settled", ~((F.col("p") > 0) & (F.col("p") < 1)))
    done, turn = [at.where("settled")], 0
    left = at.where("not settled")
    while True:
        counts = left.groupBy("source").count().withColumnsRenamed({"source": "s"})
        blocks = F.ceil(F.col("count") / block)
        dealt = left.join(counts, F.col("source").eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64("code", F.lit(turn)), blocks)).withColumn("last", blocks == 1)

        def fly(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["code", "doc_id", "size"], kind="stable").reset_index(drop=True)
            p, sizes = pdf["p"].tolist(), pdf["size"].astype(float).tolist()
            flight(sizes, p)
            if bool(pdf["last"].iloc[0]):
                land(sizes, p)
            pdf["p"] = p
            pdf["settled"] = [x in (0.0, 1.0) for x in p]
            return pdf[["doc_id", "size", "source", "code", "p", "settled"]]

        flown = stage(dealt.groupBy("source", "block").applyInPandas(fly, ROW), "flight")
        done.append(flown.where("settled"))
        left, turn = flown.where("not settled"), turn + 1
        if left.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5,
                ceiling: float = 2.0, size: Column | None = None) -> DataFrame:
    """How many words of each document a mix by ``weights`` takes: doc_id, size, source_size, target, taken, copies, source.

    ``size`` defaults to the number of words. A document is taken floor(ratio) or floor(ratio) + 1 times, ratio being its
    source's target over its size, so never above ``ceiling`` times. Null and empty texts have size 0 and a source whose
    documents are all empty gets target 0; a null source is a source of its own; a null doc_id stays null; repeated rows
    are drawn one by one; an empty table gives no rows; other columns are not read.
    """
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long") if size is None else size.cast("long")
    sizes = stage(docs.select(whole(doc_id).alias("doc_id"), words.alias("size"), F.col(source).cast("string").alias("source")), "sizes")
    goal = stage(targets(sizes, list(weights), share, ceiling), "targets").withColumnsRenamed({"source": "s"})
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(ceiling)))).otherwise(F.lit(0.0))
    wanted = sizes.join(goal, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source", (ratio - F.floor(ratio)).alias("p"))
    drawn = sample(wanted).join(goal, F.col("source").eqNullSafe(F.col("s")))
    copies = F.floor(ratio) + F.col("p").cast("long")
    return drawn.select(back("doc_id"), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")


def op2_cube_mix(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {"op2_cube_mix": op2_cube_mix}
