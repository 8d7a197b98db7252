"""Near-duplicates by order MinHash.

The k-mers of a text are its runs of three words (of two in short texts), each labelled with how often it occurred before, so that repeats count.
A sketch takes, under its own hash, the ``few`` smallest labelled k-mers and hashes them in the order in which they stand
in the text: two texts agree only if they share k-mers in the same order, which follows edit similarity where plain
MinHash follows set similarity. Texts that agree in one sketch are candidates; an alignment of their words decides.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import components, mix, raw, table, trim
from rillwork.llm.letters import Words
from rillwork.session import released, scratch_path, stage

SKETCHES = pa.schema([("doc_id", pa.int64()), ("class_hi", pa.int64()), ("class_lo", pa.int64()), ("n", pa.int32()), ("sketches", pa.list_(pa.int64())), ("bag", pa.binary())])
#: Words are counted in so many bins; two texts share at most the sum of the smaller counts.
BINS = 1024
#: Texts of so many words at most are aligned by long integers.
BITWISE = 20_000
#: K-mers times seeds that are hashed at once.
AT_ONCE = 500_000


def counted(bag: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(bag), "<u2")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text)."""
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    text = np.searchsorted(begins, start, "right") - 1
    return Words(data, start, end, text, text).hashes(), np.bincount(text, minlength=len(texts))


def kmers(h: np.ndarray, k: int) -> np.ndarray:
    """Occurrence-labelled k-mers of one text, in text order; a shorter text is one k-mer."""
    k = min(k, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        out = mix(out + h[j:len(h) - k + 1 + j])
    order = np.argsort(out, kind="stable")
    heads = np.concatenate([[True], out[order][1:] != out[order][:-1]])
    if heads.all():
        return out
    at = np.arange(len(out))
    label = np.empty(len(out), np.uint64)
    label[order] = at - np.maximum.accumulate(np.where(heads, at, 0))
    return mix(out + label * np.uint64(0x9E3779B97F4A7C15))


def sketch(h: np.ndarray, k: int, few: int, seeds: np.ndarray) -> np.ndarray:
    """One value per seed: the hash, in text order, of the ``few`` labelled k-mers that are smallest under the seed."""
    labelled = kmers(h, k)
    few = min(few, len(labelled))
    out = np.empty(len(seeds), np.uint64)
    for lo in range(0, len(seeds), max(1, AT_ONCE // len(labelled))):
        own = seeds[lo:lo + max(1, AT_ONCE // len(labelled))]
        x = (labelled[None] ^ own[:, None]) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        at = np.sort(np.argpartition(x, few - 1, axis=1)[:, :few], axis=1) if few < len(labelled) else np.tile(np.arange(few), (len(own), 1))
        value = own.copy()
        for j in range(few):
            value = mix(value + labelled[at[:, j]])
        out[lo:lo + len(own)] = value
    return out


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edits between two sequences, or ``most + 1`` if there are more.

    Up to ``BITWISE`` words a column of the alignment is one long integer; beyond that a band widens until the distance fits in it.
    """
    n = min(len(a), len(b))
    same = np.flatnonzero(a[:n] != b[:n])
    head = int(same[0]) if len(same) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = np.flatnonzero(a[len(a) - n:][::-1] != b[len(b) - n:][::-1])
    tail = int(same[0]) if len(same) else n
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    if len(a) > len(b):
        a, b = b, a
    if not len(a) or len(b) - len(a) > most:
        return min(len(b), most + 1)
    if len(b) <= BITWISE:
        return _bitwise(a.tolist(), b.tolist(), most)
    band = max(4, len(b) - len(a))
    while True:
        band = min(band, most)
        got = _banded(a, b, band)
        if got <= band or band == most:
            return got if got <= most else most + 1
        band *= 4


def _bitwise(a: list[int], b: list[int], most: int) -> int:
    """Myers' bit-vector distance of whole sequences; ``most + 1`` once the words left cannot bring it down to ``most``."""
    mask, last, equal = (1 << len(a)) - 1, 1 << (len(a) - 1), {}
    for i, x in enumerate(a):
        equal[x] = equal.get(x, 0) | 1 << i
    up, down, score, left = mask, 0, len(a), len(b)
    for y in b:
        same = equal.get(y, 0)
        flat = (((same & up) + up) ^ up) | same
        rise, fall = down | (mask & ~(flat | up)), up & flat
        score, left = score + bool(rise & last) - bool(fall & last), left - 1
        if score - left > most:
            return most + 1
        rise, fall, keep = rise << 1 | 1, fall << 1, same | down
        up, down = (fall | ~(keep | rise)) & mask, rise & keep & mask
    return score


def _banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Distance along paths that stay within ``band`` of the diagonal; ``band + 1`` once no path can do with ``band`` edits."""
    width, big = 2 * band + 1, np.int32(1 << 29)
    padded = np.concatenate([np.full(band, 0, b.dtype), b, np.full(band + 1, 0, b.dtype)])
    slot = np.arange(width, dtype=np.int32)
    column = slot - band
    row = np.where(column >= 0, column, big).astype(np.int32)
    up = np.full(width + 1, big, np.int32)
    for i in range(1, len(a) + 1):
        up[:width] = row
        column = slot + (i - band)
        best = np.minimum(row + (padded[i - 1:i - 1 + width] != a[i - 1]), up[1:] + 1)
        if i <= band:
            best[column == 0] = i
            best[column < 0] = big
        if i + band > len(b):
            best[column > len(b)] = big
        row = np.minimum.accumulate(best - slot) + slot
        if i + band > len(b):
            row[column > len(b)] = big
        if row.min() > band:
            return band + 1
    end = len(b) - len(a) + band
    return int(min(row[end], band + 1))


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether 1 - edits / words of the longer is ``least`` at least."""
    longest = max(len(a), len(b))
    most = int((1 - least) * longest + 1e-9)
    words, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    shared = np.minimum(np.bincount(at[:len(a)], minlength=len(words)), np.bincount(at[len(a):], minlength=len(words))).sum()
    if longest - shared > most:  # every word that the other text lacks is an edit
        return False
    return edit_distance(a, b, most) <= most


def families(h: np.ndarray, k: int, k_short: int, short: int, least: float, few: int, seeds: np.ndarray) -> np.ndarray:
    """The sketches by ``k`` of a text of ``short`` words or more, then those by ``k_short`` of one under ``short / least``; 0 for those it lacks.

    Two texts whose lengths allow the similarity ``least`` so have a family in common.
    """
    out = np.zeros((2, len(seeds)), np.uint64)
    if len(h) >= short:
        out[0] = sketch(h, k, few, seeds)
    if len(h) * least < short:
        out[1] = sketch(h, k_short, few, seeds)
    return out.ravel()


def sketched(docs: DataFrame, doc_id: str, text: str, k: int, k_short: int, short: int, least: float, few: int, count: int) -> DataFrame:
    """doc_id, a 128-bit class of equal word sequences, number of words, sketches of both families, word counts; texts without a word are left out."""
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                h, n = word_hashes([raw(t) for t in part.column("text").to_pylist()])
                ends, has, out, classes, bags = np.cumsum(n), np.flatnonzero(n), [], [], []
                for i in has:
                    mine = h[ends[i] - n[i]:ends[i]]
                    out.append(families(mine, k, k_short, short, least, few, seeds).view(np.int64))
                    bags.append(zlib.compress(np.minimum(np.bincount((mine >> np.uint64(20)).astype(np.int64) % BINS, minlength=BINS), 65535).astype("<u2").tobytes(), 1))
                    place = mix(np.arange(len(mine), dtype=np.uint64))
                    classes.append([np.add.reduce(mix(mine + place)), np.add.reduce(mix(mine ^ (place * np.uint64(3))))])
                c = np.array(classes, np.uint64).reshape(-1, 2).view(np.int64)
                offsets = pa.array(np.arange(len(has) + 1, dtype=np.int32) * (2 * count))
                flat = pa.array(np.concatenate(out) if out else np.empty(0, np.int64))
                yield pa.record_batch([part.column("doc_id").take(pa.array(has)), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(n[has].astype(np.int32)),
                                       pa.ListArray.from_arrays(offsets, flat), pa.array(bags, pa.binary())], schema=SKETCHES)
        trim()

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return narrow.mapInArrow(run, "doc_id long, class_hi long, class_lo long, n int, sketches array<long>, bag binary")


def verify(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """``pairs`` (a, b) with ``ok``: whether the alignment of their texts finds them similar.

    ``texts`` (doc_id, text) has one row per id, so both joins have one row per key on a side; a document with very many partners is split by adaptive execution.
    """

    @F.pandas_udf("boolean")
    def check(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right):
            h, n = word_hashes([raw(x), raw(y)])
            out.append(similar(h[:n[0]], h[n[0]:], least))
        return pd.Series(out, dtype=bool)

    one, two = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", check("ta", "tb").alias("ok"))


def allowed(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The (a, b) of ``pairs`` whose lengths and word counts allow the similarity."""

    @F.pandas_udf("boolean")
    def near(na: pd.Series, nb: pd.Series, left: pd.Series, right: pd.Series) -> pd.Series:
        longest = np.maximum(na.to_numpy(), nb.to_numpy())
        shared = np.array([np.minimum(counted(x), counted(y)).sum(dtype=np.int64) for x, y in zip(left, right)], np.int64)
        return pd.Series((longest - shared <= longest * (1 - least) + 1e-9) | (longest > 65_000), dtype=bool)

    one, two = (sketches.select(F.col("doc_id").alias(x), F.col("n").alias("n" + x), F.col("bag").alias("w" + x)) for x in "ab")
    fits = F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9
    short = sketches.select("doc_id", "n")
    fitting = pairs.join(short.withColumnsRenamed({"doc_id": "a", "n": "na"}), "a").join(short.withColumnsRenamed({"doc_id": "b", "n": "nb"}), "b").where(fits).select("a", "b")
    return fitting.join(one, "a").join(two, "b").where(near("na", "nb", "wa", "wb")).select("a", "b")


def crossing(rows: Iterator[pd.DataFrame], least: float) -> Iterator[pd.DataFrame]:
    """Pairs of texts of different components in each bucket (or pair of its blocks) of a sorted partition, once per pair of texts."""
    held: list[pd.DataFrame] = []

    def solve(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["root", "doc_id"], kind="stable")
        ids, roots, n, block = (group[c].to_numpy() for c in ("doc_id", "root", "n", "block"))
        sketches, j = np.stack(group["sketches"].to_numpy()), int(group["j"].iloc[0]) % len(group["sketches"].iloc[0])
        bags = np.frombuffer(b"".join(map(zlib.decompress, group["bag"])), "<u2").reshape(len(group), BINS)
        sizes = pd.Series(roots).value_counts()
        small = np.flatnonzero(roots != sizes.index[0])  # every pair across components has an end outside the largest
        x_block, y_block = int(group["x"].iloc[0]), int(group["y"].iloc[0])
        out = []
        for lo in range(0, len(small), 128):
            mine = small[lo:lo + 128]
            equal = sketches[mine][:, None, :] == sketches[None]
            fits = np.minimum(n[mine][:, None], n[None]) >= np.maximum(n[mine][:, None], n[None]) * least - 1e-9
            good = fits & (roots[mine][:, None] != roots[None]) & (equal.argmax(axis=2) == j)  # counted in the first sketch of the family that they share
            if x_block != y_block:
                good &= block[mine][:, None] != block[None]
            p, q = np.nonzero(good)
            near = np.empty(len(p), bool)
            for at in range(0, len(p), 4_000):
                x, y = mine[p[at:at + 4_000]], q[at:at + 4_000]
                longest = np.maximum(n[x], n[y])
                near[at:at + 4_000] = (longest - np.minimum(bags[x], bags[y]).sum(axis=1, dtype=np.int64) <= longest * (1 - least) + 1e-9) | (longest > 65_000)
            p, q = p[near], q[near]
            out.append(np.stack([np.minimum(ids[mine[p]], ids[q]), np.maximum(ids[mine[p]], ids[q])], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        return pd.DataFrame(pairs, columns=["a", "b"])

    key = ["j", "h", "x", "y"]
    for pdf in rows:
        if not len(pdf):
            continue
        changed = np.flatnonzero((pdf[key].to_numpy()[1:] != pdf[key].to_numpy()[:-1]).any(axis=1)) + 1
        parts = np.split(np.arange(len(pdf)), changed)
        if held and (held[-1][key].iloc[0].to_numpy() != pdf[key].iloc[0].to_numpy()).any():
            yield solve(pd.concat(held))
            held = []
        for part in parts[:-1]:
            yield solve(pd.concat([*held, pdf.iloc[part]]))
            held = []
        held.append(pdf.iloc[parts[-1]])
    if held:
        yield solve(pd.concat(held))


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 3, k_short: int = 2, short: int = 100, few: int = 2, count: int = 48, least: float = 0.8, block: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(links between class representatives (a, b), copies (rep, doc_id)): enough links to connect every group of similar texts.

    Texts with equal words are one class, stood for by its smallest id. A bucket holds the texts that share a sketch. Pairs
    of one bucket are candidates unless their lengths or word counts rule the similarity out. First every text is compared with its buckets' smallest
    ids: as many pairs as texts, however large a bucket. Then all candidates that these links have not connected are compared,
    so no pair of candidates stays undecided. Buckets of more than ``block`` texts are cut into blocks that meet pairwise in tasks of their own.
    """
    rows = stage(sketched(docs, doc_id, text, k, k_short, short, least, few, count), "sketches")
    classes = rows.groupBy("class_hi", "class_lo").agg(F.min("doc_id").alias("rep"))
    copies = stage(rows.select("doc_id", "class_hi", "class_lo").join(classes, ["class_hi", "class_lo"]).select("rep", "doc_id").distinct(), "copies")
    reps = copies.where("doc_id = rep").select("doc_id")
    slots = rows.join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", F.posexplode("sketches").alias("j", "h")).where("h <> 0")
    buckets = slots.groupBy("j", "h").agg(F.min("doc_id").alias("head"), F.count("*").alias("m")).where("m > 1")
    members = stage(slots.join(buckets, ["j", "h"]), "members")
    near = members.select("doc_id").distinct()
    sketches = stage(rows.join(near, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "n", "sketches", "bag"), "near-sketches")
    star = members.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = stage(allowed(star, sketches, least), "star")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(near, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    texts = stage(texts, "texts")
    tried = stage(verify(star, texts, least), "tried")
    linked = tried.where("ok").select("a", "b")
    roots = components(linked).withColumnRenamed("id", "doc_id")
    named = stage(members.select("j", "h", "doc_id", "m").join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")), "named")
    split = named.groupBy("j", "h").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("j", "h")
    blocks = F.ceil(F.col("m") / block).cast("int")
    apart = named.join(split, ["j", "h"], "left_semi").join(sketches, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), blocks).cast("int"))
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    apart = apart.withColumn("other", other).withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    apart = apart.withColumn("sketches", F.slice("sketches", F.floor(F.col("j") / count).cast("int") * count + 1, count))
    shaped = apart.select("j", "h", "x", "y", "block", "doc_id", "root", "n", "sketches", "bag").repartition("j", "h", "x", "y").sortWithinPartitions("j", "h", "x", "y")
    found = shaped.mapInPandas(lambda it: crossing(it, least), "a long, b long").distinct()
    fresh = stage(found.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "fresh")
    more = stage(verify(fresh, texts, least), "tried").where("ok").select("a", "b")
    return linked.unionByName(more), copies


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, group_id (the smallest id that links reach), kept (doc_id = group_id), n_linked (class copies and verified links of the document).

    Two texts are linked if their words are equal, or if they agree in one sketch at least and 1 - word edits / words of
    the longer is 0.8 at least. Null texts, empty ones and ones without a word are groups of their own; texts under two words
    are one k-mer; a null doc_id is kept, without a group; rows that share a doc_id are one document, one row each; an
    empty table gives no rows; other columns are not read. Whole texts are compared, as far as the similarity allows.
    """
    path = scratch_path(docs.sparkSession, "near-links")
    with released(docs.sparkSession):  # only the links are read from here on; sketches, buckets and texts would take room for good
        links, copies = link(docs, doc_id, text, **options)
        edges = links.unionByName(copies.where("rep <> doc_id").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
        edges = stage(edges, "near-links", path)
    roots = components(edges)
    degree = edges.select(F.col("a").alias("id")).unionByName(edges.select(F.col("b").alias("id"))).groupBy("id").agg(F.count("*").alias("n_linked"))
    ids = docs.select(F.col(doc_id).cast("long").alias("doc_id"))
    out = ids.join(roots, F.col("doc_id") == F.col("id"), "left").drop("id").join(degree, F.col("doc_id") == F.col("id"), "left")
    group = F.coalesce("root", "doc_id")
    return out.select("doc_id", group.alias("group_id"), (F.col("doc_id").isNull() | (group == F.col("doc_id"))).alias("kept"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))


def op6_order_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op6_order_minhash": op6_order_minhash}
