"""Divergence of sources within a language, priced over hash-consed segment trees of term counts.

The terms of a language are dealt to blocks. In a block every source has a segment tree over the term ids whose leaves are its
counts. Trees are built bottom-up and subtrees with equal counts are one node, shared by all sources. Two trees are compared
by going down both at once: equal pairs of nodes on a level are visited once and carry how often they occur, so the
pair is priced once. Ids follow the counts in the language, which puts the rare terms, whose counts are mostly alike,
side by side. Sums over blocks give the whole trees' values. All arithmetic is in integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.common import table
from rillwork.session import stage

#: Letters A to Z become lower case, other letters and all bytes of other code points stay, the rest is a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))
ONE = 10 ** 9
#: Salts that spread the rows of one language over tasks where they meet the language's one row.
SALTS = 64
ENTRY, GROUP = 0, 1
COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("df", pa.int64())])
PRICED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64()), ("seen", pa.int64()),
                    ("unseen_value", pa.int64()), ("v", pa.int64())])


def count_terms(docs: DataFrame, held: int = 400_000) -> DataFrame:
    """(lang, source, term, n, df) of (lang, source, text), counted in each task, ``held`` terms at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict = defaultdict(Counter)
        df: dict = defaultdict(Counter)

        def out():
            for key, terms in n.items():
                size = len(terms)
                names = pa.array(list(terms), pa.binary()).cast(pa.string())
                yield pa.record_batch([pa.array([key[0]] * size, pa.string()), pa.array([key[1]] * size, pa.string()), names, pa.array(list(terms.values()), pa.int64()),
                                       pa.array([df[key][t] for t in terms], pa.int64())], schema=COUNTS)

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for key, text in zip(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist()), texts):
                terms = text.as_py().translate(FOLD).split()
                n[key].update(terms)
                df[key].update(set(terms))
            if sum(map(len, n.values())) > held:
                yield from out()
                n.clear()
                df.clear()
        yield from out()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, df long")


def grow(counts: np.ndarray) -> tuple[np.ndarray, list, np.ndarray]:
    """Hash-consed trees over the columns of ``counts`` (one row per tree): (leaf values, levels, root of each row).

    Leaf 0 pads rows to a power of two. A level is (left, right, pad): the children of its nodes on the level below, equal
    subtrees of any rows being one node, and the node that holds padding only, or -1.
    """
    width = 1 << max(0, counts.shape[1] - 1).bit_length()
    values, ids = np.unique(counts, return_inverse=True)
    at = np.zeros((counts.shape[0], width), np.int64)
    at[:, :counts.shape[1]] = ids.reshape(counts.shape) + 1
    levels, size, pad = [], len(values) + 1, 0
    while at.shape[1] > 1:
        nodes, ids = np.unique(at[:, ::2] * size + at[:, 1::2], return_inverse=True)
        below = pad * size + pad
        place = int(np.searchsorted(nodes, below)) if pad >= 0 else len(nodes)
        pad = place if place < len(nodes) and nodes[place] == below else -1
        levels.append((nodes // size, nodes % size, pad))
        at, size = ids.reshape(counts.shape[0], -1), len(nodes)
    return values, levels, at[:, 0]


def descend(levels: list, leaves: int, roots_a: np.ndarray, roots_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(pair, leaf a, leaf b, times) of simultaneous traversals; on each level an equal pair of nodes is visited once a traversal."""
    pair, a, b, times = np.arange(len(roots_a), dtype=np.int64), roots_a, roots_b, np.ones(len(roots_a), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        left, right, _ = levels[depth]
        pad, size = (levels[depth - 1][2], len(levels[depth - 1][0])) if depth else (0, leaves)
        pair, times = np.concatenate([pair, pair]), np.concatenate([times, times])
        a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
        real = a != pad
        key, back = np.unique((pair[real] * size + a[real]) * size + b[real], return_inverse=True)
        many = np.zeros(len(key), np.int64)
        np.add.at(many, back, times[real])
        pair, a, b, times = key // size // size, key // size % size, key % size, many
    return pair, a, b, times


def prices(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """p of each count in a group of ``total`` occurrences: exact, as counts are Python integers here."""
    return (1 + ONE * (counts.astype(object) + 1) // (total + terms)).astype(np.int64) if terms else np.zeros(len(counts), np.int64)


def price_block(rows: pa.Table, top: int, cells: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Values of all pairs of sources of two tiles over one block of terms, and each source's first ``top`` terms against the language."""
    lang, ta, tb = (rows.column(c)[0].as_py() for c in ("lang", "ta", "tb"))
    kind = rows.column("kind").to_numpy()
    groups = rows.filter(pa.array(kind == GROUP))
    names, tile = groups.column("source").to_pylist(), groups.column("tile").to_numpy()
    size_of, all_total, v = groups.column("n").to_pylist(), groups.column("total")[0].as_py(), groups.column("v")[0].as_py()
    entries = rows.filter(pa.array(kind == ENTRY))
    coded = entries.column("term").combine_chunks().dictionary_encode()
    terms = np.array([t.encode() for t in coded.dictionary.to_pylist()], object)
    code, total, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), entries.column("total").to_numpy(), entries.column("n").to_numpy()
    of_term = np.zeros(len(terms), np.int64)
    of_term[code] = total
    order = np.lexsort((terms.astype(bytes) if len(terms) else terms, -of_term))
    tid = np.empty(len(terms), np.int64)
    tid[order] = np.arange(len(terms))
    row_of = {s: i for i, s in enumerate(names)}
    counts = np.zeros((len(names) + 1, len(terms)), np.int64)
    counts[[row_of[s] for s in entries.column("source").to_pylist()], tid[code]] = n
    counts[-1] = of_term[order]  # the language's own tree
    values, levels, roots = grow(counts)
    known = np.concatenate([[0], values])
    p = np.array([prices(known, size, v) for size in [*size_of, all_total]])
    none = [int(prices(np.zeros(1, np.int64), size, v)[0]) for size in size_of]

    def rows_of(part, sources, items, value, seen, unseen):
        m = len(sources)
        return pa.record_batch([pa.array([lang] * m, pa.string()), pa.array(sources, pa.string()), pa.array([part] * m, pa.string()), pa.array(items, pa.string()),
                                pa.array(value, pa.int64()), pa.array([seen] * m, pa.int64()), pa.array(unseen, pa.int64()), pa.array([v] * m, pa.int64())], schema=PRICED)

    a, b = np.triu_indices(len(names), 1)
    meet = (np.minimum(tile[a], tile[b]) == ta) & (np.maximum(tile[a], tile[b]) == tb)
    a, b = a[meet], b[meet]
    step = max(1, cells // max(1, counts.shape[1]))
    for lo in range(0, len(a), step):
        i, j = a[lo:lo + step], b[lo:lo + step]
        there, back = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        if len(terms):
            pair, x, y, times = descend(levels, len(known), roots[i], roots[j])
            px, py = p[i[pair], x], p[j[pair], y]
            square = (px - py) ** 2
            np.add.at(there, pair, square // py * times)
            np.add.at(back, pair, square // px * times)
        f0 = [((none[s] - none[t]) ** 2 // none[t], (none[s] - none[t]) ** 2 // none[s]) if v else (0, 0) for s, t in zip(i, j)]
        first, second = [names[s] for s in i], [names[t] for t in j]
        yield rows_of("pair", first, second, there, len(terms), [f for f, _ in f0])
        yield rows_of("pair", second, first, back, len(terms), [g for _, g in f0])
    if ta != tb or not len(terms):
        return
    rank = np.empty(len(terms), np.int64)
    rank[np.argsort(terms)] = np.arange(len(terms))
    rank = rank[order]
    whole_language = len(names)
    for s in range(len(names)):
        # the traversal prices each pair of counts once; the source's terms look their price up
        _, x, y, _ = descend(levels, len(known), roots[s:s + 1], roots[whole_language:])
        over = p[s, x] > p[whole_language, y]
        f = np.where(over, (p[s, x] - p[whole_language, y]) ** 2 // np.maximum(p[whole_language, y], 1), -1)
        at = np.flatnonzero(counts[s])
        leaf = np.searchsorted(values, counts[s, at]) + 1, np.searchsorted(values, counts[whole_language, at]) + 1
        value = f[np.searchsorted(x * len(known) + y, leaf[0] * len(known) + leaf[1])]
        at, value = at[value >= 0], value[value >= 0]
        best = np.lexsort((rank[at], -value))[:top]
        yield rows_of("term", [names[s]] * len(best), [terms[order[k]].decode() for k in at[best]], value[best], 0, [0] * len(best))


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200, tile: int = 48, cells: int = 1 << 18) -> DataFrame:
    """How far each source of a language departs from its other sources and, term by term, from the language.

    Returns lang, source, part, item, value, rank. Null texts, languages and sources are read as empty strings; a language without
    kept terms has pairs of value 0; repeated rows are documents of their own; equal values rank by the bytes of the item;
    an empty table gives no rows; other columns are not read. Texts are read whole. A block has about ``cells`` counts and
    a task compares the sources of two tiles of about ``tile`` sources, so a task's memory does not grow with the table.
    """
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    counted = count_terms(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    one_term = Window.partitionBy("lang", "term")  # one row per source
    first = F.row_number().over(one_term.orderBy("source")) == 1
    kept = counted.select("*", F.sum("df").over(one_term).alias("docs"), F.sum("n").over(one_term).alias("total"), first.alias("head")).where(F.col("docs") >= least_docs)
    entries = stage(kept.select("lang", "source", "term", "n", "total", "head"), "term-counts")

    sizes = entries.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum(F.col("head").cast("long")).alias("heads"))
    groups = docs.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").na.fill(0, ["n", "heads"])
    groups = stage(groups, "source-groups")
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum("heads").alias("v"), F.count("*").alias("s"))
    langs = langs.select("lang", "lang_total", "v", F.ceil(F.col("s") / tile).cast("long").alias("tiles"),
                         F.greatest(F.lit(1).cast("long"), F.ceil(F.col("v") * F.least("s", F.lit(tile)) / cells).cast("long")).alias("blocks"))
    langs = stage(langs, "languages")

    salted = langs.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    mine = F.pmod(F.xxhash64("source"), F.col("tiles"))
    dealt = (entries.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
             .select("lang", "source", "term", "n", "total", F.pmod(F.xxhash64("term", F.lit(1)), F.col("blocks")).alias("block"), mine.alias("tile"), "tiles", F.lit(ENTRY).alias("kind"), "v"))
    present = (groups.select("lang", "source", "n").join(langs, "lang")
               .select("lang", "source", F.lit(None).cast("string").alias("term"), "n", F.col("lang_total").alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"),
                       mine.alias("tile"), "tiles", F.lit(GROUP).alias("kind"), "v"))
    units = dealt.unionByName(present).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    units = units.select("lang", "block", F.least("tile", "other").alias("ta"), F.greatest("tile", "other").alias("tb"), "tile", "source", "term", "n", "total", "kind", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from price_block(pa.Table.from_batches(list(batches)), top)

    priced = units.groupBy("lang", "block", "ta", "tb").applyInArrow(
        run, "lang string, source string, part string, item string, value long, seen long, unseen_value long, v long")
    priced = stage(priced, "priced")
    # terms that no source of the two tiles has in a block were not seen there: all have the same price
    unseen = (F.max("v") - F.sum("seen")) * F.max("unseen_value")
    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg((F.sum("value") + unseen).alias("value"))
    group = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(group))
    terms = priced.where("part = 'term'").select(*pairs.columns).withColumn("rank", F.row_number().over(group)).where(F.col("rank") <= top)
    return ranked.unionByName(terms)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLES = {"op12_source_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
     t AS (SELECT doc, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
     kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
     c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
     g AS (SELECT DISTINCT lang, source FROM d),
     size AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS size FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
     lsize AS (SELECT lang, sum(total)::HUGEINT AS size, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
     p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (s.size + l.v) AS p,
                  1 + (1000000000::HUGEINT * (k.total + 1)) // (l.size + l.v) AS q
           FROM size s JOIN kept k USING (lang) JOIN lsize l USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
     pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // y.p), 0)::BIGINT AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
                   LEFT JOIN p y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
     term AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM pair
UNION ALL
SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item))::INT AS rank FROM term
QUALIFY rank <= 200"""}
