"""Spelling variants of corpus words by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other. The shorter word (either, if
they are equally long) contributes two disjoint chunks, its halves: one edit leaves one of them as it is. The other word
contributes its positional grams of a chunk's length; as words differ by at most one in length, a chunk can only meet the
gram at its own place or one further, and only those grams are dealt. The half that holds the edit is chunked again in the
same way, so that a key is all of a word but a quarter of it. A key that still has many words is chunked further until
its open part is a single place. Every meeting pair is verified.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import NO_ID, table, whole
from rillwork.session import stage

#: Latin-1 bytes: A to Z become lower case, other letters of the runs stay, everything else is a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF as Latin-1 bytes, A-Z in lower case."""
    return text.encode("latin-1", "replace").translate(FOLD).split()


def spoken(doc_id: int, run: bytes, every: int) -> bytes:
    """The run, less one code point where the checksum of document and run is a multiple of ``every``."""
    head = b":" if doc_id == NO_ID else b"%d:" % doc_id
    h = zlib.crc32(head + (run if run.isascii() else run.decode("latin-1").encode()))
    k = h % len(run)
    return run if h % every else run[:k] + run[k + 1:]


def count_words(docs: DataFrame, doc_id: str, text: str, least: int, every: int, held: int = 400_000) -> DataFrame:
    """(word, n) of all words of at least ``least`` code points; each task counts before it sends, ``held`` words at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            names = pa.array([w.decode("latin-1") for w in seen], pa.string())
            return pa.record_batch([names, pa.array(list(seen.values()), pa.int64())], schema=COUNTS)

        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for w, n in Counter(w for w in runs(t.as_py() or "") if len(w) >= least).items():
                    w = spoken(d, w, every)
                    if len(w) >= least:
                        seen[w] += n
                if len(seen) > held:
                    yield out()
                    seen.clear()
        yield out()

    narrow = docs.where(F.col(text).isNotNull()).select(whole(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    return narrow.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the key of a word outside its open part [lo, hi): the chunk word's own, or a gram's, whose open part is one longer."""
    tail = F.expr("substring(word, CAST(hi + 1 + longer AS INT), length(word))")
    return rows.withColumn("key", F.xxhash64("size", "lo", "hi", F.expr("substring(word, 1, CAST(lo AS INT))"), tail))


def halve(rows: DataFrame) -> DataFrame:
    """Each row twice: one half of its open part becomes a chunk, the other stays open."""
    parts = F.expr("explode(array(struct(lo AS lo, (lo + hi) div 2 AS hi), struct((lo + hi) div 2 AS lo, hi AS hi)))")
    return keyed(rows.select("word", "n", "size", "longer", parts.alias("part")).select("word", "n", "size", "longer", "part.lo", "part.hi"))


def near_pairs(words: DataFrame, crowd: int = 1000) -> DataFrame:
    """(word, near, near_n) of all ordered pairs of words (word, n) that are one edit apart, each once.

    A key with over ``crowd`` words is halved again. With one open place a key has at most one word for each letter, or,
    among words that are one longer, for two letters, so no group grows with the table.
    """
    start = words.where("length(word) > 1").withColumn("at", F.expr("explode(array(0, 1))"))
    start = start.select("word", "n", F.expr("CAST(length(word) - at AS LONG) AS size"), F.col("at").cast("long").alias("longer"), F.lit(0).cast("long").alias("lo"))
    rows, ready = stage(halve(halve(start.withColumn("hi", F.col("size")))), "chunks"), []
    while True:
        crowded = stage(rows.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > crowd).select("key"), "crowded")
        if crowded.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(crowded, "key", "left_anti").select(*rows.columns))
        rows = stage(halve(rows.join(crowded, "key", "left_semi").select(*rows.columns)), "chunks")
    every = reduce(DataFrame.unionByName, ready)
    chunks = every.where("longer = 0").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"))
    grams = every.select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("longer") == 1)
    met = chunks.join(grams.toDF("key", "b", "b_n", "longer"), "key").where((F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    # equally long words meet from both sides, others from the shorter word's side only
    both = met.withColumn("side", F.explode(F.when(F.col("longer"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    one = F.col("side") == 0
    pairs = both.select(F.when(one, F.col("a")).otherwise(F.col("b")).alias("word"), F.when(one, F.col("b")).otherwise(F.col("a")).alias("near"),
                        F.when(one, F.col("b_n")).otherwise(F.col("a_n")).alias("near_n"))
    return pairs.repartition("word").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))


def last_forms(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms. Steps double each round; counts grow tenfold a step, so rounds are few."""
    now = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = now.select(F.col("word").alias("of"), F.col("root").alias("next"))
        then = stage(now.join(further, F.col("root") == F.col("of"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
        if then.where("moved").isEmpty():
            return then.select("word", "root")
        now = then.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 7, occurrences: int = 2, ratio: int = 10, every: int = 31, crowd: int = 1000) -> DataFrame:
    """Words of a corpus with their forms: word, form, root, n, n_near, form_n.

    Words are the results of at least ``least`` code points that occur ``occurrences`` times or more. The form of a word is its
    near word of largest n (ties: smallest in code-point order) if that is ``ratio`` times its own n at least. Null and
    empty texts have no words; a null doc_id counts as the empty string in the checksum; repeated rows count each; an empty
    table gives no rows; other columns are not read. Words of any length take part; whole texts are read.
    """
    words = stage(count_words(docs, doc_id, text, least, every).where(F.col("n") >= occurrences), "words")
    near = near_pairs(words, crowd).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    seen = words.join(near, "word", "left").withColumn("has", F.coalesce(-F.col("best.minus") >= ratio * F.col("n"), F.lit(False)))
    found = stage(seen.select("word", F.when(F.col("has"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                              F.when(F.col("has"), -F.col("best.minus")).alias("form_n")), "variants")
    roots = last_forms(found.where("form IS NOT NULL"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLES = {"op11_spelling_variants": r"""
WITH RECURSIVE steps AS (SELECT list_transform(range(0, 256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
                             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
     run AS (SELECT doc_id, w, count(*) AS n
             FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents)
             WHERE length(w) >= 7 GROUP BY ALL),
     hexed AS (SELECT *, hex(coalesce(doc_id::VARCHAR, '') || ':' || w) AS x FROM run),
     summed AS (SELECT w, n, xor(list_reduce([4294967295] || list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, (2 * i + 1)::INT, 2))::BIGINT),
                       lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM hexed, steps),
     word AS (SELECT word, sum(n)::BIGINT AS n
              FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM summed)
              WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
     alpha AS (SELECT string_agg(chr((192 + i)::INT), '' ORDER BY i) AS wide, string_agg(chr((33 + i)::INT), '' ORDER BY i) AS narrow FROM range(64) AS r(i)),
     coded AS (SELECT word, n, translate(word, wide, narrow) AS c FROM word, alpha),
     near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM coded a JOIN coded b ON abs(length(a.c) - length(b.c)) <= 1 AND a.c <> b.c AND levenshtein(a.c, b.c) = 1),
     best AS (SELECT word, count(*) AS n_near, min({'a': -near_n, 'b': encode(near), 'c': near}) AS top FROM near GROUP BY word),
     form AS (SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -top.a >= 10 * n THEN top.c END AS form, CASE WHEN -top.a >= 10 * n THEN -top.a END::BIGINT AS form_n
              FROM word LEFT JOIN best USING (word)),
     chain AS (SELECT word, word AS root, form AS next FROM form
               UNION ALL SELECT chain.word, form.word, form.form FROM chain JOIN form ON form.word = chain.next)
SELECT form.word, form, root, n, n_near, form_n FROM form JOIN chain ON chain.word = form.word AND chain.next IS NULL"""}
