"""Substring dedup by sliding sentence spans.

A text is cut into sentences; every run of consecutive sentences is hashed, equal runs are joined over all documents, and
the sentences covered by any run that is not the first of its kind are removed. The first is the one with the smallest
document id, then the smallest position.

Text without sentence marks is cut by its own words: of every ``WINDOW`` words in a row within a sentence, the one with the
smallest CRC-32, the last of equals, ends a piece. So where a passage is cut depends on the passage, not on where it was
pasted. A piece has about six words; any 64 words that two documents share hold three whole pieces of both, and nearly any 50. Short sentences are taken together: a run
goes on beyond ``run`` sentences until it has ``min_words`` words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import mix, raw, table

#: Words of which one ends a piece, where no sentence ends among them.
WINDOW = 11
SPANS = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("h", pa.int64()), ("g", pa.int32()), ("again", pa.bool_())])


def pieces(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words, number of the first word, first byte) of every piece of a UTF-8 text; a piece keeps the white space behind it.

    A sentence ends with a word that ends in a full stop, exclamation or question mark, and at a line break.
    """
    words = data.split()
    if not words:
        return [], np.empty(0, np.int64), np.empty(0, np.int64)
    d = np.frombuffer(data, np.uint8)
    solid = np.zeros(len(d) + 2, bool)
    solid[1:-1] = ~((d == 32) | ((d >= 9) & (d <= 13)))
    start, end = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(~solid[1:] & solid[:-1])
    breaks = np.concatenate([[0], np.cumsum(d == 10)])
    closes = np.isin(d[end - 1], np.frombuffer(b".!?", np.uint8))
    closes[:-1] |= breaks[start[1:]] > breaks[end[:-1]]
    closes[-1] = True
    cut, n = closes.copy(), len(words) - WINDOW + 1
    if n > 0:
        sums = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        sentence = np.cumsum(closes) - closes
        inside = np.flatnonzero(sentence[:n] == sentence[WINDOW - 1:])
        least = np.lib.stride_tricks.sliding_window_view(sums, WINDOW)[inside, ::-1].argmin(1)
        cut[inside + WINDOW - 1 - least] = True
    first = np.concatenate([[0], np.flatnonzero(cut[:-1]) + 1])
    at = start[first]
    at[0] = 0
    return words, first, at


def runs(words: list[bytes], first: np.ndarray, run: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first piece, number of pieces, 64-bit hash) of the run that begins at each piece; runs that the text ends too early have none."""
    n = len(first)
    if n < run:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    edge = [*first.tolist(), len(words)]
    one = np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[a:b])) for a, b in zip(edge, edge[1:])), np.uint64, n)
    before = np.array(edge, np.int64)
    # the first number of pieces, ``run`` at least, that reaches the words asked for
    last = np.maximum(np.searchsorted(before, before[:-1] + min_words, "left"), np.arange(n) + run)
    at = np.flatnonzero(last <= n)
    count, key = last[at] - at, np.zeros(len(at), np.uint64)
    for k in range(int(count.max()) if len(count) else 0):
        live = count > k
        key[live] = mix(key[live] + one[at[live] + k])
    return at, count, key


def spans(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    """(doc_id, at, h, g, again) of every run; h and g together are a 96-bit key, again says that it stands further up in the same text too."""

    def repeated(key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key), bool)
        out[np.unique(key, return_index=True)[1]] = False
        return out

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                found = [runs(*pieces(raw(t))[:2], run, min_words) for t in part.column("text").to_pylist()]
                ids = np.repeat(part.column("doc_id").to_numpy(), [len(a) for a, _, _ in found])
                key = np.concatenate([k for _, _, k in found])
                yield pa.record_batch([pa.array(ids), pa.array(np.concatenate([a for a, _, _ in found]).astype(np.int32)), pa.array(key.view(np.int64)),
                                       pa.array((mix(key + np.uint64(1)) >> np.uint64(33)).astype(np.int32)),
                                       pa.array(np.concatenate([repeated(k) for _, _, k in found]))], schema=SPANS)

    return docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(cut, "doc_id long, at int, h long, g int, again boolean")


def removals(docs: DataFrame, run: int, min_words: int) -> DataFrame:
    """(doc_id, starts): where the runs begin that are not the first of their kind.

    A run that its own text repeats needs no other document. The first of each text are grouped with map-side minima, so a
    run that a third of all documents holds is a few rows per task; the join back has one row per key on one side and is
    split by adaptive execution on the other. Runs are made twice from the texts, as written they take more room than these.
    """
    all_spans = spans(docs, run, min_words)
    first = all_spans.where("NOT again").groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "g", "first")
    later = all_spans.join(first, ["h", "g"], "left").where("again OR doc_id > first")
    return later.groupBy("doc_id").agg(F.sort_array(F.collect_set("at")).alias("starts"))


def drop_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = 3, min_words: int = 12) -> DataFrame:
    """All columns of ``docs`` with ``text`` less its repeated sentences, and n_sentences, n_removed, n_spans (maximal removed runs).

    A run has ``run`` sentences, or as many more as it takes to reach ``min_words`` words, so that short phrases that occur by
    chance stay. Null, empty and wordless texts, and texts too short for a run, come back as they are; a null doc_id takes no
    part; rows that share a doc_id are judged against smaller ids, not against each other; an empty table gives no rows. The added
    columns replace columns of the same names.
    """
    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gone = removals(narrow, run, min_words).withColumnsRenamed({"doc_id": "__doc", "starts": "__starts"})
    joined = docs.join(gone, F.col(doc_id).cast("long") == F.col("__doc"), "left").drop("__doc")

    @F.pandas_udf("text string, n_sentences long, n_removed long, n_spans long")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, starts):
            data = raw(t)
            words, first, at = pieces(data)
            if s is None or not len(first):
                out.append((t, len(first), 0, 0))
                continue
            begin, count, _ = runs(words, first, run, min_words)
            change = np.zeros(len(first) + 1, np.int64)
            hit = np.isin(begin, np.asarray(s, np.int64))
            np.add.at(change, begin[hit], 1)
            np.add.at(change, begin[hit] + count[hit], -1)
            covered = np.cumsum(change[:-1]) > 0
            edge = np.append(at, len(data))
            kept = b"".join(data[a:b] for a, b, c in zip(edge[:-1].tolist(), edge[1:].tolist(), covered) if not c)
            out.append((kept.decode("utf-8", "surrogatepass"), len(first), int(covered.sum()), int(np.count_nonzero(covered & ~np.concatenate([[False], covered[:-1]])))))
        return pd.DataFrame(out, columns=["text", "n_sentences", "n_removed", "n_spans"])

    done = joined.withColumn("__cut", cut(F.col(text), F.col("__starts")))
    return done.withColumns({text: F.col("__cut.text"), "n_sentences": F.col("__cut.n_sentences"), "n_removed": F.col("__cut.n_removed"),
                             "n_spans": F.col("__cut.n_spans")}).drop("__cut", "__starts")


def op3_sentence_spans(spark, sf_dir: str) -> DataFrame:
    return drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_sentence_spans": op3_sentence_spans}
ORACLES = {"op3_sentence_spans": r"""
WITH steps AS (SELECT list_transform(range(0, 256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
     part AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \x09-\x0D]+[ \x09-\x0D]*')) AS raw, generate_subscripts(regexp_extract_all(text, '[^ \x09-\x0D]+[ \x09-\x0D]*'), 1) AS pos FROM documents),
     word AS (SELECT doc_id, pos, raw, regexp_extract(raw, '^[^ \x09-\x0D]+') AS w FROM part),
     code AS (SELECT w, xor(list_reduce([4294967295] || list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(w), (2 * i + 1)::INT, 2))::BIGINT),
                     lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM (SELECT DISTINCT w FROM word), steps),
     marked AS (SELECT doc_id, pos, raw, w, crc, regexp_matches(w, '[.!?]$') OR contains(raw, chr(10)) OR lead(pos) OVER d IS NULL AS closes
                FROM word JOIN code USING (w) WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
     placed AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM marked),
     least_of AS (SELECT doc_id, (16777215 - min(crc * 16777216 + 16777215 - pos) OVER win % 16777216) AS chosen, count(*) OVER win AS n
                  FROM placed WINDOW win AS (PARTITION BY doc_id, sentence ORDER BY pos ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING)),
     cuts AS (SELECT DISTINCT doc_id, chosen AS pos FROM least_of WHERE n = 11),
     numbered AS (SELECT p.doc_id, p.pos, raw, w, coalesce(sum((closes OR c.pos IS NOT NULL)::INT) OVER (PARTITION BY p.doc_id ORDER BY p.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS piece
                  FROM placed p LEFT JOIN cuts c ON c.doc_id = p.doc_id AND c.pos = p.pos),
     piece AS (SELECT doc_id, piece, string_agg(w, ' ' ORDER BY pos) AS key, string_agg(raw, '' ORDER BY pos) AS raw, min(pos) - 1 AS before, max(pos) AS upto FROM numbered GROUP BY ALL),
     run AS (SELECT a.doc_id, a.piece, min(b.piece) AS last FROM piece a JOIN piece b ON a.doc_id = b.doc_id AND b.piece BETWEEN a.piece + 2 AND a.piece + 11 AND b.upto - a.before >= 12 GROUP BY ALL),
     span AS (SELECT r.doc_id, r.piece, r.last, string_agg(p.key, chr(10) ORDER BY p.piece) AS key FROM run r JOIN piece p ON p.doc_id = r.doc_id AND p.piece BETWEEN r.piece AND r.last GROUP BY ALL),
     later AS (SELECT doc_id, piece, last FROM span QUALIFY row_number() OVER (PARTITION BY key ORDER BY doc_id, piece) > 1),
     gone AS (SELECT DISTINCT doc_id, unnest(range(piece, last + 1)) AS piece FROM later),
     cover AS (SELECT p.doc_id, p.piece, raw, g.piece IS NOT NULL AS cut, coalesce(lag(g.piece IS NOT NULL) OVER (PARTITION BY p.doc_id ORDER BY p.piece), false) AS cut_before
               FROM piece p LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.piece = p.piece),
     done AS (SELECT doc_id, count(*) AS n_sentences, count(*) FILTER (cut) AS n_removed, count(*) FILTER (cut AND NOT cut_before) AS n_spans,
                     coalesce(string_agg(raw, '' ORDER BY piece) FILTER (NOT cut), '') AS kept, bool_or(cut AND piece = 0) AS head FROM cover GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN coalesce(n_removed, 0) = 0 THEN d.text WHEN head THEN kept ELSE regexp_extract(d.text, '^[ \x09-\x0D]*') || kept END AS text,
       coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM documents d LEFT JOIN done USING (doc_id)"""}
