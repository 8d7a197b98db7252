"""Single large JSON documents (one array, one collection, one keyed object), read by many tasks and written from many.

A document has no line breaks to cut it at, and a byte range does not know whether it begins inside a string or how deep.
Spark's text reader cuts the file at a closing bracket, which moves no bytes between tasks. A first pass notes for every
range what it does to the state: the parity of its quotes and the change of depth under either start. Prefix sums of these,
one row per range, give each range its true state. A second pass cuts the range behind every top-level element; the
element that crosses an edge is put together from the partial pieces of the ranges it touches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rillwork.session import stage

#: Up to this many ranges their states are sent to every task; beyond it ranges and states meet in a shuffle.
BROADCAST_RANGES = 100_000
OPEN, CLOSE, QUOTE, SLASH = frozenset(b"{["), frozenset(b"}]"), ord('"'), ord("\\")
STATES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("odd", pa.int32()), ("outside", pa.int64()), ("inside", pa.int64()), ("first", pa.string())])
PIECES = pa.schema([("path", pa.string()), ("start", pa.int64()), ("k", pa.int64()), ("text", pa.string()), ("opens", pa.bool_()), ("closes", pa.bool_()), ("at_end", pa.bool_())])
_IS_OPEN = np.isin(np.arange(256), list(OPEN))
_IS_CLOSE = np.isin(np.arange(256), list(CLOSE))


def _unquoted(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """(which bytes stand outside of strings, whether the data ends inside of one). Ranges never begin behind a backslash."""
    quote = data == QUOTE
    slash = data == SLASH
    if slash.any():
        at = np.flatnonzero(quote)
        at = at[at > 0]
        last_plain = np.maximum.accumulate(np.where(slash, -1, np.arange(len(data))))
        quote[at[(at - 1 - last_plain[at - 1]) % 2 == 1]] = False
    parity = (np.cumsum(quote) + inside) % 2 == 1
    return ~parity & ~quote, bool(parity[-1]) if len(data) else inside


def _ranges(batches: Iterator[pa.RecordBatch], end: bytes):
    """(path, start, first rows, byte arrays with a mark on the last one) of every range of a file in this task."""
    def runs():
        for batch in batches:
            paths, starts = batch.column("path").to_pylist(), batch.column("start").to_pylist()
            change = [i for i in range(1, batch.num_rows) if starts[i] != starts[i - 1] or paths[i] != paths[i - 1]]
            for a, b in zip([0, *change], [*change, batch.num_rows]):
                if b > a:
                    yield (paths[a], starts[a]), batch.slice(a, b - a)

    def data(parts):
        held = None
        for part in parts:
            if held is not None:
                yield held, False
            held = np.frombuffer(end.join(part.column("value").cast(pa.binary()).to_pylist()) + end, np.uint8)
        yield held, True

    for (path, start), group in groupby(runs(), key=lambda r: r[0]):
        parts = (part for _, part in group)
        first = next(parts)
        yield path, start, first, data(chain([first], parts))


def _fragments(spark: SparkSession, path: str, end: str) -> DataFrame:
    return spark.read.option("lineSep", end).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def range_states(fragments: DataFrame, end: str = "}") -> DataFrame:
    """One row per byte range: path, start, in_string and depth where it begins, the file's first byte, and whether it is the last range."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, start, _, stream in _ranges(batches, end.encode()):
            ends, depth, first = [False, True], [0, 0], ""
            for data, _ in stream:
                if start == 0 and not first:
                    first = data.tobytes()[:64].decode("utf-8", "replace").lstrip("﻿ \t\r\n")[:1]
                for s in (0, 1):
                    plain, after = _unquoted(data, ends[s])
                    depth[s] += int(np.count_nonzero(plain & _IS_OPEN[data])) - int(np.count_nonzero(plain & _IS_CLOSE[data]))
                    ends[s] = after
            yield pa.record_batch([pa.array([v], f.type) for v, f in zip([path, start, int(ends[0]), depth[0], depth[1], first], STATES)], schema=STATES)

    raw = fragments.mapInArrow(scan, "path string, start long, odd int, outside long, inside long, first string")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    file = Window.partitionBy("path").orderBy("start")
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    known = raw.withColumn("in_string", inside).withColumn("change", F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside")))
    return known.select("path", "start", "in_string", F.coalesce(F.sum("change").over(before), F.lit(0)).cast("long").alias("depth"),
                        F.first("first").over(file).alias("outer"), F.lead("start").over(file).isNull().alias("last"))


def elements(spark: SparkSession, path: str, depth: int = 1, outer: str = "[", keyed: bool = False, end: str = "}") -> DataFrame:
    """(path, start, k, text) of the objects and arrays that lie directly below ``depth`` brackets of each document below ``path``.

    ``end`` is the bracket that closes most of them. Documents whose first character is not ``outer`` have none. With
    ``keyed`` the text begins with the element's key. Within a path, start and k follow the document's order. An element
    that the end of the file cuts is not returned.
    """
    fragments = _fragments(spark, path, end)
    states = stage(range_states(fragments, end), "ranges")
    own = [c for c in states.columns if c not in ("path", "start")]
    met = (F.col("f.path") == F.col("s.path")) & (F.col("f.start") == F.col("s.start"))
    few = states.limit(BROADCAST_RANGES + 1).count() <= BROADCAST_RANGES
    if few:
        ready = fragments.alias("f").join(F.broadcast(states.alias("s")), met).select("f.*", *[f"s.{c}" for c in own])
    else:
        numbered = fragments.withColumn("row", F.monotonically_increasing_id())
        ready = numbered.alias("f").join(states.alias("s"), met).select("f.*", *[f"s.{c}" for c in own])
        ready = ready.repartition("path", "start").sortWithinPartitions("path", "start", "row").drop("row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, start, first, stream in _ranges(batches, end.encode()):
            state = {c: first.column(c)[0].as_py() for c in own}
            if state["outer"] != outer:
                for _ in stream:
                    pass
                continue
            inside, now, k = state["in_string"], state["depth"], 0
            held, opened = ([] if now > depth or (keyed and now == depth) else None), False  # bytes of the open element
            for data, final in stream:
                plain, inside = _unquoted(data, inside)
                step = (plain & _IS_OPEN[data]).astype(np.int64) - (plain & _IS_CLOSE[data])
                level = now + np.cumsum(step)
                now = int(level[-1])
                ends = np.flatnonzero((step < 0) & (level == depth)) + 1
                if keyed:  # the key stands behind the element before it or behind the outer bracket
                    begins = np.sort(np.concatenate([np.flatnonzero((step > 0) & (level == depth)) + 1, ends]))
                else:
                    begins = np.flatnonzero((step > 0) & (level == depth + 1))
                raw, at, out = data.tobytes(), 0, []

                def begin(at):
                    nxt = np.searchsorted(begins, at)
                    return (True, [], int(begins[nxt])) if nxt < len(begins) else (opened, None, at)

                for e in ends.tolist():
                    if held is None:
                        opened, held, at = begin(at)
                        if held is None or at > e:  # a closing bracket without its opening one
                            held, at = None, e
                            continue
                    out.append((b"".join([*held, raw[at:e]]), opened, True, final and e == len(raw)))
                    held, at = None, e
                if held is None:
                    opened, held, at = begin(at)
                if held is not None:
                    held.append(raw[at:])
                if out:
                    yield _pieces(name, start, k, out)
                    k += len(out)
            if held:
                yield _pieces(name, start, k, [(b"".join(held), opened, False, False)])

    pieces = ready.mapInArrow(cut, "path string, start long, k long, text string, opens boolean, closes boolean, at_end boolean")
    # the reader's last fragment of a file may lack the bracket that this one puts behind each
    last = states.where("last").select(F.col("path").alias("of"), F.col("start").alias("at"))
    doubtful = (F.col("path") == F.col("of")) & (F.col("start") == F.col("at")) & F.col("at_end")
    real = stage(pieces.join(F.broadcast(last) if few else last, doubtful, "left_anti"), "pieces")
    order = Window.partitionBy("path").orderBy("start", "k")  # at most two partial pieces of a range
    partial = real.where("NOT (opens AND closes)").withColumn("e", F.sum(F.col("opens").cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("start", "k", "text", "opens", "closes")))
    together = (partial.groupBy("path", "e").agg(parts.alias("p")).where("p[0].opens AND element_at(p, -1).closes")
                .select("path", F.col("p")[0]["start"].alias("start"), F.col("p")[0]["k"].alias("k"), F.array_join(F.col("p.text"), "").alias("text")))
    found = real.where("opens AND closes").select("path", "start", "k", "text").unionByName(together)
    return found.withColumn("text", F.regexp_replace("text", r"^[\s,]+", "")) if keyed else found


def _pieces(path: str, start: int, k: int, rows: list) -> pa.RecordBatch:
    n = len(rows)
    return pa.record_batch([pa.array([path] * n), pa.array([start] * n, pa.int64()), pa.array(range(k, k + n), pa.int64()), pa.array([r[0].decode("utf-8", "replace") for r in rows]),
                            pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows])], schema=PIECES)


def write_documents(lines: DataFrame, path: str, head: str = "[", foot: str = "]") -> None:
    """One JSON document per task: ``head``, the rows of the only column (JSON text) with commas between, ``foot``. Nothing is gathered."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for v in batch.column(0).to_pylist():
                if held is not None:
                    yield pa.record_batch([pa.array([held + ","])], names=["value"])
                    held = v
                else:
                    held = head + v
        if held is not None:
            yield pa.record_batch([pa.array([held + foot])], names=["value"])

    lines.mapInArrow(run, "value string").write.mode("overwrite").text(path)
