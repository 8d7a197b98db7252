"""Mixture-controlled packing: every window takes tokens from the source queues in target proportions.

Each source is a queue of tokens and has a target share. Its quanta get virtual finish times spaced by one over the share, so
a source owns its share of every stretch of virtual time; serving quanta in the order of their times is a deficit round
robin: what a source is behind its target at the end of a window, at most a quantum, is its deficit, which makes its next
quantum come first in the window that follows. A quantum's place is the number of quanta of all sources with earlier
times, which integer arithmetic on the queue lengths gives, so partitions place their own tokens without a running state
and deficits carry over from one partition to the next. A source that has run out leaves its part to the others.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Mapping
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.common import ranges, table, worker_store
from rillwork.session import stage

SPAN = 1 << 62
RANKS = "byte_bpe_50k.tiktoken"
#: White space beside white space: the pre-tokeniser may then join what the spaces part.
LOOSE = re.compile(r"\s\s")
TOKENS = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("part", pa.int32()), ("local", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
                    ("offset", pa.int64()), ("source", pa.string()), ("ids", pa.binary())])


def binaries(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column whose values lie one behind the other in ``flat``."""
    ends = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths * flat.itemsize, out=ends[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


class WordEncoder:
    """Token ids of whole texts; every space-led chunk is encoded once and kept.

    The pre-tokeniser starts a new piece at each single space between two other characters, so a text is the
    concatenation of its space-led chunks. Texts with white space beside a space are encoded as a whole. The ranks are
    the vocabulary of ``byte_bpe_50k.json``; a test holds the ids against that file's own tokenizer.
    """

    def __init__(self, ranks: str, pattern: str, most: int = 900_000):
        import tiktoken

        with open(ranks, "rb") as f:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.one = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table_, special_tokens={}).encode_ordinary
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.heads_of: dict[str, np.ndarray] = {}
        self.pool = np.empty(1 << 20, np.uint16)
        self.starts = np.zeros(1 << 18, np.int64)  # starts[k + 1] is also the end of entry k

    def _keep(self, chunks: list[str]) -> None:
        k, used = len(self.index), int(self.starts[len(self.index)])
        flat: list[int] = []
        sizes = []
        for chunk in chunks:
            ids = self.one(" " + chunk)
            sizes.append(len(ids))
            flat += ids
        while used + len(flat) > self.pool.size:
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while k + len(chunks) >= self.starts.size:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.pool[used:used + len(flat)] = flat
        self.starts[k + 1:k + 1 + len(chunks)] = used + np.cumsum(sizes)
        self.index.update(zip(chunks, range(k, k + len(chunks))))

    def _head(self, chunk: str) -> np.ndarray:
        """Ids of the first chunk of a text; short ones, which many texts begin with, are kept."""
        ids = self.heads_of.get(chunk)
        if ids is None:
            ids = np.asarray(self.one(chunk), np.uint16)
            if len(chunk) <= 32:
                self.heads_of[chunk] = ids
        return ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One id array (unsigned 16 bit) per text."""
        if len(self.index) + len(self.heads_of) > self.most:
            self.clear()
        out = [np.empty(0, np.uint16)] * len(texts)
        chunked = []
        for i, text in enumerate(texts):
            if text and (LOOSE.search(text) or text[0].isspace() or text[-1].isspace()):
                out[i] = np.asarray(self.one(text), np.uint16)
            elif text:
                chunked.append(i)
        if not chunked:
            return out
        parts = pc.split_pattern(pa.array([texts[i] for i in chunked], pa.large_string()), " ")
        coded = parts.values.dictionary_encode()
        known = coded.dictionary.to_pylist()
        entry = np.fromiter(map(self.index.get, known, repeat(-1)), np.int64, len(known))
        fresh = np.flatnonzero(entry < 0)
        if len(fresh):
            k = len(self.index)
            self._keep([known[j] for j in fresh.tolist()])
            entry[fresh] = np.arange(k, k + len(fresh))
        entry, ends = entry[coded.indices.to_numpy()], parts.offsets.to_numpy()
        for lo in range(0, len(chunked), 200):
            some, cuts = chunked[lo:lo + 200], ends[lo:lo + 201]
            own = entry[cuts[0]:cuts[-1]]
            sizes = self.starts[own + 1] - self.starts[own]
            sizes[cuts[:-1] - cuts[0]] = 0  # the head of a text has no space before it
            places = np.concatenate([[0], np.cumsum(sizes)])[cuts - cuts[0]].tolist()
            flat = self.pool[ranges(self.starts[own], sizes)]
            for i, a, b in zip(some, places[:-1], places[1:]):
                out[i] = np.concatenate([self._head(texts[i].partition(" ")[0]), flat[a:b]])
        return out


def tokenize(docs: DataFrame, doc_id: str, text: str, source: str, ranks: str, pattern: str, end_id: int) -> DataFrame:
    """Per document its ids (unsigned 16 bit, little-endian, end id last), partition and place in its source's local queue."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, queue, kept = TaskContext.get().partitionId(), {}, worker_store()
        if ranks not in kept:
            kept[ranks] = WordEncoder(ranks, pattern)
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, 2500):
                batch = whole_batch.slice(lo, 2500)
                ids = kept[ranks].encode(batch.column("text").to_pylist())
                lengths = np.array([len(x) + 1 for x in ids], np.int64)
                flat = np.concatenate([y for x in ids for y in (x, [end_id])]).astype("<u2")
                local = []
                for s, n in zip(batch.column("source").to_pylist(), lengths.tolist()):
                    local.append(queue.get(s, 0))
                    queue[s] = local[-1] + n
                yield pa.record_batch([batch.column("doc_id"), batch.column("source"), pa.array(np.full(len(ids), part, np.int32)), pa.array(local, pa.int64()),
                                       pa.array(lengths), binaries(flat, lengths)], schema=TOKENS)

    narrow = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    return narrow.mapInArrow(run, "doc_id long, source string, part int, local long, doc_tokens long, ids binary")


def steps(totals: np.ndarray, quantum: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(quanta, virtual time between two quanta) of each queue. ``weights`` are the target shares as whole numbers, by default the queues' quanta.

    The queue that lasts longest at its share fills the whole span of virtual time.
    """
    n = -(-totals // quantum)
    w = [int(x) for x in (n if weights is None else weights)]
    longest = max(((int(a), b) for a, b in zip(n, w) if a), key=lambda q: Fraction(*q), default=(1, 1))
    return n, np.array([SPAN * longest[1] // (longest[0] * b) if a else SPAN for a, b in zip(n, w)], np.int64)


def places(part_of: np.ndarray, number: np.ndarray, totals: np.ndarray, quantum: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Place in the merged stream of the first token of quantum ``number`` of source ``part_of``.

    Sources are indexes into ``totals`` (tokens of each queue). A quantum's time is its number times its source's step
    plus half a step; before it come all quanta of smaller time, and of equal time those of sources with smaller index.
    """
    n, step = steps(totals, quantum, weights)
    time = number * step[part_of] + step[part_of] // 2
    place = np.zeros(len(number), np.int64)
    for s in range(len(totals)):
        if n[s]:
            late = time - step[s] // 2
            ahead = np.where(late > 0, (late + step[s] - 1) // step[s], 0)
            ahead += ((late >= 0) & (late % step[s] == 0) & (s < part_of))
            np.minimum(np.minimum(ahead, n[s]) * quantum, totals[s], out=ahead)
            place += np.where(part_of == s, number * quantum, ahead)
    return place


def cut(q0: np.ndarray, lengths: np.ndarray, part_of: np.ndarray, totals: np.ndarray, window: int, quantum: int, weights: np.ndarray | None = None):
    """Pieces of documents that start at ``q0`` in their source's queue: (document, start, length, sequence, offset) arrays.

    Tokens behind the last full window form sequences whose lengths are the powers of two of their number, so nothing is padded.
    """
    first, last = q0 // quantum, (q0 + lengths - 1) // quantum
    count = last - first + 1
    doc = np.repeat(np.arange(len(q0)), count)
    number = ranges(first, count)
    begin = np.maximum(number * quantum, q0[doc])
    end = np.minimum((number + 1) * quantum, (q0 + lengths)[doc])
    at = places(part_of[doc], number, totals, quantum, weights) + begin - number * quantum
    begin, size = begin - q0[doc], end - begin

    def split(doc, begin, size, at, edge):
        """Cuts each piece at multiples of ``window`` and at the sorted places ``edge``."""
        while True:
            stop = (at // window + 1) * window
            if len(edge):
                k = np.searchsorted(edge, at, "right")
                stop = np.minimum(stop, np.where(k < len(edge), edge[np.minimum(k, len(edge) - 1)], np.iinfo(np.int64).max))
            over = at + size > stop
            if not over.any():
                return doc, begin, size, at
            head = np.where(over, stop - at, size)
            doc, begin, size, at = (np.concatenate([x, y[over]]) for x, y in ((doc, doc), (begin, begin + head), (head, size - head), (at, at + head)))

    total = int(totals.sum())
    full, rest = total // window, total % window
    powers = [1 << k for k in range(window.bit_length(), -1, -1) if rest >> k & 1]
    edge = full * window + np.cumsum([0, *powers], dtype=np.int64)
    doc, begin, size, at = split(doc, begin, size, at, edge)
    tail = at >= full * window
    k = np.searchsorted(edge, at, "right") - 1
    sequence = np.where(tail, full + k, at // window)
    offset = np.where(tail, at - edge[np.maximum(k, 0)], at % window)
    # neighbours of one document in one sequence are one piece
    order = np.lexsort((begin, doc))
    doc, begin, size, sequence, offset = (x[order] for x in (doc, begin, size, sequence, offset))
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (sequence[1:] == sequence[:-1]) & (offset[1:] == offset[:-1] + size[:-1])
    heads = np.flatnonzero(~same)
    return doc[heads], begin[heads], np.add.reduceat(size, heads) if len(heads) else size, sequence[heads], offset[heads]


def pack(docs: DataFrame, ranks: str, pattern: str, doc_id: str = "doc_id", text: str = "text", source: str = "source", window: int = 1024,
         quantum: int = 64, end_id: int = 0, shares: Mapping[str | None, float] | None = None) -> DataFrame:
    """Packs all documents into sequences of at most ``window`` tokens; every window holds the sources in their target shares, as long as they last.

    ``shares`` gives the targets (positive, in any unit; a source without one gets the smallest given); by default a source's
    share is that of its tokens, so all sources end together. Each token is packed once whatever the shares. Which documents
    share a sequence depends on how the input is split into partitions: a rerun on the same split gives the same sequences.

    ``ranks`` and ``pattern`` name the byte-level vocabulary (at most 65,536 ids). Returns one row per piece: doc_id, start,
    length, doc_tokens, sequence_id, offset, source, ids (unsigned 32-bit little-endian).
    Null and empty texts are one end id; a null source is a source of its own; a null doc_id stays null; repeated rows are
    packed each; an empty table gives no rows; other columns are not read. Texts of any length are cut, none is shortened.
    The driver gets one number per source; documents never leave the partition that tokenised them.
    """
    tokens = stage(tokenize(docs, doc_id, text, source, ranks, pattern, end_id), "tokens")
    local = tokens.groupBy("source", "part").agg(F.sum("doc_tokens").alias("n"))
    queue = Window.partitionBy("source").orderBy("part")
    base = stage(local.select(F.col("source").alias("s"), F.col("part").alias("p"), "n", (F.sum("n").over(queue) - F.col("n")).alias("base")), "queues")
    sums = {r["s"]: int(r["n"]) for r in base.groupBy("s").agg(F.sum("n").alias("n")).collect()}
    names = sorted(sums, key=lambda s: (s is None, s or ""))
    index = {s: i for i, s in enumerate(names)}
    totals = np.array([sums[s] for s in names], np.int64)
    weights = None
    if shares:
        least = min(shares.values())
        if least <= 0:
            raise ValueError("shares are positive")
        weights = np.array([max(1, round(shares.get(s, least) / max(shares.values()) * 10 ** 6)) for s in names], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, 1000):
                batch = whole_batch.slice(lo, 1000)
                part_of = np.array([index[s] for s in batch.column("source").to_pylist()], np.int64)
                q0 = batch.column("base").to_numpy() + batch.column("local").to_numpy()
                doc, start, length, sequence, offset = cut(q0, batch.column("doc_tokens").to_numpy(), part_of, totals, window, quantum, weights)
                flat = np.frombuffer(b"".join(batch.column("ids").to_pylist()), "<u2").astype("<u4")  # pieces come in the order of their ids
                of = pa.array(doc)
                yield pa.record_batch([batch.column("doc_id").take(of), pa.array(start), pa.array(length), batch.column("doc_tokens").take(of), pa.array(sequence),
                                       pa.array(offset), batch.column("source").take(of), binaries(flat, length)], schema=PIECES)

    joined = tokens.join(base.drop("n"), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return joined.select("doc_id", "source", "base", "local", "doc_tokens", "ids").mapInArrow(
        run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, source string, ids binary")


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


QUERIES = {"op10_packing": op10_packing}
