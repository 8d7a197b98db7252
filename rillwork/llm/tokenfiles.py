"""Token ids in flat binary files that are memory-mapped, with 64-bit document offsets.

A folder holds shards in ascending document order. Of each shard there are three files without headers, little-endian:

* ``<name>.ids``: the ids of its documents one behind the other, unsigned 16 or 32 bit;
* ``<name>.docs``: the document ids, signed 64 bit;
* ``<name>.offsets``: unsigned 64 bit, one for each document and one for the end. Offsets count ids from the start of the
  whole collection, so document k of a shard lies at ``offsets[k] - offsets[0]`` of its ids file.

``manifest`` (Parquet) names the shards that count with their first offset, number of documents and ids and width; files that
a lost or repeated task left behind are not in it. First offsets are prefix sums over the shards' totals, so no task
has to see what another one wrote before it.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillwork.llm.common import NO_ID, back, table, whole, worker_store
from rillwork.llm.files import opened
from rillwork.llm.packing import WordEncoder, binaries
from rillwork.session import scratch_path, stage

VOCABULARY = "byte_bpe_50k.json"
#: How byte-level vocabularies write the space byte.
SPACE = "\u0120"
#: Documents that one reading task takes at a time.
BLOCK = 4096
WRITTEN = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("block", pa.int64()), ("n_docs", pa.int64()), ("n", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary())])
CLOSED = pa.schema([("path", pa.string()), ("base", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())])
READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


class JsonEncoder(WordEncoder):
    """Ids by the ``tokenizers`` library; like its base it encodes every space-led chunk once and keeps the ids.

    For byte-level vocabularies of at most 65,536 ids. New chunks are encoded together: none has a space of its own, so
    each begins at a token that begins with the space byte.
    """

    def __init__(self, vocabulary: str, most: int = 900_000, together: int = 500):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one worker per core already
        from tokenizers import Tokenizer

        self.model, self.most, self.together = Tokenizer.from_file(vocabulary), most, together
        self.model.encode_special_tokens = True
        if self.model.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids")
        self.heads = np.zeros(1 << 16, bool)
        self.heads[[i for token, i in self.model.get_vocab().items() if token[0] == SPACE]] = True
        self.clear()

    def one(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _keep(self, chunks: list[str]) -> None:
        lines = [" " + " ".join(chunks[k:k + self.together]) for k in range(0, len(chunks), self.together)]
        flat = np.concatenate([np.array(e.ids, np.uint16) for e in self.model.encode_batch_fast(lines, add_special_tokens=False)])
        heads = np.flatnonzero(self.heads[flat])
        if len(heads) != len(chunks):
            raise ValueError("not a byte-level vocabulary")
        k, used = len(self.index), int(self.starts[len(self.index)])
        while used + len(flat) > self.pool.size:
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        while k + len(chunks) >= self.starts.size:
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.pool[used:used + len(flat)] = flat
        self.starts[k + 1:k + 1 + len(chunks)] = used + np.append(heads[1:], len(flat))
        self.index.update(zip(chunks, range(k, k + len(chunks))))


def in_order(rows: DataFrame, shards: int) -> DataFrame:
    """Rows dealt to ranges in the order of their ids, null ids last. Rows that share an id are ordered by hashes of their texts and
    a range may begin among them, so an id that a third of all rows share fills many ranges."""
    keyed = rows.withColumns({"last": F.col("doc_id") == F.lit(NO_ID), "content": F.xxhash64("text"), "again": F.crc32(F.col("text").cast("binary")), "any": F.monotonically_increasing_id()})
    keys = ["last", "doc_id", "content", "again", "any"]
    return keyed.repartitionByRange(shards, *keys).sortWithinPartitions(*keys).select("doc_id", "text")


def write(docs: DataFrame, folder: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0, width: int = 2,
          shards: int | None = None) -> DataFrame:
    """Encodes all rows, writes their ids below ``folder`` in ascending ``doc_id`` order and returns the manifest.

    ``shards`` is the number of files, by default the session's shuffle partitions. ``width`` is the bytes of an id, 2 or 4; an end id that does not fit raises an error. Null and empty texts are one end
    id; a null doc_id is written as the smallest long, behind all others; repeated rows are written each; rows that
    share a doc_id with different texts lie in the order of hashes of their texts, so reruns give the same bytes; an empty
    table writes no shard; other columns are not read. Texts of any length are written whole. Two passes: ids, then
    offsets, as their bases are prefix sums over what the first pass has written.
    """
    spark, kind = docs.sparkSession, {2: "<u2", 4: "<u4"}[width]
    if end_id >> (8 * width):
        raise ValueError(f"id {end_id} does not fit into {width} bytes")
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(whole(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def ids_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out, path, number, kept = TaskContext.get().partitionId(), None, "", 0, worker_store()
        if ("json", vocabulary) not in kept:
            kept["json", vocabulary] = JsonEncoder(vocabulary)
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, 2000):
                batch = whole_batch.slice(lo, 2000)
                if out is None:
                    path = f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}"
                    system, place = opened(path + ".ids")
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(place, compression=None)
                ids = kept["json", vocabulary].encode(batch.column("text").to_pylist())
                sizes = np.array([len(x) + 1 for x in ids], "<i8")
                out.write(np.concatenate([y for x in ids for y in (x, [end_id])]).astype(kind).tobytes())
                row = [[shard], [path], [number], [batch.num_rows], [int(sizes.sum())], [batch.column("doc_id").to_numpy().astype("<i8").tobytes()], [sizes.tobytes()]]
                yield pa.record_batch([pa.array(v, f.type) for v, f in zip(row, WRITTEN)], schema=WRITTEN)
                number += 1
        if out:
            out.close()

    blocks = stage(in_order(rows, shards).mapInArrow(ids_files, "shard int, path string, block long, n_docs long, n long, docs binary, sizes binary"), "token-blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n").alias("total"))
    bases = totals.select(F.col("shard").alias("of"), (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("base"))  # one row per shard

    def offset_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, files, at, base, n_docs = None, [], 0, 0, 0

        def close():
            files[1].write(np.array([at], "<u8").tobytes())
            for f in files:
                f.close()
            return pa.record_batch([pa.array([v], f.type) for v, f in zip([now, base, n_docs, at - base, width], CLOSED)], schema=CLOSED)

        for batch in batches:
            for row in batch.to_pylist():
                if row["path"] != now:
                    if now:
                        yield close()
                    now, at, base, n_docs = row["path"], row["base"], row["base"], 0
                    files = [opened(now + end)[0].open_output_stream(opened(now + end)[1], compression=None) for end in (".docs", ".offsets")]
                sizes = np.frombuffer(row["sizes"], "<i8")
                files[0].write(row["docs"])
                files[1].write((at + np.cumsum(sizes) - sizes).astype("<u8").tobytes())
                at, n_docs = at + int(sizes.sum()), n_docs + len(sizes)
        if now:
            yield close()

    ordered = blocks.join(bases, F.col("shard") == F.col("of")).repartition("path").sortWithinPartitions("path", "block").select("path", "base", "docs", "sizes")
    closed = ordered.mapInArrow(offset_files, "path string, base long, n_docs long, n_tokens long, width int")
    return stage(closed, "manifest", f"{folder}/manifest")


def mapped(uri: str, kind: str, first: int, count: int) -> np.ndarray:
    """``count`` numbers of a file from number ``first`` on: memory-mapped where the file system is mounted, else one ranged read."""
    from pyarrow import fs

    system, path = opened(uri)
    if not count:
        return np.empty(0, kind)
    size = np.dtype(kind).itemsize
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r", first * size, (count,))
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read_at(count * size, first * size), kind)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document below ``folder``; ids come as unsigned 32 bit, little-endian.

    A task maps the offsets of some thousand documents and no more of the ids file than they cover.
    """
    manifest = spark.read.parquet(f"{folder}/manifest")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = manifest.select("path", "n_docs", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(BLOCK).cast("long"))).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n, kind = min(BLOCK, row["n_docs"] - row["first"]), f"<u{row['width']}"
                docs = mapped(row["path"] + ".docs", "<i8", row["first"], n)
                offsets = mapped(row["path"] + ".offsets", "<u8", row["first"], n + 1).astype(np.int64)
                base = int(mapped(row["path"] + ".offsets", "<u8", 0, 1)[0])
                for lo in range(0, n, 512):
                    hi = min(n, lo + 512)
                    flat = mapped(row["path"] + ".ids", kind, offsets[lo] - base, int(offsets[hi] - offsets[lo])).astype("<u4")
                    sizes = np.diff(offsets[lo:hi + 1])
                    yield pa.record_batch([pa.array(np.array(docs[lo:hi])), pa.array(offsets[lo:hi]), pa.array(sizes), binaries(flat, sizes)], schema=READ)

    got = parts.repartition(tasks, "path", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
    return got.select(back("doc_id"), "start", "n_tokens", "ids")


def op13_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = scratch_path(spark, "token-files")
    write(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(VOCABULARY))
    return read(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op13_token_files": op13_token_files}
