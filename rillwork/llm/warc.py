"""Web archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding a group of whole WARC records, followed by a seek table
in a skippable frame (the public seekable format), so that any plain Zstandard reader still reads the file. The index
maps a record to its bundle, frame and offset inside the decompressed frame: one record costs one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import NO_ID, back, table, whole
from rillwork.llm.files import opened
from rillwork.session import scratch_path, stage

# Fixed values of the public formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, record_id string, path string, frame int, offset long, length long, record_type string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, record_id string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def record(page_id: int, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[str, bytes]:
    """One WARC record and its id: a response with its payload, or a revisit that names the record which holds it."""
    digest = base32_sha1(payload)
    name = record_id(page_id, digest)
    safe = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", str(page_id)), ("X-Payload-Length", str(len(payload)))]
    if url is not None:
        head.append(("WARC-Target-URI", safe))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block = http + payload
    else:
        block = http
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
    head.append(("Content-Length", str(len(block))))
    return name, "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[dict, bytes, int]:
    """(headers, block, end) of the record that starts at ``at``."""
    stop = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:stop].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = dict(line.split(": ", 1) for line in lines)
    begin = stop + 4
    end = begin + int(head["Content-Length"])
    if data[end:end + 4] != b"\r\n\r\n":
        raise ValueError(f"WARC record at {at} does not end where it says")
    return head, data[begin:end], end + 4


class Bundle:
    """Writes one bundle; ``add`` returns a record's (frame, offset, length)."""

    def __init__(self, uri: str, frame_bytes: int, level: int):
        system, path = opened(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.packer, self.most = system.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level), frame_bytes
        self.group, self.held, self.sizes, self.raw = [], 0, [], 0

    def add(self, data: bytes) -> tuple[int, int, int]:
        if self.held and self.held + len(data) > self.most:
            self._flush()
        place = (len(self.sizes), self.held, len(data))
        self.group.append(data)
        self.held += len(data)
        self.raw += len(data)
        return place

    def _flush(self) -> None:
        frame = self.packer.compress(b"".join(self.group))
        self.out.write(frame)
        self.sizes.append((len(frame), self.held))
        self.group, self.held = [], 0

    def close(self) -> None:
        if self.held:
            self._flush()
        entries = b"".join(struct.pack("<II", *s) for s in self.sizes)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC))
        self.out.close()


class BundleReader:
    """Reads the seek table at the end of a bundle and any frame by its number."""

    def __init__(self, uri: str):
        system, path = opened(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", self.file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        self.file.seek(size - 9 - 8 * count)
        table_ = self.file.read(8 * count)
        self.frames, at = [], 0
        for k in range(count):
            packed, raw = struct.unpack_from("<II", table_, 8 * k)
            self.frames.append((at, packed, raw))
            at += packed

    def frame(self, number: int) -> bytes:
        at, packed, raw = self.frames[number]
        self.file.seek(at)
        data = zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=raw)
        if len(data) != raw:
            raise ValueError("a frame is shorter than the seek table says")
        return data


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """``pages`` (page_id, url, payload) with refers_to: the largest page_id of those with an equal payload, null for that page itself.

    Payloads are grouped by their SHA-256; only digests and ids are grouped, with map-side maxima.
    """
    keyed = pages.withColumn("key", F.sha2("payload", 256))
    groups = (keyed.where(F.length("payload") >= min_bytes).groupBy("key").agg(F.max(F.when(F.col("page_id") != NO_ID, F.col("page_id"))).alias("largest"), F.count("*").alias("n"))
              .where("n > 1").drop("n"))
    refers = F.when(F.col("largest") != F.col("page_id"), F.col("largest")).alias("refers_to")
    return keyed.join(groups, "key", "left").select("page_id", "url", "payload", refers)


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, bundle_bytes: int = 256 << 20,
                   frame_bytes: int = 1 << 20, level: int = 6, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Writes one WARC record per row into bundles below ``folder`` and returns the index (see INDEX).

    Each task writes its own bundles under names that no other attempt uses; the index, staged once all tasks have
    ended, names only the bundles of the attempts that count. Null payloads are empty, a null URL leaves its header out,
    a null page_id is written as the smallest long and never referred to; repeated rows are written each, and rows that
    share the largest page_id of a payload are all responses; an empty table writes nothing; other columns are not read.
    """
    rows = pages.select(whole(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, path = None, ""
        for pdf in batches:
            out = []
            for page, u, body, refers in zip(pdf["page_id"].tolist(), pdf["url"].tolist(), pdf["payload"].tolist(), pdf["refers_to"].tolist()):
                if bundle is None or bundle.raw > bundle_bytes:
                    if bundle:
                        bundle.close()
                    path = f"{folder}/bundle-{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(path, frame_bytes, level)
                target = None if refers == "" else int(refers)
                name, data = record(page, u, bytes(body), target, date)
                out.append((page, name, path, *bundle.add(data), "response" if target is None else "revisit"))
            yield pd.DataFrame(out, columns=["page_id", "record_id", "path", "frame", "offset", "length", "record_type"])
        if bundle:
            bundle.close()

    marked = revisits(rows, min_bytes).withColumn("refers_to", F.coalesce(F.col("refers_to").cast("string"), F.lit("")))
    return stage(marked.mapInPandas(run, INDEX), "warc-index")


def _row(head: dict, block: bytes) -> tuple:
    digest, kind = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"]
    payload = block[block.index(b"\r\n\r\n") + 4:] if kind == "response" else None
    if payload is not None and base32_sha1(payload) != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} does not match its digest")
    return (int(head["X-Page-Id"]), head.get("WARC-Target-URI"), kind, head.get("X-Refers-To-Page"), len(payload) if payload is not None else int(head["X-Payload-Length"]),
            digest, payload, head["WARC-Record-ID"])


COLUMNS = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "record_id"]


def _result(rows: DataFrame) -> DataFrame:
    return rows.select(back("page_id"), "url", "record_type", F.col("refers_to").cast("long").alias("refers_to"), "payload_bytes", "payload_digest", "payload", "record_id")


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the bundles that the index names, read frame by frame: see RECORD. A revisit has no payload of its own."""
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bundles = index.select("path").distinct().repartition(tasks, "path")  # a given number is not merged into fewer tasks

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                reader = BundleReader(path)
                for k in range(len(reader.frames)):
                    data, at, out = reader.frame(k), 0, []
                    while at < len(data):
                        head, block, at = parse(data, at)
                        out.append(_row(head, block))
                    yield pd.DataFrame(out, columns=COLUMNS)

    return _result(bundles.mapInPandas(run, RECORD.replace("refers_to long", "refers_to string")))


def read_records(wanted: DataFrame) -> DataFrame:
    """The records of some index rows, each by its frame and offset; rows of one frame share one read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, mine in pdf.groupby("path"):
                reader = BundleReader(path)
                for frame, rows in mine.groupby("frame"):
                    data = reader.frame(int(frame))
                    yield pd.DataFrame([_row(*parse(data, int(at))[:2]) for at in rows["offset"]], columns=COLUMNS)

    return _result(wanted.select("path", "frame", "offset").mapInPandas(run, RECORD.replace("refers_to long", "refers_to string")))


def op4_seekable_warc(spark, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "archives"))
    return read_archives(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op4_seekable_warc": op4_seekable_warc}
ORACLES = {"op4_seekable_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     g AS (SELECT h, max(page_id) AS m FROM p GROUP BY h)
SELECT page_id, strlen(p.h)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((('0x' || substr(sha1(p.h), (1 + 5 * (i // 4))::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = m OR m IS NULL THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to
FROM p JOIN g USING (h)"""}
