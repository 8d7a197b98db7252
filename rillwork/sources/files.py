"""Objects of a folder as a table, and byte ranges of them read from tasks."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_DIRECTORY = "path string, member string, offset long, packed long, size long, method int"


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, object, length, modified) of every object below ``path``; object is the path as rows read from it carry it. Contents are never opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("_metadata.file_path").alias("object"), "length", F.col("modificationTime").alias("modified"))


def opened(uri: str):
    """A seekable file that a task reads ranges of."""
    from pyarrow import fs

    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(unquote(urlparse(uri).path) if scheme else uri)
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_file(path)


def zip_members(spark: SparkSession, path: str, suffix: str = ".csv") -> DataFrame:
    """Index of the zip files below ``path``: one row per member, from the directory at each file's end."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p in pdf["path"]:
                with opened(p) as f, zipfile.ZipFile(f) as z:
                    rows = [(p, m.filename, m.header_offset, m.compress_size, m.file_size, m.compress_type) for m in z.infolist() if not m.is_dir() and m.filename.lower().endswith(suffix)]
                yield pd.DataFrame(rows, columns=["path", "member", "offset", "packed", "size", "method"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return listing(spark, path).select("path").repartition(tasks, "path").mapInPandas(read, _DIRECTORY)


class _Member(io.RawIOBase):
    """The bytes of one member, unpacked as they are read."""

    def __init__(self, f, offset: int, packed: int, method: int):
        f.seek(offset)
        names = struct.unpack("<HH", f.read(30)[26:])
        f.seek(offset + 30 + sum(names))
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"zip method {method} is not supported")
        self.f, self.left, self.held = f, packed, b""
        self.unpack = zlib.decompressobj(-15).decompress if method == zipfile.ZIP_DEFLATED else bytes

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.held and self.left:
            raw = self.f.read(min(self.left, 1 << 18))
            if not raw:
                raise EOFError("the archive ends inside a member")
            self.left -= len(raw)
            self.held = self.unpack(raw)
        n = min(len(buffer), len(self.held))
        buffer[:n], self.held = self.held[:n], self.held[n:]
        return n


def member_rows(members: DataFrame, columns: Sequence[str], sep: str = ",", encoding: str = "utf-8-sig", chunk: int = 50_000) -> DataFrame:
    """Rows of delimited members as strings, with their member's name; every member is read alone, from its own byte range."""
    schema = T.StructType([*[T.StructField(c, T.StringType()) for c in columns], T.StructField("member", T.StringType())])
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m in pdf.itertuples():
                with opened(m.path) as f:
                    if not m.size:
                        continue
                    text = io.BufferedReader(_Member(f, m.offset, m.packed, m.method), 1 << 18)
                    for part in pd.read_csv(text, sep=sep, dtype=str, encoding=encoding, chunksize=chunk):
                        part.columns = [c.strip() for c in part.columns]
                        yield part.reindex(columns=list(columns)).astype(object).where(lambda d: d.notna(), None).assign(member=m.member)

    spread = members.select("path", "member", "offset", "packed", "size", "method").repartition(tasks, "path", "member")
    return spread.mapInPandas(read, schema)
