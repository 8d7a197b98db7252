"""Words of many texts at once, as numpy arrays over their bytes."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwork.llm.common import mix

LETTER = re.compile(r"[^\W\d_]")
#: Texts are read in pieces of this many characters, cut behind a white space.
PIECE = 500_000
_CLASS = np.zeros(256, np.uint8)
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[128:] = 1
for _c in b"\n.!?":
    _CLASS[_c] = 2
_ODD = 0x100000001B3  # odd, so it has an inverse modulo 2 ** 64
_BACK = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def pieces(text: str):
    """The text cut behind white space every PIECE characters; one without white space is cut there all the same."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            space = max(text.rfind(" ", at, end), text.rfind("\n", at, end))
            end = space + 1 if space > at else end
        yield text[at:end]
        at = end


@dataclass
class Words:
    """Lower-cased letter runs of a block of texts: bytes, and for each word its first byte, end, text and whether a sentence starts."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    opens: np.ndarray

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, equal for equal words wherever they stand."""
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, n), out=total[1:], dtype=np.uint64)
        return mix((total[self.end] - total[self.start]) * _powers(_BACK, n)[self.start])


def scan(texts: list[tuple[int, str]]) -> Words:
    """Words of (number, text) pairs. Letters are ASCII letters and everything beyond ASCII; a sentence ends at a line break or . ! ?"""
    parts = [t.lower().encode("utf-8", "replace") for _, t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(parts) + b"\n", np.uint8)
    kind = _CLASS[data]
    letter = kind == 1
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    begins = np.cumsum([1] + [len(p) + 1 for p in parts])
    text = np.searchsorted(begins, start, "right") - 1
    stops = np.cumsum(kind == 2)
    opens = np.ones(len(start), bool)
    opens[1:] = stops[start[1:]] != stops[start[:-1]]
    numbers = np.array([i for i, _ in texts], np.int64)
    return Words(data, start, end, numbers[text] if len(start) else np.empty(0, np.int64), opens)


def blocks(texts: list[str | None], most: int = 1_000_000):
    """Words of all texts that have a letter, in blocks of about ``most`` characters."""
    group, size = [], 0
    for i, t in enumerate(texts):
        if t is None or not LETTER.search(t):
            continue
        for piece in pieces(t):
            group.append((i, piece))
            size += len(piece)
            if size >= most:
                yield scan(group)
                group, size = [], 0
    if group:
        yield scan(group)


def first_per_class(rows: DataFrame, of: str, key: str, most: int, salts: int = 64) -> DataFrame:
    """Of each class the ``most`` rows with the smallest hash of ``key``: the same rows at every run.

    Each class is first cut into ``salts`` parts of which ``most`` rows stay, so a hot class never meets in one task.
    """
    hashed = rows.withColumn("__hash", F.xxhash64(key, F.lit(11))).withColumn("__salt", F.pmod(F.xxhash64(key, F.lit(13)), F.lit(salts)))
    for part in ([of, "__salt"], [of]):
        hashed = hashed.withColumn("__rank", F.row_number().over(Window.partitionBy(*part).orderBy("__hash", key))).where(F.col("__rank") <= most)
    return hashed.drop("__hash", "__salt", "__rank")


def fold(key: Column, parts: int) -> Column:
    """The CRC-32 of an id written as text, modulo ``parts``."""
    return F.crc32(key.cast("string").cast("binary")) % parts
