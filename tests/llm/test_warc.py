import io
from collections import Counter

import zstandard

from rillwork.llm import warc
from rillwork.session import scratch_path

SCHEMA = "page_id long, url string, html string, refers_to string, path string, key string"


def write(spark, rows, **more):
    pages = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return warc.write_archives(pages, scratch_path(spark, "test-archives"), **more)


def test_round_trip(spark):
    big = "<p>" + "é" * 300_000
    rows = [(1, "http://a/x y\r\nX: 1", "same"), (2, None, "same"), (7, "http://b", "same"), (3, "u", None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n"), (None, "u", "same"),
            (6, "u", big), (8, "u", big), (9, "u", "once"), (9, "u", "once"), (None, "n", "alone")]
    index = write(spark, rows, frame_bytes=2000, bundle_bytes=4000)
    out = warc.read_archives(index).collect()
    assert len(out) == len(rows)
    best = {}
    for p, _, h in rows:
        best[h or ""] = max((x for x in (best.get(h or ""), p) if x is not None), default=None)
    want = Counter()
    for p, _, h in rows:
        body = (h or "").encode()
        refers = best[h or ""] if best[h or ""] != p else None
        want[(p, len(body), warc.base32_sha1(body), "response" if refers is None else "revisit", refers, body if refers is None else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.payload and bytes(r.payload) if r.payload is not None else None) for r in out) == want
    # random access by the index, and ids that match
    some = index.where("page_id IN (5, 8)")
    assert {r.page_id: r.record_id for r in warc.read_records(some).collect()} == {r.page_id: r.record_id for r in some.collect()}
    assert next(bytes(r.payload) for r in warc.read_records(some).collect() if r.page_id == 8) == big.encode()


def test_plain_reader_and_frames(spark):
    index = write(spark, [(i, "u", f"page {i} " * 50) for i in range(40)], frame_bytes=3000)
    for path in {r.path for r in index.collect()}:
        system, name = warc.opened(path)
        data = system.open_input_file(name).read()
        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        reader = warc.BundleReader(path)
        assert len(reader.frames) > 1 and stream == b"".join(reader.frame(k) for k in range(len(reader.frames)))


def test_min_bytes_and_empty(spark):
    out = warc.read_archives(write(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], min_bytes=3)).collect()
    assert {r.page_id: (r.record_type, r.refers_to) for r in out} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert warc.read_archives(write(spark, [])).count() == 0
