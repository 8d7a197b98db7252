import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rillwork.llm import tokenfiles
from rillwork.session import scratch_path

SCHEMA = "doc_id long, text string, n string, ids string, path string, shard string, any string"


@pytest.fixture(scope="module")
def oracle():
    t = Tokenizer.from_file(public_tokenizers.path(tokenfiles.VOCABULARY))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def brute(rows, oracle):
    """(doc_id, start, ids) of each row in ascending order of ids, null ids last."""
    out, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = oracle(t)
        out.append((d, start, ids))
        start += len(ids)
    return out


def round_trip(spark, rows, **more):
    folder = scratch_path(spark, "token-test")
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA).repartition(5)
    manifest = tokenfiles.write(docs, folder, public_tokenizers.path(tokenfiles.VOCABULARY), **more).collect()
    return manifest, [(r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in tokenfiles.read(spark, folder).orderBy("start").collect()]


@pytest.mark.parametrize("width", [2, 4])
def test_files_hold_every_document(spark, oracle, width):
    rows = [(i * 7 - 900, f"Word {i}, it's <|endoftext|> \n\n  and é ü\t{'more ' * (i % 40)}") for i in range(300)]
    rows += [(5000, None), (5001, ""), (5002, "long " * 30000), (None, "no id")]
    manifest, got = round_trip(spark, rows, width=width)
    assert got == brute(rows, oracle)
    spans = sorted((m.base, m.n_tokens, m.n_docs) for m in manifest)
    assert len(spans) > 1 and sum(m[2] for m in spans) == len(rows)
    assert all(a[0] + a[1] == b[0] for a, b in zip(spans, spans[1:]))
    m = manifest[0]
    offsets = np.memmap(m.path + ".offsets", "<u8", "r")
    assert len(offsets) == m.n_docs + 1 and int(offsets[0]) == m.base and len(np.memmap(m.path + ".ids", f"<u{width}", "r")) == m.n_tokens == int(offsets[-1]) - m.base


def test_an_id_that_most_rows_share_fills_many_shards(spark, oracle):
    rows = [(7, f"text number {i}") for i in range(400)] + [(7, "same")] * 200 + [(None, "null")] * 200 + [(i, "x") for i in range(20)]
    manifest, got = round_trip(spark, rows)
    assert len(manifest) > 4 and max(m.n_docs for m in manifest) < 400
    want = brute(rows, oracle)
    assert [g[0] for g in got] == [w[0] for w in want] and sorted(g[2] for g in got) == sorted(w[2] for w in want)
    assert all(a[1] + len(a[2]) == b[1] for a, b in zip(got, got[1:]))
    assert round_trip(spark, rows[::-1])[1] == got


def test_wide_ids_need_wide_files(spark):
    with pytest.raises(Exception, match="does not fit"):
        round_trip(spark, [(1, "a")], end_id=1 << 16)
    assert round_trip(spark, [(1, "a")], end_id=1 << 16, width=4)[1][0][2][-1] == 1 << 16


def test_encoder_keeps_chunks(oracle):
    encoder = tokenfiles.JsonEncoder(public_tokenizers.path(tokenfiles.VOCABULARY), most=5, together=2)
    texts = ["a b c a b c", None, "", "it's we'll don't x", "a  b", " a", "one\ntwo three.\nfour five", "1234 ab12 \u00a0z", "日本 語 é", "the the <|endoftext|> the", "tail "]
    for _ in range(2):
        assert [x.tolist() for x in encoder.encode(texts)] == [oracle(t)[:-1] for t in texts]


def test_first_chunks_are_encoded_once(oracle):
    encoder, calls = tokenfiles.JsonEncoder(public_tokenizers.path(tokenfiles.VOCABULARY)), []
    one = encoder.one
    encoder.one = lambda text: calls.append(text) or one(text)
    texts = ["Some words here", None, "Some other words", "", "alone", "x" * 40 + " far"] * 300
    got = encoder.encode(texts)
    assert len(got) == len(texts) and len(calls) <= 2 + 300
    assert all(x.tolist() == oracle(t)[:-1] for t, x in zip(texts[:12], got[:12]))
    assert all((a == b).all() for a, b in zip(got, got[6:]))


def test_empty_table_and_query(spark, oracle):
    assert round_trip(spark, []) == ([], [])
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = sorted(tuple(r) for r in tokenfiles.op13_token_files(spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == [(d, s, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, s, ids in brute(docs, oracle)]
