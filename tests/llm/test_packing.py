import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rillwork.llm import packing

SCHEMA = "doc_id long, text string, source string, ids string, part string, sequence_id string"


@pytest.fixture(scope="module")
def oracle():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [0]


def run(spark, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA)
    return packing.pack(docs, public_tokenizers.path(packing.RANKS), public_tokenizers.PATTERN, **more)


def test_encoder_equals_the_tokenizer(spark, oracle):
    encoder = packing.WordEncoder(public_tokenizers.path(packing.RANKS), public_tokenizers.PATTERN, most=3)
    texts = ["", None, "a", " a", "a ", "a  b", "it's   we'll\tx", "a\n\nb c.", "a b c", "é ü　z", "1234 ab12", "one two one", "x <|endoftext|> y", "😀 hi".encode("utf-16", "surrogatepass").decode("utf-16")]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert ids.tolist() == oracle(text)[:-1]


def test_pieces_cover_every_id_once(spark, oracle):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta.", "gamma\n", "d"], rng.integers(0, 90))), ["a", "b", "b", "b", None][i % 5], "x", "y", "z") for i in range(60)]
    rows += [(60, None, "lone", None, None, None), (None, "null id", "a", "", "", ""), (5, "same id " * 40, "b", "", "", ""), (61, "long " * 3000, "b", "", "", "")]
    rows += [rows[0], rows[0]]
    out = run(spark, rows, window=64, quantum=8).collect()
    sequences, docs = defaultdict(list), defaultdict(lambda: defaultdict(int))
    for r in out:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id][(r.start, r.length, ids.tobytes())] += 1
    for pieces in sequences.values():
        end = 0
        for offset, n in sorted(pieces):
            assert offset == end
            end += n
        assert end == 64 or end & (end - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(r.length for r in out) == sum(len(oracle(t)) for _, t, *_ in rows)
    joined = {d: b"".join(b for (_, _, b), n in sorted(p.items())) for d, p in docs.items()}
    assert joined[61] == np.array(oracle("long " * 3000), "<u4").tobytes()
    assert joined[60] == b"\0\0\0\0"
    assert joined[None] == np.array(oracle("null id"), "<u4").tobytes()


def test_every_window_keeps_the_proportions(spark):
    rows = [(i, "word " * (50 + i % 7), "big" if i % 3 else "small", "", "", "") for i in range(300)]
    out = run(spark, rows, window=256, quantum=16).collect()
    total, share = sum(r.length for r in out), defaultdict(int)
    window = defaultdict(lambda: defaultdict(int))
    for r in out:
        share[r.source] += r.length
        window[r.sequence_id][r.source] += r.length
    full = [w for w in window.values() if sum(w.values()) == 256]
    assert len(full) > 40
    for w in full:
        assert abs(w["small"] - 256 * share["small"] / total) <= 32
    assert out[0].ids


def test_digest_and_empty_table(spark):
    assert run(spark, []).count() == 0
    rows = packing.digest(run(spark, [(1, "a b c", "s", "", "", "")])).collect()
    ids = b"".join(r.ids for r in run(spark, [(1, "a b c", "s", "", "", "")]).orderBy("start").collect())
    if len(rows) == 1:
        assert rows[0].ids_crc32 == zlib.crc32(ids)
    assert sum(r.length for r in rows) == 4


def test_windows_hold_the_target_shares_as_long_as_sources_last(spark):
    rows = [(i, "word " * (40 + i % 9), ["a", "b", "c", None][i % 4], "", "", "") for i in range(400)]
    plain, mixed = run(spark, rows, window=256, quantum=16).collect(), run(spark, rows, window=256, quantum=16, shares={"a": 0.5, "b": 0.3, "c": 0.1, None: 0.1}).collect()
    assert sum(r.length for r in plain) == sum(r.length for r in mixed)
    docs = defaultdict(dict)
    for r in mixed:
        docs[r.doc_id][r.start] = bytes(r.ids)
    want = defaultdict(dict)
    for r in plain:
        want[r.doc_id][r.start] = bytes(r.ids)
    join = lambda d: {k: b"".join(v for _, v in sorted(p.items())) for k, p in d.items()}
    assert join(docs) == join(want)  # every token once, whatever the shares
    window, total = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for r in mixed:
        window[r.sequence_id][r.source] += r.length
        total[r.source] += r.length
    full = [w for _, w in sorted(window.items()) if sum(w.values()) == 256]
    lasts = int(total["a"] / 0.5 / 256) - 1  # source a has the largest share and runs out first
    assert lasts > 20
    taken = defaultdict(int)
    for k, w in enumerate(full[:lasts]):
        for s, share in {"a": 0.5, "b": 0.3, "c": 0.1, None: 0.1}.items():
            taken[s] += w[s]
            assert abs(w[s] - share * 256) <= 32
            assert abs(taken[s] - share * 256 * (k + 1)) <= 32  # deficits carry over, they do not add up
    after = full[lasts + 3]
    assert after["a"] == 0 and abs(after["b"] - 0.6 * 256) <= 32  # what it leaves goes to the others in their shares


def test_places_are_those_of_a_round_robin_with_deficits():
    rng = np.random.default_rng(5)
    for _ in range(20):
        totals, weights, quantum = rng.integers(0, 900, 4).astype(np.int64), rng.integers(1, 50, 4), int(rng.integers(1, 40))
        n, step = packing.steps(totals, quantum, weights)
        order = sorted((k * int(step[s]) + int(step[s]) // 2, s, k) for s in range(4) for k in range(n[s]))
        place, at = {}, 0
        for _, s, k in order:
            place[s, k] = at
            at += min(quantum, int(totals[s]) - k * quantum)
        keys = list(place)
        got = packing.places(np.array([s for s, _ in keys], np.int64), np.array([k for _, k in keys], np.int64), totals, quantum, weights) if keys else []
        assert list(got) == [place[k] for k in keys]
