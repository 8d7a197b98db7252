from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
import public_tokenizers
import test_minhash
import test_mixing
import test_quality
import test_spans

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng, rows = np.random.default_rng(9), []
    shared = "\n".join(" ".join("".join(rng.choice(list("etaoinsh"), 4)) for _ in range(12)) + "." for _ in range(6))
    for i in range(90):
        text = "\n".join(" ".join("".join(rng.choice(list("etaoinsh"), 4)) for _ in range(11)) + "." for _ in range(int(rng.integers(9, 16))))
        rows.append([i, text + ("\n" + shared if i % 9 == 0 else ""), "en", ["a", "b", "c", None][i % 4]])
    for i in range(90, 110):
        words = rows[i - 90][1].split(" ")
        words[int(rng.integers(len(words)))] = "tahosnei"
        rows.append([i, " ".join(words), "en", "b"])
    rows += [[200, None, "en", "a"], [201, "too short", "en", "a"], [202, "again and again " * 50, "en", "c"], [203, "%# $& " * 400, "en", "c"], [204, rows[5][1], None, None]]
    return [(*r, len(r[1] or "")) for r in rows]


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.createDataFrame(corpus(), SCHEMA), []
    for _, function in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(function(spark, docs, ""), "test")
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_return_the_columns_of_documents(results):
    assert all(df.columns == ["doc_id", "text", "lang", "source", "n_chars"] for df in results[:-1])


def test_quality_goes_first(results):
    base = {d for d, t, *_ in corpus() if (lambda c: c[0] >= 50 and 100 * c[4] <= 50 * c[0])(test_quality.brute(t))}
    kept = set(ids(results[0]))
    assert kept <= base and base - kept <= {203} and {200, 201, 202} & kept == set()


def test_one_of_each_group_stays(results):
    rows = [(r.doc_id, r.text) for r in results[0].collect()]
    assert ids(results[1]) == sorted(set(test_minhash.brute(rows).values()))


def test_repeated_sentences_go(results):
    rows = [(r.doc_id, r.text) for r in results[1].collect()]
    want, gone = test_spans.brute(rows)
    got = {r.doc_id: (r.text, r.n_chars) for r in results[2].collect()}
    assert got == {d: (want[d] if d in gone else t, len(want[d] if d in gone else t)) for d, t in rows} and gone


def test_mix_meets_the_targets(results):
    size, taken = Counter(), Counter()
    for r in results[2].collect():
        size[r.source] += len(r.text.split())
    for r in results[3].collect():
        taken[r.source] += len(r.text.split())
    goal = test_mixing.water_fill(size)
    assert all(abs(taken[s] - goal[s]) <= 250 for s in size)
    assert max(Counter(ids(results[3])).values()) <= 2


def test_packing_holds_every_token(results):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum((len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in results[3].collect()), 0)
    pieces = results[4].collect()
    assert sum(r.length for r in pieces) == want == sum(len(r.ids) // 4 for r in pieces)


def test_run(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0


def test_mix_draws_rows_that_share_an_id_or_have_none(spark):
    rng, rows = np.random.default_rng(10), []
    for i in range(1200):  # a third without an id, a third with one of five ids
        n = int(rng.integers(50, 90))
        rows.append(([None, i % 5, 1000 + i][i % 3], " ".join(f"r{i}w{k}" for k in range(n)), "en", ["a", "b", "c", "c", "c", "c"][int(rng.integers(6))], 0))
    docs = spark.createDataFrame(rows, SCHEMA)
    got, size, taken = corpus_pipeline.source_mix(spark, docs, "").collect(), Counter(), Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(t.split())
    for r in got:
        taken[r.source] += len(r.text.split())
    goal = test_mixing.water_fill(size)
    assert all(abs(taken[s] - goal[s]) <= 250 for s in size), (taken, goal)
    copies = Counter(r.text for r in got)
    assert all(copies[t] in (int(goal[s] / size[s]), int(goal[s] / size[s]) + 1) for _, t, _, s, _ in rows if goal[s] / size[s] % 1)


def test_columns_that_clash_and_empty_tables(spark):
    names = ["copies", "copy", "n_removed", "n_spans", "n_sentences", "kept", "starts", "size", "gone", "h", "entropy"]
    schema = SCHEMA + "".join(f", {c} string" for c in names)
    rows = [(*r[:5], *(f"{c}{r[0]}" for c in names)) for r in corpus()[:60]]
    docs = spark.createDataFrame(rows, schema)
    extra = {r[0]: r[5:] for r in rows}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, docs, "")
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(tuple(r)[5:] == extra[r.doc_id] for r in got), name
        assert function(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.pack_sequences(spark, docs, "").count() > 0 and corpus_pipeline.pack_sequences(spark, docs.limit(0), "").count() == 0


def test_near_dedup_leaves_only_links(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("rillwork.session.scratch_dir", lambda s: str(tmp_path))
    docs = spark.createDataFrame(corpus(), SCHEMA)
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert {p.name.rsplit("-", 1)[0] for p in (tmp_path / "rillwork").iterdir()} == {"near-links", "links"}
    assert 204 not in ids(kept) and kept.count() < docs.count()
