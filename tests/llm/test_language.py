import itertools

import numpy as np

from rillwork.llm import language, letters

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score string, i string"
SAMPLE = {"en": "the and of with this that from there which people", "de": "und der nicht eine schön über wird auch straße", "fr": "les des être avec où leur même très pour"}


def corpus(n=240):
    rng = np.random.default_rng(1)
    return [(i, ". ".join(" ".join(rng.choice(SAMPLE[s].split(), 7)) for _ in range(4)), s) for i in range(n) for s in [sorted(SAMPLE)[i % 3]]]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(2)
    emit, move = rng.normal(size=(4, 3)), rng.normal(size=(3, 3))
    total, marginal, joint = 0.0, np.zeros((4, 3)), np.zeros((3, 3))
    for path in itertools.product(range(3), repeat=4):
        p = np.exp(sum(emit[t, s] for t, s in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:])))
        total += p
        for t, s in enumerate(path):
            marginal[t, s] += p
        for a, b in zip(path, path[1:]):
            joint[a, b] += p
    other = rng.normal(size=(2, 3))  # a second, shorter chain in the same call
    got, pairs = language.forward_backward(np.concatenate([other, emit]), move, np.array([0, 2]), np.array([2, 4]), pairs=True)
    _, short = language.forward_backward(other, move, np.array([0]), np.array([2]), pairs=True)
    assert np.allclose(got[2:], marginal / total) and np.allclose(pairs - short, joint / total)


def test_words_and_hashes():
    w = letters.scan([(0, "Abc déf. ghi"), (5, "abc\nDÉF!! 12 x")])
    data = w.data.tobytes()
    assert [data[s:e].decode() for s, e in zip(w.start, w.end)] == ["abc", "déf", "ghi", "abc", "déf", "x"]
    assert w.text.tolist() == [0, 0, 0, 5, 5, 5] and w.opens.tolist() == [True, False, True, True, True, True]
    h = w.hashes()
    assert h[0] == h[3] and h[1] == h[4] and len(set(h.tolist())) == 4


def test_held_out_documents_and_switches(spark):
    rows = corpus()
    extra = [(900, None, "en"), (901, "", "en"), (902, "12 — !!", "de"), (None, "der und nicht eine", None), (903, "the of people " * 30000, None), (903, "über wird auch", "de")]
    docs = frame(spark, rows + extra)
    held = letters.fold(language.F.col("doc_id"), 5) == 0
    tagger = language.fit(docs, ~held, per_language=60)
    assert tagger.labels == ["de", "en", "fr"]
    assert all(tagger.transition[k, k] > tagger.transition[k].sum() - tagger.transition[k, k] for k in range(3))
    out = language.identify(docs, tagger).collect()
    assert len(out) == len(rows) + len(extra)
    truth = {i: s for i, _, s in rows}
    known = [r for r in out if r.doc_id in truth]
    assert all(r.lang_pred == truth[r.doc_id] for r in known) and all(0 <= r.score <= 1 + 1e-9 for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.lang_pred)
    assert by[900] == by[901] == by[902] == ["und"] and by[None] == ["de"] and sorted(by[903]) == ["de", "en"]
    tags = tagger.words("the people of this nicht eine schön straße")
    assert [t for _, t, _ in tags] == ["en"] * 4 + ["de"] * 4


def test_nothing_to_learn(spark):
    empty = frame(spark, [])
    tagger = language.fit(empty, language.F.lit(True))
    assert language.identify(empty, tagger).count() == 0
    assert language.identify(frame(spark, [(1, "hello", None)]), tagger).first().lang_pred == "und"
