import numpy as np

from rillwork.llm import toxicity

DOCS = "doc_id long, text string, lang string, score string, i string, y string"
LABELS = "doc_id long, toxic int, t string"


def corpus(n=600):
    rng = np.random.default_rng(4)
    rows, marks = [], []
    for i in range(n):
        words = [f"w{a}" for a in rng.choice(list("abcdefghijklmnop"), 40)]
        bad = i % 4 == 0
        if bad:
            words[int(rng.integers(40))] = ["grukk!", "SNARB"][i % 8 == 0]
        rows.append((i, " ".join(words), "de" if i % 3 else "en"))
        marks.append((i, int(bad)))
    return rows, marks


def frames(spark, rows, marks):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], DOCS), spark.createDataFrame([(*m, "x") for m in marks], LABELS)


def test_held_out_documents(spark):
    rows, marks = corpus()
    docs, labels = frames(spark, rows, marks + [(3, None), (None, 1), (7000, 1)])
    held = toxicity.fold(toxicity.F.col("doc_id"), 3) == 1
    net = toxicity.fit(docs, labels, ~held)
    out = {r.doc_id: (r.score, r.held_out) for r in toxicity.score(docs, net).withColumn("held_out", held).collect()}
    unseen = [(out[i][0] >= 0.7, bool(y)) for i, y in marks if out[i][1]]
    assert len(unseen) > 150 and sum(a == b for a, b in unseen) >= 0.97 * len(unseen)
    odd, _ = frames(spark, [(1, None, None), (2, "", "en"), (None, "grukk", None), (3, "wa " * 400000 + "grukk", "en"), (3, "!! 12", None)], [])
    got = [(r.doc_id, r.score) for r in toxicity.score(odd, net).collect()]
    assert len(got) == 5 and all(0 <= s <= 1 for _, s in got)
    assert max(s for i, s in got if i == 3) >= 0.7 and next(s for i, s in got if i is None) >= 0.7 and next(s for i, s in got if i == 1) < 0.7


def test_scores_ignore_language_and_order():
    rows, marks = corpus(200)
    net = toxicity.ConvNet().fit([t for _, t, _ in rows], np.array([y for _, y in marks]), np.ones(200), epochs=1)
    net.learn_languages([t for _, t, _ in rows], [s for _, _, s in rows])
    texts = [t for _, t, _ in rows[:20]]
    assert np.allclose(net.scores(texts), net.scores(texts[::-1])[::-1])


def test_no_labels(spark):
    docs, labels = frames(spark, [(1, "a", "en")], [])
    assert toxicity.fit(docs, labels, toxicity.F.lit(True)) is None
    assert toxicity.score(docs, None).first().score == 0.0
    empty, _ = frames(spark, [], [])
    assert toxicity.score(empty, None).count() == 0


def test_every_labelled_document_is_learned_from(spark, monkeypatch):
    """A class larger than any bucket: each of its documents counts, in several buckets, and a rerun gives the same net."""
    monkeypatch.setattr(toxicity, "BUCKET", 100)
    rows, marks = corpus(800)
    docs, labels = frames(spark, rows, marks)
    known = labels.selectExpr("doc_id AS i", "toxic AS y")
    cut = toxicity.known_texts(docs.selectExpr("doc_id AS i", "text AS t", "lang AS s"), known, 8, True)
    seen, total, langs = toxicity.slot_counts(cut)
    back = [toxicity.hash_fifth(i) for i, _ in marks]
    assert total.tolist() == [sum(y == k and not b for (_, y), b in zip(marks, back)) for k in (0, 1)]
    assert sum(v.sum() for v in langs.values()) == 800 * 40
    bad = toxicity.text_slots("grukk snarb")
    assert seen[0, 1, bad[0]].sum() == total[1] and seen[0, 0, bad[0]].sum() == 0
    one, two = (toxicity.fit(docs, labels, toxicity.F.lit(True)) for _ in range(2))
    assert np.array_equal(one.tables[0], two.tables[0]) and one.threshold == two.threshold
    cells = toxicity.calibration_cells(cut, one)
    assert cells["n"].sum() == sum(back) and cells["hits"].sum() == sum(y for (_, y), b in zip(marks, back) if b)
    scores = one.scores([t for _, t, _ in rows])
    assert ((scores >= 0.7) == np.array([y for _, y in marks])).mean() >= 0.97
