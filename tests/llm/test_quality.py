import re
from collections import Counter

import numpy as np
import pytest

from rillwork.llm import quality
from rillwork.session import scratch_path

SCHEMA = "doc_id long, text string, lang string, median string, k string, kept string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)]


TEXTS = ["", "a b c a b c", "é é\né é\n\n \n é é", "x#*$%&|<> x", "\x1c a\x85b　c", "one two three\none two three\none two", "😀 a " * 30, "a\r\nb\r\nb\r\nb", "w " * 5000, "\t\n ", "a b", "the end"]


def test_base_counts():
    got = quality.base_counts([t.encode() for t in TEXTS])
    assert got.tolist() == [brute(t) for t in TEXTS]


def model_by_hand(texts):
    """The same model with plain dictionaries: a function from an n-gram to its probability."""
    order, df, kinds_of = quality.ORDER, Counter(), {}
    for t in texts:
        c = (32,) * (order - 1) + tuple(quality.folded(t).tolist())
        df.update({c[i:i + order] for i in range(len(c) - order + 1)})
        for g in {c[i:i + order] for i in range(len(c) - order + 1)}:
            kinds_of.setdefault(g, set()).add(t)
    count = {order: {g: n for g, n in df.items() if len(kinds_of[g]) > 1}}
    for n in range(order - 1, 0, -1):
        count[n] = Counter(g[1:] for g in count[n + 1])
    every = {g[-1:] for g in df}
    cut, after = {}, {}
    for n, grams in count.items():
        kinds = Counter(grams.values())
        y = kinds[1] / max(1, kinds[1] + 2 * kinds[2])
        d = [k + 1 - (k + 2) * y * kinds[k + 2] / kinds[k + 1] if kinds[k + 1] else 0.5 for k in range(3)]
        cut[n] = [0, *(x if 0 < x < k + 1 else 0.5 for k, x in enumerate(d))]
        after[n] = {}
        for g, c in grams.items():
            s = after[n].setdefault(g[:-1], [0, 0.0])
            s[0] += c
            s[1] += cut[n][min(c, 3)]

    def p(g):
        if not g:
            return 1 / (1 + len(every))
        n, low = len(g), p(g[1:])
        if g[:-1] not in after[n]:
            return low
        total, free = after[n][g[:-1]]
        c = count[n].get(g, 0)
        return (c - cut[n][min(c, 3)]) / total + free / total * low

    return df, every, p


def test_model_equals_the_formula(spark, monkeypatch):
    monkeypatch.setattr(quality, "RANGE", 20)
    texts = ["the cat sat on the mat. the cat ran.", "the cat and a dog 12 %%", "Été à la mer, à la mer", "THE CAT\tsat 7", "日本語の日本語 \U0001F600", "日本語の本", None, "", "the cat sat on the mat. the cat ran."]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    df, every, p = model_by_hand([t for t in texts if t])
    seen = {(r["hi"], r["lo"]): r["n"] for r in quality.count_grams(docs).collect()}
    pack = lambda g: (g[0] << 21 | g[1], g[2] << 42 | g[3] << 21 | g[4])
    assert seen == {pack(g): n for g, n in df.items()}
    model = quality.kneser_ney(quality.count_grams(docs))
    got = {(r["hi"], r["lo"]): r["p"] for r in model.collect()}
    assert got == {pack(g): pytest.approx(p(g)) for g in df}
    known = [g[:-1] for g, n in df.items() if n > 1][::7]
    for context in [(32, 32, 32, 32), *known]:
        assert sum(p((*context, *c)) for c in every) <= 1 + 1e-9
    bits, index = quality.write_model(model, scratch_path(spark, "model-test"))
    assert bits > 0 and len(index) > 1 and sum(n for _, _, n in index) == len(df)
    found = quality.Model(bits, index)
    hi, lo = (np.array(x, np.int64) for x in zip(*map(pack, df)))
    assert found.log_p(hi, lo) == pytest.approx([np.log(p(g)) for g in df], rel=1e-6)
    assert np.isnan(found.log_p(np.array([5]), np.array([6]))).all()
    rows = docs.selectExpr("text", "monotonically_increasing_id() AS id")
    out = {r.id: r for r in quality.measure(rows, bits, index).collect()}
    for r in rows.collect():
        c = (32,) * 4 + tuple(quality.folded(r.text or "").tolist())
        want = [-np.log(p(c[i:i + 5])) for i in range(len(c) - 4)]
        assert out[r.id].n_chars == len(want) and out[r.id].entropy == pytest.approx(np.mean(want) if want else 0, rel=1e-5)


def test_long_texts_are_scored_whole(spark, monkeypatch):
    rng, rows = np.random.default_rng(1), []
    for i in range(6):
        rows.append((i, prose(rng, "etaoinsh", 900), "en"))
    docs = frame(spark, rows)
    whole = {r.doc_id: r for r in quality.judge(docs).collect()}
    counted = {(r.hi, r.lo): r.n for r in quality.count_grams(docs).collect()}
    blocks = quality.text_blocks
    monkeypatch.setattr(quality, "text_blocks", lambda texts: blocks(texts, 1000))
    assert {(r.hi, r.lo): r.n for r in quality.count_grams(docs).collect()} == counted
    for r in quality.judge(docs).collect():
        assert (r.perplexity, r.kept) == (pytest.approx(whole[r.doc_id].perplexity), whole[r.doc_id].kept)


def test_letters_of_a_foreign_script_are_rejected(spark):
    rng = np.random.default_rng(3)
    rows = [(i, prose(rng, "etaoinsh", 120), "en") for i in range(80)]
    odd = [(900 + i, prose(rng, [chr(c) for c in range(start, start + 30)], 120), "en") for i, start in enumerate((0x430, 0x3B1, 0x5D0, 0x4E00))]
    out = {r.doc_id: r for r in quality.judge(frame(spark, rows + odd)).collect()}
    assert all(out[i].kept for i, _, _ in rows) and not any(out[i].kept or out[i].base_failed for i, _, _ in odd)


def prose(rng, letters, n=200):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 6))) for _ in range(n)) + "."


def test_limits_reject_odd_texts_and_keep_clean_ones(spark):
    rng = np.random.default_rng(6)
    rows = [(i, prose(rng, "etaoinsh" if i % 2 else "uvwxyzab"), "en" if i % 2 else "xx") for i in range(160)]
    odd = [(900, " ".join("%#" + w + "$|" for w in prose(rng, "etaoinsh", 600).split()), "en"), (901, prose(rng, "qjkz", 600), "en")]
    bad = [(902, None, "en"), (903, "", None), (904, "few words", "en"), (905, "same three words " * 60, "en"), (None, prose(rng, "etaoinsh"), "en"), (906, prose(rng, "etaoinsh"), None), rows[1]]
    out = quality.judge(frame(spark, rows + odd + bad)).collect()
    assert len(out) == len(rows) + len(odd) + len(bad)
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[i] for i, _, _ in rows) and not any(kept[i] for i in (900, 901, 902, 903, 904, 905)) and kept[None]
    failed = {r.doc_id: r.base_failed for r in out}
    assert not failed[900] and not failed[901] and failed[905] and failed[902]
    text = {i: t for i, t, _ in rows + odd + bad}
    assert all([r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == brute(text[r.doc_id]) for r in out)
    assert quality.judge(frame(spark, [])).count() == 0
    assert [r.kept for r in quality.judge(frame(spark, [(1, None, None)])).collect()] == [False]


def test_small_languages_and_unlabelled_texts_stay(spark):
    rng = np.random.default_rng(7)
    rows = [(i, prose(rng, "etaoinsh", int(rng.integers(100, 400))), "en") for i in range(300)]
    rows += [(1000 + i, prose(rng, "uvwxyzab", int(rng.integers(100, 400))), "xx") for i in range(12)]
    rows += [(2000, prose(rng, "cdfgklmp", 300), "yy"), (2001, prose(rng, "cdfgklmp", 100), "yy"), (2002, prose(rng, "rmdlcupg", 200), "zz")]
    rows += [(3000 + i, prose(rng, ["etaoinsh", "uvwxyzab"][i % 2], 200), [None, ""][i // 2]) for i in range(4)]
    odd = (900, " ".join("%#" + w + "$|" for w in prose(rng, "etaoinsh", 600).split()), "en")
    out = {r.doc_id: r for r in quality.judge(frame(spark, [*rows, odd])).collect()}
    assert [i for i, _, _ in rows if not out[i].kept] == [] and not out[900].kept and not out[900].base_failed
    assert out[2002].high - out[2002].low > out[0].high - out[0].low
