import random
import re
import zlib
from collections import Counter

import pytest

from rillwork.llm import variants

SCHEMA = "doc_id long, text string, word string, n string, form string, root string, key string"


def edits_of_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(rows):
    n = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 7:
                n[w] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    out = {}
    for w in n:
        near = sorted((v for v in n if edits_of_one(w, v)), key=lambda v: (-n[v], v))
        form = near[0] if near and n[near[0]] >= 10 * n[w] else None
        out[w] = [form, w, n[w], len(near), n[form] if form else None]
    for w in n:
        while out[out[w][1]][0]:
            out[w][1] = out[out[w][1]][0]
    return {w: tuple(v) for w, v in out.items()}


def run(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA).repartition(4)
    out = variants.spelling_variants(docs, **more).collect()
    assert len({r.word for r in out}) == len(out)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out}


@pytest.mark.parametrize("crowd", [1000, 3])
def test_against_brute_force(spark, crowd):
    rng = random.Random(4)
    base = ["".join(rng.choice("abéÿ×") for _ in range(rng.randint(7, 11))) for _ in range(25)] + ["resource", "resources", "aaaaaaaa", "aaaaaaaaa", "aaaaaaa", "longerwordswithmanyletters"]
    rows = []
    for i in range(150):
        words = []
        for _ in range(40):
            w = rng.choice(base[:4] if rng.random() < 0.7 else base)
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abé") + w[k:], w[:k] + rng.choice("abé") + w[k + 1:]])
            words.append(w if rng.random() < 0.8 else w.upper())
        rows.append((i, " ".join(words)))
    rows += [(None, "Nothing nothing nothing nothinG"), (None, None), (1, ""), (2, "z" * 20000 + " " + "z" * 20000 + " " + "z" * 19999 + "." + "z" * 19999), (3, "日本語日本語日本語 naïveté_naïveté 1234567")]
    rows += [rows[0], rows[0]]
    want = brute(rows)
    assert run(spark, rows, crowd=crowd) == want
    assert any(v[0] for v in want.values()) and any(v[3] > 5 for v in want.values())


def test_chains_of_forms(spark):
    def some(w, n, start):  # ids whose checksum leaves the word as it is
        ids = (d for d in range(start, 10 ** 6) if zlib.crc32(f"{d}:{w}".encode()) % 31)
        return [(next(ids), w) for _ in range(n)]

    rows = some("abcdefg", 2, 0) + some("abcdefgh", 20, 0) + some("abcdefghi", 200, 0) + some("abcdefghij", 2000, 0)
    out = run(spark, rows)
    assert out == {"abcdefg": ("abcdefgh", "abcdefghij", 2, 1, 20), "abcdefgh": ("abcdefghi", "abcdefghij", 20, 2, 200),
                   "abcdefghi": ("abcdefghij", "abcdefghij", 200, 2, 2000), "abcdefghij": (None, "abcdefghij", 2000, 1, None)}


def test_an_open_part_with_many_words_is_chunked_on(spark):
    words = [f"prefix{a}{b}{c}suffixes" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh"]
    got = {r.word: r.k for r in variants.near_pairs(spark.createDataFrame([(w, 5) for w in words], "word string, n long"), crowd=20).groupBy("word").count().withColumnRenamed("count", "k").collect()}
    assert got == {w: 21 for w in words}


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [(1, None), (2, "short words")]) == {}
