import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rillwork.llm import divergence

SCHEMA = "text string, lang string, source string, term string, n string, v string, block string, tile string"


def brute(rows, least_docs=3, top=200):
    df, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        terms = [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        df[lang or ""].update(set(terms))
        count[lang or "", source or ""].update(terms)
        groups.add((lang or "", source or ""))
    out = set()
    for lang, source in groups:
        kept = [t for t, k in df[lang].items() if k >= least_docs]
        mine = {s: {t: count[l, s][t] for t in kept} for l, s in groups if l == lang}
        language = {t: sum(c[t] for c in mine.values()) for t in kept}

        def p(c):
            n = sum(c.values())
            return {t: 1 + 10 ** 9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        a, q = p(mine[source]), p(language)
        pairs = [(s, sum((a[t] - b) ** 2 // b for t, b in p(c).items())) for s, c in mine.items() if s != source]
        terms = [(t, (a[t] - q[t]) ** 2 // q[t]) for t in kept if mine[source][t] and a[t] > q[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out |= {(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(items) if part == "pair" or k < top}
    return out


def rows_of(seed, docs, sources):
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)] + ["Éa", "éa", "日本", "ÿ", "It's"]
    rows = []
    for _ in range(docs):
        lang, s = rng.choice(["en", "en", "fr", None, ""]), rng.randrange(sources)
        rows.append((" ".join(words[min(int(rng.expovariate(0.05)) + s * 2, len(words) - 1)] for _ in range(rng.randint(0, 60))), lang, f"s{s}" if s else None))
    return rows + [(None, "en", "void"), ("", "zz", "a"), ("only here", "zz", "b"), ("x " * 50000, "en", "s1"), rows[0], rows[0], ("Once\x00upon[a{time", "fr", "s1")]


@pytest.mark.parametrize("more", [{}, {"tile": 2, "cells": 40}, {"top": 3, "cells": 100}])
def test_against_brute_force(spark, more):
    rows = rows_of(5, 150, 7)
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA).repartition(3)
    out = [tuple(r) for r in divergence.divergence(docs, **more).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(out) == len(set(out)) and set(out) == brute(rows, top=more.get("top", 200))


def test_equal_subtrees_are_one_node():
    counts = np.array([[1, 2] * 8 + [0] * 16, [0] * 16 + [1, 2] * 8, [0] * 32])
    values, levels, roots = divergence.grow(counts)
    assert values.tolist() == [0, 1, 2] and [len(level[0]) for level in levels] == [2, 2, 2, 2, 3]
    pair, a, b, times = divergence.descend(levels, 4, roots[[0, 0]], roots[[1, 2]])
    assert sorted(zip(pair.tolist(), values[a - 1].tolist(), values[b - 1].tolist(), times.tolist())) == [
        (0, 0, 1, 8), (0, 0, 2, 8), (0, 1, 0, 8), (0, 2, 0, 8), (1, 0, 0, 16), (1, 1, 0, 8), (1, 2, 0, 8)]


def test_padding_is_not_priced():
    values, levels, roots = divergence.grow(np.array([[4, 0, 5], [0, 0, 5]]))
    assert sorted(divergence.descend(levels, 4, roots[:1], roots[1:])[3].tolist()) == [1, 1, 1]


def test_prices_are_exact_for_any_count():
    big = 10 ** 13 + 7
    assert divergence.prices(np.array([big]), 3 * big, 11)[0] == 1 + 10 ** 9 * (big + 1) // (3 * big + 11)


def test_empty(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    assert divergence.divergence(spark.createDataFrame([(None,) * 8], SCHEMA)).count() == 0
