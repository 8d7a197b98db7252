from collections import defaultdict

import pytest

from rillwork.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, code string, p string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA)


def water_fill(sizes, weights=(3, 1, 2), share=1.5, ceiling=2.0):
    """Literal reading: divide by weight, cut what is above, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    got, left, free = dict.fromkeys(names, 0.0), share * sum(sizes.values()), set(names)
    while left > 1e-6 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            got[s] += left * weight[s] / total
        left = 0.0
        for s in list(free):
            if got[s] >= ceiling * sizes[s]:
                left += got[s] - ceiling * sizes[s]
                got[s] = ceiling * sizes[s]
                free.discard(s)
    return got


def test_targets_and_totals(spark):
    rows = []
    for i in range(3000):
        rows.append((i, "w " * (1 + i * 7919 % 311), ["a", "b", "b", "c", "hot", "hot", "hot", "é", None][i % 9]))
    rows += [(None, "null id", "a"), (9000, None, "b"), (9001, " \t\n", "c"), (9002, "", "empty"), (9003, "x " * 20000, "a"), rows[3], rows[3], rows[3]]
    out = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken == r.copies * r.size <= 2 * r.size
    goal = water_fill(sizes)
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(goal[r.source])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= (20000 if s == "a" else 311)
    again = mixing.mix_sources(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_rounds_reach_one_block(spark):
    docs = frame(spark, [(i, "w " * (i % 50), "s" if i % 4 else "t") for i in range(2000)])
    sizes = docs.selectExpr("doc_id", "size(split(text, ' ')) - 1L AS size", "source", "0.4D AS p").withColumn("size", mixing.F.col("size").cast("long"))
    out = mixing.sample(sizes, block=16).collect()
    assert len(out) == 2000 and {r.p for r in out} == {0.0, 1.0}
    for s in "st":
        mine = [r for r in out if r.source == s]
        assert abs(sum(r.p for r in mine) - 0.4 * len(mine)) <= 1
        assert abs(sum(r.p * r.size for r in mine) - 0.4 * sum(r.size for r in mine)) <= 60


def test_flight_keeps_sums():
    sizes, p = [5.0, 5.0, 5.0, 5.0, 0.0, 9.0, 1e6], [0.5] * 7
    mixing.flight(sizes, p)
    assert sum(p) == pytest.approx(3.5) and sum(a * b for a, b in zip(p, sizes)) == pytest.approx(0.5 * sum(sizes))
    assert sum(0 < x < 1 for x in p) <= 2


def test_empty_and_wordless(spark):
    assert mixing.mix_sources(frame(spark, [])).count() == 0
    out = mixing.mix_sources(frame(spark, [(1, None, "a"), (2, "", "b")])).collect()
    assert {(r.target, r.taken) for r in out} == {(0.0, 0)}
