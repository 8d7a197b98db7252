import tracemalloc

import numpy as np
import pytest

from rillwork.llm import minhash

SCHEMA = "doc_id long, text string, rep string, n string, h string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(400):
        a = rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64)
        b = a.copy() if rng.random() < 0.3 else rng.integers(0, 4, rng.integers(0, 25)).astype(np.uint64)
        for _ in range(rng.integers(0, 4)):
            if len(b):
                b = np.delete(b, rng.integers(len(b))) if rng.random() < 0.5 else np.insert(b, rng.integers(len(b)), 9)
        truth = levenshtein(a.tolist(), b.tolist())
        for most in (0, 1, 3, 8, 40):
            assert minhash.edit_distance(a, b, most) == min(truth, most + 1)


def test_labels_and_order():
    h = np.array([1, 2, 3, 1, 2, 3, 1, 2, 3], np.uint64)
    assert len(set(minhash.kmers(h, 2).tolist())) == 8  # repeats get labels of their own
    seeds = np.arange(1, 65, dtype=np.uint64)
    a = minhash.mix(np.arange(100, dtype=np.uint64))
    swapped = np.concatenate([a[50:], a[:50]])
    plain = (minhash.sketch(a, 1, 1, seeds) == minhash.sketch(swapped, 1, 1, seeds)).mean()
    ordered = (minhash.sketch(a, 1, 2, seeds) == minhash.sketch(swapped, 1, 2, seeds)).mean()
    assert plain == 1.0 and ordered < 0.75


def noisy(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = int(rng.integers(len(out)))
        kind = rng.integers(3)
        if kind == 0:
            out[at] = f"new{rng.integers(10**6)}"
        elif kind == 1:
            out.insert(at, f"ins{rng.integers(10**6)}")
        else:
            del out[at]
    return out


def corpus(seed=2):
    rng, rows = np.random.default_rng(seed), []
    passage = [f"shared{i}" for i in range(60)]
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(120, 400))]
        rows.append((base * 100, " ".join(words)))
        for c in range(int(rng.integers(0, 6))):
            rows.append((base * 100 + c + 1, " ".join(noisy(rng, words, int(len(words) * rng.choice([0, 0.01, 0.03, 0.5]))))))
    for i in range(30):  # unrelated texts around one passage
        rows.append((5000 + i, " ".join([f"a{x}" for x in rng.integers(0, 5000, 60)] + passage + [f"b{x}" for x in rng.integers(0, 5000, 60)])))
    return rows


def brute(rows):
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, t) in enumerate(rows):
        for e, u in rows[:i]:
            a, b = t.split(), u.split()
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and levenshtein(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return {d: root(d) for d, _ in rows}


def test_groups_against_brute_force(spark):
    rows = corpus()
    out = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    want = brute(rows)
    assert {d: r.group_id for d, r in out.items()} == want
    assert {d for d, r in out.items() if r.kept} == set(want.values())
    assert {r.doc_id: r.group_id for r in minhash.near_duplicates(frame(spark, rows), block=3).collect()} == want


def test_chains_meet_across_components(spark):
    rng = np.random.default_rng(8)
    words, rows = [f"c{i}" for i in range(300)], []
    for i in range(12):  # each text is near its neighbours only
        rows.append((i, " ".join(words)))
        words = noisy(rng, words, 12)
    assert {r.doc_id: r.group_id for r in minhash.near_duplicates(frame(spark, rows)).collect()} == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, None), (3, ""), (4, " \n"), (5, "one two"), (6, "one  two"), (7, "one three"), (None, "one two"), (None, None), (8, "x " * 20000), (9, "x " * 20000 + "y"), (10, "a b c d e f g"), (10, "a b c d e f g")]
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    group = {r.doc_id: r.group_id for r in out}
    assert [group[i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [1, 2, 3, 4, 5, 5, 7, 8, 8, 10]
    assert all(r.kept and r.group_id is None for r in out if r.doc_id is None)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_short_sketches(n):
    assert len(minhash.sketch(np.arange(n, dtype=np.uint64), 5, 2, np.arange(1, 9, dtype=np.uint64))) == 8


@pytest.mark.parametrize("share", [0.05, 0.1, 0.15, 0.2])
def test_recall_against_brute_force(spark, share):
    rng, rows, cell = np.random.default_rng(11), [], {}
    for n in (10, 20, 50, 100, 125, 300):
        for c in range(20):
            words = [f"p{x}" for x in rng.integers(0, 10**7, n)]
            other = list(words)
            for at in rng.choice(n, int(n * share + 1e-9), replace=False):
                other[at] = f"q{rng.integers(10**7)}"
            cell[len(rows)] = n
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
            assert levenshtein(words, other) <= 0.2 * n + 1e-9
    group = {r.doc_id: r.group_id for r in minhash.near_duplicates(frame(spark, rows)).collect()}
    assert all(group[a] == a for a in cell)  # each pair has words of its own
    found = {n: sum(group[a + 1] == a for a, m in cell.items() if m == n) for n in set(cell.values())}
    assert min(found.values()) >= 19 and sum(found.values()) >= 0.98 * len(cell), found


def test_both_alignments_agree(monkeypatch):
    rng = np.random.default_rng(12)
    for _ in range(60):
        a = rng.integers(0, 300, int(rng.integers(50, 400))).astype(np.uint64)
        b = a.copy()
        for _ in range(int(rng.integers(0, 90))):
            at = int(rng.integers(len(b)))
            b = [np.delete(b, at), np.insert(b, at, 999), np.concatenate([b[:at], [np.uint64(7)], b[at + 1:]])][rng.integers(3)].astype(np.uint64)
        most = int(rng.integers(1, 100))
        whole = minhash.edit_distance(a, b, most)
        with monkeypatch.context() as m:
            m.setattr(minhash, "BITWISE", 0)
            assert minhash.edit_distance(a, b, most) == whole


def test_sketches_are_hashed_in_small_parts():
    seeds = minhash.mix(np.arange(1, 49, dtype=np.uint64))
    words = minhash.mix(np.arange(40_000, dtype=np.uint64))
    tracemalloc.start()
    got = minhash.sketch(words, 3, 2, seeds)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    assert (got == np.concatenate([minhash.sketch(words, 3, 2, seeds[k:k + 1]) for k in range(48)])).all()
