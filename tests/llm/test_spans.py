import random
import re
import zlib

import numpy as np
import pytest

from rillwork.llm import spans

SCHEMA = "doc_id long, text string, h string, starts string, n_spans string"


def cut(text):
    """The rule word by word: a piece ends where a sentence ends and at the last smallest checksum of each eleven words of a sentence."""
    found = list(re.finditer(r"([^ \x09-\x0D]+)([ \x09-\x0D]*)", text or ""))
    words = [m[1].encode("utf-8", "surrogatepass") for m in found]
    ends = [w[-1:] in (b".", b"!", b"?") or "\n" in m[2] or i == len(found) - 1 for i, (w, m) in enumerate(zip(words, found))]
    marks = list(ends)
    for i in range(len(words) - 10):
        if not any(ends[i:i + 10]):
            marks[min(range(i, i + 11), key=lambda j: (zlib.crc32(words[j]), -j))] = True
    out, now = [], []
    for i, m in enumerate(found):
        now.append(m)
        if marks[i]:
            out.append(now)
            now = []
    return [(tuple(m[1] for m in p), text[p[0].start() if k else 0:p[-1].end()]) for k, p in enumerate(out)]


def brute(rows, run=3, min_words=12):
    """Literal reading over all runs of all documents."""
    seen, gone, parts = {}, {}, {}
    for d, t in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[0]):
        parts[d] = cut(t)
        for i in range(len(parts[d])):
            for j in range(i + run, len(parts[d]) + 1):
                key = tuple(p[0] for p in parts[d][i:j])
                if sum(map(len, key)) >= min_words:
                    if seen.setdefault(key, (d, i)) != (d, i):
                        gone.setdefault(d, set()).update(range(i, j))
                    break
    return {d: "".join(p[1] for i, p in enumerate(parts[d]) if i not in gone.get(d, ())) for d in parts}, gone


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def passage(seed, n=60):
    return " ".join(f"w{seed}x{i}" + ("." if i % 9 == 8 else "") for i in range(n))


def test_against_brute_force(spark):
    shared, long_one = passage(1), passage(2, 60).replace(".", "")
    rows = [(i, f"Start {i} of it all here.\n{shared}\nEnd {i} then more to come of it." if i % 3 else f"own {i} " * 30) for i in range(30)]
    rows += [(40, f"head 40\n{long_one}\ntail 40"), (41, f"other 41\n{long_one}\nrest 41"), (42, None), (43, ""), (44, " \n "), (45, "one"), (46, passage(3) + "\n" + passage(3)),
             (47, passage(4, 20000)), (48, "No. No. No. No. No."), (49, "No. No. No. No."), (50, "  \n" + passage(4, 30)), (51, "é ü. \x1c\x85 a\x0bb! 日本 " * 9), (52, " é ü. \x1c\x85 a\x0bb! 日本 " * 9)]
    rng = random.Random(1)
    rows += [(60 + i, "".join(rng.choice(["aa", "bb", "cc", "dd."]) + rng.choice([" ", " ", " ", "\n", "\t"]) for _ in range(rng.randint(0, 200)))) for i in range(30)]
    out = {r.doc_id: r for r in spans.drop_repeated(frame(spark, rows)).collect()}
    text, gone = brute(rows)
    assert len(out) == len(rows)
    for d, t in rows:
        assert out[d].text == (text[d] if t and t.strip() and gone.get(d) else t)
        assert out[d].n_removed == len(gone.get(d, ())) and out[d].n_sentences == len(cut(t))
        assert out[d].n_spans == sum(i - 1 not in gone[d] for i in gone[d]) if d in gone else out[d].n_spans == 0
    assert shared in out[1].text and "w1x5" not in out[2].text and "Start 2" in out[2].text
    assert "w2x5" in out[40].text and "w2x30" not in out[41].text and "rest 41" in out[41].text
    assert out[48].text == "No. No. No. No. No." and out[1].h == "a"


@pytest.mark.parametrize("n", [50, 64, 90])
def test_a_passage_without_marks_is_found_at_any_offset(spark, n):
    rng = random.Random(n)
    inside = " ".join(f"p{rng.randrange(10 ** 6)}" for _ in range(n))
    rows = [(i, " ".join(f"d{i}w{rng.randrange(10 ** 6)}" for _ in range(i)) + " " + inside + " " + " ".join(f"e{i}w{rng.randrange(10 ** 6)}" for _ in range(40))) for i in range(40)]
    out = {r.doc_id: r.text for r in spans.drop_repeated(frame(spark, rows)).collect()}
    assert out[0] == rows[0][1]
    found = [d for d in range(1, 40) if out[d] != rows[d][1]]
    assert len(found) >= (35 if n < 64 else 39)
    for d in found:
        left = sum(w in out[d].split() for w in inside.split())
        assert left <= (40 if n < 64 else 20)  # the piece at either edge may hold words of its surroundings
        assert sum(w.startswith(("d", "e")) for w in out[d].split()) >= d + 40 - 20


@pytest.mark.parametrize("each", [1, 3])
def test_short_sentences_are_taken_together(spark, each):
    rng = random.Random(each)
    words = [f"s{rng.randrange(10 ** 6)}" + ("!!" if i % each == each - 1 else "") for i in range(60 * each)]
    rows = [(1, "own words here at the start. " + " ".join(words)), (2, "others stand there instead. " + " ".join(words) + " and an end."), (3, "Yes. No. Yes. No. Yes."), (4, "Yes. No. Yes. No. Yes.")]
    out = {r.doc_id: r.text for r in spans.drop_repeated(frame(spark, rows)).collect()}
    assert out[1] == rows[0][1] and out[2] == "others stand there instead. and an end." and out[4] == rows[3][1]


def test_null_ids_repeats_and_empty(spark):
    shared = passage(5)
    out = spans.drop_repeated(frame(spark, [(None, shared), (None, shared), (1, shared), (1, shared), (2, shared)])).collect()
    assert sorted((r.doc_id or 0, bool(r.text)) for r in out) == [(0, True), (0, True), (1, True), (1, True), (2, False)]
    assert spans.drop_repeated(frame(spark, [])).count() == 0


def test_pieces_concatenate_to_the_text():
    for t in ["a b c ", " a.\n\n b! c? d", "x" * 5000, "a " * 100, "...", "a\x0bb\x1cc. d"]:
        data = t.encode()
        words, first, at = spans.pieces(data)
        edge = [*at.tolist(), len(data)]
        assert [data[a:b].decode() for a, b in zip(edge, edge[1:])] == [p[1] for p in cut(t)] and len(first) == len(at)
        assert np.all(np.diff(first) <= spans.WINDOW)
