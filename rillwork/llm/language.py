"""Language of every word by a linear-chain conditional random field.

Words are the chain, languages its labels. A word's score for a language is the sum of learned weights of its byte
n-grams (with word edges), its affixes and its entry in the hashed lexicon; learned transitions join neighbours, and
forward-backward gives each word's probabilities. Documents are labelled by the sum over their words. To learn when
languages switch, training chains also join sentences of different documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import back, mix, table, whole
from rillwork.llm.letters import Words, blocks, first_per_class, fold

BITS = 18
CHAIN = 64  # longest chain; a longer sentence is several


def _slot(x: np.ndarray, kind: int) -> np.ndarray:
    return (mix(x * np.uint64(16) + np.uint64(kind)) & np.uint64((1 << BITS) - 1)).astype(np.int64)


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram slots of all word bytes, index of each word's first n-gram, slots of affixes and lexicon as words x 5)."""
    inside = np.zeros(len(w.data) + 1, np.int8)
    inside[w.start] += 1
    inside[w.end] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    d = w.data.astype(np.uint64)
    d[~np.cumsum(inside[:-1]).astype(bool)] = 32
    grams = _slot((d[at - 1] << np.uint64(16)) | (d[at] << np.uint64(8)) | d[at + 1], 1)
    size = w.end - w.start
    first = np.cumsum(size) - size
    pad = np.concatenate([d, np.full(4, 32, np.uint64)])
    pre = np.zeros((2, len(w.start)), np.uint64)
    for k, width in enumerate((2, 4)):
        for j in range(width):
            pre[k] = (pre[k] << np.uint64(8)) | np.where(j < size, pad[w.start + j], 32).astype(np.uint64)
    post = np.zeros((2, len(w.start)), np.uint64)
    for k, width in enumerate((2, 4)):
        for j in range(width):
            post[k] = (post[k] << np.uint64(8)) | np.where(j < size, pad[np.maximum(w.end - 1 - j, 0)], 32).astype(np.uint64)
    own = np.stack([_slot(pre[0], 2), _slot(pre[1], 3), _slot(post[0], 4), _slot(post[1], 5), _slot(w.hashes(), 6)], axis=1)
    return grams, first, own


def emissions(weights: np.ndarray, f: tuple) -> np.ndarray:
    grams, first, own = f
    out = np.add.reduceat(weights[grams], first, axis=0)
    for k in range(own.shape[1]):
        out += weights[own[:, k]]
    return out


def chains(opens: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word, length) of every chain: sentences of one text, of at most CHAIN words."""
    n = len(opens)
    new = opens.copy()
    new[1:] |= text[1:] != text[:-1]
    heads = np.flatnonzero(new)
    place = np.arange(n) - np.repeat(heads, np.diff(np.append(heads, n)))
    heads = np.flatnonzero(place % CHAIN == 0)
    return heads, np.diff(np.append(heads, n))


def forward_backward(emit: np.ndarray, transition: np.ndarray, heads: np.ndarray, lengths: np.ndarray, pairs: bool = False):
    """Probabilities of every word's labels and, if asked for, the expected number of every label pair. All chains advance at once."""
    order = np.argsort(-lengths, kind="stable")
    heads, lengths = heads[order], lengths[order]
    e = np.exp(emit - emit.max(axis=1, keepdims=True)).astype(np.float64)
    step = np.exp(transition)
    ahead, behind = np.empty_like(e), np.ones_like(e)
    longest = int(lengths[0])
    active = [int(np.searchsorted(-lengths, -t, "left")) for t in range(longest)]  # chains with more than t words
    for t in range(longest):
        at = heads[:active[t]] + t
        a = e[at] if t == 0 else (ahead[at - 1] @ step) * e[at]
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        at = heads[:active[t + 1]] + t
        b = (behind[at + 1] * e[at + 1]) @ step.T
        behind[at] = b / b.sum(axis=1, keepdims=True)
    both = ahead * behind
    both /= both.sum(axis=1, keepdims=True)
    if not pairs:
        return both, None
    inner = np.ones(len(e), bool)
    inner[heads + lengths - 1] = False
    at = np.flatnonzero(inner)
    joint = ahead[at][:, :, None] * step[None] * (behind[at + 1] * e[at + 1])[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return both, joint.sum(axis=0)


class Tagger:
    """Weights of the features (slots x labels) and transitions (labels x labels)."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((1 << BITS, len(labels)), np.float32)
        self.transition = np.zeros((len(labels), len(labels)))

    def fit(self, texts: list[str], langs: list[str], sentences: int, epochs: int, seed: int = 5) -> Tagger:
        """Adagrad on the conditional likelihood of chains from at most ``sentences`` evenly spaced sentences of each text."""
        rng, number = np.random.default_rng(seed), {s: k for k, s in enumerate(self.labels)}
        sampled = []  # (text of one sentence, label)
        for t, s in zip(texts, langs):
            own = [x for x in t.replace("!", ".").replace("?", ".").replace("\n", ".").split(".") if x.strip()]
            keep = own if len(own) <= sentences else [own[int(i)] for i in np.linspace(0, len(own) - 1, sentences)]
            sampled += [(" ".join(x.split()[:CHAIN]), number[s]) for x in keep]
        squares, moved = np.full_like(self.weights, 1e-3), np.full_like(self.transition, 1e-3)
        for _ in range(epochs):
            rng.shuffle(sampled)
            for lo in range(0, len(sampled), 512):
                part = sampled[lo:lo + 512]
                w = next(iter(blocks([x for x, _ in part], 1 << 60)), None)
                if w is None or not len(w.start):
                    continue
                truth = np.array([y for _, y in part])[w.text]
                heads = np.flatnonzero(np.concatenate([[True], w.text[1:] != w.text[:-1]]))
                # half of the sentences go on in the next one: the chain switches language as mixed texts do
                keep = rng.random(len(heads)) < 0.5
                keep[0] = True
                heads = heads[keep]
                lengths = np.diff(np.append(heads, len(truth)))
                f = features(w)
                post, joint = forward_backward(emissions(self.weights, f), self.transition, heads, lengths, pairs=True)
                post[np.arange(len(truth)), truth] -= 1
                inner = np.ones(len(truth), bool)
                inner[heads + lengths - 1] = False
                at = np.flatnonzero(inner)
                np.add.at(joint, (truth[at], truth[at + 1]), -1)
                joint /= len(truth)
                moved += joint ** 2
                self.transition -= 0.2 * joint / np.sqrt(moved)
                grams, first, own = f
                word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(grams))))
                slots = np.concatenate([grams, own.T.ravel()])
                source = np.concatenate([word, np.tile(np.arange(len(first)), own.shape[1])])
                used, back_ = np.unique(slots, return_inverse=True)
                grad = np.stack([np.bincount(back_, post[source, k], len(used)) for k in range(len(self.labels))], axis=1) / len(truth)
                squares[used] += grad ** 2
                self.weights[used] -= 0.1 * grad / np.sqrt(squares[used])
        return self

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """(label, share of the text's word bytes that are in it) per text; ``und`` and 0 where there is no letter or nothing learned."""
        total = np.zeros((len(texts), len(self.labels)))
        for w in blocks(texts) if self.labels else ():
            if not len(w.start):
                continue
            post, _ = forward_backward(emissions(self.weights, features(w)), self.transition, *chains(w.opens, w.text))
            post *= (w.end - w.start)[:, None]
            heads = np.flatnonzero(np.concatenate([[True], w.text[1:] != w.text[:-1]]))
            total[w.text[heads]] += np.add.reduceat(post, heads, axis=0)
        mass = total.sum(axis=1)
        best = total.argmax(axis=1) if self.labels else np.zeros(len(texts), int)
        return ([self.labels[b] if m > 0 else "und" for b, m in zip(best, mass)],
                [float(t[b] / m) if m > 0 else 0.0 for t, b, m in zip(total, best, mass)])

    def words(self, text: str) -> list[tuple[str, str, float]]:
        """(word, label, probability) of every word of one text."""
        out = []
        for w in blocks([text]) if self.labels else ():
            post, _ = forward_backward(emissions(self.weights, features(w)), self.transition, *chains(w.opens, w.text))
            data = w.data.tobytes()
            out += [(data[s:e].decode("utf-8", "replace"), self.labels[int(p.argmax())], float(p.max())) for s, e, p in zip(w.start, w.end, post)]
        return out


def fit(docs: DataFrame, training, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 300, sentences: int = 24, epochs: int = 4) -> Tagger:
    """A tagger learned from ``per_language`` documents of every language among the rows where ``training`` holds.

    That bound on the sample (and ``sentences`` of each) is all that reaches the driver; which documents it holds depends
    on their ids alone. Null languages and texts are not learned from; without any row the tagger knows no language.
    """
    rows = (docs.where(training).select(F.col(doc_id).cast("long").alias("i"), F.col(lang).alias("s"), F.col(text).alias("t"))
            .where("s IS NOT NULL AND t IS NOT NULL"))
    chosen = first_per_class(rows.select("i", "s"), "s", "i", per_language).select("i").distinct()
    got = sorted((r["s"], r["t"]) for r in rows.join(F.broadcast(chosen), "i", "left_semi").select("s", "t").collect())
    return Tagger(sorted({s for s, _ in got})).fit([t for _, t in got], [s for s, _ in got], sentences, epochs)


def identify(docs: DataFrame, tagger: Tagger, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every document, over its whole text.

    ``und`` with score 0 where the text is null or has no letter; a null doc_id stays null; repeated rows are labelled
    each; an empty table gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(tagger)  # slots x languages: fixed number of slots

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo:lo + 1000]
                label, score = model.value.documents(part["text"].tolist())
                yield pd.DataFrame({"doc_id": part["doc_id"], "lang_pred": label, "score": score})

    return docs.select(whole(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, lang_pred string, score double").withColumn("doc_id", back("doc_id"))


def op9_language_crf(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False))
    tagger = fit(docs, F.col("doc_id").isNotNull() & ~held)
    return identify(docs, tagger).select("doc_id", held.alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language_crf": op9_language_crf}
