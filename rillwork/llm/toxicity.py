"""Toxicity by a convolutional text classifier, trained in numpy by tasks that hold a bucket of texts each.

Every word has an embedding, the sum of the entries that two hashes pick from two tables, so that a rare word rarely
shares both with a telling one. Filters of several widths run over the word sequence, each filter's largest response
over the whole text is kept, and a linear layer turns these into a logit. All labelled documents train it: in a round
every bucket goes on from the common net, and what the buckets changed is averaged. Thresholds are calibrated on held-back
training documents for every language; which language a text counts as is told by its words.
"""

from __future__ import annotations

import copy
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import back, table, whole, worker_store
from rillwork.llm.files import opened
from rillwork.llm.letters import Words, blocks, fold
from rillwork.session import scratch_path, stage

BITS = 18
SIZE = 1 << BITS
DECISION = 0.7
#: Labelled documents in a bucket; labels that are sent to every task up to so many, beyond it they meet the documents in a shuffle.
BUCKET = 4096
BROADCAST_LABELS = 2_000_000
#: Logits meet their calibration in steps of 1 / GRID.
GRID = 1024
#: What buckets changed is first added up in so many groups.
SALTS = 16
_CUT = pa.schema([("y", pa.int32()), ("s", pa.string()), ("held_back", pa.bool_()), ("seat", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
_CHANGES = "salt int, piece long, rows binary, changed binary, dense binary"


def slots(w: Words) -> tuple[np.ndarray, np.ndarray]:
    h = w.hashes()
    return (h & np.uint64(SIZE - 1)).astype(np.int64), ((h >> np.uint64(30)) & np.uint64(SIZE - 1)).astype(np.int64)


class ConvNet:
    """Two embedding tables, one filter bank per width, and a linear layer."""

    def __init__(self, dim: int = 8, filters: int = 8, widths: tuple[int, ...] = (1, 2, 3), seed: int = 3):
        rng = np.random.default_rng(seed)
        self.tables = [rng.normal(0, 0.01, (SIZE, dim)).astype(np.float32) for _ in range(2)]
        self.widths, self.filters = widths, filters
        self.banks = [rng.normal(0, 0.3, (w, dim, filters)).astype(np.float32) for w in widths]
        self.out = np.full(len(widths) * filters, 0.3, np.float32)
        self.bias = -1.0
        self.state: list[np.ndarray] = []
        self.bias_state = 1e-2
        self.languages: list[str] = []
        self.word_language = np.zeros((SIZE, 0), np.float32)
        self.thresholds: dict[str, float] = {}
        self.threshold = 0.0

    def pooled(self, a: np.ndarray, b: np.ndarray, heads: np.ndarray, where: bool = False):
        """Largest response of every filter over each text (texts x filters), and at which word if asked for."""
        e = self.tables[0][a] + self.tables[1][b]
        ends = np.append(heads[1:], len(a))
        values, places = [], []
        for width, bank in zip(self.widths, self.banks):
            response = e @ bank[0]
            for k in range(1, width):
                response[:-k] += e[k:] @ bank[k]
            for k in range(1, width):  # a window that would leave its text does not count
                last = np.maximum(ends - k, heads)
                response[last[last > heads]] = -np.inf
            top = np.maximum.reduceat(response, heads, axis=0)
            values.append(top)
            if where:
                at = np.empty(top.shape, np.int64)
                for i, (lo, hi) in enumerate(zip(heads, ends)):
                    at[i] = lo + response[lo:hi].argmax(axis=0)
                places.append(at)
        return (np.concatenate(values, axis=1), places, e) if where else np.concatenate(values, axis=1)

    def open(self, seen: np.ndarray, total: np.ndarray) -> ConvNet:
        """One embedding entry starts at the log odds of the texts its words occur in, which spares long searching: texts of each class by table, class and slot, and in all."""
        for k in range(2):
            odds = np.log((seen[k, 1] + 0.5) / (total[1] + 1)) - np.log((seen[k, 0] + 0.5) / (total[0] + 1))
            self.tables[k][:, 0] += (odds * np.minimum(1, (seen[k, 0] + seen[k, 1]) / 8)).astype(np.float32) / 2
        self.banks[0][0, 0] = np.abs(self.banks[0][0, 0]) + 0.3
        self.state = [np.full_like(x, 1e-2) for x in [*self.tables, *self.banks, self.out]]
        self.bias_state = 1e-2
        return self

    def dense(self) -> np.ndarray:
        """All that is not an embedding, with its Adagrad sums."""
        return np.concatenate([x.ravel() for x in [*self.banks, self.out, *self.state[2:]]] + [[self.bias, self.bias_state]]).astype(np.float64)

    def set_dense(self, values: np.ndarray) -> None:
        at = 0
        for x in [*self.banks, self.out, *self.state[2:]]:
            x[...] = values[at:at + x.size].reshape(x.shape)
            at += x.size
        self.bias, self.bias_state = float(values[at]), float(values[at + 1])

    def part(self, rows: list[np.ndarray]) -> ConvNet:
        """A copy with only these rows of the two tables."""
        net = copy.copy(self)
        net.tables = [t[r] for t, r in zip(self.tables, rows)]
        net.banks, net.out = [x.copy() for x in self.banks], self.out.copy()
        net.state = [s[r] for s, r in zip(self.state, rows)] + [s.copy() for s in self.state[2:]]
        return net

    def embeddings(self, rows: list[np.ndarray]) -> np.ndarray:
        """Embeddings and their Adagrad sums of rows of the first and of the second table."""
        return np.concatenate([np.concatenate([x[k][rows[k]] for k in range(2)]) for x in (self.tables, self.state)], axis=1)

    def move_embeddings(self, rows: np.ndarray, by: np.ndarray) -> None:
        """Adds to embeddings and Adagrad sums; rows are numbered through both tables."""
        dim = self.tables[0].shape[1]
        for k in range(2):
            mine = rows // SIZE == k
            self.tables[k][rows[mine] % SIZE] += by[mine, :dim]
            self.state[k][rows[mine] % SIZE] += by[mine, dim:]

    def train(self, cut: list, epochs: int, seed: int) -> list[np.ndarray]:
        """Adagrad on the weighted log loss of (slots, slots, label, weight) texts; the rows it changed in each table."""
        rng, rate = np.random.default_rng(seed), 0.05
        state = {id(x): s for x, s in zip([*self.tables, *self.banks, self.out], self.state)}
        touched = [np.zeros(len(t), bool) for t in self.tables]

        def step(x, grad, rows=None):
            s = state[id(x)]
            if rows is None:
                s += grad ** 2
                x -= rate * grad / np.sqrt(s)
            else:
                np.add.at(s, rows, grad ** 2)
                np.add.at(x, rows, -rate * grad / np.sqrt(s[rows]))

        for _ in range(epochs):
            order = rng.permutation(len(cut))
            for lo in range(0, len(order), 64):
                batch = [cut[i] for i in order[lo:lo + 64]]
                lengths = np.array([len(c[0]) for c in batch])
                heads = np.cumsum(lengths) - lengths
                a, b = np.concatenate([c[0] for c in batch]), np.concatenate([c[1] for c in batch])
                y, weight = np.array([c[2] for c in batch], float), np.array([c[3] for c in batch])
                top, places, e = self.pooled(a, b, heads, where=True)
                finite = np.isfinite(top)
                hidden = np.where(finite & (top > 0), top, 0)
                p = 1 / (1 + np.exp(-(hidden @ self.out + self.bias)))
                d = ((p - y) * weight / len(batch)).astype(np.float32)
                flow = (d[:, None] * self.out[None]) * (hidden > 0)
                step(self.out, hidden.T @ d)
                self.bias_state += float(d.sum()) ** 2
                self.bias -= rate * float(d.sum()) / self.bias_state ** 0.5
                for k, width in enumerate(self.widths):
                    g = flow[:, k * self.filters:(k + 1) * self.filters]
                    text, unit = np.nonzero(g)
                    at = places[k][text, unit]
                    bank, grad = self.banks[k], np.zeros_like(self.banks[k])
                    for j in range(width):
                        word = np.minimum(at + j, len(a) - 1)
                        np.add.at(grad[j].T, unit, g[text, unit][:, None] * e[word])
                        back_ = g[text, unit][:, None] * bank[j][:, unit].T
                        step(self.tables[0], back_, a[word])
                        step(self.tables[1], back_, b[word])
                        touched[0][a[word]] = touched[1][b[word]] = True
                    step(bank, grad)
        return [np.flatnonzero(t) for t in touched]

    def fit(self, texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = 6, seed: int = 7) -> ConvNet:
        """Learns from texts at hand, as one bucket."""
        cut = [(*text_slots(t), labels[i], weights[i]) for i, t in enumerate(texts)]
        cut = [c for c in cut if len(c[0])]
        if cut:
            seen = np.zeros((2, 2, SIZE))
            for c in cut:
                for k in range(2):
                    seen[k, int(c[2]), np.unique(c[k])] += 1
            self.open(seen, np.array([sum(1 for c in cut if c[2] == y) for y in (0, 1)])).train(cut, epochs, seed)
        return self

    def learn_languages(self, texts: list[str], langs: list[str | None]) -> ConvNet:
        """Log shares of word slots per language, to tell which threshold a text falls under."""
        counts = {s: np.zeros(SIZE) for s in langs if s is not None}
        for t, s in zip(texts, langs):
            if s is not None:
                counts[s] += np.bincount(text_slots(t)[0], minlength=SIZE)
        return self.know_languages(counts)

    def know_languages(self, counts: dict[str, np.ndarray]) -> ConvNet:
        """Log shares from the number of words in every slot."""
        self.languages = sorted(counts)
        known = np.stack([counts[s] for s in self.languages], axis=1) + 0.1 if counts else np.full((SIZE, 0), 0.1)
        self.word_language = np.log(known / known.sum(axis=0)).astype(np.float32)
        return self

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, index of the language or -1) of every whole text; the pieces of a very long one are pooled together."""
        top = np.full((len(texts), len(self.out)), -np.inf, np.float32)
        told = np.zeros((len(texts), len(self.languages)), np.float64)
        for w in blocks(texts):
            if not len(w.start):
                continue
            a, b = slots(w)
            heads = np.flatnonzero(np.concatenate([[True], w.text[1:] != w.text[:-1]]))
            self._see(top, told, a, b, heads, w.text[heads])
        return self._logits(top, told)

    def _see(self, top, told, a, b, heads, of) -> None:
        np.maximum.at(top, of, self.pooled(a, b, heads))
        if self.languages:
            np.add.at(told, of, np.add.reduceat(self.word_language[a], heads, axis=0))

    def slot_logits(self, cut: list) -> tuple[np.ndarray, np.ndarray]:
        """The same of texts given by the slots of their words."""
        top = np.full((len(cut), len(self.out)), -np.inf, np.float32)
        told = np.zeros((len(cut), len(self.languages)), np.float64)
        for i, (a, b) in enumerate(cut):
            if len(a):
                self._see(top, told, a, b, np.zeros(1, np.int64), np.array([i]))
        return self._logits(top, told)

    def _logits(self, top, told) -> tuple[np.ndarray, np.ndarray]:
        has = np.isfinite(top).any(axis=1)
        hidden = np.where(np.isfinite(top) & (top > 0), top, 0)
        return hidden @ self.out + self.bias, np.where(has, told.argmax(axis=1) if self.languages else -1, -1)

    def calibrate(self, z: np.ndarray, lang: np.ndarray, hits: np.ndarray, n: np.ndarray, least: int = 30) -> ConvNet:
        """The logit with the best F1 over all texts and in each language; a language with few positives is drawn to the common one.

        ``hits`` of the ``n`` texts of language number ``lang`` with logit ``z`` have label 1.
        """
        def best(mask):
            order = np.argsort(-z[mask], kind="stable")
            y, w, s = hits[mask][order], n[mask][order], z[mask][order]
            hit = np.cumsum(y)
            f1 = 2 * hit / (np.cumsum(w) + y.sum())
            f1[np.append(s[1:] == s[:-1], False)] = -1  # equal logits fall on one side
            k = int(f1.argmax())
            return (s[k] + (s[k + 1] if k + 1 < len(s) else s[k] - 2)) / 2

        if hits.any():
            self.threshold = float(best(np.ones(len(z), bool)))
        for k, name in enumerate(self.languages):
            mask = lang == k
            found = int(hits[mask].sum())
            if found:
                self.thresholds[name] = float((found * best(mask) + least * self.threshold) / (found + least))
        return self

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Between 0 and 1; DECISION where the logit is at the threshold of the text's language."""
        z, lang = self.logits(texts)
        limit = np.array([self.thresholds.get(s, self.threshold) for s in self.languages] + [self.threshold])[lang]
        return 1 / (1 + np.exp(-np.clip(z - limit + np.log(DECISION / (1 - DECISION)), -40, 40)))


def text_slots(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The slots of the words of a whole text in both tables."""
    parts = [slots(w) for w in blocks([text])]
    return tuple(np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in range(2))


def known_texts(docs: DataFrame, known: DataFrame, buckets: int, few: bool) -> DataFrame:
    """y, s, held_back, seat, a, b, bucket: label, language, whether it calibrates, and the slots of every labelled document, written bucket by bucket."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                i, y, s, seat, texts = (c.to_pylist() for c in batch.slice(lo, 500).select(["i", "y", "s", "seat", "t"]).columns)
                both = [[x.astype(np.int32).tobytes() for x in text_slots(t)] for t in texts]
                columns = [y, s, [hash_fifth(x) for x in i], seat, [x[0] for x in both], [x[1] for x in both]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _CUT)], schema=_CUT)

    rows = docs.join(F.broadcast(known) if few else known, "i").distinct().withColumn("seat", F.xxhash64("i", "y", "s", "t"))
    rows = rows.mapInArrow(cut, "y int, s string, held_back boolean, seat long, a binary, b binary").withColumn("bucket", F.pmod("seat", F.lit(buckets)))
    return stage(rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "seat", "y"), "toxic-texts")


def _read(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """(slots, slots, values of ``columns``) of a few hundred rows at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            yield *([np.frombuffer(v, np.int32) for v in part.column(c).to_pylist()] for c in ("a", "b")), *(part.column(c).to_pylist() for c in columns)


def slot_counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(texts by table, label and slot; texts by label; words by slot for each language). The first two leave out those held back.

    Tasks add up their rows and what meets is as large as the tables, whatever the number of rows.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen, words = np.zeros((2, 2, SIZE), np.int64), {}
        for a, b, y, s, back_ in _read(batches, "y", "s", "held_back"):
            for i, ab in enumerate(zip(a, b)):
                if len(ab[0]) and not back_[i]:
                    for k in range(2):
                        seen[k, y[i], np.unique(ab[k])] += 1
                if s[i] is not None:
                    words.setdefault(s[i], np.zeros(SIZE, np.int64))
                    np.add.at(words[s[i]], ab[0], 1)
        packed = [*((str(2 * k + y), None, seen[k, y]) for k in range(2) for y in (0, 1)), *(("words", name, v) for name, v in words.items())]
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.record_batch([pa.array([p[0] for p in packed]), pa.array([p[1] for p in packed], pa.string()), pa.array([salt] * len(packed), pa.int32()),
                               pa.array([zlib.compress(p[2].tobytes(), 1) for p in packed], pa.binary())], names=["kind", "of", "salt", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(b), np.int64) for b in pdf["n"])
        return pdf.iloc[:1].assign(n=[zlib.compress(total.tobytes(), 1)])

    form = "kind string, of string, salt int, n binary"
    got = rows.select("y", "s", "held_back", "a", "b").mapInArrow(count, form).groupBy("kind", "of", "salt").applyInPandas(add, form).groupBy("kind", "of").applyInPandas(add, form)
    seen, langs = np.zeros((2, 2, SIZE)), {}
    for r in got.collect():
        values = np.frombuffer(zlib.decompress(r["n"]), np.int64)
        if r["kind"] == "words":
            langs[r["of"]] = values
        else:
            seen[int(r["kind"]) // 2, int(r["kind"]) % 2] = values
    total = {r["y"]: r["n"] for r in rows.where("NOT held_back AND length(a) > 0").groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    return seen, np.array([total.get(y, 0) for y in (0, 1)]), langs


def _written(spark, net: ConvNet) -> str:
    """The net as a file in the shared folder; its size is fixed."""
    path = scratch_path(spark, "net")
    fs, at = opened(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(at) as out:
        pickle.dump(net, out, 5)
    return path


def _held(path: str) -> ConvNet:
    """The net of that file; a worker keeps the one it read last."""
    kept = worker_store()
    if kept.get("net", ("",))[0] != path:
        kept.pop("net", None)
        fs, at = opened(path)
        with fs.open_input_stream(at) as data:
            kept["net"] = path, pickle.load(data)
    return kept["net"][1]


def train_round(rows: DataFrame, net: ConvNet, epochs: int, seed: int) -> None:
    """One round: every bucket trains a copy of the net on its texts, and the net moves by the mean of what they changed.

    Buckets weigh as many as they have texts; an embedding row moves by the mean over the buckets that changed it.
    """
    path, width = _written(rows.sparkSession, net), 2 * net.tables[0].shape[1]

    def pieces(batches):
        held, now = [], None
        for part in _read(batches, "bucket", "y"):
            for a, b, bucket, y in zip(*part):
                if held and bucket != now:
                    yield now, held
                    held = []
                now = bucket
                held.append((a, b, y, 1.0))
        if held:
            yield now, held

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = _held(path)
        for bucket, cut in pieces(batches):
            of, seats = zip(*(np.unique(np.concatenate([c[k] for c in cut]), return_inverse=True) for k in range(2)))
            ends = np.cumsum([len(c[0]) for c in cut])[:-1]
            start = base.part(of)
            mine = start.part([slice(None)] * 2)
            changed = mine.train([(a, b, *c[2:]) for a, b, c in zip(*(np.split(x, ends) for x in seats), cut)], epochs, seed * 1_000_003 + bucket)
            n = len(cut)
            moved = (mine.embeddings(changed).astype(np.float64) - start.embeddings(changed)) * n
            moved = np.column_stack([moved, np.full(len(moved), n)]).astype(np.float32)
            changed = np.concatenate([of[0][changed[0]], of[1][changed[1]] + SIZE])
            dense = np.append((mine.dense() - start.dense()) * n, n)
            yield pa.record_batch([pa.array([bucket % SALTS], pa.int32()), pa.array([bucket], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (changed.astype(np.int64), moved, dense)]],
                                  names=["salt", "piece", "rows", "changed", "dense"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["piece", "dense"])  # the same sums at every run
        total = np.zeros((2 * SIZE, width + 1))
        for rows_, changed in zip(pdf["rows"], pdf["changed"]):
            total[np.frombuffer(rows_, np.int64)] += np.frombuffer(changed, np.float32).reshape(-1, width + 1)
        every = np.flatnonzero(total[:, -1])
        total = total[every]
        dense = sum(np.frombuffer(b) for b in pdf["dense"])
        return pd.DataFrame({"salt": [0], "piece": [int(pdf["salt"].iloc[0])], "rows": [every.tobytes()], "changed": [total.astype(np.float32).tobytes()], "dense": [dense.tobytes()]})

    sums = rows.where("NOT held_back AND length(a) > 0").select("bucket", "y", "a", "b").mapInArrow(learn, _CHANGES)
    for r in sums.groupBy("salt").applyInPandas(add, _CHANGES).groupBy("salt").applyInPandas(add, _CHANGES).collect():
        at, values, dense = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["changed"], np.float32).reshape(-1, width + 1), np.frombuffer(r["dense"])
        net.move_embeddings(at, values[:, :-1] / values[:, -1:])
        net.set_dense(net.dense() + dense[:-1] / dense[-1])


def calibration_cells(rows: DataFrame, net: ConvNet) -> pd.DataFrame:
    """Held-back texts by language number and logit (in steps of 1 / GRID): z, lang, hits, n."""
    path = _written(rows.sparkSession, net)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b, y in _read(batches, "y"):
            z, lang = _held(path).slot_logits(list(zip(a, b)))
            yield pa.record_batch([pa.array(np.round(z * GRID).astype(np.int64)), pa.array(lang.astype(np.int32)), pa.array(y, pa.int32())], names=["z", "lang", "y"])

    seen = rows.where("held_back").select("y", "a", "b").mapInArrow(read, "z long, lang int, y int")
    got = seen.groupBy("z", "lang").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n")).orderBy("lang", "z").toPandas()
    got["z"] /= GRID
    return got


def fit(docs: DataFrame, labels: DataFrame, training, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic",
        rounds: int = 3, epochs: int = 2) -> ConvNet | None:
    """A net trained on all labelled documents among the label rows where ``training`` holds; a hash of the id deals a fifth of them to the calibration.

    Texts are cut into slots once and lie in buckets of about BUCKET documents; a round is one scan of them, ``epochs`` passes over each
    bucket. Only sums of the size of the net reach the driver. Null labels, ids and texts are not learned from; None where a class is missing.
    """
    known = labels.where(training).where(F.col(label).isin(0, 1)).select(F.col(doc_id).cast("long").alias("i"), F.col(label).cast("int").alias("y")).where("i IS NOT NULL").distinct()
    n = known.count()
    if not n:
        return None
    texts = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t"), F.col(lang).alias("s")).where("t IS NOT NULL")
    rows = known_texts(texts, known, -(-n // BUCKET), n <= BROADCAST_LABELS)
    if len(rows.select("y").distinct().collect()) < 2:
        return None
    seen, total, langs = slot_counts(rows)
    net = ConvNet().open(seen, total)
    if total.sum():
        for r in range(rounds):
            train_round(rows, net, epochs, 7 + r)
    cells = calibration_cells(rows, net.know_languages(langs))
    net.state = []
    return net.calibrate(*(cells[c].to_numpy() for c in ("z", "lang", "hits", "n")))


def hash_fifth(i: int) -> bool:
    """Whether an id belongs to the calibrating fifth."""
    return (i * 2654435761 % (1 << 32)) >> 16 & 0xFF < 51


def score(docs: DataFrame, net: ConvNet | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every document, over its whole text.

    Null and wordless texts get the score of a text in which nothing was found; without a net all scores are 0; a null
    doc_id stays null; repeated rows are scored each; an empty table gives no rows; other columns are not read.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # fixed table sizes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo:lo + 1000]
                got = model.value.scores(part["text"].tolist()) if model.value is not None else np.zeros(len(part))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "score": np.asarray(got, float)})

    return docs.select(whole(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, "doc_id long, score double").withColumn("doc_id", back("doc_id"))


def op8_toxicity_cnn(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    net = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), F.col("doc_id").isNotNull() & ~held)
    return score(docs, net).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= DECISION, 1).otherwise(0).alias("predicted"))


QUERIES = {"op8_toxicity_cnn": op8_toxicity_cnn}
