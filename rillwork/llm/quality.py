"""Quality rules: a base of counts and an n-gram perplexity with upper and lower limits for every language.

The language model is a character model with modified Kneser-Ney smoothing over true characters (lower case, digits alike,
white space alike), so it grows with the corpus and its scripts. Spark counts in how many documents each n-gram occurs;
one that a single text has, be it in many copies, is not part of the model, so no text vouches for itself. Continuation counts, discounts and
back-off weights are groupings and joins of the distinct n-grams. Their log probabilities are written as sorted hash arrays,
one file for each range of hashes, which scoring tasks map into memory. Perplexity limits stand around each language's
median; how far depends on the text's length, since short texts scatter more.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillwork.llm.common import mix, raw, table, trim, worker_store
from rillwork.llm.files import opened
from rillwork.llm.letters import Words
from rillwork.llm.tokenfiles import mapped
from rillwork.session import scratch_path, stage

#: Characters of an n-gram: ``hi`` holds all but the last three, ``lo`` the last three, 21 bits each.
ORDER = 5
ONE, TWO, THREE = (1 << 21) - 1, (1 << 42) - 1, (1 << 63) - 1
SYMBOLS = b"#*$%&|<>"
#: Distinct n-grams a counting task holds before it sends them, how many it sends at a time, and about the n-grams of a file of the model.
HELD, SENT, RANGE = 300_000, 100_000, 2_000_000


def folded(text: str) -> np.ndarray:
    """Code points of a text in lower case, digits as 0, white space of the ASCII range as a space."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    c[(c >= 9) & (c <= 13)] = 32
    c[(c >= 48) & (c <= 57)] = 48
    return c


def text_blocks(texts: list[str | None], most: int = 500_000):
    """Blocks of about ``most`` characters: (numbers of the texts, code points with what precedes each, their lengths). Longer texts are
    cut into several blocks; what precedes a text is white space, what precedes a later part of one are its own characters."""
    before, at, parts, size = np.full(ORDER - 1, 32, np.int64), [], [], 0
    for i, t in enumerate(texts):
        if not t:
            continue
        c = np.concatenate([before, folded(t)])
        if len(c) > most:
            if at:
                yield at, parts
            for lo in range(0, len(c) - ORDER + 1, most):
                yield [i], [c[lo:lo + most + ORDER - 1]]
            at, parts, size = [], [], 0
            continue
        at.append(i)
        parts.append(c)
        size += len(c)
        if size >= most:
            yield at, parts
            at, parts, size = [], [], 0
    if at:
        yield at, parts


def grams(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hi, lo, first index of each part) of the n-gram that ends at every character of the parts."""
    c = np.concatenate(parts)
    lo = np.zeros(len(c), np.int64)
    hi = np.zeros(len(c), np.int64)
    lo[2:] = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    hi[4:] = c[:-4] << 21 | c[1:-3]
    size = np.array([len(p) for p in parts], np.int64)
    start = np.cumsum(size) - size
    own = np.ones(len(c), bool)
    for k in range(ORDER - 1):
        own[start + k] = False
    return hi[own], lo[own], start - np.arange(len(parts)) * (ORDER - 1)


def hashed(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    return mix(mix(hi.view(np.uint64) + np.uint64(1)) + lo.view(np.uint64))


def count_grams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(hi, lo, n, shared): distinct n-grams, in how many documents each occurs and whether these are different texts, summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def merged():
            """One row a hash; a column after the other, so that no second copy of all columns is held."""
            h = np.concatenate([x[0] for x in held])
            order = np.argsort(h, kind="stable")
            h = h[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            columns, heads = [h[first]], order[first]
            for k in (1, 2):
                columns.append(np.concatenate([x[k] for x in held])[heads])
            for k, join in ((3, np.add), (4, np.minimum), (5, np.maximum)):
                columns.append(join.reduceat(np.concatenate([x[k] for x in held])[order], first))
            return tuple(columns)

        def out():
            for at in range(0, len(held[0][0]), SENT):
                yield pa.record_batch([pa.array(x[at:at + SENT]) for x in held[0][1:]], names=["hi", "lo", "n", "low", "high"])

        for batch in batches:
            for cut in range(0, batch.num_rows, 1000):
                of_last, last = None, []  # the n-grams of a text that spans blocks count once
                texts = batch.column(0).slice(cut, 1000).to_pylist()
                name = np.array([xxhash.xxh3_64_intdigest(raw(t)) >> 1 for t in texts], np.int64)
                for at, parts in text_blocks(texts):
                    hi, lo, first = grams(parts)
                    h = hashed(hi, lo)
                    text_of = np.repeat(np.array(at), np.diff(np.append(first, len(h))))
                    order = np.argsort(h, kind="stable")  # texts stay in order among equal ones
                    h, text_of = h[order], text_of[order]
                    new = np.concatenate([[True], h[1:] != h[:-1]])
                    fresh = new.copy()
                    fresh[1:] |= text_of[1:] != text_of[:-1]
                    heads = np.flatnonzero(new)
                    n = np.add.reduceat(fresh.astype(np.int64), heads)
                    low, high = np.minimum.reduceat(name[text_of], heads), np.maximum.reduceat(name[text_of], heads)
                    h, hi, lo = h[heads], hi[order][heads], lo[order][heads]
                    if len(at) == 1:
                        if of_last == at[0]:
                            seen = np.isin(h, np.concatenate(last))
                            n = np.where(seen, 0, n)
                        else:
                            last = []
                        of_last = at[0]
                        last.append(h)
                    held.append((h, hi, lo, n, low, high))
                    if sum(len(x[0]) for x in held) > 2 * HELD:
                        held[:] = [merged()]
                        if len(held[0][0]) > HELD:
                            yield from out()
                            held.clear()
        if held:
            held[:] = [merged()]
            yield from out()
            held.clear()
        trim()

    rows = docs.select(F.col(text).alias("t")).where("t IS NOT NULL").mapInArrow(run, "hi long, lo long, n long, low long, high long")
    return rows.groupBy("hi", "lo").agg(F.sum("n").alias("n"), (F.min("low") < F.max("high")).alias("shared"))


def suffix(order: int) -> list[Column]:
    """An n-gram without its first character."""
    hi = F.col("hi").bitwiseAND(F.lit((1 << 21 * (order - 4)) - 1)) if order > 4 else F.lit(0).cast("long")
    return [hi.alias("shi"), F.col("lo").bitwiseAND(F.lit((1 << 21 * min(3, order - 1)) - 1)).alias("slo")]


def context() -> list[Column]:
    """An n-gram without its last character."""
    return [F.shiftright("hi", 21).alias("chi"), F.shiftright("lo", 21).bitwiseOR(F.shiftleft(F.col("hi").bitwiseAND(F.lit(ONE)), 42)).alias("clo")]


def discounts(counts: DataFrame) -> list[float]:
    """0 and the discounts of counts 1, 2 and 3 or more; half a count where the corpus is too small to tell."""
    n = counts.agg(*[F.count(F.when(F.col("c") == k, 1)) for k in range(1, 5)]).first()
    y = n[0] / max(1, n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.5 for k in range(3)]
    return [0.0, *(x if 0 < x < k + 1 else 0.5 for k, x in enumerate(d))]


def kneser_ney(seen: DataFrame) -> DataFrame:
    """(hi, lo, p): the probability of the last character of each distinct n-gram after the others.

    ``seen``: hi, lo, n, shared. Only n-grams of at least two texts are counted; all others get their probability by backing off.
    """
    tables = {ORDER: stage(seen.select("hi", "lo", F.when(F.col("shared"), F.col("n")).otherwise(F.lit(0).cast("long")).alias("c")), "grams")}
    for n in range(ORDER, 1, -1):
        shorter = tables[n].select(*suffix(n), (F.col("c") > 0).cast("long").alias("more"))
        tables[n - 1] = stage(shorter.groupBy(F.col("shi").alias("hi"), F.col("slo").alias("lo")).agg(F.sum("more").alias("c")), "grams")
    low = None
    for n in range(1, ORDER + 1):
        known, d = tables[n].where("c > 0"), discounts(tables[n])
        cut = F.element_at(F.array(*[F.lit(x) for x in d]), F.least(F.col("c"), F.lit(3)).cast("int") + 1)
        if n == 1:
            all_of = known.agg(F.sum("c").alias("total"), F.sum(cut).alias("free")).first()
            total, free, below = F.lit(all_of["total"]).cast("double"), F.lit(all_of["free"]).cast("double"), F.lit(1.0 / (1 + tables[1].count()))
            rows = tables[1]
        else:
            after = known.select(*context(), "c").groupBy("chi", "clo").agg(F.sum("c").cast("double").alias("total"), F.sum(cut).alias("free"))
            rows = tables[n].select("*", *context(), *suffix(n)).join(after, ["chi", "clo"], "left").join(low, ["shi", "slo"])
            total, free, below = F.col("total"), F.col("free"), F.col("below")
        p = F.when(total.isNull(), below).otherwise((F.col("c") - cut) / total + free / total * below)
        low = stage(rows.select("hi", "lo", p.alias("p")), "probabilities").select(F.col("hi").alias("shi"), F.col("lo").alias("slo"), F.col("p").alias("below"))
    return low.toDF("hi", "lo", "p")


def write_model(model: DataFrame, folder: str) -> tuple[int, list[tuple[int, str, int]]]:
    """Writes (hi, lo, p) as sorted hash arrays below ``folder``: bits that name a range, and (range, path, n-grams) of every file."""
    spark = model.sparkSession
    bits = max(0, math.ceil(math.log2(max(1, model.count()) / RANGE)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = hashed(batch.column("hi").to_numpy(), batch.column("lo").to_numpy())
            yield pa.record_batch([pa.array(_range(h, bits)), pa.array(h.view(np.int64)), pa.array(np.log(batch.column("p").to_numpy()).astype(np.float32))], names=["r", "h", "logp"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, path, n, out = None, "", 0, []

        def close():
            for f in out:
                f.close()
            return pa.record_batch([pa.array([now], pa.int64()), pa.array([path]), pa.array([n], pa.int64())], names=["r", "path", "n"])

        for batch in batches:
            r = batch.column("r").to_numpy()
            cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if r[a] != now:
                    if now is not None:
                        yield close()
                    now, path, n = int(r[a]), f"{folder}/range-{int(r[a]):05d}-{uuid.uuid4().hex}", 0
                    system, place = opened(path)
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    out = [system.open_output_stream(place + end, compression=None) for end in (".hash", ".logp")]
                out[0].write(batch.column("h").slice(a, b - a).to_numpy().astype("<i8").tobytes())
                out[1].write(batch.column("logp").slice(a, b - a).to_numpy().astype("<f4").tobytes())
                n += b - a
        if now is not None:
            yield close()

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = model.mapInArrow(keyed, "r long, h long, logp float").repartition(tasks, "r").sortWithinPartitions("r", "h")
    index = stage(ordered.mapInArrow(files, "r long, path string, n long"), "model-index")
    return bits, [tuple(x) for x in index.collect()]  # one row for each RANGE n-grams


def _range(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


class Model:
    """Looks n-grams up in the sorted hash arrays; only the pages that are looked at are read."""

    def __init__(self, bits: int, index: list[tuple[int, str, int]]):
        self.bits, self.files = bits, {r: (path, n) for r, path, n in index}
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def log_p(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Natural log of the probability of the last character of each n-gram; not a number for one that was never counted."""
        h, back = np.unique(hashed(hi, lo), return_inverse=True)
        r, out = _range(h, self.bits), np.full(len(h), np.nan)
        for k in np.unique(r).tolist():
            if k not in self.files:
                continue
            if k not in self.open:
                path, n = self.files[k]
                self.open[k] = mapped(path + ".hash", "<i8", 0, n), mapped(path + ".logp", "<f4", 0, n)
            keys, values = self.open[k]
            mine = np.flatnonzero(r == k)
            want = h[mine].view(np.int64)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            out[mine] = np.where(keys[at] == want, values[at], np.nan)
        return out[back]


def base_counts(texts: list[bytes]) -> np.ndarray:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of UTF-8 texts, one row each."""
    out = np.zeros((len(texts), 5), np.int64)
    data = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    begins = np.cumsum([1] + [len(t) + 1 for t in texts])
    text = np.searchsorted(begins, start, "right") - 1
    out[:, 0] = np.bincount(text, minlength=len(texts))
    places = np.concatenate([[0], np.cumsum(solid & ((data & 0xC0) != 0x80))])
    out[:, 1] = places[begins[1:] - 1] - places[begins[:-1]]
    places = np.concatenate([[0], np.cumsum(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)))])
    out[:, 2] = places[begins[1:] - 1] - places[begins[:-1]]
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[i, 3] = len(lines) - len(set(lines))
    if len(start) > 2:
        h = Words(data, start, end, text, text).hashes()
        window = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
        at = np.flatnonzero(text[2:] == text[:-2])
        window = mix(window[at] + text[at].astype(np.uint64))
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(start), bool)
        for k in range(3):
            covered[at[twice] + k] = True
        out[:, 4] = np.bincount(text[covered], minlength=len(texts))
    return out


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars"]


def measure(rows: DataFrame, bits: int, index: list[tuple[int, str, int]]) -> DataFrame:
    """``rows``, which has a column text, with base counts and entropy (mean negative log probability of a character) of every whole text; text is dropped."""
    others, name = [f for f in rows.schema.fields if f.name != "text"], uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_store()
        if kept.get("quality", ("",))[0] != name:
            kept["quality"] = name, Model(bits, index)
        model = kept["quality"][1]
        for whole_batch in batches:
            for lo in range(0, whole_batch.num_rows, 1000):
                part = whole_batch.slice(lo, 1000)
                n, texts = part.num_rows, part.column("text").to_pylist()
                counts, total = np.zeros((n, len(MEASURES)), np.int64), np.zeros(n)
                for at in range(0, n, 200):
                    some = [i for i in range(at, min(n, at + 200)) if texts[i]]
                    if some:
                        counts[some, :5] = base_counts([raw(texts[i]) for i in some])
                for at, parts in text_blocks(texts):
                    hi, low, first = grams(parts)
                    size = np.diff(np.append(first, len(hi)))
                    np.add.at(total, at, -np.add.reduceat(np.nan_to_num(model.log_p(hi, low)), first))
                    np.add.at(counts[:, 5], at, size)
                entropy = total / np.maximum(counts[:, 5], 1)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in others), *(pa.array(c) for c in np.ascontiguousarray(counts.T)), pa.array(entropy)],
                                                 names=[f.name for f in others] + MEASURES + ["entropy"])
        trim()

    schema = T.StructType([*others, *(T.StructField(m, T.LongType()) for m in MEASURES), T.StructField("entropy", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def limits(measured: DataFrame, width: float, least: int) -> DataFrame:
    """measured with low and high entropy of its language.

    Deviations from the language's median are scaled by the root of the text's length before their median is taken, and
    scaled back for each text. The scale of all texts times ``least`` over the language's number of texts is added to its
    own, so limits are wide open for a handful of texts and close in as they grow. Texts without a language, null or
    empty, have limits that span the medians of all languages with the widest scale.
    """
    known = measured.where("n_chars > 0").select(F.coalesce("lang", F.lit("")).alias("k"), "entropy", "n_chars")
    away = F.abs(F.col("entropy") - F.col("median")) * F.sqrt("n_chars")
    middle = stage(known.groupBy("k").agg(F.percentile_approx("entropy", 0.5, 10000).alias("median"), F.count("*").alias("n")), "medians")
    m0 = known.agg(F.percentile_approx("entropy", 0.5, 10000)).first()[0]
    s0 = known.withColumn("median", F.lit(m0).cast("double")).agg(F.percentile_approx(away, 0.5, 10000) * 1.4826).first()[0]
    own = (F.percentile_approx(away, 0.5, 10000) * 1.4826) + F.lit(s0).cast("double") * least / F.col("n")
    per = stage(known.join(middle, "k").groupBy("k", "median", "n").agg(own.alias("scale")).drop("n"), "limits")
    lowest, highest, widest = (F.lit(x).cast("double") for x in per.agg(F.min("median"), F.max("median"), F.max("scale")).first())
    out = measured.withColumn("k", F.coalesce("lang", F.lit(""))).join(per.where("k <> ''"), "k", "left")
    margin = F.coalesce("scale", widest) * width / F.sqrt(F.greatest("n_chars", F.lit(1)))
    return out.select(*measured.columns, (F.coalesce("median", lowest) - margin).alias("low"), (F.coalesce("median", highest) + margin).alias("high"))


def judged(docs: DataFrame, columns: list, text: str, lang: str, width: float, least: int) -> DataFrame:
    """``columns`` of every document with its measures, limits, base_failed and kept."""
    bits, index = write_model(kneser_ney(count_grams(docs, text)), scratch_path(docs.sparkSession, "model"))
    rows = docs.select(*columns, F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    measured = stage(measure(rows, bits, index), "measured")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    inside = F.col("entropy").between(F.col("low"), F.col("high"))
    return limits(measured, width, least).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", width: float = 7.0, least: int = 50) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, perplexity, low and high (perplexity limits), kept.

    The base fails texts of under 50 words or with over half of their words in repeated three-word windows. Of the others
    those are kept whose perplexity lies between the limits of their language, ``width`` robust standard deviations from
    its median; the fewer texts a language has, the wider (``least`` texts add one deviation of all texts to its own).
    Null and empty texts have no words and fail; without a language the limits span those of all languages; a null
    doc_id stays null; repeated rows are judged each; an empty table gives no rows; other columns are not read.
    """
    return judged(docs, [F.col(doc_id).alias("doc_id")], text, lang, width, least).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.exp("entropy").alias("perplexity"), F.exp("low").alias("low"),
        F.exp("high").alias("high"), "kept")


def keep(docs: DataFrame, text: str = "text", lang: str = "lang", width: float = 7.0, least: int = 50) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns."""
    return judged(docs, [F.struct("*").alias("document")], text, lang, width, least).where("kept").select("document.*")


def op5_perplexity_rules(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "low", "high")


QUERIES = {"op5_perplexity_rules": op5_perplexity_rules}
