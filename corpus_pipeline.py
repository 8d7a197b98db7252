"""From raw documents to packed training sequences: five stages, each on all that the one before it kept.

STAGES names them in order; each takes (spark, docs, sf_dir) and returns a DataFrame, the next one's docs. All but the last
return the columns of ``documents``; ``run`` writes each result as Parquet and reads it back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillwork.llm import minhash, mixing, packing, quality, spans
from rillwork.llm.common import table
from rillwork.session import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the perplexity limits of their language.

    Null, empty and short texts go; a null language has limits that span all languages; repeated rows are judged each, and
    rows without a doc_id too; an empty table stays empty; other columns are carried along.
    """
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id; documents without an id stay.

    Rows that share a doc_id are one document: they stay or go together. Null and empty texts are near nothing but
    each other's exact copies; an empty table stays empty; other columns are carried along.
    """
    gone = minhash.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without repeated runs of sentences; n_chars follows the text.

    Null, empty and short texts and rows without a doc_id are left as they are; rows that share a doc_id are judged
    against smaller ids; an empty table stays empty; other columns are carried along, whatever their names.
    """
    out = spans.drop_repeated(docs.select("doc_id", "text", F.struct("*").alias("__document")))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[new.get(c, F.col(f"__document.`{c}`")).alias(c) for c in docs.columns])


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows without a doc_id and rows that share one are drawn one by one.

    A null source is a source of its own; null and empty texts have no words and are drawn like the others; an empty table stays
    empty; other columns are carried along, whatever their names.
    """
    rows = stage(docs.select("text", "source", F.struct("*").alias("__document"), F.monotonically_increasing_id().alias("__row")), "numbered")
    taken = mixing.mix_sources(rows, doc_id="__row").select(F.col("doc_id").alias("__taken"), F.col("copies").alias("__copies")).where("__copies > 0")
    out = rows.join(taken, rows["__row"] == taken["__taken"]).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return out.select(*[F.col(f"__document.`{c}`").alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens, with their ids.

    Null and empty texts are one end id; a null doc_id stays null; repeated rows are packed each; an empty table gives no
    rows; other columns are not read.
    """
    return packing.pack(docs, public_tokenizers.path(packing.RANKS), public_tokenizers.PATTERN)


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup), ("substring dedup", substring_dedup), ("source mix", source_mix), ("packing", pack_sequences)]

#: Perplexity, alignment and balanced sampling have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
