"""Feature-table cache and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rillwork.functions import columns as X


def write_features(df: DataFrame, path: str) -> None:
    """Store the wide table once; later steps read it instead of rebuilding."""
    df.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str, target: str | None = None) -> DataFrame:
    """Read the wide table, keeping rows with a target (the filter reaches the scan)."""
    df = spark.read.parquet(path)
    return df.where(F.col(target).isNotNull()) if target else df


def write_json(df: DataFrame, path: str) -> None:
    """Result rows as newline-delimited JSON; null fields are kept so that every record has every field."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def keyed_documents(df: DataFrame, key: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """(key, document): NaN and infinities to null, listed columns dropped, the row as one JSON text."""
    clean = X.finite_doubles(df).drop(*drop)
    cols = [c for c in clean.columns if c != key]
    return clean.select(F.col(key), F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("document"))


def write_keyed(df: DataFrame, key: str, path: str, drop: tuple[str, ...] = ()) -> None:
    """Keyed wide-table sink, one line per key."""
    docs = keyed_documents(df, key, drop)
    docs.select(F.to_json(F.struct(F.col(key), F.col("document"))).alias("value")).write.mode("overwrite").text(path)


def read_keyed(spark: SparkSession, path: str, key: str, schema: T.StructType | str) -> DataFrame:
    """Read the keyed sink back with a declared document schema."""
    rows = spark.read.text(path).select(F.from_json("value", f"{key} string, document string").alias("r")).select("r.*")
    return rows.select(key, F.from_json("document", schema).alias("d")).select(key, "d.*")
