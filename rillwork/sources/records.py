"""Typed scans of the raw file layouts, and optional or fallback sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rillwork.functions import columns as X
from rillwork.session import stage
from rillwork.sources import documents, files

RECORD_FIELDS = ["source_desc", "sector_desc", "agg_level_desc", "statisticcat_desc", "prodn_practice_desc",
                 "util_practice_desc", "domain_desc", "domaincat_desc", "commodity_desc", "short_desc", "unit_desc",
                 "state_alpha", "state_fips_code", "county_code", "county_ansi", "county_name", "year", "Value"]
RECORD_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in RECORD_FIELDS])


def _or_empty(spark: SparkSession, schema: T.StructType | str, read) -> DataFrame:
    """A missing path gives an empty frame with the declared schema, so later steps always see every column."""
    try:
        return read()
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in (err.getCondition() or "") or "does not exist" in str(err):
            return spark.createDataFrame([], schema)
        raise


def json_records(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA, lines: bool = False) -> DataFrame:
    """JSON array of records or, with ``lines``, newline-delimited records. Both split freely: an array is cut at its elements."""
    def read() -> DataFrame:
        if lines:
            return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).dropna(how="all")
        return documents.elements(spark, path).select(F.from_json("text", schema).alias("r")).select("r.*").dropna(how="all")
    return _or_empty(spark, schema, read)


def json_objects(spark: SparkSession, glob: str, schema: T.StructType, key: str) -> DataFrame:
    """Many small files, one object each; unreadable ones and those without a key are skipped."""
    return _or_empty(spark, schema, lambda: spark.read.schema(schema).option("multiLine", True)
                     .option("ignoreCorruptFiles", True).json(glob).where(F.col(key).isNotNull() & (F.col(key) != "")))


def keyed_object(spark: SparkSession, path: str, value_type: str, key: str = "key") -> DataFrame:
    """One object {key: {...}} per file, of any size, to (key, value) rows."""
    entry = F.from_json(F.concat(F.lit("{"), F.col("text"), F.lit("}")), f"map<string,{value_type}>")
    return _or_empty(spark, f"{key} string, value {value_type}", lambda: documents.elements(spark, path, outer="{", keyed=True)
                     .select(F.explode(entry).alias(key, "value")))


def nested_years(spark: SparkSession, path: str, key: str = "state") -> DataFrame:
    """{key: {year: number}} to (key, year, value) rows."""
    outer = keyed_object(spark, path, "map<string,double>", key)
    return outer.select(key, F.explode("value").alias("year", "value")) \
                .withColumn("year", F.col("year").try_cast("int"))


def header_matrix(text: Column) -> Column:
    """JSON array of rows whose first row names the columns, to an array of maps."""
    rows = F.from_json(text, "array<array<string>>")
    return F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))),
                       lambda r: F.map_from_arrays(rows[0], r))


def header_matrix_rows(spark: SparkSession, path: str, cols: Sequence[str]) -> DataFrame:
    """Header-row matrix files, of any size, to records with the named columns. Each file's first row names its columns."""
    def read() -> DataFrame:
        rows = documents.elements(spark, path, end="]").select("path", "start", "k", F.from_json("text", "array<string>").alias("row"))
        # longs alone go through a hash aggregate; least structs or rows would sort all rows of a task
        first = rows.groupBy("path", "start").agg(F.min("k").alias("k")).groupBy("path").agg(F.min(F.struct("start", "k")).alias("top"))
        first = stage(first.select("path", "top.start", "top.k"), "first-rows")
        few = first.limit(documents.BROADCAST_RANGES + 1).count() <= documents.BROADCAST_RANGES  # one row per file
        sent = F.broadcast if few else lambda heads: heads
        heads = stage(rows.join(sent(first), ["path", "start", "k"]).select("path", F.col("start").alias("top_start"), F.col("k").alias("top_k"), F.col("row").alias("names")), "heads")
        body = rows.join(sent(heads), "path").where((F.col("start") != F.col("top_start")) | (F.col("k") != F.col("top_k")))
        place = lambda c: F.array_position("names", c)
        return body.select(*[F.when(place(c) > 0, F.get("row", place(c).cast("int") - 1)).alias(c) for c in cols])
    return _or_empty(spark, ", ".join(f"`{c}` string" for c in cols), read)


def csv_table(spark: SparkSession, path: str, schema: str | T.StructType, encoding: str = "UTF-8",
              by_name: bool = True) -> DataFrame:
    """CSV with a header; a byte-order mark is dropped, columns are taken by name whatever their order."""
    def read() -> DataFrame:
        opts = spark.read.option("header", True).option("encoding", encoding)
        raw = opts.csv(path)
        if not by_name:
            return opts.schema(schema).csv(path)
        have = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
        want = spark.createDataFrame([], schema).schema
        return raw.select(*[(F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None))
                            .try_cast(f.dataType).alias(f.name) for f in want])
    return _or_empty(spark, schema, read)


def split_lines(spark: SparkSession, path: str, sep: str, fields: dict[str, int], min_fields: int) -> DataFrame:
    """Delimited text by position; short lines are dropped. ``fields``: name -> 0-based position."""
    parts = F.split("value", sep)
    schema = ", ".join(f"`{k}` string" for k in fields)
    return _or_empty(spark, schema, lambda: spark.read.text(path).where(F.size(parts) >= min_fields)
                     .select(*[F.trim(parts[i]).alias(k) for k, i in fields.items()]))


def insurance_lines(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited insurance rows: year, place, premium, indemnity; unreadable rows are dropped."""
    raw = split_lines(spark, path, r"\|", {"year": 0, "st": 1, "co": 2, "premium": 11, "indemnity": 12}, 15)
    out = raw.select(X.place_key("st", "co").alias("fips"), F.col("year").try_cast("int").alias("year"),
                     X.parse_number("premium").alias("premium"), X.parse_number("indemnity").alias("indemnity"))
    return out.dropna()


def unemployment_lines(spark: SparkSession, path: str) -> DataFrame:
    """Two text layouts in one folder: tab rows keyed by series id (annual period only), and split-code rows."""
    def read() -> DataFrame:
        line = F.trim("value")
        raw = spark.read.text(path).select(line.alias("l")).where(
            (F.col("l") != "") & ~F.col("l").startswith("series")
            & (~F.col("l").startswith("LAU") | F.col("l").startswith("LAUCN")))
        parts = F.when(F.col("l").contains("\t"), F.split("l", "\t")) \
                 .when(F.col("l").contains("|"), F.split("l", r"\|")).otherwise(F.split("l", r"\s+"))
        raw = raw.withColumn("p", parts)
        part = lambda i: F.trim(F.try_element_at("p", F.lit(i + 1)))
        series = part(0).startswith("LAUCN")
        keep = F.when(series, part(2) == "M13").otherwise(F.size("p") >= 8)
        fips = F.when(series, X.series_place(part(0))).otherwise(X.place_key(part(1), part(2)))
        return raw.where(keep).select(
            fips.alias("fips"), F.when(series, part(1)).otherwise(part(4)).try_cast("int").alias("year"),
            X.finite(F.when(series, part(3)).otherwise(part(7)).try_cast("double")).alias("rate")).dropna()
    return _or_empty(spark, "fips string, year int, rate double", read)


def zipped_rows(spark: SparkSession, path: str, columns: Sequence[str], suffix: str = ".csv", every: bool = False, **options) -> DataFrame:
    """Rows of the first matching member (or, with ``every``, of all) of each zip file below a path, as strings.

    The files' directories are an index; each member is one task's work and only its byte range is read.
    """
    def read() -> DataFrame:
        members = files.zip_members(spark, path, suffix)
        if not every:
            members = members.groupBy("path").agg(F.min_by(F.struct("member", "packed", "size", "method", "offset"), "offset").alias("m")).select("path", "m.*")
        return files.member_rows(members, columns, **options).drop("member")
    return _or_empty(spark, T.StructType([T.StructField(c, T.StringType()) for c in columns]), read)


def time_series(spark: SparkSession, path: str) -> DataFrame:
    """Nested value.timeSeries[] documents to (site, date, value) rows; a document is cut at its series."""
    series = "sourceInfo struct<siteName: string>, values array<struct<value: array<struct<value: string, dateTime: string>>>>"
    flat = "site string, date date, value double"
    return _or_empty(spark, flat, lambda: documents.elements(spark, path, depth=3, outer="{").select(F.from_json("text", series).alias("s"))
                     .select(F.col("s.sourceInfo.siteName").alias("site"), F.explode("s.values").alias("v"))
                     .select("site", F.explode("v.value").alias("r"))
                     .select("site", F.to_date(F.substring("r.dateTime", 1, 10)).alias("date"),
                             X.finite(F.col("r.value").try_cast("double")).alias("value")))


def named_series(text: Column, name: str, close: str = "4. close", volume: str = "5. volume") -> Column:
    """{name: {date: {fields}}} to an array of (date, close, volume)."""
    m = F.try_element_at(F.from_json(text, "map<string, map<string, map<string, string>>>"), F.lit(name))
    return F.transform(F.map_entries(m), lambda e: F.struct(
        F.to_date(e["key"]).alias("date"), e["value"][close].try_cast("double").alias("close"),
        e["value"][volume].try_cast("long").alias("volume")))


def vegetation(df: DataFrame) -> DataFrame:
    """(fips, ndvi array<struct<date, ndvi>>) to scaled rows without fill values."""
    rows = df.select("fips", F.explode("ndvi").alias("r")).select("fips", "r.date", X.ndvi("r.ndvi").alias("ndvi"))
    return rows.where(F.col("ndvi").isNotNull())


def optional(spark: SparkSession, read, schema: T.StructType | str) -> DataFrame:
    """A source that may be missing: an empty typed frame takes its place."""
    return _or_empty(spark, schema, read)


def invalid_documents(docs: DataFrame, key: str, measure: str) -> DataFrame:
    """Placeholders: documents whose key measure is null or unreadable."""
    return docs.where(X.finite(F.col(measure).try_cast("double")).isNull()).select(key)


def swept(spark: SparkSession, path: str, key: str, measure: str, whole: bool = False) -> DataFrame:
    """(path, key, value, reason, text) of every document: JSON objects, one a line or, with ``whole``, one a file.

    reason is null for a good one, else 'blank', 'broken' (no JSON object), 'no key' or 'placeholder' (the measure is
    null, unreadable or infinite); text is kept for those that are not good.
    """
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField(measure, T.StringType()), T.StructField("_corrupt", T.StringType())])
    raw = spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    doc = raw.withColumn("r", F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    number = X.finite(F.col(f"r.{measure}").try_cast("double"))
    object_like = F.trim("text").startswith("{")
    reason = (F.when(F.regexp_like("text", F.lit(r"^\s*$")), "blank").when(F.col("r").isNull() | F.col("r._corrupt").isNotNull() | ~object_like, "broken")
              .when(F.coalesce(F.col(f"r.{key}"), F.lit("")) == "", "no key").when(number.isNull(), "placeholder"))
    out = doc.select("path", F.col(f"r.{key}").alias(key), number.alias(measure), reason.alias("reason"), "text")
    return out.withColumn("text", F.when(F.col("reason").isNotNull(), F.col("text")))


def quarantine(documents: DataFrame, out: str) -> None:
    """Writes swept documents once: good rows below ``state=good``, the others below ``state=bad``, with path and reason."""
    state = F.when(F.col("reason").isNull(), "good").otherwise("bad")
    documents.withColumn("state", state).write.mode("overwrite").partitionBy("state").parquet(out)
