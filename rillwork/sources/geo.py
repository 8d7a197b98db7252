"""GeoJSON scan and sink; geometry thinning and centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rillwork.sources import documents

POLYGON = "array<array<array<double>>>"
MULTI = "array<array<array<array<double>>>>"


def _collections(spark: SparkSession, path: str) -> DataFrame:
    feature = "struct<type: string, id: string, properties: map<string,string>, geometry: struct<type: string, coordinates: string>>"
    return documents.elements(spark, path, depth=2, outer="{").select(F.from_json("text", feature).alias("f")).where("f.type = 'Feature'")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Feature collections, of any size, to rows: id, properties, geometry type and rings (one array level for both kinds)."""
    return _typed(_collections(spark, path))


def read_feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited features (one per line): files of any size split across tasks."""
    feature = "struct<id: string, properties: map<string,string>, geometry: struct<type: string, coordinates: string>>"
    return _typed(spark.read.text(path).select(F.from_json("value", feature).alias("f")))


def _typed(df: DataFrame) -> DataFrame:
    kind, text = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    rings = F.when(kind == "MultiPolygon", F.flatten(F.from_json(text, MULTI))) \
             .when(kind == "Polygon", F.from_json(text, POLYGON))
    return df.select(F.col("f.id").alias("id"), F.col("f.properties").alias("properties"), kind.alias("kind"),
                     text.alias("coordinates"), rings.alias("rings"))


def centre(rings: Column, digits: int = 4) -> Column:
    """Plain mean of all vertices."""
    pts = F.flatten(rings)
    n = F.size(pts)
    mean = lambda i: F.round(F.aggregate(pts, F.lit(0.0), lambda a, p: a + p[i]) / n, digits)
    return F.when(n > 0, F.struct(mean(0).alias("lon"), mean(1).alias("lat")))


def thin(rings: Column, digits: int = 1) -> Column:
    """Round every coordinate."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: F.transform(p, lambda v: F.round(v, digits))))


def thin_text(kind: Column, coordinates: Column, digits: int = 1) -> Column:
    """Rounded coordinates as JSON text, for both geometry kinds."""
    multi = F.transform(F.from_json(coordinates, MULTI), lambda g: thin(g, digits))
    return F.when(kind == "MultiPolygon", F.to_json(multi)).otherwise(F.to_json(thin(F.from_json(coordinates, POLYGON), digits)))


def merge_properties(features: DataFrame, metrics: DataFrame, on: str, keep_unmatched: bool) -> DataFrame:
    """Attach metric columns to features; unmatched features keep their bare properties or drop out."""
    return features.join(metrics, on, "left" if keep_unmatched else "inner")


def feature_text(props: list[str], kind: str = "kind", coordinates: str = "coordinates", id_col: str = "id") -> Column:
    """One feature as JSON text."""
    return F.concat(
        F.lit('{"type":"Feature","id":'), F.to_json(F.struct(F.col(id_col).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(id_col).alias("v")))) - 6),
        F.lit(',"properties":'), F.to_json(F.struct(*props), {"ignoreNullFields": "false"}),
        F.lit(',"geometry":{"type":"'), F.col(kind), F.lit('","coordinates":'), F.col(coordinates), F.lit("}}"))


def write_feature_lines(df: DataFrame, props: list[str], path: str) -> None:
    """Newline-delimited features, written in parallel."""
    df.select(feature_text(props).alias("value")).write.mode("overwrite").text(path)


def write_collections(df: DataFrame, props: list[str], path: str) -> None:
    """A folder of feature collections, one from each task."""
    documents.write_documents(df.select(feature_text(props).alias("value")), path, '{"type":"FeatureCollection","features":[', "]}")
