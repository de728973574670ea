"""Ramps and their associations from delimited text. The parse functions take lines (value), the read functions paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NUMBER = r"(-?[0-9.]+(?:[eE]-?[0-9]+)?)"


def parse_points(lines: DataFrame) -> DataFrame:
    """Semicolon-separated lines whose first field is `POINT (lng lat)` and whose sixth is an address."""
    row = F.from_csv("value", "point string, b string, c string, d string, e string, address string", {"sep": ";"})
    rows = lines.select(row.alias("r"))
    pattern = rf"POINT ?\( *{_NUMBER} +{_NUMBER} *\)"
    return rows.select(F.regexp_extract("r.point", pattern, 2).try_cast("double").alias("lat"), F.regexp_extract("r.point", pattern, 1).try_cast("double").alias("lng"), "r.address").where("lat is not null")


def parse_plain(lines: DataFrame) -> DataFrame:
    """Semicolon-separated lines of longitude, latitude and address."""
    return lines.select(F.from_csv("value", "lng double, lat double, address string", {"sep": ";"}).alias("r")).select("r.lat", "r.lng", "r.address").where("lat is not null")


def parse_associations(lines: DataFrame) -> DataFrame:
    """Comma-separated lines of ramp, vertex and crossing."""
    return lines.select(F.from_csv("value", "rampId bigint, vertexId bigint, crossingId bigint").alias("r")).select("r.*")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return parse_points(_without_header(spark, path))


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    return parse_plain(_without_header(spark, path))


def read_associations(spark: SparkSession, path: str) -> DataFrame:
    return parse_associations(spark.read.text(path).where("value <> ''"))


def _without_header(spark: SparkSession, path: str) -> DataFrame:
    """All lines with a digit: a header names its fields and has none."""
    lines = spark.read.text(path)
    return lines.where(F.regexp_like("value", F.lit("[0-9]")) & (F.col("value") != ""))


def concat(sources: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sources)
