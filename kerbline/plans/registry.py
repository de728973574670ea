"""All queries of the library and the SQL that states their results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kerbline.plans import areas, base, geometry, network, relational, routes  # noqa: F401  each registers its queries


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct transit lines between two points, the five cheapest."""
    return base.QUERIES["top-04"](spark, sf_dir)
