"""How queries are registered: a function of the relations, and the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.plans import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PI, HALF = "3.141592653589793", "1.5707963267948966"


class Tables:
    """The relations of one data folder, each made once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = fixtures.relation(self.spark, self.sf_dir, name)
        return self._made[name]


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[name] = fixtures.oracle(sql)
        return f

    return add


def r6(x: Column) -> Column:
    """Rounded for comparison between engines, without a negative zero."""
    y = F.round(x, 6)
    return F.when(y == 0, 0.0).otherwise(y)


def s6(x: str) -> str:
    return f"(CASE WHEN round({x}, 6) = 0 THEN 0.0::DOUBLE ELSE round({x}, 6) END)"


def angular(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    a = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lng2} - {lng1}) / 2), 2))"
    return f"(2 * atan2(sqrt({a}), sqrt(1 - {a})))"


def km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return f"({angular(lat1, lng1, lat2, lng2)} * 6371.0)"


def planar(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return f"sqrt(pow(radians({lng1}) - radians({lng2}), 2) + pow(radians({lat1}) - radians({lat2}), 2))"


def within(lat: str, lng: str, at_lat: float, at_lng: float, radius: float) -> str:
    """The box and the planar radian distance, far from poles and the antimeridian."""
    d = f"({radius} / 6371.0)"
    half = f"asin(sin({d}) / cos(radians({at_lat})))"
    return (
        f"(radians({lat}) >= radians({at_lat}) - {d} AND radians({lat}) <= radians({at_lat}) + {d} AND radians({lng}) >= radians({at_lng}) - {half}"
        f" AND radians({lng}) <= radians({at_lng}) + {half} AND {planar(lat, lng, str(at_lat), str(at_lng))} <= {d})"
    )
