"""What the operators share: reading a table, cutting lineage, and components of a graph."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.text import mix
from kerbline.operators.lineage import checkpoint, shared_folder  # noqa: F401

WORD_SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that df does not have, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


SALTS = 16


def salted_join(large: DataFrame, small: DataFrame, on: str | list[str], by: str, how: str = "inner") -> DataFrame:
    """The join of large and small on columns, rows of a hot key of large dealt to SALTS tasks by another column; small goes to all of them."""
    (salt,) = fresh(large, *fresh(small, "salt"))
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    keys = [on] if isinstance(on, str) else on
    return large.withColumn(salt, F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(copies, [*keys, salt], how).drop(salt)


BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most about BATCH_BYTES from here on: rows alone don't bound the memory of batches of long texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of an edge the smallest node that it reaches. Large-star and small-star rounds.

    A round costs two aggregations with map-side minima and two joins on the node; a hot node's rows are never gathered.
    Loops and repeated edges change nothing; no edges give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, seen = checkpoint(e), None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = checkpoint(small.select("x.*").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())


FILTER_BITS, FILTER_PARTS = 23, 64


def marked(keys: DataFrame, filter_bits: int = FILTER_BITS):
    """A test, for arrays of 64-bit keys, that all keys of the one column pass and few others do: a filter of 2 ** filter_bits bits, whatever
    the number of keys (by default 1 MB at the driver and in each task). With a number of keys near 2 ** filter_bits it only sieves less.
    """
    name = keys.columns[0]

    def marks(batches):
        bits = np.zeros(1 << filter_bits, bool)
        for batch in batches:
            bits[spot(batch.column(name).to_numpy(zero_copy_only=False), filter_bits)] = True
        parts = np.packbits(bits).reshape(FILTER_PARTS, -1)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()), "marks": pa.array([zlib.compress(parts[i].tobytes(), 1) for i in some], pa.binary())})

    def either(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(blob), np.uint8)
                total[part] = total[part] | x if part in total else x
        if total:
            yield pa.RecordBatch.from_pydict({"part": pa.array(total, pa.int32()), "marks": pa.array([x.tobytes() for x in total.values()], pa.binary())})

    every = np.zeros((FILTER_PARTS, (1 << filter_bits) // 8 // FILTER_PARTS), np.uint8)
    for part, blob in keys.mapInArrow(marks, "part int, marks binary").repartition(FILTER_PARTS, "part").mapInArrow(either, "part int, marks binary").collect():
        every[part] = np.frombuffer(blob, np.uint8)
    held = keys.sparkSession.sparkContext.broadcast(every.tobytes())
    unpacked: list[np.ndarray] = []

    def test(key: np.ndarray) -> np.ndarray:
        if not unpacked:
            unpacked.append(np.frombuffer(held.value, np.uint8))
        at = spot(key, filter_bits)
        return (unpacked[0][at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)

    return test


def column_test(test):
    """A test of marked as a function of a column."""

    @F.pandas_udf("boolean")
    def passes(key: pd.Series) -> pd.Series:
        return pd.Series(test(key.to_numpy()))

    return passes


def spot(key: np.ndarray, filter_bits: int = FILTER_BITS) -> np.ndarray:
    """A key's place in the filter."""
    return (mix(key.astype(np.int64).view(np.uint64)) >> np.uint64(64 - filter_bits)).astype(np.int64)
