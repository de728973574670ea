"""Greedy clustering of stops: the first by id of those left takes all within the radius, again and again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.lineage import checkpoint
from kerbline.operators.overlay import curve
from kerbline.operators.spatial import within_distance
from kerbline.operators.tables import dense_ids

#: Pairs that a block holds in the first round, and at most in later ones.
FIRST, MOST = 4096, 1 << 18


def _chosen(pairs: pd.DataFrame) -> pd.DataFrame:
    """(id, leads) for the places of a block, as far as its pairs (a, b, inside) tell. Whether a place outside leads is unknown."""
    state = dict.fromkeys(set(pairs.a[pairs.inside]) - set(pairs.b), True)
    pairs = pairs.sort_values("b")
    now, lead, sure = None, False, True
    for a, b, inside in zip(pairs.a.tolist(), pairs.b.tolist(), pairs.inside.tolist(), strict=True):
        if b != now:
            if now is not None and (lead or sure):
                state[now] = not lead
            now, lead, sure = b, False, True
        known = state.get(a) if inside else None
        lead, sure = lead or known is True, sure and known is not None
    if lead or sure:
        state[now] = not lead
    return pd.DataFrame({"id": pd.Series(list(state), dtype="int64"), "leads": pd.Series(list(state.values()), dtype="bool")})


def _leaders(close: DataFrame, places: DataFrame) -> DataFrame:
    """(id) of the places of pairs (a, b; a first) that lead: those with no leading place before them in a pair."""
    # pairs are numbered by their later place along the curve, so that blocks hold neighbours and are of even size
    single = close.select(F.explode(F.array("a", "b")).alias("b")).distinct().select(F.lit(None).cast("long").alias("a"), "b")
    key = places.select(F.col("id").alias("b"), curve("lat", "lng").alias("key"))
    ranked = dense_ids(close.select("a", "b").unionByName(single).join(key, "b"), ["key", "b", "a"], "z")
    degree = close.groupBy(F.col("b").alias("id")).agg((F.count("*") > MOST).alias("hot"))
    at = checkpoint(ranked.where("a is null").select(F.col("b").alias("id"), "z").join(degree, "id", "left").select("id", "z", F.coalesce("hot", F.lit(False)).alias("hot")))
    end = lambda c: at.select(F.col("id").alias(c), F.col("z").alias(f"z{c}"), F.col("hot").alias(f"hot_{c}"))
    left, found, width = checkpoint(close.join(end("a"), "a").join(end("b"), "b")), [close.select(F.col("a").alias("id")).where("false")], FIRST
    while not left.isEmpty():
        block = lambda c, width=width: F.floor(F.col(c) / width)
        # a place with more pairs than a block holds is decided by the joins below alone
        inside = (block("za") == block("zb")) & ~F.col("hot_a")
        inner = left.where("not hot_b").select(block("zb").alias("block"), "a", "b", inside.alias("inside")).groupBy("block").applyInPandas(lambda pairs: _chosen(pairs), "id long, leads boolean")
        first = left.select(F.col("a").alias("id")).distinct().join(left.select(F.col("b").alias("id")), "id", "left_anti").withColumn("leads", F.lit(True))
        chosen = checkpoint(inner.union(first).distinct())
        followers = left.join(chosen.where("leads").select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id"), F.lit(False).alias("leads"))
        state = checkpoint(chosen.union(followers).distinct())
        known = lambda c, state=state: state.select(F.col("id").alias(c))
        rest = checkpoint(left.join(known("a"), "a", "left_anti").join(known("b"), "b", "left_anti"))
        # a place whose earlier neighbours all follow others has lost its pairs with them, and leads
        both = lambda df: df.select(F.explode(F.array("a", "b")).alias("id"))
        found += [state.where("leads").select("id"), both(left).distinct().join(known("id"), "id", "left_anti").join(both(rest), "id", "left_anti")]
        left, width = rest, min(4 * width, MOST)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    return checkpoint(every.distinct())


def cluster(stops: DataFrame, km: float) -> DataFrame:
    """(id, leader) for stops (id, lat, lng), as one by one: the first place left leads, and those close to it that are left follow.

    Stops of equal coordinates are one place, named by its least id. Who leads is decided within blocks of neighbouring places, each in one task, as far
    as their pairs tell; what hangs on other blocks is left for the next round, whose blocks are four times as large, up to MOST pairs. So a run of
    rising ids takes a logarithm of rounds, and beyond MOST one for each MOST of its pairs. At the end each follower takes its least leader,
    which would have come first. Stops without a place or id are left out.
    """
    stops = stops.select("id", "lat", "lng").where("id is not null and lat is not null and lng is not null")
    places = checkpoint(stops.groupBy("lat", "lng").agg(F.min("id").alias("id")))
    close = checkpoint(within_distance(places, places, km, "haversine").where("l.id < r.id").select(F.col("l.id").alias("a"), F.col("r.id").alias("b")))
    leaders = _leaders(close, places)
    least = close.join(leaders.select(F.col("id").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("id")).agg(F.min("a").alias("leader"))
    places = places.join(least.join(leaders, "id", "left_anti"), "id", "left")
    return stops.join(places.withColumnRenamed("id", "place"), ["lat", "lng"]).select("id", F.coalesce("leader", "place").alias("leader"))
