"""Hard negatives by cover trees over norm-augmented vectors.

A coordinate sqrt(M * M - |x| * |x|) makes all candidates equally long (M), so a large inner product with a query is a small distance, and a ball of
points around a centre bounds the inner products of all points in it from both sides.

Candidates are dealt to cells: the top level is a net of centres picked farthest first from a bounded sample (CENTRES of SAMPLE rows), each row
belongs to its nearest centre, and what gathers there beyond CELL rows is dealt to several cells. A task makes the cover tree of one cell: a node's points are
covered by a net of smaller balls, level by level, and each node keeps its true covering radius. Queries, in blocks, meet every cell; a best-first
descent takes the node of the highest bound, skips nodes whose bounds lie outside all windows of scores still open, or below the k best found, and
verifies leaves by exact integer inner products. So results are exact; the sample decides only how much is skipped.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.llm.common import checkpoint, table

CENTRES, SAMPLE, CELL, LEAF, QUERIES, BASE = 64, 4096, 2048, 32, 1024, 1.5
EXACT = 1 << 53  # whole numbers below are exact as floats

# cover trees ---------------------------------------------------------------------------------------------------------------


def matrix(vectors) -> np.ndarray:
    """Vectors as rows of whole numbers; shorter ones are filled with zeros. Objects if they don't fit."""
    vectors = [np.asarray(v) for v in vectors]
    out = np.zeros((len(vectors), max(map(len, vectors), default=0)), np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def net(points: np.ndarray, first: int, radius: float, most: int | None = None, worth: int = 0) -> tuple[list[int], np.ndarray, np.ndarray] | None:
    """Centres (of points) farthest first until all points lie within radius of one or there are `most`, each point's nearest centre, and its distance.

    With worth, None as soon as 16 centres or more cover fewer than worth points each.
    """
    centres, own, far = [first], np.zeros(len(points), np.int64), np.linalg.norm(points - points[first], axis=1)
    while (most is None or len(centres) < most) and far.max(initial=0.0) > radius:
        if worth and len(centres) >= 16 and (far <= radius).sum() < worth * len(centres):
            return None
        c = int(far.argmax())
        d = np.linalg.norm(points - points[c], axis=1)
        own[d < far], far = len(centres), np.minimum(d, far)
        centres.append(c)
    return centres, own, far


class CoverTree:
    """A cover tree of vectors (whole numbers, a row each) with their ids and labels; points of a node are neighbours in the arrays."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        x = vectors.astype(float)
        squares = (x * x).sum(1)
        self.square = float(squares.max(initial=0.0))  # of the augmented norm
        points = np.column_stack([x, np.sqrt(np.maximum(self.square - squares, 0))])
        order = np.arange(len(points))
        first = int(np.linalg.norm(points - points.mean(0), axis=1).argmin()) if len(points) else 0
        # nodes: centre, covering radius, range of points, range of children
        nodes = [[first, float(np.linalg.norm(points - points[first], axis=1).max(initial=0.0)), 0, len(points), 0, 0]]
        at = 0
        while at < len(nodes):
            centre, radius, begin, end, *_ = nodes[at]
            within, found, scale = order[begin:end].copy(), None, radius
            if end - begin > leaf and radius > 0:
                where = int(np.flatnonzero(within == centre)[0])
                found = ([where], None, None)
                while found is not None and len(found[0]) == 1:  # levels at which one ball holds all are skipped
                    scale /= BASE
                    found = net(points[within], where, scale, worth=2)
            if found is not None:
                centres, own, far = found
                nodes[at][4], nodes[at][5] = len(nodes), len(nodes) + len(centres)
                by = np.argsort(own, kind="stable")
                sizes = np.bincount(own, minlength=len(centres))
                to = np.cumsum(sizes)
                order[begin:end] = within[by]
                for k, c in enumerate(centres):
                    nodes.append([int(within[c]), float(far[own == k].max(initial=0.0)), begin + int(to[k] - sizes[k]), begin + int(to[k]), 0, 0])
            at += 1
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.centre, self.radius = rank[[n[0] for n in nodes]], np.array([n[1] for n in nodes])
        self.ranges = [tuple(n[2:]) for n in nodes]
        self.most, self.floats = largest(vectors), None

    def products(self, rows, q: np.ndarray) -> np.ndarray:
        """Exact inner products of rows (a slice or array) with a query of whole numbers."""
        n = min(self.vectors.shape[1], len(q))
        q = q[:n]
        if self.most * largest(q) * max(n, 1) < EXACT:
            if self.floats is None:
                self.floats = self.vectors.astype(float)
            return (self.floats[rows, :n] @ q.astype(float)).astype(np.int64)
        return np.array([sum(int(a) * int(b) for a, b in zip(v, q, strict=True)) for v in self.vectors[rows, :n]], object)

    def best(self, q: np.ndarray, windows: list[tuple], k: int, takes) -> list[list[tuple]]:
        """For each window (least, most) of scores, None for open ends, its k best (score, id), higher scores and smaller ids first. takes(ids, labels) says which points count."""
        own = float((q[: self.vectors.shape[1]].astype(float) ** 2).sum())
        total = own + self.square
        slack = 1e-9 * (total + 1)
        found: list[list[tuple]] = [[] for _ in windows]
        low = [-np.inf if w[0] is None else w[0] for w in windows]  # rises with the k-th best
        high = [np.inf if w[1] is None else w[1] for w in windows]
        top = max(high, default=0)
        heap: list[tuple[float, float, int]] = []

        def push(some: np.ndarray) -> None:
            d = np.sqrt(np.maximum(total - 2 * self.products(self.centre[some], q).astype(float), 0))
            radius = self.radius[some]
            most = (total - np.maximum(d - radius, 0) ** 2) / 2 + slack
            least = (total - (d + radius) ** 2) / 2 - slack
            for node, a, b in zip(some.tolist(), least.tolist(), most.tolist(), strict=True):
                if any(b >= x and a <= y and x <= y for x, y in zip(low, high, strict=True)):
                    heapq.heappush(heap, (-min(b, top), a, node))

        if len(self.ids) and windows:
            push(np.array([0]))
        while heap:
            bound, least, node = heapq.heappop(heap)
            if not any(-bound >= x and least <= y for x, y in zip(low, high, strict=True)):
                continue
            begin, end, child, last = self.ranges[node]
            if child:
                push(np.arange(child, last))
                continue
            score, ids = self.products(slice(begin, end), q), self.ids[begin:end]
            counts = takes(ids, self.labels[begin:end])
            for j in range(len(windows)):
                some = np.flatnonzero(counts & (score >= low[j]) & (score <= high[j]))
                if len(some) > 4 * k and score.dtype != object:  # those below the k-th score of these alone are none of the best
                    some = some[score[some] >= np.partition(score[some], len(some) - k)[len(some) - k]]
                if len(some):
                    found[j] = sorted([*found[j], *((-s, i) for s, i in zip(score[some].tolist(), ids[some].tolist(), strict=True))])[:k]
                    if len(found[j]) == k:
                        low[j] = max(low[j], -found[j][-1][0])
        return [[(-s, i) for s, i in f] for f in found]


# the index and its search --------------------------------------------------------------------------------------------------


def build_index(rows: DataFrame) -> tuple[DataFrame, int]:
    """(cell, tree) of all rows (id, label, v), and the number of cells, counted from 0. A cell holds about CELL rows.

    The centres come from the SAMPLE rows of least hash; every row is in the index.
    """
    sample = matrix([r.v for r in rows.orderBy(F.xxhash64("id", F.lit(11)), "id").limit(SAMPLE).select("v").collect()]).astype(float)
    count, square = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()
    if not count:
        return rows.sparkSession.createDataFrame([], "cell long, tree binary"), 0
    augmented = lambda x: np.column_stack([x, np.sqrt(np.maximum(square - (x * x).sum(1), 0))])
    points = augmented(sample)
    centres = sample[net(points, 0, 0.0, most=max(1, min(CENTRES, -(-count // CELL))))[0]]

    def nearest(batches):
        for batch in batches:
            x = matrix(batch["v"]).astype(float)
            n = max(x.shape[1], centres.shape[1])
            a, c = (augmented(np.pad(m, ((0, 0), (0, n - m.shape[1])))) for m in (x, centres))
            yield batch.assign(centre=(-2 * a @ c.T + (c * c).sum(1)).argmin(1) if len(batch) else np.zeros(0, np.int64))

    dealt = checkpoint(rows.select("id", "label", "v").mapInPandas(nearest, "id long, label long, v array<long>, centre long"))
    # at most CENTRES rows
    parts = [(r.centre, -(-r.n // CELL)) for r in dealt.groupBy("centre").agg(F.count("*").alias("n")).orderBy("centre").collect()]
    first = np.concatenate([[0], np.cumsum([n for _, n in parts])])
    known = F.create_map(*[F.lit(x) for (c, n), a in zip(parts, first.tolist(), strict=False) for x in (c, F.struct(F.lit(a).alias("first"), F.lit(n).alias("parts")))])
    own = known[F.col("centre")]
    cell = (own["first"] + F.pmod(F.xxhash64("id", F.lit(12)), own["parts"])).cast("long")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        tree = CoverTree(group["id"].to_numpy(), group["label"].to_numpy(), matrix(group["v"]))
        return pd.DataFrame({"cell": [group["cell"].iloc[0]], "tree": [pickle.dumps(tree)]})

    trees = dealt.withColumn("cell", cell).groupBy("cell").applyInPandas(build, "cell long, tree binary")
    return checkpoint(trees), int(first[-1])


def search(index: DataFrame, cells: int, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(query, window, score, id): the k best candidates of each window of each query (id, label, v, windows array of (least, most)), those of the query's
    label or of others, never itself. Each cell gives its own k best; the best of all cells are kept."""
    blocks = max(1, -(-queries.count() // QUERIES))
    asked = queries.select("id", "label", "v", "windows", F.pmod(F.xxhash64("id", F.lit(13)), F.lit(blocks)).cast("long").alias("block"))
    asked = asked.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def found(trees: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in trees["tree"]:
            tree = pickle.loads(blob)
            for own, label, v, windows in zip(asked["id"], asked["label"], asked["v"], asked["windows"], strict=True):
                takes = lambda ids, labels, own=own, label=label: ((labels == label) == same) & (ids != own)
                best = tree.best(np.asarray(v), [(w["least"], w["most"]) for w in windows], k, takes)
                out += [(own, j, max(-(1 << 63), min(s, (1 << 63) - 1)), i) for j, rows in enumerate(best) for s, i in rows]
        return pd.DataFrame(out, columns=["query", "window", "score", "id"]).astype("int64")

    every = held.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInPandas(found, "query long, window long, score long, id long")
    rank = F.row_number().over(Window.partitionBy("query", "window").orderBy(F.desc("score"), "id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)


def mine(rows: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, label, v array of whole numbers, anchor boolean).

    An anchor's positives are its best other rows of the same label by inner product; for each, the best rows of other labels are returned whose score is
    from low to high percent of the positive's. Higher scores first, ties by smaller id. Fewer rows, none, or an anchor without positives, give as
    many results as there are. Rows without id, label or vector take no part; of rows of one id that of the least (label, vector) counts. Missing
    components of shorter vectors are zeros. Scores must fit 64 bits (others are cut to that range in the result). Other columns are not read.
    """
    rows = rows.where("id is not null and label is not null and v is not null").groupBy("id").agg(F.min(F.struct(F.col("label").cast("long").alias("label"), "v", "anchor")).alias("row"))
    rows = checkpoint(rows.select("id", "row.*"))
    index, cells = build_index(rows)
    if not cells:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    anchors = rows.where("anchor").select("id", "label", "v")
    window = lambda least, most: F.struct(least.cast("long").alias("least"), most.cast("long").alias("most"))
    open_ = F.array(window(F.lit(None), F.lit(None)))
    near = checkpoint(search(index, cells, anchors.withColumn("windows", open_), positives, True).select("query", F.col("rank").alias("place"), "id", "score"))
    whole = lambda percent: F.col("score").cast("decimal(20,0)") * percent / 100
    # a negative score leaves no room between low and high percent of it
    bounds = F.transform(F.sort_array(F.collect_list(F.struct("place", F.ceil(whole(low)).alias("least"), F.floor(whole(high)).alias("most")))), lambda x: window(x["least"], x["most"]))
    asked = anchors.join(near.groupBy(F.col("query").alias("id")).agg(bounds.alias("windows")), "id")
    got = search(index, cells, asked, negatives, False).withColumn("place", (F.col("window") + 1).cast("int"))
    found = got.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(near.withColumnsRenamed({"id": "positive_id", "score": "positive_score"}), ["query", "place"])
    return found.select(F.col("query").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def finite(vector: Column) -> Column:
    """Whether no component is null or not finite."""
    return F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("vec_id is not null and label is not null and embedding is not null").where(finite(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return mine(rows.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), v.alias("v"), (F.col("vec_id") % 100 == 0).alias("anchor")))


ORACLE_SQL = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
  FROM p JOIN s ON s.anchor_id = p.anchor_id WHERE NOT s.same AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
