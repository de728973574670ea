"""Quality classifier: histogram gradient-boosted trees over document statistics, traversed as flat arrays.

The statistics come from whole texts, a block at a time, in numpy. Trees are grown level by level: each feature's values are cut
into BINS bins once, and a level's best splits come from histograms of gradients by node, feature and bin. The
finished trees are arrays of feature, threshold, children and value, through which all documents of a batch step at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import text as T
from kerbline.llm.common import bounded_batches, table

BINS, DEPTH, TREES, RATE, LEAST_ROWS = 64, 4, 60, 0.15, 20
FEATURES = (
    "log_words", "word_length", "word_length_spread", "upper", "digits", "bars", "bangs", "symbols", "sentence_marks", "commas", "newlines", "beyond_ascii",
    "distinct_words", "same_as_before", "top_word", "distinct_triples", "upper_words", "marked_words", "one_letter_words", "ended_words",
)
_CLASSES = np.zeros((8, 256), bool)
_CLASSES[0, 65:91] = _CLASSES[1, 48:58] = _CLASSES[6, 128:192] = True  # upper case, digits, bytes within a longer character
_CLASSES[2, ord("|")] = _CLASSES[3, ord("!")] = _CLASSES[5, 10] = True
for _c in "#$%&*+=@^_~<>\\/{}[]":
    _CLASSES[4, ord(_c)] = True
_CLASSES[7, 192:] = True


def statistics(column: pa.Array) -> np.ndarray:
    """FEATURES of each text, as rows of floats; a null or empty text has zeros."""
    data, offsets = T.utf8(column)
    out = np.zeros((len(column), len(FEATURES)), np.float32)
    for a, h, at, s, e in T.words(column, spans=True):
        rows = len(at) - 1
        n = np.diff(at).astype(np.float64)
        part = data[offsets[a] : offsets[a + rows]]
        chars = np.maximum(np.diff(offsets[a : a + rows + 1]), 1).astype(np.float64)
        row = np.repeat(np.arange(rows), np.diff(at))
        per = lambda x: np.bincount(row, x, rows) / np.maximum(n, 1)
        own = np.repeat(np.arange(rows), np.diff(offsets[a : a + rows + 1]))
        share = [np.bincount(own[_CLASSES[k][part]], minlength=rows) / chars for k in range(8)]
        place = s + (offsets[a : a + rows] - offsets[a])[row]
        end = e + (offsets[a : a + rows] - offsets[a])[row]
        length = (e - s).astype(np.float64)
        mean = per(length)
        first, last = (part[place], part[end - 1]) if len(place) else (part[:0], part[:0])
        second = part[np.minimum(place + 1, len(part) - 1)] if len(place) else part[:0]
        same = np.zeros(len(h))
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        order = np.lexsort((h, row))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])]) if len(h) else np.zeros(0, bool)
        distinct = np.bincount(row[order][new], minlength=rows)
        top = np.zeros(rows)
        if len(h):
            starts = np.flatnonzero(new)
            np.maximum.at(top, row[order][starts], np.diff(np.concatenate([starts, [len(h)]])))
        triples, to = T.shingles(h, at, 3)
        own3 = np.repeat(np.arange(rows), np.diff(to))
        order = np.lexsort((triples, own3))
        new = np.concatenate([[True], (triples[order][1:] != triples[order][:-1]) | (own3[order][1:] != own3[order][:-1])]) if len(triples) else np.zeros(0, bool)
        upper = lambda x: (x >= 65) & (x <= 90)
        marks = _CLASSES[4] | _CLASSES[3]
        out[a : a + rows] = np.stack([
            np.log1p(n), mean, np.sqrt(np.maximum(per(length * length) - mean * mean, 0)), *share[:6][:2], share[2], share[3], share[4],
            per(np.isin(last, (46, 63))), per(last == 44), share[5], share[6] + share[7],
            distinct / np.maximum(n, 1), per(same), top / np.maximum(n, 1), np.bincount(own3[order][new], minlength=rows) / np.maximum(np.diff(to), 1),
            per(upper(first) & (upper(second) | (length < 2))), per(marks[last]), per(length == 1), per(np.isin(last, (44, 46, 58, 59, 63))),
        ], axis=1)
    return out


@dataclass
class Trees:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: list[int]
    start: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees of logistic loss for labels 0 or 1. A leaf is its own child, so that every walk takes DEPTH steps."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    score = np.full(len(y), np.log(rate / (1 - rate)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        value = lambda rows: -RATE * g[rows].sum() / (h[rows].sum() + 1.0)
        roots.append(len(nodes))
        nodes.append([0, np.inf, len(nodes), len(nodes), value(slice(None))])
        level = [(roots[-1], np.arange(len(y)))]
        for _ in range(DEPTH):
            below = []
            for at, rows in level:
                if len(rows) < 2 * LEAST_ROWS:
                    continue
                flat = (binned[rows] + np.arange(x.shape[1]) * BINS).ravel()
                hist = [np.bincount(flat, np.repeat(w, x.shape[1]), BINS * x.shape[1]).reshape(-1, BINS) for w in (g[rows], h[rows], np.ones(len(rows)))]
                gl, hl, nl = (np.cumsum(v, 1) for v in hist)
                gr, hr, nr = gl[:, -1:] - gl, hl[:, -1:] - hl, nl[:, -1:] - nl
                gain = np.where((nl >= LEAST_ROWS) & (nr >= LEAST_ROWS), gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl[:, -1:] ** 2) / (hl[:, -1:] + 1), -1)
                f, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[f, b] <= 1e-6 or b >= len(cuts[f]):
                    continue
                goes = binned[rows, f] <= b
                for side in (rows[goes], rows[~goes]):
                    below.append((len(nodes), side))
                    nodes.append([0, np.inf, len(nodes), len(nodes), value(side)])
                nodes[at][:4] = [int(f), float(cuts[f][b]), len(nodes) - 2, len(nodes) - 1]
            level = below
        made = _flat(nodes, [roots[-1]], 0.0)
        node = np.full(len(y), roots[-1])
        for _ in range(DEPTH):
            node = np.where(x[np.arange(len(y)), made.feature[node]] <= made.threshold[node], made.left[node], made.right[node])
        score += made.value[node]
    return _flat(nodes, roots, float(np.log(rate / (1 - rate))))


def _flat(nodes: list[list], roots: list[int], start: float) -> Trees:
    column = lambda k, kind: np.array([n[k] for n in nodes], kind)
    return Trees(column(0, np.int64), column(1, np.float64), column(2, np.int64), column(3, np.int64), column(4, np.float64), roots, start)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 20_000) -> Trees:
    """Trees from docs (doc_id, text) and labels (doc_id, quality 0/1); labels of other values are left out.

    It learns from at most `rows` labelled documents, those of least hash, whatever the input's size; only their statistics
    reach the driver, one row an id: of repeated rows of an id the one whose statistics come first. Labels of no or one class give a constant score.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    chosen = labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most `rows` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "quality": batch.column("quality"), "x": pa.array([r.tobytes() for r in x], pa.binary())})
        T.tidy()

    bounded_batches(docs.sparkSession)
    one = texts.mapInArrow(run, "doc_id long, quality double, x binary").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("x").alias("x"))
    got = one.toPandas().sort_values(["doc_id", "x"])  # at most `rows` rows
    if not len(got):
        return _flat([[0, np.inf, 0, 0, 0.0]], [], 0.0)
    x = np.stack([np.frombuffer(v, np.float32) for v in got.x]).astype(np.float64)
    return grow(x, got.quality.to_numpy())


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """docs with a column quality_score (0 to 1) for every row, of its whole text; a null text scores as an empty one.

    All columns and repeated rows stay; a column named quality_score is replaced. No rows: none.
    """
    docs = docs.drop("quality_score")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("quality_score", pa.array(held.value.predict(statistics(batch.column("text").cast(pa.string())).astype(np.float64)), pa.float64()))
        T.tidy()

    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.withColumn("quality_score", F.lit(0.0)).schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels").where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))
