"""Toxicity: a subsequence string kernel with Nyström landmarks and a support vector machine over sentences.

The kernel counts shared three-letter subsequences whose letters stand at most three places apart, each gap place
weighted by DECAY, so that an insult with inserted letters still resembles itself. Landmarks are words or beginnings of
words that labelled toxic texts have and clean ones have not. A sentence's features are its similarity to each landmark summed over its words, and that of
its whole text per 100 words, mapped by the inverse root of the landmarks' own kernel matrix. A toxic text need only hold one toxic
sentence: the machine is refitted on the most toxic sentence of each toxic text and all sentences of the clean ones. A text's
score is that of its most toxic sentence, through a logistic curve fitted on the same texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.llm import text as T
from kerbline.llm.common import WORD_SEPARATORS, bounded_batches, table

DECAY, REACH, LEAST, POWER, LETTERS, CACHED_WORDS = 0.75, 3, 0.45, 3, 32, 300_000
_STEPS = [(a, b) for a in range(1, REACH + 1) for b in range(1, REACH + 1)]
STARTS = (4, 5, 6, 7, 8, 9, 10)
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def _codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, subsequence, weight, end in the word) of all subsequences; punctuation doesn't count, letters outside a-z share a few codes."""
    clean = [w.translate(None, _PUNCTUATION).lower() for w in words]
    data = np.frombuffer(b"".join(clean), np.uint8).astype(np.int32)
    length = np.array([len(w) for w in clean], np.int64)
    letter = np.where((data >= 97) & (data <= 122), data - 97, 26 + data % 6)
    own = np.repeat(np.arange(len(words)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(data))  # letters from here to the word's end
    place = length[own] - left
    found = []
    for a, b in _STEPS:
        at = np.flatnonzero(left > a + b)
        found.append((own[at], (letter[at] * LETTERS + letter[at + a]) * LETTERS + letter[at + a + b], np.full(len(at), DECAY ** (a + b - 2), np.float32), place[at] + a + b + 1))
    return tuple(np.concatenate([x[k] for x in found]) for k in range(4))


def _norms(own: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    key, at = np.unique(own * LETTERS**3 + code, return_inverse=True)
    total = np.bincount(at, weight, len(key))
    return np.sqrt(np.bincount(key // LETTERS**3, total * total, n)) + 1e-12


class Landmarks:
    """Normalised kernel values of words against the landmark words."""

    def __init__(self, words: list[bytes]):
        self.words = words
        own, code, weight, _ = _codes(words)
        dense = np.zeros((LETTERS**3, len(words)), np.float32)
        np.add.at(dense, (code, own), weight)
        dense /= _norms(own, code, weight, len(words)).astype(np.float32)
        self.held = np.flatnonzero(dense.any(1))
        self.row = np.full(LETTERS**3, -1, np.int32)
        self.row[self.held] = np.arange(len(self.held))
        self.dense = dense[self.held]

    def similar(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the words that are like any landmark by LEAST or more, and their kernel values to the power POWER.

        A word counts by the most similar of itself and its beginnings of STARTS letters, as endings vary. Lesser values are 0.
        """
        own, code, weight, end = _codes(words)
        near = self.row[code] >= 0
        own_near = np.bincount(own[near], minlength=len(words)) if near.any() else np.zeros(len(words))
        some = np.flatnonzero(own_near >= 2)
        if not len(some):
            return some, np.zeros((0, len(self.words)), np.float32)
        mine = np.full(len(words), -1)
        mine[some] = np.arange(len(some))
        of = mine[own] >= 0
        own, code, weight, end, near = mine[own[of]], code[of], weight[of], end[of], near[of]
        # each subsequence counts for all beginnings from the first that holds it on: sums by that first one, then running sums
        kinds = len(STARTS) + 1
        slot = own * kinds + np.searchsorted(STARTS, end)
        row, at, w = self.row[code[near]], slot[near], weight[near]
        value = np.zeros((len(some) * kinds, len(self.words)), np.float32)
        order = np.argsort(at, kind="stable")
        for a in range(0, len(order), 1 << 14):
            part = order[a : a + (1 << 14)]
            first = np.flatnonzero(np.concatenate([[True], at[part][1:] != at[part][:-1]]))
            value[at[part][first]] += np.add.reduceat(self.dense[row[part]] * w[part, None], first, axis=0)
        value = np.cumsum(value.reshape(len(some), kinds, -1), axis=1).reshape(len(some) * kinds, -1)
        squares = np.cumsum(np.bincount(slot, weight * weight, len(some) * kinds).reshape(-1, kinds), axis=1).ravel()
        keep = np.flatnonzero(value.max(1) >= LEAST * np.sqrt(np.maximum(squares, 1e-12)))  # no norm is less
        value = value[keep]
        mine = np.full(len(some) * kinds, -1)
        mine[keep] = np.arange(len(keep))
        parts = [(mine[own * kinds + k], (end <= most) & (mine[own * kinds + k] >= 0)) for k, most in enumerate([*STARTS, 1 << 30])]
        value /= _norms(np.concatenate([x[ok] for x, ok in parts]), *(np.concatenate([x[ok] for _, ok in parts]) for x in (code, weight)), len(keep))[:, None]
        value[value < LEAST] = 0
        best = np.zeros((len(some), len(self.words)), np.float32)
        np.maximum.at(best, keep // kinds, value)
        good = np.flatnonzero(best.any(1))
        return some[good], best[good] ** POWER


class Known:
    """The kernel values of words against the landmarks, kept from block to block; of most words, which are like none, a number alone."""

    def __init__(self, landmarks: list[bytes]):
        self.landmarks, self.table = Landmarks(landmarks), T.WordTable(CACHED_WORDS)
        self.row, self.values = np.zeros(0, np.int32), np.zeros((0, len(landmarks)), np.float32)

    def rows(self, data: np.ndarray, h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """For each word its row in values, -1 without one."""
        some, first, back = np.unique(h, return_index=True, return_inverse=True)
        slots = self.table.find(some)
        kept = self.table.full(int((slots < 0).sum()))
        if kept is not None:
            row = self.row[kept]
            like = row >= 0
            self.values = self.values[row[like]]
            row[like] = np.arange(like.sum())
            self.row, slots = row, self.table.find(some)
        new = np.flatnonzero(slots < 0)
        slots[new] = self.table.add(some[new])
        for b in range(0, len(new), 2048):
            part = first[new[b : b + 2048]]
            like, value = self.landmarks.similar([data[s[i] : e[i]].tobytes() for i in part])
            row = np.full(len(part), -1, np.int32)
            row[like] = len(self.values) + np.arange(len(like))
            self.row, self.values = np.concatenate([self.row, row]), np.concatenate([self.values, value])
        return self.row[slots][back]


def sentences(column: pa.Array, known: Known) -> Iterator[tuple[int, int, np.ndarray]]:
    """(row, sentence, features) for each sentence with a word that is like a landmark. Single letters in a row are one word.

    The features are sums of the words' kernel values, once over the sentence and once over the whole text, there per 100 words.
    """
    data, offsets = T.utf8(column)
    for a, h, at, s, e in T.words(column, spans=True):
        row = np.repeat(np.arange(a, a + len(at) - 1), np.diff(at))
        s, e = s + offsets[row], e + offsets[row]
        ends = np.isin(data[e - 1], (33, 46, 63)) if len(e) else np.zeros(0, bool)
        sentence = np.concatenate([[0], np.cumsum(ends)[:-1]]) if len(ends) else np.zeros(0, np.int64)
        like_row = known.rows(data, h, s, e)
        out: dict[tuple[int, int], np.ndarray] = {}
        for i in np.flatnonzero(like_row >= 0).tolist():
            key, value = (int(row[i]), int(sentence[i])), known.values[like_row[i]]
            out[key] = out[key] + value if key in out else value
        single = np.flatnonzero(e - s == 1)
        if len(single) > 2:
            run = np.split(single, np.flatnonzero((np.diff(single) > 1) | (np.diff(row[single]) > 0)) + 1)
            run = [r for r in run if len(r) > 2]
            like, value = known.landmarks.similar([data[s[r]].tobytes() for r in run]) if run else ([], [])
            for k, x in zip(like, value, strict=True):
                key = (int(row[run[k][0]]), int(sentence[run[k][0]]))
                out[key] = out[key] + x if key in out else x
        whole: dict[int, np.ndarray] = {}
        for (r, _), value in out.items():
            whole[r] = whole[r] + value if r in whole else value
        for (r, n), value in out.items():
            yield r, n, np.concatenate([value, whole[r] * (100 / (20 + at[r - a + 1] - at[r - a]))])


@dataclass
class Model:
    landmarks: list[bytes]
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, column: pa.Array, known: Known) -> np.ndarray:
        best = np.full(len(column), self.bias)
        for row, _, value in sentences(column, known):
            best[row] = max(best[row], float(value @ self.weights) + self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * best + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, c: float = 2000.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine with squared hinge loss, by Newton steps; y is -1 or 1, cost a weight per row.

    A row like no landmark belongs to the clean side. Sums are taken over parts of the rows.
    """
    n = x.shape[1]
    w, ridge, last = np.zeros(n + 1), np.diag(np.append(np.ones(n), 1e-3)), None
    cost = c * cost / (cost.sum() + 0.2)
    parts = [slice(a, a + 4096) for a in range(0, len(x), 4096)]
    for _ in range(30):
        hit = np.concatenate([y[p] * (x[p] @ w[:-1] + w[-1]) < 1 for p in parts])
        if last is not None and (hit == last).all():
            break
        last, hess, grad = hit, ridge.copy(), np.zeros(n + 1)
        if w[-1] > -1:
            hess[-1, -1] += 0.2 * c / 2.2
            grad[-1] -= 0.2 * c / 2.2
        for p in parts:
            rows = np.concatenate([x[p][hit[p]], np.ones((hit[p].sum(), 1))], 1).astype(np.float64)
            hess += (rows * cost[p][hit[p], None]).T @ rows
            grad += rows.T @ (cost[p] * y[p])[hit[p]]
        w = np.linalg.solve(hess, grad)
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a = np.array([1.0, 0.0])
    design = np.stack([x, np.ones(len(x))], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ a, -30, 30)))
        grad = design.T @ (p - y) + 0.01 * a
        hess = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        a -= np.clip(np.linalg.solve(hess, grad), -2, 2)
    return float(max(a[0], 1e-3)), float(a[1])


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000, landmarks: int = 96, sentences_each: int = 500) -> Model:
    """A model from docs (doc_id, text) and labels (doc_id, toxic 0/1); labels of other values are left out.

    It learns from at most `rows` labelled documents of either class (those of least hash, whatever the input's size), and from at most
    `sentences_each` different sentences of each document that are like a landmark (those of least hash); repeated rows of a document count once.
    Without both classes the model gives every text the share of toxic labels.
    """
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null")
    take = lambda y: labels.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    chosen = take(1).union(take(0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id")  # at most 2 * rows rows
    words = F.array_distinct(F.split(F.regexp_replace(F.lower("text"), r"[!-/:-@\[-`{-~]", ""), WORD_SEPARATORS))
    starts = F.transform(F.filter(words, lambda w: F.length(w) > 3), lambda w: F.transform(F.sequence(F.lit(4), F.least(F.length(w), F.lit(9))), lambda n: F.substring(w, 1, n)))
    words = F.array_distinct(F.flatten(starts))
    counts = texts.select("toxic", F.explode(words).alias("word")).groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    number = {r["toxic"]: r["n"] for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, good = number.get(1, 0), number.get(0, 0)
    if not bad or not good:
        return Model([b"none"], np.zeros(2), 0.0, 1.0, float(np.log((bad + 0.01) / (good + 0.01))))
    share, other = F.col("bad") / bad, F.col("good") / good
    top = counts.where("bad > 1").orderBy((share * F.log((share + 1e-3) / (other + 1e-3))).desc(), "word").limit(8 * landmarks).collect()
    picked: list[bytes] = []
    words = [r["word"].encode() for r in top]
    if words:
        own, code, weight, _ = _codes(words)
        held, column = np.unique(code, return_inverse=True)
        dense = np.zeros((len(words), len(held)), np.float32)
        np.add.at(dense, (own, column), weight)
        dense /= _norms(own, code, weight, len(words))[:, None]
        alike, free = dense @ dense.T, np.ones(len(words), bool)
        for i in range(len(words)):
            if free[i] and len(picked) < landmarks:
                picked.append(words[i])
                free &= alike[i] < 0.85
    picked = picked or [b"none"]
    held = docs.sparkSession.sparkContext.broadcast(picked)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = ("likeness", *held.value)
        known = T.kept(owner, lambda: Known(held.value))
        for batch in batches:
            found = [(r, x.astype(np.float16).tobytes()) for r, _, x in sentences(batch.column("text"), known)]
            ids, toxic = batch.column("doc_id"), batch.column("toxic")
            rows = pa.array([r for r, _ in found], pa.int64())
            every = pa.RecordBatch.from_pydict({"doc_id": ids, "toxic": toxic, "x": pa.nulls(len(ids), pa.binary())})
            yield every
            yield pa.RecordBatch.from_pydict({"doc_id": ids.take(rows), "toxic": toxic.take(rows), "x": pa.array([x for _, x in found], pa.binary())})
        T.tidy(owner)

    bounded_batches(docs.sparkSession)
    found = texts.mapInArrow(features, "doc_id long, toxic int, x binary").distinct()
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("x").isNotNull(), F.xxhash64("x"), "x"))
    got = found.withColumn("rank", rank).where(F.col("rank") <= sentences_each + 1).drop("rank").toPandas().sort_values(["doc_id", "x"], na_position="first")
    label = got[got.x.isna()].set_index("doc_id").toxic.groupby(level=0).max()
    got = got[got.x.notna()]
    own, y = got.doc_id.to_numpy(), got.toxic.to_numpy()
    x = np.frombuffer(b"".join(got.x), np.float16).reshape(len(got), 2 * len(picked))
    del got
    kernel = Landmarks(picked)
    gram = np.zeros((len(picked), len(picked)))
    for i, value in zip(*kernel.similar(picked), strict=True):
        gram[i] = value
    gram = (gram + gram.T) / 2
    root, basis = np.linalg.eigh(gram + 1e-3 * np.eye(len(picked)))
    root = basis @ np.diag(1 / np.sqrt(np.maximum(root, 1e-2))) @ basis.T
    root = np.kron(np.eye(2), root)
    z, decision, bias = np.empty(x.shape, np.float32), np.empty(len(x)), 0.0
    for a in range(0, len(x), 4096):
        part = x[a : a + 4096].astype(np.float64)
        z[a : a + 4096], decision[a : a + 4096] = part @ root, part.sum(1)
    del x
    weights = np.zeros(2 * len(picked))
    for _ in range(4):
        order = np.lexsort((-decision, own))
        lead = np.zeros(len(own), bool)
        lead[order[np.concatenate([[True], own[order][1:] != own[order][:-1]])] if len(own) else []] = True
        use = np.flatnonzero((y == 0) | lead)
        if not len(use):
            break
        side = np.where(y[use] == 1, 1.0, -1.0)
        weight = np.where(side > 0, 1 / max(1, (side > 0).sum()), 1 / max(1, (side < 0).sum()))
        v, bias = _svm(z[use], side, weight)
        weights, decision = root @ v, np.concatenate([z[a : a + 4096] @ v for a in range(0, len(z), 4096)]) + bias
    best = np.full(len(label), bias)
    if len(own):
        top = np.full(len(label), -np.inf)
        np.maximum.at(top, label.index.get_indexer(own), decision)
        best = np.maximum(best, top)
    slope, shift = _logistic(best, label.to_numpy().astype(float))
    return Model(picked, weights.astype(np.float32), float(bias), slope, shift)


def score(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs with a column of that name (0 to 1) for every row, of its whole text; a null or empty text scores as one without insults.

    All columns and repeated rows stay; a column of that name is replaced. No rows: none.
    """
    docs = docs.drop(name)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = ("likeness", *held.value.landmarks)
        known = T.kept(owner, lambda: Known(held.value.landmarks))
        for batch in batches:
            yield batch.append_column(name, pa.array(held.value.scores(batch.column("text").cast(pa.string()), known), pa.float64()))
        T.tidy(owner)

    bounded_batches(docs.sparkSession)

    return docs.mapInArrow(run, docs.withColumn(name, F.lit(0.0)).schema)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 5 == 0


def trained(spark: SparkSession, sf_dir: str) -> Model:
    """The model of the labels outside the held-out fifth."""
    return fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, trained(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
