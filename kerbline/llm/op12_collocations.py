"""Phrase collocations by top-order marginalisation.

Every word of a piece of text (between two marks) begins one window: the word and, as lead columns, the words after it, padded where the piece ends. Only these
longest windows are counted, within tasks before they are shuffled. A ROLLUP over the counted windows then sums ever shorter prefixes, and since every
occurrence of a phrase begins exactly one window, the prefixes' sums are the counts of all shorter phrases, of single words, and of all words of a group.

Most windows are rare, and shuffling them whole takes many times the texts' size. So hashes of neighbouring words are counted first, and a window is padded
from the first pair on that occurs too seldom for a candidate: no count of a phrase that can be a candidate, or of its parts, changes. The filter
of frequent pairs has at most 2 ** MOST_BITS bits; beyond about as many pairs it sieves less and the shuffle grows, results stay.

A candidate's score is the lowest over its cuts into two parts of scale * a * a / (l * r), a whole number from exact decimals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import text as T
from kerbline.llm.common import bounded_batches, checkpoint, marked, salted_join, table
from kerbline.llm.op13_token_ids import unit_hashes
from kerbline.operators.tables import dense_ids

PAD, BLOCK, MOST_BITS = "", 1 << 21, 26
# Marks and line ends end a piece, spaces and tabs part words, A-Z are written as a-z.
_MARK = np.isin(np.arange(256), list(b".,;:!?\n\x0b\x0c\r"))
_WORD = ~_MARK & ~np.isin(np.arange(256), list(b" \t"))
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


class Words:
    """The words of a block of rows: their bytes (data, start, end), row, and two hashes; joined says whether a word and the next are of one piece."""

    def __init__(self, data: np.ndarray, rows: np.ndarray, first: int):
        """rows: where the rows after the first begin in data; first: the number of the first."""
        self.data = _LOWER[data]
        word, new = _WORD[data], np.zeros(len(data) + 1, bool)
        new[rows] = True
        new[-1] = True
        before, after = np.concatenate([[False], word[:-1]]), np.append(word[1:], False)
        self.start = np.flatnonzero(word & (~before | new[:-1]))
        self.end = np.flatnonzero(word & (~after | new[1:])) + 1
        self.row = first + np.searchsorted(rows, self.start, "right")
        piece = np.cumsum(_MARK[data])[self.start]
        self.joined = np.append((piece[1:] == piece[:-1]) & (self.row[1:] == self.row[:-1]), False) if len(piece) else np.zeros(0, bool)
        self.hash, self.other = unit_hashes(self.data, self.start, self.end)

    def pairs(self, groups: np.ndarray) -> np.ndarray:
        """A hash of each word and the next, if they are of one piece, and the row's group."""
        both = T.mix(self.hash ^ groups[self.row]) * np.uint64(0x9FB21C651E98DF25) + np.append(self.hash[1:], np.zeros(min(1, len(self.hash)), np.uint64))
        return T.mix(both)

    def numbered(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word, and the different words by number."""
        order = np.argsort(self.hash, kind="stable")
        differs = lambda x: x[order][1:] != x[order][:-1]
        new = differs(self.hash)
        if (differs(self.other) & ~new).any():
            order = np.lexsort((self.other, self.hash))
            new = differs(self.hash) | differs(self.other)
        number = np.empty(len(order), np.int64)
        number[order] = np.concatenate([[0], np.cumsum(new)])
        some = order[np.concatenate([[True], new])]
        size = self.end[some] - self.start[some]
        to = np.cumsum(size)
        letters = self.data[np.repeat(self.start[some] - (to - size), size) + np.arange(to[-1])]
        return number, pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(np.concatenate([[0], to]).astype(np.int64)), pa.py_buffer(letters))


def blocks(column: pa.Array) -> Iterator[Words]:
    """The words of a string column, a block of text at a time; longer texts are cut after marks only."""
    data, offsets = T.utf8(column)
    p = 0
    while p < len(data):
        q = min(p + BLOCK, len(data))
        while q < len(data):
            inner = offsets[np.searchsorted(offsets, p, "right") : np.searchsorted(offsets, q, "right")]
            marks = np.flatnonzero(_MARK[data[p:q]])
            last = max(int(inner[-1]) if len(inner) else p, p + int(marks[-1]) + 1 if len(marks) else p)
            if last > p:
                q = last
                break
            q = min(q + BLOCK, len(data))
        first = int(np.searchsorted(offsets, p, "right")) - 1
        rows = offsets[first + 1 :]
        words = Words(data[p:q], rows[rows < q] - p, first)
        if len(words.start):
            yield words
        p = q


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups = batch.column("gh").to_numpy().view(np.uint64)
        found = [words.pairs(groups)[words.joined] for words in blocks(batch.column("text"))]
        if found:
            pair, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(pair.view(np.int64)), "n": pa.array(n, pa.int64())})
    T.tidy()


def _windows(size: int, frequent: Callable):
    names = [f"w{k}" for k in range(1, size + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups, g = batch.column("gh").to_numpy().view(np.uint64), batch.column("g").dictionary_encode()
            of_row = g.indices.to_numpy()
            for words in blocks(batch.column("text")):
                number, known = words.numbered()
                n, open_ = len(number), words.joined & frequent(words.pairs(groups).view(np.int64))
                columns, going = [number], np.ones(n, bool)
                for k in range(1, size):  # lead columns; len(known) is the padding
                    going = going & np.append(open_[k - 1 :], np.zeros(min(k - 1, n), bool))[:n]
                    lead = np.append(number[k:], np.zeros(min(k, n), np.int64))
                    columns.append(np.where(going, lead, len(known)))
                key = of_row[words.row].astype(np.int64)
                for c in columns:
                    some, first, key, count = np.unique(key * (len(known) + 1) + c, return_index=True, return_inverse=True, return_counts=True)
                known = pa.concat_arrays([known, pa.array([PAD], pa.large_string())])
                arrays = [g.dictionary.cast(pa.large_string()).take(pa.array(of_row[words.row[first]]))] + [known.take(pa.array(c[first])) for c in columns]
                for a in range(0, len(first), 1 << 16):
                    part = [x.slice(a, 1 << 16).cast(pa.string()) for x in arrays]
                    yield pa.RecordBatch.from_arrays([*part, pa.array(count[a : a + (1 << 16)], pa.int64())], names=["g", *names, "f"])
        T.tidy()

    return run


def counted(docs: DataFrame, words: int, least: int, text: str = "text", group: str = "lang", other: str = "und") -> tuple[DataFrame, DataFrame]:
    """Counts (g, phrase array, f) of all phrases of up to `words` words with f >= least, and totals (g, n) of all words, all from one table of windows."""
    bounded_batches(docs.sparkSession)
    g = F.coalesce(F.col(group).cast("string"), F.lit(other))
    rows = docs.select(g.alias("g"), F.xxhash64(g).alias("gh"), F.col(text).cast("string").alias("text")).where(F.length("text") > 0)
    pairs = rows.select("gh", "text").mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = checkpoint(pairs.where(F.col("n") >= least).select("pair"))
    bits = min(MOST_BITS, max(16, (16 * pairs.count()).bit_length()))
    names = [f"w{k}" for k in range(1, words + 1)]
    top = rows.mapInArrow(_windows(words, marked(pairs, bits)), ", ".join(f"{c} string" for c in ["g", *names]) + ", f long")
    top = checkpoint(top.groupBy("g", *names).agg(F.sum("f").alias("f")))
    # a prefix ends before the first column that the rollup leaves out; the windows themselves are its last level, counted already
    summed = top.rollup("g", *names[:-1]).agg(F.sum("f").alias("f"))
    whole = top.where(F.col("f") >= least).select("g", *names, "f")
    short = summed.where(F.col("w1").isNull() | (F.col("f") >= least)).select("g", *names[:-1], F.lit(None).cast("string").alias(names[-1]), "f")
    found = checkpoint(whole.unionByName(short).where("g is not null"))
    # a prefix that ends in padding repeats a shorter one
    phrase = F.array_compact(F.array(*names))
    phrases = found.where(F.col("w1").isNotNull()).select("g", phrase.alias("phrase"), "f").where(F.element_at("phrase", -1) != PAD)
    return phrases, found.where(F.col("w1").isNull()).select("g", F.col("f").alias("n"))


def scored(phrases: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """(g, phrase, a, l, r, score) of all phrases of two words and more, from counts (g, phrase array, f) that hold their parts too."""
    joined = lambda x: F.array_join(x, " ")
    candidates = phrases.where(F.size("phrase") > 1).select("g", "phrase", F.col("f").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.size("phrase") - 1)).alias("k")
    cut = candidates.select("g", "phrase", "a", cut)
    cut = cut.select("g", joined("phrase").alias("phrase"), "a", "k", joined(F.expr("slice(phrase, 1, k)")).alias("first"), joined(F.expr("slice(phrase, k + 1, size(phrase) - k)")).alias("rest"))
    part = lambda name, f: phrases.select("g", joined("phrase").alias(name), F.col("f").alias(f))
    # a very common word stands in a small part of all candidates; Spark splits its rows where they are many
    cut = cut.join(part("first", "l"), ["g", "first"]).join(part("rest", "r"), ["g", "rest"])
    whole = lambda c: f"cast({c} as decimal(15,0))"
    score = F.expr(f"cast({scale} as decimal(7,0)) * {whole('a')} * {whole('a')} div ({whole('l')} * {whole('r')})")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")
    return cut.groupBy("g", "phrase", "a").agg(best).select("g", "phrase", "a", "b.l", "b.r", "b.score")


def absorbed(phrases: DataFrame, percent: int = 50) -> DataFrame:
    """(g, phrase) of phrases that a longer one holds which is at least percent as frequent."""
    longer = phrases.where(F.size("phrase") > 2).withColumn("size", F.explode(F.expr("sequence(2, size(phrase) - 1)")))
    inner = longer.select("g", F.col("f").alias("by"), F.explode(F.expr("transform(sequence(1, size(phrase) - size + 1), i -> array_join(slice(phrase, i, size), ' '))")).alias("phrase"))
    most = inner.groupBy("g", "phrase").agg(F.max("by").alias("by"))
    own = phrases.where(F.size("phrase") > 1).select("g", F.array_join("phrase", " ").alias("phrase"), "f")
    return most.join(own, ["g", "phrase"]).where(F.col("by") * 100 >= F.col("f") * percent).select("g", "phrase")


def collocations(docs: DataFrame, words: int = 3, least: int = 10, best: int = 2000, percent: int = 50, scale: int = 1_000_000, text: str = "text", group: str = "lang") -> DataFrame:
    """(g, rank, phrase, a, l, r, n, score): the best phrases of 2 to `words` words of each group by score, a (both descending) and phrase (bytes).

    A phrase is a candidate if it occurs a >= least times within pieces, overlaps included; l and r are the counts of the two parts at its lowest-scoring
    cut (the first of equal ones), n the words of its group. Phrases that lie in a candidate of at least percent of their count are dropped.
    Null texts are empty, a null group is `und`, repeated rows count each. Texts without words, and no rows, give nothing. Other columns are not read.
    Ranks come from a sort by ranges, not from a task a group.
    """
    phrases, totals = counted(docs, words, least, text, group)
    kept = scored(phrases, scale).join(absorbed(phrases, percent), ["g", "phrase"], "left_anti")
    order = ["g", "by_score", "by_a", "phrase"]
    rows = dense_ids(kept.withColumns({"by_score": -F.col("score"), "by_a": -F.col("a")}), order, "place")
    first = rows.groupBy("g").agg(F.min("place").alias("least"))
    ranked = salted_join(rows, first.join(totals, "g"), "g", "place").withColumn("rank", (F.col("place") - F.col("least") + 1).cast("int")).where(F.col("rank") <= best)
    return ranked.select("g", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents")).withColumnRenamed("g", "lang")


ORACLE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, unnest(list_concat(list_transform(range(1, len(ws) + 1), lambda i: [ws[i]]), list_transform(range(1, len(ws)), lambda i: ws[i:i + 1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i:i + 2]))) AS ph FROM w WHERE len(ws) > 0),
f AS (SELECT lang, ph, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(ph) = 1 GROUP BY lang),
c AS (SELECT lang, ph, f AS a FROM f WHERE len(ph) > 1 AND f >= 10),
k AS (SELECT c.*, unnest(range(1, len(ph))) AS k FROM c),
s AS (SELECT k.lang, k.ph, k.a, k.k, x.f AS l, y.f AS r, ((1000000::HUGEINT * k.a * k.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.ph = k.ph[1:k.k] JOIN f y ON y.lang = k.lang AND y.ph = k.ph[k.k + 1:]),
b AS (SELECT lang, ph, a, arg_min(l, [score, k]) AS l, arg_min(r, [score, k]) AS r, min(score) AS score FROM s GROUP BY ALL),
d AS (SELECT lang, unnest([ph[1:2], ph[2:3]]) AS ph, a AS "by" FROM c WHERE len(ph) = 3),
e AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.lang = b.lang AND d.ph = b.ph AND 100 * d."by" >= 50 * b.a)),
o AS (SELECT *, array_to_string(ph, ' ') AS phrase FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o)
SELECT r.lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n.n, score FROM r JOIN n ON n.lang = r.lang WHERE rank <= 2000
"""
