"""Benchmark decontamination: SimHash of item-sized windows, a multi-index Hamming search, exact weighted similarity.

Every window of a document that has as many words as some benchmark item and shares a shingle with an item of that
size gets a 64-bit SimHash of its shingles (a window without such a shingle has similarity 0 to every item of its size). A document
of fewer words than an item is itself the one window for it, so that an item cut at an end is found too. Item
fingerprints are cut into BLOCKS blocks; two fingerprints within RADIUS bits differ by at most RADIUS // BLOCKS bits in one of
them. Each block has an index from its value to the items whose own block lies so near, as one bit an item, GROUP items at a time; what any
block's bucket holds is an item that may lie within RADIUS, and all that do are among them. Those that do are verified: the weighted Jaccard
similarity of the two shingle bags, each shingle weighing one over the number of different item texts (as words) that hold it, must
reach the threshold. Those numbers are counted in Spark over the whole benchmark: neither repeated items nor the cut into blocks changes them.
A shingle of one item weighs as much as one of none, so only shared shingles are sent: WEIGHTS of them with the items, more of them in passes
over the texts, each of which adds to a column what its part of them says of the row.

An item of fewer words than a shingle is one shingle and is found wherever a text holds its words in a row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from kerbline.llm import text as T
from kerbline.llm.common import bounded_batches, checkpoint, fresh, table

BLOCKS, RADIUS, GROUP, BLOCK_BYTES, SIEVE_BITS, WEIGHTS = 5, 19, 64, 4 << 20, 22, 1 << 20
_WIDTH = -(-64 // BLOCKS)
SCHEMA = "doc_id long, item_id long, similarity double, start_word long, n_words long, hamming int"
_PAIR = np.dtype([("shingle", "<u8"), ("n", "<i8")])


class Index:
    """The shingles and fingerprints of a bounded set of items, by their size in words.

    shared: sorted shingles of several items of the whole benchmark with their number of items; more: those of the rest, as _PAIR, of each text.
    """

    def __init__(self, ids: list[int], texts: list[str], size: int, shared: np.ndarray, more: list[bytes | None]):
        self.size, self.shared = size, shared
        bags: list[Counter] = []
        self.words = []
        for _, h, at in T.words(pa.array(texts, pa.string())):
            s, to = T.shingles(h, at, size)
            bags += [Counter(s[to[i] : to[i + 1]].tolist()) for i in range(len(to) - 1)]
            self.words += np.diff(at).tolist()
        self.ids, self.bags, self.more = ids, bags, more
        self.by_words: dict[int, np.ndarray] = {}
        for n in set(self.words) - {0}:
            self.by_words[n] = np.array([i for i, w in enumerate(self.words) if w == n])
        marks = [self._bits(x := np.array(list(bag.elements()), np.uint64), self.weights(x, m)).sum(0) for bag, m in zip(bags, more, strict=True) if bag]
        kept = [i for i, bag in enumerate(bags) if bag]
        self.print = np.zeros(len(bags), np.uint64)
        if kept:
            self.print[kept] = self._pack(np.array(marks))
        sizes: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, list[int]]] = {}  # by words and hash
        for i, (bag, n) in enumerate(zip(bags, self.words, strict=True)):
            for x in bag:
                if n < size:
                    self.short.setdefault(n, {}).setdefault(x, []).append(i)
                else:
                    sizes.setdefault(x, set()).add(n)
        self.shingle = np.array(sorted(sizes), np.uint64)
        self.sizes = [sorted(sizes[x]) for x in self.shingle.tolist()]
        self.sieve = np.zeros(1 << SIEVE_BITS, bool)
        self.sieve[self._spot(self.shingle)] = True
        near = [0] + [sum(1 << b for b in bits) for r in range(1, RADIUS // BLOCKS + 1) for bits in combinations(range(_WIDTH), r)]
        self.near = np.array(near, np.int64)
        self.tables: dict[int, list[tuple[np.ndarray, list[np.ndarray]]]] = {}

    @staticmethod
    def _spot(x: np.ndarray) -> np.ndarray:
        return (x >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)

    def weights(self, x: np.ndarray, more: bytes | None) -> np.ndarray:
        """Each shingle's weight; more has those of the text that self.shared lacks."""
        n = np.ones(len(x), np.int64)
        for known in (self.shared, np.frombuffer(more or b"", _PAIR)):
            at, hit = _found(x, known["shingle"])
            n[hit] = known["n"][at]
        return 1 / n

    @staticmethod
    def _bits(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Each shingle's weight, with the sign of each bit of its hash."""
        signs = np.unpackbits(T.mix(x).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32) * 2 - 1
        return signs * weights.astype(np.float32)[:, None]

    @staticmethod
    def _pack(sums: np.ndarray) -> np.ndarray:
        return np.packbits(sums > 1e-4, axis=1).view(np.uint64).reshape(-1)

    @staticmethod
    def _block(prints: np.ndarray, b: int) -> np.ndarray:
        """The values of block b; the last block has fewer bits."""
        return ((prints >> np.uint64(_WIDTH * b)) & np.uint64((1 << min(_WIDTH, 64 - _WIDTH * b)) - 1)).astype(np.int64)

    def _table(self, n: int) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """Groups of the items of n words, each with an index per block from values to the items near them, as bits."""
        if n not in self.tables:
            out = []
            for a in range(0, len(self.by_words[n]), GROUP):
                items, index = self.by_words[n][a : a + GROUP], []
                for b in range(BLOCKS):
                    bucket = np.zeros(1 << _WIDTH, np.uint64)
                    for i, value in enumerate(self._block(self.print[items], b).tolist()):
                        bucket[value ^ self.near] |= np.uint64(1 << i)
                    index.append(bucket)
                out.append((items, index))
            self.tables[n] = out
        return self.tables[n]

    def within(self, prints: np.ndarray, n: int) -> Iterator[tuple[int, int, int]]:
        """(place, item, distance) of all items of n words within RADIUS of the fingerprints."""
        blocks = [self._block(prints, b) for b in range(BLOCKS)]
        for items, index in self._table(n):
            met = index[0][blocks[0]]
            for b in range(1, BLOCKS):
                met |= index[b][blocks[b]]
            hit = np.flatnonzero(met)
            place, bit = np.nonzero(np.unpackbits(met[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, : len(items)])
            place, item = hit[place], items[bit]
            distance = np.bitwise_count(prints[place] ^ self.print[item])
            near = np.flatnonzero(distance <= RADIUS)
            yield from zip(place[near].tolist(), item[near].tolist(), distance[near].tolist(), strict=True)

    def similarity(self, item: int, shingles: np.ndarray, weights: np.ndarray) -> float:
        mine, other = self.bags[item], Counter(shingles.tolist())
        weight = dict(zip(shingles.tolist(), weights.tolist(), strict=True))
        rest = np.array([x for x in mine if x not in other], np.uint64)
        both = sum(weight[x] * min(c, mine[x]) for x, c in other.items() if x in mine)
        every = sum(weight[x] * max(c, mine.get(x, 0)) for x, c in other.items()) + sum(w * mine[x] for x, w in zip(rest.tolist(), self.weights(rest, self.more[item]).tolist(), strict=True))
        return both / every if every else 0.0

    def matches(self, column: pa.Array, more: pa.Array | None, threshold: float) -> Iterator[tuple[int, int, float, int, int, int]]:
        """(row, item id, similarity, first word, words, Hamming distance): the best window of each row for each item."""
        for a, h, at in T.words(column):
            small: dict[int, dict[int, int]] = {}  # row, item, first word
            for n, known in self.short.items():
                grams, keys = T.grams(h, n), np.array(sorted(known), np.uint64)
                for p in np.flatnonzero(_found(grams, keys)[1]).tolist():
                    r = int(np.searchsorted(at, p, "right")) - 1
                    if p + n <= at[r + 1]:
                        for item in known[int(grams[p])]:
                            small.setdefault(r, {}).setdefault(item, p - int(at[r]))
            s, to = T.shingles(h, at, self.size)
            hit = np.flatnonzero(self.sieve[self._spot(s)])
            place, same = _found(s[hit], self.shingle)
            hit = hit[same]
            row = np.searchsorted(to, hit, "right") - 1
            for r in sorted({*np.unique(row).tolist(), *small}):
                here, words = s[to[r] : to[r + 1]], int(at[r + 1] - at[r])
                weights = self.weights(here, more[a + r].as_py() if more is not None else None)
                starts: dict[int, list[int]] = {}
                for p, q in zip((hit[row == r] - to[r]).tolist(), place[row == r].tolist(), strict=True):
                    for n in self.sizes[q]:
                        starts.setdefault(n, []).append(p)
                best = {item: (1.0, start, self.words[item], 0) for item, start in small.get(r, {}).items()}
                for n, hits in starts.items():
                    for start, item, distance in self._windows(here, weights, words, n, np.array(hits)):
                        window = slice(start, start + max(1, min(n, words) - self.size + 1))
                        value = self.similarity(item, here[window], weights[window])
                        if value >= threshold - 1e-12 and (item not in best or (value, -start) > (best[item][0], -best[item][1])):
                            best[item] = value, start, min(n, words), distance
                for item, (value, start, n, distance) in sorted(best.items()):
                    yield a + r, self.ids[item], value, start, n, distance

    def _windows(self, here: np.ndarray, weights: np.ndarray, words: int, n: int, hits: np.ndarray) -> Iterator[tuple[int, int, int]]:
        wide = min(n, words)
        span, last = max(1, wide - self.size + 1), words - wide
        begin = np.zeros(last + 2, np.int64)
        np.add.at(begin, np.minimum(np.maximum(hits - span + 1, 0), last + 1), 1)
        np.add.at(begin, np.minimum(hits + 1, last + 1), -1)
        starts = np.flatnonzero(np.cumsum(begin)[: last + 1] > 0)
        for part in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):
            for x in range(0, len(part), 8192):
                some = part[x : x + 8192]
                if len(some):
                    sums = np.concatenate([np.zeros((1, 64)), np.cumsum(self._bits(here[some[0] : some[-1] + span], weights[some[0] : some[-1] + span]), axis=0, dtype=np.float64)])
                    prints = self._pack(sums[some - some[0] + span] - sums[some - some[0]])
                    for p, item, distance in self.within(prints, n):
                        yield int(some[p]), item, distance


def _found(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in known, which is sorted, of those of x that it has, and which those are."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    same = known[at] == x
    return at[same], same


def _shared(items: DataFrame, size: int) -> Iterator:
    """Broadcast parts of about WEIGHTS rows of the shingles that several different texts hold, with their number; one at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, h, at in T.words(batch.column("text")):
                s, to = T.shingles(h, at, size)
                for i in range(len(to) - 1):
                    own = np.unique(s[to[i] : to[i + 1]])
                    key = np.frombuffer(hashlib.blake2b(h[at[i] : at[i + 1]].tobytes(), digest_size=8).digest(), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.repeat(key, len(own)))], names=["shingle", "key"])

    held = items.select("text").distinct().mapInArrow(run, "shingle long, key long").groupBy("shingle").agg(F.count_distinct("key").alias("n")).where("n > 1")
    held = checkpoint(held)
    parts = max(1, -(-held.count() // WEIGHTS))
    for p in range(parts):
        rows = held.where(F.pmod(F.xxhash64("shingle"), F.lit(parts)) == p).toArrow()  # about WEIGHTS
        pairs = np.zeros(rows.num_rows, _PAIR)
        pairs["shingle"], pairs["n"] = rows["shingle"].to_numpy().view(np.uint64), rows["n"].to_numpy()
        yield items.sparkSession.sparkContext.broadcast(np.sort(pairs, order="shingle"))


def _marked(rows: DataFrame, part, size: int, shared: str) -> DataFrame:
    """rows with what part, of _shared, has of their texts added to the column named shared, which is sorted by shingle."""
    names = [c for c in rows.columns if c != shared]
    schema = StructType([f for f in rows.schema.fields if f.name != shared]).add(shared, BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = part.value
        for batch in batches:
            out = batch.column(shared).to_pylist() if shared in batch.schema.names else [None] * batch.num_rows
            for a, h, at in T.words(batch.column("text").cast(pa.string())):
                s, to = T.shingles(h, at, size)
                place, same = _found(s, known["shingle"])
                row = np.searchsorted(to, np.flatnonzero(same), "right") - 1
                for r in np.unique(row).tolist():
                    own = known[np.unique(place[row == r])]
                    out[a + r] = np.sort(np.concatenate([np.frombuffer(out[a + r] or b"", _PAIR), own]), order="shingle").tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], names=[*names, shared])

    return rows.mapInArrow(run, schema)


def _indexes(docs: DataFrame, benchmark: DataFrame, size: int) -> tuple[DataFrame, str, list]:
    """docs, with a further column of the given name if one broadcast can't hold the weights; arguments of Index, broadcast, and a name, of the
    benchmark in blocks of about BLOCK_BYTES of text: one for a usual benchmark."""
    (shared,) = fresh(docs, "shared_shingles")
    bounded_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    first, *rest = _shared(items, size)
    for part in rest:
        docs, items = _marked(docs, part, size, shared), _marked(items, part, size, shared)
    held = []
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()  # about BLOCK_BYTES
        block = ([r["item_id"] for r in rows], [r["text"] for r in rows]), [r[shared] if rest else None for r in rows]
        held.append(docs.sparkSession.sparkContext.broadcast(block))
    return docs, shared, [(block, first, uuid.uuid4().hex) for block in held]


def _index(held: tuple, size: int) -> Index:
    """The index of a block, kept by the worker from task to task."""

    def make() -> Index:
        (block, more), shared = held[0].value, held[1].value
        return Index(*block, size, shared, more)

    return T.kept(held[2], make)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """SCHEMA rows: for each row of docs (doc_id, text) and each item (item_id, text) that it holds, the best window.

    A null or empty text holds and is no item; an item of fewer than `size` words is held by a text with its words in a row.
    n_words is the window's size: the item's, or the text's if that is shorter.
    Repeated documents give repeated rows; equal items are found each. Other columns are not read. No documents or items: no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    docs, shared, indexes = _indexes(docs, benchmark, size)
    for held in indexes:

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = _index(held, size)
            for batch in batches:
                rows = list(index.matches(batch.column("text"), batch.column(shared) if shared in batch.schema.names else None, threshold))
                column = lambda k, kind: pa.array([r[k] for r in rows], kind)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(column(0, pa.int64())), column(1, pa.int64()), column(2, pa.float64()), column(3, pa.int64()), column(4, pa.int64()), column(5, pa.int32())], names=["doc_id", "item_id", "similarity", "start_word", "n_words", "hamming"])
            T.tidy(held[2])

        one = docs.mapInArrow(run, SCHEMA)
        found = one if found is None else found.union(one)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; all columns and all other rows stay, nulls, empty texts and repeated rows included."""
    columns = docs.columns
    docs, shared, indexes = _indexes(docs, benchmark, size)
    for held in indexes:

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = _index(held, size)
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in index.matches(batch.column("text").cast(pa.string()), batch.column(shared) if shared in batch.schema.names else None, threshold)]] = False
                yield batch.filter(pa.array(keep))
            T.tidy(held[2])

        docs = docs.mapInArrow(run, docs.schema)
    return docs.select(*columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
