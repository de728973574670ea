"""Packing: token sequences of at most capacity tokens with little padding, by Karmarkar-Karp multiway differencing.

Each task tokenizes its own documents and packs them, so no token crosses the network. A document is cut into full
sequences from its start; the rests, all shorter than a sequence, are gathered until a group fills
WINDOWS windows. Differencing then merges partial partitions, the most loaded window of one with the least loaded of the
other, always the two with the largest imbalance, which leaves near-equal windows. What a window then holds beyond the
capacity is cut off and fills those below it, so that all are full; where cuts are not wanted, the group is
partitioned again over one more window as long as any exceeds the capacity. A task's last tokens, less than a window, make
sequences of powers of two, which need no padding.

Words are tokenized once a worker and then are numbers: a block of text becomes ids by sorting, searching and gathering in numpy.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import text as T
from kerbline.llm.common import bounded_batches, table

WINDOWS, CACHED_WORDS = 192, 600_000
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def differencing(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Items of each window, near equal in their sums: the largest differencing method for many windows."""
    left: list[int] = []
    right: list[int] = []
    heap: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for i, size in enumerate(sizes.tolist()):
        load, node = np.zeros(windows, np.int64), np.full(windows, -1)
        load[0], node[0] = size, i
        heap.append((-size, i, load, node))
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        (_, _, load, node), (_, _, other, more) = heapq.heappop(heap), heapq.heappop(heap)
        load, more = load + other[::-1], more[::-1]
        both = np.flatnonzero((node >= 0) & (more >= 0))
        merged = np.where(node >= 0, node, more)
        merged[both] = len(sizes) + len(left) + np.arange(len(both))
        left += node[both].tolist()
        right += more[both].tolist()
        by = np.argsort(-load, kind="stable")
        load, order = load[by] - load[by[-1]], order + 1
        heapq.heappush(heap, (-int(load[0]), order, load, merged[by]))
    out: list[list[int]] = []
    for top in heap[0][3].tolist() if heap else []:
        todo, items = [top], []
        while todo:
            x = todo.pop()
            if x >= len(sizes):
                todo += [right[x - len(sizes)], left[x - len(sizes)]]
            elif x >= 0:
                items.append(x)
        out.append(items)
    return out


def windows_of(sizes: np.ndarray, capacity: int, level: bool = False) -> list[list[int]]:
    """As few near-equal windows as differencing fits under the capacity; to be levelled by cuts, as many as the sizes fill."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = differencing(sizes, windows)
        if level or all(sizes[items].sum() <= capacity for items in found):
            return found
        windows += 1


# Fixed values of byte-level vocabularies: the printable letter that stands for each byte is the byte itself, or the next one from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_LETTER_OF = np.zeros(256, np.uint32)
_LETTER_OF[_PRINTED] = _PRINTED
_LETTER_OF[[b for b in range(256) if b not in _PRINTED]] = np.arange(256, 512 - len(_PRINTED))
_ENDING = np.isin(np.arange(256), list(b".,;:!?"))
_LETTER = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_LATIN = (np.arange(256) >= 128) & (np.arange(256) < 192) & ~np.isin(np.arange(256), (0x97, 0xB7))  # after 0xC3, but for two signs


def _before_ending(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the marks at a word's end begin, if a Latin letter or a digit stands before them; else the end.

    The tokenizer parts letters and digits from what follows, so such words are tokenized as two.
    """
    core = ends.copy()
    open_ = np.arange(len(ends))
    while len(open_ := open_[(core[open_] - starts[open_] > 1) & _ENDING[data[core[open_] - 1]]]):
        core[open_] -= 1
    last, before = data[core - 1], data[np.maximum(core - 2, 0)]
    fits = _LETTER[last] | ((last >= 48) & (last <= 57)) | (_LATIN[last] & (before == 0xC3) & (core - starts > 1))
    return np.where(fits, core, ends)


class Encoder:
    """Token ids of texts. The tokenizer drops white space and never joins across it, so each word is tokenized once and kept."""

    def __init__(self, tokenizer_path: str, words: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(tokenizer_path)
        self.plain = Tokenizer(self.full.model)  # the same model, without normalizer
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.full.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.table, self.pool, self.start, self.length = T.WordTable(words), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _latin(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are Latin letters alone, each one word to the tokenizer too, and how many each has."""
        size = e - s + 1
        to = np.cumsum(size)
        inner = np.repeat(s - (to - size), size) + np.arange(to[-1])
        codes = data[np.minimum(inner, len(data) - 1)].astype(np.uint32)
        second = np.concatenate([[False], codes[:-1] == 0xC3])
        codes[((codes >= 65) & (codes <= 90)) | (second & (codes >= 0x80) & (codes <= 0x9E))] += 32
        codes = _LETTER_OF[codes]
        codes[to - 1] = 32
        ids = np.array(self.plain.encode_batch_fast([codes.astype("<u4").tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.final[ids]) + 1
        return ids, np.diff(ends, prepend=0)

    def _learn(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> None:
        """Ids of words of the table's next numbers."""
        ok = _LETTER[data] | (data == 0xC3)
        ok[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
        bad = np.concatenate([[0], np.cumsum(~ok)])
        latin = (bad[e] == bad[s]) & (data[e - 1] != 0xC3)
        length, parts = np.zeros(len(s), np.int64), []
        if latin.any():
            ids, length[latin] = self._latin(data, s[latin], e[latin])
            parts.append(ids)
        rest = np.flatnonzero(~latin)
        for a in range(0, len(rest), 4096):
            some = rest[a : a + 4096]
            found = [x.ids for x in self.full.encode_batch_fast([data[s[i] : e[i]].tobytes().decode("utf-8", "replace") for i in some], add_special_tokens=False)]
            length[some] = [len(x) for x in found]
            parts.append(np.array([x for ids in found for x in ids], np.uint32))
        start = np.zeros(len(s), np.int64)
        for some in (np.flatnonzero(latin), rest):
            start[some] = np.cumsum(length[some]) - length[some]
        start[rest] += length[latin].sum()
        self.start, self.length = np.concatenate([self.start, len(self.pool) + start]), np.concatenate([self.length, length])
        self.pool = np.concatenate([self.pool, *parts])

    def _forget(self, kept: np.ndarray) -> None:
        length = self.length[kept]
        to = np.cumsum(length)
        self.pool = self.pool[np.repeat(self.start[kept] - (to - length), length) + np.arange(length.sum())]
        self.start, self.length = to - length, length

    def encode(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For blocks of rows: first row, their ids with end_id after each text, and where each row's begin."""
        data, offsets = T.utf8(column)
        for a, h, at, s, e in T.words(column, spans=True, cut=_before_ending):
            rows = len(at) - 1
            some, first, back = np.unique(h, return_index=True, return_inverse=True)
            slots = self.table.find(some)
            new = slots < 0
            if new.any():
                kept = self.table.full(int(new.sum()))
                if kept is not None:
                    self._forget(kept)
                    slots = self.table.find(some)
                    new = slots < 0
                slots[new] = self.table.add(some[new])
                place = first[new]
                base = offsets[a + np.searchsorted(at, place, "right") - 1]
                self._learn(data[offsets[a] : offsets[a + rows]], s[place] + base - offsets[a], e[place] + base - offsets[a])
            slots = slots[back]
            length = self.length[slots]
            total = np.concatenate([[0], np.cumsum(length)])
            ids = self.pool[np.repeat(self.start[slots] - total[:-1], length) + np.arange(total[-1])]
            ends = total[at[1:]]
            yield a, np.insert(ids, ends, end_id).astype("<u4"), np.concatenate([[0], ends + np.arange(1, rows + 1)])


def _cut_to(rests: list[tuple], total: int) -> tuple[list[tuple], list[tuple]]:
    """The first rests (doc, start, length, doc_tokens, ids) of together total ids, the last of them cut if need be, and those left."""
    held = 0
    for i, (doc, start, length, doc_tokens, ids) in enumerate(rests):
        if held + length > total:
            n = total - held
            head = [(doc, start, n, doc_tokens, ids[: 4 * n])] if n else []
            return [*rests[:i], *head], [(doc, start + n, length - n, doc_tokens, ids[4 * n :]), *rests[i + 1 :]]
        held += length
    return rests, []


def _level(rests: list[tuple], groups: list[list[int]], capacity: int) -> list[list[tuple]]:
    """The groups' rests as full windows: what the fuller ones hold beyond capacity is cut off and fills the others."""
    out, over = [], []
    for items in groups:
        window, beyond = _cut_to([rests[i] for i in items], capacity)
        out.append(window)
        over += beyond
    for window in out:
        short = capacity - sum(r[2] for r in window)
        if short:
            more, over = _cut_to(over, short)
            window += more
    return out


def _pack(tokenizer_path: str, end_id: int, capacity: int, cut: bool, words: int):
    owner = ("ids", tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, number = T.kept(owner, lambda: Encoder(tokenizer_path, words)), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        rests: list[tuple] = []
        waiting = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary() if k == 6 else pa.int64()) for k in range(7)], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        def placed(windows: list[list[tuple]]) -> None:
            nonlocal number
            for window in windows:
                at = 0
                for doc, start, length, total, ids in window:
                    rows.append((doc, start, length, total, number, at, ids))
                    at += length
                number += 1

        def differenced(rests: list[tuple]) -> list[list[tuple]]:
            groups = windows_of(np.array([r[2] for r in rests], np.int64), capacity, cut)
            return _level(rests, groups, capacity) if cut else [[rests[i] for i in items] for items in groups]

        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for a, ids, at in encoder.encode(batch.column("text"), end_id):
                blob, at = ids.tobytes(), at.tolist()
                for i in range(len(at) - 1):
                    total = at[i + 1] - at[i]
                    for start in range(0, total, capacity):
                        length = min(capacity, total - start)
                        piece = blob[4 * (at[i] + start) : 4 * (at[i] + start + length)]
                        if length == capacity:
                            rows.append((docs[a + i], start, length, total, number, 0, piece))
                            number += 1
                        else:
                            rests.append((docs[a + i], start, length, total, piece))
                            waiting += length
                while waiting >= WINDOWS * capacity:
                    some, rests = _cut_to(rests, WINDOWS * capacity) if cut else (rests, [])
                    waiting = sum(r[2] for r in rests)
                    placed(differenced(some))
                if len(rows) >= 500:
                    yield batch_of(rows)
                    rows.clear()
        some, rests = _cut_to(rests, waiting // capacity * capacity) if cut else (rests, [])
        if some:
            placed(differenced(some))
        # what is left is less than a window: sequences of powers of two, which need no padding
        while rests:
            some, rests = _cut_to(rests, 1 << (sum(r[2] for r in rests).bit_length() - 1))
            placed([some])
        if rows:
            yield batch_of(rows)
        T.tidy(owner)

    return run


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, cut: bool = True, words: int = CACHED_WORDS) -> DataFrame:
    """The pieces of docs (doc_id, text) with their place in a packed sequence and their ids (32-bit little-endian).

    Every id of every row lies in one piece. A null or empty text is end_id alone. Repeated rows are packed each on their own;
    a null doc_id stays null; other columns are not read. No rows: none. Sequence ids are unique, not dense.
    With cut, windows are levelled by cuts and only sequences of a power of two are shorter than capacity; without, a rest stays
    whole and the window count rises until none exceeds capacity. A worker keeps the ids of at most about `words` words.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_pack(tokenizer_path, end_id, capacity, cut, words), SCHEMA)


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizer())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
