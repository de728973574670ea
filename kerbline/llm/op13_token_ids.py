"""Token ids as bit-packed binary files in ascending doc_id order, and reading them back, whole or at random places.

Documents are cut into ranges of doc_id and sorted there: one shuffle of the texts. Each task tokenizes its range and streams one file through Spark's own
writer, so that files are committed as those of any Spark job and lie wherever Spark can write. A file is

    block, line end, block, line end, ..., footer, line end

A block holds up to `block_ids` ids, each in the fewest bits that hold the vocabulary, highest bit first, without gaps. The footer is a list of little-endian
numbers: the blocks' offsets, the documents' ids and where each begins; its last 32 bytes say how large it is. So a reader finds the block of any id
by division, and numpy unpacks it in a few calls. Files state their place in the order (range) themselves.

The tokenizer parts a text before white space that follows a letter, digit or mark, whatever stands around, so a text is tokenized in such units, each once a
worker, and blocks of text become ids by sorting, searching and gathering in numpy.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.llm import text as T
from kerbline.llm.common import bounded_batches, checkpoint, shared_folder, table

CACHED_UNITS, TEXT_BLOCK, LONG_UNIT, BLOCK_IDS = 600_000, 1 << 21, 256, 1 << 16
MAGIC = 0x314B434150544942
TAIL = 4  # numbers at a footer's end: documents, blocks, width, magic

# bit packing ---------------------------------------------------------------------------------------------------------------


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids of width bits each, highest bit first; the last byte is filled with zeros."""
    wide = np.ascontiguousarray(ids, ">u4").view(np.uint8).reshape(-1, 4)
    if width % 8 == 0:
        return wide[:, 4 - width // 8 :].tobytes()
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - width :]).tobytes()


def unpack(data: bytes | np.ndarray, width: int, n: int) -> np.ndarray:
    """The first n ids of packed data."""
    data = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    wide = np.zeros((n, 4), np.uint8)
    if width % 8 == 0:
        wide[:, 4 - width // 8 :] = data[: n * width // 8].reshape(n, -1)
    else:
        bits = np.zeros((n, 32), np.uint8)
        bits[:, 32 - width :] = np.unpackbits(data[: -(-n * width // 8)])[: n * width].reshape(n, width)
        wide = np.packbits(bits, axis=1)
    return wide.reshape(-1).view(">u4").astype(np.uint32)


class TokenFile:
    """A file's ids by place. data is the file's bytes (or a memory map of them)."""

    def __init__(self, data):
        self.data = np.frombuffer(data, np.uint8)
        tail = self._numbers(len(self.data) - 1 - 8 * TAIL, TAIL)
        if int(tail[3]) != MAGIC:
            raise ValueError("not a file of token ids")
        documents, blocks, self.width = (int(x) for x in tail[:3])
        size = 2 * documents + documents + 1 + blocks + 1 + 2
        numbers = self._numbers(len(self.data) - 1 - 8 * (TAIL + size), size)
        self.doc_ids, self.known, self.starts, rest = np.split(numbers, [documents, 2 * documents, 3 * documents + 1])
        self.offsets, (self.range, self.block_ids) = rest[: blocks + 1], (int(x) for x in rest[blocks + 1 :])

    def _numbers(self, at: int, n: int) -> np.ndarray:
        return np.frombuffer(self.data[at : at + 8 * n].tobytes(), "<i8")

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids of places [start, stop) of the file; only their blocks are read."""
        first, parts = start // self.block_ids, []
        for k in range(first, -(-stop // self.block_ids) if stop > start else first):
            n = min(self.block_ids, int(self.starts[-1]) - k * self.block_ids)
            parts.append(unpack(self.data[self.offsets[k] : self.offsets[k + 1] - 1], self.width, n))
        whole = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return whole[start - first * self.block_ids : stop - first * self.block_ids]

    def document(self, i: int) -> np.ndarray:
        """Ids of the file's document number i."""
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


# tokenizing ----------------------------------------------------------------------------------------------------------------

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
_CUT = np.isin(np.arange(256), [0x20, 0x0A])
_PRINTED = (np.arange(256) > 0x20) & (np.arange(256) < 0x7F)
_SPACED2, _SPACED3 = np.arange(256) == 0xC2, np.isin(np.arange(256), [0xE1, 0xE2, 0xE3])  # first bytes of the white space outside ASCII


def _ends_safe(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the sign before each place is surely no white space and no control sign."""
    last, two, three = (np.where(at >= k, data[np.maximum(at - k, 0)], 0) for k in (1, 2, 3))
    return _PRINTED[last] | ((last >= 0x80) & ~_SPACED2[two] & ~_SPACED3[three])


def cuts(data: np.ndarray) -> np.ndarray:
    """Places before spaces and line feeds where tokens surely part."""
    at = np.flatnonzero(_CUT[data])
    at = at[at > 0]
    return at[_ends_safe(data, at)]


def unit_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of units, eight bytes at a time."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) + 1, "<u8", held, strides=(1,))
    left = ends - starts
    a = T.mix(left.astype(np.uint64) + np.uint64(0x51ED270B35A4C9E1))
    b = T.mix(left.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    open_, at = np.arange(len(starts)), starts
    while len(open_):
        lane = lanes[at] & _MASK[np.minimum(left, 8)]
        a[open_] = T.mix(a[open_] ^ lane)
        b[open_] = T.mix(b[open_] * np.uint64(0x9FB21C651E98DF25) + lane)
        more = left > 8
        open_, at, left = open_[more], at[more] + 8, left[more] - 8
    return a, b


class Encoder:
    """Token ids of texts by a byte-level tokenizer that parts words before white space. A unit is tokenized once and kept, at most about `units` of them."""

    def __init__(self, tokenizer_path: str, units: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(tokenizer_path)
        vocabulary = self.full.get_vocab()
        added = {i: token.content for i, token in self.full.get_added_tokens_decoder().items()}
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of each token; a printed letter stands for a byte
        for token, i in vocabulary.items():
            self.bytes[i] = len(added[i].encode()) if i in added else len(token)
        self.table = T.WordTable(units)
        self.check, self.pool, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _tokens(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units, and how many each has. Those that begin with a space and end safely are tokenized side by side, as in a text."""
        joined = _CUT[data[s]] & _ends_safe(data, e)
        length, parts = np.zeros(len(s), np.int64), []
        some = np.flatnonzero(joined)
        for a in range(0, len(some), 2048):
            i = some[a : a + 2048]
            size = e[i] - s[i]
            to = np.cumsum(size)
            whole = data[np.repeat(s[i] - (to - size), size) + np.arange(to[-1])]
            ids = np.array(self.full.encode_batch_fast([whole.tobytes().decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)
            reached = np.cumsum(self.bytes[ids])
            ends = np.searchsorted(reached, to) + 1
            if ends[-1] != len(ids) or (reached[ends - 1] != to).any():
                raise ValueError("tokens cross the white space between words")
            length[i] = np.diff(ends, prepend=0)
            parts.append(ids)
        rest = np.flatnonzero(~joined)
        for a in range(0, len(rest), 2048):
            i = rest[a : a + 2048]
            found = [x.ids for x in self.full.encode_batch_fast([data[s[k] : e[k]].tobytes().decode("utf-8", "replace") for k in i], add_special_tokens=False)]
            length[i] = [len(x) for x in found]
            parts.append(np.array([x for ids in found for x in ids], np.uint32))
        pool = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        order = np.concatenate([some, rest])
        start = np.zeros(len(s), np.int64)
        start[order] = np.cumsum(length[order]) - length[order]
        return _gathered(pool, start, length), length

    def _known(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray | None:
        """The numbers of units, new ones learnt; None if two different ones share their first hash, which is then no name for them."""
        a, b = unit_hashes(data, s, e)
        some, first, back = np.unique(a, return_index=True, return_inverse=True)
        slots = self.table.find(some)
        hit = slots >= 0
        if (b[first][back] != b).any() or (self.check[slots[hit]] != b[first[hit]]).any():
            return None
        if not hit.all():
            kept = self.table.full(int((~hit).sum()))
            if kept is not None:
                self.pool, self.check, self.length = _gathered(self.pool, self.start[kept], self.length[kept]), self.check[kept], self.length[kept]
                self.start = np.cumsum(self.length) - self.length
                slots = self.table.find(some)
            new = slots < 0
            slots[new] = self.table.add(some[new])
            place = first[new]
            ids, length = self._tokens(data, s[place], e[place])
            self.start, self.length = np.concatenate([self.start, len(self.pool) + np.cumsum(length) - length]), np.concatenate([self.length, length])
            self.pool, self.check = np.concatenate([self.pool, ids]), np.concatenate([self.check, b[place]])
        return slots[back]

    def _block(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units of a block, in order, and how many each has. Long units are tokenized each time."""
        apart = e - s > LONG_UNIT
        short, apart = np.flatnonzero(~apart), np.flatnonzero(apart)
        slots = self._known(data, s[short], e[short])
        if slots is None:
            return self._tokens(data, s, e)
        own, n = self._tokens(data, s[apart], e[apart])
        start, length = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
        start[short], length[short] = self.start[slots], self.length[slots]
        start[apart], length[apart] = len(self.pool) + np.cumsum(n) - n, n
        return _gathered(np.concatenate([self.pool, own]) if len(own) else self.pool, start, length), length

    def encode(self, column: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows with end_id after each, and where each row's begin (one entry more than rows). A null text is an empty one."""
        data, offsets = T.utf8(column)
        parts, sizes, begins, p = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        while p < len(data):
            step = TEXT_BLOCK
            while True:
                q = min(p + step, len(data))
                rows = offsets[np.searchsorted(offsets, p) : np.searchsorted(offsets, q, "right")]
                begins_here = np.zeros(q - p, bool)
                begins_here[cuts(data[p:q])] = True
                begins_here[rows[rows < q] - p] = True
                begins_here[0] = True
                starts = np.flatnonzero(begins_here) + p
                if q == len(data):
                    break
                if len(starts) > 1:  # the last unit may go on
                    q = int(starts[-1])
                    starts = starts[:-1]
                    break
                step *= 2
            ends = np.append(starts[1:], q)
            ids, length = self._block(data[p:q], starts - p, ends - p)
            parts.append(ids)
            sizes.append(length)
            begins.append(starts)
            p = q
        before = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        at = before[np.searchsorted(np.concatenate(begins), offsets)]
        return np.insert(np.concatenate(parts), at[1:], end_id).astype(np.uint32), at + np.arange(len(at))


def _gathered(pool: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs of pool that begin at start, one after another."""
    to = np.cumsum(length)
    return pool[np.repeat(start - (to - length), length) + np.arange(to[-1] if len(to) else 0)]


# files ---------------------------------------------------------------------------------------------------------------------


def _written(tokenizer_path: str, end_id: int, units: int, block_ids: int):
    owner = ("byte ids", tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = T.kept(owner, lambda: Encoder(tokenizer_path, units))
        width = bits_for(max(len(encoder.bytes), end_id + 1))
        held, docs, known, starts, offsets = [np.zeros(0, np.uint32)], [], [], [np.zeros(1, np.int64)], [0]

        def row(block: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], names=["block"])

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate(held)
            end = len(ids) if last else len(ids) // block_ids * block_ids
            for k in range(0, end, block_ids):
                block = pack(ids[k : min(k + block_ids, end)], width)
                offsets.append(offsets[-1] + len(block) + 1)
                yield row(block)
            held[:] = [ids[end:]]

        for batch in batches:
            ids, at = encoder.encode(batch.column("text"), end_id)
            held.append(ids)
            column = batch.column("doc_id")
            docs.append(column.fill_null(0).to_numpy(zero_copy_only=False))
            known.append(column.is_valid().to_numpy(zero_copy_only=False).astype(np.int64))
            starts.append(starts[-1][-1] + at[1:])
            yield from full(False)
        if docs:
            yield from full(True)
            n = sum(map(len, docs))
            tail = [TaskContext.get().partitionId(), block_ids, n, len(offsets) - 1, width, MAGIC]
            yield row(np.concatenate([*docs, *known, *starts, offsets, tail]).astype("<i8").tobytes())
        T.tidy(owner)

    return run


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, block_ids: int = BLOCK_IDS, units: int = CACHED_UNITS) -> None:
    """Files of the ids of all rows of docs (doc_id, text) in a new folder, end_id after each text, in ascending order of doc_id.

    A null text is an empty one: end_id alone. Rows without a doc_id come first; rows of one doc_id follow the hashes of their texts, and repeated rows are
    written each. Texts of any length are tokenized whole. Other columns are not read. No rows: no file with ids.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    blocks = rows.mapInArrow(_written(tokenizer_path, end_id, units, block_ids), "block binary")
    # bytes pass the text writer as they are
    blocks.select(F.col("block").cast("string").alias("value")).write.option("lineSep", "\n").text(folder)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column("content"):
            file = TokenFile(content.as_buffer())
            step = max(1, (1 << 22) // file.block_ids) * file.block_ids  # ids at once
            crc, done, n = np.zeros(len(file.doc_ids), np.int64), 0, int(file.starts[-1])
            for a in range(0, n, step):
                ids = file.ids(a, min(a + step, n)).astype("<u4")
                first = done
                while done < len(crc) and file.starts[done] < a + step:
                    done += 1
                for i in range(max(first - 1, 0), done):
                    crc[i] = zlib.crc32(ids[max(file.starts[i] - a, 0) : max(file.starts[i + 1] - a, 0)], crc[i])
            numbers = [np.full(len(crc), file.range), file.doc_ids, file.starts[:-1], np.diff(file.starts), crc]
            arrays = [pa.array(x, pa.int64()) for x in numbers]
            arrays[1] = pa.array(file.doc_ids, pa.int64(), mask=file.known == 0)
            yield pa.RecordBatch.from_arrays(arrays, names=["range", "doc_id", "at", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files: ids of all documents before it, its own with the end id, and their checksum.

    A task reads one file at a time; the files' numbers of ids are summed in their order.
    """
    files = spark.read.format("binaryFile").load(folder).where("length > 0").select("content")
    rows = checkpoint(files.mapInArrow(_read, "range long, doc_id long, at long, n_tokens long, ids_crc32 long"))
    order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    before = rows.groupBy("range").agg(F.sum("n_tokens").alias("n")).select("range", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    return rows.join(before, "range").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op13_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents"), folder, public_tokenizer())
    return read(spark, folder)
