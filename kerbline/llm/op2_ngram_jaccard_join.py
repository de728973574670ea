"""N-gram Jaccard join: all links between documents' shingle sets, as components.

The metric is the Jaccard distance d = 1 - |x & y| / |x | y|, links are the pairs with d <= r = 1 - threshold.

1. First pivots are the one-shingle sets. In the order (corpus count, hash) of shingles, linked sets x and y share a
   smallest shingle c, and all shingles of either before c lie outside the other; so x must be in the cells of its first
   |x| - ceil(threshold |x|) + 1 shingles only. That is its triangle-inequality window around those pivots, and rare shingles
   come first, so that cells are small. Within a cell the windows around the empty set (sizes) and around the shingles
   before c (positions) drop every set that can link to no other. One shingle more in each window, and linked sets share
   two: pairs that meet once, in one small cell, are chance and go. (So links must share two shingles: percent >= 67.)
2. The set with the least position in a cell, the one nearest to the others, is the document pivot. A pivot's Voronoi
   region is the sets that share a cell with it; boundary documents stand in all such regions. Every link lies in a region.
3. A region of at most LEAF sets is joined exactly, by a product of its incidence matrix. A larger one is split once more:
   rings of width r around the pivot, of which only equal and neighbouring ones can link, cut into blocks of LEAF / 2 sets.

Equal sets are one set from the start, and links are given as a spanning forest of each region, so a group of copies
costs a row each. A document pivot alone can't start the recursion: unrelated texts are all at distance 1 from it, and its
window would hold the corpus; hence step 1.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import text as T
from kerbline.llm.common import bounded_batches, checkpoint, components, marked, salted_join, table

BUCKET_BITS, PARTS, LEAF, SMALL = 20, 64, 1024, 8


def _needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    return (percent * n + 99) // 100


def _sets(column: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    for a, h, at in T.words(column):
        s, to = T.shingles(h, at, size)
        for i in range(len(to) - 1):
            yield a + i, np.unique(s[to[i] : to[i + 1]])


def _key(x: np.ndarray) -> int:
    """A set's identity, together with its size."""
    h = np.array([np.bitwise_xor.reduce(T.mix(x))]) + np.add.reduce(x, keepdims=True)
    return int(T.mix(h).view(np.int64)[0])


def _bucket(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _summaries(size: int):
    """Per document its size and key; per task the counts of its distinct sets' shingles by hash bucket, in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen = np.zeros(1 << BUCKET_BITS, np.int32), set()
        for batch in batches:
            n, key = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            held: list[np.ndarray] = []
            for i, x in _sets(batch.column("text"), size):
                n[i], key[i] = len(x), _key(x)
                if key[i] not in seen:
                    seen.add(int(key[i]))
                    held.append(x)
                if len(held) == 500:
                    counts += np.bincount(_bucket(np.concatenate(held)), minlength=len(counts)).astype(np.int32)
                    held.clear()
            if held:
                counts += np.bincount(_bucket(np.concatenate(held)), minlength=len(counts)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n": n, "key": key, "part": pa.nulls(len(n), pa.int32()), "counts": pa.nulls(len(n), pa.binary())})
        if seen:
            blobs = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, PARTS)]
            none = pa.nulls(PARTS, pa.int64())
            yield pa.RecordBatch.from_pydict({"doc_id": none, "n": none, "key": none, "part": pa.array(range(PARTS), pa.int32()), "counts": pa.array(blobs, pa.binary())})
        T.tidy()

    return run


def _sum_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(blob), np.int32)
            total[part] = total[part] + x if part in total else x.astype(np.int64)
    if total:
        yield pa.RecordBatch.from_pydict({"part": pa.array(total, pa.int32()), "counts": pa.array([np.minimum(x, 2**31 - 1).astype(np.int32).tobytes() for x in total.values()], pa.binary())})


def _cells(size: int, percent: int, counts):
    """(token, pos, key, n) for each distinct set of the task and each shingle of its window, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = np.frombuffer(counts.value, np.int32), set()

        def out(held: list) -> pa.RecordBatch:
            length = [len(x) for x, _, _ in held]
            return pa.RecordBatch.from_pydict({
                "token": np.concatenate([x for x, _, _ in held]).view(np.int64), "pos": np.concatenate([np.arange(m, dtype=np.int32) for m in length]),
                "key": np.repeat(np.array([k for _, k, _ in held], np.int64), length), "n": np.repeat(np.array([n for _, _, n in held], np.int64), length),
            })

        for batch in batches:
            held: list[tuple[np.ndarray, int, int]] = []
            for _, x in _sets(batch.column("text"), size):
                if not len(x) or (key := _key(x)) in seen:
                    continue
                seen.add(key)
                window = min(len(x), len(x) - _needed(len(x), percent) + 2)
                c = count[_bucket(x)]
                order = np.flatnonzero(c <= np.partition(c, window - 1)[window - 1]) if window < len(x) else np.arange(len(x))
                held.append((x[order[np.argsort(c[order], kind="stable")][:window]], key, len(x)))
                if len(held) == 500:
                    yield out(held)
                    held.clear()
            if held:
                yield out(held)
        T.tidy()

    return run


def _packed_sets(size: int, wanted):
    """The sets of the documents whose id passes wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted(batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False))))
            held = [(_key(x), pack(x)) for _, x in _sets(batch.column("text"), size)]
            for a in range(0, len(held), 500):
                yield pa.RecordBatch.from_pydict({"key": [k for k, _ in held[a : a + 500]], "shingles": [x for _, x in held[a : a + 500]]})
        T.tidy()

    return run


def pack(x: np.ndarray) -> bytes:
    """The upper 48 bits of each hash: enough to tell a few thousand shingles of two texts apart."""
    return x.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(blob: bytes) -> np.ndarray:
    x = np.zeros((len(blob) // 6, 8), np.uint8)
    x[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return x.reshape(-1).view(">u8").astype(np.uint64)


def _runs(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[pa.Table]:
    """Whole groups of rows with equal by, in sorted input, many groups at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(by).to_numpy()
        if x[0] == x[-1] and held and held[-1].column(by)[-1].as_py() == x[0]:
            held.append(batch)
            continue
        cut = int(np.flatnonzero(x == x[-1])[0])
        if cut or held:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _can(p: np.ndarray, q: np.ndarray, m: np.ndarray, k: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of m and k shingles can link if their first or second common one has the positions p and q."""
    return (100 * np.minimum(m, k) >= percent * np.maximum(m, k)) & ((p + q - 2) * (100 + percent) <= (100 - percent) * (m + k))


def _partner(pos: np.ndarray, n: np.ndarray, percent: int, block: int = 2048) -> np.ndarray:
    """Which sets of a cell can link to another by size and position."""
    can = np.zeros(len(pos), bool)
    for a in range(0, len(pos), block):
        for b in range(a, len(pos), block):
            p, q, m, k = pos[a : a + block, None], pos[None, b : b + block], n[a : a + block, None], n[None, b : b + block]
            ok = _can(p, q, m, k, percent)
            if a == b:
                np.fill_diagonal(ok, False)
            can[a : a + block] |= ok.any(1)
            can[b : b + block] |= ok.any(0)
    return can


def _pivots(percent: int):
    """From cells sorted by token, position and key: (pivot, key) for each set that can link to another of its cell.

    A cell of at most SMALL sets gives its pairs instead, as a pair must have two common shingles in the windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "token"):
            token, pos, key, n = (rows.column(c).to_numpy() for c in ("token", "pos", "key", "n"))
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (pos[1:] != pos[:-1]) | (key[1:] != key[:-1]) | (n[1:] != n[:-1])])
            token, pos, key, n = token[new], pos[new].astype(np.int64), key[new], n[new]  # a set comes from each task that has it
            start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            length = np.diff(np.concatenate([start, [len(token)]]))
            small: list[np.ndarray] = []
            large: list[np.ndarray] = []
            for w in range(2, SMALL + 1):
                at = start[length == w]
                for x, y in [(at + i, at + j) for i in range(w) for j in range(i + 1, w)]:
                    ok = _can(pos[x], pos[y], n[x], n[y], percent)
                    small.append(np.sort(np.stack([key[x[ok]], key[y[ok]]]), axis=0))
            for s, w in zip(start[length > SMALL], length[length > SMALL], strict=True):
                can = s + np.flatnonzero(_partner(pos[s : s + w], n[s : s + w], percent))
                large.append(np.stack([np.full(len(can), key[can[0]] if len(can) else 0), key[can]]))
            for found, alone in ((small, True), (large, False)):
                if found and (pairs := np.concatenate(found, axis=1)).shape[1]:
                    pairs = pairs if alone else np.unique(pairs, axis=1)
                    yield pa.RecordBatch.from_pydict({"pivot": pairs[0], "key": pairs[1], "small": np.full(pairs.shape[1], alone)})

    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections: rare shingles pair by pair, frequent ones by products of incidence matrices."""
    own = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    token = np.concatenate(sets)
    order = np.argsort(token, kind="stable")
    token, own = token[order], own[order]
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    length = np.diff(np.concatenate([start, [len(token)]]))
    both = np.zeros(len(sets) ** 2, np.float32)
    for w in range(2, 9):
        at = start[length == w]
        pairs = [own[at + i] * len(sets) + own[at + j] for i in range(w) for j in range(w) if i < j]
        both += np.bincount(np.concatenate(pairs), minlength=len(both)).astype(np.float32)
    both = both.reshape(len(sets), len(sets))
    both += both.T
    heavy = np.flatnonzero(length > 8)
    for a in range(0, len(heavy), 2048):
        some = heavy[a : a + 2048]
        m = np.zeros((len(sets), len(some)), np.float32)
        for column, g in enumerate(some):
            m[own[start[g] : start[g] + length[g]], column] = 1
        both += m @ m.T
    return both


def _forest(keys: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Every set of a block with the first set that links lead it to, itself left out."""
    n = np.array([len(x) for x in sets])
    inner = overlaps(sets)
    link = 100 * inner >= percent * (n[:, None] + n[None, :] - inner)
    root = np.full(len(sets), -1)
    for i in range(len(sets)):
        if root[i] >= 0:
            continue
        root[i], edge = i, np.array([i])
        while len(edge):
            edge = np.flatnonzero(link[edge].any(0) & (root < 0))
            root[edge] = i
    far = np.flatnonzero(root != np.arange(len(sets)))
    return keys[root[far]], keys[far]


_FOUND = "a long, b long, pivot long, ring int, n long, shingles binary"


def _found(a=None, b=None, pivot=None, ring=None, n=None, shingles=None) -> pa.RecordBatch:
    size = len(a) if a is not None else len(pivot)
    none = lambda x, kind: pa.nulls(size, kind) if x is None else pa.array(x, kind)
    return pa.RecordBatch.from_pydict({"a": none(a, pa.int64()), "b": none(b, pa.int64()), "pivot": none(pivot, pa.int64()), "ring": none(ring, pa.int32()), "n": none(n, pa.int64()), "shingles": none(shingles, pa.binary())})


def _regions(percent: int):
    """Regions sorted by pivot, the pivot's own set first: links of small ones; of large ones the members by ring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, center, more = None, [], None, False

        def rings(rows: list) -> pa.RecordBatch:
            ring = []
            for _, x in rows:
                inner = len(np.intersect1d(x, center, assume_unique=True))
                distance = 1 - inner / (len(x) + len(center) - inner)
                ring.append(int(distance / (1 - percent / 100 + 1e-9)))
            return _found(pivot=[now] * len(rows), ring=ring, n=[len(x) for _, x in rows], shingles=[pack(x) for _, x in rows], b=[k for k, _ in rows], a=[k for k, _ in rows])

        def done() -> Iterator[pa.RecordBatch]:
            if more and held:
                yield rings(held)
            elif len(held) > 1:
                a, b = _forest(np.array([k for k, _ in held]), [x for _, x in held], percent)
                if len(a):
                    yield _found(a=a, b=b)

        for batch in batches:
            for pivot, key, blob in zip(batch.column("pivot").to_pylist(), batch.column("key").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                if pivot != now:
                    yield from done()
                    now, held, more = pivot, [], False
                    center = unpack(blob)
                held.append((key, unpack(blob)))
                if len(held) > LEAF:
                    yield rings(held)
                    held, more = [], True
        yield from done()
        T.tidy()

    return run


def _blocks(percent: int):
    """The links of each block of a large region; rows come sorted by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                a, b = _forest(np.array([k for k, _ in held]), [x for _, x in held], percent)
                if len(a):
                    yield pa.RecordBatch.from_pydict({"a": a, "b": b})

        for batch in batches:
            for block, key, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "key", "shingles")), strict=True):
                if block != now:
                    yield from done()
                    now, held = block, []
                held.append((key, unpack(blob)))
        yield from done()

    return run


def _large(rows: DataFrame, percent: int) -> DataFrame:
    """Links within large regions: each pair of blocks in equal or neighbouring rings is one task's work."""
    size = rows.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / (LEAF // 2)).cast("int").alias("blocks"))
    next_ring = size.select("pivot", (F.col("ring") - 1).alias("ring"), F.col("blocks").alias("after"))
    before = size.select("pivot", (F.col("ring") + 1).alias("ring"), F.col("blocks").alias("before"))
    every = rows.join(size, ["pivot", "ring"]).join(next_ring, ["pivot", "ring"], "left").join(before, ["pivot", "ring"], "left")
    own = F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int")
    up_to = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda ring, i, j: F.concat_ws(":", "pivot", ring, i, j)
    every = every.withColumn("own", own).select(
        F.col("b").alias("key"), "shingles",
        F.explode(F.concat(
            F.transform(up_to(F.col("blocks")), lambda j: block(F.col("ring"), F.least("own", j), F.greatest("own", j))),
            F.transform(up_to(F.col("after")), lambda j: F.concat_ws(":", F.lit("up"), "pivot", "ring", "own", j)),
            F.transform(up_to(F.col("before")), lambda j: F.concat_ws(":", F.lit("up"), "pivot", F.col("ring") - 1, j, "own")),
        )).alias("block"),
    )
    return every.repartition("block").sortWithinPartitions("block", "key").mapInArrow(_blocks(percent), "a long, b long")


def similar_sets(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    Two documents link when their sets of size-word shingles have 100 * |x & y| >= percent * |x | y|; component_id is the
    smallest doc_id that links lead to. A text of fewer words is one shingle; a null text or one without words has none and
    links to nothing. Rows with a repeated doc_id stay and get their own set's size; other columns are not read. No rows: none.
    """
    if not 67 <= percent <= 100:
        raise ValueError("percent must be from 67 to 100")
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    read = checkpoint(docs.mapInArrow(_summaries(size), "doc_id long, n long, key long, part int, counts binary"))
    counts = np.zeros((PARTS, (1 << BUCKET_BITS) // PARTS), np.int32)
    summed = read.where("part is not null").select("part", "counts").repartition(PARTS, "part").mapInArrow(_sum_counts, "part int, counts binary")
    for part, blob in summed.collect():  # PARTS rows at most, 4 MB together
        counts[part] = np.frombuffer(blob, np.int32)
    held = spark.sparkContext.broadcast(counts.tobytes())
    cells = docs.mapInArrow(_cells(size, percent, held), "token long, pos int, key long, n long")
    members = cells.repartition("token").sortWithinPartitions("token", "pos", "key", "n").mapInArrow(_pivots(percent), "pivot long, key long, small boolean")
    members = members.groupBy("pivot", "key").agg(F.count("*").alias("times"), F.min("small").alias("small")).where("not small or times > 1")
    members = checkpoint(members.select(F.explode(F.array(F.struct("pivot", "key"), F.struct("pivot", F.col("pivot").alias("key")))).alias("x")).select("x.*").distinct())
    ids = read.where("part is null").select("doc_id", "n", "key")
    first = checkpoint(ids.where("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    wanted = first.join(members.select("key").distinct(), "key", "left_semi").select("rep")
    sets = docs.where(F.col("doc_id").isNotNull()).mapInArrow(_packed_sets(size, marked(wanted)), "key long, shingles binary").dropDuplicates(["key"])
    regions = members.join(sets, "key").repartition("pivot").sortWithinPartitions("pivot", F.col("key") != F.col("pivot"), "key")
    found = checkpoint(regions.mapInArrow(_regions(percent), _FOUND))
    links = found.where("pivot is null").select("a", "b")
    large = found.where("pivot is not null")
    if not large.isEmpty():
        links = links.union(_large(large, percent))
    rep = first.groupBy("key").agg(F.min("rep").alias("rep"))
    links = links.join(rep.select(F.col("key").alias("a"), F.col("rep").alias("x")), "a").join(rep.select(F.col("key").alias("b"), F.col("rep").alias("y")), "b")
    root = components(links, "x", "y").withColumnsRenamed({"node": "rep", "root": "component_id"})
    # a large group of copies is dealt to several tasks; a set without copies stands for itself
    ids = salted_join(ids, first.where("copies > 1").drop("copies"), ["key", "n"], "doc_id", "left").withColumn("own", F.coalesce("rep", "doc_id")).drop("rep")
    out = salted_join(ids, root.withColumnRenamed("rep", "own"), "own", "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "own").alias("component_id"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"), size=4, percent=85)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM w),
t AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT a AS doc_id, a AS reached FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.c, s.doc_id) AS component_id
FROM s LEFT JOIN (SELECT doc_id, min(reached) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""
