"""Hard negatives, collocations and files of token ids."""

import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from kerbline.llm import op11_hard_negatives as op11
from kerbline.llm import op12_collocations as op12
from kerbline.llm import op13_token_ids as op13
from kerbline.llm import registry
from kerbline.llm.common import shared_folder

DATA = "/root/testdata/sf0.001"


def _plain_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op13.public_tokenizer())


def _odd_texts(n: int, seed: int) -> list[str | None]:
    rng = random.Random(seed)
    parts = ["a", "Bé", "straße", "'s", "don't", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x85", " ", " ", "　", "’", "中文", "123", "!?", "é", "\U0001f600", "\x00", "\x1c", "<|endoftext|>", "word", "x" * 300, "-", "à ", "Ω"]
    return [None, "", " ", *["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(n)]]


@pytest.mark.parametrize("width", [1, 3, 8, 13, 16, 17, 24, 32])
def test_packing_of_bits(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype(np.uint32)
    packed = op13.pack(ids, width)
    assert len(packed) == -(-1001 * width // 8) and (op13.unpack(packed, width, 1001) == ids).all()
    assert int.from_bytes(packed[: 2 * width], "big") >> 15 * width == int(ids[0])
    assert op13.bits_for(50257) == 16 and op13.bits_for(65536) == 16 and op13.bits_for(65537) == 17 and op13.bits_for(1) == 1


@pytest.mark.parametrize("block", [1 << 22, 64])
def test_ids_are_the_tokenizers(monkeypatch, block):
    monkeypatch.setattr(op13, "TEXT_BLOCK", block)
    plain, encoder = _plain_tokenizer(), op13.Encoder(op13.public_tokenizer(), 300)
    for seed in range(4):
        texts = _odd_texts(150, seed)
        ids, at = encoder.encode(pa.array(texts, pa.string()), 2)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 2], text


def test_units_of_equal_hashes_stay_apart(monkeypatch):
    monkeypatch.setattr(op13, "unit_hashes", lambda data, s, e: (np.zeros(len(s), np.uint64), (data[s] + e - s).astype(np.uint64)))
    plain, encoder, text = _plain_tokenizer(), op13.Encoder(op13.public_tokenizer(), 100), "one fourteen two three"
    for t in (text, "one", text):
        assert encoder.encode(pa.array([t]), 2)[0].tolist() == [*plain.encode(t).ids, 2]
    signs = ["a"]
    for _ in range(11):  # words of which plain polynomial hashes are equal
        signs = signs + ["b" if x == "a" else "a" for x in signs]
    word = "".join(signs)[:200], "".join(signs)[200:400], "".join(signs[:2048]), "".join("b" if x == "a" else "a" for x in signs[:2048])
    encoder = op13.Encoder(op13.public_tokenizer(), 100)
    for t in word:
        assert encoder.encode(pa.array([t]), 2)[0].tolist() == [*plain.encode(t).ids, 2]


def _files(spark, rows, folder, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, tie string")
    op13.write(docs.repartition(3), folder, op13.public_tokenizer(), **more)
    return op13.read(spark, folder).orderBy("start").collect()


def test_files_hold_all_documents_in_order(spark):
    texts = _odd_texts(60, 9)
    rows = [(i * 7 - 100, t, i, "clash") for i, t in enumerate(texts)] + [(None, "no id", 0, None), (-100, "same id", 0, None), (-100, "same id", 0, None)]
    random.Random(1).shuffle(rows)
    folder, plain = f"{shared_folder(spark)}/odd-ids", _plain_tokenizer()
    got = _files(spark, rows, folder, block_ids=64)
    ids = lambda text: [*plain.encode(text or "", add_special_tokens=False).ids, 2]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert sorted([(r.doc_id, r.n_tokens, r.ids_crc32) for r in got], key=repr) == sorted([(d, len(ids(t)), crc(ids(t))) for d, t, *_ in rows], key=repr)
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    # random places of the files
    by_id = {}
    for d, t, *_ in rows:
        by_id.setdefault(d, []).append(ids(t))
    for content in [r.content for r in spark.read.format("binaryFile").load(folder).where("length > 0").collect()]:
        file = op13.TokenFile(content)
        assert file.width == 16 and file.block_ids == 64
        whole = file.ids(0, int(file.starts[-1]))
        for i, doc in enumerate(file.doc_ids):
            assert file.document(i).tolist() in by_id[int(doc) if file.known[i] else None]
        for a in range(0, len(whole), 37):
            assert (file.ids(a, min(a + 50, len(whole))) == whole[a : a + 50]).all()


def test_files_of_nothing_and_of_one_id(spark):
    assert _files(spark, [], f"{shared_folder(spark)}/no-ids") == []
    got = _files(spark, [(7, f"text {i % 50}", i, None) for i in range(400)], f"{shared_folder(spark)}/one-id")
    assert len(got) == 400 and sum(r.n_tokens for r in got) == got[-1].start + got[-1].n_tokens
    with pytest.raises(ValueError, match="not a file"):
        op13.TokenFile(b"\0" * 100)


def test_ids_of_all_documents(spark):
    got, plain, at = op13.op13_token_ids(spark, DATA).orderBy("doc_id").collect(), _plain_tokenizer(), 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    assert len(got) == len(docs)
    for r, doc in zip(got, docs, strict=True):
        ids = [*plain.encode(doc.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


# collocations --------------------------------------------------------------------------------------------------------------


def _plain_collocations(docs, words, least, best, percent):
    counts, total = Counter(), Counter()
    for lang, text in docs:
        g = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            total[g] += len(ws)
            counts.update((g, tuple(ws[i : i + n])) for n in range(1, words + 1) for i in range(len(ws) - n + 1))
    rows = {}
    for (g, ph), a in counts.items():
        if len(ph) < 2 or a < least:
            continue
        longer = [f for (h, q), f in counts.items() if h == g and f >= least and len(q) > len(ph) and any(q[i : i + len(ph)] == ph for i in range(len(q))) and 100 * f >= percent * a]
        score, k = min((1_000_000 * a * a // (counts[g, ph[:k]] * counts[g, ph[k:]]), k) for k in range(1, len(ph)))
        if not longer:
            rows.setdefault(g, []).append((-score, -a, " ".join(ph).encode(), counts[g, ph[:k]], counts[g, ph[k:]]))
    return sorted((g, i + 1, ph.decode(), -a, l, r, total[g], -s) for g, found in rows.items() for i, (s, a, ph, l, r) in enumerate(sorted(found)[:best]))


@pytest.mark.parametrize("words, least, best, percent", [(3, 3, 2000, 50), (4, 2, 7, 60), (2, 2, 5, 50), (5, 3, 50, 90)])
def test_collocations_against_plain_counts(spark, words, least, best, percent):
    rng = random.Random(words)
    signs = ["a", "b", "C", "c", "é", "a a", "New York city", "d\x00", ".", ", ", "!\n", "\t", "  ", "\r\x0b", " \U0001f600", "ﬀ"]
    docs = [(rng.choice(["x", "x", "y", None, "und"]), " ".join(rng.choice(signs) for _ in range(rng.randrange(40)))) for _ in range(60)] + [("x", None), ("y", ""), ("z", " . "), (None, None)] + [("x", "new york city new york")] * 20
    frame = spark.createDataFrame([(i, t, g, 1, "w1") for i, (g, t) in enumerate(docs)], "doc_id long, text string, lang string, f int, phrase string").repartition(3)
    got = op12.collocations(frame, words, least, best, percent).collect()
    assert sorted((r.g, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got) == _plain_collocations(docs, words, least, best, percent)


def test_collocations_of_nothing(spark):
    frame = spark.createDataFrame([], "text string, lang string")
    assert op12.collocations(frame).count() == 0 and op12.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 4_000_000_000_000
    phrases = spark.createDataFrame([("g", ["a"], big), ("g", ["b"], big + 1), ("g", ["a", "b"], big - 1)], "g string, phrase array<string>, f long")
    assert op12.scored(phrases).first().score == 1_000_000 * (big - 1) ** 2 // (big * (big + 1))


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_collocations"])
def test_new_queries_against_sql(spark, name):
    duck = duckdb.connect()
    for f in os.listdir(DATA):
        duck.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got) == sorted(want) and len(want)
    assert sorted(map(tuple, got[sorted(got)].values.tolist())) == sorted(map(tuple, want[sorted(want)].values.tolist()))


# hard negatives ------------------------------------------------------------------------------------------------------------


def _plain_mine(rows, positives, negatives, low, high):
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731, B905
    out = []
    for a, label, v, anchor in rows:
        if not anchor:
            continue
        others = [(-dot(v, w), i, other) for i, other, w, _ in rows if i != a]
        for p, pid, _ in sorted(x for x in others if x[2] == label)[:positives]:
            fits = sorted(x for x in others if x[2] != label and low * -p <= 100 * -x[0] <= high * -p)[:negatives]
            out += [(a, pid, k + 1, i, -p, -s) for k, (s, i, _) in enumerate(fits)]
    return sorted(out)


def _mined(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id long, label int, v array<long>, anchor boolean, cell string, centre int").repartition(3)
    return sorted(tuple(r) for r in op11.mine(frame, **more).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("seed, leaf, cell", [(1, 2, 50), (2, 8, 2048), (3, 4, 7)])
def test_hard_negatives_against_all_pairs(spark, monkeypatch, seed, leaf, cell):
    monkeypatch.setattr(op11, "CELL", cell)
    monkeypatch.setattr(op11, "QUERIES", 20)
    monkeypatch.setattr(op11.CoverTree.__init__, "__defaults__", (leaf,))
    rng = np.random.default_rng(seed)
    hot = rng.integers(-40, 40, 6)
    vectors = [*(hot + rng.integers(-1, 2, (120, 6))), *([hot] * 40), *rng.integers(-50, 50, (200, 6)), *([np.zeros(6, np.int64)] * 5)]
    rows = [(i - 30, int(rng.integers(3)), [int(x) for x in v], i % 9 == 0) for i, v in enumerate(vectors)]
    assert _mined(spark, rows) == _plain_mine(rows, 5, 10, 30, 90)
    assert _mined(spark, rows, positives=2, negatives=300, low=-50, high=100) == _plain_mine(rows, 2, 300, -50, 100)


def test_odd_vectors(spark):
    rows = [(1, 0, [3, 4], True), (2, 0, [5], False), (3, 1, [2, 1, 9], False), (4, 1, [], False), (5, 9, [1 << 40, 3], True), (6, 9, [1 << 20, 1], False), (7, 1, [(1 << 19) + 1, 7], False)]
    assert _mined(spark, rows) == _plain_mine(rows, 5, 10, 30, 90)
    repeated = [*rows, rows[0], rows[2], (None, 0, [1], True), (8, None, [1], True), (9, 0, None, True)]
    assert _mined(spark, repeated) == _plain_mine(rows, 5, 10, 30, 90)
    assert _mined(spark, []) == [] and _mined(spark, rows[:1]) == [] and _mined(spark, [(i, 0, [1], False) for i in range(9)]) == []


def test_trees_cover_and_skip():
    rng = np.random.default_rng(5)
    centres = rng.integers(-3000, 3000, (40, 8))
    vectors = np.concatenate([c + rng.integers(-20, 20, (50, 8)) for c in centres])
    tree = op11.CoverTree(np.arange(2000), np.zeros(2000, int), vectors, 8)
    assert sorted(tree.ids) == list(range(2000)) and len(tree.radius) > 100
    for centre, radius, (begin, end, child, last) in zip(tree.centre, tree.radius, tree.ranges, strict=True):
        x = tree.vectors[begin:end].astype(float)
        lift = lambda v: np.sqrt(np.maximum(tree.square - (v**2).sum(-1), 0))
        d = np.sqrt(((x - tree.vectors[centre]) ** 2).sum(1) + (lift(x) - lift(tree.vectors[centre].astype(float))) ** 2)
        assert begin <= centre < end and d.max() <= radius * (1 + 1e-9) + 1e-6
        assert not child or (tree.ranges[child][0], tree.ranges[last - 1][1]) == (begin, end)
    seen, plain = [], op11.CoverTree.products
    tree.products = lambda rows, q: (seen.append(len(tree.vectors[rows])), plain(tree, rows, q))[1]
    q = vectors[17]
    assert tree.best(q, [(None, None)], 5, lambda ids, labels: ids >= 0)[0] == sorted(((int(s), i) for i, s in enumerate(vectors @ q)), key=lambda x: (-x[0], x[1]))[:5]
    assert sum(seen) < 700  # of 2,000 points and their nodes


def test_embeddings_that_take_no_part(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(i * 10, [((i * 7 + k * 3) % 11 - 5) / 5.0 for k in range(4)], i % 2) for i in range(60)] + [(1000, None, 1), (1100, [1.0, None], 1), (1200, [nan, 1.0], 0), (1300, [inf, 0.0], 0), (1400, [1.0, 1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0, 1.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in op11.op11_hard_negatives(spark, str(tmp_path)).select(*names).collect()]
    assert sorted(got) == sorted(duck.sql(f"select {', '.join(names)} from ({op11.ORACLE_SQL})").fetchall()) and got


def test_windows_are_the_same_however_blocks_fall(spark, monkeypatch):
    texts = ["a b. c D", None, "", " x\ty ", "no marks at all in this text", "e,f;g\nh", "é é é! ü"]
    def counted():  # noqa: E306
        seen = Counter()
        column = pa.array(texts, pa.string())
        for words in op12.blocks(column):
            number, known = words.numbered()
            known = known.to_pylist()
            seen.update((int(words.row[i]), known[number[i]], known[number[i + 1]] if words.joined[i] else None) for i in range(len(number)))
        return seen
    whole = counted()
    assert whole[4, "no", "marks"] == 1 and whole[0, "b", None] == 1 and whole[0, "c", "d"] == 1 and whole[3, "x", "y"] == 1 and whole[6, "é", "é"] == 2
    for block in (1, 5, 16):
        monkeypatch.setattr(op12, "BLOCK", block)
        assert counted() == whole


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"a b c{i % 3} d e f{i % 5} a b. a b c1", "en") for i in range(60)], "doc_id long, text string, lang string")
    rows = lambda: sorted(map(tuple, op12.collocations(frame).collect()))
    want = rows()
    monkeypatch.setattr(op12, "marked", lambda keys, bits: lambda pairs: np.ones(len(pairs), bool))
    assert rows() == want and want
