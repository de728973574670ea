"""Brute-force versions, small cases and edge cases of the operators on texts."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbline.llm import op1_decontamination as op1
from kerbline.llm import op2_ngram_jaccard_join as op2
from kerbline.llm import op4_packing as op4
from kerbline.llm import op6_quality as op6
from kerbline.llm import op7_fingerprints as op7
from kerbline.llm import op8_toxicity as op8
from kerbline.llm import op9_pii as op9
from kerbline.llm import text as T

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, toxicity string, extra int"


def _docs(spark, texts):
    return spark.createDataFrame([(i, x, "old", 1) for i, x in enumerate(texts)], SCHEMA)


ODD = [None, "", "   \n", "one", "two words", "é ñ 漢字", "same text here again and on", "same text here again and on", "a" * 5000 + " b", "x " * 3000]


# Words and shingles.


def test_words_are_the_same_however_blocks_fall(monkeypatch):
    random.seed(1)
    texts = ["".join(random.choice("aB cé\n") for _ in range(random.randint(0, 300))) for _ in range(50)] + [None, "", "word " * 200]

    def every():
        return [x for a, h, at in T.words(pa.array(texts)) for x in (tuple(h[at[i] : at[i + 1]].tolist()) for i in range(len(at) - 1))]

    whole = every()
    words = [[w for w in (x or "").encode().lower().split()] for x in texts]
    assert [len(x) for x in whole] == [len(x) for x in words]
    by = {}
    for a, b in zip(whole, words):
        for h, w in zip(a, b):
            assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)
    monkeypatch.setattr(T, "BLOCK", 64)
    assert every() == whole


# 2.


def _plain_components(texts, size, percent):
    sets = []
    for x in texts:
        w = (x or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            inner = len(sets[i] & sets[j])
            if inner and 100 * inner >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize("leaf,small", [(1024, 8), (4, 2)])
def test_components_against_all_pairs(spark, monkeypatch, leaf, small):
    monkeypatch.setattr(op2, "LEAF", leaf)
    monkeypatch.setattr(op2, "SMALL", small)
    random.seed(2)
    base = [[f"w{random.randint(0, 400)}" for _ in range(random.randint(3, 60))] for _ in range(12)]
    texts = list(ODD)
    for words in base * 6:
        copy = list(words)
        for _ in range(random.randint(0, 3)):
            copy[random.randrange(len(copy))] = f"n{random.randint(0, 9999)}"
        texts.append(" ".join(copy))
    found = op2.similar_sets(_docs(spark, texts), 4, 85)
    assert sorted(tuple(r) for r in found.collect()) == _plain_components(texts, 4, 85)


def _alike(n):
    """A word of n letters and its complement, of one hash modulo 2 ** 64 in any base."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_made_to_collide(spark, n):
    from tokenizers import Tokenizer

    one, two = _alike(n)
    data = np.frombuffer(one.encode(), np.uint8).astype(object) - np.frombuffer(two.encode(), np.uint8)
    assert sum(int(x) * pow(T._BASE, i, 1 << 64) for i, x in enumerate(data)) % (1 << 64) == 0  # they do collide there
    ((_, h, at),) = T.words(pa.array([one, two, one.upper()]))
    assert h[0] != h[1] and h[0] == h[2] and np.diff(at).tolist() == [1, 1, 1]
    docs = _docs(spark, [None, one, two, one])
    assert [r.component_id for r in op2.similar_sets(docs).orderBy("doc_id").collect()] == [0, 1, 2, 1]
    tokenizer = Tokenizer.from_file(op4.public_tokenizer())
    whole = {}
    for r in op4.pack(docs, op4.public_tokenizer()).orderBy("doc_id", "start").collect():
        whole[r.doc_id] = whole.get(r.doc_id, b"") + bytes(r.ids)
    assert whole == {i: np.array([*tokenizer.encode(x, add_special_tokens=False).ids, 2], "<u4").tobytes() for i, x in enumerate(["", one, two, one])}
    benchmark = spark.createDataFrame([(5, one)], "item_id long, text string")
    assert sorted(r.doc_id for r in op1.contaminated(docs, benchmark).collect()) == [1, 3]


def test_hashes_of_words_modulo_primes(monkeypatch):
    monkeypatch.setattr(T, "_SUMMED", 7)
    random.seed(4)
    text = " ".join("".join(random.choice("abXYZ\u00e9") for _ in range(random.randint(1, 30))) for _ in range(60))
    data = np.frombuffer(text.encode(), np.uint8)
    ((_, _, at, s, e),) = T.words(pa.array([text]), spans=True)
    for k, (prime, base) in enumerate(T._PRIMES):
        plain = [sum((int(x) + 1) * pow(base, i, prime) for i, x in enumerate(data[a:b])) % prime for a, b in zip(s, e, strict=True)]
        assert T._residues(data.astype(np.uint64) + np.uint64(1), s, e, k).tolist() == plain


def test_components_of_nothing(spark):
    assert op2.similar_sets(_docs(spark, []).where("doc_id is not null")).count() == 0
    with pytest.raises(ValueError):
        op2.similar_sets(_docs(spark, ["a"]), percent=50)


def test_overlaps():
    random.seed(3)
    sets = [np.array(sorted(random.sample(range(60), random.randint(1, 40))), np.uint64) for _ in range(30)]
    assert (op2.overlaps(sets).astype(int) == [[len(set(a.tolist()) & set(b.tolist())) if i != j else op2.overlaps(sets)[i, j] for j, b in enumerate(sets)] for i, a in enumerate(sets)]).all()
    assert (op2.unpack(op2.pack(np.array([2**63 + 2**20, 5 << 16], np.uint64))) == np.array([2**63 + 2**20, 5 << 16], np.uint64)).all()


# 1.


def test_contamination_against_all_windows(spark):
    random.seed(4)
    word = lambda: random.choice("abcdefgh") * random.randint(1, 3)
    items = [" ".join(word() + str(random.randint(0, 99)) for _ in range(random.choice((3, 12, 12, 30)))) for _ in range(12)]
    texts = list(ODD)
    for _ in range(40):
        body = [word() for _ in range(random.randint(0, 80))]
        item = random.choice(items).split()
        if random.random() < 0.6:
            for _ in range(random.choice((0, 0, 1, 4))):
                item[random.randrange(len(item))] = "zz"
            at = random.randint(0, len(body))
            body[at:at] = item
        texts.append(" ".join(body).upper() if random.random() < 0.2 else " ".join(body))
    texts += items[:2]
    benchmark = spark.createDataFrame(list(enumerate(items)) + [(None, "null id"), (99, None)], "item_id long, text string")
    bags = [Counter(_grams(x.lower().split())) for x in items]
    held = Counter(g for bag in bags for g in bag)
    weight = lambda g: 1 / held[g] if g in held else 1.0
    expected = {}
    for d, text in enumerate(texts):
        words = (text or "").lower().encode().split()
        words = [w.decode() for w in words]
        for i, bag in enumerate(bags):
            n = len(items[i].split())
            for s in range(len(words) - n + 1):
                other = Counter(_grams(words[s : s + n]))
                both = sum(weight(g) * min(c, bag[g]) for g, c in other.items())
                every = sum(weight(g) * max(bag[g], other[g]) for g in set(bag) | set(other))
                if both / every >= 0.8 - 1e-12:
                    expected[d, i] = max(expected.get((d, i), 0), both / every)
    found = {(r.doc_id, r.item_id): r.similarity for r in op1.contaminated(_docs(spark, texts), benchmark).collect()}
    assert found == pytest.approx(expected) and found
    kept = op1.decontaminate(_docs(spark, texts), benchmark)
    assert {r.doc_id for r in kept.collect()} == set(range(len(texts))) - {d for d, _ in expected}
    assert op1.contaminated(_docs(spark, texts), benchmark.where("item_id < 0")).count() == 0


def test_contamination_is_the_same_in_blocks_and_with_repeated_items(spark, monkeypatch):
    random.seed(14)
    common = [f"c{i}" for i in range(30)]
    items = [[f"w{i}x{j}" for j in range(59)] for i in range(8)]
    for i in range(1, 8):
        items[i][10:40] = common  # shared by seven items, in different blocks
    texts = []
    for i, item in enumerate(items):
        for at in (3, 30, 58):
            texts.append(" ".join([*item[:at], "changed", *item[at + 1 :]]))
        texts.append(" ".join(["before", *item[:9], *common, *items[(i + 1) % 8][40:], "after"]))
    rows = [(i, " ".join(x)) for i, x in enumerate(items)]

    def found(rows):
        benchmark = spark.createDataFrame(rows, "item_id long, text string")
        kept = op1.decontaminate(_docs(spark, texts), benchmark)
        assert kept.columns == ["doc_id", "text", "toxicity", "extra"]
        return sorted(op1.contaminated(_docs(spark, texts), benchmark).collect()), sorted(r.doc_id for r in kept.collect())

    whole, kept = found(rows)
    assert {(r.doc_id, r.item_id) for r in whole} >= {(0, 0), (1, 0), (2, 0)}
    again = [(100 + k, x.upper() if k % 2 else x) for k, (_, x) in enumerate([rows[0]] * 9 + rows[1:3])]
    more, kept_more = found(rows + again)
    assert [r for r in more if r.item_id < 100] == whole and kept_more == kept
    monkeypatch.setattr(op1, "BLOCK_BYTES", 700)
    assert found(rows) == (whole, kept)
    monkeypatch.setattr(op1, "WEIGHTS", 8)
    assert found(rows) == (whole, kept)
    monkeypatch.setattr(op1, "BLOCK_BYTES", 16 << 20)
    assert found(rows) == (whole, kept)


def test_contamination_of_documents_shorter_than_the_item(spark):
    item = [f"w{j}" for j in range(59)]
    texts = [" ".join(x) for x in (item[:-1], item[1:], item[2:-2], item[:30], item[:3], ["other", *item[:57]], item)]
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: (r.similarity, r.start_word, r.n_words) for r in op1.contaminated(_docs(spark, texts), benchmark).collect()}
    assert found == {0: (pytest.approx(54 / 55), 0, 58), 1: (pytest.approx(54 / 55), 0, 58), 2: (pytest.approx(51 / 55), 0, 55), 5: (pytest.approx(53 / 56), 0, 58), 6: (1, 0, 59)}
    assert {r.doc_id for r in op1.decontaminate(_docs(spark, texts), benchmark).collect()} == {3, 4}


def _grams(w, size=5):
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [tuple(w)] if w else []


# 4.


def test_packing_is_a_partition_of_all_ids(spark):
    from tokenizers import Tokenizer

    texts = [*ODD, "Hello, World!! don't 3.14 İx " * 700, "<|endoftext|> ok"]
    rows = op4.pack(_docs(spark, texts), op4.public_tokenizer(), capacity=512).collect()
    tokenizer = Tokenizer.from_file(op4.public_tokenizer())
    for d, x in enumerate(texts):
        ids = [*tokenizer.encode(x or "", add_special_tokens=False).ids, 2]
        pieces = sorted((r.start, r.length, bytes(r.ids)) for r in rows if r.doc_id == d)
        assert b"".join(p[2] for p in pieces) == np.array(ids, "<u4").tobytes()
        assert [p[0] for p in pieces] == list(np.cumsum([0] + [p[1] for p in pieces])[:-1]) and all(r.doc_tokens == len(ids) for r in rows if r.doc_id == d)
    for s in {r.sequence_id for r in rows}:
        own = sorted((r.offset, r.length) for r in rows if r.sequence_id == s)
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(n for _, n in own) <= 512
    assert op4.pack(_docs(spark, []), op4.public_tokenizer()).count() == 0


def test_the_search_misses_few_windows_just_above_the_threshold():
    random.seed(21)
    items = [" ".join(f"w{random.randint(0, 5000)}" for _ in range(random.choice((20, 35, 59)))) for _ in range(150)]
    index = op1.Index(list(range(len(items))), items, 5, np.zeros(0, op1._PAIR), [None] * len(items))
    met = near = 0
    for i, item in enumerate(items):
        for _ in range(12):
            words = item.split()
            for at in sorted(random.sample(range(len(words)), random.randint(1, 2))):
                words[at] = f"z{random.randint(0, 5000)}"
            a, b = (set(zip(*[x[k:] for k in range(5)])) for x in (words, item.split()))
            value = len(a & b) / len(a | b)
            if 0.8 <= value < 0.9:
                near += 1
                met += any(r[1] == i for r in index.matches(pa.array([" ".join(words)]), None, 0.8))
    assert near > 300 and met >= 0.995 * near


def test_buckets_hold_all_items_within_the_radius():
    random.seed(22)
    items = [" ".join(f"w{random.randint(0, 900)}" for _ in range(12)) for _ in range(150)]
    index = op1.Index(list(range(len(items))), items, 5, np.zeros(0, op1._PAIR), [None] * len(items))
    prints = np.array([int(index.print[random.randrange(150)]) ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 24))) for _ in range(400)], np.uint64)
    every = np.bitwise_count(prints[:, None] ^ index.print[None, :])
    expected = {(int(p), int(i), int(every[p, i])) for p, i in np.argwhere(every <= op1.RADIUS)}
    assert {tuple(map(int, x)) for x in index.within(prints, 12)} == expected and len(expected) > 200


def test_decontamination_keeps_all_else(spark):
    item = " ".join(f"b{i}" for i in range(14))
    rows = [(1, f"x {item} y", "a"), (1, "clean", "b"), (1, "clean", "b"), (None, None, None), (2, "", ""), (None, item.upper(), "c"), (3, "says yes now", "d"), (4, "yes", "e"), (5, "yesterday", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string").withColumn("similarity", F.lit(1))
    benchmark = spark.createDataFrame([(7, item, 1), (7, item, 1), (8, "Yes", 1), (None, "clean", 1), (9, None, 1), (10, "", 1)], "item_id long, text string, doc_id int")
    kept = op1.decontaminate(docs, benchmark)
    assert kept.schema == docs.schema and sorted((r.item_id or "") for r in kept.collect()) == ["", "", "b", "b", "f"]
    clash = docs.withColumns({"__shared_shingles": F.lit(1), "shared_shingles": F.lit("x")})
    assert op1.decontaminate(clash, benchmark).schema == clash.schema and op1.decontaminate(clash, benchmark).count() == op1.decontaminate(docs, benchmark).count()
    assert op1.decontaminate(docs.where("doc_id > 99"), benchmark).count() == 0 and op1.decontaminate(docs, benchmark.where("item_id > 99")).count() == len(rows)
    assert sorted({(r.doc_id, r.item_id) for r in op1.contaminated(docs, benchmark).collect()}, key=repr) == sorted([(1, 7), (None, 7), (3, 8), (4, 8)], key=repr)


@pytest.mark.parametrize("cut", [True, False])
def test_packing_wastes_little(spark, cut):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").coalesce(2)
    rows = op4.pack(docs.unionByName(docs.where("doc_id < 9")), op4.public_tokenizer(), cut=cut, words=3000).toPandas()
    load = rows.groupby("sequence_id").length.sum()
    assert load.max() == 4096 and rows.duplicated(["sequence_id", "offset"]).sum() == 0
    padded = load[(load & (load - 1)) != 0]
    assert (4096 - padded).sum() == 0 if cut else (4096 - padded).sum() < 0.06 * load.sum()
    assert (rows[rows.doc_id < 9].groupby(["doc_id", "start"]).size() >= 2).all() or cut
    total = rows[rows.doc_id >= 9].groupby("doc_id").agg(total=("length", "sum"), whole=("doc_tokens", "max"))
    assert (total.total == total.whole).all()


def test_packing_words_as_the_tokenizer(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(op4.public_tokenizer())
    random.seed(8)
    letters = "abzAZ09\u00e9\u00c9\u00df\u00ff\u00d7\u00f7\u00bb\u00ab.,;:!?'\"-  \n\t\x0b\u00a0\u2003\u0301\u0130\u03a3\u03c2\u65e5\U0001f642|"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 50))) for _ in range(2000)] + ["a<|endoftext|>b", "It's.", None]
    encoder, seen = op4.Encoder(op4.public_tokenizer(), 500), 0  # so few that words are forgotten
    for a, ids, at in encoder.encode(pa.array(texts * 3, pa.string()), 2):
        for i in range(len(at) - 1):
            assert ids[at[i] : at[i + 1]].tolist() == [*plain.encode((texts * 3)[a + i] or "", add_special_tokens=False).ids, 2]
            seen += 1
    assert seen == 3 * len(texts)


def test_differencing():
    random.seed(5)
    sizes = np.array([random.randint(1, 4000) for _ in range(600)])
    found = op4.differencing(sizes, 40)
    assert sorted(i for w in found for i in w) == list(range(600))
    loads = [sizes[w].sum() for w in found]
    assert max(loads) - min(loads) < 0.01 * max(loads)
    full = op4.windows_of(sizes, 4096)
    assert all(sizes[w].sum() <= 4096 for w in full) and sizes.sum() / (4096 * len(full)) > 0.95


# 6, 8.


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = op6.fit(docs, labels.where(~held))
    both = op6.score(docs, model).join(labels.where(held), "doc_id").select("quality_score", "quality").toPandas()
    assert ((both.quality_score >= 0.7) == (both.quality == 1)).mean() > 0.95
    odd = op6.score(_docs(spark, ODD), model)
    assert odd.count() == len(ODD) and odd.where("quality_score between 0 and 1").count() == len(ODD)
    assert op6.fit(docs, labels.where("doc_id < 0")).predict(np.zeros((1, len(op6.FEATURES)))) == pytest.approx([0.5])


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    model = op8.fit(docs, labels.where(~op8.held_out()))
    both = op8.score(docs, model).join(labels.where(op8.held_out()), "doc_id").select("toxicity", "toxic").toPandas()
    assert ((both.toxicity >= 0.5) == (both.toxic == 1)).mean() > 0.9
    odd = op8.score(_docs(spark, ODD), model)
    assert odd.columns[-1] == "toxicity" and odd.where("toxicity < 0.5").count() == len(ODD)
    kernel = op8.Landmarks([b"pathetic", b"worthless"])
    like, value = kernel.similar([b"PATHETIC,", b"p.a.t.h.e.t.i.c", b"pathxetic", b"random", b"worthlessness"])
    best = dict(zip(like.tolist(), value.max(1).tolist(), strict=True))
    assert best[0] == pytest.approx(1, abs=1e-5) and best[1] == pytest.approx(1, abs=1e-5) and best[2] > 0.1 and 3 not in best and best[4] > 0.9


# 7.


def test_fingerprints(spark):
    docs = _docs(spark, [*ODD, "a b c d e f g h " * 30])
    prints = {r.doc_id: r.fingerprint for r in op7.fingerprints(docs).collect()}
    assert prints[6] == prints[7] and prints[0] == prints[1] == prints[2] == "" and prints[3] != prints[4]
    by = op7.with_next(docs.select("doc_id", "text"), ["text"]).collect()
    ids = sorted((r.doc_id for r in by), reverse=True)
    texts = {r.doc_id: r.text for r in by}
    assert all(r.next_text == texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]] for r in by)
    assert op7.with_next(docs.where("doc_id < 0").select("doc_id", "text"), ["text"]).count() == 0


def test_fingerprint_components_against_plain_order_minhash(spark):
    import xxhash

    text = " ".join(random.Random(6).choice("abcde") for _ in range(300))

    def signed(x):
        return x - (1 << 64) if x >= 1 << 63 else x

    def spark_hash(*parts):
        seed = 42
        for p in parts:
            seed = xxhash.xxh64(p if isinstance(p, bytes) else int(p).to_bytes(4 if isinstance(p, np.int32) else 8, "little", signed=True), seed=seed).intdigest()
        return signed(seed)

    words, seen, least = text.split(), Counter(), {}
    for i in range(len(words) - 2):
        kmer = spark_hash(*[w.encode() for w in words[i : i + 3]]) >> 24
        z = spark_hash(int(kmer), np.int32(seen[kmer])) >> 24
        seen[kmer] += 1
        slot = z >> 34  # the upper six of 40 bits
        least[slot] = min(least.get(slot, (1 << 62, 0)), (z, i))
    expected = []
    for pair in sorted({s >> 1 for s in least}):
        two = sorted((least[s] for s in (2 * pair, 2 * pair + 1) if s in least), key=lambda x: x[1])
        expected.append(f"{pair + 16:02X}{spark_hash(*[int(z) for z, _ in two]) & (2**64 - 1):016X}")
    assert op7.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().fingerprint == "".join(expected)


def test_fingerprint_query_against_plain_edits(spark):
    rows = {r.doc_id: r for r in op7.op7_fingerprints(spark, DATA).collect()}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    edited = {}
    for i, d in enumerate(order):
        text, next_ = texts[d], texts[order[(i + 1) % len(order)]]
        half = len(text) // 2
        edited[d] = text[: len(text) - half] + next_[:half]
    prints = {r.doc_id: r.fingerprint for r in op7.fingerprints(spark.createDataFrame(list(edited.items()), "doc_id long, text string")).collect()}
    own = {r.doc_id: r.fingerprint for r in op7.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}

    def like(a, b):
        x, y = ({p[i : i + 18] for i in range(0, len(p), 18)} for p in (a, b))
        places = {p[:2] for p in x | y}
        return len(x & y) / len(places) if places else 1.0

    assert set(rows) == set(texts)
    for i, d in enumerate(order):
        r = rows[d]
        assert r.n_chars == len(texts[d]) and r.edited_sha256 == hashlib.sha256(edited[d].encode()).hexdigest()
        assert r.fingerprint == own[d] and r.edited_fingerprint == prints[d]
        assert r.near_edited == pytest.approx(like(own[d], prints[d])) and r.near_next == pytest.approx(like(own[d], own[order[(i + 1) % len(order)]]))


def test_fingerprints_keep_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c d", 1), (1, "a b c d", 1), (None, None, 2)], "doc_id long, text string, f_words int").withColumns({c: F.lit(c) for c in ("f_kmers", "F_LEAST", "n_range", "n_to", "n_key", "n_next", "f_components")})
    got = op7.fingerprints(docs)
    assert got.columns == [*docs.columns, "fingerprint"] and got.count() == 3 and {r.F_LEAST for r in got.collect()} == {"F_LEAST"}
    after = op7.with_next(docs, ["text"])
    assert after.columns == [*docs.columns, "next_text"] and sorted(r.next_text or "" for r in after.collect()) == ["", "a b c d", "a b c d"]
    assert op7.op7_fingerprints.__name__ and op7.fingerprints(docs.where("doc_id > 9")).count() == 0


# 6.


def test_statistics_against_plain_counts():
    random.seed(31)
    texts = [None, "", "One two! Three, |x| 42 é", "\n".join("word Word, 7 #a" for _ in range(30)), " ".join(random.choice(["a", "Bc", "d1!", "é,", "ff."]) for _ in range(500))]
    got = op6.statistics(pa.array(texts, pa.string()))
    for row, text in zip(got, texts, strict=True):
        words = (text or "").split()
        lower = [w.lower() for w in words]
        triples = [tuple(lower[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [tuple(lower)] if words else []
        plain = {
            "log_words": np.log1p(len(words)), "word_length": np.mean([len(w.encode()) for w in words]) if words else 0, "distinct_words": len(set(lower)) / max(1, len(words)),
            "same_as_before": sum(a == b for a, b in zip(lower, lower[1:])) / max(1, len(words)), "top_word": max(Counter(lower).values(), default=0) / max(1, len(words)),
            "distinct_triples": len(set(triples)) / max(1, len(triples)), "digits": sum(c in "0123456789" for c in text or "") / max(1, len((text or "").encode())),
            "commas": sum(w.endswith(",") for w in words) / max(1, len(words)), "newlines": (text or "").count("\n") / max(1, len((text or "").encode())),
            "one_letter_words": sum(len(w.encode()) == 1 for w in words) / max(1, len(words)),
        }
        for name, value in plain.items():
            assert row[op6.FEATURES.index(name)] == pytest.approx(value, abs=1e-5), (name, text)


def test_flat_trees_walk_as_nested_ones():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(800, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] * x[:, 1] > 0)).astype(float)
    trees = op6.grow(x, y)

    def walk(row, node):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]

    plain = [1 / (1 + np.exp(-(trees.start + sum(walk(row, root) for root in trees.roots)))) for row in x[:100]]
    assert trees.predict(x[:100]) == pytest.approx(np.array(plain)) and ((trees.predict(x) > 0.5) == y).mean() > 0.9


def test_classifiers_with_odd_labels(spark):
    docs = spark.createDataFrame([(i % 30, f"some text {i % 30} with words") for i in range(90)], "doc_id long, text string").withColumns({"quality_score": F.lit(7), "x": F.lit("x")})
    labels = spark.createDataFrame([(i, None if i % 3 else 1, 2 if i % 2 else None) for i in range(30)], "doc_id long, quality int, toxic int")
    scored = op6.score(docs, op6.fit(docs, labels))
    assert set(scored.columns) == {"doc_id", "text", "quality_score", "x"} and scored.count() == 90 and scored.where("quality_score between 0 and 1").count() == 90
    assert op6.score(docs.where("doc_id > 99"), op6.fit(docs.where("doc_id > 99"), labels)).count() == 0
    model = op8.fit(docs, labels)  # no class at all
    assert op8.score(docs.withColumn("toxicity", F.lit("old")), model).where("toxicity between 0 and 1").count() == 90
    assert op8.score(docs.where("doc_id > 99"), model).count() == 0


def test_kernel_values_by_plain_enumeration():
    from itertools import combinations as choose

    def features(word):
        out = Counter()
        for a, b, c in choose(range(len(word)), 3):
            if b - a <= op8.REACH and c - b <= op8.REACH:
                out[word[a], word[b], word[c]] += op8.DECAY ** (c - a - 2)
        return out

    def value(x, y):
        x, y = features(x), features(y)
        norm = lambda v: sum(n * n for n in v.values()) ** 0.5 + 1e-12
        return sum(n * y[k] for k, n in x.items()) / norm(x) / norm(y)

    marks, words = ["pathetic", "worthless", "moron"], ["pathxetic", "p4thetic", "worthl", "worthlessly", "morn", "house", "mo", "patheticpathetic", "moronic"]
    like, got = op8.Landmarks([m.encode() for m in marks]).similar([w.encode() for w in words])
    found = {words[i]: row for i, row in zip(like.tolist(), got, strict=True)}
    for w in words:
        plain = lambda x: "".join(c if c.isalpha() else chr(0x4E00 + ord(c) % 6) for c in x)
        for k, m in enumerate(marks):
            best = max((v for n in (*op8.STARTS, len(w)) if n <= len(w) and (v := value(plain(w[:n]), m)) >= op8.LEAST), default=0.0)
            assert (found[w][k] if w in found else 0.0) == pytest.approx(best**op8.POWER, abs=1e-4), (w, m)


# 9.


def test_base_forms():
    text = "a.b+c@x-y.co.uk, 1.2.3.4 999.1.1.1, 4111 1111 1111 1111 +1 (555) 010-9999 x@y +12 @z.com 10.0.0.1.2.3.4.5"
    assert op9.joined(op9.base_spans(text)) == "email:0:15,ip:17:24,card:36:55,phone:56:73,ip:89:97,ip:98:105"
    assert op9.base_spans("") == [] and op9.base_spans("é 1.2.3.4")[0] == (2, 1, 9)


def test_contexts_discover_and_mask(spark):
    digits = lambda i: f"+1 555 010 {1000 + i}"
    texts = [f"so please call me at {digits(i)} tonight" for i in range(12)] + ["so please call me at 555 010 4242 tonight", None, "", "nothing 12 here", "mail q@w.org"]
    docs = spark.createDataFrame([(i, x, -1) for i, x in enumerate(texts)], "doc_id long, text string, n_chars long")
    found = {r.doc_id: r for r in op9.find(docs).collect()}
    assert found[0].n_phone == 1 and found[0].added is None
    assert [(x.start, op9.KINDS[x.k], x.end) for x in found[12].added] == [(21, "phone", 33)]
    masked = {r.doc_id: (r.text, r.n_chars) for r in op9.mask(docs).collect()}
    assert masked[12][0] == "so please call me at <PHONE> tonight" and masked[12][1] == len(masked[12][0])
    assert masked[16][0] == "mail <EMAIL>" and masked[13] == (None, -1) and masked[15] == ("nothing 12 here", -1) and len(masked) == len(texts)


def test_contexts_discover_in_texts_without_digits_and_numbers(spark):
    texts = [f"so please write to {c}{c}x@example.org tonight" for c in "abcdefghijkl"]
    texts += [f"so please write to person{c} (at) example (dot) org tonight" for c in "abcdefgh"] + ["nothing (at) all", None]
    for number in (lambda i: i, lambda i: None):
        docs = spark.createDataFrame([(number(i), x, 0) for i, x in enumerate(texts)], "doc_id long, text string, other_doc_key int")
        found = [(r.n_email, len(r.added or [])) for r in op9.find(docs).collect()]
        assert sorted(found) == sorted([(1, 0)] * 12 + [(0, 1)] * 8 + [(0, 0)] * 2)
        masked = [r.text for r in op9.mask(docs).collect()]
        assert masked.count("so please write to <EMAIL> tonight") == 20 and len(masked) == len(texts) and op9.mask(docs).schema == docs.schema


def test_secrets_and_forms(spark):
    key = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    texts = [f'we set token = "{key(i)}" once' for i in range(12)] + ['we set token = "abc12345" once', f'we set color = "{"ab" * 20}" once']
    texts += [f"at +1 (555) 010-{1000 + i} now" for i in range(12)] + ["at +1 (555) 010-4242 10.1.2.3 now"]  # too many digits in a row for the fixed form
    texts += [f"sum {4111111111111111 + i}" for i in range(40)]  # one in ten is a card number by its digits, which makes no form
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: r.added and [(op9.KINDS[x.k], texts[r.doc_id][x.start : x.end]) for x in r.added] for r in op9.find(docs).collect()}
    assert all(found[i] == [("secret", key(i))] for i in range(12)) and found[12] == [("secret", "abc12345")] and found[13] is None
    assert found[26] == [("phone", "+1 (555) 010-4242")] and not any(found[i] for i in range(14, 26)) and not any(found[i] for i in range(27, len(texts)))
    masked = {r.doc_id: r.text for r in op9.mask(docs).collect()}
    assert masked[12] == 'we set token = "<SECRET>" once' and masked[26] == "at <PHONE> <IP> now"


def _python_steps(df):
    """The most Python steps that one task of df runs: those of a path of its plan without an exchange between."""
    most, above = 0, []  # of the nodes above: column, steps since an exchange
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        name = line.lstrip(" :+-*()0123456789")
        if name:
            at = len(line) - len(line.lstrip(" :+-"))
            while above and above[-1][0] >= at:
                above.pop()
            steps = 0 if "Exchange" in name.split()[0] else (above[-1][1] if above else 0) + name.startswith(("MapInArrow", "ArrowEvalPython", "BatchEvalPython", "MapInPandas"))
            above.append((at, steps))
            most = max(most, steps)
    return most


def test_masking_runs_one_python_worker_a_task(spark):
    texts = [f"so please call me at +1 555 010 {1000 + i} tonight" for i in range(12)] + ["so please call me at 555 010 4242 tonight", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    twice = docs.mapInArrow(lambda batches: batches, docs.schema).mapInArrow(lambda batches: batches, docs.schema)
    assert _python_steps(twice) == 2 and _python_steps(docs) == 0
    masked = op9.mask(docs)
    assert _python_steps(masked) == 1 and masked.where("text like '%<PHONE>%'").count() == 13


def test_pii_odd_input(spark):
    rows = [(1, "mail q@w.org", 7, "x"), (1, "mail q@w.org", 7, "x"), (1, "other 1.2.3.4", 8, None), (None, "mail a@b.cd", 9, "z"), (2, None, 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash long, added string").withColumns({"more_spans": F.lit("keep"), "doc_key": F.lit(3)})
    masked = sorted(op9.mask(docs).collect(), key=repr)
    assert op9.mask(docs).schema == docs.schema and len(masked) == 5 and all(r.more_spans == "keep" and r.doc_key == 3 for r in masked)
    assert sorted((r.text_hash, r.added or "", r.text or "") for r in masked) == [(1, "", ""), (7, "x", "mail <EMAIL>"), (7, "x", "mail <EMAIL>"), (8, "", "other <IP>"), (9, "z", "mail <EMAIL>")]
    assert op9.mask(docs.where("doc_id > 99")).count() == 0 and op9.find(docs.where("doc_id > 99")).count() == 0
    assert [r.n_email for r in op9.find(docs.where("doc_id is null")).collect()] == [1]


def test_pii_of_long_texts_takes_time_in_proportion():
    import time

    def seconds(n):
        text = " ".join(f"{i}.5 x{i % 7}" for i in range(n)) + "," + ",".join(str(i) for i in range(n))
        began = time.process_time()
        spans = op9._occurrences(text, op9.base_spans(text))
        assert sum(1 for _ in op9._patterns(text, spans)) > n
        return time.process_time() - began

    assert seconds(40_000) < 12 * seconds(10_000) + 1


def _plain_bootstrap(rows):
    """The rounds of patterns and values, over plain dictionaries."""
    edges, kinds, shapes = {}, {}, {}
    for pattern, value, kind, shape in rows:
        edges.setdefault(pattern, set()).add(value)
        kinds[value], shapes[value] = max(kinds.get(value, -1), kind), max(shapes.get(value, 0), shape)
    open_ = {v for v in kinds if kinds[v] < 0 and shapes[v] > 0}
    score, last = {(v, k): 1.0 for v, k in kinds.items() if k >= 0}, -1
    while True:
        best = {}
        for p, values in edges.items():
            light = lambda v: v in open_ and not p.startswith(op9.FORM)
            whole = sum(op9.UNKNOWN if light(v) else 1.0 for v in values)
            for k in range(len(op9.KINDS)):
                own = {v: score[v, k] for v in values if (v, k) in score and (v not in open_ or light(v))}
                support = sum(x for v, x in own.items() if v not in open_ or x >= op9.CONFIDENCE)
                more = sum(max(x - op9.UNKNOWN, 0) for v, x in own.items() if light(v))
                if own and support >= op9.SUPPORT and sum(own.values()) / (whole + more) >= op9.CONFIDENCE:
                    best[p, k] = sum(own.values()) / (whole + more)
        raised = {}
        for (p, k), c in best.items():
            for v in edges[p] & open_:
                if shapes[v] >> k & 1:
                    raised[v, k] = raised.get((v, k), 1.0) * (1.0001 - c)
        total = round(sum(best.values()) + sum(1 - x for x in raised.values()), 3)
        if total <= last:
            return {(p, k) for p, k in best if best[p, k] == max(best.get((p, x), 0) for x in range(len(op9.KINDS)))}
        score.update({key: 1 - x for key, x in raised.items()})
        last = total


def test_patterns_against_plain_rounds(spark):
    random.seed(12)
    words, forms = ["call", "desk", "at", "lot", "ring", "no"], [lambda: f"+1 555 {random.randint(100, 999)} {random.randint(1000, 1040)}", lambda: f"555 {random.randint(100, 104)} {random.randint(1000, 1020)}", lambda: str(random.randint(0, 50)), lambda: f"u{random.randint(0, 30)}@w.org"]
    texts = []
    for _ in range(900):
        w = random.choice(words)
        texts.append(f"so {w} {random.choice(forms[:2] if w in ('call', 'desk', 'ring') else forms)()} end")
    rows = [tuple(r) for r in spark.createDataFrame([(i, x, i) for i, x in enumerate(texts)], "doc_id long, text string, text_hash long").mapInArrow(op9._read, op9._READ).where("pattern is not null").select("pattern", "value", "kind", "shape").collect()]
    found = {(r.pattern, r.k) for r in op9._bootstrap(spark.createDataFrame(rows, "pattern string, value string, kind int, shape int")).collect()}
    assert found == _plain_bootstrap(rows) and len(found) > 3


def test_contexts_found_through_discovered_values(spark):
    number = lambda chain, i: f"555 0{chain}0 {4000 + i}"
    contexts = ["please call me at {} tonight", "reach our desk on {} today", "fax papers over {} instead", "ring grandma via {} sundays", "pager code was {} formerly"]
    texts = [contexts[0].format(f"+1 555 010 {1000 + i}") for i in range(30)]
    for c in range(1, len(contexts)):  # each context shares values with the one before it only
        texts += [contexts[k].format(number(c, i)) for i in range(20) for k in (c - 1, c)]
    lone = [contexts[c].format(number(9, c)) for c in range(1, len(contexts))]
    other = [f"the lot numbered {number(8, i)} arrived" for i in range(9)]  # candidates alone make no pattern
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts + lone + other)], "doc_id long, text string")
    found = {r.doc_id: r.added and [(op9.KINDS[x.k], x.start, x.end) for x in r.added] for r in op9.find(docs).collect()}
    for i, text in enumerate(lone, len(texts)):
        assert found[i] == [("phone", text.index("555"), text.index("555") + 12)]
    assert all(found[i] for i in range(30, len(texts))) and not any(found[i] for i in [*range(30), *range(len(texts) + len(lone), len(docs.collect()))])


def test_digests_derive_from_results(spark):
    rows = op9.op9_pii(spark, DATA).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert all(r.base_sha256 == hashlib.sha256(op9.joined(op9.base_spans(docs[r.doc_id])).encode()).hexdigest() for r in rows) and len(rows) == len(docs)
    packed = op4.op4_packing(spark, DATA).collect()
    assert sum(r.length for r in packed) == sum({r.doc_id: r.doc_tokens for r in packed}.values()) and all(0 <= r.ids_crc32 < 2**32 for r in packed) and zlib
