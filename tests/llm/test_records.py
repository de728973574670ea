"""URL rules, conversations, archives and the pipeline."""

import pytest
from pyspark.sql import functions as F

from kerbline.llm import op3_url_filters as op3
from kerbline.llm import op5_chat_formatting as op5
from kerbline.llm import op10_warc as op10

DATA = "/root/testdata/sf0.001"


def test_fixed_rules(spark):
    urls = ["http://A.Example.net/en/1", "https://x.net/", "https://x.net", "http://a.example.com/de/q?x=/fr/", "http://b.org/fr/", "ftp://notexample.com/de/", None, "no scheme", "http://net/#a", "http://example.net?/en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    labels = spark.createDataFrame([], "page_id long, blocked boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op3.judge(pages, labels, op3.RULES).collect()}
    assert got[0] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[1][2:] == ("net/", "block") and got[2] == ("x.net", "", None, "allow")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow") and got[5][2:] == (None, "allow")
    assert got[6] == got[7] == ("", "", None, "allow") and got[8][2] == "net/" and got[9] == ("example.net", "", None, "allow")


def test_mined_rules(spark):
    urls = [(i, f"http://{'spam' if i % 2 else 'good'}.site{i % 3}.org/p{i}/x") for i in range(300)]
    pages = spark.createDataFrame([*urls, (900, "http://spam.site1.org/new"), (901, "http://good.site1.org/new")], "page_id long, url string")
    labels = pages.where("page_id < 300").select("page_id", (F.col("page_id") % 2 == 1).alias("blocked"))
    assert {r.page_id: r.verdict for r in op3.judge(pages, labels, []).where("page_id >= 900").collect()} == {900: "block", 901: "allow"}


def test_rules_of_several_tokens_and_parts(spark, monkeypatch):
    monkeypatch.setattr(op3, "RULES_AT_ONCE", 2)
    rows, blocked = [], {}
    for i in range(600):  # only the three together are blocked, and another path alone
        a, b, c = i % 2, i // 2 % 2, i // 4 % 2
        rows.append((i, f"http://{'x' if a else 'y'}.org/{'p' if b else 'q'}/{'r' if c else 's'}/{'bad' if i % 8 == 0 else 'fine'}"))
        blocked[i] = bool(a and b and c) or i % 8 == 0
    pages = spark.createDataFrame([*rows, (900, "http://x.org/p/r/new"), (901, "http://x.org/p/s/new"), (902, "http://z.net/bad"), (902, "http://z.net/bad"), (None, "http://x.org/r/p"), (903, None)], "page_id long, url string")
    labels = spark.createDataFrame(list(blocked.items()), "page_id long, blocked boolean")
    mined = {tuple(sorted(r.tokens)): r.confidence for r in op3.mine(pages, labels, confidence=0.9).collect()}
    # every combination's share by counting
    tokens = {r.page_id: set(r.t) for r in pages.where("page_id < 600").select("page_id", op3.tokens(F.col("url")).alias("t")).collect()}
    share = lambda need: (lambda ids: sum(blocked[i] for i in ids) / len(ids))([i for i, t in tokens.items() if t >= set(need)])
    assert ("path bad",) in mined and all(share(need) == pytest.approx(c) and c >= 0.9 for need, c in mined.items())
    assert not any(share(set(need) - {t}) >= c for need, c in mined.items() if len(need) > 1 for t in need)
    assert any({"host x.org", "path p", "path r"} >= set(need) and len(need) == 3 for need in mined)
    got = [(r.page_id, r.verdict) for r in op3.judge(pages, labels, [], confidence=0.9).where("page_id is null or page_id >= 900").collect()]
    assert sorted(got, key=repr) == sorted([(900, "block"), (901, "allow"), (902, "block"), (902, "block"), (None, "block"), (903, "allow")], key=repr)
    assert op3.judge(pages.where("page_id < 0"), labels, op3.RULES).count() == 0


def test_verdicts_of_all_pages_by_plain_rules(spark):
    rows = op3.op3_url_filters(spark, "/root/testdata/sf0.01").collect()
    urls = {r.page_id: r.url for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    assert len(rows) == len(urls)
    for r in rows:
        rest = (urls[r.page_id] or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail.split("?")[0].split("#")[0]
        fits = [(len(rule), rule, verdict) for rule, verdict in op3.RULES if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0])) and path.startswith("/" + rule.split("/", 1)[1])]
        _, rule, verdict = max(fits, default=(0, None, "block" if r.confidence is not None else "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_pages_take_the_labels_of_their_documents(spark):
    pages = spark.createDataFrame([(1, "http://a.b/en/7?x"), (2, "http://a.b/en/7.html"), (3, "http://a.b/8/"), (4, "http://a.b/en"), (5, None), (6, "http://a.b/9")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0), (9, 0, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert {tuple(r) for r in op3.page_labels(pages, labels).collect()} == {(1, True), (2, True), (3, False), (6, True)}


@pytest.mark.parametrize("length", [1, 2, 3, 5])
def test_cycles_give_nothing(spark, length):
    ring = [(1, f"c{i}", f"c{(i + 1) % length}", "user", "x", 1.0) for i in range(length)]
    hung = [(1, "t", "c0", "user", "y", 1.0), (1, "leaf", "t", "user", "z", 1.0), (2, "root", None, "user", "kept", None), (2, "end", "root", "assistant", None, None)]
    nodes = spark.createDataFrame(ring + hung, "tree long, node string, parent string, role string, text string, score double").withColumn("leaf", F.lit(5)).withColumn("turns", F.lit(6))
    got = op5.format_trees(nodes, best=3).collect()
    assert [(r.tree, r["rank"], r.n_turns) for r in got] == [(2, 1, 2)]


def test_ties_and_repeated_turns_of_conversations(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "c"), (1, 1, "assistant", "c"), (None, 0, None, None), (2, None, "user", "d")]
    done = op5.format_trees(op5.chains(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"))).select("tree", op5.read_turns(F.col("formatted")).alias("t")).collect()
    assert {r.tree: [tuple(t) for t in r.t] for r in done} == {1: [("user", "a"), ("user", "b"), ("assistant", "c"), ("assistant", "c")], None: [("", "")], 2: [("user", "d")]}


def test_trees_are_formatted_by_their_best_branch(spark):
    rows = [(1, "a", None, "user", "hi <|im_end|> \\ there", 0.0), (1, "b", "a", "assistant", "low", 0.1), (1, "c", "a", "assistant", "<|im_start|>", 0.9), (1, "d", "c", "we\\nird\n", None, 0.5), (2, "e", "gone", "assistant", "alone", None)]
    nodes = spark.createDataFrame(rows, "tree long, node string, parent string, role string, text string, score double")
    done = op5.format_trees(nodes, best=2).withColumn("turns", op5.read_turns(F.col("formatted"))).withColumn("loss", op5.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {(r.tree, r["rank"]): ([tuple(t) for t in r.turns], r.loss) for r in done.collect()}
    assert got[1, 1] == ([("user", "hi <|im_end|> \\ there"), ("assistant", "<|im_start|>"), ("we\\nird\n", "")], "<|im_start|>")
    assert got[1, 2] == ([("user", "hi <|im_end|> \\ there"), ("assistant", "low")], "low") and got[2, 1] == ([("assistant", "alone")], "alone")
    assert op5.format_trees(nodes.where("tree > 9")).count() == 0


def test_deep_trees(spark):
    n = 300
    nodes = spark.range(n).select(F.lit(1).alias("tree"), F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(None).cast("double").alias("score"))
    assert [t.text for t in op5.format_trees(nodes).select(op5.read_turns(F.col("formatted")).alias("t")).first().t] == [str(i) for i in range(n)]


def test_archives_survive_magic_in_payloads(spark):
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = [None, "", "plain", "plain", f"before {fake} after", fake, "é" * 50, f"{fake}{fake}tail", "WARC/1.0\r\n", "plain"]
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n", h) for i, h in enumerate(html)], "page_id long, url string, html string").repartition(3)
    folder = op10.archive_folder(spark)
    op10.write(pages, folder)
    import base64
    import hashlib

    got = {r.page_id: r for r in op10.read(spark, folder).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        payload = (h or "").encode()
        last = max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()), i
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == last else ("revisit", last))


def test_records_are_valid_and_odd_pages_stay(spark):
    import glob
    import gzip

    rows = [(1, None, "same"), (1, "http://x/", "same"), (None, "u", "same"), (2, "u", "same"), (3, "u", "s"), (4, "u", "s"), (5, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "first": F.lit(9)})
    folder = op10.archive_folder(spark)
    op10.write(pages, folder, revisit_from=2)
    text = b"".join(gzip.open(f).read() for f in sorted(glob.glob(folder.removeprefix("file:") + "/*.gz")))
    seen = 0
    while text:
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.split(b"\r\n")
        fields = dict(x.split(b": ", 1) for x in lines[1:] if b": " in x)
        assert lines[0] == b"WARC/1.0" and {b"WARC-Type", b"WARC-Date", b"Content-Type", b"Content-Length"} <= set(fields)
        assert (fields[b"WARC-Type"] == b"revisit") == (b"WARC-Profile" in fields)
        size = int(fields[b"Content-Length"])
        assert rest[:size].startswith(b"HTTP/1.1 200 OK\r\n") and rest[size : size + 4] == b"\r\n\r\n"
        text, seen = rest[size + 4 :], seen + 1
    assert seen == len(rows)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in op10.read(spark, folder).collect()), key=repr)
    assert got == sorted([(1, "revisit", 2, 4), (1, "revisit", 2, 4), (None, "response", None, 4), (2, "response", None, 4), (3, "response", None, 1), (4, "response", None, 1), (5, "response", None, 0)], key=repr)
    empty = op10.archive_folder(spark)
    op10.write(pages.where("page_id > 9"), empty)
    assert op10.read(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["op2_ngram_jaccard_join", "op5_chat_formatting", "op10_warc"])
def test_against_sql(spark, name):
    import os

    import duckdb

    from kerbline.llm import registry

    connection = duckdb.connect()
    for f in os.listdir(DATA):
        connection.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got, expected = registry.queries()[name](spark, DATA).toPandas(), connection.sql(registry.oracle_sql()[name]).df()
    rows = lambda d: sorted(map(str, d[sorted(d)].astype(object).where(d[sorted(d)].notna(), None).values.tolist()))
    assert [x.replace(".0]", "]").replace(".0,", ",") for x in rows(got)] == [x.replace(".0]", "]").replace(".0,", ",") for x in rows(expected)]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, DATA).write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.columns == columns and 0.7 * before < docs.count() <= before
            before = docs.count()
    assert docs.select("doc_id").distinct().count() == before


def test_stages_keep_odd_documents(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, toxicity string, added string, key long"
    twice = "a plain sentence that stands here twice and says nothing of note to anyone at all"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, twice, "en", "s", 9), (4, twice, "en", "s", 9), (4, twice, "en", "s", 9), (None, "no id but words", None, "s", 3), (5, "write to q@w.org now", "en", None, 20)]
    docs = spark.createDataFrame([(*r, "x", "y", 7) for r in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.where("doc_id > 99"), DATA).count() == 0, name
        got = sorted((r.doc_id or 0) for r in out.collect())
        assert got == ([0, 1, 2, 3, 5] if name.startswith("n-gram") else [0, 1, 2, 3, 4, 4, 5]), name
        assert {r.key for r in out.collect()} == {7}
    masked = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.pii(spark, docs, DATA).collect()}
    assert masked[5] == ("write to <EMAIL> now", 20) and masked[1] == (None, None) and masked[2] == ("", 0)
    packed = corpus_pipeline.packing(spark, docs, DATA).collect()
    assert sum(r.length for r in packed if r.doc_id == 1) == 1 and len({r.doc_id for r in packed}) == 6
