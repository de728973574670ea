"""WARC: archives written by Spark's text writer, and read back by boundary-chain verification.

Each record ends in the two line ends that separate records, so an archive is a text file with that separator. A record's block is an HTTP
response, its payload the body. Equal payloads are stored once: the page of the largest id is the response, the others revisit it and keep
the HTTP header alone, as the profile of identical payloads says. Reading splits the files at the magic
`WARC/1.0`, wherever it stands, also within a payload, into candidates; every candidate names its successor by its own
Content-Length. Pointer jumping from each file's start then keeps the candidates on the chain of true records,
and pieces off the chain are payload of the record before them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.llm.common import checkpoint, salted_join, shared_folder, table

MAGIC, LINE, GAP = "WARC/1.0\r\n", "\r\n", "\r\n\r\n"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP = "application/http; msgtype=response"


def _base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hexadecimal: five bits a letter, 160 bits in all."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    bits = lambda part: F.lpad(F.conv(part, 16, 2), 20, "0")
    groups = [bits(F.substring(hex_digest, 5 * k + 1, 5)) for k in range(8)]
    letter = lambda five: F.substring(F.lit(letters), (F.conv(five, 2, 10).cast("int") + 1), F.lit(1))
    return F.concat(*[letter(F.substring(g, 5 * k + 1, 5)) for g in groups for k in range(4)])


def records(pages: DataFrame, revisit_from: int = 0, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record) of pages (page_id, url, html): one record a row, without the gap after it; date is when they were fetched.

    Of payloads that are equal and at least revisit_from bytes long, that of the largest page_id is a response and the others are
    revisits of it, smaller ones are all responses. A null html is an empty payload, a null url an empty target. Rows with the same
    page_id and payload are responses each, as are those without a page_id. Line ends in a url are written as spaces.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.sha1("html"))
    repeated = pages.select("page_id", "digest").groupBy("digest").agg(F.max("page_id").alias("first"), F.min("page_id").alias("least")).where("least < first").drop("least")
    pages = salted_join(pages, repeated, "digest", "page_id", "left")
    revisits = (F.octet_length("html") >= revisit_from) & F.coalesce(F.col("page_id") < F.col("first"), F.lit(False))
    http = F.concat(F.lit(LINE.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "])), F.octet_length("html"), F.lit(GAP))
    block = F.concat(http, F.when(revisits, "").otherwise(F.col("html")))
    head = F.concat_ws(
        LINE, F.lit(MAGIC[:-2]), F.concat(F.lit("WARC-Type: "), F.when(revisits, "revisit").otherwise("response")), F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.col("page_id"), F.lit(">")),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), F.translate("url", "\r\n", "  ")), F.concat(F.lit("WARC-Payload-Digest: sha1:"), _base32(F.col("digest"))),
        F.when(revisits, F.concat(F.lit(f"WARC-Profile: {PROFILE}{LINE}WARC-Refers-To: <urn:page:"), F.col("first"), F.lit(">"))), F.lit(f"Content-Type: {HTTP}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    return pages.select("page_id", F.concat(head, F.lit(GAP), block).alias("record"))


def write(pages: DataFrame, folder: str, revisit_from: int = 0) -> None:
    """Archives of all pages in a new folder, one for each task, compressed."""
    records(pages, revisit_from).select("record").write.text(folder, compression="gzip", lineSep=GAP)


def pieces(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each magic of the archives: file, offset (bytes, of the magic), next (the offset its own length leads to, or null),
    head, http (the HTTP header, null if the block is none), begin (of the payload in the piece), stored (payload bytes declared), sha1 of
    them, clean (whether the piece ends where the length says).

    Tasks read parts of files, in order; a running sum of the pieces' sizes per file gives the offsets.
    """
    size, gap = len(MAGIC), len(GAP)
    rows = spark.read.text(folder, lineSep=MAGIC).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("id"), "value")
    rows = rows.withColumn("head", F.when(F.contains("value", F.lit(GAP)), F.substring_index("value", GAP, 1)))
    rows = rows.withColumn("declared", _header("Content-Length").try_cast("long")).withColumn("start", F.octet_length("head") + gap)
    two = F.substring_index("value", GAP, 2)
    is_http = F.startswith(F.lower(_header("Content-Type")), F.lit("application/http")) & (F.length(two) < F.length("value"))
    rows = rows.withColumn("http", F.when(is_http, F.substring(two, F.length("head") + (gap + 1), F.length(two))))
    rows = rows.withColumn("begin", F.col("start") + F.when(F.col("http").isNull(), 0).otherwise(F.octet_length("http") + gap))
    clean = F.coalesce(F.col("declared") == F.octet_length("value") - F.col("start") - gap, F.lit(False))
    stored = F.col("declared") - (F.col("begin") - F.col("start"))
    payload = F.expr("substring(cast(value as binary), begin + 1, cast(stored as int))")
    rows = rows.withColumn("stored", stored).select("file", "part", "id", F.octet_length("value").cast("long").alias("bytes"), "head", "http", "declared", "start", "begin", "stored", clean.alias("clean"), F.when(clean, F.sha1(payload)).alias("sha1"))
    order = Window.partitionBy("file").orderBy("part", "id")
    rows = rows.withColumn("offset", F.sum(F.col("bytes") + size).over(order) - F.col("bytes") - 2 * size)
    next_ = F.when(F.col("declared") >= 0, F.col("offset") + size + F.col("start") + F.col("declared") + gap)
    return rows.where("offset >= 0").select("file", "offset", next_.alias("next"), "head", "http", "begin", "stored", "sha1", "clean")


def _header(name: str, of: str = "head") -> Column:
    return F.trim(F.regexp_extract(F.concat(F.lit("\n"), F.col(of)), rf"(?i)\n{name}:([^\r\n]*)", 1))


def on_chain(found: DataFrame) -> DataFrame:
    """The rows of found (file, offset, next, ...) that the chain from each file's offset 0 reaches.

    Rows that each lead to the very next one are a run; a run also begins where any other row leads. Pointer jumping over
    runs doubles its reach each round, and a sound archive is one run.
    """
    order = Window.partitionBy("file").orderBy("offset")
    rows = found.withColumn("_before", F.lag("next").over(order)).withColumn("_after", F.lead("offset").over(order))
    far = rows.where("next is not null and next <> coalesce(_after, -1)").select("file", F.col("next").alias("offset"), F.lit(True).alias("_led")).distinct()
    rows = rows.join(far, ["file", "offset"], "left")
    begins = F.col("_led").isNotNull() | F.col("_before").isNull() | (F.col("_before") != F.col("offset"))
    rows = rows.withColumn("run", F.max(F.when(begins, F.col("offset"))).over(order)).drop("_before", "_after", "_led")
    runs = checkpoint(rows.groupBy("file", "run").agg(F.max_by("next", "offset").alias("next")))
    reached = runs.where("run = 0").select("file", "run")
    jumps = checkpoint(runs.join(runs.select("file", F.col("run").alias("next")), ["file", "next"]).select("file", "run", "next"))
    while not jumps.isEmpty():
        more = reached.join(jumps, ["file", "run"]).select("file", F.col("next").alias("run"))
        reached = checkpoint(reached.union(more).distinct())
        further = jumps.select("file", "run", F.col("next").alias("via")).join(jumps.select("file", F.col("run").alias("via"), "next"), ["file", "via"])
        jumps = checkpoint(further.select("file", "run", "next"))
    return rows.join(reached, ["file", "run"], "left_semi").drop("run")


def _whole(spark: SparkSession, folder: str, split: DataFrame) -> DataFrame:
    """(file, offset, whole) of the records of split (file, offset, next, begin, stored) whose payload holds magics: the hash of their pieces, put together."""
    size = len(MAGIC)
    rows = spark.read.text(folder, lineSep=MAGIC).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("id"), "value")
    order = Window.partitionBy("file").orderBy("part", "id")
    rows = rows.join(split.select("file").distinct(), "file", "left_semi")
    rows = rows.withColumn("offset", F.sum(F.octet_length("value").cast("long") + size).over(order) - F.octet_length("value") - 2 * size)
    # a record's own row sorts before the pieces at and after it; the last record begun before a piece owns it
    marks = split.select("file", "offset", "next", "begin", "stored", F.lit(None).cast("string").alias("value"))
    every = rows.select("file", "offset", F.lit(None).cast("long").alias("next"), F.lit(None).cast("int").alias("begin"), F.lit(None).cast("long").alias("stored"), "value").unionByName(marks)
    own = Window.partitionBy("file").orderBy("offset", F.col("next").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    every = every.withColumn("own", F.last(F.when(F.col("next").isNotNull(), F.struct("offset", "next", "begin", "stored")), True).over(own))
    parts = every.where("value is not null and own is not null and offset < own.next")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), MAGIC)
    whole = parts.groupBy("file", "own").agg(text.alias("value"))
    return whole.select("file", F.col("own.offset").alias("offset"), F.sha1(F.expr("substring(cast(value as binary), own.begin + 1, cast(own.stored as int))")).alias("whole"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(file, offset, record_type, page_id, payload_bytes, payload_digest, refers_to) for every true record of the archives.

    A response's bytes and digest are those of its stored payload, a revisit's those that it and its HTTP header state. refers_to is null for responses.
    """
    kept = checkpoint(on_chain(checkpoint(pieces(spark, folder))))
    split = kept.where("not clean")
    if not split.isEmpty():
        kept = kept.join(_whole(spark, folder, split), ["file", "offset"], "left").withColumn("sha1", F.coalesce("sha1", "whole"))
    kind, page = _header("WARC-Type"), lambda name: F.regexp_extract(_header(name), r"<urn:page:(-?[0-9]+)>", 1).try_cast("long")
    revisit = kind == "revisit"
    digest = F.when(revisit, F.substring_index(_header("WARC-Payload-Digest"), ":", -1)).otherwise(_base32(F.col("sha1")))
    length = F.when(revisit, _header("Content-Length", "http").try_cast("long")).otherwise(F.col("stored"))
    return kept.select("file", "offset", kind.alias("record_type"), page("WARC-Record-ID").alias("page_id"), length.alias("payload_bytes"), digest.alias("payload_digest"), page("WARC-Refers-To").alias("refers_to"))


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared checkpoint folder."""
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    write(table(spark, sf_dir, "pages"), folder)
    return read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((
    ((strpos('0123456789abcdef', substr(p.h, CAST((5 * i) // 4 + 1 AS INT), 1)) - 1) * 16
      + (strpos('0123456789abcdef', substr(p.h || '0', CAST((5 * i) // 4 + 2 AS INT), 1)) - 1)) >> CAST(3 - (5 * i) % 4 AS INT)) & 31) AS INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN m ON p.h = m.h
"""
