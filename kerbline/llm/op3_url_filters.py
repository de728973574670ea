"""URL filters: association rules of URL tokens, mined from labels by FP-growth, under a list of fixed rules.

A URL's tokens are its scheme, its host and that host's parents, its path's segments with digits folded, and its query's keys.
Spark's FP-growth finds the frequent token combinations of labelled URLs and those of the blocked ones with them; a combination that
at least `least` blocked URLs hold, and blocked URLs make up to the share `confidence`, is a rule, unless a
part of it already is one of at least that confidence.
An inverted index holds each rule under its rarest token: a URL meets only the rules of its own tokens and then must have all of theirs. Rules go to
the tasks RULES_AT_ONCE at a time, so a URL is judged where its row is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm.common import bounded_batches, checkpoint, fresh, table

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
RULES_AT_ONCE = 100_000
_UPPER, _LOWER, _BAD = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "=blocked"


def host(url: Column) -> Column:
    """Lower-cased; empty without `://` or for null."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL; none for null or a text without `://`."""
    labels = F.split(host(url), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("host "), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.transform(F.filter(F.split(F.regexp_replace(path(url), "[0-9]+", "0"), "/"), lambda s: s != ""), lambda s: F.concat(F.lit("path "), s))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("query "), F.substring_index(s, "=", 1)))
    scheme = F.array(F.concat(F.lit("scheme "), F.substring_index(url, "://", 1)))
    return F.when(F.contains(url, F.lit("://")), F.array_distinct(F.concat(scheme, suffixes, segments, keys))).otherwise(F.expr("cast(array() as array<string>)"))


def fixed(url_host: str, url_path: str, rules: list[tuple[str, str]]) -> Column:
    """struct<rule, verdict> of the longest rule (host/path, verdict) that fits, or null; a rule fits its host and all below it."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, start = rule.partition("/")
        fits = ((F.col(url_host) == name) | F.endswith(F.col(url_host), F.lit("." + name))) & F.startswith(F.col(url_path), F.lit(slash + start))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def mine(pages: DataFrame, labels: DataFrame, support: float = 0.002, confidence: float = 0.6, least: int = 20) -> DataFrame:
    """(tokens, rarest, confidence) rules from pages (page_id, url) and labels (page_id, blocked boolean).

    support is the least share of labelled pages that hold a combination, least the least number of blocked ones. Pages without
    tokens, label or page_id are left out; without labelled pages there are no rules.
    """
    rows = pages.join(labels.where("blocked is not null"), "page_id").select(tokens(F.col("url")).alias("items"), "blocked").where("size(items) > 0")
    rows = checkpoint(rows.select(F.when(F.col("blocked"), F.concat("items", F.array(F.lit(_BAD)))).otherwise(F.col("items")).alias("items")))
    none = rows.sparkSession.createDataFrame([], "tokens array<string>, rarest string, confidence double")
    if rows.isEmpty():
        return none
    found = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0).fit(rows).freqItemsets
    found = checkpoint(found.select(F.array_sort("items").alias("items"), "freq"))
    blocked = found.where(F.array_contains("items", _BAD) & (F.col("freq") >= least) & (F.size("items") > 1)).select(F.array_remove("items", _BAD).alias("items"), F.col("freq").alias("bad"))
    every = found.where(~F.array_contains("items", _BAD))
    rules = blocked.join(every, "items").select(F.col("items").alias("tokens"), (F.col("bad") / F.col("freq")).alias("confidence"), "bad", "freq").where(F.col("confidence") >= confidence)
    rules = checkpoint(rules.withColumn("rule_id", F.xxhash64("tokens")))
    # a rule goes if dropping one of its tokens leaves a rule of no less confidence
    parts = rules.where(F.size("tokens") > 1).select("rule_id", "confidence", F.explode("tokens").alias("out"), "tokens").select("rule_id", F.col("confidence").alias("own"), F.array_remove("tokens", F.col("out")).alias("tokens"))
    weaker = parts.join(rules.select("tokens", "confidence"), "tokens").where("confidence >= own").select("rule_id").distinct()
    single = every.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    kept = rules.join(weaker, "rule_id", "left_anti")
    rarest = kept.select("rule_id", F.explode("tokens").alias("token")).join(single, "token").groupBy("rule_id").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest"))
    return checkpoint(kept.join(rarest, "rule_id").select("tokens", "rarest", "confidence"))


def _matching(held, items: str, out: str):
    """Raises the column out to the greatest confidence of the rules whose tokens are all among the column items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[str, list[tuple[frozenset, float]]] = {}
        for needs, rarest, confidence in held.value:
            index.setdefault(rarest, []).append((frozenset(needs), confidence))
        for batch in batches:
            best = batch.column(out).to_pylist()
            for i, own in enumerate(batch.column(items).to_pylist()):
                near = [rule for token in own for rule in index.get(token, ())]
                for needs, confidence in near:
                    if needs.issubset(own) and (best[i] is None or confidence > best[i]):
                        best[i] = confidence
            yield batch.set_column(batch.schema.get_field_index(out), out, pa.array(best, pa.float64()))

    return run


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], **mining) -> DataFrame:
    """pages (page_id, url) with host, path, rule, verdict and the mined confidence (null if no mined rule matches).

    The longest fixed rule decides, else a mined rule blocks, else the page is allowed. Every row stays, also repeated ones, null
    URLs (empty host and path) and null page_ids; columns of those names are replaced. No rows: none.
    """
    bounded_batches(pages.sparkSession)
    pages = pages.drop("host", "path", "rule", "verdict", "confidence")
    items, chosen = fresh(pages, "url_tokens", "fixed_rule")
    mined = mine(pages, labels, **mining)
    parts = -(-mined.count() // RULES_AT_ONCE)
    judged = pages.withColumns({items: tokens(F.col("url")), "confidence": F.lit(None).cast("double")})
    for part in range(parts):
        some = mined.where(F.pmod(F.xxhash64("tokens"), F.lit(parts)) == part).collect()  # about RULES_AT_ONCE
        judged = judged.mapInArrow(_matching(pages.sparkSession.sparkContext.broadcast([tuple(r) for r in some]), items, "confidence"), judged.schema)
    judged = judged.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    judged = judged.withColumn(chosen, fixed("host", "path", rules))
    verdict = F.coalesce(F.col(f"{chosen}.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return judged.withColumns({"rule": F.col(f"{chosen}.rule"), "verdict": verdict}).drop(chosen, items)


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, blocked) of pages by the labels (doc_id, quality, toxic) of the document whose number ends their path; low quality or toxic is blocked."""
    number = F.regexp_extract(path(F.col("url")), r"/([0-9]{1,18})(?:\.[a-z]+)?/?$", 1).try_cast("long")
    bad = F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")) == 1
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("number")).agg(bad.alias("blocked"))
    return pages.where("page_id is not null").select("page_id", number.alias("number")).join(known, "number").groupBy("page_id").agg(F.max("blocked").alias("blocked"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = page_labels(pages, table(spark, sf_dir, "labels"))
    return judge(pages, labels, RULES).select("page_id", "host", "path", "rule", "verdict", "confidence")
