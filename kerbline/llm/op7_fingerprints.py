"""Document fingerprints: order MinHash, with DataFrame expressions only.

A text's k-mers are its runs of K words, each numbered by its occurrence so that repeats count. Every numbered k-mer is hashed
into one of BINS ranges, and each range keeps its least. Two ranges make a component: their k-mers, in the order in which they stand in the
text, hashed together. So a component survives an edit only if both k-mers and their order do, as edit distance asks.
All of it is array work within a row, by sorting: no k-mer leaves its row, and nothing is quadratic in a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kerbline.llm.common import WORD_SEPARATORS, fresh, table

K, BINS, PLACE_BITS = 3, 64, 24


def _high(x: Column) -> Column:
    return F.shiftright(x, PLACE_BITS)


def _place(x: Column) -> Column:
    return x.bitwiseAND(F.lit((1 << PLACE_BITS) - 1).cast("long"))


def _count(array: str) -> Column:
    """0 .. size - 1."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(0), F.size(array) - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """df with the components of a text's fingerprint, an array of strings: two hex digits of place and sixteen of hash.

    A null text is empty; a text without words has no component; one of fewer than K words is one k-mer. Texts may be of any length:
    beyond 2 ** PLACE_BITS words places repeat, which can only change an order. All columns stay, but for one of that name.
    """
    words, kmers, runs, each, numbers, least, pairs = fresh(df, "f_words", "f_kmers", "f_runs", "f_each", "f_numbered", "f_least", "f_pairs")
    n = F.size(words)
    item = lambda array, j: F.coalesce(F.get(array, j), F.lit(0).cast("long"))
    kmer = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)])
    first_of = lambda array, shift: lambda j: (j == 0) | (F.shiftright(F.get(array, j), shift) != F.shiftright(F.get(array, j - 1), shift))
    packed = lambda h, i: F.coalesce(F.shiftleft(_high(h), PLACE_BITS).bitwiseOR(_place(i.cast("long"))), F.lit(0).cast("long"))
    df = df.withColumn(words, F.filter(F.split(F.coalesce(text, F.lit("")), WORD_SEPARATORS), lambda w: w != ""))
    starts = F.when(n >= K, F.sequence(F.lit(0), n - K)).when(n > 0, F.array(F.lit(0))).otherwise(F.expr("cast(array() as array<int>)"))
    df = df.withColumn(kmers, F.sort_array(F.transform(starts, lambda i: packed(kmer(i), i))))
    df = df.withColumn(runs, F.filter(_count(kmers), first_of(F.col(kmers), PLACE_BITS)))
    df = df.withColumn(each, F.flatten(F.transform(runs, lambda s, r: F.sequence(F.lit(0), F.coalesce(F.get(runs, r + 1), F.size(kmers)) - s - 1))))
    both = F.arrays_zip(kmers, each)  # a zip, as an array read once within a function would be made anew for each element
    numbered = F.transform(both, lambda x: packed(F.xxhash64(_high(x[kmers]), x[each]), _place(x[kmers])))
    df = df.withColumn(numbers, F.sort_array(numbered)).drop(words, kmers, runs, each)
    bits = 64 - (BINS.bit_length() - 1)
    df = df.withColumn(least, F.transform(F.filter(_count(numbers), first_of(F.col(numbers), bits)), lambda j: item(numbers, j))).drop(numbers)
    df = df.withColumn(pairs, F.filter(_count(least), first_of(F.col(least), bits + 1)))

    def component(j: Column) -> Column:
        a, b = F.get(least, j), F.get(least, j + 1)
        place = F.shiftright(a, bits + 1)
        alone = b.isNull() | (F.shiftright(b, bits + 1) != place)
        h = F.when(alone, F.xxhash64(_high(a))).when(_place(a) < _place(b), F.xxhash64(_high(a), _high(b))).otherwise(F.xxhash64(_high(b), _high(a)))
        return F.concat(F.lpad(F.hex(place + BINS // 4), 2, "0"), F.lpad(F.hex(h), 16, "0"))

    return df.withColumn(name, F.transform(pairs, component)).drop(least, pairs)


def likeness(a: str, b: str) -> Column:
    """The share of components that two fingerprints have in common, of the places that either has; 1 if both are empty."""
    places = lambda c: F.transform(c, lambda x: F.substring(x, 1, 2))
    total = F.size(F.array_union(places(a), places(b)))
    return F.when(total == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / total)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with a string column fingerprint; all rows and columns stay, one of that name is replaced. No rows: none."""
    (parts,) = fresh(docs, "f_components")
    return with_fingerprint(docs, F.col("text").cast("string"), parts).withColumn("fingerprint", F.concat_ws("", parts)).drop(parts)


def with_next(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with next_<column> of the row that follows in descending doc_id, the first one's for the last.

    Rows are cut into ranges of doc_id of about equal counts, each range's first row is also sent to the end of the range before
    it, and each range is one window: no global sort, whatever the number of rows. Equal ids are ordered by the columns.
    """
    spark = rows.sparkSession
    part, key_, dealt, following = fresh(rows, "n_range", "n_key", "n_to", "n_next")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    count = rows.count()
    wide = max(1, min(128, round((count / 1000) ** 0.5), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    cuts = rows.select(F.percentile_approx(key, [i / (wide * wide) for i in range(1, wide * wide)] or [0.5], 100 * wide * wide).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts), reverse=True)  # at most 128 * 128 numbers
    outer, inner = cuts[wide - 1 :: wide], [cuts[i : i + wide] for i in range(0, max(1, len(cuts)), wide)]
    larger = lambda bounds: F.size(F.filter(bounds, lambda b: b > key))
    lit = lambda x, kind: F.lit(x).cast(kind) if x else F.expr(f"cast(array() as {kind})")
    coarse = larger(lit(outer, "array<bigint>"))
    nested = F.array(*[lit(x, "array<bigint>") for x in inner]) if inner else F.array(F.expr("cast(array() as array<bigint>)"))
    fine = larger(F.coalesce(F.get(nested, coarse), F.expr("cast(array() as array<bigint>)")))
    ranged = rows.withColumn(part, coarse * (wide + 1) + fine)
    heads = sorted(tuple(r) for r in ranged.groupBy(part).agg(F.max(key).alias("head")).collect())  # a row per range
    before = {r: heads[i - 1][0] for i, (r, _) in enumerate(heads)}
    top = max((r for r, _ in heads), default=0) + 1
    first = lit([dict(heads).get(r) for r in range(top)], "array<bigint>")
    to = lit([before.get(r) for r in range(top)], "array<int>")
    own = F.struct(F.col(part).alias("at"), F.lit(False).alias("sent"))
    sent = F.struct(F.get(to, F.col(part)).alias("at"), F.lit(True).alias("sent"))
    rows = ranged.withColumn(key_, key).withColumn(dealt, F.explode(F.when(F.col(key_) == F.get(first, F.col(part)), F.array(own, sent)).otherwise(F.array(own))))
    order = Window.partitionBy(f"{dealt}.at").orderBy(f"{dealt}.sent", F.desc(key_), *columns)
    rows = rows.withColumn(following, F.lead(F.struct(*columns)).over(order)).where(f"not {dealt}.sent")
    return rows.select("*", *[F.col(f"{following}.{c}").alias(f"next_{c}") for c in columns]).drop(dealt, key_, part, following)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = with_next(with_fingerprint(docs, F.col("text"), "own"), ["text", "own"])
    half = F.floor(F.length("text") / 2).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half)))
    docs = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", "own", "next_own")
    docs = with_fingerprint(docs, F.col("edited"), "changed")
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.concat_ws("", "own").alias("fingerprint"), F.concat_ws("", "changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "next_own").alias("near_next"),
    )
