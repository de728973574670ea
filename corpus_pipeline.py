"""The training-data pipeline: five operators in a row over documents, each on all that its predecessor kept.

All stages but the last return the columns that they got, whatever their names. Null and empty texts pass all of them; a null doc_id is kept
and never takes part in a group. Rows that are repeated are judged alike. No rows: none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import op1_decontamination, op2_ngram_jaccard_join, op4_packing, op8_toxicity, op9_pii
from kerbline.llm.common import checkpoint, column_test, fresh, marked, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject: a score below 0.5. A null or empty text scores as one without insults and stays."""
    (name,) = fresh(docs, "toxicity_score")
    return op8_toxicity.score(docs, op8_toxicity.trained(spark, sf_dir), name).where(F.col(name) < 0.5).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones (five words, 0.8): the one of least doc_id.

    Repeated rows of that doc_id all have the same decision, so their texts stay too if they differ from its group's.
    """
    found = op2_ngram_jaccard_join.similar_sets(docs)
    gone = checkpoint(found.where("component_id <> doc_id").select("doc_id").distinct())
    # rows whose id no marked key has need no join; the few others do
    test = column_test(marked(gone))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    hit = docs.where(test(key)).join(gone, "doc_id", "left_anti")
    return docs.where(~test(key)).unionByName(hit)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as a window of its size at similarity 0.8 or more; null and empty texts hold none."""
    return op1_decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by their kind; a null text stays null, n_chars is counted anew."""
    return op9_pii.mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in packed sequences; a null or empty text is the end token alone."""
    packed = op4_packing.pack(docs, op4_packing.public_tokenizer())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", pii),
    ("packing", packing),
]

#: SQL expresses neither the classifier nor the tokenizer; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written before the next, which may read its documents several times."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir) if i == len(STAGES) - 1 else checkpoint(stage(spark, docs, sf_dir))
    return docs
