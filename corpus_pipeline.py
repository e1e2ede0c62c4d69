"""A training corpus from ``documents`` in five stages, each written as Parquet and reread.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return
the columns of ``documents``.  Null and empty texts, repeated rows and empty tables follow the operators'
own rules; columns beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from survspark.llm.common import small_batches, stored
from survspark.llm.decontaminate import find_contamination
from survspark.llm.langid import fit_languages, predict_languages
from survspark.llm.packing import pack_documents
from survspark.llm.partenum import jaccard_groups
from survspark.llm.pii import replace_pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Not a secret of a deployment: whoever runs the pipeline on real data passes their own.
PII_KEY = "surrogates-1"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised, with the recognised language as ``lang``."""
    out = predict_languages(docs.select(*COLUMNS), fit_languages(docs))
    return out.where(~F.col("rejected")).select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group that word 5-gram similarity of 0.8 or more links: the one with the smallest
    id (null last), then the smallest hash of the text; rows that repeat both are one group too."""
    groups = jaccard_groups(docs, k=5, num=80, den=100, with_keys=True).where("component is not null")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "h")).alias("first"))
    again = groups.join(first, "component").where(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))))
    again = again.select(F.col("doc_id").alias("_id"), F.col("h").alias("_again")).distinct()
    # decisions come back by id and text: one id may stand for several texts
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_h"))
    kept = rows.join(again, (F.col("_h") == F.col("_again")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    return kept.dropDuplicates(["doc_id", "_h"]).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of ``benchmark``; the hash of the text stands for the row, as only the text decides."""
    small_batches(spark)
    rows = docs.select(*COLUMNS, F.xxhash64("text").alias("_h"))
    found = find_contamination(rows.select(F.col("_h").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rows.join(stored(found.select(F.col("doc_id").alias("_h")).distinct(), "contaminated"), "_h", "left_anti").select(*COLUMNS)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data; ``n_chars`` follows the new text."""
    return replace_pii(docs.select(*COLUMNS), PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: each piece with its ids, sequence and offset."""
    import public_tokenizers

    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminated", decontaminated),
          ("surrogates", surrogates), ("packed", packed)]
#: No SQL for compression, tokenising or packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
