"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept:

1. language_id: documents without a letter (`und`) go, and those whose prediction is unclear: below the score
   that 999 of 1,000 right predictions on held-out labelled documents reach (`language_id.clear_bound`).
2. quality: documents that the quality classifier scores below 0.7 go.
3. near_duplicates: one document of each component of the n-gram Jaccard join stays.
4. decontaminate: documents that hold a window of a benchmark item go.
5. pack: the rest is cut and packed into sequences.

Rows with null or empty text go in stage 1. Columns beyond doc_id, text, lang and source pass
through the first four stages as they are; names that begin with an underscore are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, language_id, ngram_join, packing, quality_mil
from tidelog.llm.common import fold, materialize, read_table
from tidelog.llm.encode import vocabulary

GOOD = 0.7


#: Rows that pass between Spark and a Python worker at once: whole texts may be long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Stages end in Python functions that run when their result is written, so the batches are set for the session: where it has more."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    held_out = fold("doc_id", 5) == 0
    model = language_id.train(docs, ~held_out)
    clear = language_id.clear_bound(model, docs, held_out)
    tagged = docs.withColumn("_tag", language_id.language(model))
    return tagged.filter((F.col("_tag.lang_pred") != "und") & (F.col("_tag.score") >= clear)).select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality_mil.train(docs, read_table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return docs.withColumn("_score", quality_mil.quality(model)).filter(F.col("_score") >= GOOD).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", identify_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pack", pack_sequences),
]

#: A trained network cannot be written as SQL; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
