"""Small shared pieces: the shared folder, folds, bounded labelled samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

import tidelog

# Functions of this package travel with the task, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(tidelog)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only in local mode, where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(named)
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Rows that pass between Spark and a Python worker at once while our tables are written: whole texts may be long.
BATCH_ROWS = 1000


def write_table(df: DataFrame, path: str) -> None:
    """Write df to a folder of the shared one. Batches for Python workers are kept small in the meantime; the session's setting is put back."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    write_table(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def give_back() -> None:
    """Return a Python worker's freed memory to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps what it keeps
        pass


def lean(task):
    """A function over batches that leaves its Python worker small: workers live on from stage to stage, next to a full heap.

    What other operators remember in the worker is dropped before it (the encoder's units), and freed memory is
    given back before and after.
    """

    def run(batches):
        import sys

        if kept := sys.modules.get("_tidelog_worker"):
            kept.__dict__.pop("encoders", None)
        give_back()
        yield from task(batches)
        give_back()

    return run


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def class_sample(rows: DataFrame, label: str, per_class: int, key: str = "doc_id") -> DataFrame:
    """per_class rows of each label value (all where there are fewer), lowest hash of the key first.

    A class's count gives a hash bound that about 2 * per_class + 100 of its rows pass, so what meets in
    the task that ranks a class is bounded, however many rows the class has in however many tasks.
    """
    count = F.broadcast(rows.groupBy(label).agg(F.count("*").alias("_count")))  # a row a class
    place = F.shiftrightunsigned(F.xxhash64(key), 11)
    low = place / F.lit(float(1 << 53)) * F.col("_count") <= 2.0 * per_class + 100
    w = Window.partitionBy(label).orderBy(place, F.col(key))
    near = rows.join(count, label).filter(low).drop("_count")
    return near.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= per_class).drop("_rank")


def stretch(text: str, key: str, chars: int) -> Column:
    """At most chars characters of a text, from a place given by the key's hash."""
    room = F.greatest(F.length(text) - chars, F.lit(0)) + 1
    return F.substring(F.col(text), (F.pmod(F.xxhash64(key), room) + 1).cast("int"), F.lit(chars))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int, max_chars: int) -> list[tuple[str, int]]:
    """A bounded labelled sample for the driver: (text, label) of per_class documents a class at most.

    Only documents with a text are picked; of texts beyond max_chars a stretch of that length is taken
    (for the sample only, scores cover every text). Rows of one doc_id with several labels count by the
    largest, documents that repeat a doc_id by the text of the lowest hash; null ids and labels are left out.
    """
    one = (
        labels.select("doc_id", label).dropna().filter(train)
        .groupBy("doc_id").agg(F.max(label).alias("y"))
    )
    with_text = docs.filter(F.col("text").isNotNull()).select("doc_id")
    picked = F.broadcast(class_sample(one.join(with_text, "doc_id", "left_semi"), "y", per_class))  # per_class rows a class
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(picked, "doc_id")
    rows = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), stretch("text", "doc_id", max_chars).alias("text"))).alias("r"))
    return [(r.text, int(r.y)) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("r.text", "y").collect()]
