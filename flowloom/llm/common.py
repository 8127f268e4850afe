"""Helpers shared by the training-data operators: whole texts, shared folders, written tables."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of a batch on its way to a Python worker (one row may be longer).
BATCH_BYTES = 8 << 20


def give_back() -> None:
    """Returns freed memory to the system; workers are used again by later stages, beside which it would count."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), in batches bounded by bytes (a setting of the session), and freed memory given back.

    All operators go through here, so their batches never depend on which of them ran before.
    """

    def work(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(work, schema)


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the whole text; a null text is the empty text. Other columns are left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share.

    Only where that is unset and the master is local (tests) a temporary folder takes its place.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="flowloom-")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{top.rstrip('/')}/flowloom-{uuid.uuid4().hex}")
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made and nothing reads any more, so that they don't add up on disk."""
    for table in tables:
        path = getattr(table, "written_to", None)
        if path:
            spark = table.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def crc_fold(column: str = "doc_id", folds: int = 5):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds
