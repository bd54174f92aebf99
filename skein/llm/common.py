"""Shared plumbing of the training-data operators: tables, the shared folder, written intermediates, text batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a text batch a Python worker holds at once.
SLICE_ROWS = 512
#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1024, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A scan of fewer partitions than there are cores, dealt over the cores; larger tables stay as their files lie."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.rdd().getNumPartitions() < cores else scan


@lru_cache(maxsize=1)
def _test_dir() -> str:
    return tempfile.mkdtemp(prefix="skein-shared-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.  Only a single-JVM local session may go without one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _test_dir()


def scratch(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/skein/{label}-{uuid.uuid4().hex}"


def hadoop_fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop_fs(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, at = hadoop_fs(spark, path)
        fs.delete(at, True)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to the shared folder and read again: later steps survive lost executors without a recompute."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame) -> DataFrame:
    """All columns of ``df`` as one struct, ``row``: names beside it cannot clash with theirs, whatever they are."""
    quoted = ["`" + c.replace("`", "``") + "`" for c in df.columns]
    return df.select(F.struct(*quoted).alias("row"))


#: Ids that may be broadcast, once counted; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def counted_broadcast(ids: DataFrame) -> DataFrame:
    """``ids``, few columns of numbers, marked for broadcast if they are at most BROADCAST_IDS."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``row``, all columns of ``docs`` as a struct, of the rows whose doc_id is not among ``ids`` (gone)."""
    return packed(docs).join(counted_broadcast(ids), F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("gone")), "left_anti")


def told_apart(rows: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``rows`` with nodes that stand for one thing each.  node and check are two hashes of it; where things of different
    checks share a node, both hashes make another.  Rows without a node stay.  ``keep`` writes what was made anew."""
    for n in range(8):
        things = rows.filter("node IS NOT NULL").select("node", "check").distinct()
        shared = things.groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a != b").select("node", F.lit(True).alias("shared"))
        if shared.isEmpty():
            return rows
        rows = keep(rows.join(shared, "node", "left").withColumn("node", F.when(F.col("shared"), F.xxhash64("node", "check", F.lit(n))).otherwise(F.col("node"))).drop("shared"), "told-apart")
    raise RuntimeError("two hashes do not tell things apart")


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``: the contract's folds."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes: a batch stands several times in the memory of executor and worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Gives freed memory of a worker, which lives on, back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def map_text(df: DataFrame, f: Callable, schema: str, arrow: pa.Schema, id_col="doc_id", text_col="text", per_task: bool = False) -> DataFrame:
    """``f(ids, texts)`` over bounded slices of each Arrow batch; it returns one list a column.  A null text is empty.

    ``per_task``: ``f()`` makes that function anew for each run of a task, so that it may remember what it has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = f() if per_task else f
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                columns = g(part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, k.type) for c, k in zip(columns, arrow, strict=True)], schema=arrow)
        release()

    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
