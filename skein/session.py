"""Making the package importable in Python workers, and checkpoints in a folder that all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors once for each application, unless their search path has it already."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    target = Path(os.path.realpath(tempfile.mkdtemp())) / f"{ROOT.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    context.addPyFile(str(target))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage cut.

    The folder is the one named in ``spark.checkpoint.dir``; only a single-JVM local session may go without one."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="skein-checkpoints-"))
    return df.checkpoint()


#: Bytes that a side of a join may measure if it is broadcast.
BROADCAST_BYTES = 2 << 20
_STATIC, _MEASURED, _BEFORE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", "skein.autoBroadcastJoinThreshold"


def measured_joins(spark: SparkSession) -> None:
    """From now on a side of a join is broadcast only if a finished stage has measured it as small.

    Estimates start from a file's compressed bytes and know nothing of what explodes and Python make of a row, so that
    sides of gigabytes went through the driver.  The setting stays, as plans are lazy; ``estimated_joins`` takes it back."""
    if spark.conf.get(_BEFORE, None) is None:
        before = spark.conf.get(_STATIC)
        spark.conf.set(_BEFORE, before)
        spark.conf.set(_MEASURED, str(min(int(before), BROADCAST_BYTES)) if re.fullmatch(r"-?\d+", before) else str(BROADCAST_BYTES))
    spark.conf.set(_STATIC, "-1")


def estimated_joins(spark: SparkSession) -> None:
    """Spark's own choice of broadcasts, as it was before ``measured_joins``."""
    before = spark.conf.get(_BEFORE, None)
    if before is not None:
        spark.conf.set(_STATIC, before)
        spark.conf.unset(_MEASURED)
        spark.conf.unset(_BEFORE)


def spread(keys: DataFrame, *by: str) -> DataFrame:
    """Narrow rows dealt out over all cores, several tasks each, before something long is made of every one: a table of
    millions of them may lie in one row group of one file, and be read by one task."""
    return keys.repartition(4 * keys.sparkSession.sparkContext.defaultParallelism, *by)


#: Rows and bytes of an Arrow batch: it stands several times in the memory of executor and worker.
BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Sets the session's limits of Arrow batches, unless smaller ones hold; the setting stays, as plans are lazy."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if not size.isdigit() or not 0 < int(size) <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
