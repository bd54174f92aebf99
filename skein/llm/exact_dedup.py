"""Operator 5: exact deduplication against a persistent digest index.  DataFrame functions only.

Two texts are equal when they are identical after every run of space, tab, line feed, vertical tab, form feed and
carriage return is replaced by one space; null is the empty text.  Of equal texts the row with the smallest doc_id
stays, unless the index already holds the digest from an earlier batch; then that batch's document stays.

The index is a list of runs, each a table bucketed and sorted by digest with one file a bucket, so that it is read
without a shuffle or a sort.  A batch is aggregated to one row a digest, matched with each run by a sort-merge anti-join
that shuffles only the batch, and what is new is appended as a run.  Beyond ``MOST_RUNS`` runs they are merged into one,
whose number of buckets follows its rows.  A run counts once its ``_SUCCESS`` file is there; a merged run names the first
run that it stands for, so a merge that died is ignored and one whose old runs remain is read once.  One writer at a time.
A batch handed in again finds its own digests and ids and gives the same answer, so a failed run can be repeated.

Defined cases: a null doc_id never stays while its text has another id.  Rows that repeat a doc_id and its text are one
document: each is reported, and ``drop_copies`` returns one of them (the least as JSON, where their other columns
differ).  Other columns may have any name and type and are returned as they are.  An empty table gives no rows and adds
no run.  Hot digests are split by a salt; no digest meets in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted_broadcast, hadoop_fs, packed, remove, scratch, without_ids, written

SALTS = 64
#: Digests that a bucket should hold: about 100 MB.
BUCKET_ROWS = 2_000_000
LEAST_BUCKETS, MOST_BUCKETS = 16, 1 << 16
MOST_RUNS = 8
_RUN = re.compile(r"run-(\d+)-from-(\d+)-buckets-(\d+)")
_ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def normalised(text: str | Column = "text") -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: str | Column = "text") -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def buckets_for(rows: int) -> int:
    """A power of two, so that a bucket holds at most BUCKET_ROWS of ``rows`` digests."""
    return min(max(LEAST_BUCKETS, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length()), MOST_BUCKETS)


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside know that a bucket of one file is sorted; the caller's setting comes back."""
    before = spark.conf.get(_ORDERED, None)
    spark.conf.set(_ORDERED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_ORDERED) if before is None else spark.conf.set(_ORDERED, before)


class DigestIndex:
    """digest -> keep_id, kept in the folder ``path`` as runs of Parquet."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, most_runs: int = MOST_RUNS):
        self.spark, self.path, self.buckets, self.most_runs = spark, path.rstrip("/"), buckets, most_runs
        self.prefix = f"skein_digests_{hashlib.md5(self.path.encode()).hexdigest()[:16]}_"

    def runs(self) -> list[tuple[int, int, int]]:
        """(number, first run that it stands for, buckets) of each run that counts."""
        fs, at = hadoop_fs(self.spark, self.path)
        found = []
        for status in fs.listStatus(at) if fs.exists(at) else []:
            m = _RUN.fullmatch(status.getPath().getName())
            if m and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
                found.append(tuple(map(int, m.groups())))
        return [r for r in sorted(found) if not any(first <= r[0] < number for number, first, _ in found)]

    def _folder(self, run: tuple[int, int, int]) -> str:
        return "{}/run-{:06d}-from-{:06d}-buckets-{}".format(self.path, *run)

    def table(self, run: tuple[int, int, int]) -> DataFrame:
        name = f"{self.prefix}{run[0]}"
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {run[2]} BUCKETS LOCATION '{self._folder(run)}'")
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name)

    def read(self) -> DataFrame:
        out = self.spark.createDataFrame([], "digest binary, keep_id long")
        for run in self.runs():
            out = out.unionByName(self.table(run))
        return out

    def _write(self, rows: DataFrame, run: tuple[int, int, int]) -> None:
        remove(self.spark, self._folder(run))  # what a run that died has left
        self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}{run[0]}")
        self.table(run)
        rows.select("digest", "keep_id").repartition(run[2], "digest").sortWithinPartitions("digest").write.insertInto(f"{self.prefix}{run[0]}")

    def _drop(self, run: tuple[int, int, int]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}{run[0]}")
        remove(self.spark, self._folder(run))

    def unknown(self, groups: DataFrame, runs: list[tuple[int, int, int]]) -> DataFrame:
        """The rows of ``groups`` (digest, ...; one a digest) whose digest no run holds."""
        dealt = 0
        for run in runs:
            if run[2] != dealt:
                groups, dealt = groups.repartition(run[2], "digest"), run[2]
            groups = groups.join(self.table(run).select("digest").hint("merge"), "digest", "left_anti")
        return groups

    def append_new(self, groups: DataFrame) -> None:
        """Appends the rows of ``groups`` (digest, keep_id; one a digest) whose digest the index lacks."""
        runs = self.runs()
        if groups.isEmpty():
            return
        number = runs[-1][0] + 1 if runs else 1
        buckets = max((r[2] for r in runs), default=0) or self.buckets or buckets_for(groups.count())
        with _sorted_scans(self.spark):
            self._write(self.unknown(groups.select("digest", "keep_id"), runs), (number, number, buckets))
        if len(runs) + 1 > self.most_runs:
            self.merge()

    def merge(self) -> None:
        """One run for all, with as many buckets as its rows want."""
        runs = self.runs()
        if len(runs) < 2:
            return
        rows = self.read()
        merged = (runs[-1][0] + 1, runs[0][0], self.buckets or buckets_for(rows.count()))
        self._write(rows, merged)
        for run in runs:
            self._drop(run)

    def settled(self, groups: DataFrame) -> DataFrame:
        """``groups`` (digest, ...) with the keep_id of each digest that the index holds: each run is met in its order."""
        out = None
        for run in self.runs():
            met = groups.repartition(run[2], "digest").join(self.table(run).hint("merge"), "digest")
            out = met if out is None else out.unionByName(met)
        return out if out is not None else groups.withColumn("keep_id", F.lit(None).cast("bigint")).limit(0)

    def forget(self, files: bool = False) -> None:
        """Drops the catalog's entries; the files only if asked."""
        for run in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}{run[0]}")
        if files:
            remove(self.spark, self.path)


def deduplicate(docs: DataFrame, index: DigestIndex, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size (rows of this batch with the text), kept, text_sha256 for every row of ``docs``."""
    spark, made = docs.sparkSession, []

    def keep(df: DataFrame, label: str) -> DataFrame:
        made.append(scratch(spark, label))
        return written(df, made[-1])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), digest().alias("digest"))
    rows = keep(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")), "digests")
    parts = rows.groupBy("digest", "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"))
    groups = keep(parts.groupBy("digest").agg(F.min("least").alias("keep_id"), F.sum("size").alias("group_size")), "groups")
    index.append_new(groups)
    with _sorted_scans(spark):
        settled = keep(index.settled(groups.select("digest", "group_size")), "settled")
    by_salt = parts.select("digest", "salt").join(settled, "digest")
    out = rows.join(by_salt, ["digest", "salt"])
    out = keep(out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")), "deduplicated")
    remove(spark, *made[:-1])
    return out


def drop_copies(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat a doc_id and its text, one."""
    found = deduplicate(docs, index)
    of_id = found.groupBy(F.col("doc_id").alias("gone")).agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"))
    of_id = written(of_id.filter("n > 1 OR kept = 0"), scratch(docs.sparkSession, "not-single"))
    single = without_ids(docs, of_id.select("gone"))  # what is left has one row an id, and it stays
    if of_id.filter("n > 1 AND kept > 0").isEmpty():
        return single.select("row.*")
    repeated = counted_broadcast(of_id.filter("n > 1 AND kept > 0").select("gone"))
    again = packed(docs).join(repeated, F.col("row.doc_id").cast("bigint").eqNullSafe(F.col("gone")), "left_semi")
    again = again.select("row", F.col("row.doc_id").cast("bigint").alias("id"), digest(F.col("row.text")).alias("digest"))
    texts = found.filter("kept").select(F.col("doc_id").alias("kept_id"), F.unhex("text_sha256").alias("kept_digest")).distinct()
    again = again.join(texts, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")), "left_semi")
    first = again.groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return single.select("row.*").unionByName(first.select("row.*"))
