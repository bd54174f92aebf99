"""Operator 10: token counts as delta-maintained rollups by source, language and tokenizer version.

A ledger is a folder of committed batches and one table of totals.  A batch is a table of signed sums, one row a key:
inserts add a document and its tokens, deletes take them off, a revision takes the old text off and adds the new one.  As
the sums are signed, batches may come in any order.

A batch is committed by its id: its rows are written to a folder of that name, and Spark's ``_SUCCESS`` file, which comes
last, commits it.  Then the totals move on by the deltas of the batches that they do not hold yet, and by nothing else: a
new version of the totals is written with the ids of all batches in it, and the folders of those are dropped.  The newest
version with a ``_SUCCESS`` file counts; batches that were committed and not yet added, for a run died in between, are
added when totals are read, and by the next commit.  Handing in an id again does nothing; a folder without that file is a
run that died, is never read, and is written anew.  Totals are moved on by one writer at a time.

Defined cases: a null source or language is a key of its own; a null text is empty and counts as a document with no
tokens; rows that repeat are counted again; keys whose documents and tokens both come to zero are left out; an empty batch
is committed and changes nothing; an empty ledger has no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, exists, hadoop_fs, remove, small_batches
from .pretokens import PieceCache

KEYS = ["source", "lang", "tokenizer_version"]
STORED = "source string, lang string, tokenizer_version string, documents long, tokens long, batch string"


@lru_cache(maxsize=4)
def _counter(rank_file: str) -> PieceCache:
    import tiktoken

    from .byte_bpe import read_ranks

    encoding = tiktoken.Encoding("counts", pat_str=r"[\s\S]+", mergeable_ranks={t: i for i, t in enumerate(read_ranks(rank_file))}, special_tokens={})
    return PieceCache(lambda p: len(encoding.encode_ordinary(p)))


def tokenizer_version(rank_file: str) -> str:
    """The file's name and a digest of what is in it: a changed vocabulary is another version."""
    with open(rank_file, "rb") as f:
        return f"{re.sub(r'.*/', '', rank_file)}@{hashlib.sha256(f.read()).hexdigest()[:12]}"


def counted(docs: DataFrame, rank_file: str, text: str = "text", other: str | None = None) -> DataFrame:
    """source, lang, tokens of every row, and other_tokens of a second text; texts go no further than the task that reads
    them.  Equal texts of a row are counted once."""
    names = ["source", "lang", "tokens", *(["other_tokens"] if other else [])]

    def run(batches):
        for batch in batches:
            lengths = _counter(rank_file)
            count = lambda t: sum(lengths.values_of(t or ""))
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = part.column(2).to_pylist()
                counts = [count(t) for t in texts]
                columns = [part.column(0).cast(pa.string()), part.column(1).cast(pa.string()), pa.array(counts, pa.int64())]
                if other:
                    columns.append(pa.array([n if t == u else count(u) for t, u, n in zip(texts, part.column(3).to_pylist(), counts, strict=True)], pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(docs.sparkSession)
    as_text = [F.col(c).cast("string").alias(f"t{k}") for k, c in enumerate([text, *([other] if other else [])])]
    schema = "source string, lang string, tokens long" + (", other_tokens long" if other else "")
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), *as_text).mapInArrow(run, schema)


class Ledger:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batch(self, batch_id: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
            raise ValueError("a batch id has letters, digits, dots, dashes and underscores only")
        return f"{self.path}/batch={batch_id}"

    def _names(self) -> list[str]:
        fs, at = hadoop_fs(self.spark, self.path)
        found = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in found if exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def _version(self) -> int:
        """The newest version of the totals; 0 if there is none."""
        return max((int(n.removeprefix("totals=")) for n in self._names() if n.startswith("totals=")), default=0)

    def _read(self, *folders: str) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(*folders) if folders else self.spark.createDataFrame([], STORED)

    def _state(self) -> DataFrame:
        """The totals' rows, and one row with a batch's id for each batch in them."""
        n = self._version()
        return self._read(*([f"{self.path}/totals={n}"] if n else []))

    def _waiting(self) -> list[str]:
        """Batches that were committed and are not in the totals."""
        waiting = [n.removeprefix("batch=") for n in self._names() if n.startswith("batch=")]
        held = self._state().filter(F.col("batch").isin(waiting)).select("batch").collect() if waiting else []  # one row a waiting batch
        return sorted({*waiting} - {r["batch"] for r in held})

    def committed(self, batch_id: str) -> bool:
        return exists(self.spark, f"{self._batch(batch_id)}/_SUCCESS") or not self._state().filter(F.col("batch") == batch_id).isEmpty()

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Adds signed rows (source, lang, tokenizer_version, documents, tokens).  False if the batch was there."""
        if self.committed(batch_id):
            return False
        _sums(deltas).withColumn("batch", F.lit(None).cast("string")).write.mode("overwrite").parquet(self._batch(batch_id))
        self.fold()
        return True

    def fold(self) -> None:
        """Moves the totals on by the batches that wait, then drops what they hold."""
        waiting, n = self._waiting(), self._version()
        if waiting:
            state = self._state()
            ids = state.filter("batch IS NOT NULL").unionByName(self.spark.createDataFrame([(None, None, None, 0, 0, b) for b in waiting], STORED))
            sums = self.totals().withColumn("batch", F.lit(None).cast("string"))
            sums.unionByName(ids).write.mode("overwrite").parquet(f"{self.path}/totals={n + 1}")
            remove(self.spark, f"{self.path}/totals={n}")
        remove(self.spark, *(self._batch(m.removeprefix("batch=")) for m in self._names() if m.startswith("batch=")))

    def batches(self) -> list[str]:
        """The ids of all committed batches: one string a batch."""
        return sorted({*self._waiting(), *(r["batch"] for r in self._state().filter("batch IS NOT NULL").select("batch").collect())})

    def totals(self) -> DataFrame:
        waiting = self._read(*map(self._batch, self._waiting()))
        return _sums(self._state().filter("batch IS NULL").unionByName(waiting)).filter("documents != 0 OR tokens != 0")


def _sums(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("documents").cast("bigint").alias("documents"), F.sum("tokens").cast("bigint").alias("tokens"))


def signed(counts: DataFrame, rank_file: str, tokens: str, sign: int) -> DataFrame:
    """Rows counted before (source, lang, ``tokens``) as deltas."""
    return counts.select("source", "lang", F.lit(tokenizer_version(rank_file)).alias("tokenizer_version"), F.lit(sign).cast("bigint").alias("documents"), (F.col(tokens) * sign).alias("tokens"))


def inserts(docs: DataFrame, rank_file: str) -> DataFrame:
    return _signed(docs, rank_file, "text", 1)


def deletes(docs: DataFrame, rank_file: str) -> DataFrame:
    return _signed(docs, rank_file, "text", -1)


def revisions(pairs: DataFrame, rank_file: str, old: str = "old_text", new: str = "new_text") -> DataFrame:
    return _signed(pairs, rank_file, old, -1).unionByName(_signed(pairs, rank_file, new, 1))


def _signed(docs: DataFrame, rank_file: str, text: str, sign: int) -> DataFrame:
    return signed(counted(docs, rank_file, text), rank_file, "tokens", sign)
