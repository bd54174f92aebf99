"""Binding of the engine's tables to the Parquet tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: source/lang/doc_<id>.txt."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), F.col("lang").alias("language"), "text")


def lines(files_: DataFrame) -> DataFrame:
    """path, line_no (from 1), line."""
    rows = files_.filter(F.col("text") != "")
    return rows.select("path", F.posexplode(T.lines_of("text")).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_no"), "line")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as symbols: name, kind (type), container (brand)."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("container"), F.col("p_size").alias("size"))


def file_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as files, trade as import edges: src, dst, weight (orders' lines from customer to supplier nation)."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.filter("src != dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` with ts in microseconds as ``us``."""
    return table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def intervals(spark: SparkSession, sf_dir: str, gap_s: int = 6 * 3600) -> DataFrame:
    """Nested intervals from events: a user is a file, seconds are lines; weeks (Class), days (Class) and runs of events
    without a gap of ``gap_s`` (Method) are symbols.  symbol_id orders them by (file, start, -end, kind)."""
    from pyspark.sql import Window

    e = events(spark, sf_dir).select(F.col("user_id").alias("file_id"), F.expr("us div 1000000").alias("line"))
    w = Window.partitionBy("file_id").orderBy("line")
    run = F.sum(F.when(F.col("line") - F.lag("line").over(w) > gap_s, 1).otherwise(0)).over(w)
    parts = [
        e.groupBy("file_id", F.expr("concat('w', line div 604800)").alias("name")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).withColumn("kind", F.lit("Class")),
        e.groupBy("file_id", F.expr("concat('d', line div 86400)").alias("name")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).withColumn("kind", F.lit("Module")),
        e.withColumn("run", run).groupBy("file_id", F.concat(F.lit("r"), F.col("run")).alias("name")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line")).withColumn("kind", F.lit("Method")),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("file_id", "name", "kind", "start_line", "end_line")
