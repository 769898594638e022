"""Readers: tables, lines of documents, pairs of turns, JSON lines whose torn rows are skipped; and the folder of tables that queries write."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

JOURNAL = "lang string, chunks array<string>, failed array<string>, checks map<string, struct<severity: string, chunks: array<string>>>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no (from 0) and line of every document."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))


def pairs(turns: DataFrame) -> DataFrame:
    """A turn of the user as source, the assistant's next one as output."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    both = turns.select("conv_id", "turn", "role", F.col("text").alias("source"), F.lead("text").over(w).alias("output"), F.lead("role").over(w).alias("answers"))
    return both.where("role = 'user' AND answers = 'assistant'").select("conv_id", "turn", "source", "output")


def json_lines(spark: SparkSession, path: str, schema: str = JOURNAL) -> DataFrame:
    """JSON lines; a torn line is dropped, not an error."""
    rows = spark.read.schema(schema + ", _corrupt_record string").json(path).cache()
    return rows.where("_corrupt_record IS NULL").drop("_corrupt_record")


def source_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """path and SHA-256 of the exact bytes of every file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def config(spark: SparkSession, path: str) -> DataFrame:
    """key and value of a key=value file; comments and blank lines are skipped."""
    rows = spark.read.text(path).where("value LIKE '%=%' AND NOT ltrim(value) LIKE '#%'")
    at = F.instr("value", "=")
    return rows.select(F.trim(F.substring("value", F.lit(1), at - 1)).alias("key"), F.trim(F.substring("value", at + 1, F.length("value"))).alias("value"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session without it gets one of its own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.gettempdir()}/textloom-{spark.sparkContext.applicationId}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at, files = _at(spark, path)
    files.delete(at, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return files.getFileStatus(at).isDirectory()


def _at(spark: SparkSession, path: str):
    """The path and its file system, as Spark's readers see them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())
