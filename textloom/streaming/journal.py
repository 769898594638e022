"""Structured Streaming: the findings journal, tumbling counts, deduplication by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.tables import is_folder, new_path, remove


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs a stream over all that is there and returns the table that it left.

    Executors write the table to the shared folder, every batch by itself, so that none of its rows reach the
    driver; in mode complete the last batch is the table. The state lies there too while the stream runs.
    """
    spark = stream.sparkSession
    path = new_path(spark, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/{batch}")

    state = new_path(spark, f"{name}-state")
    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
        remove(spark, state)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream, whether it is one file or a folder of them."""
    path = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if not is_folder(spark, path):
        path, _, name = path.rpartition("/")
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(stream: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """n and total of each kind of event in each window."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def journal(stream: DataFrame) -> DataFrame:
    """Worst severity and number of findings of each check so far."""
    return stream.groupBy("check").agg(F.max(F.when(F.col("severity") == "fail", 2).otherwise(1)).alias("worst"), F.count("*").alias("n"))


def once(stream: DataFrame, key: str, late: str = "30 days") -> DataFrame:
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
