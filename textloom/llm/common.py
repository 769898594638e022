"""What the training-data operators share: tables, Arrow batches and lineage cuts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.sources.tables import new_path, remove

#: Stands for a null id where rows are keyed by id; a null sorts first, as in Spark.
NULL_ID = -(2**63)
#: Spark's setting by which a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
ROWS_A_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1500"
BYTES_A_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2_000_000
#: The share of labelled rows that no model sees: crc32(doc_id as text) mod 4 is 2.
FOLDS, HELD_OUT = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, name: str, *superseded: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back, so that losing an executor repeats no work before it.

    Shuffle files of the write go when it ends, and so do the tables of `superseded`, which cut() made
    and which nothing that runs later reads.
    """
    spark = df.sparkSession
    short_batches(spark)
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    discard(*superseded)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables that cut() made."""
    for df in tables:
        if path := getattr(df, "_cut_to", None):
            remove(df.sparkSession, path)
            df._cut_to = None


def held_out(doc_id="doc_id"):
    """False for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def short_batches(spark: SparkSession) -> None:
    """Arrow batches for long texts: where the session has Spark's 10,000 rows, which texts fill with tens of MB, BATCH_ROWS; of BATCH_BYTES, or one longer row, where it allows more."""
    if spark.conf.get(ROWS_A_BATCH) == "10000":
        spark.conf.set(ROWS_A_BATCH, BATCH_ROWS)
    if not 0 < spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() <= BATCH_BYTES:
        spark.conf.set(BYTES_A_BATCH, str(BATCH_BYTES))


def release() -> None:
    """Hands free memory back to the system. Arrow and the C library keep the most that a task ever had, and workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # only glibc has it
        trim(0)


def released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that releases memory when its task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def texts_of(row: pa.StructArray) -> pa.Array:
    """The texts within whole rows as UTF-8 bytes (null: empty)."""
    return row.field("text").fill_null("").cast(pa.binary())


def with_text(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns and the text as UTF-8 bytes in `_text` (null: empty)."""
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("_text"))


def map_batches(df: DataFrame, f: Callable[[dict[str, list]], dict[str, list]], schema: str | StructType) -> DataFrame:
    """Applies a function of plain column lists to every Arrow batch; `schema` names all columns that it returns."""
    spec = schema if isinstance(schema, StructType) else df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spec)

    short_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = f({n: c for n, c in zip(b.schema.names, b.columns, strict=True)})
                yield pa.RecordBatch.from_arrays([out[x.name] if isinstance(out[x.name], pa.Array) else pa.array(out[x.name], type=x.type) for x in arrow], schema=arrow)

    return df.mapInArrow(released(run), spec)
