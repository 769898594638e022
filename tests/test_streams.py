"""What a drained stream leaves behind, and the forms of its table."""

import pytest

from textloom.plans import catalogue


@pytest.mark.parametrize("name", ["stream_dedup", "journal_stream", "events_tumbling"])
def test_drained_stays_off_the_driver(spark, sf, name):
    """The rows lie in files that executors wrote; the driver holds no table of them."""
    df = catalogue.QUERIES[name](spark, sf)
    assert df.inputFiles() and not spark.catalog.tableExists(name)


def test_events_in_a_folder(spark, sf, tmp_path):
    """A table of several files is read whole, and events that come twice stay once."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    events.limit(10).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    rows = lambda d: sorted(map(tuple, catalogue.QUERIES["stream_dedup"](spark, d).collect()))
    assert rows(str(tmp_path)) == rows(sf) and len(rows(sf)) == events.count()
    assert catalogue.QUERIES["journal_stream"](spark, str(tmp_path)).groupBy().sum("n").first()[0] == events.count() + 10


def test_last_batch_is_the_table(spark, tmp_path):
    """Over several batches, mode append keeps the rows of all and mode complete those of the last."""
    from textloom.streaming import journal

    for k in range(3):
        spark.createDataFrame([(k, "a", "2024-01-01")], "event_id long, event_type string, ts string").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    stream = spark.readStream.schema("event_id long, event_type string, ts string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "t"))
    every = journal.drained(journal.once(stream.withColumn("ts", stream.ts.cast("timestamp")), "event_id").select("event_id"), "every", "append")
    assert sorted(r.event_id for r in every.collect()) == [0, 1, 2]
    assert [tuple(r) for r in journal.drained(stream.groupBy("event_type").count(), "counts", "complete").collect()] == [("a", 3)]
