"""Files that keep arriving, into a log that holds each key once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.writers import append_once


def stream_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream over a folder of JSON lines; malformed lines are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path)


def ingest_once(spark: SparkSession, path: str, schema: str, keys: list[str], log: str, checkpoint: str, delay: str | None = None, time: str | None = None):
    """Take in what has arrived, append the records with new keys to ``log``, and stop.

    Exactly once by key: the state of the stream drops keys it has seen (all of them, or those
    within ``delay`` of the ``time`` column, which bounds the state), and each batch is checked
    against the log, so that a batch which is repeated after a failure adds nothing.  The log may be
    read at any time.
    """
    s = stream_records(spark, path, schema)
    if delay and time:
        s = s.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
    else:
        s = s.dropDuplicates(keys)

    def write(batch: DataFrame, _: int) -> None:
        append_once(batch, log, keys)

    q = s.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
