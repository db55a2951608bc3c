"""Event feeds and replicated logs as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Past events a new subscriber sees, and how many ids a feed remembers (fixed values).
REPLAY, REMEMBERED = 256, 8 * 256


def event_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated_stream(events: DataFrame, ts: str = "ts", key: str = "id", late: str = "10 minutes") -> DataFrame:
    """Each id once; ids are remembered for as long as late events are waited for, which bounds the state."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def replay(events: DataFrame, n: int = REPLAY, ts: str = "ts", key: str = "id") -> DataFrame:
    """The last n events, oldest first."""
    return events.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(n).orderBy(ts, key)


def hourly(events: DataFrame, ts: str = "ts", kind: str = "event_type") -> DataFrame:
    return events.groupBy(F.window(ts, "1 hour").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour_start"), kind, "n")


def hourly_stream(events: DataFrame, ts: str = "ts", kind: str = "event_type", late: str = "1 hour") -> DataFrame:
    return hourly(events.withWatermark(ts, late), ts, kind)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is, then stop; a run that was cut short goes on from its checkpoint."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


CLOSED = "range_id long, lease_seq long, closed long"


def closed_timestamps(inputs: DataFrame) -> DataFrame:
    """A running closed time for each range, over a stream of (range_id, lease_seq, candidate)."""

    def advance(key, frames: Iterator[pd.DataFrame], state):
        lease, closed = state.get if state.exists else (-1, 0)
        for frame in frames:
            for seq, candidate in frame.sort_values(["lease_seq", "candidate"])[["lease_seq", "candidate"]].itertuples(index=False):
                if seq > lease or (seq == lease and candidate > closed):
                    lease, closed = int(seq), int(candidate)
        state.update((lease, closed))
        yield pd.DataFrame({"range_id": [key[0]], "lease_seq": [lease], "closed": [closed]})

    return inputs.groupBy("range_id").applyInPandasWithState(advance, CLOSED, "lease_seq long, closed long", "update", "NoTimeout")


def applied_log(log: DataFrame) -> DataFrame:
    """The state a range's ordered log (range_id, log_index, op, key, value, generation) leads to: its live keys.

    Puts and deletes of a key are settled by its last entry after the last snapshot install, so
    the fold is an aggregate.  Entries of a generation below the range's own at that time are
    refused.
    """
    from pyspark.sql import Window

    ordered = Window.partitionBy("range_id").orderBy("log_index")
    seen = log.withColumn("_top", F.max("generation").over(ordered.rowsBetween(Window.unboundedPreceding, -1)))
    accepted = seen.where(F.col("_top").isNull() | (F.col("generation") >= F.col("_top")))
    fresh = accepted.withColumn("_install", F.max(F.when(F.col("op") == "install", F.col("log_index"))).over(Window.partitionBy("range_id")))
    entries = fresh.where(F.col("op").isin("put", "delete") & (F.col("_install").isNull() | (F.col("log_index") > F.col("_install"))))
    last = entries.groupBy("range_id", "key").agg(F.max_by(F.struct("op", "value"), "log_index").alias("l"))
    return last.where("l.op = 'put'").select("range_id", "key", F.col("l.value").alias("value"))
