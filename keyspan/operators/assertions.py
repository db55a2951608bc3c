"""Checks of a run's log: each returns the rows that break the rule, so an empty result passes.

logs: node_id, ts, message, where a message is a marker `kind key=value ...`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyspan.functions.keys import marker_fields, marker_kind


def markers(logs: DataFrame) -> DataFrame:
    """Messages with their kind and fields; plain messages are left out."""
    return logs.where(F.col("message").rlike(r"^\w+( \S+=\S*)+$")).withColumns({"kind": marker_kind(F.col("message")), "fields": marker_fields(F.col("message"))})


def lost_writes(marks: DataFrame, acked: str = "write_ack", visible: str = "write_visible", field: str = "token") -> DataFrame:
    """Tokens that were acknowledged and are not visible."""
    token = F.col("fields")[field].alias("token")
    return marks.where(F.col("kind") == acked).select(token).distinct().join(marks.where(F.col("kind") == visible).select(token), "token", "left_anti")


def stale_reads(reads: DataFrame) -> DataFrame:
    """Follower reads above the closed time, or that say they broke a rule (read_ts, closed_ts, status)."""
    return reads.where((F.col("status") == "violation") | (F.col("read_ts") > F.col("closed_ts")))


def unsettled(outcomes: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Transactions (txn_id, result) with other than one distinct outcome."""
    counted = outcomes.groupBy("txn_id").agg(F.count_distinct("result").alias("outcomes"))
    if expected is not None:
        counted = expected.select("txn_id").distinct().join(counted, "txn_id", "left").withColumn("outcomes", F.coalesce("outcomes", F.lit(0)))
    return counted.where("outcomes <> 1")


def regressions(observations: DataFrame, value: str) -> DataFrame:
    """Observations (range_id, ts, node_id, value) below the one before, in order of time and node."""
    before = F.lag(value).over(Window.partitionBy("range_id").orderBy("ts", "node_id"))
    return observations.withColumn("before", before).where(F.col(value) < F.col("before"))
