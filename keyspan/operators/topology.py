"""What nodes report about a cluster, merged, joined and summed.

ranges: range_id, generation, start_key, end_key, leaseholder, row_count, replicas (array of
replica_id, node_id, role), seen (order of the report).  nodes: node_id, region, status, seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyspan.operators.relational import locate


def merged_nodes(reports: DataFrame) -> DataFrame:
    """The last report of each node."""
    return reports.groupBy("node_id").agg(F.max_by(F.struct(*(c for c in reports.columns if c != "node_id")), "seen").alias("r")).select("node_id", "r.*")


def merged_ranges(reports: DataFrame) -> DataFrame:
    """Of each range the highest generation; equal ones are put together: replicas (of equal ids the last), most rows, first filled fields."""
    top = reports.withColumn("_top", F.max("generation").over(Window.partitionBy("range_id"))).where("generation = _top")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seen"))).alias(c)
    fields = top.groupBy("range_id").agg(F.max("generation").alias("generation"), first("start_key"), first("end_key"), first("leaseholder"), F.max("row_count").alias("row_count"))
    each = top.select("range_id", "seen", F.explode("replicas").alias("r")).groupBy("range_id", F.col("r.replica_id").alias("_id")).agg(F.max_by("r", "seen").alias("r"))
    replicas = each.groupBy("range_id").agg(F.array_sort(F.collect_list("r")).alias("replicas"))
    return fields.join(replicas, "range_id", "left")


def edges(ranges: DataFrame) -> DataFrame:
    """A row for each replica: range, node, role and whether it holds the lease."""
    each = ranges.select("range_id", "leaseholder", F.explode("replicas").alias("r"))
    return each.select("range_id", F.col("r.node_id").alias("node_id"), F.col("r.replica_id").alias("replica_id"), F.col("r.role").alias("role"), (F.col("r.replica_id") == F.col("leaseholder")).alias("leaseholder"))


def related_events(events: DataFrame, node: Column | int, hosted: DataFrame) -> DataFrame:
    """Events of a node or of a range it hosts, each once, newest first."""
    kept = events.join(hosted.select("range_id").distinct().withColumn("_here", F.lit(True)), "range_id", "left").where((F.col("node_id") == node) | F.col("_here"))
    return deduplicated(kept.select(*events.columns)).orderBy(F.col("ts").desc(), "id")


def deduplicated(events: DataFrame) -> DataFrame:
    """One row for each id: the earliest, of equal ones the first by all columns."""
    rest = [c for c in events.columns if c not in ("id", "ts") and not events.schema[c].dataType.typeName() == "map"]
    first = F.min_by(F.struct(*(c for c in events.columns if c != "id")), F.struct("ts", *rest))
    return events.groupBy("id").agg(first.alias("e")).select("id", "e.*").select(*events.columns)


def range_detail(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each replica with its node's row, where there is one."""
    return edges(ranges).join(nodes, "node_id", "left")


def hosted_ranges(ranges: DataFrame, node: int) -> DataFrame:
    return ranges.where(F.exists("replicas", lambda r: r["node_id"] == node))


def table_counts(rows: DataFrame, key: str, table: str, ranges: DataFrame) -> DataFrame:
    """Visible rows by range and table."""
    return locate(rows.select(key, table), key, ranges).groupBy("range_id", table).agg(F.count("*").alias("row_count"))


def stats(counts: DataFrame) -> DataFrame:
    """By table: rows, ranges and replicas; counts: table_name, range_id, row_count, replica_count."""
    return counts.groupBy("table_name").agg(F.sum("row_count").alias("rows"), F.count_distinct("range_id").alias("ranges"), F.sum("replica_count").alias("replicas"))


def scenario(manifest: DataFrame, nodes: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of a run's nodes (node_id): the live ones, the missing ones, and the ranges with a replica on one."""
    wanted = manifest.select("node_id").distinct()
    touched = ranges.join(edges(ranges).join(wanted, "node_id", "left_semi").select("range_id").distinct(), "range_id", "left_semi")
    return nodes.join(wanted, "node_id", "left_semi"), wanted.join(nodes, "node_id", "left_anti"), touched


def next_range_id(ranges: DataFrame) -> DataFrame:
    """The id after the largest one; 1 if there are no ranges."""
    return ranges.agg((F.coalesce(F.max("range_id"), F.lit(0)) + 1).cast("long").alias("next_id"))


def shard_labels(counts: DataFrame) -> DataFrame:
    """Each range with the name of its first table, and how many tables it has (range_id, table_id, table_name)."""
    return counts.groupBy("range_id").agg(F.min_by("table_name", "table_id").alias("label"), F.count_distinct("table_id").alias("tables"))


def totals(ranges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for a cluster: its nodes, ranges, replicas and rows."""
    r = ranges.agg(F.count("*").alias("ranges"), F.coalesce(F.sum(F.size("replicas")), F.lit(0)).cast("long").alias("replicas"), F.coalesce(F.sum("row_count"), F.lit(0)).cast("long").alias("rows"))
    return r.join(nodes.agg(F.count("*").alias("nodes")))  # one row each
