"""JSON sources and sinks: cluster topology, run artefacts, node snapshots, workload reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOPOLOGY = "cluster_id string, nodes array<struct<node_id:bigint,region:string,zone:string>>, ranges array<struct<range_id:bigint,generation:bigint,start_key:string,end_key:string,leaseholder:bigint,replicas:array<struct<replica_id:bigint,node_id:bigint,role:string>>>>"
SUMMARY = "run_id string, name string, status string, started_at timestamp, finished_at timestamp, nodes array<bigint>"


def topology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and ranges of a cluster's manifest file."""
    manifest = spark.read.schema(TOPOLOGY).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return manifest.select(F.inline("nodes")), manifest.select(F.inline("ranges"))


def run_summaries(spark: SparkSession, root: str) -> DataFrame:
    """Summaries of all runs below a folder, newest finished first, each with its folder's name."""
    found = spark.read.schema(SUMMARY).option("multiLine", True).json(f"{root}/*/summary.json")
    folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
    return found.withColumn("folder", folder).orderBy(F.col("finished_at").desc_nulls_last(), "folder")


def node_snapshots(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Snapshots of several nodes as one table; `seen` is the order in which a node's is given."""
    frames = [spark.read.schema(schema).option("multiLine", True).json(p).withColumn("seen", F.lit(k)) for k, p in enumerate(paths)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("error").json(path)
