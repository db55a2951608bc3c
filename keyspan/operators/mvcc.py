"""Views of an append-only log of row versions.

A log has key columns, an ordering (one or more columns, larger is newer), a boolean tombstone
and payload columns.  The newest version of a key is found by an aggregate that is combined map
side, so a key with a third of all versions costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _newest(log: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in log.columns if c not in keys]
    picked = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_newest"))
    return picked.select(*keys, *(F.col("_newest")[c].alias(c) for c in rest)).select(*log.columns)


def latest(log: DataFrame, keys: Sequence[str], order: Sequence[str], tombstone: str = "tombstone") -> DataFrame:
    """The newest version of each key, without keys whose newest version is a tombstone."""
    return _newest(log, keys, order).where(~F.col(tombstone))


def as_of(log: DataFrame, keys: Sequence[str], order: Sequence[str], until: Column, tombstone: str = "tombstone") -> DataFrame:
    """The latest view of the versions at or before `until`, a value of struct(order)."""
    kept = F.col(order[0]) <= until if len(order) == 1 else F.struct(*order) <= until
    return latest(log.where(kept), keys, order, tombstone)


def exact(log: DataFrame, wanted: DataFrame, keys: Sequence[str], order: Sequence[str], tombstone: str = "tombstone") -> DataFrame:
    """wanted (keys, order) with `status`: live, deleted, or missing where no version has exactly that time.

    Only versions that are asked for are grouped: the log is cut down by a semi-join first.
    """
    on = [*keys, *order]
    found = log.select(*on, tombstone).join(wanted.select(*on), on, "left_semi").groupBy(*on).agg(F.bool_or(tombstone).alias("_gone"))
    status = F.when(F.col("_gone").isNull(), "missing").when(F.col("_gone"), "deleted").otherwise("live")
    return wanted.join(found, on, "left").select(*wanted.columns, status.alias("status"))


def overlay(base: DataFrame, pending: DataFrame, keys: Sequence[str], tombstone: str = "tombstone") -> DataFrame:
    """base as its writer sees it: pending rows replace theirs, pending tombstones hide theirs."""
    return base.join(pending.select(*keys).distinct(), list(keys), "left_anti").unionByName(pending.where(~F.col(tombstone)).select(*base.columns))


def version_counts(log: DataFrame, keys: Sequence[str], tombstone: str = "tombstone") -> DataFrame:
    return log.groupBy(*keys).agg(F.count("*").alias("versions"), F.count_if(F.col(tombstone)).alias("tombstones"))


def gated_read(log: DataFrame, wanted: DataFrame, closed: DataFrame, keys: Sequence[str], at: str, tombstone: str = "tombstone") -> DataFrame:
    """Exact versions as a follower may read them.

    wanted: range_id, keys, at, known_sequence.  closed: what each range has published, range_id,
    lease_seq and closed.  `gate` is ok or why not: no_closed, lease_mismatch, too_fresh; `status`
    as in `exact`, null unless the gate is ok.
    """
    both = wanted.join(closed.select("range_id", "lease_seq", "closed"), "range_id", "left")
    gate = F.when(F.col("closed").isNull(), "no_closed").when(F.col("known_sequence") != F.col("lease_seq"), "lease_mismatch").when(F.col(at) > F.col("closed"), "too_fresh").otherwise("ok")
    judged = exact(log, both.withColumn("gate", gate).drop("lease_seq", "closed"), keys, [at], tombstone)
    return judged.withColumn("status", F.when(F.col("gate") == "ok", F.col("status")))


def seek(table: DataFrame, key: str, at_least) -> DataFrame:
    """The first row whose key is at least the given one."""
    return table.where(F.col(key) >= at_least).orderBy(key).limit(1)
