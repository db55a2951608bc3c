"""What the committed commands of a replicated log lead to, beside the values that `feeds.applied_log` gives.

A log has range_id, log_index and op.  Commands that are settled by the last one of their key --
intents, transaction records, leases -- are aggregates, combined map side.  Closed timestamps
are checked by windows.  Changes of a range's descriptor depend on the one before, so these few
commands are folded in order, range by range.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _last(log: DataFrame, ops: list[str], keys: list[str], values: list[str]) -> DataFrame:
    """The last command of each key among those ops."""
    rows = log.where(F.col("op").isin(ops)).groupBy(*keys).agg(F.max_by(F.struct("op", *values), "log_index").alias("l"))
    return rows.select(*keys, "l.op", *(F.col("l")[v].alias(v) for v in values))


def open_intents(log: DataFrame) -> DataFrame:
    """Intents that no later command has cleared: put_intent and delete_intent by range and key (txn_id, epoch, strength)."""
    return _last(log, ["put_intent", "delete_intent"], ["range_id", "key"], ["txn_id", "epoch", "strength"]).where("op = 'put_intent'").drop("op")


def txn_records(log: DataFrame) -> DataFrame:
    """The last record of each transaction that a range holds (set_txn: txn_id, status, epoch)."""
    return _last(log, ["set_txn"], ["range_id", "txn_id"], ["status", "epoch"]).drop("op")


def range_state(log: DataFrame) -> DataFrame:
    """Of each range the applied index, the safe read frontier (latest time of a put or delete) and the lease."""
    put, lease = F.col("op").isin("put", "delete"), F.col("op") == "set_lease"
    return log.groupBy("range_id").agg(
        F.max("log_index").alias("applied_index"), F.max(F.when(put, F.col("ts"))).alias("frontier"),
        F.max_by("lease_seq", F.when(lease, F.col("log_index"))).alias("lease_seq"), F.max_by("holder", F.when(lease, F.col("log_index"))).alias("holder"))


def closed_updates(log: DataFrame) -> DataFrame:
    """Each set_closed command (lease_seq, closed) with the fault for which it is refused, or null.

    It needs a lease, that lease's sequence, and a time not before the one closed under it.  Of
    accepted commands sequence and time never fall, so the last accepted is the greatest
    one so far among those that fit their lease.
    """
    order = Window.partitionBy("range_id").orderBy("log_index")
    control = log.where(F.col("op").isin("set_lease", "set_closed")).select("range_id", "log_index", "op", "lease_seq", "closed")
    held = control.withColumn("_lease", F.last(F.when(F.col("op") == "set_lease", F.col("lease_seq")), ignorenulls=True).over(order))
    fits = F.when((F.col("op") == "set_closed") & (F.col("lease_seq") == F.col("_lease")), F.struct("lease_seq", "closed"))
    seen = held.withColumn("_before", F.max(fits).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    fault = F.when(F.col("_lease").isNull(), "no lease").when(F.col("lease_seq") != F.col("_lease"), "lease sequence").when(F.struct("lease_seq", "closed") < F.col("_before"), "regressed")
    return seen.where("op = 'set_closed'").select("range_id", "log_index", "lease_seq", "closed", fault.alias("fault"))


STEPS = "range_id long, log_index long, op string, fault string, generation long, start_key string, end_key string, replicas int"


def descriptor_step(now: dict | None, row: dict) -> tuple[dict | None, str | None]:
    """The descriptor after a command, and why the command is refused, if it is: then the descriptor stays."""
    op, new = row["op"], row["descriptor"]
    if op == "install":
        if now and new["generation"] < now["generation"]:
            return now, "stale"
        return new, None
    if row["expected_generation"] != (now["generation"] if now else 0):
        return now, "expected generation"
    if op == "update":
        return new, None
    if now is None:
        return now, "no range"
    if op == "split":
        right = row["other"]
        rules = [
            (new["range_id"] == now["range_id"], "left keeps its id"), (right["range_id"] != now["range_id"], "equal ids"), (new["start_key"] == now["start_key"], "left start"), (new["end_key"] is not None, "no split key"),
            (new["end_key"] == right["start_key"], "halves do not meet"), (right["end_key"] == now["end_key"], "right end"), (new["generation"] > now["generation"], "generation does not rise"),
        ]
        fault = next((name for holds, name in rules if not holds), None)
        return (now, fault) if fault else (new, None)
    replica = row["replica"]
    known = {r["replica_id"]: r for r in now["replicas"]}
    own = known.get(replica["replica_id"])
    if op == "add" and own or op in ("promote", "remove") and not own:
        return now, "exists already" if own else "not found"
    if op == "promote" and own["role"] != "LEARNER":
        return now, "not a learner"
    if op == "remove":
        if now["leaseholder"] == replica["replica_id"]:
            return now, "holds the lease"
        known.pop(replica["replica_id"])
        if not any(r["role"] == "VOTER" for r in known.values()):
            return now, "no voters left"
    else:
        known[replica["replica_id"]] = replica
    if len({r["node_id"] for r in known.values()}) < len(known):
        return now, "two on a node"
    return {**now, "generation": now["generation"] + 1, "replicas": list(known.values())}, None


def descriptor_steps(log: DataFrame) -> DataFrame:
    """Each command on a descriptor, with the fault for which it is refused, and the descriptor after it.

    log: range_id, log_index, op (install, update, split, add, promote, remove),
    expected_generation, descriptor and other (structs of range_id, generation, start_key,
    end_key, leaseholder, replicas), replica.  A range's commands are read in order from sorted
    batches; only its present descriptor is held.
    """
    import pyarrow as pa

    names = [c.split()[0] for c in STEPS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32()]

    def fold(batches) -> Iterator[pa.RecordBatch]:
        at, now = None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["range_id"] != at:
                    at, now = row["range_id"], None
                now, fault = descriptor_step(now, row)
                d = now or {"generation": None, "start_key": None, "end_key": None, "replicas": []}
                out.append((at, row["log_index"], row["op"], fault, d["generation"], d["start_key"], d["end_key"], len(d["replicas"])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=names)

    wanted = log.where(F.col("op").isin("install", "update", "split", "add", "promote", "remove")).select("range_id", "log_index", "op", "expected_generation", "descriptor", "other", "replica")
    return wanted.repartition("range_id").sortWithinPartitions("range_id", "log_index").mapInArrow(fold, STEPS)
