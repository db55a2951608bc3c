"""Closed timestamps, follower reads, leases and the routes reads take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyspan.functions import hlc


def closed_candidate(applied: Column, now: Column, offset: Column, oldest_intent: Column) -> Column:
    """The latest time that can be closed: applied, not too near to now, before the oldest intent."""
    bound = F.least(applied, hlc.minus_wall(now, offset))
    return F.when(oldest_intent.isNull(), bound).otherwise(F.least(bound, hlc.previous_tick(oldest_intent)))


def published(inputs: DataFrame) -> DataFrame:
    """Closed time after each step of (range_id, lease_seq, step, applied, now, max_offset, oldest_intent, clock_bad).

    Within a lease sequence it never falls; a step with a bad clock, or whose candidate is zero
    or no later, publishes nothing.  A new lease sequence starts afresh.
    """
    candidate = closed_candidate(F.col("applied"), F.col("now"), F.col("max_offset"), F.col("oldest_intent"))
    usable = F.when(~F.col("clock_bad") & ~hlc.is_zero(candidate), candidate)
    w = Window.partitionBy("range_id", "lease_seq").orderBy("step")
    rows = inputs.withColumn("_c", usable)
    rows = rows.withColumn("closed", F.max("_c").over(w)).withColumn("_before", F.max("_c").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.col("_c").isNotNull() & (F.col("_before").isNull() | (F.col("_c") > F.col("_before")))
    return rows.select("range_id", "lease_seq", "step", "closed", fresh.alias("published"))


def follower_gate(known_sequence: Column, sequence: Column, applied: Column, read: Column, closed: Column) -> Column:
    """ok, or why a follower cannot serve a read."""
    return F.when(known_sequence != sequence, "lease_mismatch").when(applied < closed, "not_applied").when(read > closed, "too_fresh").otherwise("ok")


def routed(reads: DataFrame) -> DataFrame:
    """Where a historical read goes, and why.

    reads: read_id, local_replica, leaseholder, local_region, leaseholder_region, preferred
    (regions, the first favoured; null or empty: no placement), known_sequence, lease_seq, applied, read_ts and
    closed (null: none known), the last three hybrid timestamps.  The follower itself answers if
    its gate lets it, unless placement prefers the leaseholder's region and not its own.
    """
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    local, holder = plain("local_region"), plain("leaseholder_region")
    regions = F.coalesce(F.transform("preferred", lambda r: F.lower(F.trim(r))), F.array().cast("array<string>"))
    gate = F.when(F.col("closed").isNull(), "no_closed").otherwise(follower_gate(F.col("known_sequence"), F.col("lease_seq"), F.col("applied"), F.col("read_ts"), F.col("closed")))
    placed = F.size(regions) > 0
    rows = reads.withColumns({"gate": gate, "_local": local, "_holder": holder, "_placed": placed, "_local_in": (local != "") & F.array_contains(regions, local), "_holder_in": (holder != "") & F.array_contains(regions, holder)})
    ok, own = F.col("gate") == "ok", F.col("local_replica") == F.col("leaseholder")
    drawn = F.col("_placed") & (F.col("_local") != "") & (F.col("_holder") != "") & (F.col("_local") != F.col("_holder")) & ~F.col("_local_in") & F.col("_holder_in")
    follower = ok & ~drawn
    gap = F.when(F.col("gate").isin("no_closed", "ok"), hlc.stamp(F.lit(0), F.lit(0))).otherwise(hlc.gap(F.col("read_ts"), F.least("closed", "applied")))
    mode = F.when(follower, "follower").when(own, "local_leaseholder").otherwise("leaseholder")
    reason = (
        F.when(follower & F.col("_placed") & F.col("_local_in"), "safe, in a preferred region").when(follower, "safe")
        .when(ok, "safe, but placement prefers the leaseholder's region")
        .when(own & F.col("_placed") & F.col("_holder_in"), "local leaseholder in a preferred region").when(own, "local leaseholder")
        .when(F.col("gate") == "lease_mismatch", "closed under another lease").when(F.col("gate") == "not_applied", "closed time not applied here")
        .when(F.col("_placed") & F.col("_holder_in"), "not safe yet, to the preferred leaseholder").otherwise("not safe yet")
    )
    rows = rows.withColumn("_gap", gap)
    return rows.select(
        "read_id", "gate", mode.alias("mode"), F.when(follower, F.col("local_replica")).otherwise(F.col("leaseholder")).alias("target"),
        F.when(follower, F.col("_local")).otherwise(F.col("_holder")).alias("target_region"), F.col("_gap.wall").alias("gap_wall"), F.col("_gap.logical").alias("gap_logical"), reason.alias("reason"),
    )


def safe_frontier(applied: DataFrame) -> DataFrame:
    """The latest commit time applied so far, for each entry of (range_id, log_index, commit_ts)."""
    return applied.withColumn("frontier", F.max("commit_ts").over(Window.partitionBy("range_id").orderBy("log_index")))


def fast_read(reads: DataFrame) -> DataFrame:
    """Whether a leaseholder may answer at once; reads has the lease's fields and the request's."""
    ok = (
        ~F.col("clock_bad") & (F.col("replica_id") == F.col("holder")) & (F.col("applied_seq") == F.col("lease_seq")) & (F.col("epoch") == F.col("holder_epoch"))
        & (F.col("now") >= F.col("start_ts")) & (F.col("now") < F.col("expiration_ts")) & (F.col("read_ts") <= F.col("frontier"))
    )
    return reads.withColumn("fast", F.coalesce(ok, F.lit(False)))


def transferred(leases: DataFrame, target: Column, epoch: Column, now: Column, expiration: Column) -> DataFrame:
    """Leases in the hands of another replica: the sequence is one later, the start never moves back."""
    return leases.withColumns({"holder": target, "holder_epoch": epoch, "start_ts": F.greatest("start_ts", now), "expiration_ts": expiration, "lease_seq": F.col("lease_seq") + 1})


def renewable(leases: DataFrame, start: Column) -> Column:
    return start >= F.col("start_ts")


def liveness(heartbeats: DataFrame) -> DataFrame:
    """The newest heartbeat of each node; its epoch is the number of its starts."""
    return heartbeats.groupBy("node_id").agg(F.max("ts").alias("last_seen"), F.sum(F.col("restart").cast("long")).alias("epoch"))
