"""Decisions about transactions, all as joins and aggregates over their records, intents and locks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staging_recovery(required: DataFrame, observed: DataFrame) -> DataFrame:
    """Outcome of each staging transaction, with the keys that are missing and those that are contended.

    required: txn_id, range_id, key, strength, epoch.  observed: txn_id, range_id, key,
    intent_txn, epoch, strength, present, contested.  Committed only if every required intent is
    there, is its own, and is not contested.
    """
    o = observed.select("txn_id", "range_id", "key", F.col("intent_txn").alias("_txn"), F.col("epoch").alias("_epoch"), F.col("strength").alias("_strength"), "present", "contested")
    both = required.join(o, ["txn_id", "range_id", "key"], "left")
    own = F.coalesce(F.col("present") & (F.col("_txn") == F.col("txn_id")) & (F.col("_epoch") == F.col("epoch")) & (F.col("_strength") == F.col("strength")), F.lit(False))
    contested = F.coalesce("contested", F.lit(False))
    counted = both.groupBy("txn_id").agg(F.count("*").alias("required"), F.count_if(~own).alias("missing"), F.count_if(own & contested).alias("contended"),
        F.array_sort(F.collect_list(F.when(~own, F.col("key")))).alias("missing_keys"), F.array_sort(F.collect_list(F.when(own & contested, F.col("key")))).alias("contended_keys"))
    status = F.when((F.col("missing") == 0) & (F.col("contended") == 0), "COMMITTED").otherwise("ABORTED")
    return counted.select("txn_id", "required", "missing", "contended", status.alias("status"), "missing_keys", "contended_keys")


def doubled_observations(observed: DataFrame) -> DataFrame:
    """Keys that participants report more than once, or from more than one range."""
    return observed.groupBy("txn_id", "key").agg(F.count("*").alias("reports"), F.count_distinct("range_id").alias("ranges")).where("reports > 1 or ranges > 1")


def resolve_actions(outcomes: DataFrame, required: DataFrame) -> DataFrame:
    """What becomes of each required intent: commit or abort."""
    return required.join(outcomes.select("txn_id", "status"), "txn_id").select("txn_id", "range_id", "key", F.when(F.col("status") == "COMMITTED", "commit").otherwise("abort").alias("action"))


def sweep(records: DataFrame, intents: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """What a background pass does with each record (txn_id, status, deadline), given leftover intents and recovery outcomes."""
    left = intents.groupBy("txn_id").agg(F.count("*").alias("intents"))
    out = outcomes.select("txn_id", F.col("status").alias("recovered"))
    joined = records.join(left, "txn_id", "left").join(out, "txn_id", "left").withColumn("intents", F.coalesce("intents", F.lit(0)))
    action = (
        F.when((F.col("status") == "PENDING") & (F.col("deadline") < now), "abort")
        .when((F.col("status") == "STAGING") & (F.col("recovered") == "COMMITTED"), "commit")
        .when((F.col("status") == "STAGING"), "abort")
        .when(F.col("status").isin("COMMITTED", "ABORTED") & (F.col("intents") > 0), "resolve")
        .otherwise("none")
    )
    return joined.select("txn_id", "status", "intents", action.alias("action"))


def resolve(intents: DataFrame, records: DataFrame) -> DataFrame:
    """Versions that intents become: those of committed transactions, in the transaction's epoch."""
    r = records.select("txn_id", F.col("epoch").alias("_epoch"), "status", "commit_ts")
    return intents.join(r, "txn_id").where((F.col("status") == "COMMITTED") & (F.col("epoch") == F.col("_epoch"))).select("key", F.col("commit_ts").alias("ts"), "tombstone", "value")


def cleanups(intents: DataFrame, records: DataFrame) -> DataFrame:
    """What becomes of each intent and its lock: those of finished transactions, or of an epoch that is over, are deleted and released.

    `action` is apply (committed: the value is written first), drop, or keep, `release` whether
    the lock goes.  An intent without a record is kept: its transaction may be about to begin.
    """
    r = records.select("txn_id", F.col("epoch").alias("_epoch"), "status")
    stale = F.col("epoch") < F.col("_epoch")
    action = F.when(F.col("status").isNull(), "keep").when(stale, "drop").when(F.col("status") == "COMMITTED", "apply").when(F.col("status") == "ABORTED", "drop").otherwise("keep")
    return intents.join(r, "txn_id", "left").withColumn("action", action).select("txn_id", "key", "epoch", "action", (F.col("action") != "keep").alias("release"))


def conflicts(requests: DataFrame) -> DataFrame:
    """Pairs of lock requests on one key that cannot hold together: holder and asker differ and one is exclusive.

    requests: txn_id, read_ts, key, strength, held.
    """
    h = requests.where("held").select("key", F.col("txn_id").alias("holder"), F.col("read_ts").alias("holder_ts"), F.col("strength").alias("holder_strength"))
    a = requests.where("not held").select("key", F.col("txn_id").alias("asker"), F.col("read_ts").alias("asker_ts"), F.col("strength").alias("asker_strength"))
    return h.join(a, "key").where((F.col("holder") != F.col("asker")) & ~((F.col("holder_strength") == "SHARED") & (F.col("asker_strength") == "SHARED")))


def older(ts_a: Column, txn_a: Column, ts_b: Column, txn_b: Column) -> Column:
    """Age order: the earlier read time, then the smaller id."""
    return F.struct(ts_a.alias("t"), txn_a.alias("x")) < F.struct(ts_b.alias("t"), txn_b.alias("x"))


def wound_wait(requests: DataFrame) -> DataFrame:
    """For each waiting request on a key: granted, wound (it is older than all that block it) or wait, and how many block it."""
    pairs = conflicts(requests)
    blocked = pairs.groupBy("key", "asker").agg(F.count("*").alias("blockers"), F.bool_and(older(F.col("asker_ts"), F.col("asker"), F.col("holder_ts"), F.col("holder"))).alias("oldest"))
    asks = requests.where("not held").select("key", F.col("txn_id").alias("asker")).distinct()
    decision = F.when(F.col("blockers").isNull(), "granted").when(F.col("oldest"), "wound").otherwise("wait")
    return asks.join(blocked, ["key", "asker"], "left").select("key", "asker", F.coalesce("blockers", F.lit(0)).alias("blockers"), decision.alias("decision"))


LOCK_LOG = "key string, seq long, txn_id string, decision string, others string"


class KeyLocks:
    """Holders and waiters of one key.  A request has txn_id, read_ts, epoch and strength."""

    def __init__(self):
        self.holders: list[dict] = []
        self.waiters: list[dict] = []

    @staticmethod
    def age(request: dict) -> tuple:
        return request["read_ts"], request["txn_id"]

    def blockers(self, request: dict) -> list[dict]:
        """Holders that cannot hold beside a request: others, unless both share."""
        return [h for h in self.holders if h["txn_id"] != request["txn_id"] and not h["strength"] == request["strength"] == "SHARED"]

    @staticmethod
    def put(entries: list[dict], request: dict) -> None:
        """Add a request, in the place of an earlier one of the same transaction if there is one."""
        for k, e in enumerate(entries):
            if e["txn_id"] == request["txn_id"]:
                entries[k] = request
                return
        entries.append(request)

    @staticmethod
    def without(entries: list[dict], txns: set) -> list[dict]:
        return [e for e in entries if e["txn_id"] not in txns]

    def acquire(self, request: dict) -> tuple[str, list[dict]]:
        """granted, wound (with the victims) or wait (with whom it waits for)."""
        late = lambda e: e["txn_id"] == request["txn_id"] and e["epoch"] < request["epoch"]
        self.holders = [h for h in self.holders if not late(h)]
        self.waiters = [w for w in self.waiters if not late(w)]
        blockers = self.blockers(request)
        if not blockers:
            self.put(self.holders, request)
            self.waiters = self.without(self.waiters, {request["txn_id"]})
            return "granted", []
        if all(self.age(request) < self.age(b) for b in blockers):
            victims = {b["txn_id"] for b in blockers}
            self.holders, self.waiters = self.without(self.holders, victims), self.without(self.waiters, victims)
            self.put(self.holders, request)
            return "wound", blockers
        self.put(self.waiters, request)
        self.waiters.sort(key=self.age)
        return "wait", blockers

    def release(self, txn_id) -> list[dict]:
        """Waiters that hold now, in age order; a transaction that waits stays in the queue."""
        self.holders = self.without(self.holders, {txn_id})
        granted = []
        while (waiter := next((w for w in self.waiters if not self.blockers(w)), None)) is not None:
            self.waiters = self.without(self.waiters, {waiter["txn_id"]})
            self.put(self.holders, waiter)
            granted.append(waiter)
        return granted


def lock_table(log: DataFrame) -> DataFrame:
    """The decisions of a lock table over an ordered log of acquire and release (key, seq, op, txn_id, read_ts, epoch, strength).

    `others` are the victims of a wound or the holders a wait is for.  Each request's decision
    depends on all earlier ones of its key, so each key is folded in order, one row at a time
    from sorted batches; only the holders and waiters of one key are held in memory.
    """
    import pyarrow as pa

    def fold(batches) -> Iterator[pa.RecordBatch]:
        key, locks = None, KeyLocks()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["key"] != key:
                    key, locks = row["key"], KeyLocks()
                if row["op"] == "release":
                    out.append((key, row["seq"], row["txn_id"], "released", ""))
                    out += [(key, row["seq"], w["txn_id"], "granted", "") for w in locks.release(row["txn_id"])]
                else:
                    decision, others = locks.acquire(row)
                    out.append((key, row["seq"], row["txn_id"], decision, ",".join(sorted(o["txn_id"] for o in others))))
            if out:
                k, s, t, d, v = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(s, pa.int64()), pa.array(t, pa.string()), pa.array(d, pa.string()), pa.array(v, pa.string())], names=["key", "seq", "txn_id", "decision", "others"])

    return log.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(fold, LOCK_LOG)


def refresh_conflicts(spans: DataFrame, writes: DataFrame, bin_width: int | None = None) -> DataFrame:
    """Transactions (txn_id, start, end, read_ts, refresh_ts) a write (key, commit_ts) of the window between their times falls into.

    A point read is the span [k, k + one zero byte), so writes are points and a span holds them.
    With a bin width, for numeric keys and closed spans, spans and writes meet by equal bins, so
    that the join is dealt by key; a span takes part in each bin it touches.  Without one every
    span is compared with every write.
    """
    inside = (F.col("key") >= F.col("start")) & (F.col("end").isNull() | (F.col("key") < F.col("end"))) & (F.col("commit_ts") > F.col("read_ts")) & (F.col("commit_ts") <= F.col("refresh_ts"))
    if bin_width is None:
        return spans.join(writes.select("key", "commit_ts"), inside, "left_semi").select("txn_id").distinct()
    bins = F.sequence(F.floor(F.col("start") / bin_width), F.floor((F.col("end") - 1) / bin_width))
    dealt = spans.where("end > start").withColumn("_bin", F.explode(bins))
    points = writes.select("key", "commit_ts", F.floor(F.col("key") / bin_width).alias("_bin"))
    return dealt.alias("s").join(points.alias("w"), (F.col("s._bin") == F.col("w._bin")) & inside, "left_semi").select("txn_id").distinct()


def one_phase(writes: DataFrame, records: DataFrame) -> DataFrame:
    """Whether each transaction can commit in one step: pending, and all its writes in one range; with its commit time."""
    spread = writes.groupBy("txn_id").agg(F.count_distinct("range_id").alias("ranges"))
    joined = records.join(spread, "txn_id", "left").withColumn("ranges", F.coalesce("ranges", F.lit(0)))
    return joined.select("txn_id", "ranges", ((F.col("status") == "PENDING") & (F.col("ranges") == 1)).alias("eligible"), F.greatest("write_ts", "min_commit_ts").alias("commit_ts"))


def restarted(records: DataFrame, now: Column) -> DataFrame:
    """Records that may restart, one epoch later, their times moved forward; finished ones are left out."""
    return records.where(~F.col("status").isin("COMMITTED", "ABORTED")).withColumns({"epoch": F.col("epoch") + 1, "read_ts": F.greatest("read_ts", now), "write_ts": F.greatest("write_ts", now), "status": F.lit("PENDING")})


def invalid_records(records: DataFrame) -> DataFrame:
    """Records that break a rule of their kind, with the rule."""
    rule = (
        F.when(F.col("txn_id").isNull() | (F.col("txn_id") == ""), "id")
        .when(~F.col("status").isin("PENDING", "STAGING", "COMMITTED", "ABORTED"), "status")
        .when(F.col("write_ts") < F.col("read_ts"), "write before read")
        .when(F.col("status").isin("STAGING", "COMMITTED") & F.col("anchor_range").isNull(), "no anchor")
    )
    return records.withColumn("rule", rule).where("rule is not null")


def oldest_intent(intents: DataFrame) -> DataFrame:
    """The earliest unresolved write of each range."""
    return intents.groupBy("range_id").agg(F.min("write_ts").alias("oldest"))


def touched_once(records: DataFrame, more: str = "new_ranges") -> DataFrame:
    """touched with the new ranges added, each once, in order."""
    return records.withColumn("touched", F.array_sort(F.array_union("touched", more))).drop(more)


