"""Operators on small tables with known results."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from keyspan.errors import SqlError, UniqueViolation, transaction_error
from keyspan.functions import hlc, keys
from keyspan.operators import assertions, dml, mvcc, placement, relational, timeline, topology, transactions, workload
from keyspan.sources import documents
from keyspan.streaming import feeds, replica_log


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_versions_match_a_replayed_dict(spark):
    random.seed(1)
    log = [(random.randrange(20), n, random.random() < 0.3, f"v{n}") for n in range(300)]
    df = spark.createDataFrame(log, "k int, ts int, tombstone boolean, v string")
    for until in (0, 10, 150, 299):
        state = {}
        for k, n, gone, v in log[: until + 1]:
            state.pop(k, None)
            if not gone:
                state[k] = v
        got = mvcc.as_of(df, ["k"], ["ts"], F.lit(until))
        assert {r["k"]: r["v"] for r in got.collect()} == state
    wanted = spark.createDataFrame([(log[5][0], 5), (log[6][0], 6), (99, 1)], "k int, ts int")
    status = {(r["k"], r["ts"]): r["status"] for r in mvcc.exact(df, wanted, ["k"], ["ts"]).collect()}
    assert status == {(log[n][0], n): "deleted" if log[n][2] else "live" for n in (5, 6)} | {(99, 1): "missing"}


def test_overlay_hides_and_replaces(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    pending = spark.createDataFrame([(2, "x", False), (3, None, True), (4, "new", False)], "k int, v string, tombstone boolean")
    assert rows(mvcc.overlay(base, pending, ["k"])) == [(1, "a"), (2, "x"), (4, "new")]


def test_changes_check_before_they_write(spark):
    current = spark.createDataFrame([(1, "a@x"), (2, None)], "id int, email string")
    with pytest.raises(UniqueViolation):
        dml.update(current, F.col("id") == 2, {"email": "a@x"}, ["id"], {"email_key": ["email"]})
    with pytest.raises(UniqueViolation):
        dml.insert(current, spark.createDataFrame([(8, "z"), (9, "z")], "id int, email string"), ["id"], {"email_key": ["email"]})
    swapped = spark.createDataFrame([(1, "c@x"), (2, "a@x")], "id int, email string")
    assert rows(dml.upsert(current, swapped, ["id"], {"email_key": ["email"]}).returning) == rows(swapped)
    with pytest.raises(UniqueViolation):
        dml.upsert(current, swapped.where("id = 2"), ["id"], {"email_key": ["email"]})
    assert rows(dml.update(current, F.col("id") == 1, {"email": "b@x"}, ["id"], {"email_key": ["email"]}).returning) == [(1, "b@x")]
    new = spark.createDataFrame([(3, None), (4, "a@x")], "id int, email string")
    assert rows(dml.on_conflict_do_nothing(current, new, ["email"], ["id"]).returning) == [(3, None)]
    assert rows(dml.index_changes(current, current.where("id = 2"), ["email"], ["id"])) == [("a@x", 1, "del")]


def test_locate_finds_each_keys_range(spark):
    ranges = spark.createDataFrame([(1, "", "g"), (2, "g", "p"), (3, "t", None)], "range_id int, start_key string, end_key string")
    key_rows = spark.createDataFrame([(k,) for k in ("a", "g", "o", "p", "t", "zz")], "key string")
    assert {r["key"]: r["range_id"] for r in relational.locate(key_rows, "key", ranges).collect()} == {"a": 1, "g": 2, "o": 2, "t": 3, "zz": 3}
    assert relational.locate_one("o", ranges).first()["range_id"] == 2
    for missing in ("p", "q"):
        with pytest.raises(LookupError):
            relational.locate_one(missing, ranges)


@pytest.mark.parametrize("settings", [{"spark.sql.adaptive.enabled": "false"}, {}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}])
@pytest.mark.parametrize("slices", [1, 16, 61])
def test_locate_with_many_slices(spark, settings, slices):
    """Ranges longer than a slice, gaps, open ends, repeated and null keys; whatever adaptive execution does."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        numbers = spark.range(-20000, 20000).select(F.when(F.col("id") % 3 == 0, 777).otherwise(F.col("id")).alias("k"), F.col("id").alias("row")).union(spark.createDataFrame([(None, 0)], "k long, row long")).repartition(8)
        spans = [(None, -15000, 0), (-15000, -14990, 1), (-5000, 5000, 2), (5000, 5001, 3), (6000, 6001, 4), (9000, None, 5)]
        ranges = spark.createDataFrame(spans, "start_key long, end_key long, range_id int")
        want = {}
        for r in numbers.where("k is not null").collect():
            for low, high, i in spans:
                if (low is None or low <= r["k"]) and (high is None or r["k"] < high):
                    want[r["row"]] = i
        got = relational.locate(numbers, "k", ranges, slices=slices).collect()
        assert len(got) == len(want) and {r["row"]: r["range_id"] for r in got} == want
        even = spark.range(400).select((F.col("id") * 50).alias("start_key"), (F.col("id") * 50 + 25).alias("end_key"), F.col("id").alias("range_id"))
        points = spark.range(20000).select(F.col("id").alias("k")).repartition(8)
        assert relational.locate(points, "k", even, slices=slices).where("k >= start_key and k < end_key and range_id = k div 50").count() == 10000
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_staging_recovery(spark):
    need = "txn_id string, range_id long, key string, strength string, epoch int"
    required = spark.createDataFrame([(t, r, k, "EXCLUSIVE", 1) for t in ("both", "one", "other", "contested") for r, k in ((7, "alice"), (9, "bob"))], need)
    seen = [("both", 7, "alice", "both", 1, "EXCLUSIVE", True, False), ("both", 9, "bob", "both", 1, "EXCLUSIVE", True, False), ("one", 7, "alice", "one", 1, "EXCLUSIVE", True, False),
            ("other", 7, "alice", "other", 2, "EXCLUSIVE", True, False), ("other", 9, "bob", "x", 1, "EXCLUSIVE", True, False), ("contested", 7, "alice", "contested", 1, "EXCLUSIVE", True, True), ("contested", 9, "bob", "contested", 1, "EXCLUSIVE", True, False)]
    observed = spark.createDataFrame(seen, "txn_id string, range_id long, key string, intent_txn string, epoch int, strength string, present boolean, contested boolean")
    out = transactions.staging_recovery(required, observed)
    assert {r["txn_id"]: (r["missing"], r["contended"], r["status"]) for r in out.collect()} == {"both": (0, 0, "COMMITTED"), "one": (1, 0, "ABORTED"), "other": (2, 0, "ABORTED"), "contested": (0, 1, "ABORTED")}
    assert {r["action"] for r in transactions.resolve_actions(out, required).where("txn_id = 'one'").collect()} == {"abort"}


def test_lock_table(spark):
    log = [("k", 1, "acquire", "old", 1, 0, "EXCLUSIVE"), ("k", 2, "acquire", "young", 5, 0, "EXCLUSIVE"), ("k", 3, "release", "old", 1, 0, ""), ("k", 4, "acquire", "old", 1, 0, "EXCLUSIVE"),
           ("s", 1, "acquire", "a", 1, 0, "SHARED"), ("s", 2, "acquire", "b", 2, 0, "SHARED"), ("e", 1, "acquire", "t", 1, 0, "SHARED"), ("e", 2, "acquire", "t", 1, 1, "EXCLUSIVE"),
           ("w", 1, "acquire", "x", 1, 0, "EXCLUSIVE"), ("w", 2, "acquire", "x", 1, 0, "SHARED"), ("w", 3, "acquire", "y", 2, 0, "SHARED")]
    got = transactions.lock_table(spark.createDataFrame(log, "key string, seq long, op string, txn_id string, read_ts long, epoch int, strength string"))
    assert [(r["key"], r["seq"], r["txn_id"], r["decision"], r["others"]) for r in got.orderBy("key", "seq").collect() if r["key"] == "k"] == [
        ("k", 1, "old", "granted", ""), ("k", 2, "young", "wait", "old"), ("k", 3, "old", "released", ""), ("k", 3, "young", "granted", ""), ("k", 4, "old", "wound", "young")]
    assert {r["decision"] for r in got.where("key <> 'k'").collect()} == {"granted"}  # also y: x holds as SHARED by then


def replayed(log):
    """Decisions by plain sets of holders and waiters, looked through anew for each request."""
    out, holding, queue = [], {}, {}
    for key, seq, op, txn, ts, epoch, strength in sorted(log):
        held, waits = holding.setdefault(key, {}), queue.setdefault(key, {})
        clash = lambda who, kind: sorted(h for h, (_, _, s) in held.items() if h != who and "EXCLUSIVE" in (s, kind))  # noqa: B023, E731
        if op == "release":
            held.pop(txn, None)
            out.append((key, seq, txn, "released", ""))
            while True:
                free = [(t, w) for w, (t, _, s) in waits.items() if not clash(w, s)]
                if not free:
                    break
                w = min(free)[1]
                held[w] = waits.pop(w)
                out.append((key, seq, w, "granted", ""))
            continue
        for table in (held, waits):
            if txn in table and table[txn][1] < epoch:
                del table[txn]
        against = clash(txn, strength)
        if not against:
            held[txn] = (ts, epoch, strength)
            waits.pop(txn, None)
            out.append((key, seq, txn, "granted", ""))
        elif all((ts, txn) < (held[h][0], h) for h in against):
            for h in against:
                del held[h]
                waits.pop(h, None)
            held[txn] = (ts, epoch, strength)
            out.append((key, seq, txn, "wound", ",".join(against)))
        else:
            waits[txn] = (ts, epoch, strength)
            out.append((key, seq, txn, "wait", ",".join(against)))
    return out


def test_lock_table_against_a_replay(spark):
    random.seed(11)
    ages = [random.randrange(6) for _ in range(12)]
    log = [(f"k{random.randrange(9)}", n, random.choice(["acquire"] * 3 + ["release"]), f"t{(who := random.randrange(12))}", ages[who], n // 300, random.choice(["SHARED", "EXCLUSIVE"])) for n in range(900)]
    got = transactions.lock_table(spark.createDataFrame(log, "key string, seq long, op string, txn_id string, read_ts long, epoch int, strength string").repartition(5))
    want = replayed(log)
    assert {d for *_, d, _ in want} == {"granted", "released", "wait", "wound"}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_refresh_and_one_phase(spark):
    spans = spark.createDataFrame([("t", "a", "m", 10, 20)], "txn_id string, start string, end string, read_ts int, refresh_ts int")
    hit = lambda key, ts: transactions.refresh_conflicts(spans, spark.createDataFrame([(key, ts)], "key string, commit_ts int")).count()
    assert (hit("b", 15), hit("z", 15), hit("b", 9), hit("m", 15), hit("b", 20), hit("b", 10)) == (1, 0, 0, 0, 1, 0)
    numbers = spark.createDataFrame([(f"t{k}", k * 7, k * 7 + k, 10, 20) for k in range(50)], "txn_id string, start int, end int, read_ts int, refresh_ts int")
    points = spark.createDataFrame([(k * 5, 10 + k % 12) for k in range(90)], "key int, commit_ts int")
    assert rows(transactions.refresh_conflicts(numbers, points, 16)) == rows(transactions.refresh_conflicts(numbers, points))
    records = spark.createDataFrame([("t", "PENDING", 5, 9), ("u", "PENDING", 5, 1), ("v", "COMMITTED", 5, 1)], "txn_id string, status string, write_ts int, min_commit_ts int")
    writes = spark.createDataFrame([("t", 1), ("t", 1), ("u", 1), ("u", 2), ("v", 1)], "txn_id string, range_id int")
    assert rows(transactions.one_phase(writes, records)) == [("t", 1, True, 9), ("u", 2, False, 5), ("v", 1, False, 5)]


def test_closed_timestamps(spark):
    steps = [(1, 1, 1, 90, 0, 100, None, None, False), (1, 1, 2, 95, 0, 110, None, None, False), (1, 1, 3, 99, 0, 120, 80, 2, False), (1, 1, 4, 120, 0, 130, None, None, True), (1, 2, 5, 50, 0, 60, 41, 0, False)]
    df = spark.createDataFrame(steps, "range_id int, lease_seq int, step int, a long, al long, n long, i long, il long, clock_bad boolean")
    inputs = df.select("range_id", "lease_seq", "step", hlc.stamp("a", "al").alias("applied"), hlc.stamp("n", 0).alias("now"), F.lit(5).cast("long").alias("max_offset"), F.when(F.col("i").isNotNull(), hlc.stamp("i", "il")).alias("oldest_intent"), "clock_bad")
    got = {r["step"]: ((r["closed"]["wall"], r["closed"]["logical"]), r["published"]) for r in timeline.published(inputs).collect()}
    assert got == {1: ((90, 0), True), 2: ((95, 0), True), 3: ((95, 0), False), 4: ((95, 0), False), 5: ((40, hlc.LAST_LOGICAL), True)}


def test_routing(spark):
    reads = [(1, 2, 1, "eu", "us", ["eu"], 3, 3, 60, 50, 50), (2, 2, 1, "as", "us", ["us"], 3, 3, 60, 50, 50), (3, 2, 1, "eu", "us", ["eu"], 3, 3, 60, 60, 50), (4, 2, 1, "eu", "us", ["us"], 2, 3, 60, 40, 50), (5, 2, 1, "eu", "us", ["eu"], 3, 3, 40, 45, 50),
             (6, 2, 1, "eu", "us", ["us "], 3, 3, 40, 40, None), (7, 1, 1, "us", "us", ["US"], 3, 3, 40, 60, 50), (8, 2, 1, " EU", "eu", ["eu"], 3, 3, 60, 50, 50), (9, 2, 1, "as", "us", None, 3, 3, 60, 50, 50)]
    df = spark.createDataFrame(reads, "read_id int, local_replica int, leaseholder int, local_region string, leaseholder_region string, preferred array<string>, known_sequence int, lease_seq int, applied long, read_ts long, closed long")
    timed = df.withColumns({"applied": hlc.stamp("applied", 0), "read_ts": hlc.stamp(F.col("read_ts"), F.when(F.col("read_id") == 5, 3).otherwise(0)), "closed": F.when(F.col("closed").isNotNull(), hlc.stamp("closed", 0))})
    assert {r["read_id"]: (r["gate"], r["mode"], r["target"], r["gap_wall"], r["reason"]) for r in timeline.routed(timed).collect()} == {
        1: ("ok", "follower", 2, 0, "safe, in a preferred region"), 2: ("ok", "leaseholder", 1, 0, "safe, but placement prefers the leaseholder's region"), 3: ("too_fresh", "leaseholder", 1, 10, "not safe yet"),
        4: ("lease_mismatch", "leaseholder", 1, 0, "closed under another lease"), 5: ("not_applied", "leaseholder", 1, 5, "closed time not applied here"), 6: ("no_closed", "leaseholder", 1, 0, "not safe yet, to the preferred leaseholder"),
        7: ("not_applied", "local_leaseholder", 1, 20, "local leaseholder in a preferred region"), 8: ("ok", "follower", 2, 0, "safe, in a preferred region"), 9: ("ok", "follower", 2, 0, "safe")}


def test_policies():
    P = placement.Policy
    assert (placement.compiled(P("REGIONAL", preferred=["US-East1 "])).replicas, placement.compiled(P("REGIONAL", preferred=["a"])).least_regions) == (3, 1)
    home = placement.compiled(P("HOME_REGION", home="a", preferred=["b", "c"]))
    assert home.preferred == ("a", "b", "c") and home.lease_preferences == ("a",) and (home.replicas, home.least_regions) == (5, 3)
    for bad in (P("GLOBAL", preferred=["a", "b"]), P("REGIONAL", preferred=["a", "b"]), P("HOME_REGION"), P("REGIONAL", home="a", preferred=["a"]), P("REGIONAL", preferred=["a"], survival="REGION_FAILURE"), P("X")):
        with pytest.raises(SqlError):
            placement.compiled(bad)


def test_rebalance(spark):
    replicas = spark.createDataFrame([(7, k + 1, k + 1, "VOTER", k, k == 0) for k in range(3)], "range_id int, replica_id int, node_id int, role string, ordinal int, leaseholder boolean")
    node = "node_id int, region string, load double, draining boolean, ordinal int"
    nodes = spark.createDataFrame([(1, "e", 0.95, False, 0), (2, "w", 0.5, False, 1), (3, "eu", 0.45, False, 2), (4, "e", 0.1, False, 3)], node)
    spread = placement.Placement("GLOBAL", "REGION_FAILURE", 5, 3)
    assert rows(placement.rebalance(replicas, nodes, spread)) == [(7, 1, 1, 4, 0.8)]
    narrow = spark.createDataFrame([(1, "e", 0.1, False, 0), (2, "w", 0.9, False, 1), (3, "eu", 0.2, False, 2), (4, "e", 0.1, False, 3)], node)
    assert placement.rebalance(replicas, narrow, spread).isEmpty()
    assert placement.rebalance(replicas, nodes.withColumn("draining", F.col("node_id") == 4), spread).isEmpty()


def test_splits_and_replica_changes(spark):
    keys_of = spark.createDataFrame([(1, k) for k in range(66)] + [(2, k) for k in range(10)], "range_id int, key int")
    assert rows(placement.median_keys(keys_of)) == [(1, 66, 33)]
    ranges = spark.createDataFrame([(1, 4, 0, None), (2, 1, 100, 200)], "range_id long, generation int, start_key int, end_key int")
    at = spark.createDataFrame([(1, 33)], "range_id long, split_key int")
    assert rows(placement.split(ranges, at, F.lit(3))) == [(1, 5, 0, 33), (2, 1, 100, 200), (3, 5, 33, None)]
    r = spark.createDataFrame([(1, 1, 1, [(1, 1, "VOTER"), (2, 2, "VOTER")])], "range_id int, generation int, leaseholder int, replicas array<struct<replica_id:int,node_id:int,role:string>>")

    def after(df, op, i, node, role):
        change = F.struct(F.lit(i).alias("replica_id"), F.lit(node).alias("node_id"), F.lit(role).alias("role"))
        return placement.changed_replicas(df.withColumns({"op": F.lit(op), "replica": change, "expected_generation": F.col("generation")})).drop("fault" if df is not r else "none")

    added = after(r, "add", 3, 3, "LEARNER")
    assert added.first()["generation"] == 2 and added.first()["replicas"][2]["role"] == "LEARNER" and added.first()["fault"] is None
    assert after(added.drop("fault"), "promote", 3, 3, "VOTER").first()["replicas"][2]["role"] == "VOTER"
    refused = after(r, "remove", 1, 1, "VOTER").first()
    assert refused["fault"] == "holds the lease" and refused["generation"] == 1 and len(refused["replicas"]) == 2
    assert len(after(r, "remove", 2, 2, "VOTER").first()["replicas"]) == 1
    assert after(r, "promote", 2, 2, "VOTER").first()["fault"] == "not a learner"


def test_admission_and_compaction(spark):
    a = placement.Admission(4, 1, 1)
    assert [a.enter(k) for k in ("background", "background", "background", "normal", "normal", "critical", "critical")] == [True, True, False, True, False, True, False]
    stores = spark.createDataFrame([(0, 0, 0, 0), (8, 0, 0, 0), (20, 0, 0, 0), (0, 0, 0, 1), (0, 0, 64 << 20, 0)], "l0_files int, l0_sublevels int, pending_bytes long, write_stalls int")
    assert [r["priority"] for r in placement.compaction_priority(stores).collect()] == ["background", "normal", "critical", "critical", "normal"]


def test_snapshot_merge(spark):
    schema = "range_id int, generation int, start_key string, end_key string, leaseholder int, row_count int, replicas array<struct<replica_id:int,node_id:int,role:string>>, seen int"
    reports = spark.createDataFrame([(1, 1, "a", "b", 1, 9, [(9, 9, "VOTER")], 0), (1, 2, None, "m", 1, 3, [(1, 1, "VOTER")], 1), (1, 2, "a", None, 1, 5, [(1, 1, "LEARNER"), (2, 2, "VOTER")], 2)], schema)
    r = topology.merged_ranges(reports).first()
    assert (r["generation"], r["start_key"], r["end_key"], r["row_count"]) == (2, "a", "m", 5) and [(x["replica_id"], x["role"]) for x in r["replicas"]] == [(1, "LEARNER"), (2, "VOTER")]
    assert topology.edges(topology.merged_ranges(reports)).count() == 2


def test_log_checks(spark):
    t = datetime.datetime(2024, 1, 1)
    logs = spark.createDataFrame([(1, t, "write_ack token=a"), (1, t, "write_ack token=b range=2"), (2, t, "write_visible token=a"), (2, t, "free text")], "node_id int, ts timestamp, message string")
    marks = assertions.markers(logs)
    assert marks.count() == 3 and rows(assertions.lost_writes(marks)) == [("b",)]
    outcomes = spark.createDataFrame([("t", "COMMITTED"), ("t", "COMMITTED"), ("u", "COMMITTED"), ("u", "ABORTED")], "txn_id string, result string")
    assert rows(assertions.unsettled(outcomes, spark.createDataFrame([("t",), ("u",), ("v",)], "txn_id string"))) == [("u", 2), ("v", 0)]


def test_percentiles_and_buckets(spark):
    ms = spark.createDataFrame([("op", float(k), k != 3) for k in range(10)], "op string, ms double, ok boolean")
    r = workload.summary(ms).first()
    assert (r["n"], r["failed"], r["p50_ms"], r["p95_ms"], r["max_ms"], r["mean_ms"]) == (10, 1, 4.0, 8.0, 9.0, 4.5)
    h = workload.histogram(ms, "ms", [2, 5, 20])
    assert tuple(h.first())[:4] == (3, 6, 10, 10)
    assert h.select(workload.bucket_quantile([2, 5, 20], [F.col("le_0"), F.col("le_1"), F.col("le_2")], 0.5)).first()[0] == 4.0


def test_keys(spark):
    values = [-(2**63), -5, -1, 0, 1, 7, 2**63 - 1]
    df = spark.createDataFrame([(v,) for v in values], "v long").select("v", keys.ordered_int_key(F.col("v")).alias("k"))
    assert [r["v"] for r in df.orderBy("k").collect()] == values
    one = spark.createDataFrame([(bytearray(b"a\x00b"), "hex:6100", "plain")], "b binary, h string, p string")
    r = one.select(keys.escaped_key(F.col("b")), keys.from_lookup(F.col("h")), keys.from_lookup(F.col("p")), keys.event_id(F.col("p"))).first()
    assert r[0] == "6100FF620001" and bytes(r[1]) == b"a\x00" and bytes(r[2]) == b"plain" and r[3].startswith("evt_")


def test_streams_equal_batches(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    events = [(f"e{k % 50}", t + datetime.timedelta(minutes=k % 50), "a" if k % 2 else "b") for k in range(120)]
    df = spark.createDataFrame(events, "id string, ts timestamp, event_type string")
    for n in range(3):
        df.where(f"pmod(hash(id), 3) = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = feeds.event_stream(spark, str(tmp_path / "in"), "id string, ts timestamp, event_type string", 1)
    feeds.run_available(feeds.deduplicated_stream(stream, late="2 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    closed = feeds.closed_timestamps(stream.select(F.lit(1).cast("long").alias("range_id"), F.lit(1).cast("long").alias("lease_seq"), F.minute("ts").cast("long").alias("candidate")))
    q = closed.writeStream.format("memory").queryName("closed").outputMode("update").option("checkpointLocation", str(tmp_path / "closed")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("closed").agg(F.max("closed")).first()[0] == 49


def test_json_sources(spark, tmp_path):
    (tmp_path / "topology.json").write_text(json.dumps({"cluster_id": "c", "nodes": [{"node_id": 1, "region": "a", "zone": "z"}], "ranges": [{"range_id": 1, "generation": 1, "start_key": "", "end_key": None, "leaseholder": 1, "replicas": [{"replica_id": 1, "node_id": 1, "role": "VOTER"}]}]}, indent=1))
    nodes, ranges = documents.topology(spark, str(tmp_path / "topology.json"))
    assert nodes.count() == 1 and topology.edges(ranges).first()["leaseholder"]
    for name, end in (("r1", "2024-01-01T00:00:00"), ("r2", "2024-01-02T00:00:00")):
        (tmp_path / "runs" / name).mkdir(parents=True)
        (tmp_path / "runs" / name / "summary.json").write_text(json.dumps({"run_id": name, "finished_at": end}))
    assert [r["folder"] for r in documents.run_summaries(spark, str(tmp_path / "runs")).collect()] == ["r2", "r1"]
    documents.write_report(spark.range(1), str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_transaction_errors():
    assert [transaction_error(k, "").sqlstate for k in ("retry", "write_too_old", "contention", "aborted", "other")] == ["40001", "40001", "40001", "25P02", "XX000"]
    assert transaction_error("contention", "").retry_after_ms == 25


def test_descriptors_follow_their_commands(spark):
    """Each command is refused or taken by the descriptor as it is by then; a snapshot of an older generation is refused."""
    def d(generation, start="a", end="z", ids=(1, 2, 3), range_id=7):
        return (range_id, generation, start, end, 1, [(i, i, "VOTER") for i in ids])

    none, learner = None, (9, 9, "LEARNER")
    log = [
        (7, 1, "install", 0, d(3), none, none), (7, 2, "update", 2, d(4), none, none), (7, 3, "update", 3, d(4), none, none), (7, 4, "add", 4, none, none, learner), (7, 5, "add", 5, none, none, learner), (7, 6, "promote", 5, none, none, (9, 9, "VOTER")),
        (7, 7, "promote", 6, none, none, (9, 9, "VOTER")), (7, 8, "remove", 6, none, none, (1, 1, "VOTER")), (7, 9, "remove", 6, none, none, (2, 2, "VOTER")), (7, 10, "add", 7, none, none, (4, 3, "LEARNER")),
        (7, 11, "split", 7, d(7, end="m"), d(1, start="m", range_id=8), none), (7, 12, "split", 7, d(8, end="m"), d(1, start="n", range_id=8), none), (7, 13, "split", 7, d(8, end="m"), d(1, start="m", range_id=8), none),
        (7, 14, "install", 0, d(5), none, none), (7, 15, "install", 0, d(9, ids=(1,)), none, none), (8, 1, "remove", 0, none, none, (1, 1, "VOTER")), (7, 16, "remove", 9, none, none, (2, 2, "VOTER")),
    ]
    replica = "struct<replica_id:int,node_id:int,role:string>"
    descriptor = f"struct<range_id:long,generation:long,start_key:string,end_key:string,leaseholder:int,replicas:array<{replica}>>"
    random.seed(2)
    random.shuffle(log)
    df = spark.createDataFrame(log, f"range_id long, log_index long, op string, expected_generation long, descriptor {descriptor}, other {descriptor}, replica {replica}").repartition(3)
    got = {(r["range_id"], r["log_index"]): (r["fault"], r["generation"], r["end_key"], r["replicas"]) for r in replica_log.descriptor_steps(df).collect()}
    assert got == {
        (7, 1): (None, 3, "z", 3), (7, 2): ("expected generation", 3, "z", 3), (7, 3): (None, 4, "z", 3), (7, 4): (None, 5, "z", 4), (7, 5): ("exists already", 5, "z", 4), (7, 6): (None, 6, "z", 4), (7, 7): ("not a learner", 6, "z", 4),
        (7, 8): ("holds the lease", 6, "z", 4), (7, 9): (None, 7, "z", 3), (7, 10): ("two on a node", 7, "z", 3), (7, 11): ("generation does not rise", 7, "z", 3), (7, 12): ("halves do not meet", 7, "z", 3), (7, 13): (None, 8, "m", 3),
        (7, 14): ("stale", 8, "m", 3), (7, 15): (None, 9, "z", 1), (8, 1): ("no range", None, None, 0), (7, 16): ("not found", 9, "z", 1)}
