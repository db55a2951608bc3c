"""Named queries over the test tables, each with DuckDB SQL that must give the same rows.

customer stands for a users table, orders for orders, events for a version log (key user_id,
order ts and event_id, tombstone where event_type is error), an event feed and latency samples;
ranges are spans of a hundred keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyspan.functions import hlc, keys
from keyspan.operators import assertions, dml, mvcc, placement, relational, timeline, topology, transactions, workload
from keyspan.streaming import feeds, replica_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function of Tables under its name, with its SQL."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return relational.equi_join(t.customer, t.orders, ("c_custkey", "o_custkey"), {"o_orderkey": ("r", "o_orderkey"), "c_name": ("l", "c_name"), "o_totalprice": ("r", "o_totalprice")}).orderBy("o_orderkey")


ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderpriority"]


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


# Scans, filters, order


@query("select o_orderkey, o_custkey, o_orderpriority from orders where o_orderkey = 7")
def point_lookup(t):
    return relational.point_lookup(t.orders, "o_orderkey", 7).select(*ORDER_COLUMNS)


@query("select k as o_orderkey, (select count(*) from orders where o_orderkey = k) as n from (values (-1), (7)) as w(k)")
def point_lookup_miss(t):
    """How many rows two lookups find, one of a key that is not there."""
    return relational.point_lookup(t.orders, "o_orderkey", -1).agg(F.lit(-1).alias("o_orderkey"), F.count("*").alias("n")).union(relational.point_lookup(t.orders, "o_orderkey", 7).agg(F.lit(7), F.count("*")))


@query("select o_orderkey, o_custkey, o_orderpriority from orders where o_orderkey >= 100 and o_orderkey < 200")
def range_scan_half_open(t):
    return relational.range_scan(t.orders, "o_orderkey", 100, 200).select(*ORDER_COLUMNS)


@query("select o_orderkey, o_custkey, o_orderpriority from orders where o_orderkey between 100 and 200")
def range_scan_closed(t):
    return relational.range_scan(t.orders, "o_orderkey", 100, 200, high_closed=True).select(*ORDER_COLUMNS)


@query("select o_orderkey, o_custkey, o_orderpriority from orders where o_orderkey > 100")
def range_scan_open_ended(t):
    return relational.range_scan(t.orders, "o_orderkey", 100, low_closed=False).select(*ORDER_COLUMNS)


@query("select c_custkey, c_name, c_mktsegment from customer")
def full_scan_projection(t):
    return t.customer.select("c_custkey", "c_name", "c_mktsegment")


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority >= '3'")
def filtered_scan_string_ge(t):
    return t.orders.where(relational.conjunction([(F.col("o_orderpriority"), ">=", "3")])).select("o_orderkey", "o_orderpriority")


@query("select o_orderkey, o_orderstatus, o_orderpriority from orders where o_orderkey >= 50 and 5000 > o_orderkey and o_orderstatus = 'O' and o_orderpriority <= '3'")
def filtered_scan_conjunction(t):
    tests = [(F.col("o_orderkey"), ">=", 50), (5000, ">", F.col("o_orderkey")), (F.col("o_orderstatus"), "=", "O"), (F.col("o_orderpriority"), "<=", "3")]
    return t.orders.where(relational.conjunction(tests)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("select o_orderkey, o_orderpriority, o_custkey from orders order by o_orderpriority desc nulls last, o_custkey nulls first, o_orderkey limit 20")
def order_by_multi_desc_limit(t):
    return relational.ordered(t.orders.select("o_orderkey", "o_orderpriority", "o_custkey"), "o_orderkey", [("o_orderpriority", True), ("o_custkey", False)], 20)


@query("select c_custkey, c_name from customer order by c_custkey limit 10")
def limit_pk_order(t):
    return relational.ordered(t.customer.select("c_custkey", "c_name"), "c_custkey", limit=10)


@query("select o_orderkey, o_custkey from orders where o_orderkey >= 777 order by o_orderkey limit 1")
def seek_at_least(t):
    return mvcc.seek(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey", 777)


@query("select cast(c_custkey as varchar) as key_text, c_name, case when c_acctbal < 0 then null else c_mktsegment end as segment from customer")
def projection_as_text(t):
    return t.customer.select(F.col("c_custkey").cast("string").alias("key_text"), "c_name", F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("segment"))


@query("select c_custkey, c_name from customer where encode(c_name) >= from_hex('437573746F6D657223303030303030353030')")
def bytes_literal_filter(t):
    return t.customer.where(F.encode("c_name", "UTF-8") >= F.unhex(F.lit("437573746F6D657223303030303030353030"))).select("c_custkey", "c_name")


# Aggregates


@query("select count(*) as n from orders")
def count_star_global(t):
    return relational.aggregate(t.orders, [], {"n": ("count", None)})


@query("select count(*) as n, count(nullif(o_orderpriority, '1-URGENT')) as n_set, count(nullif(o_orderstatus, 'O')) as n_closed from orders")
def count_col_nulls(t):
    rows = t.orders.select(F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"), F.nullif("o_orderstatus", F.lit("O")).alias("s"))
    return relational.aggregate(rows, [], {"n": ("count", None), "n_set": ("count", "p"), "n_closed": ("count", "s")})


@query("select cast(sum(o_custkey) as bigint) as total from orders")
def sum_int_global(t):
    return relational.aggregate(t.orders, [], {"total": ("sum", "o_custkey")})


@query("select cast(sum(o_custkey) as bigint) as total, count(*) as n from orders where o_orderkey < 0")
def sum_empty_is_null(t):
    return relational.aggregate(t.orders.where("o_orderkey < 0"), [], {"total": ("sum", "o_custkey"), "n": ("count", None)})


@query("select o_orderpriority, count(*) as n from orders group by o_orderpriority")
def group_by_count(t):
    return relational.aggregate(t.orders, ["o_orderpriority"], {"n": ("count", None)})


@query("select o_orderpriority, cast(sum(cast(round(o_totalprice * 100) as bigint)) as bigint) as cents from orders group by o_orderpriority")
def group_by_sum(t):
    return relational.aggregate(t.orders.withColumn("c", cents("o_totalprice")), ["o_orderpriority"], {"cents": ("sum", "c")})


@query("select l_returnflag, l_linestatus, count(*) as n, cast(sum(l_linenumber) as bigint) as lines from lineitem group by l_returnflag, l_linestatus")
def group_by_multi(t):
    return relational.aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], {"n": ("count", None), "lines": ("sum", "l_linenumber")})


@query("select nullif(o_orderstatus, 'O') as status, count(*) as n from orders group by 1")
def group_by_null_key(t):
    return relational.aggregate(t.orders.withColumn("status", F.nullif("o_orderstatus", F.lit("O"))), ["status"], {"n": ("count", None)})


@query("select distinct o_orderstatus, o_orderpriority from orders")
def group_by_distinct_like(t):
    return relational.aggregate(t.orders, ["o_orderstatus", "o_orderpriority"], {})


@query("select o_orderpriority, count(*) as n from orders where o_orderkey >= 100 and o_orderkey < 1000 group by o_orderpriority")
def aggregate_over_pk_range(t):
    return relational.aggregate(relational.range_scan(t.orders, "o_orderkey", 100, 1000), ["o_orderpriority"], {"n": ("count", None)})


# Joins


@query("select o_orderkey, c_name from customer join orders on c_custkey = o_custkey")
def join_on_equi(t):
    return relational.equi_join(t.customer, t.orders, ("c_custkey", "o_custkey"), {"o_orderkey": ("r", "o_orderkey"), "c_name": ("l", "c_name")})


@query("select c_custkey, c_name, n_name from customer join (select n_nationkey as c_nationkey, n_name from nation) using (c_nationkey)")
def join_using(t):
    nation = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    return relational.equi_join(t.customer, nation, "c_nationkey", {"c_custkey": ("l", "c_custkey"), "c_name": ("l", "c_name"), "n_name": ("r", "n_name")})


@query("select a.n_nationkey as left_key, b.n_nationkey as right_key from nation a join nation b on a.n_regionkey = b.n_regionkey")
def self_join_alias(t):
    return relational.equi_join(t.nation, t.nation, "n_regionkey", {"left_key": ("l", "n_nationkey"), "right_key": ("r", "n_nationkey")})


@query("select o_orderkey, c_name from (select o_orderkey, nullif(o_custkey, 7) as k from orders) join (select c_name, nullif(c_custkey, 7) as k from customer) using (k)")
def join_null_keys(t):
    orders = t.orders.select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("k"))
    customer = t.customer.select("c_name", F.nullif("c_custkey", F.lit(7)).alias("k"))
    return relational.equi_join(orders, customer, "k", {"o_orderkey": ("l", "o_orderkey"), "c_name": ("r", "c_name")})


@query("select s_name as supplier, n_name as country from supplier join nation on s_nationkey = n_nationkey")
def join_projection_alias(t):
    return relational.equi_join(t.supplier, t.nation, ("s_nationkey", "n_nationkey"), {"supplier": ("l", "s_name"), "country": ("r", "n_name")})


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderpriority = '1-URGENT')")
def required_minus_observed(t):
    return relational.missing_from(t.customer.select("c_custkey"), t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


# Indexes and constraints


@query("select c_name, c_custkey from customer")
def index_view_unique(t):
    return dml.index_view(t.customer, ["c_name"], ["c_custkey"])


@query("select seg, c_custkey from (select nullif(c_mktsegment, 'BUILDING') as seg, c_custkey from customer) where seg is not null")
def index_view_nonunique(t):
    return dml.index_view(t.customer.select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("seg"), "c_custkey"), ["seg"], ["c_custkey"])


@query("""with added as (select c_custkey + 5 as k, c_name as name from customer where c_custkey % 3 = 0 union all select c_custkey + 2000000, 'twin-' || (c_custkey // 4) from customer where c_custkey % 2 = 0),
      replaced as (select k from added where k % 2 = 0)
    select distinct a.name as c_name from added a join added b on a.name = b.name and a.k <> b.k
    union select a.name from added a join customer c on a.name = c.c_name and a.k <> c.c_custkey where c.c_custkey not in (select k from replaced)""")
def unique_violations(t):
    """Names that added rows share with each other or with customers of another key that no added row replaces."""
    k = F.col("c_custkey")
    added = t.customer.where(k % 3 == 0).select((k + 5).alias("c_custkey"), "c_name").union(t.customer.where(k % 2 == 0).select(k + 2_000_000, F.concat(F.lit("twin-"), F.floor(k / 4).cast("string"))))
    return dml.violations(added, t.customer, ["c_custkey"], ["c_name"], replaced=added.where(k % 2 == 0))


@query("""select segment, c_custkey, 'del' as op from (select c_mktsegment as segment, c_custkey from customer) where c_custkey < 50 and segment <> 'MACHINERY'
    union all select 'MACHINERY', c_custkey, 'put' from customer where c_custkey < 50 and c_mktsegment <> 'MACHINERY'""")
def index_changes(t):
    before = t.customer.select(F.col("c_mktsegment").alias("segment"), "c_custkey")
    after = before.withColumn("segment", F.when(F.col("c_custkey") < 50, "MACHINERY").otherwise(F.col("segment")))
    return dml.index_changes(before, after, ["segment"], ["c_custkey"])


@query("select c_custkey, c_name from customer where c_name in (select 'Customer#' || lpad(cast(range * 7 as varchar), 9, '0') from range(100))")
def index_lookup(t):
    wanted = t._spark.range(100).select(F.concat(F.lit("Customer#"), F.lpad((F.col("id") * 7).cast("string"), 9, "0")).alias("c_name"))
    return dml.index_lookup(wanted, t.customer.select("c_custkey", "c_name"), ["c_name"])


# Versions

VERSIONS = "(select user_id, ts, event_id, event_type, event_type = 'error' as tombstone from events)"
NEWEST = "select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from"


def versions(t) -> DataFrame:
    return t.events.select("user_id", "ts", "event_id", "event_type", (F.col("event_type") == "error").alias("tombstone"))


@query(f"select user_id, ts, event_id, event_type, tombstone from ({NEWEST} {VERSIONS}) where rn = 1 and not tombstone")
def mvcc_latest(t):
    return mvcc.latest(versions(t), ["user_id"], ["ts", "event_id"])


@query(f"select user_id, ts, event_id, event_type, tombstone from ({NEWEST} {VERSIONS} where ts <= timestamp '2024-01-15 00:00:00') where rn = 1 and not tombstone")
def mvcc_as_of(t):
    return mvcc.latest(versions(t).where(F.col("ts") <= F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")), ["user_id"], ["ts", "event_id"])


@query("""select w.user_id, w.event_id, case when bool_or(e.event_type = 'error') is null then 'missing' when bool_or(e.event_type = 'error') then 'deleted' else 'live' end as status
    from (select user_id, event_id from events where event_id % 3 = 0 union all select user_id, -event_id - 1 from events where event_id % 3 = 1) w
    left join events e on e.user_id = w.user_id and e.event_id = w.event_id group by 1, 2""")
def mvcc_exact_status(t):
    e = t.events
    wanted = e.where("event_id % 3 = 0").select("user_id", "event_id").union(e.where("event_id % 3 = 1").select("user_id", -F.col("event_id") - 1))
    return mvcc.exact(versions(t), wanted, ["user_id"], ["event_id"])


@query("select user_id, count(*) as versions, count(*) filter (where event_type = 'error') as tombstones from events group by user_id")
def mvcc_version_count(t):
    return mvcc.version_counts(versions(t), ["user_id"])


@query("""select c_custkey, c_mktsegment from customer where c_custkey % 10 <> 3
    union all select c_custkey, 'PENDING' from customer where c_custkey % 20 = 3""")
def read_your_writes_overlay(t):
    base = t.customer.select("c_custkey", "c_mktsegment")
    pending = base.where("c_custkey % 10 = 3").select("c_custkey", F.lit("PENDING").alias("c_mktsegment"), (F.col("c_custkey") % 20 != 3).alias("tombstone"))
    return mvcc.overlay(base, pending, ["c_custkey"])


HISTORICAL = """(select e.event_id as read_id, e.user_id, e.event_id - case when e.event_id % 4 = 0 then 1 else 0 end as want, e.event_id % 3 as known, c.lease_seq, c.closed
    from events e left join (select user_id % 20 as range_id, 1 as lease_seq, max(event_id) - 500 as closed from events where user_id % 20 <> 7 group by 1) c on c.range_id = e.user_id % 20)"""


@query(f"""select read_id, gate, case when gate <> 'ok' then null when v.event_type is null then 'missing' when v.event_type = 'error' then 'deleted' else 'live' end as status
    from (select *, case when closed is null then 'no_closed' when known <> lease_seq then 'lease_mismatch' when want > closed then 'too_fresh' else 'ok' end as gate from {HISTORICAL}) r
    left join events v on v.user_id = r.user_id and v.event_id = r.want""")
def follower_historical_read(t):
    """Exact versions at followers, gated by each range's lease sequence and closed time; range 7 has published none."""
    e, i = t.events, F.col("event_id")
    closed = e.where("user_id % 20 <> 7").groupBy((F.col("user_id") % 20).alias("range_id")).agg(F.lit(1).alias("lease_seq"), (F.max("event_id") - 500).alias("closed"))
    wanted = e.select(i.alias("read_id"), (F.col("user_id") % 20).alias("range_id"), "user_id", (i - (i % 4 == 0).cast("int")).alias("event_id"), (i % 3).alias("known_sequence"))
    return mvcc.gated_read(versions(t), wanted, closed, ["user_id"], "event_id").select("read_id", "gate", "status")


@query("""with w as (select user_id, event_id - case when event_id % 4 = 0 then 1 else 0 end as event_id from events where event_id % 5 = 0)
    select w.user_id, w.event_id, case when e.event_id is null then 'missing' when e.event_type = 'error' then 'deleted' else 'live' end as status from w left join events e on e.user_id = w.user_id and e.event_id = w.event_id""")
def mvcc_point_get(t):
    """Exact versions of a few keys: the log is reduced to the wanted keys before it is looked at."""
    wanted = t.events.where("event_id % 5 = 0").select("user_id", (F.col("event_id") - (F.col("event_id") % 4 == 0).cast("int")).alias("event_id"))
    return mvcc.exact(versions(t), wanted, ["user_id"], ["event_id"])


# Changes


def users(t) -> DataFrame:
    return t.customer.select("c_custkey", "c_name", "c_mktsegment")


def newcomers(t) -> DataFrame:
    """Half of them have the name of a customer, all have keys of their own."""
    return t.customer.where("c_custkey < 200").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.concat(F.lit("new-"), F.col("c_name"))).alias("c_name"), F.lit("NEW").alias("c_mktsegment"))


NEW = "(select c_custkey + 1000000 as c_custkey, case when c_custkey % 2 = 0 then c_name else 'new-' || c_name end as c_name, 'NEW' as c_mktsegment from customer where c_custkey < 200)"


@query("select c_custkey, c_name from (select c_custkey - 100 as c_custkey, c_name from customer where c_custkey < 150) where c_custkey in (select c_custkey from customer)")
def insert_dup_check(t):
    new = t.customer.where("c_custkey < 150").select((F.col("c_custkey") - 100).alias("c_custkey"), "c_name")
    return dml.collisions(new, t.customer, ["c_custkey"])


@query(f"select c_custkey, c_name, c_mktsegment, false as tombstone from {NEW}")
def insert_versions(t):
    return dml.insert(users(t), newcomers(t), ["c_custkey"]).versions


@query("""select c_custkey, c_name, c_mktsegment from customer where c_custkey >= 100
    union all select c_custkey, 'up-' || c_name, null from customer where c_custkey < 100""")
def upsert_result(t):
    new = t.customer.where("c_custkey < 100").select("c_custkey", F.concat(F.lit("up-"), F.col("c_name")).alias("c_name"))
    return mvcc.overlay(users(t), dml.upsert(users(t), new, ["c_custkey"]).versions, ["c_custkey"])


@query(f"select * from {NEW} n where not exists (select 1 from customer c where c.c_name = n.c_name)")
def on_conflict_do_nothing(t):
    return dml.on_conflict_do_nothing(users(t), newcomers(t), ["c_name"], ["c_custkey"]).returning


@query(f"""select c.c_custkey, c.c_name, n.c_mktsegment from customer c join {NEW} n on c.c_name = n.c_name
    union all select * from {NEW} n where not exists (select 1 from customer c where c.c_name = n.c_name)""")
def on_conflict_do_update_excluded(t):
    return dml.on_conflict_do_update(users(t), newcomers(t), ["c_name"], ["c_custkey"], {"c_mktsegment": "excluded.c_mktsegment"}).returning


@query("select c_custkey, c_name, 'X' as c_mktsegment from customer where c_custkey = 42")
def update_returning(t):
    return dml.update(users(t), F.col("c_custkey") == 42, {"c_mktsegment": "X"}, ["c_custkey"]).returning


@query("select c_custkey, c_name, case when c_custkey >= 10 and c_custkey < 60 then 'X' else c_mktsegment end as c_mktsegment from customer")
def update_range_postimage(t):
    change = dml.update(users(t), (F.col("c_custkey") >= 10) & (F.col("c_custkey") < 60), {"c_mktsegment": "X"}, ["c_custkey"])
    return mvcc.overlay(users(t), change.versions, ["c_custkey"])


@query("select c_custkey, c_name, c_mktsegment from customer where c_custkey >= 10 and c_custkey < 60")
def delete_returning(t):
    return dml.delete(users(t), (F.col("c_custkey") >= 10) & (F.col("c_custkey") < 60)).returning


@query("select c_custkey, c_name, c_mktsegment from customer where c_custkey < 10 or c_custkey >= 60")
def delete_postimage(t):
    return mvcc.overlay(users(t), dml.delete(users(t), (F.col("c_custkey") >= 10) & (F.col("c_custkey") < 60)).versions, ["c_custkey"])


# Transactions: each user is a transaction; purchases are what it must have written, other events what is seen


def required(t) -> DataFrame:
    return t.events.where("event_type in ('purchase', 'click')").select(F.col("user_id").cast("string").alias("txn_id"), (F.col("event_id") % 10).alias("range_id"), F.col("event_id").cast("string").alias("key"), F.lit("EXCLUSIVE").alias("strength"), F.lit(1).alias("epoch"))


def observed(t) -> DataFrame:
    return t.events.where("event_id % 50 <> 0").select(
        F.col("user_id").cast("string").alias("txn_id"), (F.col("event_id") % 10).alias("range_id"), F.col("event_id").cast("string").alias("key"), F.col("user_id").cast("string").alias("intent_txn"),
        F.lit(1).alias("epoch"), F.lit("EXCLUSIVE").alias("strength"), F.lit(True).alias("present"), (F.col("event_id") % 77 == 0).alias("contested"))


OUTCOMES = """(select cast(user_id as varchar) as txn_id, count(*) as required, count(*) filter (where event_id % 50 = 0) as missing,
    count(*) filter (where event_id % 50 <> 0 and event_id % 77 = 0) as contended,
    case when count(*) filter (where event_id % 50 = 0 or event_id % 77 = 0) = 0 then 'COMMITTED' else 'ABORTED' end as status
    from events where event_type in ('purchase', 'click') group by user_id)"""


@query(f"""select o.*, coalesce(missing_keys, '') as missing_keys, coalesce(contended_keys, '') as contended_keys from {OUTCOMES} o left join (
      select cast(user_id as varchar) as txn_id, string_agg(cast(event_id as varchar), ',' order by cast(event_id as varchar)) filter (where event_id % 50 = 0) as missing_keys,
        string_agg(cast(event_id as varchar), ',' order by cast(event_id as varchar)) filter (where event_id % 50 <> 0 and event_id % 77 = 0) as contended_keys
      from events where event_type in ('purchase', 'click') group by 1) k using (txn_id)""")
def staging_recovery(t):
    found = transactions.staging_recovery(required(t), observed(t))
    return found.withColumns({c: F.array_join(c, ",") for c in ("missing_keys", "contended_keys")})


@query(f"""select txn_id, event_id % 10 as range_id, cast(event_id as varchar) as key, case when status = 'COMMITTED' then 'commit' else 'abort' end as action
    from events join {OUTCOMES} o on cast(user_id as varchar) = txn_id where event_type in ('purchase', 'click')""")
def resolve_actions(t):
    return transactions.resolve_actions(transactions.staging_recovery(required(t), observed(t)), required(t))


def records(t) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, ("PENDING", "STAGING", "COMMITTED", "ABORTED"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return t.customer.select(F.col("c_custkey").cast("string").alias("txn_id"), status.alias("status"), (F.col("c_custkey") * 3 % 100).alias("deadline"), (F.col("c_custkey") % 2).alias("epoch"), (F.col("c_custkey") + 1000).alias("commit_ts"), F.col("c_custkey").alias("read_ts"), (F.col("c_custkey") + 5).alias("write_ts"), (F.col("c_custkey") * 7 % 300).alias("min_commit_ts"))


RECORDS = "(select cast(c_custkey as varchar) as txn_id, ['PENDING', 'STAGING', 'COMMITTED', 'ABORTED'][c_custkey % 4 + 1] as status, c_custkey * 3 % 100 as deadline, c_custkey % 2 as epoch, c_custkey + 1000 as commit_ts, c_custkey + 5 as write_ts, c_custkey * 7 % 300 as min_commit_ts from customer)"


@query(f"""select r.txn_id, r.status, coalesce(i.n, 0) as intents,
    case when r.status = 'PENDING' and deadline < 50 then 'abort' when r.status = 'STAGING' and o.status = 'COMMITTED' then 'commit' when r.status = 'STAGING' then 'abort'
      when r.status in ('COMMITTED', 'ABORTED') and coalesce(i.n, 0) > 0 then 'resolve' else 'none' end as action
    from {RECORDS} r left join (select cast(user_id as varchar) as txn_id, count(*) as n from events where event_type = 'signup' group by 1) i using (txn_id) left join {OUTCOMES} o using (txn_id)""")
def txn_sweep(t):
    intents = t.events.where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("txn_id"))
    return transactions.sweep(records(t), intents, transactions.staging_recovery(required(t), observed(t)), F.lit(50))


@query(f"""select cast(event_id as varchar) as key, commit_ts as ts, event_type = 'error' as tombstone, props as value
    from events join {RECORDS} r on cast(user_id as varchar) = txn_id where status = 'COMMITTED' and event_id % 2 = epoch""")
def intent_resolution(t):
    intents = t.events.select(F.col("user_id").cast("string").alias("txn_id"), F.col("event_id").cast("string").alias("key"), (F.col("event_id") % 2).alias("epoch"), (F.col("event_type") == "error").alias("tombstone"), F.col("props").alias("value"))
    return transactions.resolve(intents, records(t))


@query(f"""select cast(user_id as varchar) as txn_id, cast(event_id as varchar) as key, event_id % 3 as epoch, a as action, a <> 'keep' as release from (
    select user_id, event_id, case when r.status is null then 'keep' when event_id % 3 < epoch then 'drop' when r.status = 'COMMITTED' then 'apply' when r.status = 'ABORTED' then 'drop' else 'keep' end as a
    from events left join {RECORDS} r on cast(user_id as varchar) = txn_id)""")
def intent_cleanup(t):
    intents = t.events.select(F.col("user_id").cast("string").alias("txn_id"), F.col("event_id").cast("string").alias("key"), (F.col("event_id") % 3).alias("epoch"))
    return transactions.cleanups(intents, records(t))


def lock_requests(t) -> DataFrame:
    return t.events.select(
        F.floor(F.col("event_id") / 40).alias("key"), F.col("user_id").alias("txn_id"), F.col("ts").alias("read_ts"), F.when(F.col("event_type") == "view", "SHARED").otherwise("EXCLUSIVE").alias("strength"), (F.col("event_type") == "purchase").alias("held"))


LOCKS = "(select event_id // 40 as key, user_id as txn_id, ts as read_ts, case when event_type = 'view' then 'SHARED' else 'EXCLUSIVE' end as strength, event_type = 'purchase' as held from events)"
PAIRS = f"(select h.key, h.txn_id as holder, h.read_ts as holder_ts, a.txn_id as asker, a.read_ts as asker_ts from {LOCKS} h join {LOCKS} a on h.key = a.key and h.held and not a.held and h.txn_id <> a.txn_id and not (h.strength = 'SHARED' and a.strength = 'SHARED'))"


@query(f"select key, holder, asker from {PAIRS}")
def lock_conflict_pairs(t):
    return transactions.conflicts(lock_requests(t)).select("key", "holder", "asker")


@query(f"""select a.key, a.asker, coalesce(n, 0) as blockers, case when n is null then 'granted' when oldest then 'wound' else 'wait' end as decision
    from (select distinct key, txn_id as asker from {LOCKS} where not held) a
    left join (select key, asker, count(*) as n, bool_and((asker_ts, asker) < (holder_ts, holder)) as oldest from {PAIRS} group by 1, 2) p on a.key = p.key and a.asker = p.asker""")
def wound_wait_decision(t):
    return transactions.wound_wait(lock_requests(t))


@query()
def lock_table_fold(t):
    log = t.events.select(F.floor(F.col("event_id") / 40).cast("string").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "release").otherwise("acquire").alias("op"), F.col("user_id").cast("string").alias("txn_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("read_ts"), F.lit(0).alias("epoch"), F.when(F.col("event_type") == "view", "SHARED").otherwise("EXCLUSIVE").alias("strength"))
    return transactions.lock_table(log)


@query("""select cast(c_custkey as varchar) as txn_id from customer where exists (
    select 1 from (select o_orderkey as key, o_custkey as commit_ts from orders) w
    where w.key >= c_custkey and w.key < c_custkey + 5 and w.commit_ts > c_custkey and w.commit_ts <= c_custkey + 40)""")
def refresh_conflicts(t):
    spans = t.customer.select(F.col("c_custkey").cast("string").alias("txn_id"), F.col("c_custkey").alias("start"), (F.col("c_custkey") + 5).alias("end"), F.col("c_custkey").alias("read_ts"), (F.col("c_custkey") + 40).alias("refresh_ts"))
    writes = t.orders.select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("commit_ts"))
    return transactions.refresh_conflicts(spans, writes, bin_width=64)


@query(f"""select txn_id, coalesce(n, 0) as ranges, status = 'PENDING' and coalesce(n, 0) = 1 as eligible, greatest(write_ts, min_commit_ts) as commit_ts
    from {RECORDS} left join (select cast(user_id as varchar) as txn_id, count(distinct event_id % 3) as n from events where event_type = 'signup' group by 1) using (txn_id)""")
def one_phase_eligibility(t):
    writes = t.events.where("event_type = 'signup'").select(F.col("user_id").cast("string").alias("txn_id"), (F.col("event_id") % 3).alias("range_id"))
    return transactions.one_phase(writes, records(t))


@query("select event_id % 25 as range_id, min(event_id * 7 % 1009) as oldest from events group by 1")
def oldest_intent(t):
    return transactions.oldest_intent(t.events.select((F.col("event_id") % 25).alias("range_id"), (F.col("event_id") * 7 % 1009).alias("write_ts")))


# Time


@query("""with c as (
      select user_id as range_id, event_id % 2 as lease_seq, event_id as step, event_id % 13 = 0 as bad,
        least(event_id * 10, case when event_id * 10 + 3 <= 5 then 0 else event_id * 10 + 3 - 5 end, case when event_type = 'error' then case when event_id > 45 then event_id * 10 - 400 else event_id * 10 + 2 end - 1 end) as wall
      from events),
    d as (select *, case when not bad and wall > 0 then wall end as c from c),
    e as (select *, max(c) over w as closed, max(c) over (partition by range_id, lease_seq order by step rows between unbounded preceding and 1 preceding) as before from d
      window w as (partition by range_id, lease_seq order by step))
    select range_id, lease_seq, step, coalesce(closed, 0) as closed_wall, c is not null and (before is null or c > before) as published from e""")
def closed_timestamp_publish(t):
    zero = F.lit(0).cast("long")
    early = F.when(F.col("event_id") > 45, F.col("event_id") * 10 - 400).otherwise(F.col("event_id") * 10 + 2)
    inputs = t.events.select(
        F.col("user_id").alias("range_id"), (F.col("event_id") % 2).alias("lease_seq"), F.col("event_id").alias("step"), hlc.stamp(F.col("event_id") * 10, zero).alias("applied"), hlc.stamp(F.col("event_id") * 10 + 3, zero).alias("now"),
        F.lit(5).cast("long").alias("max_offset"), F.when(F.col("event_type") == "error", hlc.stamp(early, zero)).alias("oldest_intent"), (F.col("event_id") % 13 == 0).alias("clock_bad"))
    return timeline.published(inputs).select("range_id", "lease_seq", "step", F.coalesce("closed.wall", F.lit(0).cast("long")).alias("closed_wall"), "published")


READS = """(select event_id as read_id, event_id % 3 as local_replica, event_id % 5 as leaseholder, 'r' || (event_id % 4) as local_region, 'r' || (event_id % 3) as leaseholder_region,
    event_id % 7 as known_sequence, event_id % 2 * (event_id % 7) as lease_seq, event_id % 100 as applied, event_id * 13 % 110 as read_ts, case when event_id % 9 <> 0 then event_id % 90 end as closed from events)"""
GATE = "case when closed is null then 'no_closed' when known_sequence <> lease_seq then 'lease_mismatch' when applied < closed then 'not_applied' when read_ts > closed then 'too_fresh' else 'ok' end"


def reads(t) -> DataFrame:
    i = F.col("event_id")
    return t.events.select(
        i.alias("read_id"), (i % 3).alias("local_replica"), (i % 5).alias("leaseholder"), F.concat(F.lit("r"), (i % 4).cast("string")).alias("local_region"), F.concat(F.lit("r"), (i % 3).cast("string")).alias("leaseholder_region"), F.array(F.lit("r0"), F.lit("r3")).alias("preferred"),
        (i % 7).alias("known_sequence"), (i % 2 * (i % 7)).alias("lease_seq"), (i % 100).alias("applied"), (i * 13 % 110).alias("read_ts"), F.when(i % 9 != 0, i % 90).alias("closed"))


@query(f"select read_id, {GATE} as gate from {READS}")
def follower_read_gate(t):
    gate = F.when(F.col("closed").isNull(), "no_closed").otherwise(timeline.follower_gate(F.col("known_sequence"), F.col("lease_seq"), F.col("applied"), F.col("read_ts"), F.col("closed")))
    return reads(t).select("read_id", gate.alias("gate"))


@query(f"""select read_id, gate, case when f then 'follower' when local_replica = leaseholder then 'local_leaseholder' else 'leaseholder' end as mode, case when f then local_replica else leaseholder end as target,
      case when f then local_region else leaseholder_region end as target_region,
      case when gate in ('no_closed', 'ok') or read_ts <= b then 0 else read_ts - b end as gap_wall,
      case when gate in ('no_closed', 'ok') or read_ts <> b or read_id % 5 <= 2 then 0 else read_id % 5 - 2 end as gap_logical,
      case when f and placed and local_in then 'safe, in a preferred region' when f then 'safe' when gate = 'ok' then 'safe, but placement prefers the leaseholder''s region'
        when local_replica = leaseholder and placed and holder_in then 'local leaseholder in a preferred region' when local_replica = leaseholder then 'local leaseholder'
        when gate = 'lease_mismatch' then 'closed under another lease' when gate = 'not_applied' then 'closed time not applied here'
        when placed and holder_in then 'not safe yet, to the preferred leaseholder' else 'not safe yet' end as reason
    from (select *, gate = 'ok' and not (placed and local_region <> leaseholder_region and holder_in and not local_in) as f from (
      select *, least(closed, applied) as b, read_id % 6 <> 0 as placed, read_id % 6 <> 0 and leaseholder_region in ('r0', 'r3') as holder_in, read_id % 6 <> 0 and local_region in ('r0', 'r3') as local_in,
        case when closed is null then 'no_closed' when known_sequence <> lease_seq then 'lease_mismatch' when applied < closed then 'not_applied' when read_ts > closed or (read_ts = closed and read_id % 5 > 2) then 'too_fresh' else 'ok' end as gate from {READS}))""")
def read_routing(t):
    """Reads with hybrid times: the read's logical part is read_id % 5, closed and applied ones have 2."""
    i, two = F.col("read_id"), F.lit(2)
    rows = reads(t).withColumn("preferred", F.when(i % 6 != 0, F.col("preferred")))
    rows = rows.withColumns({"read_ts": hlc.stamp(F.col("read_ts"), i % 5), "applied": hlc.stamp(F.col("applied"), two), "closed": F.when(F.col("closed").isNotNull(), hlc.stamp(F.col("closed"), two))})
    return timeline.routed(rows)


@query("select user_id as range_id, event_id as log_index, event_id * 31 % 997 as commit_ts, max(event_id * 31 % 997) over (partition by user_id order by event_id) as frontier from events")
def safe_read_frontier(t):
    return timeline.safe_frontier(t.events.select(F.col("user_id").alias("range_id"), F.col("event_id").alias("log_index"), (F.col("event_id") * 31 % 997).alias("commit_ts")))


@query("select event_id, not clock_bad and r = h and s = 1 and now_ >= 10 and now_ < 60 and rd <= 40 as fast from (select event_id, event_id % 11 = 0 as clock_bad, event_id % 3 as r, 1 as h, event_id % 2 as s, event_id % 70 as now_, event_id % 45 as rd from events)")
def lease_fast_read(t):
    i, one = F.col("event_id"), F.lit(1)
    r = t.events.select(i, (i % 11 == 0).alias("clock_bad"), (i % 3).alias("replica_id"), one.alias("holder"), (i % 2).alias("applied_seq"), one.alias("lease_seq"), one.alias("epoch"), one.alias("holder_epoch"), (i % 70).alias("now"), F.lit(10).alias("start_ts"), F.lit(60).alias("expiration_ts"), (i % 45).alias("read_ts"), F.lit(40).alias("frontier"))
    return timeline.fast_read(r).select("event_id", "fast")


@query("select c_custkey as range_id, c_custkey % 5 + 1 as holder, greatest(c_custkey, 700) as start_ts, 900 as expiration_ts, 3 as lease_seq from customer")
def lease_transfer(t):
    leases = t.customer.select(F.col("c_custkey").alias("range_id"), F.lit(1).cast("long").alias("holder"), F.lit(1).alias("holder_epoch"), F.col("c_custkey").alias("start_ts"), F.lit(800).alias("expiration_ts"), F.lit(2).alias("lease_seq"))
    return timeline.transferred(leases, F.col("range_id") % 5 + 1, F.lit(2), F.lit(700).cast("long"), F.lit(900)).drop("holder_epoch")


@query("select user_id as node_id, max(ts) as last_seen, count(*) filter (where event_type = 'signup') as epoch from events group by 1")
def liveness(t):
    return timeline.liveness(t.events.select(F.col("user_id").alias("node_id"), "ts", (F.col("event_type") == "signup").alias("restart")))


# Placement and topology: a customer's nation is its node, ranges are a hundred keys


def hundreds(t, rows: DataFrame, key: str) -> DataFrame:
    """Ranges of a hundred keys up to the greatest one."""
    greatest = rows.agg(F.max(key)).first()[0]
    return t._spark.range(0 if greatest is None else greatest // 100 + 1).select(F.col("id").alias("range_id"), (F.col("id") * 100).alias("start_key"), (F.col("id") * 100 + 100).alias("end_key"))


@query("select o_orderkey, r.range_id, r.start_key, r.end_key from orders join (select distinct o_orderkey // 100 as range_id, o_orderkey // 100 * 100 as start_key, o_orderkey // 100 * 100 + 100 as end_key from orders) r on o_orderkey >= r.start_key and o_orderkey < r.end_key")
def range_locate(t):
    return relational.locate(t.orders.select("o_orderkey"), "o_orderkey", hundreds(t, t.orders, "o_orderkey"))


@query("select c_custkey // 100 as range_id, c_mktsegment, count(*) as row_count from customer group by 1, 2")
def range_table_stats(t):
    return topology.table_counts(t.customer, "c_custkey", "c_mktsegment", hundreds(t, t.customer, "c_custkey"))


@query("""select table_name, cast(sum(n) as bigint) as rows, count(distinct range_id) as ranges, cast(sum(3) as bigint) as replicas from
    (select 'customer' as table_name, c_custkey // 100 as range_id, count(*) as n from customer group by 2 union all select 'orders', o_orderkey // 100, count(*) from orders group by 2) group by 1""")
def cluster_stats(t):
    counts = lambda df, key, name: df.groupBy((F.floor(F.col(key) / 100)).alias("range_id")).agg(F.count("*").alias("row_count")).withColumn("table_name", F.lit(name))
    both = counts(t.customer, "c_custkey", "customer").unionByName(counts(t.orders, "o_orderkey", "orders")).withColumn("replica_count", F.lit(3))
    return topology.stats(both)


@query("select range_id, n as rows, k as split_key from (select o_custkey % 50 as range_id, o_orderkey as k, row_number() over (partition by o_custkey % 50 order by o_orderkey) as rn, count(*) over (partition by o_custkey % 50) as n from orders) where n > 64 and rn - 1 = n // 2")
def split_median_key(t):
    return placement.median_keys(t.orders.select((F.col("o_custkey") % 50).alias("range_id"), F.col("o_orderkey").alias("key")))


REPLICAS = "(select c_custkey // 3 as range_id, c_custkey as replica_id, c_nationkey as node_id, case when c_custkey % 7 = 0 then 'LEARNER' else 'VOTER' end as role, c_custkey % 3 as ordinal, c_custkey % 3 = 1 as leaseholder from customer)"
NODES = "(select n_nationkey as node_id, case when n_regionkey = 4 then '' else lower(r_name) end as region, n_nationkey * 37 % 100 / 100.0 as load, n_nationkey % 9 = 8 as draining, n_nationkey as ordinal from nation join region on n_regionkey = r_regionkey)"


def replicas(t) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(F.floor(k / 3).alias("range_id"), k.alias("replica_id"), F.col("c_nationkey").alias("node_id"), F.when(k % 7 == 0, "LEARNER").otherwise("VOTER").alias("role"), (k % 3).alias("ordinal"), (k % 3 == 1).alias("leaseholder"))


def nodes(t) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("node_id"), F.when(F.col("n_regionkey") == 4, "").otherwise(F.col("r_name")).alias("region"), (F.col("n_nationkey") * 37 % 100 / F.lit(100.0)).alias("load"), (F.col("n_nationkey") % 9 == 8).alias("draining"), F.col("n_nationkey").alias("ordinal"))


@query(f"""select range_id, replica_id as leaseholder from (
    select r.range_id, replica_id, row_number() over (partition by r.range_id order by case region when 'asia' then 1 when 'europe' then 2 else 1073741824 end, r.ordinal) as rn
    from {REPLICAS} r join {NODES} n using (node_id) where role = 'VOTER') where rn = 1""")
def leaseholder_select(t):
    r = replicas(t).join(nodes(t).select("node_id", F.lower("region").alias("region")), "node_id")
    return placement.leaseholders(r, F.array(F.lit("asia"), F.lit("europe")))


@query(f"""with r as (select * from {REPLICAS}), n as (select node_id, case when trim(region) = '' then 'unknown' else region end as region, load, draining, ordinal from {NODES}),
    m as (
      select r.range_id, r.replica_id, r.node_id as source, t.node_id as target, r.ordinal, t.ordinal as target_ordinal,
        round(s.load - t.load + case when t.region = 'asia' then 0.03 when t.region in ('asia', 'europe', 'america') then 0.01 else 0 end
          + case when s.region <> 'asia' and t.region = 'asia' then 0.02 when s.region = 'asia' and t.region <> 'asia' then -0.04 else 0 end
          - case when leaseholder then 0.05 else 0 end, 9) as score,
        (select count(distinct case when o.replica_id = r.replica_id then t.region else coalesce(x.region, 'unknown') end) from r o left join n x on x.node_id = o.node_id where o.range_id = r.range_id and o.role = 'VOTER') as regions
      from r join n s on s.node_id = r.node_id join n t on not t.draining and s.load > t.load
      where not exists (select 1 from r h where h.range_id = r.range_id and h.node_id = t.node_id))
    select range_id, replica_id, source, target, score from (select *, row_number() over (partition by range_id order by score desc, ordinal, target_ordinal) as rn from m where regions >= 3) where rn = 1""")
def rebalance_choice(t):
    policy = placement.compiled(placement.Policy("GLOBAL", preferred=["asia", "europe", "america"], lease_preferences=["asia"]))
    return placement.rebalance(replicas(t), nodes(t), policy)


@query(f"select n.node_id, n.region, coalesce(r.n, 0) + 0.25 * coalesce(r.l, 0) as load, n.draining from {NODES} n left join (select node_id, count(*) as n, count(*) filter (where leaseholder) as l from {REPLICAS} group by 1) r using (node_id)")
def node_load_score(t):
    n = nodes(t).select("node_id", F.lower("region").alias("region"), F.when(F.col("draining"), "draining").otherwise("ok").alias("status"))
    found = placement.node_loads(n, replicas(t))
    return found.withColumn("load", F.col("load").cast("double"))


@query("""with p as (select c_custkey as policy_id, ['REGIONAL', 'HOME_REGION', 'GLOBAL', 'NOPE'][c_custkey % 4 + 1] as mode, case when c_custkey % 7 = 0 then 'ZONE_FAILURE' when c_custkey % 11 = 0 then 'REGION_FAILURE' when c_custkey % 13 = 0 then 'HOPE' end as survival,
      c_custkey % 5 as n, case when c_custkey % 3 = 0 then 'r0' when c_custkey % 3 = 1 then 'home' else '' end as home from customer),
    q as (select policy_id, mode, home, n + case when mode = 'HOME_REGION' and (home = 'home' or home = 'r0' and n = 0) then 1 else 0 end as n, coalesce(survival, case when mode = 'REGIONAL' then 'ZONE_FAILURE' else 'REGION_FAILURE' end) as s from p),
    f as (select *, case when mode = 'NOPE' then 'mode' when mode = 'REGIONAL' and n <> 1 then 'one region' when mode = 'REGIONAL' and home <> '' then 'no home region' when mode = 'HOME_REGION' and home = '' then 'home region' when mode = 'GLOBAL' and n = 0 then 'regions'
      when s = 'HOPE' then 'survival' when (s = 'ZONE_FAILURE') <> (mode = 'REGIONAL') then 'survival of mode' when s = 'REGION_FAILURE' and n < 3 then 'three regions' end as fault from q)
    select policy_id, fault, case when fault is null then case when s = 'ZONE_FAILURE' then 3 else 5 end end as replicas, case when fault is null then case when s = 'ZONE_FAILURE' then 1 else 3 end end as least_regions from f""")
def placement_compile(t):
    k = F.col("c_custkey")
    mode = F.element_at(F.array(*map(F.lit, ("REGIONAL", "HOME_REGION", "GLOBAL", "NOPE"))), (k % 4 + 1).cast("int"))
    survival = F.when(k % 7 == 0, "ZONE_FAILURE").when(k % 11 == 0, "REGION_FAILURE").when(k % 13 == 0, "HOPE")
    regions = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda x: F.when(x <= k % 5, F.concat(F.lit(" R"), (x - 1).cast("string"))).otherwise(" "))  # blank ones do not count
    home = F.when(k % 3 == 0, "R0 ").when(k % 3 == 1, "Home")
    return placement.policy_numbers(t.customer.select(k.alias("policy_id"), mode.alias("mode"), survival.alias("survival"), regions.alias("preferred"), home.alias("home_region")))


@query("""with reports as (select event_id % 300 as range_id, event_id // 3000 as generation, event_id as seen, event_id * 7 % 501 as row_count, event_id % 4 as replica_id, user_id as node_id from events),
    top as (select * from (select *, max(generation) over (partition by range_id) as g from reports) where generation = g),
    each as (select range_id, replica_id, arg_max(node_id, seen) as node_id from top group by 1, 2)
    select range_id, any_value(g) as generation, max(row_count) as row_count, (select count(*) from each e where e.range_id = top.range_id) as n_replicas, (select cast(sum(node_id) as bigint) from each e where e.range_id = top.range_id) as node_sum from top group by range_id""")
def snapshot_merge_generation(t):
    i = F.col("event_id")
    reports = t.events.select((i % 300).alias("range_id"), F.floor(i / 3000).alias("generation"), F.lit("a").alias("start_key"), F.lit(None).cast("string").alias("end_key"), F.lit(1).alias("leaseholder"), (i * 7 % 501).alias("row_count"), F.array(F.struct((i % 4).alias("replica_id"), F.col("user_id").alias("node_id"), F.lit("VOTER").alias("role"))).alias("replicas"), i.alias("seen"))
    return topology.merged_ranges(reports).select("range_id", "generation", "row_count", F.size("replicas").cast("long").alias("n_replicas"), F.aggregate("replicas", F.lit(0).cast("long"), lambda a, r: a + r["node_id"]).alias("node_sum"))


def ranges_of(t) -> DataFrame:
    r = replicas(t)
    return r.groupBy("range_id").agg(F.collect_list(F.struct("replica_id", F.col("node_id").cast("long").alias("node_id"), "role")).alias("replicas"), F.max(F.when(F.col("leaseholder"), F.col("replica_id"))).alias("leaseholder"))


@query(f"select range_id, cast(node_id as bigint) as node_id, replica_id, role, coalesce(replica_id = max(case when leaseholder then replica_id end) over (partition by range_id), null) as leaseholder from {REPLICAS}")
def topology_edges(t):
    return topology.edges(ranges_of(t))


@query(f"""select event_id as id, ts, event_type from events where user_id = 5 or event_id % 500 in (select range_id from {REPLICAS} where node_id = 5)""")
def node_detail_events(t):
    hosted = topology.hosted_ranges(ranges_of(t), 5)
    events = t.events.select(F.col("event_id").alias("id"), "ts", "event_type", F.col("user_id").alias("node_id"), (F.col("event_id") % 500).alias("range_id"))
    return topology.related_events(events, 5, hosted).select("id", "ts", "event_type")


@query("select distinct event_id as id, ts, event_type from events")
def event_dedup(t):
    e = t.events.select(F.col("event_id").alias("id"), "ts", "event_type")
    return topology.deduplicated(e.union(e.where("id % 3 = 0")))


@query("select event_id, ts, event_type from events order by ts desc, event_id desc limit 256")
def recent_n_events(t):
    return feeds.replay(t.events.select("event_id", "ts", "event_type"), key="event_id")


@query("select n_nationkey as node_id, r_name as region from nation join region on n_regionkey = r_regionkey where n_nationkey in (select c_nationkey from customer where c_custkey < 20)")
def scenario_live_nodes(t):
    n = nodes(t).join(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node_id"), "r_name"), "node_id").select("node_id", F.col("r_name").alias("region"))
    return topology.scenario(t.customer.where("c_custkey < 20").select(F.col("c_nationkey").alias("node_id")), n, ranges_of(t))[0]


# Workloads, metrics and log checks


@query("""select event_type, count(*) as n, count(*) filter (where value < 50) as succeeded, count(*) filter (where not value < 50) as failed, round(avg(value), 6) as mean_ms,
    list_sort(list(value))[1 + cast(floor((count(*) - 1) * 0.5) as bigint)] as p50_ms, list_sort(list(value))[1 + cast(floor((count(*) - 1) * 0.95) as bigint)] as p95_ms, max(value) as max_ms from events group by event_type""")
def latency_summary_percentiles(t):
    return workload.summary(t.events.withColumn("ok", F.col("value") < 50), "event_type", "value").withColumn("mean_ms", F.round("mean_ms", 6))


@query("""select event_type, 't' || (event_id % 3) as tag, case when value < 50 then 'ok' when event_id % 4 = 0 then '40' when event_id % 4 = 1 then 'timeout' else 'client' end as class, count(*) as n from events group by all""")
def latency_tags_and_classes(t):
    i = F.col("event_id")
    samples = t.events.select(F.col("event_type").alias("op"), F.concat(F.lit("t"), (i % 3).cast("string")).alias("tag"), (F.col("value") < 50).alias("ok"), F.when(i % 4 == 0, "40001").alias("sqlstate"), F.when(i % 4 == 1, "Deadline passed").otherwise("gone").alias("message"))
    return workload.tag_classes(samples).withColumnRenamed("op", "event_type")


@query("select class, count(*) as n from (select case when event_type = 'error' then '40' when event_type = 'view' then 'timeout' else 'client' end as class from events) group by 1")
def error_class_histogram(t):
    state, message = F.when(F.col("event_type") == "error", "40001"), F.when(F.col("event_type") == "view", "statement Timeout").otherwise("gone")
    return t.events.select(workload.error_class(state, message).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("select event_type, count(*) filter (where value <= 10) as le_0, count(*) filter (where value <= 50) as le_1, count(*) filter (where value <= 100) as le_2, count(*) as n from events group by event_type")
def histogram_buckets(t):
    return workload.histogram(t.events, "value", [10, 50, 100], ["event_type"]).drop("total")


LOGS = "(select event_id, user_id, ts, case when event_type = 'purchase' then 'write_ack token=' || (event_id % 2000) || ' range=' || user_id when event_type = 'click' then 'write_visible token=' || (event_id % 2000) else 'plain text' end as message from events)"


def logs(t) -> DataFrame:
    token = F.concat(F.lit("token="), (F.col("event_id") % 2000).cast("string"))
    message = F.when(F.col("event_type") == "purchase", F.concat(F.lit("write_ack "), token, F.lit(" range="), F.col("user_id").cast("string"))).when(F.col("event_type") == "click", F.concat(F.lit("write_visible "), token)).otherwise("plain text")
    return t.events.select("event_id", F.col("user_id").alias("node_id"), "ts", message.alias("message"))


@query(f"select distinct regexp_extract(message, 'token=(\\S+)', 1) as token from {LOGS} where message like 'write_ack %' and regexp_extract(message, 'token=(\\S+)', 1) not in (select regexp_extract(message, 'token=(\\S+)', 1) from {LOGS} where message like 'write_visible %')")
def acked_not_visible(t):
    return assertions.lost_writes(assertions.markers(logs(t)))


@query(f"select event_id, regexp_extract(message, '^(\\w+)', 1) as kind, regexp_extract(message, 'token=(\\S+)', 1) as token, nullif(regexp_extract(message, 'range=(\\S+)', 1), '') as range_name from {LOGS} where message <> 'plain text'")
def marker_parse(t):
    return assertions.markers(logs(t)).select("event_id", "kind", F.col("fields")["token"].alias("token"), F.col("fields")["range"].alias("range_name"))


@query("select event_id, event_id * 7 % 100 as read_ts, event_id % 100 as closed_ts from events where event_type = 'error' or event_id * 7 % 100 > event_id % 100")
def stale_follower_reads(t):
    r = t.events.select("event_id", (F.col("event_id") * 7 % 100).alias("read_ts"), (F.col("event_id") % 100).alias("closed_ts"), F.when(F.col("event_type") == "error", "violation").otherwise("ok").alias("status"))
    return assertions.stale_reads(r).drop("status")


@query("select user_id as txn_id, count(distinct event_type) as outcomes from events group by 1 having count(distinct event_type) <> 1")
def conflicting_outcomes(t):
    return assertions.unsettled(t.events.select(F.col("user_id").alias("txn_id"), F.col("event_type").alias("result")))


@query("select * from (select user_id % 20 as range_id, ts, event_id as node_id, event_id * 31 % 101 as seq, lag(event_id * 31 % 101) over (partition by user_id % 20 order by ts, event_id) as before from events) where seq < before")
def monotonic_regressions(t):
    return assertions.regressions(t.events.select((F.col("user_id") % 20).alias("range_id"), "ts", F.col("event_id").alias("node_id"), (F.col("event_id") * 31 % 101).alias("seq")), "seq")


# Scalar functions


@query("select c_custkey, ['meta1', 'meta2', 'system', 'table', 'local', 'unknown'][c_custkey % 6 + 1] as kind from customer")
def keyspace_classify(t):
    starts = F.array(*(F.lit(x) for x in ("/meta1/a", "/meta2/a", "/system/x", "/mvcc/global/table/7", "/local/r", "/other")))
    return t.customer.select("c_custkey", keys.keyspace(F.element_at(starts, (F.col("c_custkey") % 6 + 1).cast("int"))).alias("kind"))


@query("select event_id, case when a > b and aw = bw then 0 when a > b then aw - bw else 0 end as wall, case when a > b and aw = bw then al - bl else 0 end as logical from (select event_id, event_id % 7 as aw, event_id % 5 as al, event_id % 6 as bw, event_id % 4 as bl, (event_id % 7, event_id % 5) as a, (event_id % 6, event_id % 4) as b from events)")
def hlc_gap(t):
    i = F.col("event_id")
    return t.events.select("event_id", hlc.gap(hlc.stamp(i % 7, i % 5), hlc.stamp(i % 6, i % 4)).alias("g")).select("event_id", "g.wall", "g.logical")


@query("select event_id, case when l = 0 and w > 0 then w - 1 else w end as wall, case when l > 0 then l - 1 when w > 0 then 4294967295 else 0 end as logical from (select event_id, event_id % 3 as w, event_id % 2 as l from events)")
def hlc_prev_tick(t):
    i = F.col("event_id")
    return t.events.select("event_id", hlc.previous_tick(hlc.stamp(i % 3, i % 2)).alias("p")).select("event_id", "p.wall", "p.logical")


@query("select o_orderkey, upper(lpad(to_hex(cast((cast(o_orderkey as hugeint) - 500) * 1000003 + 9223372036854775808 as ubigint)), 16, '0')) as key_hex from orders")
def ordered_int_key(t):
    """Keys of numbers of both signs."""
    return t.orders.select("o_orderkey", keys.ordered_int_key((F.col("o_orderkey") - 500) * 1_000_003).alias("key_hex"))


@query("select n_nationkey, case when trim(x) = '' then 'unknown' else lower(trim(x)) end as region from (select n_nationkey, case when n_nationkey % 3 = 0 then '  ' else ' ' || n_name || ' ' end as x from nation)")
def canonical_region(t):
    return t.nation.select("n_nationkey", keys.canonical_region(F.when(F.col("n_nationkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")))).alias("region"))


# Streams


@query("select date_trunc('hour', ts) as hour_start, event_type, count(*) as n from events group by 1, 2")
def events_hourly_window(t):
    found = feeds.hourly(t.events)
    return found.withColumn("hour_start", F.col("hour_start").cast("timestamp_ntz"))


@query("select event_id, ts, event_type from events")
def event_stream_available_now(t):
    """The feed as a stream that takes what there is, kept in a stored table."""
    import uuid

    spark = t._spark
    top = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/stream-{uuid.uuid4().hex}"
    schema = t.events.schema
    stream = spark.readStream.schema(schema).parquet(f"{t._dir}/events.parquet*").select("event_id", F.col("ts").cast("timestamp"), "event_type")
    feeds.run_available(feeds.deduplicated_stream(stream, key="event_id", late="40 days"), f"{top}/out", f"{top}/state")
    return spark.read.parquet(f"{top}/out").select("event_id", F.col("ts").cast("timestamp_ntz"), "event_type")


@query("""with l as (select user_id % 40 as range_id, event_id as log_index, cast(event_id % 100 as varchar) as key, event_type as value, case when event_type = 'error' then 'delete' else 'put' end as op from events)
    select range_id, key, arg_max(value, log_index) as value from l group by 1, 2 having arg_max(op, log_index) = 'put'""")
def replica_log_fold(t):
    log = t.events.select((F.col("user_id") % 40).alias("range_id"), F.col("event_id").alias("log_index"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), (F.col("event_id") % 100).cast("string").alias("key"), F.col("event_type").alias("value"), F.lit(1).alias("generation"))
    return feeds.applied_log(log)


COMMANDS = """(select user_id % 40 as range_id, event_id as log_index, ['put', 'put_intent', 'delete_intent', 'set_txn', 'set_lease', 'set_closed', 'delete', 'set_closed'][event_id % 8 + 1] as op, cast(event_id % 30 as varchar) as key,
    cast(user_id as varchar) as txn_id, event_id % 3 as epoch, event_type as status, event_id * 7 % 1009 as ts, event_id // 4000 as lease_seq, event_id % 5 as holder, event_id // 10 + event_id % 7 as closed from events)"""


def commands(t) -> DataFrame:
    i = F.col("event_id")
    op = F.element_at(F.array(*map(F.lit, ("put", "put_intent", "delete_intent", "set_txn", "set_lease", "set_closed", "delete", "set_closed"))), (i % 8 + 1).cast("int"))
    return t.events.select(
        (F.col("user_id") % 40).alias("range_id"), i.alias("log_index"), op.alias("op"), (i % 30).cast("string").alias("key"), F.col("user_id").cast("string").alias("txn_id"), (i % 3).alias("epoch"), F.lit("EXCLUSIVE").alias("strength"),
        F.col("event_type").alias("status"), (i * 7 % 1009).alias("ts"), F.floor(i / 4000).alias("lease_seq"), (i % 5).alias("holder"), (F.floor(i / 10) + i % 7).alias("closed"))


@query(f"select range_id, key, arg_max(txn_id, log_index) as txn_id, arg_max(epoch, log_index) as epoch from {COMMANDS} where op in ('put_intent', 'delete_intent') group by 1, 2 having arg_max(op, log_index) = 'put_intent'")
def replica_log_intents(t):
    return replica_log.open_intents(commands(t)).drop("strength")


@query(f"select range_id, txn_id, arg_max(status, log_index) as status, arg_max(epoch, log_index) as epoch from {COMMANDS} where op = 'set_txn' group by 1, 2")
def replica_log_records(t):
    return replica_log.txn_records(commands(t))


@query(f"""select range_id, max(log_index) as applied_index, max(ts) filter (where op in ('put', 'delete')) as frontier, arg_max(lease_seq, log_index) filter (where op = 'set_lease') as lease_seq,
    arg_max(holder, log_index) filter (where op = 'set_lease') as holder from {COMMANDS} group by 1""")
def replica_log_state(t):
    return replica_log.range_state(commands(t))


@query(f"""with c as (select * from {COMMANDS} where op in ('set_lease', 'set_closed')),
    h as (select *, last_value(case when op = 'set_lease' then lease_seq end ignore nulls) over (partition by range_id order by log_index) as lease from c),
    b as (select *, max(case when op = 'set_closed' and lease_seq = lease then lease_seq * 1000000000 + closed end) over (partition by range_id order by log_index rows between unbounded preceding and 1 preceding) as before from h)
    select range_id, log_index, lease_seq, closed, case when lease is null then 'no lease' when lease_seq <> lease then 'lease sequence' when lease_seq * 1000000000 + closed < before then 'regressed' end as fault from b where op = 'set_closed'""")
def replica_log_closed(t):
    return replica_log.closed_updates(commands(t))


@query("select n_nationkey, lower(trim(' ' || n_name || '  ')) as name, lower(to_hex(n_name)) as key_hex, to_hex(n_name) || '0001' as escaped from nation")
def names_and_keys(t):
    name = F.concat(F.lit(" "), F.col("n_name"), F.lit("  "))
    return t.nation.select("n_nationkey", keys.canonical_name(name).alias("name"), keys.hex_key(F.encode("n_name", "UTF-8")).alias("key_hex"), keys.escaped_key(F.encode("n_name", "UTF-8")).alias("escaped"))


@query("""select event_id, case when event_id % 3 = 0 then w + 1 else w end as wall, case when event_id % 3 = 0 then 0 else event_id % 5 + 1 end as logical,
    case when w <= 4 then 0 else w - 4 end as less_wall, case when w <= 4 then 0 when event_id % 3 = 0 then 4294967295 else event_id % 5 end as less_logical from (select event_id, event_id % 9 as w from events)""")
def hlc_next_tick(t):
    i = F.col("event_id")
    at = hlc.stamp(i % 9, F.when(i % 3 == 0, hlc.LAST_LOGICAL).otherwise(i % 5))
    found = t.events.select("event_id", hlc.next_tick(at).alias("n"), hlc.minus_wall(at, F.lit(4)).alias("m"))
    return found.select("event_id", "n.wall", "n.logical", F.col("m.wall").alias("less_wall"), F.col("m.logical").alias("less_logical"))


@query("select user_id % 50 as node_id, arg_max(event_type, event_id) as status, max(event_id) as seen from events group by 1")
def snapshot_merge_nodes(t):
    return topology.merged_nodes(t.events.select((F.col("user_id") % 50).alias("node_id"), F.col("event_type").alias("status"), F.col("event_id").alias("seen")))


@query("select c_custkey, list_sort(list_distinct([c_custkey % 5, 3, c_custkey % 3, c_custkey % 7])) as touched, c_custkey % 90 >= 40 as renewable from customer")
def record_touched_ranges(t):
    k = F.col("c_custkey")
    r = t.customer.select(k, F.array(k % 5, F.lit(3).cast(t.customer.schema["c_custkey"].dataType)).alias("touched"), F.array(k % 3, k % 7).alias("new_ranges"), F.lit(40).alias("start_ts"))
    return transactions.touched_once(r).select("c_custkey", "touched", timeline.renewable(r, k % 90).alias("renewable"))


# Further decisions


@query("select max(c_custkey // 3) + 1 as next_id from customer")
def next_range_id(t):
    return topology.next_range_id(replicas(t).select("range_id"))


@query("select o_custkey % 50 as range_id, min_by(o_orderstatus, o_orderkey) as label, count(distinct o_orderkey) as tables from orders group by 1")
def shard_label_first_of_group(t):
    return topology.shard_labels(t.orders.select((F.col("o_custkey") % 50).alias("range_id"), F.col("o_orderkey").alias("table_id"), F.col("o_orderstatus").alias("table_name")))


@query(f"select txn_id, 'PENDING' as status, epoch + 1 as epoch, greatest(c, 700) as read_ts, greatest(write_ts, 700) as write_ts from (select *, cast(txn_id as bigint) as c from {RECORDS}) where status in ('PENDING', 'STAGING')")
def txn_restart(t):
    return transactions.restarted(records(t), F.lit(700).cast("long")).select("txn_id", "status", "epoch", "read_ts", "write_ts")


@query("select c_custkey, case when c_custkey % 5 = 0 then 'id' when c_custkey % 7 = 0 then 'status' when c_custkey % 11 = 0 then 'write before read' when c_custkey % 2 = 0 and c_custkey % 3 = 0 then 'no anchor' end as rule from customer where c_custkey % 5 = 0 or c_custkey % 7 = 0 or c_custkey % 11 = 0 or c_custkey % 6 = 0")
def invalid_records(t):
    k = F.col("c_custkey")
    r = t.customer.select(k, F.when(k % 5 != 0, k.cast("string")).alias("txn_id"), F.when(k % 7 == 0, "LOST").when(k % 2 == 0, "STAGING").otherwise("PENDING").alias("status"), F.lit(5).alias("read_ts"), F.when(k % 11 == 0, 4).otherwise(6).alias("write_ts"), F.when(k % 3 != 0, 1).alias("anchor_range"))
    return transactions.invalid_records(r).select("c_custkey", "rule")


@query("select cast(user_id as varchar) as txn_id, cast(event_id % 40 as varchar) as key, count(*) as reports, count(distinct event_id % 3) as ranges from events group by 1, 2 having count(*) > 1 or count(distinct event_id % 3) > 1")
def doubled_observations(t):
    return transactions.doubled_observations(t.events.select(F.col("user_id").cast("string").alias("txn_id"), (F.col("event_id") % 40).cast("string").alias("key"), (F.col("event_id") % 3).alias("range_id")))


SPLIT_RULES = ["expected generation", "left keeps its id", "equal ids", "left start", "no split key", "halves do not meet", "right end", "generation does not rise", "left replicas", "right replicas", "left leaseholder", "right leaseholder", "outside"]


@query("select o_orderkey, [" + ", ".join(f"'{r}'" for r in SPLIT_RULES) + "][o_orderkey % 16 + 1] as rule from orders where o_orderkey % 16 < 13")
def split_validation(t):
    """Of sixteen kinds of splits thirteen break a rule each."""
    kind = F.col("o_orderkey") % 16
    broken = lambda rule, bad, good: F.when(kind == SPLIT_RULES.index(rule), bad).otherwise(good)
    replicas = lambda *ids: F.array(*(F.struct(F.lit(i).alias("replica_id"), F.lit(i).alias("node_id"), F.lit("VOTER").alias("role")) for i in ids))
    at = broken("outside", 95, 50)
    part = lambda i, generation, start, end, own, holder: F.struct(i.alias("range_id"), generation.alias("generation"), start.alias("start_key"), end.alias("end_key"), own.alias("replicas"), holder.alias("leaseholder"))
    one, own = F.lit(1), replicas(1, 2, 3)
    old = part(one, F.lit(4), F.lit(10), F.lit(90), own, one)
    left = part(broken("left keeps its id", 3, 1), broken("generation does not rise", 4, 5), broken("left start", 11, 10), F.when(kind != SPLIT_RULES.index("no split key"), at), broken("left replicas", replicas(1, 2), replicas(3, 1, 2)), broken("left leaseholder", 2, 1))
    right = part(broken("equal ids", 1, 2), F.lit(1), broken("halves do not meet", 51, at), broken("right end", 91, 90), broken("right replicas", replicas(1, 2, 4), own), broken("right leaseholder", 3, 1))
    s = t.orders.select("o_orderkey", old.alias("old"), left.alias("left"), right.alias("right"), broken("expected generation", 3, 4).alias("expected_generation"))
    return placement.split_faults(s).select("o_orderkey", "rule")


@query("select c_custkey, case when w > 0 or l >= 20 or s >= 10 or p >= 536870912 then 'critical' when l >= 8 or s >= 4 or p >= 67108864 then 'normal' else 'background' end as priority from (select c_custkey, c_custkey % 25 as l, c_custkey % 12 as s, c_custkey * 1000000 as p, case when c_custkey % 31 = 0 then 1 else 0 end as w from customer)")
def compaction_priority(t):
    k = F.col("c_custkey")
    stores = t.customer.select(k, (k % 25).alias("l0_files"), (k % 12).alias("l0_sublevels"), (k * 1_000_000).alias("pending_bytes"), F.when(k % 31 == 0, 1).otherwise(0).alias("write_stalls"))
    return placement.compaction_priority(stores).select("c_custkey", "priority")


@query("select time_bucket(interval '1 hour', ts) as bucket, event_type, count(*) / 3600.0 as rate from events group by 1, 2")
def dashboard_rate(t):
    found = workload.rate(t.events, "ts", 3600, ["event_type"])
    return found.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", F.col("rate").cast("double").alias("rate"))


@query("""with h as (select event_type, count(*) filter (where value <= 10) as a, count(*) filter (where value <= 50) as b, count(*) filter (where value <= 1000) as c from events group by 1)
    select event_type, round(case when a >= c * 0.5 then 10 * (c * 0.5) / a when b >= c * 0.5 then 10 + 40 * (c * 0.5 - a) / (b - a) else 50 + 950 * (c * 0.5 - b) / (c - b) end, 6) as p50 from h""")
def dashboard_quantile(t):
    h = workload.histogram(t.events, "value", [10, 50, 1000], ["event_type"])
    return h.select("event_type", F.round(workload.bucket_quantile([10, 50, 1000], [F.col("le_0"), F.col("le_1"), F.col("le_2")], 0.5), 6).alias("p50"))


@query(f"select range_id, replica_id, region from {REPLICAS} left join (select node_id, region from {NODES} where node_id < 20) using (node_id)")
def range_detail(t):
    return topology.range_detail(ranges_of(t), nodes(t).where("node_id < 20").select("node_id", F.lower("region").alias("region"))).select("range_id", "replica_id", "region")


@query("select node_id from (select distinct c_nationkey + 10 as node_id from customer where c_custkey < 40) where node_id not in (select n_nationkey from nation)")
def scenario_missing_nodes(t):
    return topology.scenario(t.customer.where("c_custkey < 40").select((F.col("c_nationkey") + 10).alias("node_id")), nodes(t), ranges_of(t))[1]


@query(f"select distinct range_id from {REPLICAS} where node_id in (1, 2)")
def scenario_ranges(t):
    manifest = t._spark.range(1, 3).select(F.col("id").cast("int").alias("node_id"))
    return topology.scenario(manifest, nodes(t), ranges_of(t))[2].select("range_id")


@query("select (select count(*) from nation) as nodes, count(distinct c_custkey // 3) as ranges, count(*) as replicas, cast(sum(c_custkey % 3) as bigint) as rows from customer")
def cluster_totals(t):
    r = ranges_of(t).withColumn("row_count", F.aggregate("replicas", F.lit(0).cast("long"), lambda a, x: a + x["replica_id"] % 3))
    return topology.totals(r, nodes(t)).select("nodes", "ranges", "replicas", "rows")


@query("""with c as (select c_custkey as range_id, case when c_custkey % 13 = 0 then 6 else 7 end as expected, ['add', 'promote', 'remove', 'swap'][c_custkey % 4 + 1] as op, c_custkey % 6 as id from customer),
    f as (select *, case when expected <> 7 then 'expected generation' when op = 'swap' then 'unknown change' when op = 'add' and id in (1, 2, 3) then 'exists already' when op in ('promote', 'remove') and id not in (1, 2, 3) then 'not found'
      when op = 'promote' and id <> 3 then 'not a learner' when op = 'remove' and id = 1 then 'holds the lease' when op = 'add' and id = 5 then 'two on a node' end as fault from c)
    select range_id, case when fault is null then 8 else 7 end as generation, fault, 3 + case when fault is null and op = 'add' then 1 when fault is null and op = 'remove' then -1 else 0 end as n_replicas,
      2 + case when fault is null and op = 'promote' then 1 when fault is null and op = 'remove' and id = 2 then -1 else 0 end as voters from f""")
def replica_change(t):
    k = F.col("c_custkey")
    replica = lambda i, node, role: F.struct(i.alias("replica_id"), node.alias("node_id"), role.alias("role"))
    there = F.array(*(replica(F.lit(i), F.lit(i), F.lit("VOTER" if i < 3 else "LEARNER")) for i in (1, 2, 3)))
    op, i = F.element_at(F.array(*map(F.lit, ("add", "promote", "remove", "swap"))), (k % 4 + 1).cast("int")), (k % 6).cast("int")
    change = replica(i, F.when(i == 5, 2).otherwise(i), F.when(op == "add", "LEARNER").otherwise("VOTER"))
    r = t.customer.select(k.alias("range_id"), F.lit(7).alias("generation"), F.lit(1).alias("leaseholder"), there.alias("replicas"), op.alias("op"), change.alias("replica"), F.when(k % 13 == 0, 6).otherwise(7).alias("expected_generation"))
    return placement.changed_replicas(r).select("range_id", "generation", "fault", F.size("replicas").alias("n_replicas"), F.size(F.filter("replicas", lambda x: x["role"] == "VOTER")).alias("voters"))


@query("select event_id % 300 as range_id, event_id, value from (select *, row_number() over (partition by event_id % 300 order by ts desc, event_id desc) as rn from events) where rn = 1")
def latest_of_each(t):
    return mvcc.latest(t.events.select((F.col("event_id") % 300).alias("range_id"), "ts", "event_id", "value", F.lit(False).alias("tombstone")), ["range_id"], ["ts", "event_id"]).select("range_id", "event_id", "value")


@query("select a.c_custkey as left_key, b.c_custkey as right_key, greatest(a.c_custkey, b.c_custkey) as start_key, least(a.c_custkey + 3, b.c_custkey + 3) as end_key from customer a join customer b on a.c_custkey < b.c_custkey + 3 and b.c_custkey < a.c_custkey + 3")
def span_overlap(t):
    # spans meet in bins of keys, and each pair in the bin where its intersection begins
    bins = lambda df, start, end: df.withColumn("bin", F.explode(F.sequence(F.floor(F.col(start) / 64), F.floor((F.col(end) - 1) / 64))))
    a = bins(t.customer.select(F.col("c_custkey").alias("left_key"), F.col("c_custkey").alias("sa"), (F.col("c_custkey") + 3).alias("ea")), "sa", "ea")
    b = bins(t.customer.select(F.col("c_custkey").alias("right_key"), F.col("c_custkey").alias("sb"), (F.col("c_custkey") + 3).alias("eb")), "sb", "eb")
    start, end = relational.intersection(F.col("sa"), F.col("ea"), F.col("sb"), F.col("eb"))
    return a.join(b, "bin").where(relational.overlaps(F.col("sa"), F.col("ea"), F.col("sb"), F.col("eb")) & (F.col("bin") == F.floor(start / 64))).select("left_key", "right_key", start.alias("start_key"), end.alias("end_key"))
