"""Placement policies, leaseholders, rebalancing, splits, admission and compaction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyspan.errors import SqlError
from keyspan.functions.keys import canonical_region

#: Replicas and least distinct regions by what a table must survive (fixed values).
SURVIVAL = {"ZONE_FAILURE": (3, 1), "REGION_FAILURE": (5, 3)}
#: What a move's score gains or loses (fixed values).
PREFERRED_BONUS, LISTED_BONUS, INTO_PREFERRED, OUT_OF_PREFERRED, LEASEHOLDER_COST = 0.03, 0.01, 0.02, -0.04, -0.05


@dataclass(frozen=True)
class Placement:
    mode: str
    survival: str
    replicas: int
    least_regions: int
    preferred: tuple[str, ...] = ()
    lease_preferences: tuple[str, ...] = ()


@dataclass
class Policy:
    mode: str
    home: str = ""
    survival: str = ""
    preferred: list[str] = field(default_factory=list)
    lease_preferences: list[str] = field(default_factory=list)


def _regions(names: list[str]) -> list[str]:
    return sorted({n.strip().lower() for n in names if n.strip()})


def compiled(policy: Policy) -> Placement:
    """A policy with its defaults, checked, as numbers an allocator uses."""
    home, preferred, leases = policy.home.strip().lower(), _regions(policy.preferred), _regions(policy.lease_preferences)
    survival = policy.survival or ("ZONE_FAILURE" if policy.mode == "REGIONAL" else "REGION_FAILURE")

    def need(fact: bool, what: str) -> None:
        if not fact:
            raise SqlError(f"{policy.mode} placement {what}", "22023")

    if policy.mode not in ("REGIONAL", "HOME_REGION", "GLOBAL") or survival not in SURVIVAL:
        raise SqlError("this placement is not known", "22023")
    if policy.mode == "REGIONAL":
        need(len(preferred) == 1, "names one region")
        need(not home, "has no home region")
        need(survival == "ZONE_FAILURE", "survives a zone's failure only")
        leases = leases or preferred
    else:
        if policy.mode == "HOME_REGION":
            need(bool(home), "needs a home region")
            preferred = preferred or [home]
            preferred = preferred if home in preferred else [home, *preferred]
            leases = leases or [home]
        need(survival == "REGION_FAILURE", "survives a region's failure")
        need(len(preferred) >= 3, "needs three regions")
    return Placement(policy.mode, survival, *SURVIVAL[survival], tuple(preferred), tuple(leases))


def policy_numbers(policies: DataFrame) -> DataFrame:
    """Replica count and least regions for each of many policies, and the fault of those that are invalid.

    policies: policy_id, mode, survival (null: the mode's own), preferred (regions), home_region.
    """
    mode, home = F.col("mode"), F.coalesce(F.lower(F.trim("home_region")), F.lit(""))
    named = F.coalesce(F.filter(F.array_distinct(F.transform("preferred", lambda r: F.lower(F.trim(r)))), lambda r: r != ""), F.array().cast("array<string>"))
    with_home = F.when((mode == "HOME_REGION") & (home != "") & ~F.array_contains(named, home), F.concat(F.array(home), named)).otherwise(named)
    survival = F.coalesce(F.nullif("survival", F.lit("")), F.when(mode == "REGIONAL", "ZONE_FAILURE").otherwise("REGION_FAILURE"))
    n = F.size("_regions")
    fault = (
        F.when(mode.isNull() | ~mode.isin("REGIONAL", "HOME_REGION", "GLOBAL"), "mode")
        .when((mode == "REGIONAL") & (n != 1), "one region")
        .when((mode == "REGIONAL") & (F.col("_home") != ""), "no home region")
        .when((mode == "HOME_REGION") & (F.col("_home") == ""), "home region")
        .when((mode == "GLOBAL") & (n == 0), "regions")
        .when(~F.col("_survival").isin(*SURVIVAL), "survival")
        .when((F.col("_survival") == "ZONE_FAILURE") != (mode == "REGIONAL"), "survival of mode")
        .when((F.col("_survival") == "REGION_FAILURE") & (n < 3), "three regions")
    )
    judged = policies.withColumns({"_home": home, "_regions": with_home, "_survival": survival}).withColumn("fault", fault)
    number = lambda k: F.when(F.col("fault").isNull(), F.when(F.col("_survival") == "ZONE_FAILURE", SURVIVAL["ZONE_FAILURE"][k]).otherwise(SURVIVAL["REGION_FAILURE"][k]))
    return judged.select("policy_id", number(0).alias("replicas"), number(1).alias("least_regions"), "fault")


def leaseholders(replicas: DataFrame, preferences: Column) -> DataFrame:
    """For each range the voter in the most preferred region, else the first voter; replicas: range_id, replica_id, region, role, ordinal."""
    rank = F.nullif(F.array_position(preferences, F.col("region")), F.lit(0))
    voters = replicas.where("role = 'VOTER'")
    return voters.groupBy("range_id").agg(F.min_by("replica_id", F.struct(F.coalesce(rank, F.lit(1 << 30)), "ordinal")).alias("leaseholder"))


def rebalance(replicas: DataFrame, nodes: DataFrame, placement: Placement | None = None, places: int = 9) -> DataFrame:
    """The best move of each range that has one.

    replicas: range_id, replica_id, node_id, role, ordinal, leaseholder (boolean).  nodes:
    node_id, region, load, draining, ordinal; a cluster's nodes, whose number is bounded by the
    cluster.  A move lowers load, goes to a node without a replica of the range, and leaves the
    voters in enough regions.
    """
    least = max(1, placement.least_regions) if placement else 1
    preferred = list(placement.preferred) if placement else []
    favoured = list(placement.lease_preferences or placement.preferred) if placement else []
    inside = lambda c, names: c.isin(names) if names else F.lit(False)
    n = nodes.withColumn("region", canonical_region(F.col("region")))
    source = n.select("node_id", F.col("region").alias("source_region"), F.col("load").alias("source_load"))
    r = replicas.join(source, "node_id")
    # what the voters' regions are, and how often each occurs, without the one that moves
    voters = replicas.where("role = 'VOTER'").join(source.select("node_id", "source_region"), "node_id", "left").withColumn("source_region", F.coalesce("source_region", F.lit("unknown")))
    held = voters.groupBy("range_id").agg(F.collect_list("source_region").alias("regions"))
    hosts = replicas.groupBy("range_id").agg(F.collect_set("node_id").alias("hosts"))
    target = n.where("not draining").select(F.col("node_id").alias("target"), F.col("region").alias("target_region"), F.col("load").alias("target_load"), F.col("ordinal").alias("target_ordinal"))
    moves = r.join(held, "range_id", "left").join(hosts, "range_id").join(target, (F.col("source_load") > F.col("target_load")) & ~F.array_contains("hosts", F.col("target")))
    others = F.slice(F.col("regions"), 1, F.array_position("regions", F.col("source_region")).cast("int") - 1)
    after = F.slice(F.col("regions"), F.array_position("regions", F.col("source_region")).cast("int") + 1, F.size("regions"))
    kept = F.when(F.col("role") == "VOTER", F.concat(others, after, F.array("target_region"))).otherwise(F.coalesce("regions", F.array().cast("array<string>")))
    moves = moves.where(F.size(F.array_distinct(kept)) >= least)
    is_from, is_to = inside(F.col("source_region"), favoured) & (F.col("source_region") != "unknown"), inside(F.col("target_region"), favoured) & (F.col("target_region") != "unknown")
    bonus = F.when(is_to & F.lit(bool(preferred)), PREFERRED_BONUS).when(inside(F.col("target_region"), preferred), LISTED_BONUS).otherwise(0.0)
    bias = F.when(~is_from & is_to, INTO_PREFERRED).when(is_from & ~is_to, OUT_OF_PREFERRED).otherwise(0.0)
    cost = F.when(F.col("leaseholder"), LEASEHOLDER_COST).otherwise(0.0)
    score = F.round(F.col("source_load") - F.col("target_load") + bonus + bias + cost, places)
    best = F.max_by(F.struct("replica_id", F.col("node_id").alias("source"), "target", "score"), F.struct("score", -F.col("ordinal"), -F.col("target_ordinal")))
    return moves.withColumn("score", score).groupBy("range_id").agg(best.alias("b")).select("range_id", "b.replica_id", "b.source", "b.target", "b.score")


def node_loads(nodes: DataFrame, replicas: DataFrame) -> DataFrame:
    """Replicas plus a quarter of the leases of each node, and whether it drains (node_id, region, status)."""
    held = replicas.groupBy("node_id").agg(F.count("*").alias("replicas"), F.count_if("leaseholder").alias("leases"))
    load = F.coalesce("replicas", F.lit(0)) + 0.25 * F.coalesce("leases", F.lit(0))
    return nodes.join(held, "node_id", "left").select("node_id", "region", load.alias("load"), (F.col("status") != "ok").alias("draining"))


def median_keys(keys: DataFrame, more_than: int = 64) -> DataFrame:
    """For each range (range_id, key) of more rows than that, its key in the middle: number n div 2 of n, from 0."""
    w = Window.partitionBy("range_id")
    ranked = keys.withColumn("rn", F.row_number().over(w.orderBy("key"))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.expr(f"n > {more_than} and rn - 1 = n div 2")).select("range_id", F.col("n").alias("rows"), F.col("key").alias("split_key"))


def split(ranges: DataFrame, at: DataFrame, next_id: Column) -> DataFrame:
    """ranges (range_id, generation, start_key, end_key) with those of `at` (range_id, split_key) cut in two, a generation later."""
    both = ranges.join(at.select("range_id", "split_key"), "range_id", "left")
    whole = both.where("split_key is null").drop("split_key")
    left = both.where("split_key is not null").select("range_id", (F.col("generation") + 1).alias("generation"), "start_key", F.col("split_key").alias("end_key"))
    rank = F.row_number().over(Window.orderBy("range_id")) - 1  # few ranges split at once
    right = both.where("split_key is not null").select((next_id + rank).cast("long").alias("range_id"), (F.col("generation") + 1).alias("generation"), F.col("split_key").alias("start_key"), "end_key")
    return whole.unionByName(left).unionByName(right)


def split_faults(splits: DataFrame) -> DataFrame:
    """Splits that break a rule, with the first rule that they break.

    splits: old, left and right, each a struct of range_id, generation, start_key, end_key (null:
    open), replicas (structs) and leaseholder; expected_generation.
    """
    old, left, right = (F.col(c) for c in ("old", "left", "right"))
    same = lambda a, b: F.array_sort(a["replicas"]).eqNullSafe(F.array_sort(b["replicas"]))
    rule = (
        F.when(F.col("expected_generation") != old["generation"], "expected generation")
        .when(old["range_id"].isNull() | (old["range_id"] == 0), "no range")
        .when(left["range_id"] != old["range_id"], "left keeps its id")
        .when(right["range_id"] == old["range_id"], "equal ids")
        .when(~left["start_key"].eqNullSafe(old["start_key"]), "left start")
        .when(left["end_key"].isNull(), "no split key")
        .when(~left["end_key"].eqNullSafe(right["start_key"]), "halves do not meet")
        .when(~right["end_key"].eqNullSafe(old["end_key"]), "right end")
        .when(left["generation"] <= old["generation"], "generation does not rise")
        .when(~same(left, old), "left replicas")
        .when(~same(right, old), "right replicas")
        .when(~left["leaseholder"].eqNullSafe(old["leaseholder"]), "left leaseholder")
        .when(~right["leaseholder"].eqNullSafe(old["leaseholder"]), "right leaseholder")
        .when((right["range_id"] == 0) | (left["end_key"] <= old["start_key"]) | (old["end_key"].isNotNull() & (left["end_key"] >= old["end_key"])), "outside")
    )
    return splits.withColumn("rule", rule).where("rule is not null")


def changed_replicas(ranges: DataFrame) -> DataFrame:
    """Each range after one replica change, or as it was with the fault for which the change is refused.

    ranges: range_id, generation, leaseholder, replicas (structs of replica_id, node_id, role), op
    (add, promote, remove), replica (a struct as in replicas), expected_generation.
    """
    new = F.col("replica")
    is_it = lambda r: r["replica_id"] == new["replica_id"]
    known, learner = F.exists("replicas", is_it), F.exists("replicas", lambda r: is_it(r) & (r["role"] == "LEARNER"))
    after = (
        F.when(F.col("op") == "add", F.concat("replicas", F.array(new)))
        .when(F.col("op") == "promote", F.transform("replicas", lambda r: F.when(is_it(r), new).otherwise(r)))
        .otherwise(F.filter("replicas", lambda r: ~is_it(r)))
    )
    voters = lambda c: F.size(F.filter(c, lambda r: r["role"] == "VOTER"))
    nodes = F.transform("_after", lambda r: r["node_id"])
    fault = (
        F.when(F.col("expected_generation") != F.col("generation"), "expected generation")
        .when(~F.col("op").isin("add", "promote", "remove"), "unknown change")
        .when((F.col("op") == "add") & known, "exists already")
        .when(F.col("op").isin("promote", "remove") & ~known, "not found")
        .when((F.col("op") == "promote") & ~learner, "not a learner")
        .when((F.col("op") == "remove") & (F.col("leaseholder") == new["replica_id"]), "holds the lease")
        .when((F.col("op") == "remove") & (voters("_after") == 0), "no voters left")
        .when(F.size(F.array_distinct(nodes)) < F.size(nodes), "two on a node")
    )
    judged = ranges.withColumn("_after", after).withColumn("fault", fault)
    fine = F.col("fault").isNull()
    return judged.withColumns({"replicas": F.when(fine, F.col("_after")).otherwise(F.col("replicas")), "generation": F.col("generation") + fine.cast("int")}).drop("_after", "op", "replica", "expected_generation")


class Admission:
    """Slots by urgency: background leaves what is reserved for normal and critical work, normal what is for critical."""

    def __init__(self, total: int, critical_reserve: int = 0, normal_reserve: int = 0):
        if total <= 0 or critical_reserve < 0 or normal_reserve < 0 or critical_reserve + normal_reserve >= total:
            raise ValueError("reserves must be at least 0 and leave a slot to all")
        self.most = {"critical": total, "normal": total - critical_reserve, "background": total - critical_reserve - normal_reserve}
        self.used = 0

    def enter(self, kind: str, units: int = 1) -> bool:
        units = max(1, units)
        if self.used + units > self.most[kind]:
            return False
        self.used += units
        return True

    def leave(self, units: int = 1) -> None:
        self.used = max(0, self.used - max(1, units))


#: From which value on a store's state is critical or normal; below all, background (fixed values).
COMPACTION = {"l0_files": (20, 8), "l0_sublevels": (10, 4), "pending_bytes": (512 << 20, 64 << 20)}


def compaction_priority(stores: DataFrame) -> DataFrame:
    """critical, normal or background for each of stores (l0_files, l0_sublevels, pending_bytes, write_stalls)."""
    at_least = lambda k: [F.col(c) >= limits[k] for c, limits in COMPACTION.items()]
    critical, normal = F.col("write_stalls") > 0, F.lit(False)
    for c in at_least(0):
        critical = critical | c
    for c in at_least(1):
        normal = normal | c
    return stores.withColumn("priority", F.when(critical, "critical").when(normal, "normal").otherwise("background"))
