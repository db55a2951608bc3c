"""Reads: point, range, filtered and ordered scans; joins; aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: op, as a statement writes it
COMPARE = {"=": lambda c, v: c == v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v}
TURNED = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


def conjunction(predicates: Sequence[tuple]) -> Column:
    """All of (column, op, literal) or (literal, op, column); which side a column is on is told by F.col."""
    out = F.lit(True)
    for left, op, right in predicates:
        if isinstance(right, Column) and not isinstance(left, Column):
            left, op, right = right, TURNED[op], left
        out = out & COMPARE[op](left, right)
    return out


def point_lookup(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def range_scan(table: DataFrame, key: str, low=None, high=None, low_closed: bool = True, high_closed: bool = False) -> DataFrame:
    """Rows between two keys, either of which may be open; the bounds reach the file's own statistics."""
    if low is not None:
        table = table.where(F.col(key) >= low if low_closed else F.col(key) > low)
    if high is not None:
        table = table.where(F.col(key) <= high if high_closed else F.col(key) < high)
    return table


def ordered(table: DataFrame, key: str, by: Sequence[tuple[str, bool]] = (), limit: int | None = None) -> DataFrame:
    """Ordered by (column, descending) and then by key, so that ties and limits are settled."""
    order = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in by]
    table = table.orderBy(*order, F.col(key).asc())
    return table if limit is None else table.limit(limit)


def equi_join(left: DataFrame, right: DataFrame, on: tuple[str, str] | str, select: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Inner join on one pair of columns; select maps an output name to (side, column)."""
    l, r = left.alias("l"), right.alias("r")
    a, b = (on, on) if isinstance(on, str) else on
    return l.join(r, F.col(f"l.{a}") == F.col(f"r.{b}")).select(*(F.col(f"{side}.{c}").alias(name) for name, (side, c) in select.items()))


def aggregate(table: DataFrame, group: Sequence[str], measures: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """Group columns first, then the measures: (count, None) counts rows, (count, c) values, (sum, c) adds."""
    made = {"count": lambda c: F.count("*") if c is None else F.count(c), "sum": lambda c: F.sum(c)}
    found = [made[kind](c).alias(name) for name, (kind, c) in measures.items()]
    if not found:
        return table.select(*group).distinct()
    return table.groupBy(*group).agg(*found) if group else table.agg(*found)


def missing_from(required: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    return required.join(observed, list(on), "left_anti")


#: Values drawn for each slice of a key space; what comes to the driver is this times the slices.
DRAWN = 32


def slice_bounds(values: DataFrame, slices: int) -> list:
    """slices - 1 values or fewer that part the one column of `values` about evenly, from a bounded sample by hash."""
    (name,) = values.columns
    drawn = sorted({r[0] for r in values.where(F.col(name).isNotNull()).orderBy(F.xxhash64(name)).limit(slices * DRAWN).collect()})
    return sorted({drawn[len(drawn) * k // slices] for k in range(1, slices)}) if drawn else []


def slice_of(value: Column, bounds: Sequence, kind) -> Column:
    """How many of the sorted bounds are at or below a value, by bisection; 0 for null."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    listed = F.array(*(F.lit(b).cast(kind) for b in bounds))

    def further(at: Column, step: Column) -> Column:
        to = at + step
        return F.when((to <= len(bounds)) & (F.get(listed, to - 1) <= value), to).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def locate(keys: DataFrame, key: str, ranges: DataFrame, start: str = "start_key", end: str = "end_key", slices: int | None = None) -> DataFrame:
    """Each row of keys with the range that holds its key: start <= key < end, a null start or end is open.

    Ranges do not overlap, so a key's range is the one with the greatest start at or below it.
    That is a running maximum within slices of the key space; the greatest start of all earlier
    slices, one row for each slice, closes the gap between them, so no pair is ever formed that
    is not a match and no side needs to fit in memory.  A slice is a function of the key alone
    (bounds are drawn once), so results depend neither on how many slices there are nor on how
    exchanges are coalesced.  Equal keys are looked up once, so that a hot key is one row; its
    rows meet the answer in a join that adaptive execution splits.
    """
    from pyspark.sql import Window

    kind = keys.schema[key].dataType
    wanted = keys.select(F.col(key).alias("_at")).where("_at is not null").distinct()
    starts = ranges.select(F.col(start).cast(kind).alias("_at"), F.struct(*ranges.columns).alias("_range"))
    bounds = slice_bounds(wanted.union(starts.select("_at")), slices or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = slice_of(F.col("_at"), bounds, kind).alias("_slice")
    starts = starts.select("_at", "_range", part)
    both = wanted.select("_at", F.lit(None).cast(starts.schema["_range"].dataType).alias("_range"), part).unionByName(starts)
    here = Window.partitionBy("_slice").orderBy(F.col("_at").asc_nulls_first(), F.col("_range").isNull())
    seen = both.withColumn("_found", F.last("_range", ignorenulls=True).over(here)).where("_range is null")
    tops = starts.groupBy("_slice").agg(F.max_by("_range", F.struct("_at")).alias("_top"))
    every = keys.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_slice"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # one row for each slice
    before = every.join(tops, "_slice", "left").select("_slice", F.last("_top", ignorenulls=True).over(earlier).alias("_before"))
    found = seen.join(before, "_slice").select("_at", F.coalesce("_found", "_before").alias("_r"))
    holds = F.col("_r").isNotNull() & (F.col("_r")[start].isNull() | (F.col("_r")[start] <= F.col("_at"))) & (F.col("_r")[end].isNull() | (F.col("_at") < F.col("_r")[end]))
    answers = found.where(holds).alias("a")
    rows = keys.alias("k")
    return rows.join(answers, F.col(f"k.{key}") == F.col("a._at")).select("k.*", *(F.col("a._r")[c].alias(c) for c in ranges.columns))


def locate_one(value, ranges: DataFrame, start: str = "start_key", end: str = "end_key") -> DataFrame:
    """The range that holds one key; LookupError if none does."""
    found = ranges.where((F.col(start).isNull() | (F.col(start) <= F.lit(value))) & (F.col(end).isNull() | (F.lit(value) < F.col(end))))
    if found.isEmpty():
        raise LookupError(f"no range holds {value!r}")
    return found


def overlaps(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Whether two half-open spans meet; a null end is open."""
    return (end_b.isNull() | (start_a < end_b)) & (end_a.isNull() | (start_b < end_a))


def intersection(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> tuple[Column, Column]:
    return F.greatest(start_a, start_b), F.least(end_a, end_b)
