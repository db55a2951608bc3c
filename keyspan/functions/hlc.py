"""Hybrid logical timestamps as struct columns (wall, logical); Spark orders them field by field."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAST_LOGICAL = 4_294_967_295


def stamp(wall, logical=0) -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)
    return F.struct(as_column(wall).cast("long").alias("wall"), as_column(logical).cast("long").alias("logical"))


def is_zero(t: Column) -> Column:
    return (t["wall"] == 0) & (t["logical"] == 0)


def next_tick(t: Column) -> Column:
    full = t["logical"] >= LAST_LOGICAL
    return stamp(F.when(full, t["wall"] + 1).otherwise(t["wall"]), F.when(full, 0).otherwise(t["logical"] + 1))


def previous_tick(t: Column) -> Column:
    """The tick before; zero stays zero."""
    wall = F.when((t["logical"] == 0) & (t["wall"] > 0), t["wall"] - 1).otherwise(t["wall"])
    logical = F.when(t["logical"] > 0, t["logical"] - 1).when(t["wall"] > 0, LAST_LOGICAL).otherwise(0)
    return stamp(wall, logical)


def minus_wall(t: Column, delta: Column) -> Column:
    """Wall time less delta, zero where that is not above zero."""
    gone = (delta > 0) & (t["wall"] <= delta)
    return stamp(F.when(gone, 0).otherwise(t["wall"] - delta), F.when(gone, 0).otherwise(t["logical"]))


def gap(later: Column, earlier: Column) -> Column:
    """Distance in wall time, or in logical ticks within one wall time; zero where later is not later."""
    same = later["wall"] == earlier["wall"]
    distance = F.when(same, stamp(F.lit(0), later["logical"] - earlier["logical"])).otherwise(stamp(later["wall"] - earlier["wall"], F.lit(0)))
    return F.when(later > earlier, distance).otherwise(stamp(0, 0))
