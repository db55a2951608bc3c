"""Inserts, upserts, conflicts, updates and deletes as changes of a table, all computed before any is stored.

A change is a pair of DataFrames: `versions` (the table's columns and a tombstone flag, to be
appended) and `returning` (the rows as a client sees them).  Checks that find a violation raise
before anything is written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyspan.errors import NotNullViolation, UniqueViolation


@dataclass
class Change:
    versions: DataFrame
    returning: DataFrame
    kind: str


def _change(kind: str, rows: DataFrame, gone: bool = False, returning: DataFrame | None = None) -> Change:
    return Change(rows.withColumn("tombstone", F.lit(gone)), rows if returning is None else returning, kind)


def duplicates(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of the columns, all of them set, that more than one row has."""
    return rows.dropna(subset=list(columns)).groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")


def collisions(new: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """New rows whose values of the columns, all set, a current row has."""
    return new.join(current.select(*columns).dropna(), list(columns), "left_semi")


def violations(added: DataFrame, current: DataFrame, pk: Sequence[str], columns: Sequence[str], replaced: DataFrame | None = None) -> DataFrame:
    """Values of the columns, all set, that an added row shares with a row of another key: an added one, or a current one that is not replaced.

    The current table is only probed with the added rows' values, so it is not dealt anew where
    these are few.
    """
    new = added.dropna(subset=list(columns))
    inside = new.groupBy(*columns).agg(F.count_distinct(F.struct(*pk)).alias("_n")).where("_n > 1").select(*columns)
    owner = new.select(*columns, F.struct(*pk).alias("_new"))
    met = current.select(*columns, F.struct(*pk).alias("_old")).join(owner, list(columns)).where(F.col("_new") != F.col("_old"))
    if replaced is not None:
        met = met.join(replaced.select(F.struct(*pk).alias("_old")), "_old", "left_anti")
    return inside.unionByName(met.select(*columns)).distinct()


def check_unique(added: DataFrame, current: DataFrame, pk: Sequence[str], uniques: Mapping[str, Sequence[str]], replaced: DataFrame | None = None) -> None:
    """Raise if added rows break a unique index; rows with a null there are free."""
    for name, columns in uniques.items():
        if not violations(added, current, pk, columns, replaced).isEmpty():
            raise UniqueViolation(f"a row with this value of {name} exists", constraint=name)


def check_not_null(rows: DataFrame, required: Sequence[str]) -> None:
    for c in required:
        if not rows.where(F.col(c).isNull()).isEmpty():
            raise NotNullViolation(f"column {c} needs a value", constraint=c)


def insert(current: DataFrame, new: DataFrame, pk: Sequence[str], uniques: Mapping[str, Sequence[str]] | None = None, table: str = "table", required: Sequence[str] = ()) -> Change:
    check_not_null(new, [*pk, *required])
    if not duplicates(new, pk).isEmpty() or not collisions(new, current, pk).isEmpty():
        raise UniqueViolation(f"a row with this key of {table} exists", constraint=f"{table}_pkey")
    check_unique(new, current, pk, uniques or {})
    return _change("INSERT", new.select(*current.columns))


def upsert(current: DataFrame, new: DataFrame, pk: Sequence[str], uniques: Mapping[str, Sequence[str]] | None = None) -> Change:
    """Whole rows replace those with their key or join them; columns that were not given are null."""
    check_not_null(new, pk)
    new = new.select(*(F.col(c) if c in new.columns else F.lit(None).cast(current.schema[c].dataType).alias(c) for c in current.columns))
    check_unique(new, current, pk, uniques or {}, replaced=new)
    return _change("UPSERT", new)


def on_conflict_do_nothing(current: DataFrame, new: DataFrame, target: Sequence[str], pk: Sequence[str], uniques: Mapping[str, Sequence[str]] | None = None, table: str = "table") -> Change:
    """New rows that share no target value with a current one; a null in the target never conflicts."""
    free = new.join(current.select(*target).dropna(), list(target), "left_anti").select(*current.columns)
    return insert(current, free, pk, uniques, table)


def merged(current: DataFrame, new: DataFrame, target: Sequence[str], assign: Mapping[str, Column | str]) -> DataFrame:
    """Current rows that new ones meet in the target, with columns assigned; `excluded.c` is the new row's value."""
    n = new.alias("excluded")
    c = current.alias("current")
    match = [F.col(f"current.{t}") == F.col(f"excluded.{t}") for t in target]
    value = lambda x: F.col(x) if isinstance(x, str) and x.startswith("excluded.") else x if isinstance(x, Column) else F.lit(x)
    return c.join(n, match).select(*((value(assign[k]) if k in assign else F.col(f"current.{k}")).alias(k) for k in current.columns))


def on_conflict_do_update(current: DataFrame, new: DataFrame, target: Sequence[str], pk: Sequence[str], assign: Mapping[str, Column | str], uniques: Mapping[str, Sequence[str]] | None = None, table: str = "table") -> Change:
    """Rows that conflict update the current row, whose key stays; the others are inserted."""
    changed = merged(current, new, target, assign)
    free = new.join(current.select(*target).dropna(), list(target), "left_anti").select(*current.columns)
    check_unique(free.unionByName(changed), current, pk, uniques or {}, replaced=changed)
    added = insert(current, free, pk, None, table)
    return _change("INSERT", changed.unionByName(added.returning))


def update(current: DataFrame, where: Column, assign: Mapping[str, object], pk: Sequence[str], uniques: Mapping[str, Sequence[str]] | None = None) -> Change:
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    hit = current.where(where)
    changed = hit.select(*((value(assign[c]).cast(current.schema[c].dataType) if c in assign else F.col(c)).alias(c) for c in current.columns))
    if uniques and any(set(cs) & set(assign) for cs in uniques.values()):
        check_unique(changed, current, pk, uniques, replaced=hit)
    return _change("UPDATE", changed)


def delete(current: DataFrame, where: Column) -> Change:
    return _change("DELETE", current.where(where), gone=True)


def index_view(table: DataFrame, columns: Sequence[str], pk: Sequence[str]) -> DataFrame:
    """Entries of a secondary index: its columns and the key, of rows that have all of them."""
    return table.select(*columns, *pk).dropna(subset=list(columns))


def index_changes(before: DataFrame, after: DataFrame, columns: Sequence[str], pk: Sequence[str]) -> DataFrame:
    """Entries that a change removes and adds: `op` is del or put."""
    old, new = index_view(before, columns, pk), index_view(after, columns, pk)
    return old.exceptAll(new).withColumn("op", F.lit("del")).unionByName(new.exceptAll(old).withColumn("op", F.lit("put")))


def index_lookup(candidates: DataFrame, table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows that own the entries with the candidates' values."""
    return table.join(candidates.select(*columns).dropna().distinct(), list(columns), "left_semi")
