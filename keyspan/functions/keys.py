"""Names, regions, ordered binary keys, event ids and log markers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which part of the key space a prefix belongs to, tested in this order (fixed values).
KEYSPACES = (("/meta1", "meta1"), ("/meta2", "meta2"), ("/system", "system"), ("/mvcc/global/table", "table"), ("/local", "local"))


def canonical_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def canonical_region(c: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(c)), F.lit("")), F.lit("unknown"))


def ordered_int_key(c: Column) -> Column:
    """Eight bytes, as hex, that sort as the signed number does."""
    return F.lpad(F.hex(c.bitwiseXOR(F.lit(-(2**63)))), 16, "0")


def escaped_key(c: Column) -> Column:
    """Hex of binary c with each zero byte followed by ff, and the terminator 00 01."""
    digits = F.hex(c)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0))), lambda i: F.substr(digits, i * 2 + 1, F.lit(2)))
    return F.concat(F.array_join(F.transform(pairs, lambda p: F.when(p == "00", F.lit("00FF")).otherwise(p)), ""), F.lit("0001"))


def hex_key(c: Column) -> Column:
    return F.lower(F.hex(c))


def from_lookup(c: Column) -> Column:
    """Bytes of a key as a person writes it: `hex:` and digits, or plain text."""
    return F.when(F.startswith(c, F.lit("hex:")), F.unhex(F.substr(c, F.lit(5)))).otherwise(F.encode(c, "UTF-8"))


def keyspace(c: Column) -> Column:
    kind = F.lit("unknown")
    for prefix, name in reversed(KEYSPACES):
        kind = F.when(F.startswith(c, F.lit(prefix)), name).otherwise(kind)
    return kind


def event_id(*fields: Column) -> Column:
    """A stable id of an event's content."""
    return F.concat(F.lit("evt_"), F.sha1(F.to_json(F.struct(*(f.alias(f"f{k}") for k, f in enumerate(fields))), {"ignoreNullFields": "false"})))


def marker_kind(message: Column) -> Column:
    return F.substring_index(message, " ", 1)


def marker_fields(message: Column) -> Column:
    """`kind k=v k=v` as a map of its fields; of a repeated field the last value."""
    rest = F.regexp_replace(message, r"^\S+\s*", "")
    pairs = F.filter(F.split(rest, r"\s+"), lambda p: F.contains(p, F.lit("=")))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_replace(p, "^[^=]*=", "").alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def command_tag(kind: str, rows: int) -> str:
    """What a client is told about a finished statement."""
    return f"INSERT 0 {rows}" if kind == "INSERT" else f"{kind} {rows}"
