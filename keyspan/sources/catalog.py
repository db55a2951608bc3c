"""Table descriptions, kept as JSON beside the data."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from keyspan.errors import SqlError, UndefinedColumn, UndefinedTable

#: Column types of the strict dialect (fixed values).
TYPES = {"INT": T.LongType(), "STRING": T.StringType(), "BYTES": T.BinaryType()}
#: What the planner assumes of a table without statistics (fixed values).
DEFAULT_ROWS, DEFAULT_BYTES = 1000, 256


@dataclass
class Index:
    name: str
    columns: list[str]
    unique: bool = False


@dataclass
class Table:
    name: str
    columns: dict[str, str]
    pk: list[str]
    nullable: list[str] = field(default_factory=list)
    indexes: list[Index] = field(default_factory=list)
    rows: int = DEFAULT_ROWS
    row_bytes: int = DEFAULT_BYTES
    placement: dict | None = None
    id: int = 0

    def __post_init__(self):
        self.name = canonical(self.name)
        self.columns = {canonical(c): t.upper() for c, t in self.columns.items()}
        self.pk, self.nullable = [canonical(c) for c in self.pk], [canonical(c) for c in self.nullable]
        if not self.columns or any(t not in TYPES for t in self.columns.values()):
            raise SqlError(f"table {self.name} has a column of an unknown type", "42704")
        if not self.pk or any(c not in self.columns for c in self.pk) or set(self.pk) & set(self.nullable):
            raise SqlError(f"the key of {self.name} must be columns that have values", "42P16")
        for index in self.indexes:
            index.columns = [canonical(c) for c in index.columns]
            if not index.columns or any(c not in self.columns for c in index.columns):
                raise UndefinedColumn(f"index {index.name} of {self.name} has an unknown column")

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c, TYPES[t], c in self.nullable) for c, t in self.columns.items()])

    @property
    def required(self) -> list[str]:
        return [c for c in self.columns if c not in self.nullable]

    @property
    def uniques(self) -> dict[str, list[str]]:
        return {i.name: i.columns for i in self.indexes if i.unique}

    def index_by_columns(self, columns: Sequence[str]) -> Index | None:
        """The unique index on exactly these columns in this order."""
        return next((i for i in self.indexes if i.unique and i.columns == [canonical(c) for c in columns]), None)


def canonical(name: str) -> str:
    return name.strip().lower()


class Catalog:
    def __init__(self, tables: Sequence[Table] = ()):
        self._tables: dict[str, Table] = {}
        for t in tables:
            self.add(t)

    def add(self, table: Table) -> None:
        if table.name in self._tables:
            raise SqlError(f"table {table.name} exists", "42P07")
        table.id = table.id or max((t.id for t in self._tables.values()), default=0) + 1
        self._tables[table.name] = table

    def resolve(self, name: str) -> Table:
        try:
            return self._tables[canonical(name)]
        except KeyError:
            raise UndefinedTable(f"table {name} is not known") from None

    def tables(self) -> list[Table]:
        return sorted(self._tables.values(), key=lambda t: t.id)

    def to_json(self) -> str:
        return json.dumps([asdict(t) for t in self.tables()], indent=1)

    @classmethod
    def from_json(cls, text: str) -> Catalog:
        return cls([Table(**{**t, "indexes": [Index(**i) for i in t["indexes"]]}) for t in json.loads(text)])


def load_or_seed(spark: SparkSession, path: str, seed: Sequence[Table]) -> Catalog:
    """The stored catalog; the seed is stored first if there is none."""
    from keyspan.sources.store import Folder

    folder = Folder(spark, path)
    if not folder.exists("catalog.json"):
        folder.create("catalog.json", Catalog(seed).to_json())
    return Catalog.from_json(folder.read("catalog.json"))


def from_views(spark: SparkSession, tables: Mapping[str, Sequence[str]]) -> Catalog:
    """A catalog of the session's views, given their keys."""
    kinds = {"bigint": "INT", "int": "INT", "smallint": "INT", "binary": "BYTES"}
    out = Catalog()
    for name, pk in tables.items():
        columns = {c: kinds.get(t, "STRING") for c, t in spark.table(name).dtypes}
        out.add(Table(name, columns, list(pk), [c for c in columns if c not in pk]))
    return out
