"""Tables as append-only logs of row versions, committed by manifests that only one writer can create.

A commit's rows are written first; then the manifest with the next number is created, which
fails if another writer was faster.  Readers see the files that manifests name, so a commit is
seen whole or not at all, and an older manifest number is a snapshot.  Two writers get in each
other's way only where one wrote a key that the other writes, or a table that it read.  Folders
may be in any file system Spark can open.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Set

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyspan.errors import Retry
from keyspan.operators import mvcc
from keyspan.sources.catalog import Table


#: Every so many commits a manifest lists all files, so that a reader never goes back further.
FULL_EVERY = 64


class Folder:
    """Small text files in a folder of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark._jvm
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(""))) if self.exists() else []

    def create(self, name: str, text: str) -> bool:
        """Create the file, unless it exists: False then."""
        try:
            out = self._fs.create(self._at(name), False)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Folder(spark, f"{self.path}/manifests")

    def head(self) -> int:
        """The number of the last commit; 0 if there is none."""
        return max((int(n.split(".")[0]) for n in self.manifests.names() if n.endswith(".json") and not n.startswith(".")), default=0)

    def _read(self, number: int) -> dict:
        return json.loads(self.manifests.read(f"{number:012d}.json"))

    def _log_schema(self, table: Table) -> T.StructType:
        fields = [T.StructField(f.name, f.dataType, True) for f in table.schema.fields]
        return T.StructType([*fields, T.StructField("tombstone", T.BooleanType()), T.StructField("wall", T.LongType()), T.StructField("logical", T.IntegerType())])

    def _paths(self, name: str, number: int) -> list[str]:
        """A table's files up to a commit, from the last one that lists them all."""
        paths: list[str] = []
        while number:
            manifest = self._read(number)
            if "all" in manifest:
                return manifest["all"].get(name, []) + paths
            paths = manifest["files"].get(name, []) + paths
            if name in manifest.get("whole", []):
                break  # this commit holds the table as it was
            number -= 1
        return paths

    def log(self, table: Table, at: int | None = None) -> DataFrame:
        """All versions of a table up to a commit; versions of a commit have its number as their time."""
        paths, schema = self._paths(table.name, self.head() if at is None else at), self._log_schema(table)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)

    def current(self, table: Table, at: int | None = None) -> DataFrame:
        return mvcc.latest(self.log(table, at), table.pk, ["wall", "logical"]).select(*table.columns)

    def _names(self, number: int) -> set[str]:
        """Tables with files up to a commit."""
        names: set[str] = set()
        while number:
            manifest = self._read(number)
            names |= set(manifest["files"])
            if "all" in manifest:
                return names | set(manifest["all"])
            number -= 1
        return names

    def _between(self, seen: int, head: int) -> dict[str, list[str]]:
        """Files of each table that commits after `seen` added; a compaction adds nothing new."""
        added: dict[str, list[str]] = {}
        for number in range(seen + 1, head + 1):
            manifest = self._read(number)
            for name, paths in manifest["files"].items():
                if name not in manifest.get("whole", []):
                    added.setdefault(name, []).extend(paths)
        return added

    def _check(self, versions: Mapping[str, DataFrame], added: Mapping[str, list[str]], tables: Mapping[str, Table], read: Set[str]) -> None:
        """Retry if commits since wrote a table that was read, a key that is written, or a table with a unique index that is written."""
        for name, paths in added.items():
            if name in read:
                raise Retry(f"another transaction has changed {name}, which was read")
            if name not in versions:
                continue
            table = tables.get(name)
            if table is None or table.uniques:
                raise Retry(f"another transaction has changed {name}")
            theirs = self.spark.read.schema(self._log_schema(table)).parquet(*(f"{self.path}/{p}" for p in paths)).select(*table.pk)
            if not versions[name].select(*table.pk).join(theirs, list(table.pk), "left_semi").isEmpty():
                raise Retry(f"another transaction has written the same key of {name}")

    def commit(self, versions: Mapping[str, DataFrame], seen: int, whole: tuple[str, ...] = (), tables: Mapping[str, Table] | None = None, read: Set[str] = frozenset()) -> int:
        """Store versions (columns and tombstone) of tables in one commit.

        Commits that came after `seen` are no hindrance unless they wrote what was read or is
        written here: then it is Retry.  A table that is written as a whole must be as it was.
        """
        while True:
            head = self.head()
            if head > seen:
                added = self._between(seen, head)
                if any(name in added for name in whole):
                    raise Retry("another transaction committed first")
                self._check(versions, added, tables or {}, read)
            number, files = head + 1, {}
            for name, rows in versions.items():
                place = f"data/{name}/{number:012d}-{uuid.uuid4().hex}"
                stamped = rows if "wall" in rows.columns else rows.withColumns({"wall": F.lit(number).cast("long"), "logical": F.lit(0)})
                stamped.write.parquet(f"{self.path}/{place}")
                files[name] = [place]
            manifest = {"files": files, "whole": list(whole)}
            if number % FULL_EVERY == 0:
                names = self._names(head) | set(files)
                manifest["all"] = {n: files[n] if n in whole else self._paths(n, head) + files.get(n, []) for n in sorted(names)}
            if self.manifests.create(f"{number:012d}.json", json.dumps(manifest)):
                return number

    def compact(self, table: Table, partitions: int | None = None) -> int:
        """Rewrite a table as it is, in key order, so that scans by key skip files; older snapshots stay readable."""
        seen = self.head()
        log = mvcc.latest(self.log(table, seen), table.pk, ["wall", "logical"])
        n = [partitions] if partitions else []
        return self.commit({table.name: log.repartitionByRange(*n, *table.pk).sortWithinPartitions(*table.pk)}, seen, whole=(table.name,))
