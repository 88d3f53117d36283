"""A repository as a Spark data source.

``spark.read.format("repository").option("table", "files").load(folder)`` plans one
partition for each range of commits, named by their ids, and hands filters on
oid, path, blob_sha and size to git, so that only these commits and paths are listed
and only these blobs read.  The folder must lie where the driver and all executors see it.

Options: ``table`` (commits, files or blobs), ``start`` (any name git knows, or
``--all``), ``limit`` (newest commits) and ``commits_per_partition``.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

from ..session import ship_package
from . import repository

FILES = "oid string, path string, blob_sha string, size long"
SCHEMAS = {"commits": repository.COMMITS, "files": FILES, "blobs": FILES + ", content binary"}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def register(spark: SparkSession) -> None:
    """Make the format ``repository`` known to a session and let filters reach it."""
    ship_package(spark)
    spark.dataSource.register(Repository)
    spark.conf.set(PUSHDOWN, "true")


@dataclass
class Commits(InputPartition):
    """A range of commits by their ids."""

    oids: list[str] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(tuple(self.oids))


class Repository(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def _table(self) -> str:
        table = self.options.get("table", "commits")
        if table not in SCHEMAS:
            raise ValueError(f"table must be one of {', '.join(SCHEMAS)}: {table}")
        return table

    def schema(self) -> str:
        return SCHEMAS[self._table()]

    def reader(self, schema) -> RepositoryReader:
        limit = self.options.get("limit")
        return RepositoryReader(repository.discover(self.options["path"]), self._table(), self.options.get("start", "HEAD"), int(limit) if limit is not None else None, int(self.options.get("commits_per_partition", 1000)))


class RepositoryReader(DataSourceReader):
    def __init__(self, root: str, table: str, start: str, limit: int | None, per_partition: int):
        self.root, self.table, self.start, self.limit, self.per_partition = root, table, start, limit, per_partition
        self.values: dict[str, set] = {}  # column to its allowed values
        self.prefixes: list[str] = []  # all must start the path
        self.largest: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        exact = {"commits": ("oid",), "files": ("oid", "path", "blob_sha"), "blobs": ("oid", "path", "blob_sha")}[self.table]
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in exact and isinstance(f, EqualTo | In):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.values[column] = self.values.get(column, wanted) & wanted
            elif column == "path" and self.table != "commits" and isinstance(f, StringStartsWith):
                self.prefixes.append(f.value)
            elif column == "size" and self.table != "commits" and isinstance(f, LessThan | LessThanOrEqual):
                bound = f.value - 1 if isinstance(f, LessThan) else f.value
                self.largest = bound if self.largest is None else min(self.largest, bound)
            else:
                yield f

    def partitions(self) -> list[Commits]:
        oids = repository.commit_ids(self.root, self.start, self.limit)
        if "oid" in self.values:
            oids = [oid for oid in oids if oid in self.values["oid"]]
        if any(not v for v in self.values.values()):
            oids = []
        return [Commits(oids[at : at + self.per_partition]) for at in range(0, len(oids), self.per_partition)] or [Commits()]

    def read(self, partition: Commits) -> Iterator[pa.RecordBatch]:
        if not partition.oids:
            return
        if self.table == "commits":
            rows = repository.commit_rows(repository.git(self.root, "log", "--no-walk=unsorted", "-z", f"--format={repository.FIELDS}", "--stdin", stdin="\n".join(partition.oids).encode()))
            names = ("oid", "short_id", "message", "author", "ts", "parents")
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = (pa.string(),) * 4 + (pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))
            return
        for oid in partition.oids:
            rows = self._files(oid)
            if rows and self.table == "files":
                yield self._batch(rows)
            elif rows:
                yield from self._contents(rows)

    def _files(self, oid: str) -> list[dict]:
        """The wanted files of one commit; git itself goes only into the folders that can hold them."""
        if "path" in self.values:
            specs = sorted(p for p in self.values["path"] if p)
        else:
            folder = os.path.dirname(max(self.prefixes, key=len, default=""))
            specs = [folder + "/"] if folder else []
        if "path" in self.values and not specs:
            return []
        listed = repository.git(self.root, "--literal-pathspecs", "ls-tree", "-r", "-l", "-z", "--full-tree", oid, "--", *specs)
        return [row for row in repository.tree_rows(oid, listed) if self._wanted(row)]

    def _wanted(self, row: dict) -> bool:
        own = all(row[c] in v for c, v in self.values.items())
        return own and all(row["path"].startswith(p) for p in self.prefixes) and (self.largest is None or row["size"] <= self.largest)

    def _contents(self, rows: list[dict]) -> Iterator[pa.RecordBatch]:
        with subprocess.Popen(["git", "-C", self.root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE) as server:
            for row in rows:
                server.stdin.write(row["blob_sha"].encode() + b"\n")
                server.stdin.flush()
                head = server.stdout.readline().split()
                body = server.stdout.read(int(head[2]))
                server.stdout.read(1)
                yield self._batch([row | {"content": body}])
            server.stdin.close()

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        fields = [("oid", pa.string()), ("path", pa.string()), ("blob_sha", pa.string()), ("size", pa.int64())]
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields + ([("content", pa.binary())] if self.table == "blobs" else [])))
