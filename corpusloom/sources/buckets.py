"""Tables in buckets of their key: a change rewrites the buckets that it touches, and one commit is seen for all tables."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators import changes
from corpusloom.operators.filters import apply_filters, condition
from corpusloom.session import materialize

#: Commits that readers may still hold on to, and the age in seconds from which unfinished writes count as dead, when cleaning.
KEPT_COMMITS, DEAD_AFTER = 2, 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed in between."""


class Folder:
    """Files below a path of any store that Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(name))) if self.fs.exists(self._at(name)) else []

    def changed_at(self, name: str) -> float:
        return self.fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def read(self, name: str) -> str:
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Whether the file is there now with the text, and was not before: it is whole from the moment it has its name."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self.fs.create(self._at(draft), False)
        stream.write(bytearray(text.encode()))
        stream.close()
        made = not self.fs.exists(self._at(name)) and self.fs.rename(self._at(draft), self._at(name))
        if not made:
            self.delete(draft)
        return made

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


@dataclass
class BucketStore:
    """Tables that share a key, each in so many buckets of the key's hash.

    A change reads and writes only the buckets of its keys, into files of its own, and then adds one small commit file that says, for
    all tables, where each bucket is: readers see all of a change or nothing. Writers that meet are told by the commit's
    number, and the later one does its change again. A null key is a key like others. New columns may come with a change;
    rows that lack them have null.
    """

    spark: SparkSession
    path: str
    key: str = "document_id"
    tables: tuple[str, ...] = ("rows",)
    buckets: int = 64
    attempts: int = 5

    def __post_init__(self) -> None:
        self.folder = Folder(self.spark, self.path)
        self.buckets = self.state().get("buckets", self.buckets)

    # Commits

    def commits(self) -> list[int]:
        return [int(n[:-5]) for n in self.folder.names("commits") if n.endswith(".json")]

    def state(self, version: int | None = None) -> dict:
        """The commit of that number, by default the last; empty before the first."""
        found = self.commits()
        if version is None and not found:
            return {}
        if version is not None and version not in found:
            raise ValueError(f"no commit {version} at {self.path}")
        return json.loads(self.folder.read(f"commits/{version if version is not None else found[-1]:012d}.json"))

    def _commit(self, before: dict, tables: dict, mark: tuple[str, int] | None) -> int:
        n = before.get("version", -1) + 1
        marks = {**before.get("marks", {}), **({mark[0]: mark[1]} if mark else {})}
        said = {"version": n, "buckets": self.buckets, "key": self.key, "tables": tables, "marks": marks}
        if not self.folder.create(f"commits/{n:012d}.json", json.dumps(said)):
            raise Conflict(f"commit {n} at {self.path} is there already")
        return n

    def done(self, mark: tuple[str, int]) -> bool:
        """Whether a batch of that stream, or a later one, is committed."""
        return self.state().get("marks", {}).get(mark[0], -1) >= mark[1]

    # Reading

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _rows(self, table: str, state: dict, only: set[int] | None = None) -> DataFrame | None:
        of = state.get("tables", {}).get(table)
        if of is None:
            return None
        schema = StructType.fromJson(of["schema"])
        paths = [f"{self.path}/data/{table}/{write}/bucket={b}" for b, write in of["files"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str | None = None, version: int | None = None) -> DataFrame | None:
        """A table as of a commit, by default the last; None before its first rows."""
        return self._rows(table or self.tables[0], self.state(version))

    def of_keys(self, keys: DataFrame, table: str | None = None) -> DataFrame | None:
        """The rows of the keys: only their buckets are read."""
        touched = {r["b"] for r in keys.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect()}
        rows = self._rows(table or self.tables[0], self.state(), touched)
        return rows if rows is None else self._matching(rows, keys, "left_semi")

    def _matching(self, rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col(self.key).alias("_key")).distinct()
        return rows.join(keys, F.col(self.key).eqNullSafe(F.col("_key")), how)

    # Changes

    def _write(self, table: str, rows: DataFrame, touched: set[int]) -> tuple[dict, dict[int, str]]:
        """Writes the touched buckets anew: their schema, and where each bucket that has rows is. A bucket with many rows is several files."""
        write = uuid.uuid4().hex
        put = rows.withColumn("bucket", self.bucket(F.col(self.key))).hint("rebalance", "bucket").sortWithinPartitions("bucket", self.key)
        put.write.partitionBy("bucket").parquet(f"{self.path}/data/{table}/{write}")
        there = {int(n[7:]) for n in self.folder.names(f"data/{table}/{write}") if n.startswith("bucket=")}
        return json.loads(rows.schema.json()), {b: write for b in touched & there}

    def _change(self, keys: DataFrame, after: dict, mark: tuple[str, int] | None) -> int:
        """One commit of after(old rows of the touched buckets) for each table that it has; the others stay."""
        touched = {r["b"] for r in keys.select(self.bucket(F.col(self.key)).alias("b")).distinct().collect()}
        for left in reversed(range(self.attempts)):
            before = self.state()
            if mark and before.get("marks", {}).get(mark[0], -1) >= mark[1]:
                return before["version"]
            tables = dict(before.get("tables", {}))
            for table, change in after.items():
                old = self._rows(table, before, touched)
                rows = change(old)
                if rows is not None:
                    schema, files = self._write(table, rows, touched)
                    stay = {b: w for b, w in tables.get(table, {}).get("files", {}).items() if int(b) not in touched}
                    tables[table] = {"schema": schema, "files": {**stay, **{str(b): w for b, w in files.items()}}}
            try:
                return self._commit(before, tables, mark)
            except Conflict:
                if not left:
                    raise
        raise AssertionError

    def change(self, keys: DataFrame, after: dict[str, Callable[[DataFrame | None], DataFrame | None]], mark: tuple[str, int] | None = None) -> int:
        """One commit in which after[table] makes the new rows of the buckets of keys from all their old ones, None before
        the first. It is called again when another writer was faster."""
        return self._change(keys, after, mark)

    def replace(self, batch: dict[str, DataFrame], gone: DataFrame | None = None, mark: tuple[str, int] | None = None) -> int:
        """All rows, in all tables, of the batch's keys and of gone's are replaced by the batch's. Returns the commit's number.

        mark (stream, batch number): a batch that is committed is not put in again.
        """
        batch = {t: materialize(rows, f"new_{t}") for t, rows in batch.items()}
        named = [rows.select(self.key) for rows in [*batch.values(), *([gone] if gone is not None else [])]]
        keys = materialize(reduce(DataFrame.union, named).distinct(), "changed_keys")

        def put(table: str):
            def change(old: DataFrame | None) -> DataFrame | None:
                new = batch.get(table)
                kept = None if old is None else self._matching(old, keys, "left_anti")
                return new if kept is None else kept if new is None else kept.unionByName(new, allowMissingColumns=True)

            return change

        return self._change(keys, {t: put(t) for t in self.tables}, mark)

    def upsert(self, rows: DataFrame, row_keys: list[str], table: str | None = None, order: str | None = None, mark: tuple[str, int] | None = None) -> int:
        """Rows replace those of equal row_keys and bucket key; of several the one of the largest order stays. row_keys have to hold the store's key."""
        if self.key not in row_keys:
            raise ValueError(f"the row's keys have to hold {self.key}")
        rows = materialize(rows, "new_rows")
        merge = lambda old: changes.merge_by_key(rows.limit(0) if old is None else old, rows, row_keys, order)
        return self._change(rows, {table or self.tables[0]: merge}, mark)

    def delete(self, keys: DataFrame) -> int:
        """The keys' rows go from all tables."""
        return self.replace({}, keys.select(self.key))

    def delete_where(self, filters: dict, table: str | None = None) -> int | None:
        """Rows of a table that the filters match go; nothing happens for an empty filter."""
        table = table or self.tables[0]
        old = self.read(table)
        if old is None or not filters:
            return None
        hit = materialize(apply_filters(old, filters).select(self.key).distinct(), "doomed")
        matched = reduce(lambda a, b: a & b, [F.coalesce(condition(n, v), F.lit(False)) for n, v in filters.items()])
        return self._change(hit, {table: lambda rows: rows.filter(~matched)}, None)

    def drop(self) -> int | None:
        """All rows go; the tables and their history stay."""
        before = self.state()
        return self._commit(before, {t: {**of, "files": {}} for t, of in before["tables"].items()}, None) if before else None

    # Upkeep

    def clean(self, keep: int = KEPT_COMMITS, dead_after: float = DEAD_AFTER) -> int:
        """Deletes commits but the last keep, buckets that only they name, and writes older than dead_after seconds that no commit names.
        Returns how many folders went."""
        found = self.commits()
        for n in found[: max(0, len(found) - keep)]:
            self.folder.delete(f"commits/{n:012d}.json")
        named = {(t, w, int(b)) for n in found[-keep:] for t, of in self.state(n)["tables"].items() for b, w in of["files"].items()}
        whole = {(t, w) for t, w, _ in named}
        gone, since = 0, time.time() - dead_after
        for t in self.folder.names("data"):
            for w in self.folder.names(f"data/{t}"):
                if (t, w) not in whole:
                    if self.folder.changed_at(f"data/{t}/{w}") <= since:
                        self.folder.delete(f"data/{t}/{w}")
                        gone += 1
                    continue
                for b in self.folder.names(f"data/{t}/{w}"):
                    if b.startswith("bucket=") and (t, w, int(b[7:])) not in named:
                        self.folder.delete(f"data/{t}/{w}/{b}")
                        gone += 1
        return gone
