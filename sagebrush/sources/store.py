"""Tables in folders that change in place, and batches that change several of them at once.

A table is a folder of whole versions and of changes after them. A change is written as it comes, so that it costs bytes
in proportion to its rows; readers merge the changes since the last whole version, and compaction writes the next
one. A version counts once Spark has marked it whole, a change once its own mark is there, which is made last. So a job
that fails leaves the table as it was.

A ledger makes changes of several tables count together: those that belong to a batch count once the ledger names the
batch, which is one file, made at once or not at all. A batch that the ledger names isn't done again.

One writer at a time; readers need no lock. The version before the last is kept for readers that have begun on it.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Changes after which a table is compacted.
MOST_CHANGES = 16
NAME = re.compile(r"[A-Za-z0-9_.-]+")


class Folder:
    """A folder of any of Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self.jvm_path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def found(self, pattern: str) -> list[str]:
        """Paths below the folder that fit a pattern, relative to it."""
        paths = [s.getPath() for s in self.fs.globStatus(self.jvm_path(f"{self.path}/{pattern}")) or []]
        depth = pattern.count("/") + 1
        return sorted("/".join(p.toUri().getPath().split("/")[-depth:]) for p in paths)

    def mark(self, name: str) -> bool:
        """Make an empty file; False if it is there."""
        return self.fs.createNewFile(self.jvm_path(f"{self.path}/{name}"))

    def remove(self, name: str) -> None:
        self.fs.delete(self.jvm_path(f"{self.path}/{name}"), True)


class Delta(NamedTuple):
    """A change of a table: its number, append, upsert or delete, the columns of its key, and its batch if it has one."""

    number: int
    kind: str
    key: tuple[str, ...]
    batch: str


class Store:
    """A table in a folder, parted by ``partitions``. ``schema`` is DDL; a store that was never written has no rows.

    ``ledger`` tells which batches count; changes without a batch count as soon as they are whole.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, *partitions: str, ledger: Ledger | None = None):
        self.spark, self.path, self.schema, self.partitions = spark, path.rstrip("/"), StructType.fromDDL(schema), partitions
        self.folder, self.ledger = Folder(spark, path), ledger

    def versions(self) -> list[int]:
        """Whole versions, oldest first."""
        return sorted(int(p.split("/")[0].removeprefix("v=")) for p in self.folder.found("v=*/_SUCCESS"))

    def version(self, v: int) -> str:
        return f"{self.path}/v={v:08d}"

    def change(self, number: int) -> str:
        return f"{self.path}/d={number:08d}"

    def all_changes(self) -> list[Delta]:
        """Whole changes after the last version, oldest first, those of batches that don't count included."""
        last, out = max(self.versions(), default=0), []
        for p in self.folder.found("d=*/_change;*"):
            at, mark = p.split("/")
            _, kind, key, batch = mark.split(";")
            if (n := int(at.removeprefix("d="))) > last:
                out.append(Delta(n, kind, tuple(filter(None, key.split("+"))), batch))
        return sorted(out)

    def changes(self) -> list[Delta]:
        """Those that count."""
        done = self.ledger.batches() if self.ledger else set()
        return [d for d in self.all_changes() if not d.batch or d.batch in done]

    def next_number(self) -> int:
        """A number that no version and no change has, whole or not."""
        return 1 + max((int(p[2:]) for p in (*self.folder.found("v=*"), *self.folder.found("d=*"))), default=0)

    def rows_of(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path).select(*self.schema.names)

    def read(self) -> DataFrame:
        """The rows as the changes leave them: of one key only those since the last change of it.

        Versions and changes are united and joined once with the last change of each changed key. Keys compare null-safe.
        """
        known, changes = self.versions(), self.changes()
        rows = self.rows_of(self.version(known[-1])) if known else self.spark.createDataFrame([], self.schema)
        if not changes:
            return rows
        rows = rows.withColumn("_change", F.lit(0))
        for d in changes:
            if d.kind != "delete":
                rows = rows.unionByName(self.rows_of(self.change(d.number)).withColumn("_change", F.lit(d.number)))
        cuts = None
        for d in changes:
            if d.kind != "append":
                keys = self.spark.read.schema(StructType([self.schema[k] for k in d.key])).parquet(self.change(d.number))
                keys = keys.select(*(F.col(k).alias(f"_key_{k}") for k in d.key), F.lit(d.number).alias("_cut"))
                cuts = keys if cuts is None else cuts.union(keys)
        if cuts is not None:
            names = [c for c in cuts.columns if c != "_cut"]
            cuts = cuts.groupBy(*names).agg(F.max("_cut").alias("_cut"))
            same = [F.col(n.removeprefix("_key_")).eqNullSafe(F.col(n)) for n in names]
            rows = rows.join(cuts, same, "left").filter(F.col("_change") >= F.coalesce("_cut", F.lit(0)))
        return rows.select(*self.schema.names)

    def stage(self, kind: str, df: DataFrame, key: tuple[str, ...] = (), batch: str = "") -> None:
        """Write a change. With a batch, it counts once the ledger names the batch."""
        known = next((d.key for d in self.all_changes() if d.key), key)
        if key and known != key:
            self.compact()
        fields = [self.schema[k] for k in key] if kind == "delete" else self.schema.fields
        number = self.next_number()
        writer = df.select(*(F.col(f.name).cast(f.dataType) for f in fields)).write.mode("overwrite")
        (writer if kind == "delete" else writer.partitionBy(*self.partitions)).parquet(self.change(number))
        self.folder.mark(f"d={number:08d}/_change;{kind};{'+'.join(key)};{batch}")
        if not batch:
            self.tidy()

    def tidy(self) -> None:
        if len(self.changes()) >= MOST_CHANGES:
            self.compact()

    def compact(self) -> None:
        """Write the rows as the next version, without changes."""
        self.replace(self.read())

    def forget(self, batch: str) -> None:
        """Remove what an attempt at a batch has left that the ledger doesn't name."""
        for d in self.all_changes():
            if d.batch == batch and (self.ledger is None or batch not in self.ledger.batches()):
                self.folder.remove(f"d={d.number:08d}")

    def append(self, df: DataFrame) -> None:
        """Add rows; those that are there are not written again."""
        self.stage("append", df)

    def replace(self, df: DataFrame) -> None:
        """Write ``df`` as the next version; versions older than the last one, and the changes before it, are removed."""
        known, old = self.versions(), self.all_changes()
        # A version that was never finished is written over.
        number = 1 + max([*known, *(d.number for d in old)], default=0)
        df.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).write.mode("overwrite").partitionBy(*self.partitions).parquet(self.version(number))
        for v in known[:-1]:
            self.folder.remove(f"v={v:08d}")
        for p in self.folder.found("d=*"):
            if int(p[2:]) < (known[-1] if known else 0):
                self.folder.remove(p)

    def insert_absent(self, df: DataFrame, *key: str) -> None:
        """Add the rows whose key isn't there yet; of new rows with one key one is added. Done twice, it changes nothing."""
        self.append(self.absent(df, *key))

    def absent(self, df: DataFrame, *key: str) -> DataFrame:
        return df.dropDuplicates(list(key)).join(self.read().select(*key), list(key), "left_anti")

    def upsert(self, df: DataFrame, *key: str) -> None:
        """Add rows, instead of those with their keys."""
        self.stage("upsert", df, key)

    def delete(self, keys: DataFrame, *key: str) -> int:
        """Remove the rows with these keys; how many there were."""
        keys = keys.select(*key).distinct()
        gone = self.read().join(keys, list(key), "left_semi").count()
        if gone:
            self.stage("delete", keys, key)
        return gone

    def clear(self) -> int:
        """Remove all rows; how many there were."""
        n = self.read().count()
        self.replace(self.spark.createDataFrame([], self.schema))
        return n


class Ledger:
    """The batches that count: one file each in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, Folder(spark, path)

    def batches(self) -> set[str]:
        return {p.removeprefix("batch;") for p in self.folder.found("batch;*")}

    def commit(self, batch: str, changes: list[tuple[Store, str, DataFrame, tuple[str, ...]]]) -> bool:
        """Make changes (store, kind, rows, key) count together, and once; False if the batch has counted before.

        Stores must have this ledger. What a stopped attempt has left is removed first; it never counts by itself.
        """
        if not NAME.fullmatch(batch):
            raise ValueError(f"a batch is named by letters, digits and ._-, not {batch!r}")
        if batch in self.batches():
            return False
        for store, *_ in changes:
            store.forget(batch)
        for store, kind, df, key in changes:
            store.stage(kind, df, key, batch)
        if not self.folder.mark(f"batch;{batch}"):
            return False
        for store, *_ in changes:
            store.tidy()
        return True
