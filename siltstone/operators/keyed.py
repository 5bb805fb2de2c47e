"""Keyed tables as a log of changes: an append writes the new rows only, and two writers never lose an update.

A table is a folder. ``data`` holds one folder of Parquet files per change, its rows in buckets of their key's hash; ``log`` holds
one small file per version that names the change. A change is checked against a version, written, and committed by
creating the next version's file, which the file system lets only one writer do; the others fail and leave no trace. A
reader takes the last compacted change and the changes after it. A lookup by key reads one bucket.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructType

from siltstone.errors import ConflictError, IntegrityError, NotFoundError, ValidationError
from siltstone.operators.store import latest_rows
from siltstone.session import task_count

_OWN = ("_generation", "_removed", "_change", "_bucket")


class _Files:
    """Small files below one folder, by the file system Spark reads it with."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm = spark.sparkContext._jvm
        self.folder = folder
        self.system = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self, folder: str) -> list[str]:
        place = self._path(folder)
        return sorted(x.getPath().getName() for x in self.system.listStatus(place)) if self.system.exists(place) else []

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False when there is one already."""
        try:
            stream = self.system.create(self._path(name), False)
        except Exception as problem:  # the bridge has one class for all errors of the other side
            if self.system.exists(self._path(name)):
                return False
            raise problem
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def read(self, name: str, waits: int = 20) -> str:
        """A file's text. A file that its writer has not closed yet is waited for."""
        for _ in range(waits):
            stream = self.system.open(self._path(name))
            text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            if text.endswith("\n"):
                return text
            time.sleep(0.25)
        raise ConflictError(f"{name} was begun but not finished", folder=self.folder)

    def remove(self, name: str) -> None:
        self.system.delete(self._path(name), True)


class Change(NamedTuple):
    """One version: the folder of its rows, and whether it holds the whole table."""

    folder: str
    whole: bool


@dataclass
class Staged:
    """Rows of a change that are written and belong to no version yet."""

    folder: str
    base: int
    rows: DataFrame
    committed: bool = False


class KeyedTable:
    """A table in a shared folder; ``unique`` columns hold each value at most once, nulls apart."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path, _Files(spark, path)
        if "table.json" not in self.files.names(""):
            raise NotFoundError(f"no table at {path}")
        known = json.loads(self.files.read("table.json"))
        self.schema = StructType.fromJson(known["schema"])
        self.key, self.unique, self.buckets = known["key"], tuple(known["unique"]), known["buckets"]

    # Versions

    def version(self) -> int:
        """The newest version; 0 is the empty table."""
        return int((self.files.names("log") or ["0"])[-1])

    def changes(self, version: int | None = None) -> list[Change]:
        """What a version consists of: the last change that holds the whole table, and those after it."""
        found: list[Change] = []
        for number in range(self.version() if version is None else version, 0, -1):
            found.insert(0, Change(**json.loads(self.files.read(f"log/{number:012d}"))))
            if found[0].whole:
                break
        return found

    # Reading

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, changes: list[Change], buckets: list[int] | None) -> DataFrame:
        fields = self.schema.fields
        schema = StructType([*fields]).add("_generation", LongType()).add("_removed", BooleanType())
        schema = schema.add("_change", StringType()).add("_bucket", IntegerType())
        if not changes:
            return self.spark.createDataFrame([], schema).limit(0)  # so the planner sees that there is nothing to join
        folders = (f"{self.path}/data/_change={x.folder}" for x in changes)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)
        return rows if buckets is None else rows.where(F.col("_bucket").isin(buckets))

    def rows(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, all of them or those of some buckets.

        Of the changed keys the last change counts. Rows of the compacted part whose keys no later change names are read as
        they are, without a shuffle where the changes are small. A change holds a key once, so a single one needs no folding.
        """
        changes = self.changes(version)
        settled = [x for x in changes if x.whole]
        base = self._read(settled, buckets).drop("_change", "_bucket")
        later = self._read(changes[len(settled) :], buckets).drop("_change", "_bucket")
        last = later if len(changes) - len(settled) == 1 else latest_rows(later, self.key, ["_generation"])
        kept = base
        if settled and len(changes) > 1:  # by hash first, as keys that begin alike are slow to sort
            hashed = F.xxhash64(self.key).alias("_hash")
            kept = base.select("*", hashed).join(last.select(self.key, hashed), ["_hash", self.key], "left_anti").drop("_hash")
        return kept.unionByName(last).where("not _removed").select(*self.schema.names)

    def get(self, value: Any, version: int | None = None) -> DataFrame:
        """The row with this key, or none; one bucket of each change is read."""
        literal = F.lit(value).cast(self.schema[self.key].dataType)
        (bucket,) = self.spark.range(1).select(self._bucket(literal)).first()
        return self.rows(version, [bucket]).where(F.col(self.key) == literal)

    # Writing

    def _typed(self, rows: DataFrame) -> DataFrame:
        lacking = set(self.schema.names) - set(rows.columns)
        if lacking:
            raise ValidationError(f"rows lack {sorted(lacking)}")
        kinds = dict(rows.dtypes)  # a cast that only lets nulls in would copy every nested row
        return rows.select(
            *(
                F.col(x.name) if kinds[x.name] == x.dataType.simpleString() else F.col(x.name).cast(x.dataType)
                for x in self.schema.fields
            )
        )

    def _require(self, rows: DataFrame, base: int, known: bool | None, removed: DataFrame | None = None) -> None:
        """One job for all rules: keys filled and once, known or unknown as asked, and unique values not taken.

        Values of the changed rows and of the table are mentions of (column, value), folded with partial counts; rows that the
        change replaces or removes give their values up first.
        """
        current = self.rows(base)
        others = current.join(rows.select(self.key), self.key, "left_anti") if self.unique and known is not False else current

        def mentions(frame: DataFrame, column: str, new: bool) -> DataFrame:
            return frame.select(
                F.lit(column).alias("column"), F.col(column).cast("string").alias("value"), F.lit(new).alias("new")
            )

        parts = [mentions(rows, self.key, True)]
        if known is not None:  # else no rule asks whether the table holds a key
            touched = [row[0] for row in rows.select(self._bucket(F.col(self.key))).distinct().collect()]  # at most one a bucket
            parts.append(mentions(self.rows(base, touched), self.key, False))
        for column in self.unique:
            parts += [mentions(rows, column, True).where("value is not null"), mentions(others, column, False)]
        folded = reduce(DataFrame.unionByName, parts).groupBy("column", "value").agg(
            F.count_if(F.col("new")).alias("added"), F.count_if(~F.col("new")).alias("held")
        )
        key = F.col("column") == self.key
        rules = [
            (key & F.col("value").isNull() & (F.col("added") > 0), "{} is null", ValidationError),
            (F.col("added") > 1, "{} '{}' occurs twice in the change", IntegrityError),
            (~key & (F.col("added") > 0) & (F.col("held") > 0), "{} '{}' already exists", IntegrityError),
        ]
        if known is False:
            rules.append((key & (F.col("added") > 0) & (F.col("held") > 0), "{} '{}' already exists", IntegrityError))
        if known is True:
            rules.append((key & (F.col("added") > 0) & (F.col("held") == 0), "{} '{}' does not exist", NotFoundError))
        broken = reduce(
            lambda held, at: held.when(rules[at][0], F.lit(at)), range(1, len(rules)), F.when(rules[0][0], F.lit(0))
        )
        example = folded.select("column", "value", broken.alias("rule")).where("rule is not null").limit(1).collect()
        if example:
            _, words, kind = rules[example[0].rule]
            raise kind(words.format(example[0].column, example[0].value))

    def deal(self, rows: DataFrame, key: Column) -> DataFrame:
        """Rows with ``_bucket`` and ``_share``, dealt out by both: groups of these and the key lie as a change is written."""
        shares = max(1, 8 * task_count(self.spark) // self.buckets)
        share = F.pmod(F.xxhash64(key, F.lit("share")), F.lit(shares)).cast("int")
        return rows.withColumns({"_bucket": self._bucket(key), "_share": share}).repartition("_bucket", "_share")

    def _write(self, rows: DataFrame, base: int, folder: str, removed: bool = False, dealt: bool = False) -> None:
        staged = rows.withColumns(
            {
                "_generation": F.lit(base + 1).cast("bigint"),
                "_removed": F.lit(removed),
                "_bucket": self._bucket(F.col(self.key)),
            }
        )
        # Files follow buckets; a bucket with very many rows is split by size at run time.
        spread = staged if dealt else staged.hint("rebalance", "_bucket")
        plain = {"compression": "zstd", f"parquet.enable.dictionary#{self.key}": "false"}  # keys do not come again
        spread.write.options(**plain).partitionBy("_bucket").parquet(f"{self.path}/data/_change={folder}")

    def _commit(self, rows: DataFrame, base: int, removed: bool = False, whole: bool = False) -> int:
        folder = uuid.uuid4().hex
        self._write(rows, base, folder, removed)
        return self._finish(Change(folder, whole or base == 0), base)  # the first change is the whole table

    @contextmanager
    def staged(self, rows: DataFrame, base: int, dealt: bool = False) -> Iterator[Staged]:
        """Write rows for ``upsert_staged``; what is not committed by the end of the block is removed.

        No reader sees the rows before, but the caller may go on from them. ``dealt`` says that they come from ``deal``.
        """
        folder = uuid.uuid4().hex
        change = None
        try:
            self._write(self._typed(rows), base, folder, dealt=dealt)
            change = Staged(folder, base, self._read([Change(folder, False)], None).select(*self.schema.names))
            yield change
        finally:
            if change is None or not change.committed:
                self.files.remove(f"data/_change={folder}")

    def upsert_staged(self, change: Staged) -> int:
        """Insert or overwrite by key with rows that are written already; a key may occur once."""
        self._require(change.rows, change.base, known=None)
        version = self._finish(Change(change.folder, change.base == 0), change.base)
        change.committed = True
        return version

    def _finish(self, change: Change, base: int) -> int:
        text = json.dumps(change._asdict()) + "\n"
        if not self.files.create(f"log/{base + 1:012d}", text):
            self.files.remove(f"data/_change={change.folder}")
            raise ConflictError(f"version {base + 1} was committed by another writer", path=self.path)
        return base + 1

    def _base(self, base: int | None) -> int:
        return self.version() if base is None else base

    def add(self, rows: DataFrame, base: int | None = None) -> int:
        """Append rows with new keys; returns the new version. ``base`` is the version the caller has seen."""
        base, rows = self._base(base), self._typed(rows)
        self._require(rows, base, known=False)
        return self._commit(rows, base)

    def update(self, rows: DataFrame, base: int | None = None) -> int:
        """Replace whole rows by key; every key must exist."""
        base, rows = self._base(base), self._typed(rows)
        self._require(rows, base, known=True)
        return self._commit(rows, base)

    def upsert(self, rows: DataFrame, order: list[str] | None = None, base: int | None = None) -> int:
        """Insert or overwrite by key; where ``order`` is given the last row of a key wins, else a key may occur once."""
        base = self._base(base)
        rows = self._typed(latest_rows(rows, self.key, order) if order else rows)
        self._require(rows, base, known=None)
        return self._commit(rows, base)

    def delete(self, keys: DataFrame, base: int | None = None) -> int:
        """Remove rows by key; unknown keys are ignored."""
        base = self._base(base)
        named = keys.select(F.col(self.key).cast(self.schema[self.key].dataType)).where(F.col(self.key).isNotNull()).distinct()
        empty = {x.name: F.lit(None).cast(x.dataType) for x in self.schema.fields if x.name != self.key}
        return self._commit(named.withColumns(empty).select(*self.schema.names), base, removed=True)

    def compact(self, base: int | None = None) -> int:
        """Write the rows of a version as one change, so that readers need none before it."""
        base = self._base(base)
        return self._commit(self.rows(base), base, whole=True)

    def retried(self, change: Callable[[], int], attempts: int = 5) -> int:
        """Run a change again on the then newest version when another writer was faster."""
        for attempt in range(attempts):
            try:
                return change()
            except ConflictError:
                if attempt + 1 == attempts:
                    raise
        raise ValidationError("attempts must be positive")


def create_keyed(
    spark: SparkSession, path: str, schema: StructType, key: str, unique: tuple[str, ...] = (), buckets: int = 64
) -> KeyedTable:
    """Create an empty table unless there is one."""
    lacking = {key, *unique} - set(schema.names)
    if lacking or set(_OWN) & set(schema.names) or buckets < 1:
        raise ValidationError(f"unusable table: {sorted(lacking)} not in the schema, or own columns {_OWN} used, or no buckets")
    # Rows of a removal hold nothing but the key.
    loose = StructType.fromJson({**schema.jsonValue(), "fields": [{**x, "nullable": True} for x in schema.jsonValue()["fields"]]})
    known = {"schema": loose.jsonValue(), "key": key, "unique": list(unique), "buckets": buckets}
    _Files(spark, path).create("table.json", json.dumps(known) + "\n")
    return KeyedTable(spark, path)
