"""Keyed tables: add, update, delete, upsert and lookups as DataFrame operations.

Each change returns the new contents; ``save_generation`` writes them next to the old ones, so readers never
see a half-written table and a lost executor only repeats its own part of the write.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siltstone.errors import IntegrityError, NotFoundError
from siltstone.operators.checks import duplicates, missing, require_empty


def add_rows(table: DataFrame, rows: DataFrame, key: str, unique: tuple[str, ...] = ()) -> DataFrame:
    """Append rows; a key or unique value that exists already, in the table or twice in the rows, is an error."""
    for column in (key, *unique):
        require_empty(duplicates(rows, [column]), f"{column} occurs twice in the added rows", IntegrityError)
        taken = rows.join(table.select(column), column, "left_semi")
        require_empty(taken.select(column), f"{column} already exists", IntegrityError)
    return table.unionByName(rows)


def update_rows(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Replace whole rows by key; a key that does not exist is an error."""
    require_empty(missing(rows.select(key), key, table, key), f"{key} does not exist", NotFoundError)
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Remove rows by key; unknown keys are ignored."""
    return table.join(keys.select(key), key, "left_anti")


def latest_rows(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key in ``order``, found with a partial maximum per task (no sort, no window)."""
    others = [name for name in rows.columns if name != key]
    last = F.max_by(F.struct(*others), F.struct(*order)).alias("r")
    return rows.groupBy(key).agg(last).select(key, "r.*").select(*rows.columns)


def upsert_rows(table: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Insert or overwrite by key; among the new rows the last of each key wins."""
    fresh = latest_rows(rows, key, order)
    return table.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def get(table: DataFrame, key: str, value: Any) -> DataFrame:
    """The row with this key, or none."""
    return table.where(F.col(key) == value).limit(1)


def exists(table: DataFrame, key: str, value: Any) -> bool:
    return bool(get(table, key, value).select(key).collect())


def list_by(table: DataFrame, column: str, value: Any) -> DataFrame:
    """All rows with this value, such as the files of a repository or the findings of a run."""
    return table.where(F.col(column) == value)


def list_all(table: DataFrame, key: str) -> DataFrame:
    return table.orderBy(key)


def affected_rows(status: str):
    """Row count at the end of a command tag such as ``UPDATE 3``."""
    return F.element_at(F.split(F.col(status), " "), -1).cast("bigint")


def create_table(spark: SparkSession, name: str, schema: StructType) -> None:
    """Create an empty parquet table unless it exists."""
    spark.createDataFrame([], schema).write.mode("ignore").saveAsTable(name)


def _generations(spark: SparkSession, path: str, complete: bool = True) -> list[int]:
    """Numbers of the generations below a table folder: the complete ones, or all that a write has begun."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("generation=") and (not complete or files.exists(done)):
            found.append(int(name.removeprefix("generation=")))
    return sorted(found)


def save_generation(table: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Write a new generation of a table; it becomes visible when its success marker is written.

    A number whose write was aborted is passed over. Two writers that start from one generation do not see each
    other's changes: one fails on the folder, or the later one hides the earlier.
    """
    number = (_generations(table.sparkSession, path, complete=False) or [0])[-1] + 1
    writer = table.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/generation={number}")
    return number


def load_latest(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The newest complete generation; an empty frame when there is none."""
    known = _generations(spark, path)
    if not known:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/generation={known[-1]}")
