"""Stored collections: JSON maps and JDBC tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions.text import is_blank
from siltstone.operators.records import SCHEMAS, from_documents, to_documents


def read_json_map(spark: SparkSession, path: str, relation: str) -> DataFrame:
    """Entities of JSON files that each hold one object of id -> record.

    The format is one document per file and cannot be split, so a file is one row; many files are read in
    parallel. A missing path or blank file is empty, anything but an object fails the job.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    known = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(folder)
    if not known:
        return spark.createDataFrame([], SCHEMAS[relation])
    texts = spark.read.text(path, wholetext=True).where(~is_blank("value"))
    broken = F.raise_error(F.lit("expected a JSON object at the top level")).cast("map<string,variant>")
    records = F.from_json("value", "map<string,variant>")
    checked = F.when(F.substring(F.ltrim("value"), 1, 1) == "{", F.coalesce(records, broken)).otherwise(broken)
    entries = texts.select(F.explode(checked).alias("id", "record"))
    return from_documents(entries.select(F.to_json("record").alias("document")), relation)


def write_json(rows: DataFrame, path: str, relation: str) -> None:
    """One JSON document per line, in as many files as there are partitions."""
    to_documents(rows, relation).select("document").write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, relation: str) -> DataFrame:
    return from_documents(spark.read.text(path).withColumnRenamed("value", "document"), relation)


def jdbc_options(
    url: str, table: str, partition_column: str | None = None, bounds: tuple[str, str] | None = None, partitions: int = 8
) -> dict[str, str]:
    """Options of a JDBC read; with a partition column the table is read by several tasks."""
    options = {"url": url, "dbtable": table}
    if partition_column and bounds:
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": bounds[0],
            "upperBound": bounds[1],
            "numPartitions": str(partitions),
        }
    return options


def read_jdbc(spark: SparkSession, url: str, table: str, **partitioning: object) -> DataFrame:
    """A database table; equality filters on it are sent to the database."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **partitioning)).load()


def append_jdbc(rows: DataFrame, url: str, table: str) -> None:
    rows.write.format("jdbc").options(**jdbc_options(url, table)).mode("append").save()
