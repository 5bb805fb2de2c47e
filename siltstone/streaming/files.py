"""Parse files as they arrive.

The reference has no streaming; this only shows that the parse and the extractions, being narrow, run unchanged
on a streaming DataFrame. No state is kept, so there is nothing to watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from siltstone.operators.parse import parse_files

FILES = "repository_id string, relative_path string, content string"


def read_file_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of (repository_id, relative_path, content) rows, as they are added to a folder."""
    return spark.readStream.schema(FILES).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def write_parsed_stream(files: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Parse each arriving file once and append its record."""
    return (
        parse_files(files)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
