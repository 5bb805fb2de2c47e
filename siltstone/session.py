"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from siltstone.errors import ConfigurationError

# Settings the operators count on. Files vary from bytes to megabytes, so Arrow batches are bounded
# by bytes as well as rows; hot join keys are split at run time by adaptive execution.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(app_name: str = "siltstone", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session carrying the engine's settings."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the engine's settings to a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, registering it with the context on first use.

    The cluster names the folder in ``spark.checkpoint.dir``. Only a local master, where driver and
    executors share one disk, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known:
        return known
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local"):
            raise ConfigurationError("spark.checkpoint.dir must name a folder all executors share")
        folder = tempfile.mkdtemp(prefix="siltstone-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to the shared checkpoint folder and continue from the written copy."""
    checkpoint_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)


def write_copy(frame: DataFrame, place: str | None = None) -> DataFrame:
    """Write ``frame`` as compressed Parquet to the shared folder (or ``place`` in it) and continue from the copy.

    A fraction of what ``cut_lineage`` writes, and a reader takes only the columns it needs.
    """
    spark = frame.sparkSession
    folder = f"{place or checkpoint_folder(spark)}/copy-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


@contextmanager
def written_copies(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Give a ``write_copy`` whose copies are all removed at the end of the block."""
    place = f"{checkpoint_folder(spark)}/copies-{uuid.uuid4().hex}"
    try:
        yield lambda frame: write_copy(frame, place)
    finally:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def drop_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside the block, shuffle files go as soon as the query that wrote them ends, not when its objects are collected.

    For jobs of many queries that each run once; a frame that is run a second time shuffles anew.
    """
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        yield


@contextmanager
def hash_joins(spark: SparkSession) -> Iterator[None]:
    """Inside the block, joins of which one side has turned out small in every task (64 MB of shuffle) sort neither side."""
    with _setting(spark, "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m"):
        yield


@contextmanager
def sorted_groups(spark: SparkSession) -> Iterator[None]:
    """Inside the block, rows that lie sorted by the keys they are grouped by are folded in one pass over them.

    Lists would else be collected by a hash of few keys, and past these sorted twice, before and after a partial step.
    """
    with _setting(spark, "spark.sql.execution.replaceHashWithSortAgg", "true"):
        yield


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def task_count(spark: SparkSession) -> int:
    """Tasks to share a step among: the session's shuffle partitions or all cores, whichever is more.

    On a local master more tasks than threads would only add start-up time.
    """
    cores = spark.sparkContext.defaultParallelism
    if spark.sparkContext.master.startswith("local"):
        return cores
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores)


def spread_rows(frame: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Deal rows out to a fixed number of tasks before a step that is expensive per row.

    With a given number of partitions adaptive execution does not merge them again; it would go by bytes, and a
    few megabytes of file names may stand for terabytes of contents.
    """
    return frame.repartition(partitions or task_count(frame.sparkSession), *keys)
