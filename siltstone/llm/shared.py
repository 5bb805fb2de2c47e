"""What several operators use: shared storage, bounded slices of a batch, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.session import checkpoint_folder, cut_lineage

NODES_A_TASK = 100_000  # of a table with one row a node


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_shared(frame: DataFrame, kind: str, **options: str) -> DataFrame:
    """Write ``frame`` as Parquet below the shared checkpoint folder and return the written table."""
    spark = frame.sparkSession
    place = f"{checkpoint_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    frame.write.options(**options).parquet(place)
    return spark.read.schema(frame.schema).parquet(place)


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def text_slices(
    batches: Iterator[pa.RecordBatch], column: str = "text", most_bytes: int = 2_000_000, most_rows: int = 20_000
) -> Iterator[pa.RecordBatch]:
    """Cut record batches where their texts reach ``most_bytes``; one longer text is a slice of its own."""
    for batch in batches:
        start = held = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for at, size in enumerate(sizes):
            if at > start and (held + size > most_bytes or at - start >= most_rows):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def passed_columns(frame: DataFrame, *names: str) -> list[Column]:
    """The named columns only, so that extra columns of the input, whatever their names, do not matter."""
    return [frame[name] for name in names]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for every node of ``edges``.

    Large-star and small-star rounds (Kiveris et al. 2014): every round is two minima and two joins on the node, and
    the number of rounds grows with the logarithm of the longest chain. The minima are cut off as tables of their own,
    so that adaptive execution can split the join of a node that has very many edges; they hold one row a node and take
    tasks by their number of rows. Rounds end once all links are stars, so the driver keeps track of no round that
    changes nothing. Self-links, repeated links and null ends are ignored; no edges give no rows.
    """
    held = cut_lineage(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v"))
        .distinct()
    )
    cores = edges.sparkSession.sparkContext.defaultParallelism
    while True:
        # Stars: no node has two smaller neighbours, or a smaller and a larger one.
        sides = (F.struct(F.col(name).alias("node"), F.lit(up).alias("up")) for name, up in (("u", 1), ("v", 0)))
        ends = held.select(F.inline(F.array(*sides)))
        nodes = ends.groupBy("node").agg(F.count("*").alias("n"), F.sum("up").alias("up"))
        links, open_nodes = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 or up = 1 and n > 1"))).first()
        if not open_nodes:
            break
        tasks = max(cores, links // NODES_A_TASK)
        turned = held.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = held.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = cut_lineage(least.coalesce(tasks))
        large = cut_lineage(turned.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        lower = cut_lineage(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks))
        held = cut_lineage(
            large.join(lower, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lower.select("u", F.col("m").alias("v")))
            .distinct()
        )
    roots = held.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return held.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
