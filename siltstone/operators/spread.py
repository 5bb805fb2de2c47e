"""Joins and ranks that stay even when one key holds a large share of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from siltstone.session import cut_lineage, task_count

# A key with fewer rows than this is one task's work and never split.
HOT_ROWS = 1_000_000


def spread_join(
    facts: DataFrame,
    lookup: DataFrame,
    keys: list[str],
    spread_by: list[str],
    counts: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
    shares: int | None = None,
) -> DataFrame:
    """Left join ``facts`` to ``lookup`` (unique on ``keys``), splitting hot keys over many tasks.

    A key is hot if it has more than ``hot_rows`` rows and more than one of ``shares`` equal shares of all rows (four a
    task unless given). So there are fewer hot keys than shares, which bounds the broadcast list, and a key that is not
    hot is a small part of one task's work; no key that is hot is left out. Rows of a hot key are dealt out by a hash of
    ``spread_by`` over one split for each share it fills, and its lookup row is repeated per split; rows without a key are
    dealt out over all shares. ``counts`` (keys and ``rows``) may be passed when it is known already, and a ``rows``
    column in ``lookup`` saves looking its keys up among the hot ones.
    """
    shares = shares or 4 * task_count(facts.sparkSession)
    keyed = reduce(lambda a, b: a & b, [F.col(key).isNotNull() for key in keys])
    if counts is None:
        counts = facts.where(keyed).groupBy(*keys).agg(F.count("*").alias("rows"))
    limit = counts.agg(
        F.greatest(F.lit(hot_rows), F.ceil(F.coalesce(F.sum("rows"), F.lit(0)) / shares)).cast("bigint").alias("limit")
    ).scalar()
    splits = F.when(F.col("rows") > limit, F.ceil(F.col("rows") / limit).cast("int")).alias("_splits")
    hot = counts.select(*keys, splits).where("_splits is not null")  # fewer rows than shares
    dealt = F.xxhash64(*spread_by)
    salt = (
        F.when(F.col("_splits").isNotNull(), F.pmod(dealt, F.col("_splits")))
        .when(~keyed, F.pmod(dealt, F.lit(shares)))
        .otherwise(0)
        .cast("int")
    )
    left = facts.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).drop("_splits")
    if "rows" in lookup.columns:
        repeated = lookup.withColumn("_splits", splits).drop("rows")
    else:
        repeated = lookup.join(F.broadcast(hot), keys, "left")
    right = repeated.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_splits"), F.lit(1)) - 1))
    ).drop("_splits")
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def distributed_rank(frame: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """1-based position of every row in a total order, without gathering the rows in one task.

    Rows are range-partitioned on the whole order (so ties in its first columns are split by the later ones),
    written to the checkpoint folder, numbered inside their range, and shifted by the sizes of the ranges
    before it. Only one count per range is gathered.
    """
    ranges = task_count(frame.sparkSession)
    written = cut_lineage(
        frame.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id())
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        written.groupBy("_range")
        .agg(F.count("*").alias("_rows"))
        .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    )  # one row per range, at most ``ranges``
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        written.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_range")
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_range", "_before", "_inside")
    )


def order_statistic(frame: DataFrame, order: list[Column], place: int) -> Row | None:
    """The row at a 1-based place of a total order, or None when there are fewer rows.

    Rows are range-partitioned on the whole order and written; counts of the ranges, one row each, tell in which the
    place lies, and only that range is ordered.
    """
    written = cut_lineage(
        frame.repartitionByRange(task_count(frame.sparkSession), *order).withColumn("_range", F.spark_partition_id())
    )
    before = 0
    for row in written.groupBy("_range").count().orderBy("_range").collect():  # one row per range
        if before + row["count"] >= place:
            inside = written.where(F.col("_range") == row["_range"]).drop("_range")
            return inside.orderBy(*order).offset(place - before - 1).first()
        before += row["count"]
    return None
