"""Near-equal vectors by a pivot-permutation index.

Every vector is described by its nearest reference points (pivots) in order. Inverted lists hold, for each label and
pivot, the vectors that have the pivot among their nearest; vectors that share enough pivots are candidates, and their
cosine is verified in double precision. A pair that meets in several lists is taken in that of its lowest shared pivot
alone, so links are counted without writing pairs out. Equal vectors of a label are one entry with a count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import connected_components
from siltstone.session import cut_lineage


@dataclass(frozen=True)
class Settings:
    """``nearest`` pivots describe a vector; ``shared`` of them, or all if there are fewer, make a candidate.

    Of each vector length one pivot per ``per_pivot`` entries is drawn, at least ``fewest``, and for all lengths together
    at most ``most_pivots`` (the bound of the sample and of its broadcast), but one for each length; longer lists are
    compared in blocks of ``block`` entries.
    """

    threshold: float = 0.93
    nearest: int = 8
    shared: int = 2
    per_pivot: int = 40
    fewest: int = 16
    most_pivots: int = 16_384
    block: int = 1024
    apart: float = 0.8  # highest cosine of two pivots


def entries_of(vectors: DataFrame) -> DataFrame:
    """Distinct vectors that can link: ``entry`` (smallest vec_id), ``copies``, ``label``, ``embedding``, hash key."""
    return (
        vectors.where("usable")
        .groupBy("h1", "h2", "label")
        .agg(F.min("vec_id").alias("entry"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    )


def _unit(lists: pa.Array) -> np.ndarray:
    rows = np.asarray(lists.flatten(), np.float64).reshape(len(lists), -1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _rows_unit(lists: list[list[float]]) -> np.ndarray:
    rows = np.array(lists, np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spread_pivots(rows: np.ndarray, apart: float) -> np.ndarray:
    """Rows in order, without those too near to an earlier one.

    A dense group of vectors would otherwise hold many pivots, and the order of pivots that hardly differ is chance.
    """
    rows = rows.astype(np.float32)
    kept = np.zeros(len(rows), bool)
    for low in range(0, len(rows), 512):
        part = rows[low : low + 512]
        far = (part @ rows[:low][kept[:low]].T < apart).all(axis=1)
        inner = part @ part.T >= apart
        for at in range(len(part)):
            kept[low + at] = far[at] and not (inner[at, :at] & kept[low : low + at]).any()
    return rows[kept]


def list_entries(entries: DataFrame, settings: Settings) -> DataFrame:
    """One row per entry and pivot of its description: the inverted lists."""
    spark = entries.sparkSession
    sized = entries.select(
        F.xxhash64("h1", "h2").alias("key"), "entry", F.size("embedding").alias("size"), "embedding"
    )
    totals = sized.groupBy("size").agg(F.count("*").alias("total"), F.min("key").alias("first")).collect()
    wanted = {row["size"]: max(settings.fewest, row["total"] // settings.per_pivot) for row in totals}
    over = max(1.0, sum(wanted.values()) / settings.most_pivots)
    bounds = []
    for row in totals:
        number = max(1, int(wanted[row["size"]] / over))
        # Twice as many rows and some are expected below the bound, so that few rows are ranked.
        bound = int(min(1.0, (2 * number + 64) / row["total"]) * 2**64) - 2**63
        bounds.append((row["size"], number, max(row["first"], min(bound, 2**63 - 1))))
    few = spark.createDataFrame(bounds, "size int, number int, bound bigint")
    rank = F.row_number().over(Window.partitionBy("size").orderBy("key", "entry"))
    near_bound = sized.join(F.broadcast(few), "size").where("key <= bound").withColumn("rank", rank)
    drawn: dict[int, list] = {}
    for row in near_bound.where("rank <= number").select("size", "rank", "embedding").orderBy("size", "rank").collect():
        drawn.setdefault(row["size"], []).append(row["embedding"])
    by_size = {size: spread_pivots(_rows_unit(rows), settings.apart) for size, rows in drawn.items()}
    pivots = spark.sparkContext.broadcast(by_size)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = np.asarray(whole.column("size"))
            for size in np.unique(lengths):
                same = whole.filter(pa.array(lengths == size))
                for start in range(0, same.num_rows, 2000):
                    part = same.slice(start, 2000)
                    near = _unit(part.column("embedding")).astype(np.float32) @ pivots.value[int(size)].T
                    kept = min(settings.nearest, near.shape[1])
                    top = np.argpartition(-near, kept - 1, axis=1)[:, :kept]
                    order = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), 1, "stable"), 1)
                    index = pa.array(np.repeat(np.arange(part.num_rows), kept))
                    columns = [part.column(c).take(index) for c in ("entry", "copies", "label", "size", "embedding")]
                    yield pa.RecordBatch.from_arrays(
                        [
                            *columns,
                            pa.array(order.ravel().astype(np.int32)),
                            pa.array(list(np.repeat(order.astype(np.int32), kept, axis=0)), pa.list_(pa.int32())),
                        ],
                        ["entry", "copies", "label", "size", "embedding", "pivot", "permutation"],
                    )

    source = entries.select("entry", "copies", "label", F.size("embedding").alias("size"), "embedding")
    return source.mapInArrow(
        describe,
        "entry bigint, copies bigint, label int, size int, embedding array<float>, pivot int, permutation array<int>",
    )


def verify_lists(lists: DataFrame, settings: Settings) -> DataFrame:
    """Links met in each list: per entry the ``links`` (weighed with copies) and one ``other`` entry it is joined to.

    A list is compared in pairs of blocks, so that a long one is work for many tasks. The links of a block are passed
    on as a spanning forest.
    """
    counts = lists.groupBy("label", "size", "pivot").agg(
        F.ceil(F.count("*") / settings.block).cast("int").alias("blocks")
    )
    own = F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")
    dealt = (
        lists.join(counts, ["label", "size", "pivot"])
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .drop("blocks", "other")
    )

    def compare(table: pa.Table) -> pa.Table:
        entry = np.asarray(table.column("entry").combine_chunks())
        copies = np.asarray(table.column("copies").combine_chunks())
        own = np.asarray(table.column("own").combine_chunks())
        unit = _unit(table.column("embedding").combine_chunks())
        marks = np.asarray(table.column("permutation").combine_chunks().flatten()).reshape(len(entry), -1)
        pivot, i, j = (table.column(c)[0].as_py() for c in ("pivot", "i", "j"))
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        near = unit[left] @ unit[right].T >= settings.threshold
        near &= (left[:, None] < right[None, :]) if i == j else True
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        keep = np.zeros(len(a), bool)
        shared = min(settings.shared, marks.shape[1])  # all vectors of a length have as many pivots
        for low in range(0, len(a), 50_000):
            one, two = marks[a[low : low + 50_000]], marks[b[low : low + 50_000]]
            both = (one[:, :, None] == two[:, None, :]).any(axis=2)
            lowest = np.where(both, one, np.iinfo(np.int32).max).min(axis=1)
            keep[low : low + 50_000] = (both.sum(axis=1) >= shared) & (lowest == pivot)
        a, b = a[keep], b[keep]
        links = np.bincount(a, copies[b], len(entry)) + np.bincount(b, copies[a], len(entry))
        root = np.arange(len(entry))
        while len(a):
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, root[a], low)
            np.minimum.at(new, root[b], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        met = np.flatnonzero(links > 0)
        return pa.table(
            {"entry": entry[met], "links": links[met].astype(np.int64), "other": entry[root[met]]},
            pa.schema([("entry", pa.int64()), ("links", pa.int64()), ("other", pa.int64())]),
        )

    return dealt.groupBy("label", "size", "pivot", "i", "j").applyInArrow(
        compare, "entry bigint, links bigint, other bigint"
    )


def near_vectors(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Links and component of every vector among those of its label.

    One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept``. A vector that is null, empty, zero or
    holds a null or non-finite component, or that has a null label, links with nothing and is its own component; so
    does a null vec_id, whose component is null and which is kept. Vectors of unequal lengths do not link. Repeated
    rows count as vectors of their own. An empty table gives an empty result. Extra columns are not read.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 3.5e38) & (F.abs(x) < float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0)
    usable = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & nonzero
    )
    rows = (
        vectors.select(
            vectors["vec_id"].cast("bigint").alias("vec_id"),
            vectors["embedding"].cast("array<float>").alias("embedding"),
            vectors["label"].cast("int").alias("label"),
        )
        .withColumn("usable", F.coalesce(usable, F.lit(False)))
        .withColumn("h1", F.xxhash64("embedding", "label"))
        .withColumn("h2", F.xxhash64(F.lit(7), "label", "embedding"))
    )
    entries = cut_lineage(entries_of(rows))
    found = cut_lineage(verify_lists(list_entries(entries, settings), settings))
    links = found.groupBy("entry").agg(F.sum("links").alias("links"))
    components = connected_components(found, "entry", "other")
    known = (
        entries.select("h1", "h2", "label", "entry", "copies")
        .join(links, "entry", "left")
        .join(components, F.col("entry") == F.col("node"), "left")
        .select(
            "h1",
            "h2",
            "label",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "entry").alias("component_id"),
        )
    )
    linked = (
        rows.where("usable")
        .select("vec_id", "h1", "h2", "label")
        .join(cut_lineage(known), ["h1", "h2", "label"])
        .select("vec_id", "n_links", "component_id")
    )
    alone = rows.where(~F.col("usable")).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))
    )
