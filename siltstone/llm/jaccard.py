"""Documents whose sets of word n-grams overlap, by a blocked sparse product of the document by n-gram incidence.

A row of the incidence matrix is a distinct set of n-grams (documents with equal sets are one row), a column an n-gram.
Only overlaps that can reach the bounds are accumulated, in three steps:

1. Two sets that reach the threshold share k of their first n - ceil(t n) + k n-grams in any fixed order. Each map task
   looks through those columns for its own documents, and sends a column block one entry per column, however many of its
   documents have it. Rows that share fewer than k of these columns with any others are done.
2. The full rows that remain are kept in row blocks. Column blocks add up how many rows have each column, again with one
   entry per row block and column. Columns of a single row go; a row that keeps fewer than ceil(t n) of its columns can
   reach no other and goes. Rows are then ordered from their rarest column on, where few rows meet.
3. In each of a row's first columns the rows are joined to the column's first row, which connects most rows that can be.
   Rows in a column that still holds unconnected rows are laid into product blocks, similar ones next to each other. Two
   blocks that share such a column are multiplied in one task: columns add to a matrix of overlaps, rarest first, a pair
   whose rest cannot reach its bound is given up, and only links that join two components leave the task. All pairs of
   unconnected rows that share a first column are met, so components are exact.

N-grams are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import connected_components, text_slices, write_shared
from siltstone.llm.words import SPACED, hashed_words, mixed
from siltstone.session import cut_lineage, task_count

_PLACES = np.array([0x9E3779B97F4A7C15 * k & (1 << 64) - 1 | 1 for k in range(1, 65)], np.uint64)


@dataclass(frozen=True)
class Settings:
    """Link where 100 * overlap >= ``percent`` * union of sets of ``words``-word n-grams.

    ``column_block`` entries make a column block and ``row_block`` a row block; their number follows the data. A product
    block ends near ``product_entries`` entries, a row counting as at least one of ``product_rows`` equal parts of them.
    """

    words: int = 5
    percent: int = 75
    column_block: int = 1_000_000
    row_block: int = 400_000
    shared: int = 16  # k of the first step
    stars: int = 1
    product_rows: int = 512
    product_entries: int = 100_000
    broadcast_ids: int = 1_000_000  # up to so many ids (some 24 MB) are sent to the texts; more are met by a shuffle


def needed(size: np.ndarray, percent: int) -> np.ndarray:
    """Smallest overlap with any set that can link a set of this size."""
    return -(-size * percent // 100)


def gram_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, one text after another, and where each text's set ends."""
    found = hashed_words(texts, SPACED)
    sets, ends = [], np.zeros(len(texts) + 1, np.int64)
    for at, (low, high) in enumerate(zip(found.bounds[:-1], found.bounds[1:])):
        own = found.hashes[low:high]
        size = min(words, len(own))
        if size:
            total = np.full(len(own) - size + 1, np.uint64(size), np.uint64)
            for k in range(size):
                total += mixed(own[k : len(own) - size + 1 + k] * _PLACES[k])
            sets.append(np.unique(mixed(total)))
        ends[at + 1] = ends[at] + (len(sets[-1]) if size else 0)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), ends


def set_keys(grams: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each set; 0 for an empty one."""
    each = mixed(grams ^ np.uint64(0x5851F42D4C957F2D))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
    sizes = np.diff(ends).astype(np.uint64)
    keys = mixed((sums[ends[1:]] - sums[ends[:-1]]) ^ (sizes * _PLACES[7]))
    return np.where(sizes > 0, keys.view(np.int64), 0)


# Step 1: which rows share a column of their prefix with another row.


def prefix_entries(documents: DataFrame, settings: Settings, blocks: int) -> DataFrame:
    """Per task and column block (``kind`` 1) entries of columns; and (``kind`` 2) rows that share a column in their task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        columns: list[np.ndarray] = []
        rows: list[np.ndarray] = []
        for part in text_slices(batches):
            grams, ends = gram_sets(part.column("text"), settings.words)
            keys, sizes = set_keys(grams, ends), np.diff(ends)
            least = needed(sizes, settings.percent)
            first = sizes - least + np.minimum(settings.shared, least)
            fresh = [i for i in np.flatnonzero(sizes) if keys[i] not in seen and not seen.add(keys[i])]
            if fresh:
                columns.append(np.concatenate([grams[ends[i] : ends[i] + first[i]] for i in fresh]))
                rows.append(np.repeat(keys[fresh], first[fresh]))
            if sum(map(len, columns)) > 4_000_000:
                yield from _column_messages(columns, rows, blocks)
                columns, rows = [], []
        if columns:
            yield from _column_messages(columns, rows, blocks)

    return documents.mapInArrow(
        scan, "kind int, block int, columns binary, rows binary"
    )


_FIELDS = [("kind", pa.int32()), ("block", pa.int32()), ("columns", pa.binary()), ("rows", pa.binary())]


def _record(count: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(given[name], kind) if name in given else pa.nulls(count, kind) for name, kind in _FIELDS],
        [name for name, _ in _FIELDS],
    )


def document_sets(documents: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id``, the key of its set, ``n_shingles``, and the ``tie`` that tells a row without an id."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            grams, ends = gram_sets(part.column("text"), settings.words)
            columns = [part.column("doc_id"), pa.array(set_keys(grams, ends)), pa.array(np.diff(ends)), part.column("tie")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "set", "n_shingles", "tie"])

    tied = documents.withColumn("tie", F.when(F.col("doc_id").isNull(), F.xxhash64("text")))
    return tied.mapInArrow(scan, "doc_id bigint, set bigint, n_shingles bigint, tie bigint")


def _block_of(columns: np.ndarray, blocks: int) -> np.ndarray:
    return ((columns >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _within(columns: np.ndarray) -> np.ndarray:
    """What tells columns of one block apart: 32 bits, as a block's size is fixed. Two columns that agree are taken as
    one, which can only let more rows through to the exact count."""
    return mixed(columns).astype(np.uint32)


def _column_messages(columns: list, rows: list, blocks: int) -> Iterator[pa.RecordBatch]:
    column, row = np.concatenate(columns), np.concatenate(rows)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    new = np.append(True, column[1:] != column[:-1])
    many = ~new | np.append(~new[1:], False)
    shared, times = np.unique(row[many], return_counts=True)
    own = _block_of(mixed(shared.view(np.uint64)), blocks)
    turn = np.argsort(own, kind="stable")
    shared, times = shared[turn], times[turn].astype(np.uint32)
    spots, counts = np.unique(own, return_counts=True)
    yield _record(
        len(spots),
        kind=np.full(len(spots), 2, np.int32),
        block=spots.astype(np.int32),
        columns=[x.tobytes() for x in np.split(times, np.cumsum(counts)[:-1])] if len(spots) else [],
        rows=[x.tobytes() for x in np.split(shared, np.cumsum(counts)[:-1])] if len(spots) else [],
    )
    column, row = column[new], row[new]
    block = _block_of(column, blocks)
    cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    ends = np.append(cuts[1:], len(block))
    yield _record(
        len(cuts),
        kind=np.ones(len(cuts), np.int32),
        block=block[cuts].astype(np.int32),
        columns=[_within(column[a:b]).tobytes() for a, b in zip(cuts, ends)],
        rows=[row[a:b].tobytes() for a, b in zip(cuts, ends)],
    )


def _joined(parts: pd.Series, kind) -> np.ndarray:
    return np.frombuffer(b"".join(parts), kind)


def meeting_rows(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns of one block that each row shares with another task's row, and those known to be shared within a task."""
    here = frame["kind"] == 2
    known, times = _joined(frame.loc[here, "rows"], np.int64), _joined(frame.loc[here, "columns"], np.uint32)
    frame = frame[~here]
    column, row = _joined(frame["columns"], np.uint32), _joined(frame["rows"], np.int64)
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    same = column[1:] == column[:-1]
    met = row[np.append(same, False) | np.append(False, same)] if len(row) else row
    rows, place = np.unique(np.concatenate([known, met]), return_inverse=True)
    total = np.bincount(place, np.concatenate([times, np.ones(len(met), np.uint32)]), len(rows))
    return pd.DataFrame({"set": rows, "met": total.astype(np.int64)})


# Step 2: full rows, counted by column and cut to what can still link.


def reduced_columns(row_blocks: DataFrame, blocks: int) -> DataFrame:
    """For every row block its columns that other rows have as well, with the number of rows in all row blocks."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                column, count = np.unique(np.frombuffer(part["columns"], np.uint64), return_counts=True)
                block = _block_of(column, blocks)
                cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, int)
                ends = np.append(cuts[1:], len(block))
                yield pa.RecordBatch.from_pydict(
                    {
                        "row_block": pa.array([part["row_block"]] * len(cuts), pa.int64()),
                        "block": pa.array(block[cuts].astype(np.int32)),
                        "columns": pa.array([_within(column[a:b]).tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                        "counts": pa.array([count[a:b].astype(np.int64).tobytes() for a, b in zip(cuts, ends)], pa.binary()),
                    }
                )

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        column, count = _joined(frame["columns"], np.uint32), _joined(frame["counts"], np.int64)
        unique, place = np.unique(column, return_inverse=True)
        total = np.bincount(place, count, len(unique)).astype(np.int64)[place]
        output, low = [], 0
        for row_block, block, own in zip(frame["row_block"], frame["block"], frame["columns"]):
            high = low + len(own) // 4
            keep = total[low:high] > 1
            output.append((row_block, block, column[low:high][keep].tobytes(), total[low:high][keep].tobytes()))
            low = high
        return pd.DataFrame(output, columns=["row_block", "block", "columns", "counts"])

    sent = row_blocks.select("row_block", "columns").mapInArrow(
        send, "row_block bigint, block int, columns binary, counts binary"
    )
    return sent.groupBy("block").applyInPandas(add, "row_block bigint, block int, columns binary, counts binary")


def prefix_rows(settings: Settings, blocks: int):
    """Function of one row block and its column counts: rows that can link, their columns and their first columns."""

    def cut(key: tuple, rows: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        held = counts["columns"].map(len).to_numpy(np.int64) // 4
        known = np.repeat(counts["block"].to_numpy(np.uint64), held) << np.uint64(32) | _joined(counts["columns"], np.uint32)
        order = np.argsort(known)
        known, total = known[order], _joined(counts["counts"], np.int64)[order]
        output = []
        for part in rows.itertuples():
            columns = np.frombuffer(part.columns, np.uint64)
            for key, low, high in zip(part.sets, np.append(0, part.ends[:-1]), part.ends):
                own = columns[low:high]
                name = _block_of(own, blocks).astype(np.uint64) << np.uint64(32) | _within(own)
                at = np.minimum(np.searchsorted(known, name), max(0, len(known) - 1))
                met = known[at] == name if len(known) else np.zeros(len(own), bool)
                least = int(needed(np.array([len(own)]), settings.percent)[0])
                if met.sum() < least:
                    continue
                first = len(own) - least + 1 - int((~met).sum())  # columns of this row alone come first
                rank = np.lexsort((own[met], total[at[met]]))[: max(0, first)]
                bits = np.zeros(1024, np.uint8)
                np.bitwise_xor.at(bits, (own & np.uint64(1023)).astype(np.int64), 1)
                output.append(
                    (key, len(own), own.tobytes(), np.packbits(bits).view(np.int64), own[met][rank].view(np.int64))
                )
        return pd.DataFrame(output, columns=["set", "size", "grams", "bits", "prefix"])

    return cut


# Step 3: pairs, first with each column's first row, then between rows not yet connected.


def _bounds(percent: int) -> Column:
    """Whether sizes and bit maps of two rows allow a link: overlap <= (sizes - differing bits) / 2."""
    differ = "aggregate(zip_with(a_bits, b_bits, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    return F.expr(
        f"100 * least(a_size, b_size) >= {percent} * greatest(a_size, b_size) and "
        f"({100 + percent}) * floor((a_size + b_size - {differ}) / 2) >= {percent} * (a_size + b_size)"
    )


def verified(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets whose overlap, counted in full, reaches the threshold."""
    wanted = pairs.select(F.col("b").alias("set")).distinct()
    held = rows.join(wanted, "set", "left_semi").select(F.col("set").alias("b"), F.col("grams").alias("b_grams"))
    both = pairs.join(rows.select(F.col("set").alias("a"), F.col("grams").alias("a_grams")), "a").join(held, "b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for one, two in zip(batch.column("a_grams").to_pylist(), batch.column("b_grams").to_pylist()):
                x, y = np.frombuffer(one, np.uint64), np.frombuffer(two, np.uint64)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                overlap = int((y[at] == x).sum())
                keep.append(100 * overlap >= percent * (len(x) + len(y) - overlap))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "a_grams", "b_grams").mapInArrow(count, "a bigint, b bigint")


def _with_sides(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    one = rows.select(F.col("set").alias("a"), F.col("size").alias("a_size"), F.col("bits").alias("a_bits"))
    two = rows.select(F.col("set").alias("b"), F.col("size").alias("b_size"), F.col("bits").alias("b_bits"))
    return pairs.join(one, "a").join(two, "b")


def linked_sets(rows: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) that connect all sets that links connect."""
    entries = cut_lineage(rows.select("set", F.explode("prefix").alias("column")))
    links = None
    component = rows.select("set", F.col("set").alias("component"))
    for turn in range(settings.stars):
        # The first row of a column, by a hash that differs with the turn; partial minima, so a hot column is no task's.
        placed = entries if turn == 0 else entries.join(component, "set")
        own = F.col("set") if turn == 0 else F.col("component")
        order = F.struct(F.xxhash64(F.lit(turn), "set").alias("h"), F.col("set"), own.alias("c"))
        first = cut_lineage(placed.groupBy("column").agg(F.min(order).alias("first")))
        pairs = (
            placed.join(first, "column")
            .where(own != F.col("first.c"))
            .groupBy(F.col("set").alias("a"), F.col("first.set").alias("b"))
            .agg(F.count("*").alias("met"))
            .groupBy("a")
            .agg(F.max_by("b", F.struct("met", "b")).alias("b"))
        )
        pairs = cut_lineage(_with_sides(pairs, rows).where(_bounds(settings.percent)).select("a", "b"))
        new = cut_lineage(verified(pairs, rows, settings.percent))
        links = new if links is None else cut_lineage(links.unionByName(new))
        known = connected_components(links)
        component = cut_lineage(
            rows.select("set").join(known, F.col("set") == F.col("node"), "left").select(
                "set", F.coalesce("component", "set").alias("component")
            )
        )
    # Columns whose rows lie in different components.
    placed = cut_lineage(entries.join(component, "set"))
    mixed_columns = cut_lineage(
        placed.groupBy("column")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"))
        .where("low <> high")
        .select("column")
    )
    opened = cut_lineage(placed.join(mixed_columns, "column").select("set", "component", "column"))
    return links.unionByName(product_links(product_blocks(opened, rows, settings), settings.percent))


def product_blocks(opened: DataFrame, rows: DataFrame, settings: Settings) -> DataFrame:
    """Rows that are still open, packed: ``sets``, ``components``, ``ends`` and ``grams`` of a block, and its open columns.

    Rows are ordered by their component's smallest open column, a hash that similar rows share, so that most blocks share
    columns with few others.
    """
    near = opened.groupBy("component").agg(F.min("column").alias("near"))
    order = ["near", "component", "set"]
    each = opened.groupBy("set", "component").agg(F.collect_list("column").alias("opened"))  # a row's first columns
    ordered = cut_lineage(each.join(near, "component").join(rows.select("set", "size", "grams"), "set"))
    # A block ends by the weights of the rows before it, whatever the number of ranges; only sums of ranges are gathered.
    weight = F.greatest(F.col("size"), F.lit(settings.product_entries // settings.product_rows))
    total = ordered.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    ranged = cut_lineage(
        ordered.select(*order, weight.alias("weight"))
        .repartitionByRange(1 + total // (4 * settings.product_entries), *order)
        .withColumn("range", F.spark_partition_id())
    )
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("range").agg(F.sum("weight").alias("weight"))
    starts = sums.select("range", F.coalesce(F.sum("weight").over(earlier), F.lit(0)).alias("start"))
    inside = F.sum("weight").over(Window.partitionBy("range").orderBy(*order)) - F.col("weight")
    numbered = (
        ranged.withColumn("inside", inside)
        .join(starts, "range")
        .select("set", F.floor((F.col("start") + F.col("inside")) / settings.product_entries).alias("block"))
    )
    kinds = pa.schema(
        [
            ("block", pa.int64()),
            *((name, pa.list_(pa.int64())) for name in ("sets", "components", "ends", "opened")),
            ("grams", pa.binary()),
        ]
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows = None, []
        for batch in batches:
            names = ("block", "set", "component", "size", "opened", "grams")
            for block, *row in zip(*(batch.column(name).to_pylist() for name in names)):
                if rows and block != number:
                    yield packed(number, rows)
                    rows = []
                number = block
                rows.append(row)
        if rows:
            yield packed(number, rows)

    def packed(number: int, rows: list[list]) -> pa.RecordBatch:
        sets, components, sizes, opened, grams = zip(*rows)
        lists = [sets, components, np.cumsum(sizes).tolist(), sorted(set().union(*opened))]
        arrays = [pa.array([list(x)], pa.list_(pa.int64())) for x in lists]
        return pa.RecordBatch.from_arrays([pa.array([number]), *arrays, pa.array([b"".join(grams)], pa.binary())], schema=kinds)

    return write_shared(
        ordered.join(numbered, "set")
        .select("block", "set", "component", "size", "opened", "grams")
        .repartition("block")
        .sortWithinPartitions("block", "set")
        .mapInArrow(
            pack,
            "block bigint, sets array<bigint>, components array<bigint>, ends array<bigint>, opened array<bigint>, grams binary",
        ),
        "product-blocks",
    )


def block_pairs(blocks: DataFrame) -> DataFrame:
    """Pairs (one, two) of blocks, one <= two, that share an open column.

    Columns held by the same blocks are one: blocks are told by their number and two sums of their hashes.
    """
    lists = blocks.select("block", F.explode("opened").alias("column"))
    alike = (
        lists.groupBy("column")
        .agg(F.count("*").alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), "block")).alias(f"h{k}") for k in (1, 2)))
        .groupBy("n", "h1", "h2")
        .agg(F.min("column").alias("column"))
        .select("column")
    )
    members = cut_lineage(lists.join(alike, "column"))
    one, two = (members.select("column", F.col("block").alias(name)) for name in ("one", "two"))
    return one.join(two, "column").where("one <= two").select("one", "two").distinct()


@dataclass(frozen=True)
class Block:
    """Rows of the incidence matrix: the columns of all rows one after another, and where each row's end."""

    sets: np.ndarray
    components: np.ndarray
    ends: np.ndarray
    grams: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)


def _shared_entries(block: Block, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the entries of live rows."""
    row = np.repeat(np.arange(len(block.sets)), block.sizes)
    keep = alive[row]
    return row[keep], block.grams[keep]


def overlap_links(one: Block, two: Block, percent: int, dense: int = 40, width: int = 2048) -> list[tuple[int, int]]:
    """Links between rows of two blocks (or of one block with itself) that join different components, as a forest.

    Columns both blocks have add to a matrix of overlaps, those with the fewest pairs first: pair by pair, or from one pair
    in ``dense`` places on as a product of two 0/1 matrices ``width`` columns wide. After each step a pair whose overlap
    so far and whose rows' remaining columns cannot reach its bound is given up.
    """
    a_sizes, b_sizes = one.sizes, two.sizes
    live = 100 * np.minimum.outer(a_sizes, b_sizes) >= percent * np.maximum.outer(a_sizes, b_sizes)
    live &= one.components[:, None] != two.components[None, :]
    if one is two:
        live = np.triu(live, 1)
    wanted = -(-percent * np.add.outer(a_sizes, b_sizes) // (100 + percent))
    a_row, a_gram = _shared_entries(one, live.any(axis=1))
    b_row, b_gram = _shared_entries(two, live.any(axis=0))
    a_names, a_times = np.unique(a_gram, return_counts=True)
    b_names, b_times = np.unique(b_gram, return_counts=True)
    names, a_at, b_at = np.intersect1d(a_names, b_names, assume_unique=True, return_indices=True)
    if not len(names):
        return []
    a_times, b_times = a_times[a_at], b_times[b_at]
    turn = np.argsort(a_times * b_times, kind="stable")
    place = np.empty(len(names), np.int64)
    place[turn] = np.arange(len(names))
    a_times, b_times = a_times[turn], b_times[turn]

    def placed(row: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(names, gram), len(names) - 1)
        known = names[at] == gram
        column, row = place[at[known]], row[known]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    (a_row, a_column), (b_row, b_column) = placed(a_row, a_gram), placed(b_row, b_gram)
    a_starts = np.append(0, np.cumsum(a_times))
    b_starts = np.append(0, np.cumsum(b_times))
    a_left, b_left = np.bincount(a_row, minlength=len(a_sizes)), np.bincount(b_row, minlength=len(b_sizes))
    overlap = np.zeros(live.shape, np.int64)
    low = 0
    while low < len(names):
        live &= overlap + np.minimum.outer(a_left, b_left) >= wanted
        if not live.any():
            return []
        high = min(low + width, len(names))
        a_part, b_part = slice(a_starts[low], a_starts[high]), slice(b_starts[low], b_starts[high])
        a, b = a_row[a_part], b_row[b_part]
        pairs = int((a_times[low:high] * b_times[low:high]).sum())
        if pairs * dense < live.size * (high - low):
            each = b_times[a_column[a_part]]
            within = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            met = b_row[np.repeat(b_starts[a_column[a_part]], each) + within]
            overlap += np.bincount(np.repeat(a, each) * live.shape[1] + met, minlength=live.size).reshape(live.shape)
        else:
            left = np.zeros((len(a_sizes), high - low), np.float32)
            right = np.zeros((len(b_sizes), high - low), np.float32)
            left[a, a_column[a_part] - low] = 1
            right[b, b_column[b_part] - low] = 1
            overlap += (left @ right.T).astype(np.int64)
        a_left -= np.bincount(a, minlength=len(a_sizes))
        b_left -= np.bincount(b, minlength=len(b_sizes))
        low = high
    live &= overlap >= wanted
    known, label = np.unique(np.concatenate([one.components, two.components]), return_inverse=True)
    a_label, b_label = label[: len(a_sizes)], label[len(a_sizes) :]
    root = np.arange(len(known))
    forest = []
    for a in np.flatnonzero(live.any(axis=1)):
        partners = np.flatnonzero(live[a])
        roots, first = np.unique(root[b_label[partners]], return_index=True)
        own = root[a_label[a]]
        forest += [(int(one.sets[a]), int(two.sets[b])) for b in partners[first[roots != own]]]
        root[np.isin(root, roots)] = own
    return forest


def product_links(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between open rows of all pairs of blocks that share an open column."""

    def side(name: str) -> DataFrame:
        parts = (F.col(part).alias(f"{name}_{part}") for part in ("sets", "components", "ends", "grams"))
        return blocks.select(F.col("block").alias(name), *parts)

    def block_of(batch: pa.RecordBatch, name: str, at: int) -> Block:
        numbers = (
            batch.column(f"{name}_{part}")[at].values.to_numpy(zero_copy_only=False) for part in ("sets", "components", "ends")
        )
        return Block(*numbers, np.frombuffer(batch.column(f"{name}_grams")[at].as_buffer(), np.uint64))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, same in enumerate(batch.column("same").to_pylist()):
                one = block_of(batch, "one", at)
                found = overlap_links(one, one if same else block_of(batch, "two", at), percent)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])

    both = block_pairs(blocks).join(side("one"), "one").join(side("two"), "two")
    return both.withColumn("same", F.col("one") == F.col("two")).drop("one", "two").mapInArrow(multiply, "a bigint, b bigint")


def gram_groups(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Number of n-grams and component of every document.

    One row per input row: ``doc_id``, ``n_shingles``, ``component_id``. A document with fewer than ``words`` words has
    its whole sequence as the one n-gram; a null or empty text, or one of white space, has none, links with nothing and is
    its own component. Repeated rows are linked as equal texts are. A null doc_id is linked, but never a component's id
    unless all its documents lack one. Whole texts are read; an empty table gives no rows; extra columns are not read.
    """
    spark = documents.sparkSession
    source = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"])
    total = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tasks = task_count(spark)
    # About one n-gram in 6 bytes of text, and a quarter of them in a prefix.
    blocks = max(tasks, int(total / 24 / settings.column_block))
    sets = write_shared(document_sets(source, settings), "document-sets")
    messages = prefix_entries(source, settings, blocks)
    met = messages.groupBy("block").applyInPandas(meeting_rows, "set bigint, met bigint")
    alive = met.groupBy("set").agg(F.sum("met").alias("met"))
    # A partner may be smaller and share fewer, but has at least the needed part of the size.
    least = F.ceil(F.ceil(F.col("size") * settings.percent / 100) * settings.percent / 100)
    # The text of one document of each remaining set; where all lack an id, a row is told by its text.
    one_each = (
        sets.where("set <> 0")
        .groupBy("set")
        .agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("size"), F.min("tie").alias("tie"))
        .join(alive, "set")
        .where(F.col("met") >= F.least(F.lit(settings.shared), least))
    )
    chosen = cut_lineage(one_each.select("doc_id", F.when(F.col("doc_id").isNull(), F.col("tie")).alias("tie")))
    known, without = chosen.agg(F.count("doc_id"), F.count("tie")).first()
    remaining = chosen.where("doc_id is not null").select("doc_id")
    few = known <= settings.broadcast_ids
    texts = source.join(F.broadcast(remaining) if few else remaining, "doc_id", "left_semi")
    if without:
        ties = chosen.where("tie is not null").select("tie")
        nameless = source.where("doc_id is null").withColumn("tie", F.xxhash64("text")).join(ties, "tie", "left_semi")
        texts = texts.unionByName(nameless.dropDuplicates(["tie"]).drop("tie"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        seen: set[int] = set()
        for part in text_slices(batches, most_bytes=6 * settings.row_block):
            grams, ends = gram_sets(part.column("text"), settings.words)
            keys = set_keys(grams, ends)
            own = [i for i in range(len(keys)) if keys[i] and keys[i] not in seen and not seen.add(keys[i])]
            if not own:
                continue
            yield pa.RecordBatch.from_pydict(
                {
                    "row_block": pa.array([number], pa.int64()),
                    "sets": pa.array([keys[own]], pa.list_(pa.int64())),
                    "ends": pa.array([np.cumsum(np.diff(ends)[own])], pa.list_(pa.int64())),
                    "columns": pa.array([b"".join(grams[ends[i] : ends[i + 1]].tobytes() for i in own)], pa.binary()),
                }
            )
            number += 1

    row_blocks = write_shared(
        texts.mapInArrow(gather, "row_block bigint, sets array<bigint>, ends array<bigint>, columns binary"), "row-blocks"
    )
    counts = reduced_columns(row_blocks, blocks)
    rows = write_shared(
        row_blocks.groupBy("row_block")
        .cogroup(counts.groupBy("row_block"))
        .applyInPandas(
            prefix_rows(settings, blocks), "set bigint, size bigint, grams binary, bits array<bigint>, prefix array<bigint>"
        ),
        "rows",
    )
    links = cut_lineage(linked_sets(rows, settings))
    components = connected_components(links)
    least = sets.where("set <> 0").groupBy("set").agg(F.min("doc_id").alias("least"))
    grouped = least.join(components, F.col("set") == F.col("node"), "left").withColumn(
        "component", F.coalesce("component", "set")
    )
    smallest = cut_lineage(grouped.groupBy("component").agg(F.min("least").alias("component_id")))
    of_set = cut_lineage(grouped.select("set", "component").join(smallest, "component").select("set", "component_id"))
    linked = sets.where("set <> 0").join(of_set, "set").select("doc_id", "n_shingles", "component_id")
    empty = sets.where("set = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(empty)
