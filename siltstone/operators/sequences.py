"""Order rules of stored sequences: rows carry a position, and their sort keys must ascend with it.

Rows are ranged by position. A range is folded, in one streaming pass, to its first and last key and how many neighbours
inside it stand in the wrong order or repeat a key; then the ranges are chained by comparing each one's first key
with the last key before it. One row a range is gathered, never a range.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.errors import IntegrityError, ValidationError
from siltstone.session import task_count


class Order(NamedTuple):
    """Sort keys in SQL, each ascending, and the columns among which no value may repeat."""

    keys: list[str]
    unique: list[str]


# The order of every relation that is stored as a sequence.
ORDERS: dict[str, Order] = {
    "scores": Order(["-score", "subject_id"], ["subject_id"]),
    "members": Order(["-score", "subject_id"], ["subject_id"]),
    "rejections": Order(["subject_id"], ["subject_id"]),
    "selected": Order(["subject_id"], ["subject_id"]),
    "memory": Order(["id"], ["id"]),
    "matches": Order(["-score", "id"], ["id"]),
    "import_nodes": Order(["identifier"], ["identifier"]),
    "import_edges": Order(["source", "target", "line_number"], []),
    "call_nodes": Order(["qualified_name"], ["qualified_name"]),
    "call_edges": Order(["caller", "callee", "line_number"], []),
    "knowledge_nodes": Order(["identifier"], ["identifier"]),
    "knowledge_relations": Order(["source", "target", "kind"], []),
    "package_nodes": Order(["package_path"], ["package_path"]),
    "package_edges": Order(["parent_path", "child_path"], ["child_path"]),
}


def _sortable(value: object) -> tuple:
    """A value that compares as in Spark: null before every value, NaN after."""
    if value is None:
        return (0,)
    return (2,) if value != value else (1, value)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a range: first and last key, neighbours out of order, neighbours with one position."""
    first = last = None
    wrong = repeated = rows = 0
    kinds: list[pa.DataType] = []
    for batch in batches:
        columns = [batch.column(x) for x in batch.schema.names if x != "position"]
        kinds = [x.type for x in columns]
        for row in zip(batch.column("position").to_pylist(), *(x.to_pylist() for x in columns)):
            key = tuple(map(_sortable, row[1:]))
            if last is not None:
                wrong += key < last[1]
                repeated += row[0] == last[0][0]
            last = row, key
            first = first or row
            rows += 1
    if last is not None:
        counts = [pa.array([TaskContext.get().partitionId()], pa.int32())]
        counts += [pa.array([x], pa.int64()) for x in (wrong, repeated, rows)]
        keys = [pa.array([x], kind) for row in (first, last[0]) for x, kind in zip(row[1:], kinds)]
        names = [f"{side}_{at}" for side in ("first", "last") for at in range(len(kinds))]
        yield pa.RecordBatch.from_arrays([*counts, *keys], ["range", "wrong", "repeated", "rows", *names])


def range_folds(frame: DataFrame, order: Order, position: str = "position", ranges: int | None = None) -> DataFrame:
    """One row per non-empty range of positions: its number, rows, faults inside, first and last keys."""
    keyed = frame.select(
        F.col(position).cast("bigint").alias("position"), *(F.expr(x).alias(f"key_{at}") for at, x in enumerate(order.keys))
    )
    kinds = [keyed.schema[f"key_{at}"].dataType.simpleString() for at in range(len(order.keys))]
    schema = "range int, wrong bigint, repeated bigint, rows bigint"
    for side in ("first", "last"):
        schema += "".join(f", {side}_{at} {kind}" for at, kind in enumerate(kinds))
    ranged = keyed.repartitionByRange(ranges or task_count(frame.sparkSession), "position")
    # Rows of one position lie in one range; they are taken in the order of their keys, so that counts do not vary.
    return ranged.sortWithinPartitions(*keyed.columns).mapInArrow(_fold, schema)


def order_violations(
    frame: DataFrame, relation: str, position: str = "position", ranges: int | None = None
) -> DataFrame:
    """(relation, rule, violations): rows before their predecessor, equal positions, and repeated unique values.

    The counts do not depend on the number of ranges. A null position comes first; equal positions count as one fault each.
    """
    order = ORDERS[relation]
    folds = range_folds(frame, order, position, ranges)
    chained = Window.orderBy("range")  # one row per range

    def key(side: str) -> Column:
        # A struct compares like a tuple, and a null within it stands before every value.
        return F.struct(*(F.col(f"{side}_{at}").alias(f"k{at}") for at in range(len(order.keys))))

    linked = folds.select("wrong", "repeated", (key("first") < F.lag(key("last")).over(chained)).alias("broken"))
    rules = linked.agg(
        F.coalesce(F.sum("wrong") + F.count_if("broken"), F.lit(0)).alias("sorted"),
        F.coalesce(F.sum("repeated"), F.lit(0)).alias("positions"),
    ).selectExpr(
        f"'{relation}' as relation",
        f"stack(2, 'sorted by {', '.join(order.keys)}', sorted, 'one row a position', positions) as (rule, violations)",
    )
    if not order.unique:
        return rules
    held = frame.groupBy(*order.unique).agg((F.count("*") - 1).alias("more"))
    repeated = held.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("violations"))
    return rules.unionByName(
        repeated.selectExpr(f"'{relation}' as relation", f"'unique {', '.join(order.unique)}' as rule", "violations")
    )


def require_order(frame: DataFrame, relation: str, position: str = "position") -> DataFrame:
    """Return ``frame`` unchanged, or raise when its rows are not in order or repeat."""
    broken = order_violations(frame, relation, position).where("violations > 0").collect()  # one row per rule
    if broken:
        listed = ", ".join(f"{row.rule} ({row.violations})" for row in broken)
        unique = any(row.rule.startswith("unique ") for row in broken)
        raise (IntegrityError if unique else ValidationError)(f"{relation}: {listed}")
    return frame
