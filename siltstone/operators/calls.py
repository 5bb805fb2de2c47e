"""Call graph over extracted symbols and caller-supplied call edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.checks import require_found

# Symbol kinds that can be called.
CALLABLE_KINDS = ["function", "method"]


def is_callable(kind: Column) -> Column:
    return kind.isin(CALLABLE_KINDS)


def call_nodes(symbols: DataFrame, *scope: str) -> DataFrame:
    """Functions and methods; one node per qualified name (the first declaration when a name repeats)."""
    first = F.min(F.struct("line_number", "name", "kind", "relative_path"))
    return (
        symbols.where(is_callable(F.col("kind")))
        .groupBy(*scope, "qualified_name")
        .agg(first.alias("n"))
        .select(*scope, "qualified_name", "n.name", "n.kind", "n.relative_path", "n.line_number")
    )


def call_edges(edges: DataFrame, nodes: DataFrame, *scope: str) -> DataFrame:
    """Edges whose caller is a node; callees may lie outside the graph."""
    callers = nodes.select(*scope, F.col("qualified_name").alias("caller"))
    return edges.join(callers, [*scope, "caller"], "left_semi")


def get_node(nodes: DataFrame, qualified_name: str) -> DataFrame:
    return require_found(
        nodes.where(F.col("qualified_name") == qualified_name), f"no callable node '{qualified_name}'"
    )


def callees_of(edges: DataFrame, qualified_name: str) -> DataFrame:
    """Calls made by one function or method, in order."""
    return edges.where(F.col("caller") == qualified_name).orderBy("caller", "callee", "line_number")


def node_documents(nodes: DataFrame) -> DataFrame:
    return nodes.select(
        F.to_json(F.struct("qualified_name", "name", "kind", "relative_path", "line_number")).alias("document")
    )


def edge_documents(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct("caller", "callee", "line_number")).alias("document"))
