"""Package tree: directories as nodes, containment as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.checks import require_found


def ancestor_paths_sql(path: str) -> str:
    """All proper prefixes of a package path, the root included."""
    return f"filter(transform(sequence(0, size({path})), i -> slice({path}, 1, i)), a -> size(a) < size({path}))"


def package_files(units: DataFrame, *scope: str) -> DataFrame:
    """Distinct files of each package; kept as rows because one package may hold most files."""
    return units.select(*scope, "package_path", "relative_path").distinct()


def package_nodes(units: DataFrame, *scope: str) -> DataFrame:
    """Every package and ancestor with its number of direct files and whether a root file marks it.

    Files are counted once per distinct path, with partial counts before each shuffle. Ancestors are added to
    the per-package sums, not to the files, so the second shuffle carries packages only.
    """
    direct = units.groupBy(*scope, "package_path").agg(
        F.count_distinct("relative_path").alias("file_count"), F.bool_or("is_package_root").alias("marked")
    )
    spread = direct.selectExpr(
        *scope,
        "package_path as own_path",
        "file_count",
        "marked",
        "explode(transform(sequence(0, size(package_path)), i -> slice(package_path, 1, i))) as package_path",
    )
    own = F.col("own_path") == F.col("package_path")
    return (
        spread.groupBy(*scope, "package_path")
        .agg(
            F.sum(F.when(own, F.col("file_count")).otherwise(0)).alias("file_count"),
            F.bool_or(own & F.col("marked")).alias("has_package_root_file"),
        )
        .selectExpr(
            *scope,
            "array_join(package_path, '/') as node_id",
            "package_path",
            "size(package_path) as depth",
            "file_count",
            "has_package_root_file",
        )
    )


def package_edges(nodes: DataFrame, *scope: str) -> DataFrame:
    """Parent of every package but the root."""
    return nodes.where("size(package_path) > 0").selectExpr(
        *scope,
        "array_join(slice(package_path, 1, size(package_path) - 1), '/') as parent_id",
        "node_id as child_id",
        "slice(package_path, 1, size(package_path) - 1) as parent_path",
        "package_path as child_path",
    )


def get_node(nodes: DataFrame, node_id: str) -> DataFrame:
    """The node with this id; raises when there is none."""
    return require_found(nodes.where(F.col("node_id") == node_id), f"no package node '{node_id}'")


def direct_children(nodes: DataFrame, edges: DataFrame, node_id: str, *scope: str) -> DataFrame:
    """Packages directly below one package."""
    children = edges.where(F.col("parent_id") == node_id).select(*scope, F.col("child_id").alias("node_id"))
    return nodes.join(children, [*scope, "node_id"], "left_semi")


def node_documents(nodes: DataFrame) -> DataFrame:
    """One JSON document per node."""
    return nodes.select(F.to_json(F.struct("node_id", "package_path", "file_count", "has_package_root_file")).alias("document"))


def edge_documents(edges: DataFrame) -> DataFrame:
    """One JSON document per edge."""
    return edges.select(F.to_json(F.struct("parent_id", "child_id", "parent_path", "child_path")).alias("document"))
