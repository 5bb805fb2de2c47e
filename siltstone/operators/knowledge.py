"""Knowledge graph: files, packages, symbols, capabilities, patterns and interfaces with their relations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.paths import package_path, qualified_name
from siltstone.operators.checks import require_found

NODE_COLUMNS = ["identifier", "kind", "label", "relative_path", "attributes"]


def node_id(kind: str, raw: Column) -> Column:
    """Identifier namespaced by kind."""
    return F.concat(F.lit(f"{kind}:"), raw)


def symbol_id(path: Column, name: Column, owner: Column | None = None) -> Column:
    return node_id("symbol", qualified_name(path, name, owner))


def pattern_id(path: Column, subject: Column, name: Column) -> Column:
    return node_id("pattern", qualified_name(path, name, subject))


def interface_id(path: Column, name: Column) -> Column:
    return node_id("interface", qualified_name(path, name))


def capability_id(path: Column, name: Column) -> Column:
    return node_id("capability", qualified_name(path, name))


def entity_id(path: Column) -> Column:
    return node_id("entity", path)


def package_id(node: Column) -> Column:
    return node_id("package", node)


def _nodes(frame: DataFrame, scope: tuple[str, ...], kind: str, identifier: Column, label: Column, attributes: Column) -> DataFrame:
    path = F.col("relative_path") if "relative_path" in frame.columns else F.lit(None).cast("string")
    return frame.select(
        *scope,
        identifier.alias("identifier"),
        F.lit(kind).alias("kind"),
        label.alias("label"),
        path.alias("relative_path"),
        attributes.cast("array<string>").alias("attributes"),
    )


def knowledge_nodes(
    *scope: str,
    symbols: DataFrame | None = None,
    patterns: DataFrame | None = None,
    interfaces: DataFrame | None = None,
    candidates: DataFrame | None = None,
    packages: DataFrame | None = None,
) -> DataFrame:
    """Union of the node kinds of the given relations; one node per identifier.

    Files are nodes whenever any relation mentions them.
    """
    path, name = F.col("relative_path"), F.col("name")
    empty = F.array().cast("array<string>")
    parts = []
    if symbols is not None:
        identifier = node_id("symbol", F.col("qualified_name"))
        parts.append(_nodes(symbols, scope, "symbol", identifier, name, F.array("kind")))
    if patterns is not None:
        identifier = pattern_id(path, F.col("subject_name"), name)
        parts.append(_nodes(patterns, scope, "pattern", identifier, name, F.col("evidence")))
    if interfaces is not None:
        parts.append(_nodes(interfaces, scope, "interface", interface_id(path, name), name, F.col("method_signatures")))
    if candidates is not None:
        parts.append(_nodes(candidates, scope, "capability", capability_id(path, name), name, F.array("kind")))
    entities = [
        _nodes(frame.select(*scope, "relative_path"), scope, "entity", entity_id(path), path, empty)
        for frame in (symbols, patterns, interfaces, candidates)
        if frame is not None
    ]
    if packages is not None:
        node = F.col("node_id")
        parts.append(_nodes(packages, scope, "package", package_id(node), node, empty))
    union = reduce(DataFrame.unionByName, parts + entities)
    first = F.min(F.struct("kind", "label", "relative_path", "attributes")).alias("n")
    return union.groupBy(*scope, "identifier").agg(first).select(*scope, "identifier", "n.*")


def knowledge_relations(
    *scope: str,
    symbols: DataFrame | None = None,
    patterns: DataFrame | None = None,
    interfaces: DataFrame | None = None,
    candidates: DataFrame | None = None,
    packages: DataFrame | None = None,
) -> DataFrame:
    """declares (file to concept), extends (interface to base name), belongs_to_package (file to package)."""
    path, name = F.col("relative_path"), F.col("name")

    def relation(frame: DataFrame, source: Column, target: Column, kind: str) -> DataFrame:
        return frame.select(*scope, source.alias("source"), target.alias("target"), F.lit(kind).alias("kind"))

    parts, files = [], []
    targets = [
        (symbols, lambda: node_id("symbol", F.col("qualified_name"))),
        (patterns, lambda: pattern_id(path, F.col("subject_name"), name)),
        (interfaces, lambda: interface_id(path, name)),
        (candidates, lambda: capability_id(path, name)),
    ]
    for frame, target in targets:
        if frame is not None:
            parts.append(relation(frame, entity_id(path), target(), "declares"))
            files.append(frame.select(*scope, "relative_path"))
    if interfaces is not None:
        based = interfaces.select(*scope, "relative_path", "name", F.explode("base_interfaces").alias("base"))
        parts.append(relation(based, interface_id(path, name), node_id("interface", F.col("base")), "extends"))
    if packages is not None:
        members = reduce(DataFrame.unionByName, files).distinct().withColumn("package_path", package_path("relative_path"))
        joined = members.join(packages.select(*scope, "package_path", "node_id"), [*scope, "package_path"])
        parts.append(relation(joined, entity_id(path), package_id(F.col("node_id")), "belongs_to_package"))
    return reduce(DataFrame.unionByName, parts).distinct()


def get_node(nodes: DataFrame, identifier: str) -> DataFrame:
    return require_found(nodes.where(F.col("identifier") == identifier), f"no knowledge node '{identifier}'")


def relations_from(relations: DataFrame, identifier: str) -> DataFrame:
    """Relations leaving one node, in order."""
    return relations.where(F.col("source") == identifier).orderBy("source", "target", "kind")


def node_documents(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.to_json(F.struct(*NODE_COLUMNS), {"ignoreNullFields": "false"}).alias("document"))


def relation_documents(relations: DataFrame) -> DataFrame:
    return relations.select(F.to_json(F.struct("source", "target", "kind")).alias("document"))
