"""Integrity rules, evaluated as one aggregation per relation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.errors import IntegrityError, NotFoundError, ValidationError

_FILLED = "not ({column} is null or {column} rlike r'(?U)\\A[\\s\\x1c-\\x1f]*\\z')"
_RATIO = "{column} between 0.0D and 1.0D"
_SORTED_SET = "{column} = array_sort(array_distinct({column}))"


def filled(column: str) -> str:
    return _FILLED.format(column=column)


def ratio(column: str) -> str:
    return _RATIO.format(column=column)


def sorted_set(column: str) -> str:
    return _SORTED_SET.format(column=column)


def not_negative(*columns: str) -> str:
    return " and ".join(f"{column} >= 0" for column in columns)


def envelope(*payload: str) -> dict[str, str]:
    """Rules of a result row: success carries no error, failure carries one and an empty payload."""
    rules = {
        "error only on failure": "not succeeded or error_message is null",
        "failure has an error": "succeeded or error_message is not null",
    }
    for column in payload:
        rules[f"no {column} on failure"] = f"succeeded or coalesce(size({column}), 0) <= 0"
    return rules


# Row rules of every relation: rule name -> SQL condition that must hold.
RULES: dict[str, dict[str, str]] = {
    "repositories": {"name filled": filled("name"), "source_uri filled": filled("source_uri")},
    "source_files": {"relative_path filled": filled("relative_path"), "size not negative": not_negative("size_bytes")},
    "findings": {"category filled": filled("category"), "message filled": filled("message")},
    "collections": envelope("repositories"),
    "parse_results": {
        **envelope("modules", "classes", "functions", "imports", "exports", "symbols"),
        "metadata on success": "not succeeded or metadata is not null",
        "no metadata on failure": "succeeded or metadata is null",
    },
    "ast_metadata": {
        f"{name} not negative": not_negative(name)
        for name in (
            "class_count",
            "function_count",
            "method_count",
            "import_count",
            "export_count",
            "symbol_count",
            "module_count",
            "async_function_count",
            "documented_class_count",
            "documented_function_count",
            "line_count",
        )
    },
    "architecture_assessments": {"declared_module_count not negative": not_negative("declared_module_count")},
    "complexity_metrics": {
        "methods_per_class not negative": not_negative("methods_per_class"),
        "lines_per_function not negative": not_negative("lines_per_function"),
        "async_function_ratio in 0..1": ratio("async_function_ratio"),
        "counts not negative": not_negative("class_count", "function_count", "method_count"),
    },
    "dependency_profiles": {
        "counts not negative": not_negative(
            "total_dependency_count", "internal_dependency_count", "external_dependency_count"
        ),
        "parts add up": "internal_dependency_count + external_dependency_count = total_dependency_count",
        "external_targets sorted set": sorted_set("external_targets"),
    },
    "documentation_coverage": {
        "counts not negative": not_negative("class_count", "function_count"),
        "documented counts not negative": not_negative("documented_class_count", "documented_function_count"),
        "documented classes within classes": "documented_class_count <= class_count",
        "documented functions within functions": "documented_function_count <= function_count",
        **{
            f"{name} in 0..1": ratio(name)
            for name in (
                "class_documentation_ratio",
                "function_documentation_ratio",
                "overall_documentation_ratio",
            )
        },
    },
    "density_metrics": {
        "line_count not negative": not_negative("line_count"),
        **{
            f"{name} not negative": not_negative(name)
            for name in ("classes_per_kloc", "functions_per_kloc", "methods_per_kloc", "symbols_per_kloc")
        },
    },
    "quality_assessments": {
        "counts not negative": not_negative("candidate_count", "public_candidate_count"),
        "public within all": "public_candidate_count <= candidate_count",
        "documented_public_ratio in 0..1": ratio("documented_public_ratio"),
    },
    "security_assessments": {
        "external_dependency_count not negative": not_negative("external_dependency_count"),
        "external_targets sorted set": sorted_set("external_targets"),
    },
    "test_evidence": {"counts not negative": not_negative("test_function_count", "test_class_count")},
    "quality_indicators": {"subject_name filled": filled("subject_name"), "message filled": filled("message")},
    "test_indicators": {"subject_name filled": filled("subject_name"), "message filled": filled("message")},
    "security_indicators": {"subject filled": filled("subject"), "message filled": filled("message")},
    "package_edges": {
        "child is directly below parent": "size(child_path) = size(parent_path) + 1 "
        "and slice(child_path, 1, size(parent_path)) = parent_path"
    },
    "call_nodes": {"kind callable": "kind in ('function', 'method')"},
    "call_edges": {"caller filled": filled("caller"), "callee filled": filled("callee")},
    "dependency_nodes": {"identifier filled": filled("identifier")},
    "dependency_edges": {"source filled": filled("source"), "target filled": filled("target")},
    "knowledge_nodes": {"identifier carries its kind": "startswith(identifier, concat(kind, ':'))"},
    "knowledge_relations": {"source filled": filled("source"), "target filled": filled("target")},
    "comparisons": {
        "left filled": filled("left_subject_id"),
        "right filled": filled("right_subject_id"),
        "subjects differ": "left_subject_id <> right_subject_id",
        "shared_signals sorted set": sorted_set("shared_signals"),
    },
    "scores": {"subject_id filled": filled("subject_id"), "score in 0..1": ratio("score")},
    "members": {
        "subject_id filled": filled("subject_id"),
        "name filled": filled("name"),
        "relative_path filled": filled("relative_path"),
        "score in 0..1": ratio("score"),
    },
    "rejections": {"subject_id filled": filled("subject_id"), "message filled": filled("message")},
    "exports": {
        "format_version filled": filled("format_version"),
        "member_count not negative": not_negative("member_count"),
        "checksum is 64 hex digits": "checksum rlike '\\\\A[0-9a-f]{64}\\\\z'",
    },
    "memory": {"memory_type filled": filled("memory_type")},
    "vectors": {
        "embedding not empty": "size(embedding) > 0",
        "embedding finite": "forall(embedding, v -> not isnan(v) and abs(v) < double('infinity'))",
    },
    "matches": {"score in 0..1": ratio("score")},
    "step_outcomes": {
        "step_name filled": filled("step_name"),
        "error only on failure": "not succeeded or error_message is null",
        "failure has an error": "succeeded or error_message is not null",
    },
}
# Result rows of the extractors and analyses share the envelope rules; these are their payload columns.
for _relation, _payload in {
    "import_results": "edges",
    "symbol_results": "symbols",
    "interface_results": "interfaces",
    "candidate_results": "candidates",
    "pattern_results": "patterns",
}.items():
    RULES[_relation] = envelope(_payload)
for _relation, _payload in {
    "package_unit_results": "unit",
    "ast_results": "metadata",
    "architecture_results": "assessment",
    "complexity_results": "metrics",
    "dependency_results": "profile",
    "documentation_results": "coverage",
    "density_results": "metrics",
    "quality_results": "assessment",
    "security_results": "assessment",
    "test_results": "evidence",
}.items():
    RULES[_relation] = {
        **envelope(),
        f"{_payload} on success": f"not succeeded or {_payload} is not null",
        f"no {_payload} on failure": f"succeeded or {_payload} is null",
    }
# Columns whose combination must be unique.
UNIQUE: dict[str, list[list[str]]] = {
    "repositories": [["id"], ["source_uri"]],
    "source_files": [["id"]],
    "analysis_runs": [["id"]],
    "findings": [["id"]],
    "package_nodes": [["package_path"]],
    "package_edges": [["child_path"]],
    "call_nodes": [["qualified_name"]],
    "dependency_nodes": [["identifier"]],
    "knowledge_nodes": [["identifier"]],
    "subjects": [["subject_id"]],
    "scores": [["subject_id"]],
    "members": [["subject_id"]],
    "rejections": [["subject_id"]],
    "memory": [["id"]],
    "vectors": [["id"]],
    "matches": [["id"]],
}


def rule_violations(frame: DataFrame, rules: dict[str, str], relation: str = "rows") -> DataFrame:
    """(relation, rule, violations) for every rule, from a single pass over the rows."""
    counts = [
        F.count_if(~F.coalesce(F.expr(condition), F.lit(False))).alias(f"rule_{at}")
        for at, condition in enumerate(rules.values())
    ]
    pairs = ", ".join("'{}', rule_{}".format(name.replace("'", "\\'"), at) for at, name in enumerate(rules))
    return frame.agg(*counts).selectExpr(
        f"'{relation}' as relation", f"stack({len(rules)}, {pairs}) as (rule, violations)"
    )


def duplicates(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once."""
    return frame.groupBy(*keys).count().where("count > 1")


def missing(frame: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Rows whose key is absent from ``known``."""
    return frame.join(known.select(F.col(known_key).alias(key)), key, "left_anti")


def violations(frame: DataFrame, relation: str, scope: list[str] | None = None) -> DataFrame:
    """All row and uniqueness rules of a relation; ``scope`` columns (repository_id) widen every unique key."""
    parts = []
    if RULES.get(relation):
        parts.append(rule_violations(frame, RULES[relation], relation))
    for keys in UNIQUE.get(relation, []):
        parts.append(
            duplicates(frame, (scope or []) + keys)
            .agg(F.count("*").alias("violations"))
            .selectExpr(f"'{relation}' as relation", f"'unique {', '.join(keys)}' as rule", "violations")
        )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def require_valid(frame: DataFrame, relation: str, scope: list[str] | None = None) -> DataFrame:
    """Return ``frame`` unchanged, or raise when any rule is broken."""
    broken = violations(frame, relation, scope).where("violations > 0").collect()  # one row per rule
    if broken:
        listed = ", ".join(f"{row.rule} ({row.violations})" for row in broken)
        unique = any(row.rule.startswith("unique ") for row in broken)
        raise (IntegrityError if unique else ValidationError)(f"{relation}: {listed}")
    return frame


def require_empty(frame: DataFrame, message: str, error: type[Exception] = ValidationError) -> None:
    """Raise with an example when a frame of offending rows is not empty."""
    example = frame.limit(1).collect()
    if example:
        raise error(f"{message}: {example[0].asDict()}")


def require_found(frame: DataFrame, message: str) -> DataFrame:
    """Return ``frame`` unchanged, or raise when it has no row."""
    if not frame.limit(1).collect():
        raise NotFoundError(message)
    return frame
