"""Per-file measurements derived from extracted facts.

The file-level analyses read arrays of one row. The edge-level ones take relations and aggregate them with
map-side partial sums, so a file or source holding a large share of all edges never ends up in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions.numbers import coverage_ratio, per_kloc, safe_ratio
from siltstone.functions.paths import is_test_file
from siltstone.operators.extract import CANDIDATES_SQL, SYMBOLS_SQL, identity_columns
from siltstone.operators.parse import successful


def architecture(units: DataFrame) -> DataFrame:
    """Package depth and number of declared modules per file."""
    return units.withColumns(
        {
            "declared_module_count": F.size("declared_modules"),
            "package_depth": F.size("package_path"),
        }
    ).drop("declared_modules")


def complexity(counts: DataFrame) -> DataFrame:
    """Methods per class, lines per free function, share of async functions.

    The async count covers methods too, so its ratio is taken over functions and methods; that keeps it
    inside 0..1.
    """
    callables = F.col("function_count") + F.col("method_count")
    return counts.select(
        *_keys(counts),
        safe_ratio(F.col("method_count"), F.col("class_count")).alias("methods_per_class"),
        safe_ratio(F.col("line_count"), F.col("function_count")).alias("lines_per_function"),
        safe_ratio(F.col("async_function_count"), callables).alias("async_function_ratio"),
        "class_count",
        "function_count",
        "method_count",
    )


def documentation(counts: DataFrame) -> DataFrame:
    """Documented shares of classes, of functions with methods, and of both together."""
    functions = F.col("function_count") + F.col("method_count")
    documented = F.col("documented_class_count") + F.col("documented_function_count")
    return counts.select(
        *_keys(counts),
        "class_count",
        "documented_class_count",
        coverage_ratio(F.col("documented_class_count"), F.col("class_count")).alias("class_documentation_ratio"),
        functions.alias("function_count"),
        "documented_function_count",
        coverage_ratio(F.col("documented_function_count"), functions).alias("function_documentation_ratio"),
        coverage_ratio(documented, F.col("class_count") + functions).alias("overall_documentation_ratio"),
    )


def density(counts: DataFrame) -> DataFrame:
    """Classes, functions, methods and symbols per thousand lines."""
    return counts.select(
        *_keys(counts),
        "line_count",
        *[
            per_kloc(F.col(f"{noun}_count"), F.col("line_count")).alias(name)
            for noun, name in (
                ("class", "classes_per_kloc"),
                ("function", "functions_per_kloc"),
                ("method", "methods_per_kloc"),
                ("symbol", "symbols_per_kloc"),
            )
        ],
    )


def _keys(counts: DataFrame) -> list[str]:
    """Identity columns of a counts frame: everything that is not a count."""
    return [name for name in counts.columns if not name.endswith("_count")]


def dependency_profile(edges: DataFrame, *keys: str) -> DataFrame:
    """Total, internal, external and distinct external dependencies per key.

    Edges need ``is_internal`` and ``target_module``. They are summed per (key, target) first, so the second
    sum sees each distinct target once however often it occurs.
    """
    per_target = edges.groupBy(*keys, "target_module").agg(
        F.count("*").alias("total"), F.count_if("is_internal").alias("internal")
    )
    return per_target.groupBy(*keys).agg(
        F.sum("total").alias("total_dependency_count"),
        F.sum("internal").alias("internal_dependency_count"),
        F.sum(F.col("total") - F.col("internal")).alias("external_dependency_count"),
        F.count_if(F.col("total") > F.col("internal")).alias("external_target_count"),
    )


def external_targets(edges: DataFrame, *keys: str) -> DataFrame:
    """Distinct external targets, one row per key and target."""
    return edges.where(~F.col("is_internal")).select(*keys, "target_module").distinct()


def dependencies(parsed: DataFrame) -> DataFrame:
    """Dependency counts and sorted distinct external targets per file."""
    return successful(parsed).selectExpr(
        *identity_columns(parsed),
        "relative_path",
        "size(imports) as total_dependency_count",
        "size(filter(imports, i -> i.is_relative)) as internal_dependency_count",
        "size(filter(imports, i -> not i.is_relative)) as external_dependency_count",
        "array_sort(array_distinct(transform(filter(imports, i -> not i.is_relative), i -> i.module))) "
        "as external_targets",
    )


def quality(parsed: DataFrame) -> DataFrame:
    """Candidate counts, documented share of public candidates, and one indicator per undocumented public one."""
    frame = successful(parsed).selectExpr(
        *identity_columns(parsed), "relative_path", f"{CANDIDATES_SQL} as found"
    )
    public, documented = "filter(found, c -> c.is_public)", "filter(found, c -> c.is_public and c.has_docstring)"
    return (
        frame.selectExpr(
            "*",
            "size(found) as candidate_count",
            f"size({public}) as public_candidate_count",
            f"size({documented}) as documented_public_count",
            "transform(filter(found, c -> c.is_public and not c.has_docstring), c -> named_struct("
            "'subject_name', c.name, 'relative_path', relative_path, 'severity', 'low', "
            "'message', concat('public ', c.kind, ' has no documentation'), 'line_number', c.line_number)) "
            "as indicators",
        )
        .withColumn(
            "documented_public_ratio",
            coverage_ratio(F.col("documented_public_count"), F.col("public_candidate_count")),
        )
        .drop("found", "documented_public_count")
    )


def security(parsed: DataFrame, watched: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """External exposure per file, with an indicator per import of a watched module.

    ``watched`` maps a module (its submodules included) to a severity and a message; the caller decides what
    deserves attention, as the reference fixes no list.
    """
    listed = "map({})".format(
        ", ".join(f"'{module}', named_struct('severity', '{sev}', 'message', '{msg}')" for module, (sev, msg) in (watched or {}).items())
    )
    if not watched:
        listed = "cast(map() as map<string,struct<severity:string,message:string>>)"
    external = "filter(imports, i -> not i.is_relative)"
    hit = f"filter(map_keys({listed}), w -> i.module = w or startswith(i.module, concat(w, '.')))"
    return successful(parsed).selectExpr(
        *identity_columns(parsed),
        "relative_path",
        f"size({external}) as external_dependency_count",
        f"array_sort(array_distinct(transform({external}, i -> i.module))) as external_targets",
        f"flatten(transform({external}, i -> transform({hit}, w -> named_struct('subject', i.module, "
        f"'relative_path', relative_path, 'severity', {listed}[w].severity, 'message', {listed}[w].message, "
        "'line_number', i.line_number)))) as indicators",
    )


def tests(parsed: DataFrame) -> DataFrame:
    """Whether a file is a test file and how many of its symbols look like tests."""
    return (
        successful(parsed)
        .selectExpr(*identity_columns(parsed), "relative_path", f"{SYMBOLS_SQL} as found")
        .select(
            *identity_columns(parsed),
            "relative_path",
            is_test_file("relative_path").alias("is_test_file"),
            F.expr("size(filter(found, s -> s.kind in ('function', 'method') and startswith(s.name, 'test_')))").alias("test_function_count"),
            F.expr("size(filter(found, s -> s.kind = 'class' and startswith(s.name, 'Test')))").alias("test_class_count"),
            F.expr(
                "transform(filter(found, s -> s.kind = 'class' and startswith(s.name, 'Test') and not exists(found, "
                "o -> o.kind = 'method' and startswith(o.qualified_name, concat(s.qualified_name, '.test_')))), "
                "s -> named_struct('subject_name', s.name, 'relative_path', relative_path, 'severity', 'info', "
                "'message', 'test class declares no test method', 'line_number', s.line_number))"
            ).alias("indicators"),
        )
    )
