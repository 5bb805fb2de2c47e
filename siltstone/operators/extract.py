"""Facts projected from parsed files: imports, counts, symbols, package units, interfaces, candidates, patterns.

Every projection is built from arrays of one row and exploded once, so none of them shuffles.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import paths
from siltstone.operators.parse import successful

PARSE_COLUMNS = [
    "relative_path",
    "succeeded",
    "language",
    "metadata",
    "modules",
    "classes",
    "functions",
    "imports",
    "exports",
    "symbols",
    "error_message",
]
# Base class names that make a Python class an interface.
ABSTRACT_BASES = ["ABC", "abc.ABC", "Protocol", "typing.Protocol"]

_SYMBOL = "named_struct('qualified_name', {qualified}, 'name', {row}.name, 'kind', '{kind}', 'line_number', {row}.line_number)"
_LOCAL = "concat(relative_path, '::', {row}.name)"

SYMBOLS_SQL = "concat({}, flatten({}), {}, {})".format(
    "transform(classes, c -> " + _SYMBOL.format(qualified=_LOCAL.format(row="c"), row="c", kind="class") + ")",
    "transform(classes, c -> transform(c.methods, m -> "
    + _SYMBOL.format(
        qualified="concat(relative_path, '::', concat_ws('.', nullif(c.name, ''), m.name))", row="m", kind="method"
    )
    + "))",
    "transform(functions, f -> " + _SYMBOL.format(qualified=_LOCAL.format(row="f"), row="f", kind="function") + ")",
    "transform(filter(symbols, s -> s.kind = 'constant'), s -> "
    + _SYMBOL.format(qualified=_LOCAL.format(row="s"), row="s", kind="constant")
    + ")",
)

_INTERFACE = (
    "named_struct('name', {row}.name, 'origin', '{origin}', 'method_signatures', {methods}, "
    "'base_interfaces', {bases}, 'line_number', {row}.line_number)"
)
_NONE = "cast(array() as array<string>)"
INTERFACES_SQL = "concat({}, {}, {})".format(
    "transform(filter(symbols, s -> s.kind = 'interface'), s -> "
    + _INTERFACE.format(row="s", origin="language_interface", methods=_NONE, bases=_NONE)
    + ")",
    "transform(filter(symbols, s -> s.kind = 'trait'), s -> "
    + _INTERFACE.format(row="s", origin="trait", methods=_NONE, bases=_NONE)
    + ")",
    "transform(filter(classes, c -> arrays_overlap(c.base_classes, array({}))), c -> ".format(
        ", ".join(f"'{base}'" for base in ABSTRACT_BASES)
    )
    + _INTERFACE.format(
        row="c", origin="abstract_class", methods="transform(c.methods, m -> m.name)", bases="c.base_classes"
    )
    + ")",
)

_CANDIDATE = (
    "named_struct('name', {row}.name, 'kind', '{kind}', "
    "'is_public', array_contains(public, {row}.name), "
    "'has_docstring', {row}.docstring is not null, 'signals', cast(array() as array<string>), "
    "'line_number', {row}.line_number)"
)
# ``public`` is bound once per file; the exported names are not listed again for every candidate.
CANDIDATES_SQL = (
    "element_at(transform(array(transform(exports, e -> e.name)), public -> "
    "concat(transform(classes, c -> {}), transform(functions, f -> {}))), 1)"
).format(_CANDIDATE.format(row="c", kind="class"), _CANDIDATE.format(row="f", kind="function"))


class PatternRule(NamedTuple):
    """A named pattern: ``subject`` is class or function, ``test`` a SQL condition on the record ``x``."""

    name: str
    subject: str
    test: str
    description: str
    evidence: str = "x.decorators"


# The reference leaves the pattern vocabulary to its user; these three cover its own examples.
DEFAULT_PATTERNS = [
    PatternRule(
        "dataclass_value_object",
        "class",
        "exists(x.decorators, d -> d rlike r'\\A(?:dataclasses\\.)?dataclass\\b')",
        "class declared as a dataclass",
    ),
    PatternRule(
        "decorated_extension_point",
        "function",
        "exists(x.decorators, d -> d rlike r'(?:register|plugin|hook)')",
        "function registered through a decorator",
    ),
    PatternRule(
        "factory_function",
        "function",
        "x.name rlike r'\\A(?:create|make|build)_' and x.return_type is not null",
        "function that builds and returns an object",
        "array(x.return_type)",
    ),
]


def identity_columns(parsed: DataFrame) -> list[str]:
    """Columns that travel with a file, such as repository_id and ordinal."""
    return [name for name in parsed.columns if name not in PARSE_COLUMNS]


def require_parsed(parsed: DataFrame) -> DataFrame:
    """All rows, but the job fails on the first file that was not parsed."""
    problem = F.concat(F.lit("cannot extract from a file that was not parsed: "), F.col("relative_path"))
    return parsed.where(F.when(F.col("succeeded"), F.lit(True)).otherwise(F.raise_error(problem).cast("boolean")))


def _exploded(parsed: DataFrame, array: str, *columns: str) -> DataFrame:
    """One row per element, with its position inside the file."""
    keys = identity_columns(parsed)
    return (
        successful(parsed)
        .selectExpr(*keys, "relative_path", f"posexplode({array}) as (position, row)")
        .selectExpr(*keys, "relative_path", "position", *columns)
    )


def import_edges(parsed: DataFrame) -> DataFrame:
    """One edge per import statement item; nothing is sorted or removed."""
    return _exploded(
        parsed,
        "imports",
        "row.module as target_module",
        "row.imported_names",
        "row.alias",
        "row.is_relative as is_internal",
        "row.line_number",
    )


def ast_counts(parsed: DataFrame) -> DataFrame:
    """Eleven counts per file. Free functions and methods are apart, except in the async and documented counts."""
    members = "flatten(transform(classes, c -> c.methods))"
    return successful(parsed).selectExpr(
        *identity_columns(parsed),
        "relative_path",
        "size(classes) as class_count",
        "size(functions) as function_count",
        f"size({members}) as method_count",
        "size(imports) as import_count",
        "size(exports) as export_count",
        "size(symbols) as symbol_count",
        "size(modules) as module_count",
        f"size(filter(functions, f -> f.is_async)) + size(filter({members}, f -> f.is_async)) as async_function_count",
        "size(filter(classes, c -> c.docstring is not null)) as documented_class_count",
        "size(filter(functions, f -> f.docstring is not null)) "
        f"+ size(filter({members}, f -> f.docstring is not null)) as documented_function_count",
        "metadata.line_count as line_count",
    )


def symbols(parsed: DataFrame) -> DataFrame:
    """Classes, then methods, then functions, then constants, with qualified names."""
    return _exploded(parsed, SYMBOLS_SQL, "row.qualified_name", "row.name", "row.kind", "row.line_number")


def package_units(parsed: DataFrame) -> DataFrame:
    """The package of each file, whether the file marks its root, and the modules it declares."""
    return successful(parsed).select(
        *identity_columns(parsed),
        "relative_path",
        paths.package_path("relative_path").alias("package_path"),
        paths.is_package_root("relative_path").alias("is_package_root"),
        F.col("modules").alias("declared_modules"),
    )


def interfaces(parsed: DataFrame) -> DataFrame:
    """Interface and trait symbols, then classes with an abstract or protocol base."""
    return _exploded(
        parsed,
        INTERFACES_SQL,
        "row.name",
        "row.origin",
        "row.method_signatures",
        "row.base_interfaces",
        "row.line_number",
    )


def candidates(parsed: DataFrame) -> DataFrame:
    """Classes, then functions, with visibility and documentation flags."""
    return _exploded(
        parsed,
        CANDIDATES_SQL,
        "row.name",
        "row.kind",
        "row.is_public",
        "row.has_docstring",
        "row.signals",
        "row.line_number",
    )


def patterns(parsed: DataFrame, rules: list[PatternRule] = DEFAULT_PATTERNS) -> DataFrame:
    """One row per class or function and rule it meets."""
    found = [
        f"transform(filter({'classes' if rule.subject == 'class' else 'functions'}, x -> {rule.test}), "
        f"x -> named_struct('name', '{rule.name}', 'subject_name', x.name, 'description', '{rule.description}', "
        f"'line_number', x.line_number, 'evidence', {rule.evidence}))"
        for rule in rules
    ]
    return _exploded(
        parsed,
        f"concat({', '.join(found)})",
        "row.name",
        "row.subject_name",
        "row.description",
        "row.line_number",
        "row.evidence",
    )
