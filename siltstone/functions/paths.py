"""Repository-relative path functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import _col

# Language of each file suffix, in the order parsers are tried.
LANGUAGE_SUFFIXES = {
    "python": [".py", ".pyi"],
    "rust": [".rs"],
    "go": [".go"],
    "typescript": [".ts", ".tsx"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hh", ".hxx", ".h"],
}
# File names that mark a package root.
PACKAGE_ROOT_MARKERS = ["__init__.py", "__init__.pyi", "mod.rs", "index.ts"]
# Directory names that hold tests.
TEST_DIRECTORIES = ["tests", "test"]


def has_extension(path: Column | str, extensions: list[str]) -> Column:
    """Case-insensitive suffix test."""
    lowered = F.lower(_col(path))
    hit = F.lit(False)
    for extension in extensions:
        hit = hit | F.endswith(lowered, F.lit(extension))
    return hit


def language_of(path: Column | str) -> Column:
    """Language name by suffix, or null when no suffix matches."""
    name = F.concat(F.lit("."), F.lower(F.substring_index(_col(path), ".", -1)))
    has_dot = F.instr(_col(path), ".") > 0
    choice = F.when(~has_dot, F.lit(None).cast("string"))
    for language, suffixes in LANGUAGE_SUFFIXES.items():
        choice = choice.when(name.isin(suffixes), F.lit(language))
    return choice


def basename(path: Column | str) -> Column:
    return F.substring_index(_col(path), "/", -1)


def directory_of(key: Column | str) -> Column:
    """Everything before the last slash; empty at the root."""
    key = _col(key)
    return F.substr(key, F.lit(1), F.greatest(F.length(key) - F.length(basename(key)) - 1, F.lit(0)))


def depth_of(directory: Column) -> Column:
    """Number of segments of a normal directory path."""
    slashes = F.length(directory) - F.length(F.replace(directory, F.lit("/"), F.lit("")))
    return F.when(directory == "", 0).otherwise(slashes + 1)


def _has(value: Column, *parts: str) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(value, F.lit(part))
    return hit


def normalize(path: Column | str) -> Column:
    """Resolve ``.``, ``..`` and back-slashes; null when the path climbs above the root."""
    path = _col(path)
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit(False).alias("escaped"))

    def step(state: Column, part: Column) -> Column:
        depth = F.size(state["stack"])
        up = part == ".."
        return F.struct(
            F.when(part.isin("", ".") | (up & (depth == 0)), state["stack"])
            .when(up, F.slice(state["stack"], F.lit(1), F.greatest(depth - 1, F.lit(0))))
            .otherwise(F.array_append(state["stack"], part))
            .alias("stack"),
            (state["escaped"] | (up & (depth == 0))).alias("escaped"),
        )

    folded = F.aggregate(
        F.split(slashed, "/", -1), start, step, lambda state: F.when(~state["escaped"], F.array_join(state["stack"], "/"))
    )
    # Most paths are normal already: no back-slash and no empty or dot segment.
    normal = ~(
        _has(path, "\\", "//", "./") | F.startswith(path, F.lit("/")) | F.endswith(path, F.lit("/")) | F.endswith(path, F.lit("."))
    )
    return F.when(normal, path).otherwise(folded)


def join_path(base: Column, relative: Column) -> Column:
    """``base/relative``, normalised."""
    return normalize(F.when(base == "", relative).otherwise(F.concat(base, F.lit("/"), relative)))


def append_path(base: Column, clean: Column) -> Column:
    """``base/clean`` for parts that are already normal."""
    return F.when(base == "", clean).otherwise(F.concat(base, F.lit("/"), clean))


def is_absolute(path: Column | str) -> Column:
    """Leading slash or drive letter, with either slash."""
    path = _col(path)
    drive = (F.substring(path, 2, 1) == ":") & F.upper(F.substring(path, 1, 1)).between("A", "Z")
    return F.startswith(path, F.lit("/")) | F.startswith(path, F.lit("\\")) | drive


def is_path_component(name: Column | str) -> Column:
    name = _col(name)
    return (name != "") & ~_has(name, "/", "\\", ".")


def python_module_path(dotted: Column | str) -> Column:
    """``a.b`` as ``a/b``; null unless every part is a path component."""
    dotted = _col(dotted)
    gap = F.startswith(dotted, F.lit(".")) | F.endswith(dotted, F.lit("."))
    return F.when((dotted != "") & ~gap & ~_has(dotted, "/", "\\", ".."), F.replace(dotted, F.lit("."), F.lit("/")))


def is_relative_specifier(specifier: Column | str) -> Column:
    specifier = _col(specifier)
    return specifier.isin(".", "..") | F.startswith(specifier, F.lit("./")) | F.startswith(specifier, F.lit("../"))


def package_path(path: Column | str) -> Column:
    """Directory segments of a file path."""
    parts = F.split(_col(path), "/", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def is_package_root(path: Column | str) -> Column:
    return basename(path).isin(PACKAGE_ROOT_MARKERS)


def is_test_file(path: Column | str) -> Column:
    """A directory named tests or test, or a stem (up to the first dot) starting test_ or ending _test."""
    stem = F.substring_index(basename(path), ".", 1)
    return (
        F.exists(package_path(path), lambda part: part.isin(TEST_DIRECTORIES))
        | F.startswith(stem, F.lit("test_"))
        | F.endswith(stem, F.lit("_test"))
    )


def is_test_symbol(name: Column | str, kind: Column | str) -> Column:
    name, kind = _col(name), _col(kind)
    return (
        F.when(kind.isin("function", "method"), F.startswith(name, F.lit("test_")))
        .when(kind == "class", F.startswith(name, F.lit("Test")))
        .otherwise(F.lit(False))
    )


def qualified_name(path: Column | str, name: Column | str, owner: Column | None = None) -> Column:
    """``path::owner.name``; the owner part is left out when there is none."""
    path, name = _col(path), _col(name)
    local = name if owner is None else F.concat_ws(".", F.when(owner != "", owner), name)
    return F.concat(path, F.lit("::"), local)
