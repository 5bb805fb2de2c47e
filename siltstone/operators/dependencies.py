"""Import graph: resolve every import edge to a file, an external module or an unresolved target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.errors import IntegrityError, ValidationError
from siltstone.functions import paths
from siltstone.functions.text import is_blank
from siltstone.operators.checks import require_found
from siltstone.operators.spread import HOT_ROWS, spread_join

# Identifier prefixes of targets that are not files.
EXTERNAL, UNRESOLVED = "external:", "unresolved:"
# File names tried for a target path, in order of preference.
PYTHON_MODULE = ["{}/__init__.py", "{}.py", "{}/__init__.pyi", "{}.pyi"]
PYTHON_PACKAGE = ["{}/__init__.py", "{}/__init__.pyi"]
TYPESCRIPT = ["{}", "{}.ts", "{}.tsx", "{}/index.ts", "{}/index.tsx"]

REQUEST = ["family", "path", "package"]
# A hash of scope and request, first of the keys: paths begin alike, so sorts would compare them to their ends.
_HASH = "_request"


def file_problems(files: DataFrame, *scope: str) -> DataFrame:
    """Files whose path is blank, reserved, absolute, outside the repository, or the same as another one's."""
    path = F.col("relative_path")
    key = paths.normalize(path)
    problem = (
        F.when(is_blank(path), "blank path")
        .when(F.startswith(path, F.lit(EXTERNAL)) | F.startswith(path, F.lit(UNRESOLVED)), "reserved prefix")
        .when(paths.is_absolute(path), "absolute path")
        .when(key.isNull() | (key == ""), "names no file inside the repository")
    )
    bad = files.select(*scope, path, problem.alias("problem")).where("problem is not null")
    twice = (
        files.groupBy(*scope, key.alias("key"))
        .agg(F.min("relative_path").alias("relative_path"), F.count("*").alias("n"))
        .where("n > 1")
        .select(*scope, "relative_path", F.lit("same path twice").alias("problem"))
    )
    return bad.unionByName(twice)


def _with_request(edges: DataFrame) -> DataFrame:
    """Add what is looked up for an edge (family, path, package) and what it becomes when nothing is found.

    The work is staged so that each stage reads the columns of the one before it a few times at most; Spark may
    inline stages into pushed-down filters, and wide reuse would then multiply the expressions.
    """
    module, up, language = F.col("target_module"), F.col("is_internal"), F.col("_language")
    staged = (
        edges.withColumn("_key", paths.normalize("relative_path"))
        .withColumns(
            {
                "_language": F.coalesce(paths.language_of("relative_path"), F.lit("none")),
                "_directory": paths.directory_of("_key"),
                "_dots": F.length(module) - F.length(F.ltrim(module, F.lit("."))),
                "_single": F.when(F.size("imported_names") == 1, F.col("imported_names")[0]),
            }
        )
        .withColumns(
            {
                # Directories left after climbing; negative when the import climbs above the root.
                "_left": paths.depth_of(F.col("_directory")) - F.col("_dots") + 1,
                "_module": paths.python_module_path(F.substr(module, F.col("_dots") + 1)),
                "_member": F.when(paths.is_path_component("_single"), F.col("_single")),
            }
        )
    )
    is_specifier = paths.is_relative_specifier(module)
    bare = F.length(module) == F.col("_dots")
    python = (
        F.when(~up, F.when((F.col("_dots") == 0) & F.col("_module").isNotNull(), "absolute").otherwise("external"))
        .when((F.col("_dots") == 0) | (F.col("_left") < 0), "qualified")
        .when(bare, F.when(F.col("_member").isNotNull(), "member").otherwise("package"))
        .when(F.col("_module").isNotNull(), "module")
        .otherwise("qualified")
    )
    form = (
        F.when(language == "python", python)
        .when(~up, "external")
        .when((language == "typescript") & F.startswith(module, F.lit("/")), "rooted")
        .when((language == "typescript") & is_specifier, "script")
        .when((language == "go") & is_specifier, "directory")
        .when((language == "cpp") & ~paths.is_absolute(module), "include")
        .otherwise("qualified")
    )
    base = F.expr("substring_index(_directory, '/', greatest(_left, 0))")
    target = (
        F.when(F.col("_form") == "absolute", F.col("_module"))
        .when(F.col("_form") == "module", paths.append_path(F.col("_base"), F.col("_module")))
        .when(F.col("_form") == "member", paths.append_path(F.col("_base"), F.col("_member")))
        .when(F.col("_form").isin("script", "directory", "include"), paths.join_path(F.col("_directory"), module))
    )
    staged = staged.withColumns({"_form": form, "_base": base}).withColumn("_target", target)
    # A relative path that leaves the repository has no target.
    form = F.when(F.col("_form").isin("script", "directory", "include") & F.col("_target").isNull(), "qualified").otherwise(F.col("_form"))
    staged = staged.withColumn("_form", form)
    form = F.col("_form")
    # Never null: a nullable key would make Spark push its null check, with all stages inlined, to the scan.
    looked_up = form.isin("module", "member", "package", "script", "include")
    family = F.when(form == "absolute", "module").when(looked_up, form).otherwise("none")
    otherwise = (
        F.when(form.isin("external", "absolute"), F.concat(F.lit(EXTERNAL), module))
        .when(form == "rooted", F.concat(F.lit(UNRESOLVED), module))
        .when(form == "package", F.concat(F.lit(UNRESOLVED), F.col("_base")))
        .when(form == "qualified", F.concat(F.lit(UNRESOLVED), F.col("_key"), F.lit("#"), module))
        .otherwise(F.concat(F.lit(UNRESOLVED), F.col("_target")))
    )
    blank = F.raise_error(F.concat(F.lit("blank import target in "), F.col("relative_path"))).cast("string")
    return staged.select(
        *edges.columns,
        F.coalesce(family, F.lit("none")).alias("family"),
        F.when((form == "absolute") | looked_up, F.coalesce("_target", F.lit(""))).otherwise("").alias("path"),
        F.when(form.isin("member", "package"), F.coalesce("_base", F.lit(""))).otherwise("").alias("package"),
        F.when(is_blank(module), blank).otherwise(otherwise).alias("otherwise"),
    )


def _candidates() -> Column:
    """The file names a request stands for, best first."""
    path, package = F.col("path"), F.col("package")

    def named(templates: list[str], stem: Column) -> Column:
        return F.array(*[F.concat(stem, F.lit(template.removeprefix("{}"))) for template in templates])

    names = (
        F.when(F.col("family") == "module", named(PYTHON_MODULE, path))
        .when(F.col("family") == "member", F.concat(named(PYTHON_MODULE, path), named(PYTHON_PACKAGE, package)))
        .when(F.col("family") == "package", named(PYTHON_PACKAGE, package))
        .when(F.col("family") == "script", named(TYPESCRIPT, path))
        .when(F.col("family") == "include", F.array(path))
    )
    return F.transform(names, lambda name: F.regexp_replace(name, "\\A/+", ""))


def with_request(edges: DataFrame, *scope: str) -> DataFrame:
    """Edges with what each of them looks up, for ``request_lookups`` and ``resolve_requests``, which may share a copy."""
    return _with_request(edges).withColumn(_HASH, F.xxhash64(*scope, *REQUEST))


def edge_lookups(edges: DataFrame, *scope: str) -> DataFrame:
    """``relative_path`` and ``lookup`` of every edge that looks for a file: the path it asks for and how, at most two."""
    return request_lookups(_with_request(edges), *scope)


def request_lookups(wanted: DataFrame, *scope: str) -> DataFrame:
    """``edge_lookups`` of edges that have their request already."""
    path, package = (F.regexp_replace(name, "\\A/+", "") for name in ("path", "package"))
    family = F.col("family")
    by_path = F.concat(F.when(family == "member", "module").otherwise(family), F.lit(":"), path)
    by_package = F.concat(F.lit("package:"), package)
    lookups = (
        F.when(family == "member", F.array(by_path, by_package))
        .when(family == "package", F.array(by_package))
        .when(family != "none", F.array(by_path))
    )
    return wanted.select(*scope, "relative_path", F.explode(lookups).alias("lookup"))


def lookups_naming(file_key: Column) -> Column:
    """All lookups that can have this file as their answer: one for each file name that is tried."""
    tried = [("module", PYTHON_MODULE), ("package", PYTHON_PACKAGE), ("script", TYPESCRIPT), ("include", ["{}"])]
    stems = []
    for family, templates in tried:
        for suffix in (template.removeprefix("{}") for template in templates):
            stem = F.when(F.endswith(file_key, F.lit(suffix)), F.substr(file_key, F.lit(1), F.length(file_key) - len(suffix)))
            if suffix.startswith("/"):
                stem = F.when(file_key == suffix[1:], "").otherwise(stem)
            stems.append(F.concat(F.lit(f"{family}:"), stem))
    return F.array_distinct(F.array_compact(F.array(*stems)))


def resolve_imports(
    edges: DataFrame, files: DataFrame, *scope: str, hot_rows: int = HOT_ROWS, carried: tuple[str, ...] = ()
) -> DataFrame:
    """Relation edges (source, target, target_kind, is_internal, imported_names, alias, line_number, columns ``carried``).

    Equal lookups are collapsed first: each distinct request of a repository is matched against the files
    once, and its answer is joined back to the edges with hot requests split over tasks. Edges are neither
    merged nor dropped.
    """
    return resolve_requests(with_request(edges, *scope), files, *scope, hot_rows=hot_rows, carried=carried)


def resolve_requests(
    wanted: DataFrame, files: DataFrame, *scope: str, hot_rows: int = HOT_ROWS, carried: tuple[str, ...] = ()
) -> DataFrame:
    """``resolve_imports`` of edges that have their request already (``with_request``)."""
    keys = [_HASH, *scope, *REQUEST]
    # The joins below ask for keys that are not null; asked here too, all of them read the same counts.
    filled = " and ".join(f"`{key}` is not null" for key in keys)
    requests = wanted.where(filled).groupBy(*keys).agg(F.count("*").alias("rows"))
    index = files.select(*scope, paths.normalize("relative_path").alias("file_key"), F.col("relative_path").alias("found"))
    name = F.xxhash64(*scope, "file_key")
    answers = (
        # The outer form, as the filter of the other one would reach the scan and have the requests counted once more.
        requests.select(*keys, "rows", F.posexplode_outer(_candidates()).alias("position", "file_key"))
        .withColumn("_name", name)
        .join(index.withColumn("_name", name), ["_name", *scope, "file_key"])
        .groupBy(*keys)
        .agg(F.min_by("found", "position").alias("found"), F.max("rows").alias("rows"))
    )
    joined = spread_join(
        wanted, answers, keys, ["relative_path", "line_number", "target_module"], counts=requests, hot_rows=hot_rows
    )
    kind = (
        F.when(F.col("found").isNotNull(), "internal_file")
        .when(F.startswith("otherwise", F.lit(EXTERNAL)), "external_module")
        .otherwise("unresolved_internal")
    )
    return joined.select(
        *scope,
        F.col("relative_path").alias("source"),
        F.coalesce("found", "otherwise").alias("target"),
        kind.alias("target_kind"),
        (kind != "external_module").alias("is_internal"),
        "imported_names",
        "alias",
        "line_number",
        *carried,
    )


def dependency_nodes(resolved: DataFrame, files: DataFrame, *scope: str) -> DataFrame:
    """All files, plus each external or unresolved target once."""
    internal = files.select(*scope, F.col("relative_path").alias("identifier"), F.lit("internal_file").alias("kind"))
    others = (
        resolved.where("target_kind <> 'internal_file'")
        .select(*scope, F.col("target").alias("identifier"), F.col("target_kind").alias("kind"))
        .distinct()
    )
    return internal.unionByName(others)


def build_graph(edges: DataFrame, files: DataFrame, *scope: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the import graph after checking the files."""
    example = file_problems(files, *scope).limit(1).collect()
    if example:
        twice = example[0].problem == "same path twice"
        raise (IntegrityError if twice else ValidationError)(f"unusable file: {example[0].asDict()}")
    resolved = resolve_imports(edges, files, *scope)
    return dependency_nodes(resolved, files, *scope), resolved.drop("target_kind")


def edge_order() -> list[Column]:
    """Total order of relation edges."""
    return [
        F.col("source"),
        F.col("target"),
        F.col("line_number"),
        F.col("imported_names"),
        F.col("alias").isNotNull(),
        F.coalesce("alias", F.lit("")),
    ]


def get_node(nodes: DataFrame, identifier: str) -> DataFrame:
    """The node with this identifier; raises when there is none."""
    return require_found(nodes.where(F.col("identifier") == identifier), f"no dependency node '{identifier}'")


def outgoing_edges(edges: DataFrame, identifier: str) -> DataFrame:
    """Edges leaving one file, in edge order."""
    return edges.where(F.col("source") == identifier).orderBy(*edge_order())


def resolve_outgoing(edges: DataFrame, files: DataFrame, identifier: str, *scope: str) -> DataFrame:
    """The relation edges of one file, in edge order, resolving its own imports only."""
    own = edges.where(F.col("relative_path") == identifier)
    return resolve_imports(own, files, *scope).orderBy(*edge_order())


def node_documents(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.to_json(F.struct("identifier", "kind")).alias("document"))


def edge_documents(edges: DataFrame) -> DataFrame:
    """One JSON document per edge; a missing alias is written as null."""
    fields = F.struct("source", "target", "is_internal", "imported_names", "alias", "line_number")
    return edges.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("document"))
