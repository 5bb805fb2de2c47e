"""The repository analysis: collect, clone, read, parse, extract, build the package tree."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import ConfigurationError, GitError, ValidationError
from siltstone.operators import extract, packages
from siltstone.operators.analyze import quality
from siltstone.operators.parse import parse_files, successful
from siltstone.operators.records import SCHEMAS
from siltstone.operators.store import add_rows, load_latest, save_generation
from siltstone.session import cut_lineage
from siltstone.sources.collectors import collect
from siltstone.sources.files import read_files
from siltstone.sources.git import working_copies


def unpack_repositories(results: DataFrame) -> DataFrame:
    """Repository rows of successful collection results; a failed result is an error."""
    failed = results.where("not succeeded").limit(1).collect()
    if failed:
        raise ValidationError(failed[0].error_message)
    now = F.current_timestamp()
    return results.select(
        F.sha2("source_uri", 256).substr(1, 32).alias("id"),
        "name",
        "source_uri",
        "provider",
        F.lit("main").alias("default_branch"),
        F.lit("pending").alias("status"),
        F.parse_json(F.lit("{}")).alias("metadata"),
        now.alias("created_at"),
        now.alias("updated_at"),
    )


def persist_repositories(path: str, repositories: DataFrame) -> DataFrame:
    """Add the repositories to the stored table; returns their ids."""
    spark = repositories.sparkSession
    known = load_latest(spark, path, spark.createDataFrame([], SCHEMAS["repositories"]).schema)
    save_generation(add_rows(known, repositories, "id", ("source_uri",)), path)
    return repositories.select("id")


def checked_copies(repositories: DataFrame, folder: str, branch: str | None = None) -> DataFrame:
    """(repository_id, root) of all repositories, each cloned once; a failed clone is an error."""
    copies = cut_lineage(working_copies(repositories, folder, branch))
    failed = copies.where("error_message is not null").limit(1).collect()
    if failed:
        raise GitError(f"{failed[0].repository_id}: {failed[0].error_message}")
    return copies.select("repository_id", "root")


def analyze_files(files: DataFrame, folder: str) -> dict[str, DataFrame]:
    """Parse results of (repository_id, relative_path, content), all extractions and the package tree, by name.

    Parse results are written once below ``folder``, since every extraction reads them, each only its own columns.
    """
    scope = ("repository_id",)
    place = f"{folder}/parsed-{uuid4().hex}"
    results = parse_files(files)
    results.write.parquet(place)
    results = files.sparkSession.read.schema(results.schema).parquet(place)
    parsed = successful(results)
    units = extract.package_units(parsed)
    nodes = packages.package_nodes(units, *scope)
    return {
        "parse_results": results,
        "imports": extract.import_edges(parsed),
        "ast_counts": extract.ast_counts(parsed),
        "symbols": extract.symbols(parsed),
        "package_units": units,
        "interfaces": extract.interfaces(parsed),
        "candidates": extract.candidates(parsed),
        "quality": quality(parsed),
        "package_nodes": nodes,
        "package_edges": packages.package_edges(nodes, *scope),
        "package_files": packages.package_files(units, *scope),
    }


def analyze_source(spark: SparkSession, source: str) -> dict[str, DataFrame]:
    """Collect, store, clone, read and analyse the repositories a source names.

    Settings are entries of the session: ``spark.siltstone.folder`` (required: a folder all executors share, for working
    copies, the repository table and parse results), ``spark.siltstone.provider`` and ``spark.siltstone.branch``.
    """
    folder = spark.conf.get("spark.siltstone.folder", None)
    if not folder:
        raise ConfigurationError("spark.siltstone.folder must name a folder all executors share")
    provider = spark.conf.get("spark.siltstone.provider", "filesystem")
    repositories = cut_lineage(unpack_repositories(collect(spark, source, provider)))
    persist_repositories(f"{folder}/repositories", repositories)
    copies = checked_copies(repositories, f"{folder}/copies", spark.conf.get("spark.siltstone.branch", None))
    return {"repositories": repositories, **analyze_files(read_files(copies), folder)}
