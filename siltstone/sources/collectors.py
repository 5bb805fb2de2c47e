"""Turn repository references into repository rows."""

from __future__ import annotations

import os
import sys
from collections import deque
from collections.abc import Iterator
from functools import reduce
from pathlib import Path

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import ValidationError
from siltstone.functions.text import is_blank, strip_sql
from siltstone.session import cut_lineage, spread_rows

# What a GitHub owner and repository name, and a GitLab path segment, may look like.
GITHUB_OWNER = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?"
GITHUB_NAME = "[A-Za-z0-9._-]{1,100}"
GITLAB_SEGMENT = "[A-Za-z0-9._-]{1,100}"
# Directories a task looks into before it hands the rest back to be dealt out again.
DIRECTORIES_A_TURN = 256

_HOSTED = {
    "github": ("github.com", f"{GITHUB_OWNER}/{GITHUB_NAME}"),
    "gitlab": ("gitlab.com", f"{GITLAB_SEGMENT}(?:/{GITLAB_SEGMENT})+"),
}


def strip_git_suffix(reference: Column) -> Column:
    return F.regexp_replace(reference, "\\.git\\z", "")


def hosted_path(source: str, provider: str) -> Column:
    """``owner/name`` of an https, ssh or short reference in column ``source``; null when it is none of them."""
    host, path = _HOSTED[provider]
    candidate = strip_git_suffix(F.regexp_replace(F.expr(strip_sql(source)), "/+\\z", ""))
    host = host.replace(".", "\\.")
    found = F.regexp_extract(candidate, f"\\A(?:https://{host}/|git@{host}:)?({path})\\z", 1)
    return F.when(found != "", found)


def collect_hosted(sources: DataFrame, provider: str) -> DataFrame:
    """One result row per reference: name and canonical URI, or an error. The job fails on a blank reference."""
    host = _HOSTED[provider][0]
    blank = F.raise_error(F.lit("source must not be empty")).cast("string")
    path = F.when(is_blank("source"), blank).otherwise(hosted_path("source", provider))
    staged = sources.withColumn("_path", path)
    found = F.col("_path").isNotNull()
    return staged.withColumns(
        {
            "succeeded": found,
            "name": F.substring_index("_path", "/", -1),
            "source_uri": F.concat(F.lit(f"https://{host}/"), F.col("_path"), F.lit(".git")),
            "provider": F.when(found, provider),
            "error_message": F.when(~found, F.concat(F.lit(f"not a valid {provider} reference: "), F.col("source"))),
        }
    ).drop("_path")


def collect_filesystem(spark: SparkSession, source: str) -> DataFrame:
    """One result row for one existing directory."""
    if not source.strip():
        raise ValidationError("source must not be empty")
    path = Path(source).expanduser()
    row = (source, False, None, None, None, f"not a directory: '{path}'")
    if path.is_dir():
        resolved = path.resolve()
        row = (source, True, resolved.name or str(resolved), str(resolved), "filesystem", None)
    return spark.createDataFrame([row], RESULT)


RESULT = "source string, succeeded boolean, name string, source_uri string, provider string, error_message string"
_FOUND = "source string, path string, depth int, found boolean"


def _expand(max_depth: int | None, a_turn: int):
    """Repositories below the given directories, and the directories that are still open after ``a_turn`` of them."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        looked = 0
        for batch in batches:
            rows, pending = [], deque(batch.itertuples(index=False, name=None))
            while pending:
                source, path, depth, found = pending.popleft()
                if found or looked >= a_turn:
                    rows.append((source, path, depth, found))
                    continue
                looked += 1
                try:
                    entries = [entry for entry in os.scandir(path) if entry.is_dir()]
                except OSError:
                    continue
                if any(entry.name == ".git" for entry in entries):
                    rows.append((source, path, depth, True))
                elif max_depth is None or depth < max_depth:
                    pending.extend(
                        (source, entry.path, depth + 1, False)
                        for entry in entries
                        if not entry.name.startswith(".") and not entry.is_symlink()
                    )
            yield pd.DataFrame(rows, columns=batch.columns)

    return step


def collect_local(
    spark: SparkSession, source: str, max_depth: int | None = None, a_turn: int = DIRECTORIES_A_TURN
) -> DataFrame:
    """Repositories (directories holding ``.git``) below a root, not looking inside them.

    Open directories are dealt out to all tasks turn by turn until none is left, so broad and deep trees are scanned by
    many tasks; the tree must be visible to all executors. ``max_depth`` bounds the levels looked into, where a caller
    wants that.
    """
    if not source.strip():
        raise ValidationError("source must not be empty")
    root = Path(source).expanduser()
    if not root.is_dir():
        return spark.createDataFrame([(source, False, None, None, None, f"not a directory: '{root}'")], RESULT)
    frontier = spark.createDataFrame([(source, str(root.resolve()), 0, False)], _FOUND)
    turns = []
    while True:
        turn = cut_lineage(spread_rows(frontier, "path").mapInPandas(_expand(max_depth, a_turn), _FOUND))
        turns.append(turn.where("found"))
        frontier = turn.where("not found")
        if not frontier.limit(1).collect():
            break
    return reduce(DataFrame.unionByName, turns).select(
        "source",
        F.lit(True).alias("succeeded"),
        F.coalesce(F.nullif(F.substring_index("path", "/", -1), F.lit("")), F.col("path")).alias("name"),
        F.col("path").alias("source_uri"),
        F.lit("local").alias("provider"),
        F.lit(None).cast("string").alias("error_message"),
    )


def collect(spark: SparkSession, source: str, provider: str) -> DataFrame:
    """Collect with the provider named in the configuration."""
    if provider in _HOSTED:
        return collect_hosted(spark.createDataFrame([(source,)], "source string"), provider)
    if provider == "filesystem":
        return collect_filesystem(spark, source)
    if provider == "local":
        return collect_local(spark, source)
    raise ValidationError(f"unknown provider '{provider}'")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
