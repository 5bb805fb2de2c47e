"""Working copies of a table of repositories, made by tasks in a folder that all executors share."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from siltstone.session import spread_rows

COPIES = "repository_id string, root string, commit_id string, error_message string"


def git_output(*arguments: str, seconds: float = 300.0) -> tuple[str, str | None]:
    """Output of a git command, and what went wrong if it failed, could not start or took too long."""
    try:
        ended = subprocess.run(["git", *arguments], capture_output=True, text=True, errors="replace", timeout=seconds)
    except (OSError, subprocess.TimeoutExpired) as problem:
        return "", f"git {arguments[0]}: {problem}"
    return ended.stdout.strip(), ended.stderr.strip() or "git failed" if ended.returncode else None


def working_copies(
    repositories: DataFrame, folder: str, branch: str | None = None, seconds: float = 300.0, partitions: int | None = None
) -> DataFrame:
    """(repository_id, root, commit_id, error_message) of every repository (``id``, ``source_uri``, ``default_branch``).

    A copy is made under a name of its own and renamed when it is whole, so a task that runs again, or twice at once,
    finds or replaces nothing half done; a copy that is there already is used as it is. A clone that fails gives a row
    with ``error_message`` and no root.
    """

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for repository, uri, own in batch.itertuples(index=False):
                root, problem = os.path.join(folder, repository), None
                if not os.path.isdir(root):
                    part = f"{root}.{uuid.uuid4().hex}"
                    _, problem = git_output("clone", "--depth", "1", "--branch", branch or own, uri, part, seconds=seconds)
                    if problem is None:
                        try:
                            os.rename(part, root)
                        except OSError:  # another attempt was first
                            shutil.rmtree(part)
                commit, unread = git_output("-C", root, "rev-parse", "HEAD") if problem is None else (None, None)
                problem = problem or unread
                rows.append((repository, None if problem else root, None if problem else commit, problem))
            yield pd.DataFrame(rows, columns=["repository_id", "root", "commit_id", "error_message"])

    wanted = repositories.select("id", "source_uri", "default_branch")
    return spread_rows(wanted, "id", partitions=partitions).mapInPandas(copy, COPIES)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
