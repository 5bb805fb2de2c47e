"""Text files of working copies as rows."""

from __future__ import annotations

import os
import sys
from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import cut_lineage, spread_rows

_LISTED = "repository_id string, root string, path string, is_file boolean"
# Directories a task lists before it hands the rest back to be dealt out again.
DIRECTORIES_A_TURN = 256
# Contents handed to Spark at once.
BATCH_BYTES = 16 * 1024 * 1024


def _entries(folder: str) -> list[tuple[str, bool]]:
    """(path, is_file) of a directory without hidden or linked subdirectories."""
    try:
        found = list(os.scandir(folder))
    except OSError:
        return []
    kept = []
    for entry in found:
        if not entry.is_dir():
            kept.append((entry.path, True))
        elif not entry.name.startswith(".") and not entry.is_symlink():
            kept.append((entry.path, False))
    return kept


def _list(a_turn: int):
    """Files below the given directories, and the directories that are still open after ``a_turn`` listings."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        listed = 0
        for batch in batches:
            rows, pending = [], deque(batch.itertuples(index=False, name=None))
            while pending:
                repository, root, at, is_file = pending.popleft()
                if is_file or listed >= a_turn:
                    rows.append((repository, root, at, is_file))
                    continue
                if at == root and not os.path.isdir(root):
                    raise FileNotFoundError(f"{repository}: no folder {root} on this machine")
                listed += 1
                pending.extend((repository, root, *child) for child in _entries(at))
            yield pd.DataFrame(rows, columns=batch.columns)

    return step


def list_paths(workspaces: DataFrame, partitions: int | None = None, a_turn: int = DIRECTORIES_A_TURN) -> DataFrame:
    """(repository_id, root, path) of all files below each ``root``, whatever the depth.

    Open directories are a frontier: in each turn they are dealt out to all tasks, a task lists ``a_turn`` of them
    and hands back the files it met and the directories left open, until none is. So one deep or broad repository is
    walked by as many tasks as many small ones, and a small tree takes one turn.
    """
    turns = []
    frontier = workspaces.selectExpr("repository_id", "root", "root as path", "false as is_file")
    while True:
        dealt = spread_rows(frontier, "path", partitions=partitions)
        turn = cut_lineage(dealt.mapInPandas(_list(a_turn), _LISTED))
        turns.append(turn.where("is_file"))
        frontier = turn.where("not is_file")
        if not frontier.limit(1).collect():
            return reduce(DataFrame.unionByName, turns).drop("is_file")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contents of UTF-8 files; anything else is left out."""
    for batch in batches:
        rows, size = [], 0
        for repository, root, path in batch.itertuples(index=False):
            try:
                with open(path, encoding="utf-8") as handle:
                    content = handle.read()
            except (UnicodeDecodeError, OSError):
                continue
            rows.append((repository, os.path.relpath(path, root).replace(os.sep, "/"), content))
            size += len(content)
            if size > BATCH_BYTES:
                yield pd.DataFrame(rows, columns=["repository_id", "relative_path", "content"])
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=["repository_id", "relative_path", "content"])


def read_files(workspaces: DataFrame, partitions: int | None = None) -> DataFrame:
    """(repository_id, relative_path, content) of all text files below ``root``.

    Spark's own file reader skips names starting with ``_`` or ``.``, which would lose ``__init__.py``; so
    directories are listed by tasks. Paths are dealt out again before contents are read: a repository holding a
    large share of all files is read by as many tasks as any other data. ``partitions`` sets how many tasks share
    the reading; the default follows the session (``task_count``). A root that is no folder where
    the task runs fails the job.
    """
    paths = list_paths(workspaces, partitions)
    dealt = spread_rows(paths, "path", partitions=partitions)
    return dealt.mapInPandas(_read, "repository_id string, relative_path string, content string")


def walk_order(path: str = "relative_path") -> Column:
    """Sort key of the walk: the files of a directory by name, then its subdirectories by name."""
    return F.expr(
        f"transform(split({path}, '/', -1), (part, i) -> named_struct("
        f"'below', i < size(split({path}, '/', -1)) - 1, 'part', part))"
    )


cloudpickle.register_pickle_by_value(sys.modules[__name__])
