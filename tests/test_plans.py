"""Collectors, working copies, the whole analysis and the stream."""

from __future__ import annotations

import subprocess
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from siltstone import cli
from siltstone.errors import ConfigurationError, GitError, IntegrityError, ValidationError
from siltstone.plans.analysis import analyze_source, checked_copies, unpack_repositories
from siltstone.sources.collectors import collect, collect_local
from siltstone.sources.files import list_paths, read_files, walk_order
from siltstone.sources.git import git_output, working_copies
from siltstone.streaming.files import FILES, read_file_stream, write_parsed_stream


def git(cwd: Path, *arguments: str) -> None:
    identity = ["-c", "user.name=t", "-c", "user.email=t@localhost"]
    subprocess.run(["git", *identity, *arguments], cwd=cwd, check=True, capture_output=True)


@pytest.fixture(scope="module")
def repository(tmp_path_factory) -> Path:
    root = tmp_path_factory.mktemp("origin") / "project"
    files = {
        "pkg/__init__.py": "",
        "pkg/core.py": 'class A:\n    """doc"""\n    def m(self): pass\n\n__all__ = ["A"]\n',
        "pkg/inner/use.py": "from ..core import A\n",
        "_main.go": "package main\nfunc Main() {\n}\n",
        "README.md": "# x\n",
        ".hidden/skip.py": "x = 1\n",
        ".keep.py": "y = 1\n",
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)
    (root / "pkg" / "bytes.py").write_bytes(b"\xff\xfe\x00")
    git(root, "init", "-b", "main")
    git(root, "add", "-A")
    git(root, "commit", "-m", "first")
    return root


def test_hosted_references(spark):
    cases = {
        "github": {
            "own/repo": "https://github.com/own/repo.git",
            " https://github.com/own/repo.git/ ": "https://github.com/own/repo.git",
            "git@github.com:o-w/re.po_1.git": "https://github.com/o-w/re.po_1.git",
            "-own/repo": None,
            "own/re/po": None,
            "https://gitlab.com/own/repo": None,
        },
        "gitlab": {"g/s/r": "https://gitlab.com/g/s/r.git", "git@gitlab.com:g/r": "https://gitlab.com/g/r.git", "r": None},
    }
    for provider, references in cases.items():
        for source, uri in references.items():
            row = collect(spark, source, provider).first()
            assert (row.source_uri, row.succeeded) == (uri, uri is not None)
    with pytest.raises(Exception, match="source must not be empty"):
        collect(spark, "  ", "github").collect()
    with pytest.raises(ValidationError):
        collect(spark, "x", "svn")


def test_local_scan(spark, tmp_path):
    for name in ("a/.git", "a/nested/.git", "b/c/.git", ".hidden/d/.git", "1/2/3/4/5/.git", "1/2/3/4/e/6/.git", "plain/x"):
        (tmp_path / name).mkdir(parents=True)
    found = [row.source_uri for row in collect_local(spark, str(tmp_path), max_depth=5).orderBy("source_uri").collect()]
    assert found == [str(tmp_path / name) for name in ("1/2/3/4/5", "a", "b/c")]
    for a_turn in (1, 256):
        every = [row.source_uri for row in collect_local(spark, str(tmp_path), a_turn=a_turn).orderBy("source_uri").collect()]
        assert every == [str(tmp_path / name) for name in ("1/2/3/4/5", "1/2/3/4/e/6", "a", "b/c")]
    assert not collect_local(spark, str(tmp_path / "absent")).first().succeeded


def test_walk_of_any_depth(spark, tmp_path):
    deep = tmp_path
    for level in range(12):
        deep = deep / f"d{level}"
        deep.mkdir()
        (deep / f"f{level}.py").write_text("x = 1\n")
    workspaces = spark.createDataFrame([("r", str(tmp_path))], "repository_id string, root string")
    for a_turn in (1, 5, 256):
        paths = [row.path for row in list_paths(workspaces, a_turn=a_turn).collect()]
        assert sorted(paths) == sorted(str(x) for x in tmp_path.rglob("*.py"))
    assert read_files(workspaces).count() == 12


def test_read_files(spark, repository):
    workspaces = spark.createDataFrame([("r", str(repository))], "repository_id string, root string")
    files = read_files(workspaces)
    listed = [row.relative_path for row in files.orderBy(walk_order()).collect()]
    assert listed == [".keep.py", "README.md", "_main.go", "pkg/__init__.py", "pkg/core.py", "pkg/inner/use.py"]
    assert files.where("relative_path = '_main.go'").first().content.startswith("package main")
    with pytest.raises(Exception, match="no folder"):
        read_files(workspaces.withColumn("root", F.lit(f"{repository}/absent"))).collect()


def test_working_copies(spark, repository, tmp_path):
    rows = [("1", str(repository), "main"), ("2", str(repository), "absent"), ("3", str(tmp_path / "nowhere"), "main")]
    repositories = spark.createDataFrame(rows, "id string, source_uri string, default_branch string")
    for _ in range(2):  # the second run finds the copies
        copies = {row.repository_id: row for row in working_copies(repositories, str(tmp_path / "copies")).collect()}
        assert copies["1"].root == str(tmp_path / "copies" / "1") and len(copies["1"].commit_id) == 40
        assert all(copies[key].root is None and copies[key].error_message for key in "23")
    with pytest.raises(GitError):
        checked_copies(repositories, str(tmp_path / "copies"))
    assert git_output("no-such-command")[1]
    assert not working_copies(repositories.limit(0), str(tmp_path / "copies")).count()


def test_repository_guards(spark, tmp_path):
    with pytest.raises(ValidationError):
        unpack_repositories(collect(spark, str(tmp_path / "absent"), "filesystem"))


def test_whole_analysis(spark, repository, tmp_path):
    spark.conf.unset("spark.siltstone.folder")
    with pytest.raises(ConfigurationError):
        analyze_source(spark, str(repository))
    spark.conf.set("spark.siltstone.folder", str(tmp_path))
    result = analyze_source(spark, str(repository))
    parsed = {row.relative_path: row.succeeded for row in result["parse_results"].collect()}
    assert parsed == {
        ".keep.py": True,
        "README.md": False,
        "_main.go": True,
        "pkg/__init__.py": True,
        "pkg/core.py": True,
        "pkg/inner/use.py": True,
    }
    assert [row.target_module for row in result["imports"].collect()] == ["..core"]
    assert {row.qualified_name for row in result["symbols"].collect()} == {
        "_main.go::Main",
        "pkg/core.py::A",
        "pkg/core.py::A.m",
    }
    assert {(n.node_id, n.file_count) for n in result["package_nodes"].collect()} == {("", 2), ("pkg", 2), ("pkg/inner", 1)}
    assert {(e.parent_id, e.child_id) for e in result["package_edges"].collect()} == {("", "pkg"), ("pkg", "pkg/inner")}
    (candidate,) = result["candidates"].where("name = 'A'").collect()
    assert candidate.is_public and candidate.has_docstring
    assert result["quality"].agg(F.sum("candidate_count")).first()[0] == 2
    with pytest.raises(IntegrityError):
        analyze_source(spark, str(repository))  # the repository is stored already


def test_cli(spark, capsys, repository, tmp_path):
    assert cli.main([str(repository), "--folder", str(tmp_path)]) == 0
    assert "package_nodes: 3" in capsys.readouterr().out
    assert cli.main([str(tmp_path / "absent"), "--folder", str(tmp_path)]) == 1
    with pytest.raises(SystemExit) as stop:
        cli.main(["--nope"])
    assert stop.value.code == 2


def test_stream_parses_arriving_files(spark, tmp_path):
    source, out, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for at in range(2):
        rows = spark.createDataFrame([("r", f"f{at}.py", "import os\n")], FILES)
        rows.write.mode("append").parquet(source)
        write_parsed_stream(read_file_stream(spark, source), out, state).awaitTermination(120)
    stored = spark.read.parquet(out)
    assert sorted(row.relative_path for row in stored.collect()) == ["f0.py", "f1.py"]
    assert stored.selectExpr("inline(imports)").count() == 2
