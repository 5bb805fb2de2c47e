"""The stored import index: every change gives what resolving all edges gives, and one file's imports come from one bucket."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql.functions import udf

from siltstone.errors import ConflictError
from siltstone.operators.dependencies import edge_lookups, lookups_naming, resolve_imports
from siltstone.operators.import_index import ImportIndex
from siltstone.session import checkpoint_folder

EDGE = (
    "repo string, relative_path string, target_module string, imported_names array<string>, alias string, "
    "is_internal boolean, line_number int"
)
FILE = "repo string, relative_path string"
COLUMNS = ["repo", "source", "target", "target_kind", "is_internal", "imported_names", "alias", "line_number"]
NAMES = ["a", "b", "c", "a/b", "a/c", "b/a", "a/b/c"]


def shown(frame):
    return sorted((tuple(map(str, row)) for row in frame.select(COLUMNS).collect()))


def paths_of(rng):
    ends = ["/__init__.py", ".py", ".pyi", "/__init__.pyi", ".ts", ".tsx", "/index.ts", ".h", ".cpp"]
    return {rng.choice(NAMES) + rng.choice(ends) for _ in range(14)} | {"__init__.py"}


def imports_of(path, rng):
    if path.endswith((".py", ".pyi")):
        forms = [("a", [], False), ("a.b", ["c"], False), (".", ["b"], True), ("..", ["a"], True), (".c", [], True), ("os", [], False)]
    elif path.endswith((".ts", ".tsx")):
        forms = [("./a", [], True), ("../b", [], True), ("./c.ts", [], True), ("react", [], False), ("/a", [], True)]
    else:
        forms = [("a.h", [], True), ("../b.h", [], True), ("vector", [], False)]
    return [(path, *rng.choice(forms), line) for line in range(rng.randint(0, 3))]


def frames(spark, state):
    files = [(repo, path) for repo, held in state.items() for path in held]
    edges = [(repo, p, m, n, None, up, line) for repo, held in state.items() for own in held.values() for p, m, n, up, line in own]
    return spark.createDataFrame(files, FILE), spark.createDataFrame(edges, EDGE)


def test_changes_equal_a_full_resolution(spark, tmp_path):
    rng = random.Random(3)
    state = {repo: {p: imports_of(p, rng) for p in paths_of(rng)} for repo in ("r1", "r2")}
    index = ImportIndex(spark, str(tmp_path / "i"), "repo", buckets=4)
    index.apply(*frames(spark, state))
    for turn in range(3):
        files, edges = frames(spark, state)
        full = shown(resolve_imports(edges, files, "repo"))
        assert shown(index.edges()) == full
        path = sorted(state["r1"])[turn]
        assert shown(index.outgoing(path, "r1")) == [row for row in full if row[:2] == ("r1", path)]
        gone = rng.sample(sorted(state["r1"]), 3)
        fresh = {p: imports_of(p, rng) for p in rng.sample(sorted(paths_of(rng) - set(gone)), 4)}
        for path in gone:
            del state["r1"][path]
        state["r1"].update(fresh)
        index.apply(*frames(spark, {"r1": fresh}), spark.createDataFrame([("r1", p) for p in gone], FILE))
    files, edges = frames(spark, state)
    assert shown(index.edges()) == shown(resolve_imports(edges, files, "repo"))
    assert not index.outgoing("nowhere.py", "r1").collect()


def test_only_sources_whose_answer_changes_are_written(spark, tmp_path):
    index = ImportIndex(spark, str(tmp_path / "i"), buckets=4)
    files = spark.createDataFrame([("x.py",), ("y.py",), ("z.py",), ("m.py",)], "relative_path string")
    kinds = EDGE.removeprefix("repo string, ")
    edges = [("x.py", "m", [], None, False, 1), ("y.py", "n", [], None, False, 1), ("z.py", "os", [], None, False, 1)]
    index.apply(files, spark.createDataFrame(edges, kinds))
    none = spark.createDataFrame([], kinds)
    index.apply(spark.createDataFrame([("n/__init__.py",)], "relative_path string"), none)
    last = index.sources.changes()[-1]
    written = {row.source for row in spark.read.parquet(f"{index.sources.path}/data/_change={last.folder}").collect()}
    assert written == {"y.py", "n/__init__.py"}
    # A worse name for m changes no answer; the better one does.
    for name, expected in (("m.pyi", {"m.pyi"}), ("m/__init__.py", {"m/__init__.py", "x.py"})):
        index.apply(spark.createDataFrame([(name,)], "relative_path string"), none)
        last = index.sources.changes()[-1]
        written = {row.source for row in spark.read.parquet(f"{index.sources.path}/data/_change={last.folder}").collect()}
        assert written == expected
    assert [r.target for r in index.outgoing("x.py").collect()] == ["m/__init__.py"]
    plan = index.sources.get("\u001fx.py")._jdf.queryExecution().toString()
    assert "_bucket" in plan[plan.index("PartitionFilters") :]


def test_another_writer_is_noticed(spark, tmp_path, monkeypatch):
    index = ImportIndex(spark, str(tmp_path / "i"), buckets=2)
    kinds = EDGE.removeprefix("repo string, ")
    files = spark.createDataFrame([("x.py",)], "relative_path string")
    edges = spark.createDataFrame([("x.py", "m", [], None, False, 1)], kinds)
    index.apply(files, edges)
    holding = index.holders.holding

    def slow(*given):
        other = ImportIndex(spark, str(tmp_path / "i"), buckets=2)
        other.apply(spark.createDataFrame([("m.py",)], "relative_path string"), spark.createDataFrame([], kinds))
        return holding(*given)

    monkeypatch.setattr(index.holders, "holding", slow)
    with pytest.raises(ConflictError):
        index.apply(spark.createDataFrame([("q.py",)], "relative_path string"), spark.createDataFrame([], kinds))
    monkeypatch.undo()
    assert [r.target for r in index.outgoing("x.py").collect()] == ["m.py"]
    index.apply(spark.createDataFrame([("q.py",)], "relative_path string"), spark.createDataFrame([], kinds))
    assert {r.relative_path for r in index.files.rows().collect()} == {"x.py", "m.py", "q.py"}


def test_a_file_leads_to_every_lookup_it_answers(spark):
    names = ["__init__.py", "a/b/__init__.py", "a/__init__.pyi", "m.py", "s.ts", "s/index.tsx", "c/h.hpp", "index.ts", ".py"]
    files = spark.createDataFrame([(x,) for x in names], "relative_path string")
    found = {r.relative_path: set(r.l) for r in files.select("relative_path", lookups_naming(files.relative_path).alias("l")).collect()}
    assert {"module:", "module:__init__", "package:"} <= found["__init__.py"]
    assert {"module:a/b", "package:a/b"} <= found["a/b/__init__.py"] and "script:s" in found["s/index.tsx"]
    assert {"script:", "script:index", "script:index.ts"} <= found["index.ts"] and "include:c/h.hpp" in found["c/h.hpp"]
    edge = spark.createDataFrame([("p/x.py", ".", ["q"], None, True, 1)], EDGE.removeprefix("repo string, "))
    assert {r.lookup for r in edge_lookups(edge).collect()} == {"module:p/q", "package:p"}


def test_a_change_leaves_nothing_but_the_tables(spark, tmp_path):
    shared = Path(checkpoint_folder(spark).removeprefix("file:"))
    index = ImportIndex(spark, str(tmp_path / "i"), buckets=2)
    kinds = EDGE.removeprefix("repo string, ")
    files = spark.createDataFrame([("x.py",), ("y.py",)], "relative_path string")
    edges = [("x.py", "m", [], None, False, 1), ("y.py", ".", ["n"], None, True, 1)]
    before = set(shared.iterdir())
    index.apply(files, spark.createDataFrame(edges, kinds))
    index.apply(spark.createDataFrame([("m.py",)], "relative_path string"), spark.createDataFrame([], kinds))
    assert set(shared.iterdir()) == before
    # A pair is stored once, not as its hashes beside both its parts, and the first change needs no folding.
    assert index.holders.schema.names == ["pair"] and index.sources.changes(1)[0].whole
    lookups = spark.createDataFrame([("\u001fmodule:n",), ("\u001fpackage:",), ("\u001fmodule:q",)], "lookup string")
    found = {(r.lookup, r.id) for r in index.holders.holding(lookups, index.holders.version()).collect()}
    assert found == {("\u001fmodule:n", "\u001fy.py"), ("\u001fpackage:", "\u001fy.py")}


def test_given_edges_are_computed_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(module):
        read.add(1)
        return module

    index = ImportIndex(spark, str(tmp_path / "i"), buckets=2)
    kinds = EDGE.removeprefix("repo string, ")
    files = spark.createDataFrame([("x.py",), ("y.py",), ("m.py",)], "relative_path string")
    edges = spark.createDataFrame([("x.py", "m", [], None, False, 1), ("y.py", "n", [], None, False, 1), ("gone.py", "m", [], None, False, 1)], kinds)
    index.apply(files, edges.withColumn("target_module", udf(counted, "string")("target_module")))
    assert read.value == 3  # for their lookups, answers and pairs
    found = {row.source: row.target for row in index.edges().collect()}
    assert found == {"x.py": "m.py", "y.py": "external:n"}  # a source that is no file has no row
    # A stored source gets another answer and loses it again; edges given for one that is not listed join its own.
    index.apply(spark.createDataFrame([("n.py",)], "relative_path string"), spark.createDataFrame([("y.py", "os", [], None, False, 2)], kinds))
    assert sorted(row.target for row in index.outgoing("y.py").collect()) == ["external:os", "n.py"]
    index.apply(files.limit(0), edges.limit(0), spark.createDataFrame([("n.py",)], "relative_path string"))
    assert sorted(row.target for row in index.outgoing("y.py").collect()) == ["external:n", "external:os"]


def test_groups_are_folded_in_one_sorted_pass(spark, tmp_path, monkeypatch):
    index = ImportIndex(spark, str(tmp_path / "i"), buckets=2)
    plans = []
    grouped = index._grouped

    def seen(*given):
        frame = grouped(*given)
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return frame

    monkeypatch.setattr(index, "_grouped", seen)
    kinds = EDGE.removeprefix("repo string, ")
    files = spark.createDataFrame([("x.py",)], "relative_path string")
    index.apply(files, spark.createDataFrame([("x.py", "m", [], None, False, 1)], kinds))
    assert "collect_list" in plans[0] and "partial_collect_list" not in plans[0]
