"""Import graph, package tree, call and knowledge graphs on hand-made input."""

from __future__ import annotations

import itertools

import pytest

from siltstone.errors import IntegrityError, NotFoundError, ValidationError
from siltstone.operators import calls, dependencies, knowledge, packages
from siltstone.operators.extract import import_edges, package_units
from siltstone.operators.parse import parse_files

EDGE = (
    "relative_path string, target_module string, imported_names array<string>, alias string, is_internal boolean, line_number int"
)

FILES = {
    "run.py": "from core.tools import go\nimport sys\nimport numpy\n",
    "core/__init__.py": "",
    "core/tools.py": "from . import names\nfrom .names import N\nfrom ..absent import z\n",
    "core/names.py": "",
    "ui/main.ts": 'import { x } from "./lib"\nimport Vue from "vue"\nimport { y } from "./lost"\n',
    "ui/lib.ts": "",
    "c/net.cpp": '#include "net.h"\n#include <map>\n#include "nope.h"\n',
    "c/net.h": "",
    "g/app.go": 'package g\n\nimport "fmt"\nimport "./sub"\n',
    "r/lib.rs": "use crate::m::T;\nuse std::io;\n",
}
EXPECTED = {
    ("run.py", 1, "core/tools.py", True),
    ("run.py", 2, "external:sys", False),
    ("run.py", 3, "external:numpy", False),
    ("core/tools.py", 1, "core/names.py", True),
    ("core/tools.py", 2, "core/names.py", True),
    ("core/tools.py", 3, "unresolved:absent", True),
    ("ui/main.ts", 1, "ui/lib.ts", True),
    ("ui/main.ts", 2, "external:vue", False),
    ("ui/main.ts", 3, "unresolved:ui/lost", True),
    ("c/net.cpp", 1, "c/net.h", True),
    ("c/net.cpp", 2, "external:map", False),
    ("c/net.cpp", 3, "unresolved:c/nope.h", True),
    ("g/app.go", 3, "external:fmt", False),
    ("g/app.go", 4, "unresolved:g/sub", True),
    ("r/lib.rs", 1, "unresolved:r/lib.rs#crate::m", True),
    ("r/lib.rs", 2, "external:std", False),
}


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_graph_from_sources(spark):
    files = frame(spark, list(FILES.items()), "relative_path string, content string")
    edges = import_edges(parse_files(files))
    nodes, relations = dependencies.build_graph(edges, files)
    got = {(r.source, r.line_number, r.target, r.is_internal) for r in relations.collect()}
    assert got == EXPECTED
    kinds = [row.kind for row in nodes.collect()]
    assert (kinds.count("internal_file"), kinds.count("external_module"), kinds.count("unresolved_internal")) == (10, 6, 5)


# source, target module, internal, imported names, other files, expected target
RULES = [
    ("a.py", "p", False, (), ("p.py", "p/__init__.py"), "p/__init__.py"),
    ("a.py", "p", False, (), ("p.pyi", "p/__init__.pyi"), "p/__init__.pyi"),
    ("a.py", "p..q", False, (), (), "external:p..q"),
    ("a.py", "p", True, (), ("p.py",), "unresolved:a.py#p"),
    ("d/a.py", "...x", True, (), ("x.py",), "unresolved:d/a.py#...x"),
    ("d/a.py", "..x", True, (), ("x.py",), "x.py"),
    ("d/a.py", ".x/y", True, (), (), "unresolved:d/a.py#.x/y"),
    ("d/a.py", ".", True, ("n",), ("d/n.py", "d/__init__.py"), "d/n.py"),
    ("d/a.py", ".", True, ("n",), ("d/__init__.py",), "d/__init__.py"),
    ("d/a.py", ".", True, ("*",), (), "unresolved:d/*"),
    ("d/a.py", ".", True, ("m", "n"), ("d/n.py",), "unresolved:d"),
    ("a.py", ".", True, ("n",), ("__init__.py",), "__init__.py"),
    ("d/a.py", "..", True, (), (), "unresolved:"),
    ("s/m.ts", "./x", True, (), ("s/x.ts", "s/x.tsx", "s/x/index.ts"), "s/x.ts"),
    ("s/m.ts", "./x", True, (), ("s/x", "s/x.ts"), "s/x"),
    ("s/m.ts", "./x.js", True, (), ("s/x.ts",), "unresolved:s/x.js"),
    ("m.ts", ".", True, (), ("index.ts",), "index.ts"),
    ("s/m.ts", "/abs", True, (), ("abs.ts",), "unresolved:/abs"),
    ("s/m.ts", "../../x", True, (), (), "unresolved:s/m.ts#../../x"),
    ("s/m.ts", "odd", True, (), (), "unresolved:s/m.ts#odd"),
    ("g/a.go", "./sub/../k", True, (), ("g/k",), "unresolved:g/k"),
    ("g/a.go", "sub", True, (), (), "unresolved:g/a.go#sub"),
    ("r/a.rs", "self::x", True, (), (), "unresolved:r/a.rs#self::x"),
    ("c/a.hh", "..\\b.h", True, (), ("b.h",), "b.h"),
    ("c/a.hh", "C:/b.h", True, (), (), "unresolved:c/a.hh#C:/b.h"),
    ("x.txt", "m", True, (), (), "unresolved:x.txt#m"),
    ("x.txt", "m", False, (), (), "external:m"),
    ("./d//a.py", ".b", True, (), ("d\\b.py",), "d\\b.py"),
]


def test_resolution_rules(spark):
    """All rules in one job, each case a repository of its own."""
    edges = [(f"{at:02d}", source, module, list(names), None, internal, 1) for at, (source, module, internal, names, _, _) in enumerate(RULES)]
    files = [(f"{at:02d}", path) for at, (source, _, _, _, others, _) in enumerate(RULES) for path in {source, *others}]
    resolved = dependencies.resolve_imports(
        frame(spark, edges, f"case string, {EDGE}"), frame(spark, files, "case string, relative_path string"), "case"
    )
    assert [row.target for row in resolved.orderBy("case").collect()] == [rule[-1] for rule in RULES]


def test_blank_target_fails_the_job(spark):
    with pytest.raises(Exception, match="blank import target"):
        edges = frame(spark, [("a.py", " ", [], None, True, 1)], EDGE)
        dependencies.resolve_imports(edges, frame(spark, [("a.py",)], "relative_path string")).collect()


def test_unusable_file_paths(spark):
    bad = [" ", "external:x", "unresolved:x", "/a", "\\a", "C:a", "a/../..", ".", "a/.."]
    files = frame(spark, [(path,) for path in [*bad, "fine.py", "a/../b.py"]], "relative_path string")
    problems = dependencies.file_problems(files).where("problem <> 'same path twice'")
    assert sorted(row.relative_path for row in problems.collect()) == sorted(bad)


def test_duplicate_files_are_rejected(spark):
    files = frame(spark, [("a/b.py",), ("a/./b.py",)], "relative_path string")
    with pytest.raises(IntegrityError):
        dependencies.build_graph(frame(spark, [], EDGE), files)
    with pytest.raises(ValidationError):
        dependencies.build_graph(frame(spark, [], EDGE), frame(spark, [("/a.py",)], "relative_path string"))


def test_hot_requests_are_split_without_changing_the_result(spark):
    rows = [(f"d/f{i}.py", "numpy" if i % 3 else "..lib", [], None, i % 3 == 0, i) for i in range(600)]
    edges = frame(spark, rows, EDGE)
    files = frame(spark, [(row[0],) for row in rows] + [("lib.py",)], "relative_path string")
    plain = dependencies.resolve_imports(edges, files)
    split = dependencies.resolve_imports(edges, files, hot_rows=7)
    assert sorted(map(tuple, plain.collect()), key=repr) == sorted(map(tuple, split.collect()), key=repr)
    assert split.count() == 600


def test_duplicate_edges_are_kept(spark):
    row = ("a.py", "sys", [], None, False, 1)
    files = frame(spark, [("a.py",)], "relative_path string")
    assert dependencies.resolve_imports(frame(spark, [row, row], EDGE), files).count() == 2


def test_order_of_input_does_not_matter(spark):
    rows = [("a.py", "b", [], None, False, 1), ("b.py", "c", [], None, False, 1), ("c.py", "x", [], None, False, 2)]
    files = [("a.py",), ("b.py",), ("c.py",)]
    seen = set()
    for order in itertools.permutations(range(3)):
        edges = frame(spark, [rows[i] for i in order], EDGE)
        known = frame(spark, [files[i] for i in order], "relative_path string")
        resolved = dependencies.resolve_imports(edges, known).orderBy(*dependencies.edge_order())
        seen.add(repr([tuple(row) for row in resolved.collect()]))
    assert len(seen) == 1


def test_scope_keeps_repositories_apart(spark):
    edges = frame(spark, [("r1", "a.py", "b", [], None, False, 1), ("r2", "a.py", "b", [], None, False, 1)], f"repo string, {EDGE}")
    files = frame(spark, [("r1", "a.py"), ("r1", "b.py"), ("r2", "a.py")], "repo string, relative_path string")
    resolved = dependencies.resolve_imports(edges, files, "repo")
    assert {(row.repo, row.target) for row in resolved.collect()} == {("r1", "b.py"), ("r2", "external:b")}


def test_package_tree(spark):
    paths = ["__init__.py", "main.py", "a/__init__.py", "a/b/__init__.py", "a/b/c/x.py", "t/index.ts", "q/z/only.py"]
    units = package_units(parse_files(frame(spark, [(p, "") for p in paths], "relative_path string, content string")))
    nodes = packages.package_nodes(units)
    assert {(n.node_id, n.file_count, n.has_package_root_file) for n in nodes.collect()} == {
        ("", 2, True),
        ("a", 1, True),
        ("a/b", 1, True),
        ("a/b/c", 1, False),
        ("q", 0, False),
        ("q/z", 1, False),
        ("t", 1, True),
    }
    edges = packages.package_edges(nodes)
    assert {(e.parent_id, e.child_id) for e in edges.collect()} == {
        ("", "a"),
        ("", "q"),
        ("", "t"),
        ("a", "a/b"),
        ("a/b", "a/b/c"),
        ("q", "q/z"),
    }
    assert [n.node_id for n in packages.direct_children(nodes, edges, "a").collect()] == ["a/b"]
    with pytest.raises(NotFoundError):
        packages.get_node(nodes, "nope")
    empty = packages.package_nodes(units.limit(0))
    assert empty.count() == 0 and packages.package_edges(empty).count() == 0


def test_call_graph_keeps_edges_with_known_callers(spark):
    symbols = frame(
        spark,
        [("a.py::f", "f", "function", "a.py", 1), ("a.py::C.m", "m", "method", "a.py", 3), ("a.py::C", "C", "class", "a.py", 2)],
        "qualified_name string, name string, kind string, relative_path string, line_number int",
    )
    nodes = calls.call_nodes(symbols)
    edges = frame(spark, [("a.py::f", "print", 9), ("a.py::f", "abs", 9), ("a.py::C", "x", 1)], "caller string, callee string, line_number int")
    kept = calls.call_edges(edges, nodes)
    assert nodes.count() == 2 and [e.callee for e in calls.callees_of(kept, "a.py::f").collect()] == ["abs", "print"]
    assert kept.count() == 2


def test_knowledge_graph(spark):
    symbols = frame(spark, [("p/a.py", "p/a.py::C", "C", "class")], "relative_path string, qualified_name string, name string, kind string")
    interfaces = frame(
        spark,
        [("p/a.py", "C", ["m"], ["ABC"])],
        "relative_path string, name string, method_signatures array<string>, base_interfaces array<string>",
    )
    tree = frame(spark, [("p", ["p"]), ("", [])], "node_id string, package_path array<string>")
    parts = {"symbols": symbols, "interfaces": interfaces, "packages": tree}
    nodes = knowledge.knowledge_nodes(**parts)
    assert {n.identifier for n in nodes.collect()} == {
        "symbol:p/a.py::C",
        "interface:p/a.py::C",
        "entity:p/a.py",
        "package:p",
        "package:",
    }
    relations = knowledge.knowledge_relations(**parts)
    assert {tuple(r) for r in relations.collect()} == {
        ("entity:p/a.py", "symbol:p/a.py::C", "declares"),
        ("entity:p/a.py", "interface:p/a.py::C", "declares"),
        ("interface:p/a.py::C", "interface:ABC", "extends"),
        ("entity:p/a.py", "package:p", "belongs_to_package"),
    }
