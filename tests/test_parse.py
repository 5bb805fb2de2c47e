"""Parser fixtures with literal expected records, and properties of the parse as a Spark job."""

from __future__ import annotations

import random

import pytest

from siltstone.functions.text import strip_sql
from siltstone.operators.marks import RULES, TextMarks, _COMPILED, innermost, pattern_marks
from siltstone.operators.parse import parse_files


def parse(spark, path: str, content: str) -> dict:
    rows = parse_files(spark.createDataFrame([(path, content)], "relative_path string, content string")).collect()
    assert len(rows) == 1
    return rows[0].asDict(recursive=True)


def imports(result: dict) -> list[tuple]:
    return [
        (row["module"], row["imported_names"], row["alias"], row["is_relative"], row["line_number"]) for row in result["imports"]
    ]


def names(rows: list[dict]) -> list[tuple]:
    return [(row["name"], row["line_number"]) for row in rows]


PYTHON = '''import json as j
from ..a import b, c
__all__ = ["K", "f"]
class K(Protocol):
    """doc"""
    async def m(self, x: int = 1): ...
def f(*args, k=None, **kw) -> str:
    return ""
def _g(): pass
'''


def test_python_fixture(spark):
    result = parse(spark, "k.py", PYTHON)
    assert imports(result) == [
        ("json", [], "j", False, 1),
        ("..a", ["b"], None, True, 2),
        ("..a", ["c"], None, True, 2),
    ]
    assert names(result["exports"]) == [("K", 3), ("f", 3)]
    (cls,) = result["classes"]
    assert (cls["name"], cls["base_classes"], cls["docstring"], cls["line_number"]) == ("K", ["Protocol"], "doc", 4)
    (method,) = cls["methods"]
    assert (method["parameters"], method["is_async"], method["is_method"]) == (["self", "x: int = 1"], True, True)
    f, g = result["functions"]
    assert (f["parameters"], f["return_type"]) == (["*args", "k = None", "**kw"], "str")
    assert g["name"] == "_g" and g["docstring"] is None
    assert [(s["kind"], s["name"]) for s in result["symbols"]] == [
        ("class", "K"),
        ("method", "m"),
        ("function", "f"),
        ("function", "_g"),
    ]
    assert result["metadata"]["line_count"] == 9


def test_python_failure_is_a_row(spark):
    result = parse(spark, "dir/bad.py", "def broken(:")
    assert not result["succeeded"] and result["metadata"] is None and result["symbols"] == []
    assert result["error_message"] == "syntax error: invalid syntax (bad.py, line 1)"


def test_unknown_suffix_is_a_failed_row(spark):
    result = parse(spark, "README.md", "x")
    assert result["language"] == "unknown" and result["error_message"] == "no parser supports 'README.md'"


def test_empty_file_succeeds(spark):
    result = parse(spark, "a.GO", "")
    assert result["succeeded"] and result["metadata"]["size_bytes"] == 0 and result["metadata"]["line_count"] == 0


@pytest.mark.parametrize(
    ("source", "expected"),
    [
        ("use a::{b, c as d, self};", [("a", ["b"], None), ("a", ["c"], "d"), ("a", ["self"], None)]),
        ("use crate::x::Y;", [("crate::x", ["Y"], None)]),
        ("use super::h::*;", [("super::h", ["*"], None)]),
        ("use a::{self as s, b::{c, d}};", [("a", ["self"], "s"), ("a", ["b::{c, d}"], None)]),
        ("use tokio;", [("tokio", [], None)]),
        ("pub use a::b\n    as c;", [("a", ["b"], "c")]),
    ],
)
def test_rust_use_items(spark, source, expected):
    assert [row[:3] for row in imports(parse(spark, "l.rs", source))] == expected


def test_rust_ownership_takes_the_smallest_impl(spark):
    source = "struct A;\nstruct B;\nimpl A {\n  fn outer() {\n    impl B {\n      fn inner() {}\n    }\n  }\n}\ntrait T {\n  fn only(&self);\n}\n"
    result = parse(spark, "l.rs", source)
    owned = {cls["name"]: [m["name"] for m in cls["methods"]] for cls in result["classes"]}
    assert owned == {"A": ["outer"], "B": ["inner"]}
    assert "only" in [s["name"] for s in result["symbols"] if s["kind"] == "method"]


def test_repeated_names_keep_first_place_and_last_line(spark):
    result = parse(spark, "l.rs", "pub enum A { X }\npub enum B { X }\nenum A { Y }\n")
    assert [(s["name"], s["line_number"]) for s in result["symbols"]] == [("A", 3), ("B", 2)]
    assert names(result["exports"]) == [("B", 2)]


def test_go_imports_and_receivers(spark):
    source = 'package m\nimport (\n"fmt"\nz "p/q"\n_ "side"\n)\ntype T struct {\n}\nfunc (p *T) A() {\n}\nfunc (p T) B() {\n}\nfunc (p U) C() {\n}\n'
    result = parse(spark, "g.go", source)
    assert [(row[0], row[2]) for row in imports(result)] == [("fmt", None), ("p/q", "z"), ("side", None)]
    assert [m["name"] for m in result["classes"][0]["methods"]] == ["A", "B"]
    assert [s["name"] for s in result["symbols"] if s["kind"] == "method"] == ["A", "B", "C"]


def test_typescript_exports(spark):
    result = parse(spark, "t.ts", 'export { x as y };\nexport * from "./m";\nexport default 1;\nclass P extends Q implements R, S {}\n')
    assert names(result["exports"]) == [("y", 1), ("*", 2), ("default", 3)]
    assert result["classes"][0]["base_classes"] == ["Q", "R", "S"]


def test_typescript_named_default_is_only_seen_at_the_start(spark):
    assert names(parse(spark, "t.ts", "export default class A {}\n")["exports"]) == [("A", 1)]
    assert names(parse(spark, "t.ts", "\nexport default class A {}\n")["exports"]) == [("A", 2), ("default", 2)]


def test_arrow_needs_its_arrow_before_the_line_ends(spark):
    result = parse(spark, "t.ts", "const a = (1);\nconst b = (x): number => x;\nconst c = (1)\n=> 2;\n")
    assert [f["name"] for f in result["functions"]] == ["b"]
    assert result["functions"][0]["return_type"] == "number"
    assert [s["name"] for s in result["symbols"] if s["kind"] == "constant"] == ["a", "c"]


def test_cpp_scopes(spark):
    source = '#include "h.h"\n#include <map>\nclass P : public A, private B {};\nnamespace n {\nint f(int x) {\n  g(x);\n}\n}\nstruct S {\n  int m();\n};\n'
    result = parse(spark, "c.cc", source)
    assert [(row[0], row[3]) for row in imports(result)] == [("h.h", True), ("map", False)]
    assert result["classes"][0]["base_classes"] == ["A", "B"]
    assert [f["name"] for f in result["functions"]] == ["f"] and result["exports"] == []


def test_comments_are_not_code(spark):
    result = parse(spark, "g.go", "package m\n/* func hidden() {\n} */\n// type T struct {\nfunc Seen() {\n}\n")
    assert names(result["functions"]) == [("Seen", 5)] and result["classes"] == []


def test_parse_does_not_shuffle(spark):
    files = spark.createDataFrame([("a.py", "x = 1")], "relative_path string, content string")
    plan = parse_files(files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 1


def test_filter_on_outcome_does_not_run_the_helper_twice(spark):
    files = spark.createDataFrame([("a.py", "x = 1")], "relative_path string, content string")
    plan = parse_files(files).where("succeeded")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_large_generated_files_stay_cheap(spark):
    """Tens of thousands of declarations in one file, with repeated names, in a few seconds."""
    import time

    count = 20_000
    sources = [
        ("big.ts", "".join(f"export const c{i % (count - 5)} = {i};\n" for i in range(count))),
        ("big.rs", "struct S;\nimpl S {\n" + "".join(f"    pub fn f{i}() {{}}\n" for i in range(4000)) + "}\n"),
        ("big.go", "package p\nconst (\n" + "".join(f"  C{i % (count - 5)} = {i}\n" for i in range(count)) + ")\n"),
    ]
    files = spark.createDataFrame(sources, "relative_path string, content string").repartition(3)
    started = time.time()
    rows = {row.relative_path: row for row in parse_files(files).collect()}
    assert time.time() - started < 60
    names_seen = [s.name for s in rows["big.ts"].symbols]
    assert len(names_seen) == count - 5 and names_seen[0] == "c0" and rows["big.ts"].symbols[0].line_number == count - 4
    assert len(rows["big.ts"].exports) == count - 5
    assert len(rows["big.rs"].classes[0].methods) == 4000
    assert len([s for s in rows["big.go"].symbols if s.kind == "constant"]) == count - 5


def test_extraction_refuses_failed_files_when_asked(spark):
    from siltstone.operators.extract import import_edges, require_parsed

    files = spark.createDataFrame([("a.py", "import os"), ("b.py", "def (")], "relative_path string, content string")
    parsed = parse_files(files)
    assert import_edges(parsed).count() == 1
    with pytest.raises(Exception, match="not parsed: b.py"):
        import_edges(require_parsed(parsed)).collect()


def test_many_declarations_cost_in_proportion():
    from siltstone.operators.marks import pattern_marks

    functions = pattern_marks("cpp", "\n".join(f"int f{i}(int a) {{ return a; }}" for i in range(20_000)))
    assert len(functions) == 20_000 and not any(mark.tail for mark in functions)
    body = "\n".join(f"  m{i}(a: number): number {{ return a; }}" for i in range(20_000))
    methods = pattern_marks("typescript", "class K {\n" + body + "\n}")
    assert sum(mark.kind == "method" for mark in methods) == 20_000
    assert {mark.depth for mark in methods if mark.kind == "method"} == {0}


@pytest.mark.parametrize(
    "language, path, line",
    [
        ("cpp", "a.cpp", "int f(\n"),
        ("cpp", "a.hpp", "class A {\n int f(\n"),
        ("rust", "a.rs", "fn f(\n"),
        ("rust", "b.rs", "fn f()\n"),
        ("go", "a.go", "func f(\n"),
        ("typescript", "a.ts", "function f(\n"),
        ("typescript", "b.ts", "class A {\n m(\n"),
    ],
)
def test_unclosed_brackets_hold_no_rest_of_the_text(language, path, line):
    sizes = []
    for count in (5_000, 10_000):
        found = pattern_marks(language, line * count)
        sizes.append(sum(len(m.params or "") + len(m.tail or "") for m in found))
        assert len(found) >= count
    assert sizes[1] <= 2 * sizes[0] + 100 and sizes[1] < 20 * 10_000


def test_innermost_spans_by_brute_force():
    dice = random.Random(4)
    for _ in range(200):
        spans, stack, at = [], [], 0
        for _ in range(dice.randrange(12)):
            at += dice.randrange(1, 4)
            if stack and dice.random() < 0.5:
                spans.append((stack.pop(), at))
            else:
                stack.append(at)
        spans += [(x, at + 5) for x in stack]
        dice.shuffle(spans)
        starts = [dice.randrange(at + 8) for _ in range(20)]
        wanted = []
        for start in starts:
            around = [(e - b, i) for i, (b, e) in enumerate(spans) if b <= start < e]
            wanted.append(min(around)[1] if around else -1)
        found = innermost(starts, spans)
        assert [spans[x] if x >= 0 else None for x in found] == [spans[x] if x >= 0 else None for x in wanted]


def test_many_methods_of_many_impls(spark):
    text = "".join(
        f"pub struct S{i} {{\n}}\nimpl T for S{i} {{\n" + "".join(f"  fn m{j}(&self) -> u8 {{ {j} }}\n" for j in range(10)) + "}\n"
        for i in range(2_000)
    )
    parsed = parse_files(spark.createDataFrame([("a.rs", text)], "relative_path string, content string"))
    row = parsed.selectExpr(
        "size(classes) as n", "size(functions) as free", "aggregate(classes, 0, (a, c) -> a + size(c.methods)) as methods",
        "classes[1999].methods[9].name as last", "classes[1999].base_classes as bases",
    ).first()
    assert (row.n, row.free, row.methods, row["last"], row.bases) == (2_000, 0, 20_000, "m9", ["T"])


def test_unclosed_class_ends_at_the_next(spark):
    text = "class A {\n  a(x: number): void {\n  }\n\nclass B {\n  b(): void {\n  }\n}\n"
    parsed = parse_files(spark.createDataFrame([("a.ts", text)], "relative_path string, content string"))
    found = parsed.selectExpr("transform(classes, c -> struct(c.name, transform(c.methods, m -> m.name))) as c").first().c
    assert [(c[0], c[1]) for c in found] == [("A", ["a"]), ("B", ["b"])]


def test_rules_try_only_lines_of_their_words():
    """What a rule finds from its lines is what its pattern finds in the whole text."""
    rng = random.Random(3)
    keywords = sorted({word for rules in RULES.values() for rule in rules for word in (rule.words or "").split(" ")})
    pieces = [*keywords, "default", "a", "B1", "é", " ", " ", "\n", "\n", "\t", "{", "}", "(", ")", "=", ";", ":", "<T>", "*", "'x'", '"y"', "# include"]
    for language, rules in RULES.items():
        assert sum(rule.words is not None for rule in rules) >= 7
        for _ in range(400):
            text = TextMarks(language, "".join(rng.choice(pieces) for _ in range(60)))
            for rule, pattern in _COMPILED[language]:
                if not rule.inside:
                    assert [x.span() for x in text.outer(rule, pattern)] == [x.span() for x in pattern.finditer(text.scan)]


def test_strip_takes_what_python_strips(spark):
    assert "regexp" not in strip_sql("v")
    points = [x for x in range(1, 0x10000) if not 0xD800 <= x < 0xE000]
    rows = spark.createDataFrame([(x, f"{chr(x)}{chr(x)}a {chr(x)}b{chr(x)}") for x in points], "point int, v string")
    wrong = [r.point for r in rows.selectExpr("point", "v", f"{strip_sql('v')} as s").collect() if r.s != r.v.strip()]
    assert wrong == []
    assert spark.sql(f"select {strip_sql('cast(null as string)')}").first()[0] is None
