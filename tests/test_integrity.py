"""Rules over several relations and over stored orders, against plain recomputations."""

from __future__ import annotations

import random

import pytest

from siltstone.errors import IntegrityError, ValidationError
from siltstone.operators import references, sequences


def counts(frame) -> dict[str, int]:
    return {row.rule: row.violations for row in frame.collect()}


def test_import_graph_rules(spark):
    nodes = spark.createDataFrame(
        [("a.py", "internal_file"), ("b.py", "internal_file"), ("b.py", "internal_file"), ("os", "external_module"), ("x", "unresolved_internal")],
        "identifier string, kind string",
    )
    edges = spark.createDataFrame(
        [
            ("a.py", "b.py", True),
            ("a.py", "os", False),
            ("a.py", "os", True),  # an external target said to be internal
            ("a.py", "x", False),  # an unresolved internal target said to be external
            ("os", "a.py", True),  # a source that is no file
            ("gone", "a.py", True),
            ("a.py", "gone", True),
            (None, "a.py", True),
        ],
        "source string, target string, is_internal boolean",
    )
    assert counts(references.reference_violations("import_graph", nodes=nodes, edges=edges)) == {
        "unique nodes": 1,
        "source is a node": 2,
        "target is a node": 1,
        "source is a file": 1,
        "is_internal agrees with the target": 2,
    }
    keys = {(r.key, r.rule) for r in references.offending_keys("import_graph", nodes=nodes, edges=edges).collect()}
    assert ("gone", "source is a node") in keys and (None, "source is a node") in keys and ("b.py", "unique nodes") in keys
    with pytest.raises(IntegrityError, match="unique nodes"):
        references.require_references("import_graph", nodes=nodes, edges=edges)
    with pytest.raises(ValidationError, match="target is a node"):
        references.require_references("import_graph", nodes=nodes.distinct(), edges=edges.where("target = 'gone'"))
    references.require_references("import_graph", nodes=nodes.distinct(), edges=edges.limit(2))


def test_scope_is_part_of_the_key(spark):
    nodes = spark.createDataFrame([(1, "f", "function"), (2, "f", "method")], "repository_id int, qualified_name string, kind string")
    edges = spark.createDataFrame([(1, "f"), (3, "f")], "repository_id int, caller string")
    found = references.reference_violations("call_graph", "repository_id", nodes=nodes, edges=edges)
    assert counts(found) == {"unique nodes": 0, "nodes are callable": 0, "caller is a node": 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_knowledge_and_selection_rules_by_brute_force(spark, seed):
    dice = random.Random(seed)
    ids = [dice.choice("abcdefgh") for _ in range(6)]
    relations = [(dice.choice("abcdefghij"), dice.choice("abcdefghij"), dice.choice(["extends", "declares"])) for _ in range(40)]
    found = references.reference_violations(
        "knowledge_graph",
        nodes=spark.createDataFrame([(x,) for x in ids], "identifier string"),
        relations=spark.createDataFrame(relations, "source string, target string, kind string"),
    )
    assert counts(found) == {
        "unique nodes": len(ids) - len(set(ids)),
        "source is a node": sum(s not in ids for s, _, _ in relations),
        "target is a node": sum(t not in ids and k != "extends" for _, t, k in relations),
    }
    sides = {name: [dice.choice("abcdefghij") for _ in range(7)] for name in ("selected", "rejections", "scores")}
    frames = {name: spark.createDataFrame([(x,) for x in own], "subject_id string") for name, own in sides.items()}
    decided = sides["selected"] + sides["rejections"]
    assert counts(references.reference_violations("selection", **frames)) == {
        "unique selected": 7 - len(set(sides["selected"])),
        "unique rejected": 7 - len(set(sides["rejections"])),
        "selected or rejected, not both": len(set(sides["selected"]) & set(sides["rejections"])),
        "scored subjects are decided": sum(x not in decided for x in sides["scores"]),
        "decided subjects are scored": sum(x not in sides["scores"] for x in decided),
    }


def test_package_paths_and_empty_relations(spark):
    nodes = spark.createDataFrame([([],), (["a"],)], "package_path array<string>")
    edges = spark.createDataFrame([([], ["a"]), (["a"], ["a", "b"]), ([], ["a"])], "parent_path array<string>, child_path array<string>")
    assert counts(references.reference_violations("package_tree", nodes=nodes, edges=edges)) == {
        "unique nodes": 0,
        "parent is a node": 0,
        "child is a node": 1,
        "one parent": 1,
    }
    nothing = references.reference_violations("package_tree", nodes=nodes.limit(0), edges=edges.limit(0))
    assert set(counts(nothing).values()) == {0}


def test_one_shuffle_and_no_join(spark):
    nodes = spark.range(10).selectExpr("concat('n', id) as qualified_name", "'function' as kind")
    edges = spark.range(10).selectExpr("concat('n', id) as caller")
    plan = references.role_counts("call_graph", nodes=nodes, edges=edges)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_relations_are_named(spark):
    with pytest.raises(ValidationError, match="edges"):
        references.role_counts("call_graph", nodes=spark.range(1))


@pytest.mark.parametrize("ranges", [1, 3, 60])
def test_order_by_brute_force(spark, ranges):
    dice = random.Random(11)
    rows = [(at, dice.choice([0.1, 0.5, 0.9, None]), dice.choice("abcde")) for at in range(200)]
    rows += [(7, 0.5, "z"), (7, 0.9, "a"), (None, 0.2, "q")]
    frame = spark.createDataFrame(rows, "position bigint, score double, subject_id string").repartition(5)

    def key(row):
        return ((0,) if row[1] is None else (1, -row[1])), row[2]

    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], key(r)))
    wrong = sum(key(b) < key(a) for a, b in zip(ordered, ordered[1:]))
    assert counts(sequences.order_violations(frame, "scores", ranges=ranges)) == {
        "sorted by -score, subject_id": wrong,
        "one row a position": 2,
        "unique subject_id": len(rows) - len({r[2] for r in rows}),
    }


def test_sorted_sequence_passes(spark):
    frame = spark.range(1000).selectExpr("id as position", "lpad(id, 6, '0') as id")
    assert sequences.require_order(frame, "memory") is frame
    with pytest.raises(ValidationError, match="sorted"):
        sequences.require_order(frame.selectExpr("-position as position", "id"), "memory")
    with pytest.raises(IntegrityError, match="unique"):
        sequences.require_order(frame.selectExpr("position", "'x' as id"), "memory")
    assert set(counts(sequences.order_violations(frame.limit(0), "memory")).values()) == {0}


def test_array_keys(spark):
    frame = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["a", "a"])], "position int, package_path array<string>")
    assert counts(sequences.order_violations(frame, "package_nodes", ranges=2))["sorted by package_path"] == 1
