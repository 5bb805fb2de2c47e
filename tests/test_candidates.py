"""Comparison, ranking, selection, merge and export against brute force on small random input."""

from __future__ import annotations

import hashlib
import itertools
import json
import random
from collections import Counter
from pathlib import Path

import pytest

from siltstone.errors import IntegrityError, NotFoundError, ValidationError
from siltstone.functions.documents import canonical_json, export_checksum
from siltstone.operators import candidates, components
from siltstone.operators.candidates import SelectionPolicy
from siltstone.operators.components import connected_components, greedy_choice
from siltstone.operators.spread import distributed_rank, order_statistic, spread_join
from pyspark.sql import functions as F

SUBJECT = (
    "subject_id string, repository_id string, relative_path string, kind string, name string, signals array<string>, score double"
)


def random_subjects(seed: int, count: int) -> list[tuple]:
    dice = random.Random(seed)
    return [
        (
            f"s{i:03d}",
            "r",
            f"p{i}",
            dice.choice(["class", "function"]),
            # one name holds about a third of all subjects
            "hot" if dice.random() < 0.35 else f"n{dice.randrange(6)}",
            sorted(dice.sample(["a", "b", "c", "d"], dice.randrange(0, 3))),
            dice.randrange(0, 11) / 10,
        )
        for i in range(count)
    ]


def verdict(left: tuple, right: tuple) -> str:
    if left[3] != right[3]:
        return "distinct"
    if left[4] == right[4]:
        return "equivalent" if left[5] == right[5] else "conflicting"
    return "compatible" if set(left[5]) & set(right[5]) else "distinct"


def walk(subjects: list[tuple], conflicts: set[frozenset], policy: SelectionPolicy) -> dict[str, str | None]:
    """The sequential greedy selection, as the contract words it."""
    chosen: list[str] = []
    reasons: dict[str, str | None] = {}
    for row in sorted(subjects, key=lambda s: (-s[6], s[0])):
        subject, kind, score = row[0], row[3], row[6]
        if score < policy.minimum_score:
            reasons[subject] = "below_minimum_score"
        elif policy.required_kind and kind != policy.required_kind:
            reasons[subject] = "kind_mismatch"
        elif any(frozenset((subject, other)) in conflicts for other in chosen):
            reasons[subject] = "conflicting_with_selected"
        elif policy.maximum_selected is not None and len(chosen) >= policy.maximum_selected:
            reasons[subject] = "capacity_exceeded"
        else:
            chosen.append(subject)
            reasons[subject] = None
    return reasons


def got(selection) -> dict[str, str | None]:
    rows = selection.collect()
    assert all(row.selected == (row.reason is None) for row in rows)
    return {row.subject_id: row.reason for row in rows}


POLICIES = [SelectionPolicy(), SelectionPolicy(0.3, 5), SelectionPolicy(0.0, 1, "class"), SelectionPolicy(0.5, None, "function")]


@pytest.mark.parametrize("seed", [1, 2])
def test_verdict_counts_equal_all_pairs(spark, seed):
    rows = random_subjects(seed, 80)
    expected = Counter(verdict(a, b) for a, b in itertools.combinations(rows, 2))
    counts = candidates.verdict_counts(spark.createDataFrame(rows, SUBJECT))
    assert {r.verdict: r.pairs for r in counts.collect()} == {
        v: expected.get(v, 0) for v in ("equivalent", "conflicting", "compatible", "distinct")
    }


@pytest.mark.parametrize("size", [20, 60])
def test_verdict_counts_of_large_signal_sets(spark, size):
    dice = random.Random(size)
    common = [f"s{i:02d}" for i in range(size)]
    rows = []
    for i in range(60):
        # Sets that differ in a few signals of many, small sets, copies, repeats and nulls.
        own = dice.sample(common, size - dice.randrange(3)) if i % 2 else dice.sample(common, dice.randrange(3))
        own = sorted(own) + ([own[0]] if own and i % 7 == 0 else [])
        rows.append((f"x{i}", "r", f"p{i}", "class", f"n{dice.randrange(8)}", own if i % 11 else [None, *own], 0.5))
    expected = Counter(
        verdict((*a[:5], a[5]), (*b[:5], b[5]))
        if a[4] == b[4]
        else ("compatible" if set(filter(None, a[5])) & set(filter(None, b[5])) else "distinct")
        for a, b in itertools.combinations(rows, 2)
    )
    counts = candidates.verdict_counts(spark.createDataFrame(rows, SUBJECT))
    assert {r.verdict: int(r.pairs) for r in counts.collect() if r.pairs} == dict(expected)
    assert dict(counts.dtypes)["pairs"] == "decimal(38,0)"


def test_verdict_counts_of_no_subjects(spark):
    counts = candidates.verdict_counts(spark.createDataFrame([], SUBJECT))
    assert {r.verdict: int(r.pairs) for r in counts.collect()} == dict.fromkeys(
        ("equivalent", "conflicting", "compatible", "distinct"), 0
    )


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_compare_pairs(spark, hot_rows):
    rows = random_subjects(3, 12)
    pairs = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2)]
    outcomes = candidates.compare_pairs(
        spark.createDataFrame(pairs, "left_subject_id string, right_subject_id string"), spark.createDataFrame(rows, SUBJECT), hot_rows
    )
    known = {row[0]: row for row in rows}
    seen = {(o.left_subject_id, o.right_subject_id): (o.verdict, o.shared_signals) for o in outcomes.collect()}
    assert seen == {
        (a, b): (verdict(known[a], known[b]), sorted(set(known[a][5]) & set(known[b][5]))) for a, b in pairs
    }


def test_comparing_a_subject_to_itself_is_an_error(spark):
    pairs = spark.createDataFrame([("a", "a")], "left_subject_id string, right_subject_id string")
    with pytest.raises(ValidationError):
        candidates.compare_pairs(pairs, spark.createDataFrame(random_subjects(1, 2), SUBJECT))


@pytest.mark.parametrize("policy", POLICIES)
@pytest.mark.parametrize("hot_rows", [1_000_000, 4])
def test_selection_equals_the_walk(spark, policy, hot_rows):
    rows = random_subjects(7, 60)
    conflicts = {frozenset((a[0], b[0])) for a, b in itertools.combinations(rows, 2) if verdict(a, b) == "conflicting"}
    selection = candidates.select_subjects(spark.createDataFrame(rows, SUBJECT), policy, hot_rows)
    assert got(selection) == walk(rows, conflicts, policy)


@pytest.mark.parametrize("policy", [SelectionPolicy(0.2, 6), SelectionPolicy()])
def test_selection_with_given_comparisons_equals_the_walk(spark, policy):
    rows = random_subjects(11, 30)
    dice = random.Random(5)
    pairs = [(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if dice.random() < 0.12]
    comparisons = spark.createDataFrame(
        [(a, b, "conflicting") for a, b in pairs] + [(rows[0][0], rows[1][0], "equivalent")],
        "left_subject_id string, right_subject_id string, verdict string",
    )
    selection = candidates.select_with_comparisons(spark.createDataFrame(rows, SUBJECT), comparisons, policy)
    assert got(selection) == walk(rows, {frozenset(p) for p in pairs}, policy)


def test_selection_fixture(spark):
    rows = [
        ("A", "r", "a", "class", "x", ["1"], 0.9),
        ("B", "r", "b", "class", "x", ["2"], 0.8),
        ("C", "r", "c", "class", "y", [], 0.7),
        ("D", "r", "d", "class", "z", [], 0.6),
        ("E", "r", "e", "class", "w", [], 0.4),
    ]
    selection = candidates.select_subjects(spark.createDataFrame(rows, SUBJECT), SelectionPolicy(0.5, 2))
    assert got(selection) == {
        "A": None,
        "B": "conflicting_with_selected",
        "C": None,
        "D": "capacity_exceeded",
        "E": "below_minimum_score",
    }
    assert candidates.is_selected(selection, "A") and not candidates.is_selected(selection, "B")


@pytest.mark.parametrize("capacity", [1, 9, 17, 60])
def test_any_capacity(spark, capacity):
    rows = random_subjects(13, 50)
    conflicts = {frozenset((a[0], b[0])) for a, b in itertools.combinations(rows, 2) if verdict(a, b) == "conflicting"}
    policy = SelectionPolicy(0.1, capacity)
    frame = spark.createDataFrame(rows, SUBJECT)
    assert got(candidates.select_subjects(frame, policy)) == walk(rows, conflicts, policy)
    first = [r.subject_id for r in candidates.top(frame, capacity).collect()]
    assert first == [r[0] for r in sorted(rows, key=lambda r: (-r[6], r[0]))][:capacity]


def test_all_of_many_hot_keys_are_split(spark):
    facts = spark.range(3 * 1001).selectExpr("id % 1001 as k", "id as v").unionByName(
        spark.range(5).selectExpr("cast(null as bigint) as k", "-id as v")
    )
    lookup = spark.range(1001).selectExpr("id as k", "id * 10 as w")
    for lookup_rows in (lookup, lookup.withColumn("rows", F.lit(3).cast("bigint"))):
        counts = lookup_rows.select("k", "rows") if "rows" in lookup_rows.columns else None
        joined = spread_join(facts, lookup_rows, ["k"], ["v"], counts, hot_rows=1, shares=5_000)
        found = {(r.k, r.v, r.w) for r in joined.collect()}
        assert found == {(i % 1001, i, i % 1001 * 10) for i in range(3003)} | {(None, -i, None) for i in range(5)}
        plan = joined._jdf.queryExecution().optimizedPlan().toString()
        assert "GlobalLimit" not in plan and "LocalLimit" not in plan


def test_order_statistic(spark):
    frame = spark.range(1000).selectExpr("(id * 7919) % 1000 as x")
    assert [order_statistic(frame, [F.col("x")], k).x for k in (1, 500, 1000)] == [0, 499, 999]
    assert order_statistic(frame, [F.col("x")], 1001) is None and order_statistic(frame.limit(0), [F.col("x")], 1) is None


@pytest.mark.parametrize("policy", [SelectionPolicy(minimum_score=1.5), SelectionPolicy(maximum_selected=0)])
def test_bad_policies(spark, policy):
    with pytest.raises(ValidationError):
        candidates.select_subjects(spark.createDataFrame(random_subjects(1, 2), SUBJECT), policy)


def test_distributed_rank_with_many_ties(spark):
    rows = [(f"s{i:04d}", 0.5 if i % 3 else i / 1000) for i in range(500)]
    ranked = distributed_rank(spark.createDataFrame(rows, "subject_id string, score double"), candidates.rank_order())
    expected = [s for s, _ in sorted(rows, key=lambda r: (-r[1], r[0]))]
    assert [r.subject_id for r in ranked.orderBy("rank").collect()] == expected
    assert sorted(r.rank for r in ranked.collect()) == list(range(1, 501))


def test_merge_and_export(spark):
    rows = random_subjects(17, 20)
    subjects = spark.createDataFrame(rows, SUBJECT)
    selected = candidates.select_subjects(subjects, SelectionPolicy(0.2, 6)).where("selected")
    candidates.require_mergeable(subjects, subjects, selected)
    members = candidates.merge_selected(subjects, subjects, selected)
    (export,) = candidates.export_members(members).collect()
    payload = json.loads(candidates.export_document(members).first().payload)
    assert [m["subject_id"] for m in payload["members"]] == [
        r.subject_id for r in members.orderBy(F.desc("score"), "subject_id").collect()
    ]
    canonical = json.dumps(payload, sort_keys=True, separators=(",", ":"))
    assert export.checksum == hashlib.sha256(canonical.encode()).hexdigest() and export.member_count == len(payload["members"])
    with pytest.raises(NotFoundError):
        candidates.member(members, "nope").collect()


@pytest.mark.parametrize("count", [0, 1, 4, 5, 70])
def test_digest_tree(spark, count):
    members = spark.createDataFrame(random_subjects(19, count), SUBJECT)
    rows = members.orderBy(F.desc("score"), "subject_id").collect()
    names = ("kind", "name", "relative_path", "repository_id", "score", "subject_id")
    level = [
        hashlib.sha256(json.dumps({n: r[n] for n in names}, separators=(",", ":")).encode()).hexdigest() for r in rows
    ]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 4]).encode()).hexdigest() for i in range(0, len(level), 4)]
    root = level[0] if level else hashlib.sha256(b"").hexdigest()
    for parts in (1, 6):
        (manifest,) = candidates.export_manifest(members.repartition(parts), fan_out=4).collect()
        assert (manifest.format_version, manifest.member_count, manifest.root) == ("1.0", count, root)


def test_canonical_json(spark):
    values = [{"b": 1.5e-05, "a": None, "é": [1, 2.0, True]}, {"z": {"y": 1, "x": "ü"}}]
    frame = spark.createDataFrame([(json.dumps(v),) for v in values], "t string")
    out = frame.select(canonical_json(F.col("t")).alias("c"), export_checksum(F.col("t")).alias("h")).collect()
    for row, value in zip(out, values):
        canonical = json.dumps(value, sort_keys=True, separators=(",", ":"))
        assert (row.c, row.h) == (canonical, hashlib.sha256(canonical.encode()).hexdigest())


def test_subjects_must_be_unique(spark):
    rows = [("r", "p", "f", "class"), ("r", "p", "f", "function")]
    subjects = candidates.build_subjects(spark.createDataFrame(rows, "repository_id string, relative_path string, name string, kind string"))
    assert subjects.first().subject_id == "r:p::f"
    with pytest.raises(IntegrityError):
        candidates.require_unique_subjects(subjects)


def test_consistency_checks(spark):
    subjects = spark.createDataFrame(random_subjects(1, 3), SUBJECT)
    stranger = spark.createDataFrame([("zz", 0.5)], "subject_id string, score double")
    with pytest.raises(ValidationError):
        candidates.require_consistent(subjects, stranger)
    clash = spark.createDataFrame([("s000", "s001", "conflicting")], "left_subject_id string, right_subject_id string, verdict string")
    with pytest.raises(ValidationError):
        candidates.require_no_conflict(subjects, clash)


def greedy(links):
    """The walk itself over ((key, id), (key, id)) pairs."""
    nodes = sorted({x for pair in links for x in pair})
    chosen = set()
    for node in nodes:
        if not any((a == node and b in chosen) or (b == node and a in chosen) for a, b in links):
            chosen.add(node)
    return {x[1] for x in chosen}


def linked(spark, pairs):
    rows = [(*reversed(min(a, b)), *reversed(max(a, b))) for a, b in pairs]
    return spark.createDataFrame(rows, "better string, better_key double, worse string, worse_key double")


@pytest.mark.parametrize("component_links", [500_000, 12])
def test_greedy_choice_equals_the_walk(spark, component_links):
    dice = random.Random(23)
    nodes = [(-dice.randrange(5) / 10, f"s{i:02d}") for i in range(30)]
    pairs = [tuple(dice.sample(nodes, 2)) for _ in range(10)]
    pairs += [(nodes[0], x) for x in nodes[1:15]]  # a hub, in a component beyond the bound
    found = [r.subject_id for r in greedy_choice(linked(spark, pairs), component_links=component_links).collect()]
    assert len(found) == len(set(found)) and set(found) == greedy(pairs)


def test_a_long_chain_is_walked_in_one_pass(spark):
    chain = [(float(i), f"c{i:04d}") for i in range(600)]
    pairs = list(zip(chain, chain[1:]))
    before = checkpoints(spark)
    found = {r.subject_id for r in greedy_choice(linked(spark, pairs)).collect()}
    assert found == {x[1] for x in chain[::2]} and checkpoints(spark) - before < 10


def test_rounds_come_before_components(spark, monkeypatch):
    """In a dense graph, rounds alone leave little enough to be walked at once; components take many joins to tell apart."""
    dice = random.Random(5)
    nodes = [(-dice.randrange(7) / 10, f"d{i:03d}") for i in range(150)]
    pairs = [tuple(dice.sample(nodes, 2)) for _ in range(1500)]

    def refused(*_):
        raise AssertionError("components were computed")

    monkeypatch.setattr(components, "connected_components", refused)
    found = [r.subject_id for r in greedy_choice(linked(spark, pairs), component_links=200).collect()]
    assert len(found) == len(set(found)) and set(found) == greedy(pairs)


def checkpoints(spark):
    return len(list(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).iterdir())) if spark.sparkContext.getCheckpointDir() else 0


def test_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("c", "a"), ("q", "q"), (None, "a"), ("y", "z")]
    frame = spark.createDataFrame(pairs, "l string, r string")
    for hot_rows in (1_000_000, 1):
        found = {r.node: r.component for r in connected_components(frame, "l", "r", hot_rows).collect()}
        assert found == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}
    assert connected_components(frame.limit(0), "l", "r").collect() == []
