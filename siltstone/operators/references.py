"""Integrity rules over several relations, checked in one pass without a join.

Every row mentions keys in *roles*: a node row names its own key, an edge row names the keys of its ends. The mentions of
all relations form one tagged union of (key, role bits). It is folded by key, with partial counts before the shuffle, so a key
that a third of all edges name meets its node as a few partial sums, and every rule is a condition on one folded row.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.errors import IntegrityError, ValidationError


class Mention(NamedTuple):
    """Rows of ``relation`` name ``key``; each role they take there has an SQL condition on the row."""

    relation: str
    key: str
    roles: dict[str, str]


class Graph(NamedTuple):
    """``rules``: how many rows break each rule, in SQL over the counts of a key's roles."""

    mentions: list[Mention]
    rules: dict[str, str]


_SAME_KEY = "if({role} > 1, {role} - 1, 0)"

GRAPHS: dict[str, Graph] = {
    "import_graph": Graph(
        [
            Mention(
                "nodes",
                "identifier",
                {
                    "node": "true",
                    "file": "kind = 'internal_file'",
                    "external": "kind = 'external_module'",
                },
            ),
            Mention("edges", "source", {"source": "true"}),
            Mention("edges", "target", {"inner_target": "is_internal", "outer_target": "not is_internal"}),
        ],
        {
            "unique nodes": _SAME_KEY.format(role="node"),
            "source is a node": "if(node = 0, source, 0)",
            "target is a node": "if(node = 0, inner_target + outer_target, 0)",
            "source is a file": "if(node > 0 and file = 0, source, 0)",
            "is_internal agrees with the target": "if(external > 0, inner_target, 0) + if(node > external, outer_target, 0)",
        },
    ),
    "call_graph": Graph(
        [
            Mention("nodes", "qualified_name", {"node": "true", "uncallable": "kind not in ('function', 'method')"}),
            Mention("edges", "caller", {"caller": "true"}),
        ],
        {
            "unique nodes": _SAME_KEY.format(role="node"),
            "nodes are callable": "uncallable",
            "caller is a node": "if(node = 0, caller, 0)",
        },
    ),
    "knowledge_graph": Graph(
        [
            Mention("nodes", "identifier", {"node": "true"}),
            Mention("relations", "source", {"source": "true"}),
            Mention("relations", "target", {"target": "kind <> 'extends'"}),
        ],
        {
            "unique nodes": _SAME_KEY.format(role="node"),
            "source is a node": "if(node = 0, source, 0)",
            "target is a node": "if(node = 0, target, 0)",
        },
    ),
    "package_tree": Graph(
        [
            Mention("nodes", "package_path", {"node": "true"}),
            Mention("edges", "parent_path", {"parent": "true"}),
            Mention("edges", "child_path", {"child": "true"}),
        ],
        {
            "unique nodes": _SAME_KEY.format(role="node"),
            "parent is a node": "if(node = 0, parent, 0)",
            "child is a node": "if(node = 0, child, 0)",
            "one parent": _SAME_KEY.format(role="child"),
        },
    ),
    "selection": Graph(
        [
            Mention("selected", "subject_id", {"selected": "true"}),
            Mention("rejections", "subject_id", {"rejected": "true"}),
            Mention("scores", "subject_id", {"scored": "true"}),
        ],
        {
            "unique selected": _SAME_KEY.format(role="selected"),
            "unique rejected": _SAME_KEY.format(role="rejected"),
            "selected or rejected, not both": "if(selected > 0 and rejected > 0, 1, 0)",
            "scored subjects are decided": "if(scored > 0 and selected + rejected = 0, scored, 0)",
            "decided subjects are scored": "if(scored = 0, selected + rejected, 0)",
        },
    ),
    "merge": Graph(
        [
            Mention("subjects", "subject_id", {"subject": "true"}),
            Mention("scores", "subject_id", {"scored": "true"}),
            Mention("selected", "subject_id", {"selected": "true"}),
        ],
        {
            "unique subjects": _SAME_KEY.format(role="subject"),
            "unique scores": _SAME_KEY.format(role="scored"),
            "score names a subject": "if(subject = 0, scored, 0)",
            "selected names a subject": "if(subject = 0, selected, 0)",
            "selected has a score": "if(scored = 0, selected, 0)",
        },
    ),
}


def role_counts(graph: str, *scope: str, **relations: DataFrame) -> DataFrame:
    """One row per scope and key: ``bits`` (which roles it has, by ``bit_or``) and how many rows name it in each role."""
    mentions = GRAPHS[graph].mentions
    unknown, needed = set(relations) - {x.relation for x in mentions}, {x.relation for x in mentions} - set(relations)
    if unknown or needed:
        raise ValidationError(f"{graph}: relations {sorted(unknown)} are unknown, {sorted(needed)} are needed")
    roles = [role for mention in mentions for role in mention.roles]
    parts = []
    for mention in mentions:
        bits = " | ".join(
            f"if({condition}, {1 << roles.index(role)}, 0)" for role, condition in mention.roles.items()
        )
        parts.append(
            relations[mention.relation].selectExpr(
                *(f"`{x}`" for x in scope), f"{mention.key} as _key", f"cast({bits} as int) as _bits"
            )
        )
    counts = [F.count_if(F.expr(f"_bits & {1 << at} <> 0")).alias(role) for at, role in enumerate(roles)]
    # Roles that no row takes fall away here: a row of no role (the target of an extending relation) says nothing.
    named = reduce(DataFrame.unionByName, parts).where("_bits <> 0")
    return named.groupBy(*scope, "_key").agg(F.bit_or("_bits").alias("bits"), *counts).withColumnRenamed("_key", "key")


def _broken(graph: str, role_rows: DataFrame) -> list:
    # A null key is no node, whatever names it.
    known = {"node", "subject", "scored"} & set(role_rows.columns)
    rows = role_rows.withColumns({x: F.expr(f"if(key is null, 0, {x})") for x in known})
    return [rows, *(F.expr(condition) for condition in GRAPHS[graph].rules.values())]


def reference_violations(graph: str, *scope: str, **relations: DataFrame) -> DataFrame:
    """(relation, rule, violations) of a graph's rules: one shuffle for all of them, whatever the number of relations.

    ``scope`` columns (repository_id) are part of every key. Violations are counted in offending rows.
    """
    rows, *broken = _broken(graph, role_counts(graph, *scope, **relations))
    names = list(GRAPHS[graph].rules)
    sums = [F.coalesce(F.sum(x), F.lit(0)).cast("bigint").alias(f"rule_{at}") for at, x in enumerate(broken)]
    pairs = ", ".join(f"'{name}', rule_{at}" for at, name in enumerate(names))
    return rows.agg(*sums).selectExpr(
        f"'{graph}' as relation", f"stack({len(names)}, {pairs}) as (rule, violations)"
    )


def offending_keys(graph: str, *scope: str, **relations: DataFrame) -> DataFrame:
    """(scope, key, rule, violations) of every key that breaks a rule."""
    rows, *broken = _broken(graph, role_counts(graph, *scope, **relations))
    found = F.array(
        *(
            F.struct(F.lit(name).alias("rule"), condition.cast("bigint").alias("violations"))
            for name, condition in zip(GRAPHS[graph].rules, broken)
        )
    )
    return (
        rows.select(*scope, "key", F.explode(F.filter(found, lambda x: x["violations"] > 0)).alias("_found"))
        .select(*scope, "key", "_found.rule", "_found.violations")
    )


def require_references(graph: str, *scope: str, **relations: DataFrame) -> None:
    """Raise when any rule of the graph is broken; duplicates are integrity errors."""
    rows = reference_violations(graph, *scope, **relations).where("violations > 0").collect()  # one row per rule
    if rows:
        unique = any(row.rule.startswith("unique ") for row in rows)
        listed = ", ".join(f"{row.rule} ({row.violations})" for row in rows)
        raise (IntegrityError if unique else ValidationError)(f"{graph}: {listed}")
