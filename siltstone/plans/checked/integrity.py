"""Rules over several relations and over stored orders, on the star-schema tables in the roles of nodes, edges and scores.

Every relation breaks each of its rules somewhere, so that the counts differ from zero.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import checks, references, sequences
from siltstone.plans.checked import query, table


def _import_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Orders as files (every seventh is missing), parts as targets of line items (every ninth missing, every eleventh twice)."""
    files = table(spark, folder, "orders").where("o_orderkey % 7 <> 3").selectExpr(
        "concat('o', o_orderkey) as identifier", "if(o_orderkey % 13 = 5, 'external_module', 'internal_file') as kind"
    )
    parts = table(spark, folder, "part").where("p_partkey % 9 <> 4").selectExpr(
        "concat('p', p_partkey) as identifier",
        "case p_partkey % 3 when 0 then 'internal_file' when 1 then 'external_module' else 'unresolved_internal' end as kind",
    )
    twice = parts.where("cast(substr(identifier, 2) as bigint) % 11 = 6")
    edges = table(spark, folder, "lineitem").selectExpr(
        "concat('o', l_orderkey) as source", "concat('p', l_partkey) as target", "l_linenumber <> 2 as is_internal"
    )
    return {"nodes": files.unionByName(parts).unionByName(twice), "edges": edges}


def _call_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Customers as callables (every tenth is missing, every twelfth a class), orders as their calls."""
    nodes = table(spark, folder, "customer").where("c_custkey % 10 <> 4").selectExpr(
        "c_name as qualified_name", "if(c_custkey % 12 = 7, 'class', 'function') as kind"
    )
    edges = table(spark, folder, "orders").selectExpr("format_string('Customer#%09d', o_custkey) as caller")
    return {"nodes": nodes.unionByName(nodes.where("endswith(qualified_name, '55')")), "edges": edges}


def _knowledge_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Suppliers as concepts related to nations; nations above 20 are missing, extending relations may leave the graph."""
    nodes = table(spark, folder, "supplier").where("s_suppkey % 6 <> 1").selectExpr("concat('s', s_suppkey) as identifier")
    nations = table(spark, folder, "nation").where("n_nationkey <= 20").selectExpr("concat('n', n_nationkey) as identifier")
    relations = table(spark, folder, "supplier").selectExpr(
        "concat('s', s_suppkey) as source",
        "concat('n', s_nationkey) as target",
        "if(s_suppkey % 2 = 0, 'extends', 'declares') as kind",
    )
    twice = nations.where("identifier in ('n3', 'n5')")
    return {"nodes": nodes.unionByName(nations).unionByName(twice), "relations": relations}


def _package_tree(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Nations inside regions; one region and two nations are missing, one nation has two parents."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    nodes = region.where("r_regionkey <> 2").selectExpr("r_regionkey", "array(r_name) as package_path").unionByName(
        nation.where("n_nationkey not in (4, 9)").selectExpr("-1 as r_regionkey", "array(n_name) as package_path")
    )
    edges = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).selectExpr(
        "n_nationkey", "array(r_name) as parent_path", "array(n_name) as child_path"
    )
    return {
        "nodes": nodes.unionByName(nodes.where("r_regionkey = 1")),
        "edges": edges.unionByName(edges.where("n_nationkey = 6")),
    }


def _selection(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Parts as subjects, selected and rejected by size, some both, some neither, some without a score."""
    part = table(spark, folder, "part")
    selected = part.where("p_size <= 20").selectExpr("concat('p', p_partkey) as subject_id")
    rejections = part.where("p_size >= 20 and p_size <> 30").selectExpr("concat('p', p_partkey) as subject_id")
    scores = part.where("p_partkey % 8 <> 1").selectExpr("concat('p', p_partkey) as subject_id")
    return {
        "selected": selected.unionByName(selected.where("endswith(subject_id, '7')")),
        "rejections": rejections.unionByName(rejections.where("endswith(subject_id, '3')")),
        "scores": scores,
    }


def _merge(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Customers as subjects; orders give scores, some for missing subjects; a few selected have no score."""
    customer, orders = table(spark, folder, "customer"), table(spark, folder, "orders")
    subjects = customer.where("c_custkey % 5 <> 2").selectExpr("c_custkey as subject_id")
    return {
        "subjects": subjects.unionByName(subjects.where("subject_id % 50 = 1")),
        "scores": orders.selectExpr("o_custkey as subject_id"),
        "selected": customer.where("c_acctbal > 0").selectExpr("c_custkey as subject_id"),
    }


@query(
    "graph_violations",
    """with p as (select 'p' || p_partkey as id, p_partkey % 3 as k, p_partkey % 11 = 6 as twice from part where p_partkey % 9 <> 4),
    f as (select 'o' || o_orderkey as id, o_orderkey % 13 = 5 as outer_kind from orders where o_orderkey % 7 <> 3),
    e as (select 'o' || l_orderkey as s, 'p' || l_partkey as t, l_linenumber <> 2 as inner_edge from lineitem),
    c as (select c_name as id, c_custkey % 12 = 7 as class from customer where c_custkey % 10 <> 4),
    cn as (select * from c union all select * from c where id like '%55'),
    o as (select 'Customer#' || lpad(o_custkey::varchar, 9, '0') as caller from orders),
    kn as (select 's' || s_suppkey as id from supplier where s_suppkey % 6 <> 1 union all
      select 'n' || n_nationkey from nation where n_nationkey <= 20),
    kr as (select 's' || s_suppkey as s, 'n' || s_nationkey as t, s_suppkey % 2 = 0 as extending from supplier),
    tn as (select r_name as id from region where r_regionkey <> 2 union all select n_name from nation where n_nationkey not in (4, 9)),
    te as (select r_name as parent, n_name as child from nation join region on r_regionkey = n_regionkey),
    te2 as (select * from te union all select * from te where child = (select n_name from nation where n_nationkey = 6)),
    se as (select 'p' || p_partkey as id from part where p_size <= 20),
    re as (select 'p' || p_partkey as id from part where p_size >= 20 and p_size <> 30),
    sc as (select 'p' || p_partkey as id from part where p_partkey % 8 <> 1),
    ms as (select c_custkey as id from customer where c_custkey % 5 <> 2),
    ml as (select c_custkey as id from customer where c_acctbal > 0)
    select relation, rule, violations::bigint as violations from (
    select 'import_graph' as relation, 'unique nodes' as rule, (select count(*) from p where twice) as violations
    union all select 'import_graph', 'source is a node', (select count(*) from e where s not in (select id from f))
    union all select 'import_graph', 'target is a node', (select count(*) from e where t not in (select id from p))
    union all select 'import_graph', 'source is a file', (select count(*) from e join f on s = id where outer_kind)
    union all select 'import_graph', 'is_internal agrees with the target', (select count(*) from e join p on t = id where (k = 1) = inner_edge)
    union all select 'call_graph', 'unique nodes', (select count(*) from c where id like '%55')
    union all select 'call_graph', 'nodes are callable', (select count(*) from cn where class)
    union all select 'call_graph', 'caller is a node', (select count(*) from o where caller not in (select id from c))
    union all select 'knowledge_graph', 'unique nodes', 2
    union all select 'knowledge_graph', 'source is a node', (select count(*) from kr where s not in (select id from kn))
    union all select 'knowledge_graph', 'target is a node', (select count(*) from kr where not extending and t not in (select id from kn))
    union all select 'package_tree', 'unique nodes', (select count(*) from tn where id = (select r_name from region where r_regionkey = 1))
    union all select 'package_tree', 'parent is a node', (select count(*) from te2 where parent not in (select id from tn))
    union all select 'package_tree', 'child is a node', (select count(*) from te2 where child not in (select id from tn))
    union all select 'package_tree', 'one parent', 1
    union all select 'selection', 'unique selected', (select count(*) from se where id like '%7')
    union all select 'selection', 'unique rejected', (select count(*) from re where id like '%3')
    union all select 'selection', 'selected or rejected, not both', (select count(*) from se where id in (select id from re))
    union all select 'selection', 'scored subjects are decided', (select count(*) from sc where id not in (select id from se) and id not in (select id from re))
    union all select 'selection', 'decided subjects are scored', (select count(*) from (select id from se union all select id from se where id like '%7'
      union all select id from re union all select id from re where id like '%3') where id not in (select id from sc))
    union all select 'merge', 'unique subjects', (select count(*) from ms where id % 50 = 1)
    union all select 'merge', 'unique scores', (select count(*) - count(distinct o_custkey) from orders)
    union all select 'merge', 'score names a subject', (select count(*) from orders where o_custkey not in (select id from ms))
    union all select 'merge', 'selected names a subject', (select count(*) from ml where id not in (select id from ms))
    union all select 'merge', 'selected has a score', (select count(*) from ml where id not in (select o_custkey from orders)))""",
)
def graph_violations(spark: SparkSession, folder: str) -> DataFrame:
    made = {
        "import_graph": _import_graph,
        "call_graph": _call_graph,
        "knowledge_graph": _knowledge_graph,
        "package_tree": _package_tree,
        "selection": _selection,
        "merge": _merge,
    }
    return reduce(
        DataFrame.unionByName,
        (references.reference_violations(name, **relations(spark, folder)) for name, relations in made.items()),
    )


@query(
    "graph_offending_keys",
    """with c as (select c_name as id from customer where c_custkey % 10 <> 4),
    o as (select 'Customer#' || lpad(o_custkey::varchar, 9, '0') as caller from orders)
    select id as key, 'unique nodes' as rule, 1::bigint as violations from c where id like '%55'
    union all select c_name, 'nodes are callable', case when c_name like '%55' then 2 else 1 end
      from customer where c_custkey % 10 <> 4 and c_custkey % 12 = 7
    union all select caller, 'caller is a node', count(*) from o where caller not in (select id from c) group by caller""",
)
def graph_offending_keys(spark: SparkSession, folder: str) -> DataFrame:
    return references.offending_keys("call_graph", **_call_graph(spark, folder))


_SEQUENCES = {
    # relation: (rows, sort keys as DuckDB writes them, unique column)
    "scores": (
        "select o_orderkey as position, case when o_orderkey % 97 = 1 then -1.0 else -o_orderkey end::double as score, "
        "'s' || o_orderkey % 5000 as subject_id from orders",
        ("-{}.score", "{}.subject_id"),
        "subject_id",
    ),
    "memory": (
        "select c_custkey as position, case when c_custkey % 50 = 3 then 'c' else c_name end as id from customer",
        ("{}.id",),
        "id",
    ),
    "matches": (
        "select l_orderkey * 8 + l_linenumber as position, -(l_orderkey // 4)::double as score, "
        "'l' || l_linenumber as id from lineitem",
        ("-{}.score", "{}.id"),
        "id",
    ),
    "call_edges": (
        "select l_orderkey * 8 + l_linenumber as position, lpad(l_orderkey::varchar, 12, '0') as caller, "
        "lpad(l_suppkey::varchar, 12, '0') as callee, l_linenumber as line_number from lineitem",
        ("{}.caller", "{}.callee", "{}.line_number"),
        "",
    ),
}


def _order_oracle() -> str:
    parts = []
    for name, (rows, keys, unique) in _SEQUENCES.items():
        own, before, inner = (", ".join(key.format(side) for key in keys) for side in ("k", "b", "r"))
        numbered = f"(select *, row_number() over (order by position, {inner}) as n from ({rows}) r)"
        parts.append(
            f"select '{name}' as relation, 'sorted by {', '.join(sequences.ORDERS[name].keys)}' as rule, (select count(*) "
            f"from {numbered} k join {numbered} b on k.n = b.n + 1 where row({own}) < row({before})) as violations union all "
            f"select '{name}', 'one row a position', (select count(*) - count(distinct position) from ({rows}))"
        )
        if unique:
            parts.append(
                f"select '{name}', 'unique {unique}', (select count(*) - count(distinct {unique}) from ({rows}))"
            )
    return f"select relation, rule, violations::bigint as violations from ({' union all '.join(parts)})"


@query("order_violations", _order_oracle())
def order_violations(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer, lineitem = (table(spark, folder, x) for x in ("orders", "customer", "lineitem"))
    rows = {
        "scores": orders.selectExpr(
            "o_orderkey as position",
            "cast(if(o_orderkey % 97 = 1, -1, -o_orderkey) as double) as score",
            "concat('s', o_orderkey % 5000) as subject_id",
        ),
        "memory": customer.selectExpr("c_custkey as position", "if(c_custkey % 50 = 3, 'c', c_name) as id"),
        "matches": lineitem.selectExpr(
            "l_orderkey * 8 + l_linenumber as position",
            "cast(-(l_orderkey div 4) as double) as score",
            "concat('l', l_linenumber) as id",
        ),
        "call_edges": lineitem.selectExpr(
            "l_orderkey * 8 + l_linenumber as position",
            "lpad(l_orderkey, 12, '0') as caller",
            "lpad(l_suppkey, 12, '0') as callee",
            "l_linenumber as line_number",
        ),
    }
    return reduce(DataFrame.unionByName, (sequences.order_violations(frame, name) for name, frame in rows.items()))


# What breaks each kind of rule in the rows below, by the part's key k and size.
_BLANK, _NEGATIVE, _OVER = "k % 7 = 0", "p_size < 10", "p_size > 40"
_TEXTS = (
    "name source_uri relative_path category message subject_name subject caller callee identifier source target subject_id "
    "left_subject_id format_version memory_type step_name"
).split()
_COUNTS = (
    "class_count function_count method_count import_count export_count symbol_count module_count async_function_count "
    "documented_class_count documented_function_count line_count size_bytes declared_module_count methods_per_class "
    "lines_per_function classes_per_kloc functions_per_kloc methods_per_kloc symbols_per_kloc candidate_count "
    "external_dependency_count test_function_count test_class_count member_count"
).split()
_RATIOS = "score async_function_ratio documented_public_ratio".split()
_LISTS = "repositories modules classes functions imports exports symbols edges interfaces candidates patterns".split()
_VALUES = "unit metadata assessment metrics profile coverage evidence".split()


def _envelope(*lists: str, value: str = "") -> dict[str, str]:
    rules = {"error only on failure": "k % 6 = 0", "failure has an error": "k % 2 = 1 and k % 3 <> 0"}
    rules |= {f"no {x} on failure": "k % 2 = 1 and k % 5 = 0" for x in lists}
    return rules | ({f"{value} on success": "k % 2 = 0 and k % 5 <> 0", f"no {value} on failure": "k % 2 = 1 and k % 5 = 0"} if value else {})


_BROKEN: dict[str, dict[str, str]] = {
    "repositories": {"name filled": _BLANK, "source_uri filled": _BLANK},
    "source_files": {"relative_path filled": _BLANK, "size not negative": _NEGATIVE},
    "findings": {"category filled": _BLANK, "message filled": _BLANK},
    "collections": _envelope("repositories"),
    "parse_results": {
        **_envelope("modules", "classes", "functions", "imports", "exports", "symbols"),
        "metadata on success": "k % 2 = 0 and k % 5 <> 0",
        "no metadata on failure": "k % 2 = 1 and k % 5 = 0",
    },
    "ast_metadata": {f"{x} not negative": _NEGATIVE for x in _COUNTS[:11]},
    "architecture_assessments": {"declared_module_count not negative": _NEGATIVE},
    "complexity_metrics": {
        "methods_per_class not negative": _NEGATIVE,
        "lines_per_function not negative": _NEGATIVE,
        "async_function_ratio in 0..1": _OVER,
        "counts not negative": _NEGATIVE,
    },
    "density_metrics": {
        f"{x} not negative": _NEGATIVE
        for x in ("line_count", "classes_per_kloc", "functions_per_kloc", "methods_per_kloc", "symbols_per_kloc")
    },
    "quality_assessments": {
        "counts not negative": "p_size < 10 or (k % 2 = 0 and p_size < 12)",
        "public within all": "k % 2 = 1",
        "documented_public_ratio in 0..1": _OVER,
    },
    "security_assessments": {"external_dependency_count not negative": _NEGATIVE, "external_targets sorted set": "k % 4 = 0"},
    "test_evidence": {"counts not negative": _NEGATIVE},
    "quality_indicators": {"subject_name filled": _BLANK, "message filled": _BLANK},
    "test_indicators": {"subject_name filled": _BLANK, "message filled": _BLANK},
    "security_indicators": {"subject filled": _BLANK, "message filled": _BLANK},
    "package_edges": {"child is directly below parent": "k % 3 <> 0"},
    "call_nodes": {"kind callable": "k % 6 = 0"},
    "call_edges": {"caller filled": _BLANK, "callee filled": _BLANK},
    "dependency_nodes": {"identifier filled": _BLANK},
    "dependency_edges": {"source filled": _BLANK, "target filled": _BLANK},
    "knowledge_nodes": {"identifier carries its kind": "true"},
    "knowledge_relations": {"source filled": _BLANK, "target filled": _BLANK},
    "comparisons": {
        "left filled": _BLANK,
        "right filled": "k % 7 = 0 and k % 4 = 1",
        "subjects differ": "k % 4 = 1",
        "shared_signals sorted set": "k % 4 = 0",
    },
    "scores": {"subject_id filled": _BLANK, "score in 0..1": _OVER},
    "members": {"subject_id filled": _BLANK, "name filled": _BLANK, "relative_path filled": _BLANK, "score in 0..1": _OVER},
    "rejections": {"subject_id filled": _BLANK, "message filled": _BLANK},
    "exports": {
        "format_version filled": _BLANK,
        "member_count not negative": _NEGATIVE,
        "checksum is 64 hex digits": "k % 5 = 0",
    },
    "memory": {"memory_type filled": _BLANK},
    "vectors": {"embedding not empty": "k % 5 <> 0", "embedding finite": "k % 10 = 0"},
    "matches": {"score in 0..1": _OVER},
    "step_outcomes": {"step_name filled": _BLANK, **_envelope()},
    **{
        f"{name}_results": _envelope(payload)
        for name, payload in (
            ("import", "edges"), ("symbol", "symbols"), ("interface", "interfaces"), ("candidate", "candidates"), ("pattern", "patterns"),
        )
    },
    **{
        f"{name}_results": _envelope(value=payload)
        for name, payload in (
            ("package_unit", "unit"), ("ast", "metadata"), ("architecture", "assessment"), ("complexity", "metrics"),
            ("dependency", "profile"), ("documentation", "coverage"), ("density", "metrics"), ("quality", "assessment"),
            ("security", "assessment"), ("test", "evidence"),
        )
    },
}


def _rules_oracle() -> str:
    rows = [
        f"select '{relation}' as relation, '{rule}' as rule, (select count(*) from p where {condition}) as violations"
        for relation, rules in _BROKEN.items()
        for rule, condition in rules.items()
    ]
    return f"with p as (select p_partkey as k, p_size from part) {' union all '.join(rows)}"


@query("relation_rules", _rules_oracle())
def relation_rules(spark: SparkSession, folder: str) -> DataFrame:
    """The row rules of all result relations, on parts as their rows; the check SQL states what breaks each rule."""
    part = table(spark, folder, "part").withColumnRenamed("p_partkey", "k")
    columns = {x: "if(k % 7 = 0, ' \\t', p_name)" for x in _TEXTS}
    columns |= {x: "p_size - 10" for x in _COUNTS} | {x: "p_size / 40.0D" for x in _RATIOS}
    columns |= {x: "if(k % 5 = 0, array(p_name), cast(array() as array<string>))" for x in _LISTS}
    columns |= {x: "if(k % 5 = 0, p_name, null)" for x in _VALUES}
    columns |= {
        "succeeded": "k % 2 = 0",
        "error_message": "if(k % 3 = 0, 'broken', null)",
        "public_candidate_count": "p_size - 12 + k % 2 * 5",
        "external_targets": "if(k % 4 = 0, array('b', 'a'), array('a', 'b'))",
        "shared_signals": "if(k % 4 = 0, array('a', 'a'), array('a', 'b'))",
        "right_subject_id": "if(k % 4 = 1, left_subject_id, 'x')",
        "parent_path": "array('a')",
        "child_path": "if(k % 3 = 0, array('a', 'b'), array('b', 'c'))",
        "kind": "if(k % 6 = 0, 'class', 'function')",
        "checksum": "if(k % 5 = 0, 'xyz', sha2(p_name, 256))",
        "embedding": "case when k % 10 = 0 then array(double('NaN'), 1.0D) when k % 5 = 0 then array(1.0D) else cast(array() as array<double>) end",
    }
    rows = part.selectExpr("k", "p_size", "p_name", *(f"{value} as {name}" for name, value in columns.items() if name != "right_subject_id"))
    rows = rows.withColumn("right_subject_id", F.expr(columns["right_subject_id"]))
    return reduce(DataFrame.unionByName, (checks.rule_violations(rows, checks.RULES[name], name) for name in _BROKEN))
