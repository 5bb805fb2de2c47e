"""Import, call and knowledge graphs over the star-schema tables in the roles of files, symbols and edges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import calls, dependencies, knowledge
from siltstone.operators.import_index import ImportIndex
from siltstone.plans.checked import query, table
from siltstone.session import checkpoint_folder

# Parts as Python modules: a package, a module, or no file at all.
_PART_FILE = (
    "case p_partkey % 3 when 0 then concat('p', p_partkey, '/__init__.py') when 1 then concat('p', p_partkey, '.py') end"
)


def _python_files(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").selectExpr(f"{_PART_FILE} as relative_path").where("relative_path is not null")
    sources = table(spark, folder, "orders").selectExpr("concat('pkg/o', o_orderkey, '.py') as relative_path")
    return parts.unionByName(sources)


def _python_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as imports of parts, in four forms by line number."""
    module = "concat('p', l_partkey)"
    return table(spark, folder, "lineitem").selectExpr(
        "concat('pkg/o', l_orderkey, '.py') as relative_path",
        f"case l_linenumber % 4 when 0 then concat('..', {module}) when 1 then {module} "
        f"when 2 then concat('.', {module}) else '..' end as target_module",
        f"if(l_linenumber % 4 = 3, array({module}), cast(array() as array<string>)) as imported_names",
        "if(l_linenumber % 4 = 3, concat('a', l_suppkey), null) as alias",
        "l_linenumber % 4 <> 1 as is_internal",
        "l_linenumber as line_number",
    )


_RESOLVED = """with e as (select 'pkg/o' || l_orderkey || '.py' as source, l_partkey as k, l_linenumber as n, l_suppkey as s,
      case when l_partkey % 3 = 2 or l_partkey not in (select p_partkey from part) then null
      when l_partkey % 3 = 0 then 'p' || l_partkey || '/__init__.py' else 'p' || l_partkey || '.py' end as hit from lineitem),
    r as (select source, n as line_number, case when n % 4 = 3 then 'p' || k else '' end as imported_names,
      case when n % 4 = 3 then 'a' || s end as alias,
      case when n % 4 = 2 then 'unresolved:pkg/p' || k
      when hit is not null then hit when n % 4 = 1 then 'external:p' || k else 'unresolved:p' || k end as target,
      case when n % 4 = 2 then 'unresolved_internal' when hit is not null then 'internal_file'
      when n % 4 = 1 then 'external_module' else 'unresolved_internal' end as target_kind from e)"""


@query(
    "import_resolution",
    f"""{_RESOLVED} select source, target, target_kind, target_kind <> 'external_module' as is_internal, imported_names, alias,
    line_number::bigint as line_number from r""",
)
def import_resolution(spark: SparkSession, folder: str) -> DataFrame:
    resolved = dependencies.resolve_imports(_python_edges(spark, folder), _python_files(spark, folder))
    return resolved.withColumns(
        {"imported_names": F.array_join("imported_names", ","), "line_number": F.col("line_number").cast("bigint")}
    )


@query(
    "import_graph_nodes",
    f"""{_RESOLVED} select 'pkg/o' || o_orderkey || '.py' as identifier, 'internal_file' as kind from orders
    union all select case p_partkey % 3 when 0 then 'p' || p_partkey || '/__init__.py' else 'p' || p_partkey || '.py' end, 'internal_file'
    from part where p_partkey % 3 <> 2
    union all select distinct target, target_kind from r where target_kind <> 'internal_file'""",
)
def import_graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes, _ = dependencies.build_graph(_python_edges(spark, folder), _python_files(spark, folder))
    return nodes


@query(
    "graph_outgoing",
    f"{_RESOLVED} select source, target, line_number::bigint as line_number from r where source = 'pkg/o100.py'",
)
def graph_outgoing(spark: SparkSession, folder: str) -> DataFrame:
    edges = dependencies.resolve_outgoing(_python_edges(spark, folder), _python_files(spark, folder), "pkg/o100.py")
    return edges.select("source", "target", F.col("line_number").cast("bigint").alias("line_number"))


@query(
    "import_index",
    f"""{_RESOLVED} select source, target, target_kind, target_kind <> 'external_module' as is_internal, imported_names, alias,
    line_number from r""",
)
def import_index(spark: SparkSession, folder: str) -> DataFrame:
    """Files and edges go into a stored index before any package file is known; the packages come as a change."""
    files, edges = _python_files(spark, folder), _python_edges(spark, folder)
    package = F.endswith("relative_path", F.lit("__init__.py"))
    index = ImportIndex(spark, f"{checkpoint_folder(spark)}/import-index-{uuid.uuid4().hex}", buckets=8)
    index.apply(files.where(~package), edges)
    index.apply(files.where(package), edges.limit(0))
    return index.edges().withColumn("imported_names", F.array_join("imported_names", ","))


@query(
    "import_rules",
    """with o as (select o_orderkey as k, o_custkey as c, o_orderkey % 6 as r from orders)
    select case when r = 4 then 'web/o' || k || '.ts' else 'a/b/o' || k || '.py' end as source,
    case r when 0 then 'unresolved:a/b/o' || k || '.py#mod' || c
      when 1 then 'unresolved:a/b/o' || k || '.py#....m' || c
      when 2 then 'unresolved:a/b/o' || k || '.py#.a..b' || c
      when 3 then 'a/__init__.py' when 4 then 'unresolved:/abs' || c else 'a/b/__init__.pyi' end as target,
    case when r in (3, 5) then 'internal_file' else 'unresolved_internal' end as target_kind from o""",
)
def import_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Imports said to be internal that name no module: no leading dot, above the root, a malformed rest, a rooted
    specifier; and dots with a name that only the package itself can answer."""
    orders = table(spark, folder, "orders")
    edges = orders.selectExpr(
        "if(o_orderkey % 6 = 4, concat('web/o', o_orderkey, '.ts'), concat('a/b/o', o_orderkey, '.py')) as relative_path",
        "case o_orderkey % 6 when 0 then concat('mod', o_custkey) when 1 then concat('....m', o_custkey) "
        "when 2 then concat('.a..b', o_custkey) when 3 then '..' when 4 then concat('/abs', o_custkey) else '.' end as target_module",
        "if(o_orderkey % 6 in (3, 5), array(concat('x', o_custkey)), cast(array() as array<string>)) as imported_names",
        "cast(null as string) as alias",
        "true as is_internal",
        "1 as line_number",
    )
    files = edges.select("relative_path").unionByName(
        spark.createDataFrame([("a/__init__.py",), ("a/b/__init__.pyi",)], "relative_path string")
    )
    return dependencies.resolve_imports(edges, files).select("source", "target", "target_kind")


@query(
    "graph_edge_documents",
    f"""{_RESOLVED} select '{{"source":"' || source || '","target":"' || target || '","is_internal":'
    || case when target_kind <> 'external_module' then 'true' else 'false' end
    || ',"imported_names":[' || case when imported_names = '' then '' else '"' || imported_names || '"' end || '],"alias":'
    || coalesce('"' || alias || '"', 'null') || ',"line_number":' || line_number || '}}' as document from r""",
)
def graph_edge_documents(spark: SparkSession, folder: str) -> DataFrame:
    return dependencies.edge_documents(
        dependencies.resolve_imports(_python_edges(spark, folder), _python_files(spark, folder))
    )


@query(
    "script_import_resolution",
    """with f as (select c_custkey as k, case c_custkey % 3 when 0 then 'src/c' || c_custkey || '.ts'
      when 1 then 'src/c' || c_custkey || '/index.tsx' end as path from customer),
    e as (select o_orderkey as k, o_custkey as c, path from orders left join f on f.k = o_custkey)
    select 'src/w/o' || k || '.ts' as source,
    case when k % 4 < 2 then coalesce(path, 'unresolved:src/c' || c)
    when k % 4 = 2 then 'unresolved:src/w/o' || k || '.ts#../../../x' || c else 'external:vue' || c end as target,
    k % 4 <> 3 as is_internal from e""",
)
def script_import_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as TypeScript files importing customers by relative specifiers."""
    modules = table(spark, folder, "customer").selectExpr(
        "case c_custkey % 3 when 0 then concat('src/c', c_custkey, '.ts') "
        "when 1 then concat('src/c', c_custkey, '/index.tsx') end as relative_path"
    )
    orders = table(spark, folder, "orders")
    source = "concat('src/w/o', o_orderkey, '.ts') as relative_path"
    edges = orders.selectExpr(
        source,
        "case o_orderkey % 4 when 0 then concat('./../c', o_custkey) when 1 then concat('../../src/./c', o_custkey) "
        "when 2 then concat('../../../x', o_custkey) else concat('vue', o_custkey) end as target_module",
        "cast(array() as array<string>) as imported_names",
        "cast(null as string) as alias",
        "o_orderkey % 4 <> 3 as is_internal",
        "1 as line_number",
    )
    files = modules.where("relative_path is not null").unionByName(orders.selectExpr(source))
    return dependencies.resolve_imports(edges, files).select("source", "target", "is_internal")


@query(
    "mixed_import_resolution",
    """select 'd/s' || s_suppkey || case s_suppkey % 5 when 0 then '.go' when 1 then '.rs' when 2 then '.cpp' when 3 then '.hpp' else '.txt' end as source,
    case s_suppkey % 5 when 0 then 'unresolved:d/sub' || s_suppkey when 1 then 'unresolved:d/s' || s_suppkey || '.rs#crate::m' || s_suppkey
    when 2 then case when s_suppkey + 1 in (select s_suppkey from supplier) then 'd/s' || (s_suppkey + 1) || '.hpp' else 'unresolved:d/s' || (s_suppkey + 1) || '.hpp' end
    when 3 then 'unresolved:d/s' || s_suppkey || '.hpp#C:\\x.h' else 'unresolved:d/s' || s_suppkey || '.txt#y' end as target from supplier
    union all select 'd/s' || s_suppkey || case s_suppkey % 5 when 0 then '.go' when 1 then '.rs' when 2 then '.cpp' when 3 then '.hpp' else '.txt' end,
    'external:lib' || s_nationkey from supplier""",
)
def mixed_import_resolution(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as Go, Rust, C++ and unknown files, each with an internal and an external import."""
    suffix = "case s_suppkey % 5 when 0 then '.go' when 1 then '.rs' when 2 then '.cpp' when 3 then '.hpp' else '.txt' end"
    supplier = table(spark, folder, "supplier")
    rest = ["cast(array() as array<string>) as imported_names", "cast(null as string) as alias"]
    path = f"concat('d/s', s_suppkey, {suffix}) as relative_path"
    internal = supplier.selectExpr(
        path,
        "case s_suppkey % 5 when 0 then concat('./sub', s_suppkey) when 1 then concat('crate::m', s_suppkey) "
        "when 2 then concat('../d/s', s_suppkey + 1, '.hpp') when 3 then 'C:\\\\x.h' else 'y' end as target_module",
        *rest,
        "true as is_internal",
        "1 as line_number",
    )
    external = supplier.selectExpr(path, "concat('lib', s_nationkey) as target_module", *rest, "false as is_internal", "2 as line_number")
    return dependencies.resolve_imports(internal.unionByName(external), supplier.selectExpr(path)).select("source", "target")


_KIND = "case role when 'user' then 'function' when 'assistant' then 'method' else 'class' end"


def _turn_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").selectExpr(
        "concat('c', conv_id, '.py::t', turn) as qualified_name",
        "concat('t', turn) as name",
        f"{_KIND} as kind",
        "concat('c', conv_id, '.py') as relative_path",
        "cast(turn as int) as line_number",
    )


@query(
    "callable_nodes",
    f"""select 'c' || conv_id || '.py::t' || turn as qualified_name, min('t' || turn) as name, min({_KIND}) as kind,
    turn::bigint as line_number from conversations where role in ('user', 'assistant') group by conv_id, turn""",
)
def callable_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = calls.call_nodes(_turn_symbols(spark, folder))
    return nodes.select("qualified_name", "name", "kind", F.col("line_number").cast("bigint").alias("line_number"))


@query(
    "call_edges",
    """select 'c' || conv_id || '.py::t' || turn as caller, 'c' || conv_id || '.py::t' || (turn + 1) as callee,
    turn::bigint as line_number from conversations where (conv_id, turn) in
    (select (conv_id, turn) from conversations where role in ('user', 'assistant'))""",
)
def call_edges(spark: SparkSession, folder: str) -> DataFrame:
    edges = table(spark, folder, "conversations").selectExpr(
        "concat('c', conv_id, '.py::t', turn) as caller", "concat('c', conv_id, '.py::t', turn + 1) as callee", "turn as line_number"
    )
    kept = calls.call_edges(edges, calls.call_nodes(_turn_symbols(spark, folder)))
    return kept.select("caller", "callee", F.col("line_number").cast("bigint").alias("line_number"))


@query(
    "callees",
    """select 'c' || conv_id || '.py::t' || turn as caller, 'c' || conv_id || '.py::t' || (turn + 1) as callee
    from conversations where conv_id = 0 and turn = 0 and role in ('user', 'assistant')""",
)
def callees(spark: SparkSession, folder: str) -> DataFrame:
    return calls.callees_of(call_edges(spark, folder), "c0.py::t0").select("caller", "callee")


def _concepts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Customers as symbols, suppliers as interfaces, parts as candidates and patterns, nations as packages."""
    return {
        "symbols": table(spark, folder, "customer").selectExpr(
            "concat('n', c_nationkey, '/f.py') as relative_path",
            "concat('n', c_nationkey, '/f.py::', c_name) as qualified_name",
            "c_name as name",
            "'class' as kind",
        ),
        "interfaces": table(spark, folder, "supplier").selectExpr(
            "concat('n', s_nationkey, '/f.py') as relative_path",
            "s_name as name",
            "array('m') as method_signatures",
            "array(concat('Base', s_suppkey % 7)) as base_interfaces",
        ),
        "candidates": table(spark, folder, "part").selectExpr(
            "concat('n', p_partkey % 25, '/f.py') as relative_path", "concat('p', p_partkey) as name", "'function' as kind"
        ),
        "patterns": table(spark, folder, "part").selectExpr(
            "concat('n', p_partkey % 25, '/f.py') as relative_path",
            "concat('p', p_partkey) as subject_name",
            "p_type as name",
            "array(p_brand) as evidence",
        ),
        "packages": table(spark, folder, "nation").selectExpr(
            "concat('n', n_nationkey) as node_id", "array(concat('n', n_nationkey)) as package_path"
        ),
    }


@query(
    "knowledge_nodes",
    """select 'symbol:n' || c_nationkey || '/f.py::' || c_name as identifier, 'symbol' as kind, c_name as label,
      'n' || c_nationkey || '/f.py' as relative_path, 'class' as attributes from customer
    union all select 'interface:n' || s_nationkey || '/f.py::' || s_name, 'interface', s_name, 'n' || s_nationkey || '/f.py', 'm' from supplier
    union all select 'capability:n' || p_partkey % 25 || '/f.py::p' || p_partkey, 'capability', 'p' || p_partkey, 'n' || p_partkey % 25 || '/f.py', 'function' from part
    union all select 'pattern:n' || p_partkey % 25 || '/f.py::p' || p_partkey || '.' || p_type, 'pattern', p_type, 'n' || p_partkey % 25 || '/f.py', p_brand from part
    union all select 'package:n' || n_nationkey, 'package', 'n' || n_nationkey, null, '' from nation
    union all select distinct 'entity:n' || k || '/f.py', 'entity', 'n' || k || '/f.py', 'n' || k || '/f.py', '' from
      (select c_nationkey as k from customer union select s_nationkey from supplier union select p_partkey % 25 from part)""",
)
def knowledge_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = knowledge.knowledge_nodes(**_concepts(spark, folder))
    return nodes.withColumn("attributes", F.array_join("attributes", ","))


@query(
    "knowledge_relations",
    """select 'entity:n' || c_nationkey || '/f.py' as source, 'symbol:n' || c_nationkey || '/f.py::' || c_name as target, 'declares' as kind from customer
    union all select 'entity:n' || s_nationkey || '/f.py', 'interface:n' || s_nationkey || '/f.py::' || s_name, 'declares' from supplier
    union all select 'entity:n' || p_partkey % 25 || '/f.py', 'capability:n' || p_partkey % 25 || '/f.py::p' || p_partkey, 'declares' from part
    union all select 'entity:n' || p_partkey % 25 || '/f.py', 'pattern:n' || p_partkey % 25 || '/f.py::p' || p_partkey || '.' || p_type, 'declares' from part
    union all select 'interface:n' || s_nationkey || '/f.py::' || s_name, 'interface:Base' || s_suppkey % 7, 'extends' from supplier
    union all select distinct 'entity:n' || k || '/f.py', 'package:n' || k, 'belongs_to_package' from
      (select c_nationkey as k from customer union select s_nationkey from supplier union select p_partkey % 25 from part)""",
)
def knowledge_relations(spark: SparkSession, folder: str) -> DataFrame:
    return knowledge.knowledge_relations(**_concepts(spark, folder))


@query(
    "knowledge_relations_from",
    "select 'interface:n' || s_nationkey || '/f.py::' || s_name as source, 'interface:Base' || s_suppkey % 7 as target from supplier where s_suppkey = 4",
)
def knowledge_relations_from(spark: SparkSession, folder: str) -> DataFrame:
    supplier = table(spark, folder, "supplier").where("s_suppkey = 4").first()
    identifier = f"interface:n{supplier.s_nationkey}/f.py::{supplier.s_name}"
    return knowledge.relations_from(knowledge_relations(spark, folder), identifier).select("source", "target")
