"""File facts, text and path functions, ratios and package trees over the documents and pages tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import numbers, paths, text
from siltstone.operators import analyze, checks, extract, packages
from siltstone.operators.parse import IMPORT, successful
from siltstone.plans.checked import query, table

# Documents as files: source/lang/name, with a shared __init__.py for every 25th document.
PATH = (
    "concat(source, '/', lang, '/', case when doc_id % 25 = 0 then '__init__.py' "
    "else concat('doc_', doc_id, case lang when 'en' then '.py' when 'de' then '.rs' when 'fr' then '.go' else '.ts' end) end)"
)
LANGUAGE = (
    "case when doc_id % 25 = 0 or lang = 'en' then 'python' when lang = 'de' then 'rust' "
    "when lang = 'fr' then 'go' else 'typescript' end"
)
_BREAKS = r"[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
LINES = (
    rf"(len(regexp_extract_all(text, '\r\n|{_BREAKS}')) "
    rf"+ case when text <> '' and not regexp_matches(text, '{_BREAKS}\z') then 1 else 0 end)"
)


def document_files(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(*columns, f"{PATH} as relative_path")


def document_units(spark: SparkSession, folder: str) -> DataFrame:
    return document_files(spark, folder).select(
        "relative_path",
        paths.package_path("relative_path").alias("package_path"),
        paths.is_package_root("relative_path").alias("is_package_root"),
    )


@query(
    "file_metadata",
    f"""select doc_id, {PATH} as relative_path, {LANGUAGE} as language,
    octet_length(encode(text))::bigint as size_bytes, {LINES}::bigint as line_count, sha256(text) as content_hash
    from documents""",
)
def file_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return document_files(spark, folder, "doc_id", "text").select(
        "doc_id",
        "relative_path",
        paths.language_of("relative_path").alias("language"),
        text.size_bytes("text").alias("size_bytes"),
        text.line_count("text").cast("bigint").alias("line_count"),
        text.content_hash("text").alias("content_hash"),
    )


@query(
    "file_lines",
    f"""select doc_id, {LINES}::bigint as line_count,
    sum(len(line))::bigint as characters from (
      select doc_id, text, unnest(regexp_split_to_array(text, '\\r\\n|{_BREAKS}')) as line from documents
    ) group by doc_id, text""",
)
def file_lines(spark: SparkSession, folder: str) -> DataFrame:
    split = table(spark, folder, "documents").select("doc_id", text.lines("text").alias("parts"))
    return split.selectExpr(
        "doc_id",
        "cast(size(parts) as bigint) as line_count",
        "cast(aggregate(parts, 0, (n, p) -> n + length(p)) as bigint) as characters",
    )


@query(
    "line_numbers",
    """select doc_id, (len(left(text, len(text) // 2)) - len(replace(left(text, len(text) // 2), chr(10), '')) + 1)::bigint
    as line_number from documents""",
)
def line_numbers(spark: SparkSession, folder: str) -> DataFrame:
    middle = F.floor(F.length("text") / 2)
    return table(spark, folder, "documents").select(
        "doc_id", text.line_number_at("text", middle).cast("bigint").alias("line_number")
    )


@query(
    "language_dispatch",
    f"select doc_id, {LANGUAGE} as language, lang in ('en') or doc_id % 25 = 0 as is_python from documents",
)
def language_dispatch(spark: SparkSession, folder: str) -> DataFrame:
    files = document_files(spark, folder, "doc_id").selectExpr(
        "doc_id", "if(doc_id % 2 = 0, upper(relative_path), relative_path) as relative_path"
    )
    return files.select(
        "doc_id",
        paths.language_of("relative_path").alias("language"),
        paths.has_extension("relative_path", paths.LANGUAGE_SUFFIXES["python"]).alias("is_python"),
    )


@query(
    "parse_success_filter",
    "select d.doc_id, d.n_chars from documents d join labels l on l.doc_id = d.doc_id where l.quality = 1",
)
def parse_success_filter(spark: SparkSession, folder: str) -> DataFrame:
    outcome = table(spark, folder, "labels").selectExpr("doc_id", "quality = 1 as succeeded")
    results = table(spark, folder, "documents").select("doc_id", "n_chars").join(outcome, "doc_id", "left")
    return successful(results).select("doc_id", "n_chars")


@query(
    "page_import_edges",
    """select page_id, url as relative_path, i::bigint as position, refs[i + 1] as target_module,
    starts_with(refs[i + 1], '/') as is_internal from (
      select page_id, url, refs, unnest(range(len(refs))) as i
      from (select page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) as refs from pages))""",
)
def page_import_edges(spark: SparkSession, folder: str) -> DataFrame:
    links = (
        "transform(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), r -> named_struct('module', r, "
        "'imported_names', cast(array() as array<string>), 'alias', cast(null as string), "
        f"'is_relative', startswith(r, '/'), 'line_number', 0))"
    )
    pages = table(spark, folder, "pages").selectExpr(
        "page_id", "url as relative_path", "true as succeeded", f"cast({links} as array<{IMPORT}>) as imports"
    )
    return extract.import_edges(pages).selectExpr(
        "page_id", "relative_path", "cast(position as bigint) as position", "target_module", "is_internal"
    )


@query(
    "comment_mask",
    r"""select page_id, array_to_string(list_transform(
      regexp_extract_all(html, '(?s)/\*.*?(?:\*/|\z)|//[^\n]*|[^/]+|/'),
      lambda p: case when starts_with(p, '/*') or starts_with(p, '//') then regexp_replace(p, '[^\n]', ' ', 'g') else p end
    ), '') as masked from pages""",
)
def comment_mask(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").selectExpr("page_id", f"{text.mask_comments_sql('html')} as masked")


@query(
    "bracket_functions",
    """select p_partkey,
    'a' || p_partkey || '|b(c, ' || p_size || ')|[d, e]|' || p_brand as segments,
    (2 + len(p_name) + 3 + 2 + len(p_brand))::bigint as closing,
    p_size % 2 = 0 as top_level,
    'size ' || p_size || chr(10) || ' brand ' || p_brand as comment
    from part""",
)
def bracket_functions(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").selectExpr(
        "p_partkey",
        "concat(' a', p_partkey, ' , b(c, ', p_size, '),, [d, e], ', p_brand) as listed",
        "concat('f(', p_name, '(x), ', p_brand, ') tail (') as call",
        "concat('{ x } { ', if(p_size % 2 = 0, '}', ''), ' here') as braces",
        "array('code', concat('  /// size ', p_size), concat('///  brand ', p_brand), 'fn f()') as source_lines",
    )
    return part.selectExpr(
        "p_partkey",
        f"array_join({text.split_top_level_sql('listed')}, '|') as segments",
        f"cast({text.find_matching_sql('call', '1', '(', ')')} as bigint) as closing",
        text.is_top_level_of_span_sql("braces", "0", "length(braces)") + " as top_level",
        text.leading_comment_lines_sql("source_lines", "4", "///") + " as comment",
    )


@query(
    "path_functions",
    """select doc_id, source || '/' || lang || '/x.py' as normal, case when doc_id % 2 = 0 then null else lang end as climbed,
    source || '/' || lang as directory, 'm' || doc_id || '/' || lang as module_path,
    source || '/' || lang || '::C.m' || doc_id as qualified from documents""",
)
def path_functions(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    messy = F.expr("concat('./', source, '//', lang, '\\\\y/../x.py/')")
    climbing = F.expr("concat(if(doc_id % 2 = 0, '../', ''), source, '/../', lang)")
    return documents.select(
        "doc_id",
        paths.normalize(messy).alias("normal"),
        paths.normalize(climbing).alias("climbed"),
        paths.directory_of(F.expr("concat(source, '/', lang, '/x.py')")).alias("directory"),
        paths.python_module_path(F.expr("concat('m', doc_id, '.', lang)")).alias("module_path"),
        paths.qualified_name(F.expr("concat(source, '/', lang)"), F.expr("concat('m', doc_id)"), F.lit("C")).alias("qualified"),
    )


_TEST_PATH = (
    "case doc_id % 5 when 0 then concat(source, '/tests/', lang, '/a.py') when 1 then concat(source, '/test_', lang, '.py') "
    "when 2 then concat(source, '/', lang, '_test.spec.ts') when 3 then concat(source, '/contest/', lang, '.py') else 'tests.py' end"
)


@query("test_file_flag", f"select doc_id, {_TEST_PATH} as relative_path, doc_id % 5 in (0, 1, 2) as is_test_file from documents")
def test_file_flag(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "documents").selectExpr("doc_id", f"{_TEST_PATH} as relative_path")
    return files.select("doc_id", "relative_path", paths.is_test_file("relative_path").alias("is_test_file"))


@query(
    "dependency_profile",
    """select l_orderkey, count(*)::bigint as total_dependency_count,
    count(*) filter (l_returnflag = 'N')::bigint as internal_dependency_count,
    count(*) filter (l_returnflag <> 'N')::bigint as external_dependency_count,
    count(distinct l_suppkey) filter (l_returnflag <> 'N')::bigint as external_target_count
    from lineitem group by l_orderkey""",
)
def dependency_profile(spark: SparkSession, folder: str) -> DataFrame:
    return analyze.dependency_profile(_order_edges(spark, folder), "l_orderkey")


def _order_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as import edges of an order; returned or accepted ones are external."""
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_returnflag = 'N' as is_internal", "concat('s', l_suppkey) as target_module"
    )


@query(
    "dependency_targets",
    "select distinct l_orderkey, 's' || l_suppkey as target_module from lineitem where l_returnflag <> 'N'",
)
def dependency_targets(spark: SparkSession, folder: str) -> DataFrame:
    return analyze.external_targets(_order_edges(spark, folder), "l_orderkey")


@query(
    "doc_coverage",
    """select source, lang, count(*)::bigint as total, count(*) filter (quality = 1)::bigint as documented,
    round(count(*) filter (quality = 1) / count(*), 6) as coverage, round(count(*) filter (toxic = 1) / count(*), 6) as toxic_share
    from documents left join labels using (doc_id) group by source, lang""",
)
def doc_coverage(spark: SparkSession, folder: str) -> DataFrame:
    joined = table(spark, folder, "documents").select("doc_id", "source", "lang").join(
        table(spark, folder, "labels"), "doc_id", "left"
    )
    counts = joined.groupBy("source", "lang").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("quality") == 1).alias("documented"),
        F.count_if(F.col("toxic") == 1).alias("toxic"),
    )
    return counts.select(
        "source",
        "lang",
        "total",
        "documented",
        F.round(numbers.coverage_ratio(F.col("documented"), F.col("total")), 6).alias("coverage"),
        F.round(numbers.safe_ratio(F.col("toxic"), F.col("total")), 6).alias("toxic_share"),
    )


@query(
    "text_density",
    f"""with c as (select doc_id, {LINES} as n, len(text) - len(replace(text, '.', '')) as a,
      len(text) - len(replace(text, ',', '')) as b, len(text) - len(replace(text, '-', '')) as d from documents)
    select doc_id, n::bigint as line_count, round(case when n = 0 then 0 else a / n * 1000 end, 6) as classes_per_kloc,
    round(case when n = 0 then 0 else b / n * 1000 end, 6) as functions_per_kloc,
    round(case when n = 0 then 0 else d / n * 1000 end, 6) as methods_per_kloc,
    round(case when n = 0 then 0 else (a + b + d) / n * 1000 end, 6) as symbols_per_kloc from c""",
)
def text_density(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "documents").select(
        "doc_id",
        text.line_count("text").cast("bigint").alias("line_count"),
        F.regexp_count("text", F.lit("\\.")).alias("class_count"),
        F.regexp_count("text", F.lit(",")).alias("function_count"),
        F.regexp_count("text", F.lit("-")).alias("method_count"),
        F.regexp_count("text", F.lit("[.,-]")).alias("symbol_count"),
    )
    return _rounded(analyze.density(counts))


def _rounded(frame: DataFrame) -> DataFrame:
    """Doubles to six places and integers as bigint, the form results are compared in."""

    def shown(name: str, kind: str) -> Column:
        column = F.col(name)
        return F.round(column, 6).alias(name) if kind == "double" else column.cast("bigint").alias(name) if kind == "int" else column

    return frame.select(*[shown(name, kind) for name, kind in frame.dtypes])


@query(
    "safe_ratio",
    """select c_custkey, count(o_orderkey)::bigint as orders, count(*) filter (o_orderstatus = 'F')::bigint as finished,
    round(case when count(o_orderkey) = 0 then 0 else count(*) filter (o_orderstatus = 'F') / count(o_orderkey) end, 6) as share
    from customer left join orders on o_custkey = c_custkey group by c_custkey""",
)
def safe_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Orders are summed per customer before the join, so a customer with most orders costs one row."""
    per_customer = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f")
    )
    joined = table(spark, folder, "customer").select("c_custkey").join(
        per_customer, F.col("c_custkey") == F.col("o_custkey"), "left"
    )
    orders, finished = F.coalesce("n", F.lit(0)), F.coalesce("f", F.lit(0))
    return joined.select(
        "c_custkey",
        orders.alias("orders"),
        finished.alias("finished"),
        F.round(numbers.safe_ratio(finished, orders), 6).alias("share"),
    )


_TREE = f"""with f as (select distinct {PATH} as p from documents),
    s as (select p, string_split(p, '/')[1:len(string_split(p, '/')) - 1] as pk,
      p like '%/\\_\\_init\\_\\_.py' escape '\\' as marked from f),
    a as (select unnest(range(len(pk) + 1)) as i, pk from s),
    n as (select distinct pk[1:i] as pk from a)"""


@query(
    "package_nodes",
    f"""{_TREE} select array_to_string(n.pk, '/') as node_id, len(n.pk)::bigint as depth, count(s.p)::bigint as file_count,
    coalesce(bool_or(s.marked), false) as has_package_root_file from n left join s on s.pk = n.pk group by n.pk""",
)
def package_nodes(spark: SparkSession, folder: str) -> DataFrame:
    nodes = packages.package_nodes(document_units(spark, folder))
    return nodes.selectExpr(
        "node_id", "cast(depth as bigint) as depth", "cast(file_count as bigint) as file_count", "has_package_root_file"
    )


@query(
    "package_edges",
    f"""{_TREE} select array_to_string(pk[1:len(pk) - 1], '/') as parent_id, array_to_string(pk, '/') as child_id
    from n where len(pk) > 0""",
)
def package_edges(spark: SparkSession, folder: str) -> DataFrame:
    nodes = packages.package_nodes(document_units(spark, folder))
    return packages.package_edges(nodes).select("parent_id", "child_id")


@query("package_files", f"{_TREE} select array_to_string(pk, '/') as node_id, p as relative_path from s")
def package_files(spark: SparkSession, folder: str) -> DataFrame:
    files = packages.package_files(document_units(spark, folder))
    return files.select(F.array_join("package_path", "/").alias("node_id"), "relative_path")


@query(
    "direct_children",
    f"""{_TREE} select array_to_string(pk, '/') as node_id, len(pk)::bigint as depth from n
    where len(pk) = 2 and pk[1] = 'src3'""",
)
def direct_children(spark: SparkSession, folder: str) -> DataFrame:
    nodes = packages.package_nodes(document_units(spark, folder))
    children = packages.direct_children(nodes, packages.package_edges(nodes), "src3")
    return children.selectExpr("node_id", "cast(depth as bigint) as depth")


@query(
    "package_documents",
    f"""{_TREE} select '{{"parent_id":"' || array_to_string(pk[1:len(pk) - 1], '/') || '","child_id":"' || array_to_string(pk, '/')
    || '","parent_path":[' || array_to_string(list_transform(pk[1:len(pk) - 1], lambda x: '"' || x || '"'), ',')
    || '],"child_path":[' || array_to_string(list_transform(pk, lambda x: '"' || x || '"'), ',') || ']}}' as document
    from n where len(pk) > 0""",
)
def package_documents(spark: SparkSession, folder: str) -> DataFrame:
    nodes = packages.package_nodes(document_units(spark, folder))
    return packages.edge_documents(packages.package_edges(nodes))


@query(
    "constraint_violations",
    """select 'source_files' as relation, unnest(['relative_path filled', 'size not negative']) as rule,
    unnest([count(*) filter (doc_id % 7 = 0), count(*) filter (n_chars < 500)])::bigint as violations from documents
    union all
    select 'source_files', 'unique id', count(*)::bigint from (select lang, source from documents group by all having count(*) > 1)
    union all
    select 'documentation_coverage', unnest(['counts not negative', 'documented counts not negative',
      'documented classes within classes', 'documented functions within functions', 'class_documentation_ratio in 0..1',
      'function_documentation_ratio in 0..1', 'overall_documentation_ratio in 0..1']),
    unnest([0, 0, count(*) filter (l_quantity > l_linenumber * 10), 0, count(*) filter (l_discount > 0.05) * 0,
      count(*) filter (l_extendedprice > 50000), 0])::bigint from lineitem""",
)
def constraint_violations(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "documents").selectExpr(
        "concat(source, lang) as id", "if(doc_id % 7 = 0, ' \\t', text) as relative_path", "n_chars - 500 as size_bytes"
    )
    coverage = table(spark, folder, "lineitem").selectExpr(
        "l_linenumber * 10 as class_count",
        "l_quantity as documented_class_count",
        "1 as function_count",
        "1 as documented_function_count",
        "l_discount as class_documentation_ratio",
        "l_extendedprice / 50000 as function_documentation_ratio",
        "l_tax as overall_documentation_ratio",
    )
    return checks.violations(files, "source_files").unionByName(checks.violations(coverage, "documentation_coverage"))
