"""Parse, extraction and analysis of source texts that Spark writes from the part table.

Each part becomes one file per language, with names, flags and broken texts that depend on its columns. The
check SQL states the expected facts from the same columns, so it never parses anything.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators import analyze, extract
from siltstone.operators.parse import parse_files
from siltstone.plans.checked import query, table
from siltstone.plans.checked.files import _rounded, document_files
from siltstone.session import spread_rows

# What a marker like @k@ stands for, as SQL that Spark and DuckDB both read.
MARKERS = {
    "k": "p_partkey",
    "s": "p_size",
    "b": "replace(p_brand, '#', '')",
    "n": "replace(p_name, ' ', '_')",
    "t": "replace(p_type, ' ', '_')",
    "a": "case when p_size % 2 = 0 then 'async ' else '' end",
    "e": "case when p_size % 2 = 0 then 'true' else 'false' end",
    "d": "case when p_size % 5 = 0 then 'pass' else '\"\"\"About.\"\"\"' end",
    "q": "chr(39)",
}
BROKEN = "p_size % 3 = 0"

SOURCES = {
    "python": """import json as j@k@
from ..@n@ import A, B as C@s@
from . import @t@
__all__ = ["TestK@k@", "run", 1]
@dataclass(frozen=True)
class TestK@k@(Base@s@, Protocol):
    @d@
    async def m(self, x: int = @s@, /, *args, k=None, **kw) -> "str":
        import os.path
        return x
    def test_plain(self): pass
@a@def run(a, *, b: @t@=1):
    "doc"
    class Inner: pass
def _hidden(): pass""",
    "rust": """use a@k@::{b, c as d, self};
pub use crate::x::Y@s@;
use super::h::*;
/* struct Hidden { } */ // fn hidden() {}
/// Doc of @b@
///  second
pub struct P@k@<T> { x: T }
struct Unit;
impl<T> Shape for P@k@<T> {
    pub fn area(&self, k: Vec<(u8, u8)>) -> f64 { 1.0 }
    @a@fn inner(&self) {}
}
impl Missing {
    fn lost() {}
}
pub trait Shape<T>: Base {
    fn area(&self) -> f64;
}
pub enum E@s@ { A }
type Alias = u8;
pub const MAX@k@: u8 = 1;
/// run doc
pub(crate) @a@fn run(x: u8) -> Result<(), E> {
}
mod inner_@t@;
pub enum E@s@ { B }""",
    "go": """package @n@
// import "hidden"
import (
  "fmt"
  z "p/q@k@"
  _ "side"
  "./local"
)
import . "dot@s@"
type T@k@ struct {
  a int
}
type I interface {
  M()
}
type Z = int
func (p *T@k@) Run(a int, b func(int) int) (int, error) {
  return 1, nil
}
func (x Other) Lost() {
}
func free@s@() {
}
func Pub(a, b string) error {
}
const (
  A@k@ = 1
  _ = 2
  b
)
var V = 1""",
    "typescript": """import D@k@, { A, B as C } from "./m@s@";
import * as N from "lib";
import "./side";
import type { T } from "/abs";
/**
 * Doc @b@
 */
export abstract class P@k@ extends Q.R implements S, U<V> {
  private readonly x = 1;
  @a@run(a: number, b: [x, y]): Promise<void> {
    if (a) { call(b); }
  }
  get val() { return 1; }
}
export interface I@s@ {}
export type Al = string;
export const enum En { X }
export @a@function go(a: string): void {}
export const arrow = @a@(x, y) => x;
const plain = (1);
let l@k@ = 2;
export var v = 3;
export { plain as p2, l@k@ };
export * as ns from "z";
export default @a@function named() {}
namespace Sp.@t@ {
}
function inner(q) {}""",
    "cpp": """#include "h@k@.h"
#include <map>
import mod.@n@;
namespace n@s@ {
/// Doc @b@
class P@k@ final : public A, private virtual B<C, D> {
 public:
  virtual int go(int a, std::pair<int,int> b) { call(a); }
  explicit P@k@();
  ~P@k@();
};
/// free doc
static int free_fn(int x) { other(x); }
}
void outer() {
  nested(1);
}
enum class En@s@ { A };
using Al = int;
typedef unsigned long ul;
export int shown(int y);
// int hidden(int z);""",
}
SUFFIX = {"python": ".py", "rust": ".rs", "go": ".go", "typescript": ".ts", "cpp": ".cpp"}

# Expected facts per language, in order. Imports: module|names|alias|relative|line. Classes:
# name|bases|decorators|doc|line. Functions: name|parameters|return|async|doc|line.
FACTS = {
    "python": {
        "metadata": ["python|15"],
        "import": [
            "json||j@k@|false|1",
            "..@n@|A|-|true|2",
            "..@n@|B|C@s@|true|2",
            ".|@t@|-|true|3",
            "os.path||-|false|9",
        ],
        "export": ["TestK@k@|4", "run|4"],
        "method": [
            "TestK@k@.m|self;x: int = @s@;*args;k = None;**kw|@q@str@q@|true|-|8",
            "TestK@k@.test_plain|self|-|false|-|11",
        ],
        "function": ["run|a;*;b: @t@ = 1|-|@e@|doc|12", "_hidden||-|false|-|15"],
        "symbol": [
            "class|TestK@k@|6",
            "method|m|8",
            "method|test_plain|11",
            "function|run|12",
            "function|_hidden|15",
        ],
    },
    "rust": {
        "metadata": ["rust|26"],
        "module": ["inner_@t@|25"],
        "import": [
            "a@k@|b|-|false|1",
            "a@k@|c|d|false|1",
            "a@k@|self|-|false|1",
            "crate::x|Y@s@|-|true|2",
            "super::h|*|-|true|3",
        ],
        "export": ["P@k@|7", "Shape|16", "E@s@|26", "MAX@k@|21", "run|23"],
        "class": ["P@k@|Shape||Doc of @b@/ second|7", "Unit|||-|8"],
        "method": ["P@k@.area|&self;k: Vec<(u8, u8)>|f64|false|-|10", "P@k@.inner|&self|-|@e@|-|11"],
        "function": ["run|x: u8|Result<(), E>|@e@|run doc|23"],
        "symbol": [
            "module|inner_@t@|25",
            "struct|P@k@|7",
            "struct|Unit|8",
            "trait|Shape|16",
            "enum|E@s@|26",
            "type_alias|Alias|20",
            "function|run|23",
            "method|area|10",
            "method|inner|11",
            "method|lost|14",
            "method|area|17",
            "constant|MAX@k@|21",
        ],
    },
    "go": {
        "metadata": ["go|31"],
        "module": ["@n@|1"],
        "import": [
            "fmt||-|false|4",
            "p/q@k@||z|false|5",
            "side||-|false|6",
            "./local||-|true|7",
            "dot@s@||-|false|9",
        ],
        "export": ["T@k@|10", "I|13", "Z|16", "A@k@|27", "V|31", "Pub|24"],
        "class": ["T@k@|||-|10"],
        "method": ["T@k@.Run|a int;b func(int) int|(int, error)|false|-|17"],
        "function": ["free@s@||-|false|-|22", "Pub|a;b string|error|false|-|24"],
        "symbol": [
            "module|@n@|1",
            "struct|T@k@|10",
            "interface|I|13",
            "type_alias|Z|16",
            "function|free@s@|22",
            "function|Pub|24",
            "method|Run|17",
            "method|Lost|20",
            "constant|A@k@|27",
            "constant|b|29",
            "variable|V|31",
        ],
    },
    "typescript": {
        "metadata": ["typescript|28"],
        "module": ["Sp.@t@|26"],
        "import": [
            "./m@s@||D@k@|true|1",
            "./m@s@|A|-|true|1",
            "./m@s@|B|C|true|1",
            "lib|*|N|false|2",
            "./side||-|true|3",
            "/abs|T|-|true|4",
        ],
        "export": [
            "P@k@|8",
            "go|18",
            "named|25",
            "arrow|19",
            "I@s@|15",
            "Al|16",
            "En|17",
            "enum|17",
            "v|22",
            "p2|23",
            "l@k@|23",
            "ns|24",
            "default|25",
        ],
        "class": ["P@k@|Q.R,S,U<V>||Doc @b@|8"],
        "method": ["P@k@.run|a: number;b: [x, y]|Promise<void>|@e@|-|10", "P@k@.val||-|false|-|13"],
        "function": [
            "go|a: string|void|@e@|-|18",
            "named||-|@e@|-|25",
            "inner|q|-|false|-|28",
            "arrow|x;y|-|@e@|-|19",
        ],
        "symbol": [
            "namespace|Sp.@t@|26",
            "class|P@k@|8",
            "method|run|10",
            "method|val|13",
            "function|go|18",
            "function|named|25",
            "function|inner|28",
            "function|arrow|19",
            "interface|I@s@|15",
            "type_alias|Al|16",
            "enum|En|17",
            "constant|enum|17",
            "constant|plain|20",
            "variable|l@k@|21",
            "variable|v|22",
        ],
    },
    "cpp": {
        "metadata": ["cpp|22"],
        "module": ["n@s@|4"],
        "import": ["h@k@.h||-|true|1", "map||-|false|2", "mod.@n@||-|false|3"],
        "export": ["shown|21"],
        "class": ["P@k@|A,B<C,D>||Doc @b@|6"],
        "method": [
            "P@k@.go|int a;std::pair<int;int> b|int|false|-|8",
            "P@k@.P@k@||-|false|-|9",
            "P@k@.~P@k@||-|false|-|10",
        ],
        "function": [
            "free_fn|int x|int|false|free doc|13",
            "outer||void|false|-|15",
            "shown|int y|export int|false|-|21",
        ],
        "symbol": [
            "namespace|n@s@|4",
            "class|P@k@|6",
            "method|go|8",
            "method|P@k@|9",
            "method|~P@k@|10",
            "function|free_fn|13",
            "function|outer|15",
            "function|shown|21",
            "enum|En@s@|18",
            "type_alias|Al|19",
            "type_alias|ul|20",
        ],
    },
}


def _filled(template: str) -> str:
    """SQL text with the markers of a template replaced by column expressions."""
    parts = []
    for at, part in enumerate(re.split(r"@(\w)@", template)):
        if at % 2:
            parts.append(MARKERS[part])
        else:
            parts += ["chr(10)" if line == "\n" else f"'{line}'" for line in re.split("(\n)", part) if line]
    return f"concat({', '.join(parts)})" if parts else "''"


def source_files(spark: SparkSession, folder: str, language: str, *columns: str) -> DataFrame:
    """One file per part; every third size of Python is broken."""
    content = _filled(SOURCES[language])
    if language == "python":
        content = f"concat({content}, if({BROKEN}, concat(chr(10), 'def broken(:'), ''))"
    directory = "concat(if(p_size % 4 = 0, 'tests/', 'lib/'), replace(p_brand, '#', ''))"
    # Dealing out the narrow part rows is cheap; the texts written from them are parsed where they land.
    return spread_rows(table(spark, folder, "part"), "p_partkey").selectExpr(
        "p_partkey as file_id",
        *columns,
        f"concat({directory}, '/f', p_partkey, '{SUFFIX[language]}') as relative_path",
        f"{content} as content",
    )


def fact_rows(parsed: DataFrame) -> DataFrame:
    """All parts of a parse as (fact, position, detail) rows."""
    function = (
        "array_join({r}.parameters, ';'), coalesce({r}.return_type, '-'), {r}.is_async, "
        "coalesce(replace({r}.docstring, chr(10), '/'), '-'), {r}.line_number"
    )
    details = {
        "metadata": ("array(metadata)", "x.language, x.line_count"),
        "module": ("modules", "x.name, x.line_number"),
        "import": ("imports", "x.module, array_join(x.imported_names, ','), coalesce(x.alias, '-'), x.is_relative, x.line_number"),
        "export": ("exports", "x.name, x.line_number"),
        "class": (
            "classes",
            "x.name, array_join(x.base_classes, ','), array_join(x.decorators, ','), "
            "coalesce(replace(x.docstring, chr(10), '/'), '-'), x.line_number",
        ),
        "method": (
            "flatten(transform(classes, c -> transform(c.methods, m -> named_struct('owner', c.name, 'm', m))))",
            "concat(x.owner, '.', x.m.name), " + function.format(r="x.m"),
        ),
        "function": ("functions", "x.name, " + function.format(r="x")),
        "symbol": ("symbols", "x.kind, x.name, x.line_number"),
    }
    arrays = [
        f"transform({rows}, (x, i) -> named_struct('fact', '{fact}', 'position', cast(i as bigint), "
        f"'detail', concat_ws('|', {shown})))"
        for fact, (rows, shown) in details.items()
    ]
    keys = [name for name in extract.identity_columns(parsed) if name != "content"]
    return parsed.where("succeeded").selectExpr(*keys, f"inline(concat({', '.join(arrays)}))")


def facts_sql(language: str, where: str = "true") -> str:
    facts = {name: list(rows) for name, rows in FACTS[language].items()}
    listed = ", ".join(
        f"{{'fact': '{fact}', 'position': {at}::bigint, 'detail': {_filled(detail)}}}"
        for fact, details in facts.items()
        for at, detail in enumerate(details)
    )
    extra = ""
    if language == "python":
        head = _filled("TestK@k@|Base@s@,Protocol|dataclass(frozen=True)|")
        doc = "case when p_size % 5 = 0 then '-' else 'About.' end"
        extra = f", {{'fact': 'class', 'position': 0::bigint, 'detail': concat({head}, {doc}, '|6')}}"
    return (
        "select file_id, f.fact as fact, f.position as position, f.detail as detail from "
        f"(select p_partkey as file_id, unnest([{listed}{extra}]) as f from part where {where})"
    )


def _register(language: str) -> None:
    where = f"not ({BROKEN})" if language == "python" else "true"

    @query(f"{language}_parse", facts_sql(language, where))
    def parse(spark: SparkSession, folder: str) -> DataFrame:
        return fact_rows(parse_files(source_files(spark, folder, language)))


for _language in SOURCES:
    _register(_language)

_GOOD = f"from part where not ({BROKEN})"
_PATH_SQL = "case when p_size % 4 = 0 then 'tests/' else 'lib/' end || replace(p_brand, '#', '') || '/f' || p_partkey || '.py'"
_DOC = "case when p_size % 5 = 0 then 0 else 1 end"
_ASYNC = "case when p_size % 2 = 0 then 1 else 0 end"


def _python(spark: SparkSession, folder: str) -> DataFrame:
    return parse_files(source_files(spark, folder, "python"))


@query(
    "parse_outcomes",
    f"""select p_partkey as file_id, not ({BROKEN}) as succeeded,
    case when {BROKEN} then 'syntax error: invalid syntax (f' || p_partkey || '.py, line 16)' end as error_message,
    case when not ({BROKEN}) then 15 end::bigint as line_count from part""",
)
def parse_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return _python(spark, folder).selectExpr(
        "file_id", "succeeded", "error_message", "cast(metadata.line_count as bigint) as line_count"
    )


@query(
    "ast_counts",
    f"""select p_partkey as file_id, {_PATH_SQL} as relative_path, 1::bigint as class_count, 2::bigint as function_count,
    2::bigint as method_count, 5::bigint as import_count, 2::bigint as export_count, 5::bigint as symbol_count, 0::bigint as module_count,
    (1 + {_ASYNC})::bigint as async_function_count, ({_DOC})::bigint as documented_class_count,
    1::bigint as documented_function_count, 15::bigint as line_count {_GOOD}""",
)
def ast_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(extract.ast_counts(_python(spark, folder)))


@query(
    "code_symbols",
    f"""select file_id, path || '::' || n as qualified_name, regexp_replace(n, '.*[.]', '') as name, kind, line::bigint as line_number
    from (select p_partkey as file_id, {_PATH_SQL} as path, unnest(['TestK' || p_partkey, 'TestK' || p_partkey || '.m',
      'TestK' || p_partkey || '.test_plain', 'run', '_hidden']) as n, unnest(['class', 'method', 'method', 'function', 'function']) as kind,
      unnest([6, 8, 11, 12, 15]) as line {_GOOD})""",
)
def code_symbols(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(extract.symbols(_python(spark, folder)).drop("relative_path", "position"))


@query(
    "code_constants",
    """select p_partkey as file_id, n as name, line::bigint as line_number from (select p_partkey,
    unnest(['A' || p_partkey, 'b']) as n, unnest([27, 29]) as line from part)""",
)
def code_constants(spark: SparkSession, folder: str) -> DataFrame:
    found = extract.symbols(parse_files(source_files(spark, folder, "go"))).where("kind = 'constant'")
    return _rounded(found.select("file_id", "name", "line_number"))


@query(
    "code_interfaces",
    f"""select p_partkey as file_id, 'TestK' || p_partkey as name, 'abstract_class' as origin, 'm,test_plain' as method_signatures,
    'Base' || p_size || ',Protocol' as base_interfaces, 6::bigint as line_number {_GOOD}
    union all select p_partkey, 'I', 'language_interface', '', '', 13 from part
    union all select p_partkey, 'Shape', 'trait', '', '', 16 from part""",
)
def code_interfaces(spark: SparkSession, folder: str) -> DataFrame:
    files = source_files(spark, folder, "python")
    for language in ("go", "rust"):
        files = files.unionByName(source_files(spark, folder, language))
    return extract.interfaces(parse_files(files)).selectExpr(
        "file_id",
        "name",
        "origin",
        "array_join(method_signatures, ',') as method_signatures",
        "array_join(base_interfaces, ',') as base_interfaces",
        "cast(line_number as bigint) as line_number",
    )


@query(
    "code_candidates",
    f"""select file_id, name, kind, public as is_public, documented as has_docstring, line::bigint as line_number from (
      select p_partkey as file_id, unnest(['TestK' || p_partkey, 'run', '_hidden']) as name, unnest(['class', 'function', 'function']) as kind,
      unnest([true, true, false]) as public, unnest([p_size % 5 <> 0, true, false]) as documented, unnest([6, 12, 15]) as line {_GOOD})""",
)
def code_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(extract.candidates(_python(spark, folder)).drop("relative_path", "position", "signals"))


@query(
    "code_patterns",
    f"""select p_partkey as file_id, 'dataclass_value_object' as name, 'TestK' || p_partkey as subject_name,
    'dataclass(frozen=True)' as evidence, 6::bigint as line_number {_GOOD}""",
)
def code_patterns(spark: SparkSession, folder: str) -> DataFrame:
    return extract.patterns(_python(spark, folder)).selectExpr(
        "file_id", "name", "subject_name", "array_join(evidence, ',') as evidence", "cast(line_number as bigint) as line_number"
    )


@query(
    "code_architecture",
    """select p_partkey as file_id, case when p_size % 4 = 0 then 'tests/' else 'lib/' end || replace(p_brand, '#', '') as package,
    2::bigint as package_depth, 1::bigint as declared_module_count, false as is_package_root from part""",
)
def code_architecture(spark: SparkSession, folder: str) -> DataFrame:
    units = extract.package_units(parse_files(source_files(spark, folder, "rust")))
    assessed = analyze.architecture(units).withColumn("package", F.array_join("package_path", "/"))
    return _rounded(assessed.drop("relative_path", "package_path"))


@query(
    "code_complexity",
    f"""select p_partkey as file_id, 2.0::double as methods_per_class, 7.5::double as lines_per_function,
    (1 + {_ASYNC}) / 4 as async_function_ratio, 1::bigint as class_count, 2::bigint as function_count, 2::bigint as method_count {_GOOD}""",
)
def code_complexity(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(analyze.complexity(extract.ast_counts(_python(spark, folder))).drop("relative_path"))


@query(
    "code_documentation",
    f"""select p_partkey as file_id, 1::bigint as class_count, ({_DOC})::bigint as documented_class_count,
    ({_DOC})::double as class_documentation_ratio, 4::bigint as function_count, 1::bigint as documented_function_count,
    0.25::double as function_documentation_ratio, (1 + {_DOC}) / 5 as overall_documentation_ratio {_GOOD}""",
)
def code_documentation(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(analyze.documentation(extract.ast_counts(_python(spark, folder))).drop("relative_path"))


@query(
    "code_density",
    """select p_partkey as file_id, 22::bigint as line_count, round(1000 / 22, 6) as classes_per_kloc, round(3000 / 22, 6) as functions_per_kloc,
    round(3000 / 22, 6) as methods_per_kloc, round(11000 / 22, 6) as symbols_per_kloc from part""",
)
def code_density(spark: SparkSession, folder: str) -> DataFrame:
    counts = extract.ast_counts(parse_files(source_files(spark, folder, "cpp")))
    return _rounded(analyze.density(counts).drop("relative_path"))


@query(
    "code_dependencies",
    """select p_partkey as file_id, 6::bigint as total_dependency_count, 5::bigint as internal_dependency_count,
    1::bigint as external_dependency_count, 'lib' as external_targets from part""",
)
def code_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    profile = analyze.dependencies(parse_files(source_files(spark, folder, "typescript")))
    return _rounded(profile.withColumn("external_targets", F.array_join("external_targets", ",")).drop("relative_path"))


@query(
    "code_quality",
    f"""select p_partkey as file_id, 3::bigint as candidate_count, 2::bigint as public_candidate_count,
    (1 + {_DOC}) / 2 as documented_public_ratio, case when p_size % 5 = 0 then 'TestK' || p_partkey || ':low:6' else '' end as indicators {_GOOD}""",
)
def code_quality(spark: SparkSession, folder: str) -> DataFrame:
    shown = "array_join(transform(indicators, i -> concat_ws(':', i.subject_name, i.severity, i.line_number)), ',')"
    assessed = analyze.quality(_python(spark, folder))
    return _rounded(assessed.withColumn("indicators", F.expr(shown)).drop("relative_path"))


@query(
    "code_security",
    f"""select p_partkey as file_id, 2::bigint as external_dependency_count, 'json,os.path' as external_targets,
    'os.path:medium:9' as indicators {_GOOD}""",
)
def code_security(spark: SparkSession, folder: str) -> DataFrame:
    shown = "array_join(transform(indicators, i -> concat_ws(':', i.subject, i.severity, i.line_number)), ',')"
    assessed = analyze.security(_python(spark, folder), {"os": ("medium", "touches the system"), "js": ("low", "none")})
    return _rounded(
        assessed.withColumns({"external_targets": F.array_join("external_targets", ","), "indicators": F.expr(shown)}).drop("relative_path")
    )


@query(
    "code_tests",
    f"""select p_partkey as file_id, p_size % 4 = 0 as is_test_file, 1::bigint as test_function_count, 1::bigint as test_class_count,
    0::bigint as indicator_count {_GOOD}""",
)
def code_tests(spark: SparkSession, folder: str) -> DataFrame:
    evidence = analyze.tests(_python(spark, folder))
    return _rounded(evidence.withColumn("indicator_count", F.size("indicators")).drop("relative_path", "indicators"))


@query("document_parse")
def document_parse(spark: SparkSession, folder: str) -> DataFrame:
    """The documents table parsed as if it were code, whole texts; prose has no SQL statement of its facts."""
    parsed = parse_files(spread_rows(document_files(spark, folder, "doc_id", "text as content"), "doc_id"))
    return parsed.selectExpr(
        "doc_id", "succeeded", "language", "size(symbols) as symbol_count", "size(imports) as import_count", "metadata.line_count"
    )
