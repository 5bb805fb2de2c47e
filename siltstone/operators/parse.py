"""Parse files into nested structural records.

``parse_files`` is narrow: one Arrow step finds the marks of each text, and SQL array expressions turn the
marks of a row into modules, classes, functions, imports, exports and symbols. Nothing is shuffled, and a
consumer that reads only some of the columns pays only for those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import paths, text
from siltstone.functions.text import find_matching_sql, split_top_level_sql, strip_sql, words_sql
from siltstone.operators.marks import scan_marks

FUNCTION = (
    "struct<name:string,parameters:array<string>,return_type:string,is_async:boolean,is_method:boolean,"
    "decorators:array<string>,docstring:string,line_number:int>"
)
CLASS = (
    f"struct<name:string,base_classes:array<string>,methods:array<{FUNCTION}>,decorators:array<string>,"
    "docstring:string,line_number:int>"
)
IMPORT = "struct<module:string,imported_names:array<string>,alias:string,is_relative:boolean,line_number:int>"
NAMED_LINE = "struct<name:string,line_number:int>"
SYMBOL = "struct<name:string,kind:string,line_number:int>"

# Words that are not part of a C++ base class name or return type.
CPP_BASE_WORDS = ["public", "private", "protected", "virtual"]
CPP_RETURN_WORDS = ["virtual", "static", "explicit", "inline", "friend", "constexpr"]

NO_STRINGS = "cast(array() as array<string>)"


def _of(*kinds: str) -> str:
    """The marks of the given kinds, in order."""
    listed = ", ".join(f"'{kind}'" for kind in kinds)
    return f"filter(_marks, k -> k.kind in ({listed}))"


def _per_language(kind: str, **choices: str) -> str:
    """One array expression per language; empty for the rest."""
    branches = " ".join(f"when '{name}' then cast({value} as array<{kind}>)" for name, value in choices.items())
    return f"case _language {branches} else cast(array() as array<{kind}>) end"


def _after(value: str, separator: str) -> str:
    """Everything after the first separator, stripped."""
    return strip_sql(f"substr({value}, instr({value}, '{separator}') + {len(separator)})")


def _before(value: str, separator: str) -> str:
    return strip_sql(f"substring_index({value}, '{separator}', 1)")


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``value`` computed once per row and bound to ``name``, however often the body uses it."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _latest(rows: str) -> str:
    """One row per name: first position, last occurrence. Sorting keeps it n log n for generated files."""
    sorted_rows = f"array_sort(transform({rows}, (e, i) -> named_struct('name', e.name, 'at', i, 'row', e)))"
    firsts = "filter(sr, (x, i) -> i = 0 or sr[greatest(i - 1, 0)].name <> x.name)"
    lasts = "filter(sr, (x, i) -> i = size(sr) - 1 or sr[least(i + 1, size(sr) - 1)].name <> x.name)"
    kept = f"array_sort(zip_with({firsts}, {lasts}, (x, z) -> named_struct('at', x.at, 'row', z.row)))"
    return f"transform({_let(sorted_rows, 'sr', kept)}, y -> y.row)"


def _python_parameters(mark: str) -> str:
    """Parameters as written: stars, name, annotation, default; a lone star before named ones without a rest."""
    rows = (
        f"transform({mark}.items, (n, at) -> named_struct('place', {mark}.places[at], 'text', concat("
        f"n, coalesce(concat(': ', {mark}.annotations[at]), ''), coalesce(concat(' = ', {mark}.defaults[at]), ''))))"
    )

    def shown(place: str, stars: str = "") -> str:
        return f"transform(filter(pp, q -> q.place = '{place}'), q -> concat('{stars}', q.text))"

    lone = "exists(pp, q -> q.place = 'named') and not exists(pp, q -> q.place = 'rest')"
    rest = f"if({lone}, array('*'), {shown('rest', '*')})"
    return _let(rows, "pp", f"concat({shown('plain')}, {rest}, {shown('named')}, {shown('more', '**')})")


def _doc(mark: str) -> str:
    """Text of a raw doc comment; Python's own docstrings are texts already."""
    dashes = r"r'^\s*/// ?|\s+$'"
    ends, opening = r"r'\s*(\*/)?\s*$'", r"r'^\s*(/\*\*)?\s*\*?\s*'"
    lined = f"array_join(transform(split({mark}.doc, r'\n'), l -> regexp_replace(l, {dashes}, '')), chr(10))"
    bare = f"transform(split({mark}.doc, r'\n'), l -> regexp_replace(regexp_replace(l, {ends}, ''), {opening}, ''))"
    return (
        f"case when _language = 'python' then {mark}.doc when startswith({mark}.doc, '///') then {lined} "
        f"else nullif(array_join(filter({bare}, l -> l <> ''), chr(10)), '') end"
    )


def _function(mark: str, is_method: str) -> str:
    """A function or method record from its mark."""
    tail = strip_sql(f"{mark}.tail")
    returned = (
        f"case _language when 'python' then {mark}.first "
        f"when 'rust' then if(instr({tail}, '->') > 0, nullif({_after(tail, '->')}, ''), null) "
        f"when 'go' then nullif({tail}, '') "
        f"when 'cpp' then nullif({words_sql(f'{mark}.first', CPP_RETURN_WORDS)}, '') "
        f"else if(startswith({tail}, ':'), nullif({strip_sql(f'substr({tail}, 2)')}, ''), null) end"
    )
    parameters = f"if(_language = 'python', {_python_parameters(mark)}, {split_top_level_sql(f'{mark}.params')})"
    return (
        f"named_struct('name', {mark}.name, 'parameters', {parameters}, 'return_type', {returned}, "
        f"'is_async', {mark}.is_async, 'is_method', {is_method}, 'decorators', {mark}.decorators, "
        f"'docstring', {_doc(mark)}, 'line_number', {mark}.line)"
    )


def _import(module: str, names: str, alias: str, relative: str, line: str) -> str:
    return (
        f"named_struct('module', {module}, 'imported_names', {names}, 'alias', cast({alias} as string), "
        f"'is_relative', {relative}, 'line_number', {line})"
    )


def _rust_imports() -> str:
    """``use`` items: brace lists, aliases, ``self`` and globs."""
    # u: one use declaration with its blank-normalised body; then prefix and items; i: one item
    bodies = f"transform({_of('import')}, m -> named_struct('body', {words_sql('m.name')}, 'line', m.line))"
    grouped = "(instr(u.body, '{') > 0 and endswith(u.body, '}'))"
    head = strip_sql("substr(u.body, 1, instr(u.body, '{') - 1)")
    inner = (
        "substr(u.body, instr(u.body, '{') + 1, "
        + find_matching_sql("u.body", "(instr(u.body, '{') - 1)", "{", "}")
        + " - instr(u.body, '{'))"
    )
    prefix_expr = strip_sql(f"regexp_replace({head}, r'::\\z', '')")
    uses = (
        f"transform({bodies}, u -> named_struct("
        f"'prefix', if({grouped}, {prefix_expr}, ''), "
        f"'items', if({grouped}, {split_top_level_sql(inner)}, array(u.body)), "
        "'relative', u.body rlike r'\\A(?:crate|self|super)::', 'line', u.line))"
    )
    plain = f"if(instr(i, ' as ') > 0, {_before('i', ' as ')}, i)"
    alias = f"if(instr(i, ' as ') > 0, {_after('i', ' as ')}, null)"
    parts = f"transform(v.items, i -> named_struct('plain', {plain}, 'alias', {alias}))"
    last = "substring_index(j.plain, '::', -1)"
    is_split = "(v.prefix = '' and j.plain not in ('*', 'self') and instr(j.plain, '::') > 0)"
    module = (
        f"case when v.prefix <> '' then v.prefix "
        f"when {is_split} then substr(j.plain, 1, length(j.plain) - length({last}) - 2) else j.plain end"
    )
    names = (
        f"case when j.plain in ('*', 'self') or v.prefix <> '' then array(j.plain) "
        f"when {is_split} then array({last}) else {NO_STRINGS} end"
    )
    row = _import(module, names, "if(j.plain = '*', null, j.alias)", "v.relative", "v.line")
    return f"flatten(transform({uses}, v -> transform({parts}, j -> {row})))"


def _typescript_imports() -> str:
    """Default, namespace and named imports of one statement; one bare row when it has none of them."""
    relative = "(m.name rlike r'\\A[./]')"
    name = f"if(instr(i, ' as ') > 0, {_before('i', ' as ')}, i)"
    alias = f"if(instr(i, ' as ') > 0, {_after('i', ' as ')}, null)"
    named_row = _import("m.name", f"array({name})", alias, relative, "m.line")
    default = f"if(m.first is null, array(), array({_import('m.name', NO_STRINGS, 'm.first', relative, 'm.line')}))"
    star = _import("m.name", "array('*')", "m.second", relative, "m.line")
    space = f"if(m.second is null, array(), array({star}))"
    listed = (
        f"if(m.third is null, array(), filter(transform({split_top_level_sql('m.third')}, i -> {named_row}), "
        "r -> r.imported_names[0] <> ''))"
    )
    bare = (
        "if(m.first is null and m.second is null and m.third is null, "
        f"array({_import('m.name', NO_STRINGS, 'null', relative, 'm.line')}), array())"
    )
    typed = [f"cast({part} as array<{IMPORT}>)" for part in (default, space, listed, bare)]
    return f"flatten(transform({_of('import')}, m -> concat({', '.join(typed)})))"


def _imports() -> str:
    python = _import("m.name", "m.items", "m.first", "m.depth > 0", "m.line")
    go = _import("m.name", NO_STRINGS, "if(m.first in ('_', '.'), null, m.first)", "startswith(m.name, '.')", "m.line")
    cpp = _import("coalesce(m.second, m.first)", NO_STRINGS, "null", "m.second is not null", "m.line")
    go_marks = f"filter({_of('import')}, m -> m.depth = 1 or not m.inside)"
    return _per_language(
        IMPORT,
        python=f"transform({_of('import')}, m -> {python})",
        rust=_rust_imports(),
        go=f"transform({go_marks}, m -> {go})",
        typescript=_typescript_imports(),
        cpp=f"transform({_of('import')}, m -> {cpp})",
    )


def _methods() -> str:
    """Every method with its owner: ordinal of the enclosing class mark, or owner name.

    A Rust method belongs to the smallest impl block around it, a Go method to its receiver.
    """
    owner_name = "case _language when 'rust' then get(il, m.owner).name when 'go' then m.first end"
    chosen = (
        f"case _language when 'rust' then filter({_of('function')}, m -> m.inside) "
        f"when 'go' then filter({_of('function')}, m -> m.first is not null) "
        f"else filter({_of('method')}, m -> m.depth = 0) end"
    )
    rows = (
        f"transform({chosen}, m -> named_struct('owner', m.owner, 'owner_name', {owner_name}, "
        f"'record', {_function('m', 'true')}))"
    )
    return _let(_of("impl"), "il", rows)


def _grouped(rows: str, key: str, value: str) -> str:
    """Rows (as ``x``) by key in one sort: ``rows`` in key order, and a map from a key to its first place and number.

    A class then takes a slice of them instead of looking at every row. Rows of no key are left out.
    """
    kept = f"filter(transform({rows}, (x, at) -> named_struct('key', {key}, 'at', at, 'value', {value})), g -> g.key is not null)"
    firsts = "filter(transform(gs, (g, i) -> if(i = 0 or gs[greatest(i - 1, 0)].key <> g.key, i, -1)), i -> i >= 0)"
    counts = "transform(gf, (f, i) -> coalesce(get(gf, i + 1), size(gs)) - f)"
    places = (
        f"map_from_arrays(transform(gf, f -> gs[f].key), zip_with(gf, {counts}, (f, n) -> named_struct('first', f + 1, 'n', n)))"
    )
    made = f"named_struct('rows', transform(gs, g -> g.value), 'places', {_let(firsts, 'gf', places)})"
    return _let(f"array_sort({kept})", "gs", made)


def _group_of(groups: str, key: str, kind: str) -> str:
    """The rows of one key in their order, none for an unknown key."""
    place = f"element_at({groups}.places, {key})"
    return f"coalesce(slice({groups}.rows, {place}.first, {place}.n), cast(array() as array<{kind}>))"


# The arrow must come before the statement or the line ends.
_IS_ARROW = (
    "(instr(m.third, '=>') > 0 and (instr(m.third, ';') = 0 or instr(m.third, '=>') < instr(m.third, ';')) "
    "and (instr(m.third, '\\n') = 0 or instr(m.third, '=>') < instr(m.third, '\\n')))"
)


def _function_marks() -> str:
    """Marks of free functions."""
    return (
        f"filter({_of('function', 'arrow')}, m -> case _language when 'python' then true "
        f"when 'go' then m.first is null "
        f"when 'cpp' then m.depth = 0 and not m.inside and {strip_sql('m.first')} <> '' "
        f"else not m.inside and (m.kind <> 'arrow' or {_IS_ARROW}) end)"
    )


def _values(kind: str) -> str:
    """Constants or variables: Go block entries before singles; TypeScript without arrow functions."""
    go = f"filter({_of(kind)}, m -> if(m.depth = 1, m.name <> '_', not m.inside))"
    arrows = f"transform(filter({_of('arrow')}, m -> {_IS_ARROW}), m -> m.name)"
    typescript = f"filter({_of(kind)}, m -> not array_contains(an, m.name))"
    return (
        f"case _language when 'go' then {go} "
        f"when 'typescript' then {_let(arrows, 'an', typescript)} else {_of(kind)} end"
    )


def _classes() -> str:
    """Class records; methods are attached by enclosing mark, by impl block or by receiver."""
    rust_bases = _group_of("ig", "c.name", "string")
    typescript_bases = (
        f"concat(if(c.first is null, {NO_STRINGS}, array(c.first)), "
        f"if(c.second is null, {NO_STRINGS}, {split_top_level_sql('c.second')}))"
    )
    cpp_bases = (
        f"if(c.first is null, {NO_STRINGS}, filter(transform({split_top_level_sql('c.first')}, "
        f"b -> {words_sql('b', CPP_BASE_WORDS)}), b -> b <> ''))"
    )
    bases = (
        f"case _language when 'python' then c.items when 'rust' then {rust_bases} "
        f"when 'typescript' then {typescript_bases} when 'cpp' then {cpp_bases} else {NO_STRINGS} end"
    )
    own = _group_of("mg", "if(_language in ('rust', 'go'), c.name, cast(i as string))", FUNCTION)
    record = (
        f"named_struct('name', c.name, 'base_classes', {bases}, "
        f"'methods', {own}, 'decorators', c.decorators, "
        f"'docstring', {_doc('c')}, 'line_number', c.line)"
    )
    marks = f"if(_language = 'go', {_latest(_of('class'))}, {_of('class')})"
    methods = _grouped("_methods", "if(_language in ('rust', 'go'), x.owner_name, cast(x.owner as string))", "x.record")
    impls = _grouped(_of("impl"), "if(x.first is null, null, x.name)", "x.first")
    rows = _let(methods, "mg", _let(impls, "ig", f"transform({marks}, (c, i) -> {record})"))
    return f"cast({rows} as array<{CLASS}>)"


def _go_aliases() -> str:
    """Type declarations that are not also structs or interfaces of the same text."""
    taken = f"transform({_of('class', 'interface')}, m -> m.name)"
    return _let(taken, "tk", f"filter({_of('alias')}, m -> not array_contains(tk, m.name))")


def _exports() -> str:
    def named(*parts: str) -> str:
        slim = [
            f"transform({part}, m -> named_struct('name', m.name, 'line', m.line, 'exported', m.exported))"
            for part in parts
        ]
        return _latest(f"concat({', '.join(slim)})")

    def lines(rows: str, keep: str = "true", name: str = "m.name") -> str:
        row = f"named_struct('name', {name}, 'line_number', m.line)"
        return f"cast(transform(filter({rows}, m -> {keep}), m -> {row}) as array<{NAMED_LINE}>)"

    listed_name = f"if(instr(i, ' as ') > 0, {_after('i', ' as ')}, i)"
    listed = (
        f"flatten(transform({_of('export_list')}, m -> filter(transform({split_top_level_sql('m.first')}, "
        f"i -> named_struct('name', {listed_name}, 'line_number', m.line)), r -> r.name <> '')))"
    )
    typescript = named(
        _of("class"), "_functions", _of("interface"), _of("alias"), _of("enum"), "_constants", "_lets", "_variables"
    )
    return _per_language(
        NAMED_LINE,
        python=lines(_of("export")),
        rust=lines(
            named(*[_of(kind) for kind in ("class", "trait", "enum", "alias", "const")], "_functions"), "m.exported"
        ),
        go=lines(
            named(_of("class"), _of("interface"), _go_aliases(), "_constants", "_variables", "_functions"),
            "m.name rlike r'\\A\\p{IsUppercase}'",
        ),
        typescript=f"concat({lines(typescript, 'm.exported')}, cast({listed} as array<{NAMED_LINE}>), "
        + lines(_of("export_star"), name="coalesce(m.name, '*')")
        + ", "
        + lines(_of("export_default"), name="'default'")
        + ")",
        cpp=lines(named(_of("class"), "_functions", _of("enum"), _of("alias")), "m.exported"),
    )


def _symbols() -> str:
    def rows(kind: str, source: str, line: str = "y.line_number") -> str:
        row = f"named_struct('name', y.name, 'kind', '{kind}', 'line_number', {line})"
        return f"cast(transform({source}, y -> {row}) as array<{SYMBOL}>)"

    def latest(kind: str, source: str) -> str:
        return rows(kind, _latest(source), "y.line")

    def joined(*parts: str) -> str:
        return f"concat({', '.join(parts)})"

    members = rows("method", "flatten(transform(classes, c -> c.methods))")
    every_method = rows("method", "transform(_methods, x -> x.record)")
    functions = rows("function", "functions")
    constants, variables = latest("constant", "_constants"), latest("variable", "_variables")
    interleaved = f"flatten(transform(classes, c -> concat({rows('class', 'array(c)')}, {rows('method', 'c.methods')})))"
    return _per_language(
        SYMBOL,
        python=joined(interleaved, functions),
        rust=joined(
            rows("module", "modules"),
            rows("struct", "classes"),
            latest("trait", _of("trait")),
            latest("enum", _of("enum")),
            latest("type_alias", _of("alias")),
            functions,
            every_method,
            constants,
        ),
        go=joined(
            rows("module", "modules"),
            rows("struct", "classes"),
            latest("interface", _of("interface")),
            latest("type_alias", _go_aliases()),
            functions,
            every_method,
            constants,
            variables,
        ),
        typescript=joined(
            rows("namespace", "modules"),
            rows("class", "classes"),
            members,
            functions,
            latest("interface", _of("interface")),
            latest("type_alias", _of("alias")),
            latest("enum", _of("enum")),
            constants,
            latest("variable", "concat(_lets, _variables)"),
        ),
        cpp=joined(
            rows("namespace", "modules"),
            rows("class", "classes"),
            members,
            functions,
            latest("enum", _of("enum")),
            latest("type_alias", _of("alias")),
        ),
    )


def parse_files(files: DataFrame) -> DataFrame:
    """Add the structural record of every file; ``content`` is dropped, all other columns are kept.

    ``files`` needs ``relative_path`` and ``content``. A file that cannot be parsed keeps its row with
    ``succeeded`` false, an ``error_message``, no metadata and empty collections.
    """
    content, language = F.col("content"), F.col("_language")
    kept = [name for name in files.columns if name != "content"]
    scanned = files.withColumn("_language", paths.language_of("relative_path")).select(
        *kept,
        "_language",
        F.struct(
            F.col("relative_path"),
            language.alias("language"),
            text.size_bytes(content).alias("size_bytes"),
            text.line_count(content).alias("line_count"),
            text.content_hash(content).alias("content_hash"),
        ).alias("_metadata"),
        scan_marks(F.col("relative_path"), language, F.when(language.isNotNull(), content)).alias("_scan"),
    )
    modules = f"if(_language = 'go', slice({_of('module')}, 1, 1), {_of('module')})"
    return (
        scanned.selectExpr(
            *kept,
            "_language",
            "_metadata",
            "_scan.marks as _marks",
            "if(_language is null, concat(\"no parser supports '\", relative_path, \"'\"), _scan.error) as error_message",
        )
        .selectExpr(
            "*",
            f"{_values('const')} as _constants",
            f"{_values('let')} as _lets",
            f"{_values('var')} as _variables",
            f"{_methods()} as _methods",
            f"{_function_marks()} as _functions",
        )
        .selectExpr(
            "*",
            f"cast(transform({modules}, m -> named_struct('name', m.name, 'line_number', m.line)) "
            f"as array<{NAMED_LINE}>) as modules",
            f"{_classes()} as classes",
            f"cast(transform(_functions, m -> {_function('m', 'false')}) as array<{FUNCTION}>) as functions",
            f"{_imports()} as imports",
            f"{_exports()} as exports",
        )
        .selectExpr(
            *kept,
            "error_message is null as succeeded",
            "coalesce(_language, 'unknown') as language",
            "if(error_message is null, _metadata, null) as metadata",
            "modules",
            "classes",
            "functions",
            "imports",
            "exports",
            f"{_symbols()} as symbols",
            "error_message",
        )
    )


def successful(parsed: DataFrame) -> DataFrame:
    """Only the files that were parsed."""
    return parsed.where("succeeded")
