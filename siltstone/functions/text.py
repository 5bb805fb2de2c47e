"""String functions over whole texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The line breaks Python's str.splitlines recognises, as a Java pattern.
LINE_BREAK = "\\r\\n|[\\n\\u000B\\u000C\\r\\u001C\\u001D\\u001E\\u0085\\u2028\\u2029]"
LINE_BREAK_CHARACTERS = ["\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
# Fixed value: the characters Python's str.strip removes.
BLANK_CLASS = "[\\s\\x1c-\\x1f]"
# Fixed value: the same characters one by one, as SQL trim takes them.
BLANKS = "".join(map(chr, [*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
BLANKS_SQL = "'" + "".join(f"\\u{ord(char):04x}" for char in BLANKS) + "'"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    """Trim Unicode blanks from both ends."""
    return F.regexp_replace(_col(text), f"(?U)\\A{BLANK_CLASS}+|{BLANK_CLASS}+\\z", "")


def is_blank(text: Column | str) -> Column:
    """True when nothing but blanks is left. A visible ASCII first character decides without a pattern."""
    text = _col(text)
    return ~F.substring(text, 1, 1).between("!", "~") & ~text.rlike("(?U)[^\\s\\x1c-\\x1f]")


def size_bytes(text: Column | str) -> Column:
    return F.octet_length(_col(text)).cast("bigint")


def content_hash(text: Column | str) -> Column:
    return F.sha2(_col(text), 256)


def line_count(text: Column | str) -> Column:
    """Number of lines: breaks, plus one when the text does not end in a break."""
    text = _col(text)
    ends_open = (text != "") & ~F.substring(text, -1, 1).isin(LINE_BREAK_CHARACTERS)
    return F.regexp_count(text, F.lit(LINE_BREAK)) + F.when(ends_open, 1).otherwise(0)


def lines(text: Column | str) -> Column:
    """The lines of a text without their breaks; no empty last line."""
    text = _col(text)
    pieces = F.split(text, LINE_BREAK, -1)
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.substring(text, -1, 1).isin(LINE_BREAK_CHARACTERS), F.slice(pieces, 1, F.size(pieces) - 1))
        .otherwise(pieces)
    )


def line_number_at(text: Column | str, index: Column) -> Column:
    """1-based line of a 0-based offset; only ``\\n`` counts."""
    return F.regexp_count(F.substr(_col(text), F.lit(1), index.cast("int")), F.lit("\n")) + 1


# The functions below are building blocks of long array expressions. They take and return SQL text, so a
# whole select list reaches the JVM as one string; use them with ``F.expr`` or ``selectExpr``.


def strip_sql(value: str) -> str:
    """Trim Unicode blanks from both ends."""
    return f"trim(both {BLANKS_SQL} from {value})"


def words_sql(value: str, dropped: list[str] = ()) -> str:
    """The words of a text, without the given ones, joined by single blanks."""
    listed = ", ".join(f"'{word}'" for word in ["", *dropped])
    return f"array_join(filter(split({value}, r'(?U){BLANK_CLASS}+', -1), w -> w not in ({listed})), ' ')"


def find_matching_sql(value: str, open_index: str, opening: str, closing: str) -> str:
    """0-based offset of the bracket closing the one at ``open_index``; text length when unclosed."""
    pieces = (
        f"regexp_extract_all(substr({value}, {open_index} + 1), "
        f"r'[\\{opening}\\{closing}]|[^\\{opening}\\{closing}]+', 0)"
    )
    step = (
        f"named_struct('at', st.at + length(p), "
        f"'depth', st.depth + case p when '{opening}' then 1 when '{closing}' then -1 else 0 end, "
        f"'found', if(st.found < 0 and p = '{closing}' and st.depth = 1, st.at, st.found))"
    )
    fold = f"aggregate({pieces}, named_struct('at', 0, 'depth', 0, 'found', -1), (st, p) -> {step}, st -> st.found)"
    return f"coalesce({open_index} + nullif({fold}, -1), length({value}))"


def split_top_level_sql(value: str, delimiter: str = ",") -> str:
    """Split at delimiters outside every bracket; segments are stripped and blanks dropped."""
    pieces = (
        f"regexp_extract_all({value}, r'[(\\[{{)\\]}}]|\\{delimiter}|[^(\\[{{)\\]}}\\{delimiter}]+', 0)"
    )
    step = (
        "named_struct("
        "'depth', st.depth + case when p in ('(', '[', '{') then 1 when p in (')', ']', '}') then -1 else 0 end, "
        f"'open', if(p = '{delimiter}' and st.depth = 0, '', concat(st.open, p)), "
        f"'done', if(p = '{delimiter}' and st.depth = 0, array_append(st.done, st.open), st.done))"
    )
    fold = (
        f"aggregate({pieces}, named_struct('depth', 0, 'open', '', 'done', cast(array() as array<string>)), "
        f"(st, p) -> {step}, st -> array_append(st.done, st.open))"
    )
    segments = f"if({value} rlike r'[(\\[{{)\\]}}]', {fold}, split({value}, r'\\{delimiter}', -1))"
    return f"filter(transform({segments}, g -> {strip_sql('g')}), g -> g <> '')"


def is_top_level_of_span_sql(value: str, span_start: str, index: str) -> str:
    """True when as many braces open as close between two offsets."""
    part = f"substr({value}, {span_start} + 1, {index} - {span_start})"
    return f"regexp_count({part}, r'\\{{') = regexp_count({part}, r'\\}}')"


def leading_comment_lines_sql(text_lines: str, declaration_line: str, prefix: str) -> str:
    """The block of ``prefix`` lines directly above a 1-based line, or null."""
    above = f"reverse(slice({text_lines}, 1, greatest({declaration_line} - 1, 0)))"
    bare = strip_sql("ln")
    taken = f"st.open and startswith({bare}, '{prefix}')"
    body = f"regexp_replace(substr({bare}, {len(prefix) + 1}), r'\\A ', '')"
    fold = (
        f"aggregate({above}, named_struct('open', true, 'kept', cast(array() as array<string>)), "
        f"(st, ln) -> named_struct('open', {taken}, 'kept', if({taken}, array_append(st.kept, {body}), st.kept)), "
        "st -> reverse(st.kept))"
    )
    return f"nullif(array_join({fold}, '\\n'), '')"


def mask_comments_sql(value: str) -> str:
    """Overwrite ``//`` and ``/* */`` comments with blanks, keeping length and line breaks."""
    pieces = f"regexp_extract_all({value}, r'(?s)/\\*.*?(?:\\*/|\\z)|//[^\\n]*|[^/]+|/', 0)"
    masked = (
        f"transform({pieces}, p -> if(startswith(p, '/*') or startswith(p, '//'), "
        "regexp_replace(p, r'[^\\n]', ' '), p))"
    )
    return f"array_join({masked}, '')"
