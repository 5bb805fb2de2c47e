"""Main text of web pages by differencing each page with the page of the nearest URL on its host.

A page is cut into lines, one per block of its markup. Pages are ordered by host and path, and the neighbour that has
the longer common path is the partner. The lines of the two are aligned by their longest common subsequence, and a page
loses the lines it shares: menus, notices and footers repeat on a site, its articles do not. A page that shares most of
its body is a mirror of its partner and loses only what further pages have as well. An article's own headings
and paragraphs may recur on a mirror or as a quoted passage, so inside an article element only other lines are deleted.
What HTML itself marks as no text (script, style, nav, header, footer, aside, form) or what classes name as advert,
notice or comment is dropped as well, since a host with a single page has no partner.
"""

from __future__ import annotations

import hashlib
import html
import pickle
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import cut_lineage, task_count

SCHEMA = "page_id bigint, url string, text string, n_chars bigint, n_lines bigint, n_shared bigint"


@dataclass(frozen=True)
class Settings:
    """Names that mark what is no main text; elements that are blocks, and those that are running text.

    A class name, id or role marks an element if it is one of ``words``, or some of them with ``before`` words in front
    and ``after`` words or numbers behind, such as site-header or cookie-notice-bar.
    """

    silent: frozenset = frozenset("script style noscript template svg head title iframe object select option".split())
    apart: frozenset = frozenset("nav header footer aside form menu dialog button".split())
    blocks: frozenset = frozenset(
        "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
        "form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr "
        "ul".split()
    )
    running: frozenset = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th figcaption summary".split())
    words: frozenset = frozenset(
        "ad ads advert adverts advertisement banner sponsor sponsored promo nav navbar navigation menu sidebar header "
        "footer cookie cookies consent notice comment comments respond reply replies disqus share social related "
        "newsletter subscribe subscription popup modal breadcrumb breadcrumbs widget".split()
    )
    before: frozenset = frozenset("site global top bottom mobile desktop primary secondary main".split())
    after: frozenset = frozenset(
        "area bar block box buttons container inner item items links list slot unit wrap wrapper".split()
    )
    direct_cells: int = 250_000


# A comment, a declaration, a raw-text element's content, or a tag. None is tried twice from the same place.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.DOTALL
)
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z0-9]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = ("script", "style")
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title head html".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SPACES = re.compile(r"\s+")


class Line(NamedTuple):
    text: str
    apart: bool  # in an element that is no main text
    article: bool  # in an article or main element
    running: bool  # in a heading, paragraph, list item or the like


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)


def marking(attributes: str, settings: Settings) -> set[str]:
    """Words by which class names, id or role mark an element; empty if they do not."""
    marks: set[str] = set()
    for match in _NAMES.finditer(attributes):
        for name in (match[1] or match[2] or match[3] or "").lower().split():
            parts = [x for x in _SPLIT.split(name) if x]
            low, high = 0, len(parts)
            while low < high and parts[low] not in settings.words and parts[low] in settings.before:
                low += 1
            while high > low and parts[high - 1] not in settings.words and (parts[high - 1] in settings.after or parts[high - 1].isdigit()):
                high -= 1
            if low < high and settings.words.issuperset(parts[low:high]):
                marks.update(parts[low:high])
    return marks


def page_lines(source: str, settings: Settings) -> list[Line]:
    """Blocks of a page in order, with references decoded and white space made one space."""
    lines: list[Line] = []
    pieces: list[str] = []
    stack: list[tuple[str, bool, int, bool, bool]] = []  # name, silent, apart, article, running before it
    silent = article = running = False
    apart = 0  # 1 by a class name, id or role alone, 2 by an element
    at = 0

    def flush() -> None:
        if pieces:
            text = _SPACES.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                lines.append(Line(text, apart > 0, article, running))
            pieces.clear()

    while True:
        match = _MARKUP.search(source, at)
        end = match.start() if match else len(source)
        if end > at and stack and stack[-1][0] == "head" and not source[at:end].isspace():
            _, silent, apart, article, running = stack.pop()  # text ends an open head, as in a browser
        if end > at and not silent:
            pieces.append(source[at:end])
        if not match:
            break
        at = match.end()
        name = match[2]
        if not name:
            continue
        name = name.lower()
        if match[1]:
            if name in settings.blocks:
                flush()
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    _, silent, apart, article, running = stack[depth]
                    del stack[depth:]
                    break
                if stack[depth][0] in ("article", "main", "body", "table") and name not in ("article", "main", "body", "html", "table"):
                    break  # a stray end tag does not close what lies around it
            continue
        if stack and (name == "body" or stack[-1][0] == "head" and name not in _HEAD):
            for depth in range(len(stack)):
                if stack[depth][0] == "head":
                    # The end tag of a head may be left out: what cannot stand in it ends it.
                    _, silent, apart, article, running = stack[depth]
                    del stack[depth:]
                    break
        if name == "br":
            pieces.append(" ")
            continue
        if name in settings.blocks:
            flush()
            if stack and stack[-1][0] == "p" or name == "p" and any(x[0] == "p" for x in stack[-4:]):
                # A block ends an open paragraph.
                for depth in range(len(stack) - 1, -1, -1):
                    if stack[depth][0] == "p":
                        _, silent, apart, article, running = stack[depth]
                        del stack[depth:]
                        break
        if name in _VOID or match[3].endswith("/"):
            continue
        if name in _RAW:
            close = re.compile(rf"</{name}\s*>|\Z", re.IGNORECASE).search(source, at)
            at = close.end()
            continue
        stack.append((name, silent, apart, article, running))
        silent = silent or name in settings.silent
        marks = marking(match[3], settings) - ({"header"} if name in _HEADINGS else set())
        if name in ("article", "main"):
            # What a wrapper's name says does not hold for an article in it, unless the article says it as well.
            apart = 0 if apart == 1 and not marks else apart
        elif name in settings.apart and not (name == "header" and article):
            apart = 2
        elif marks and name not in ("html", "body"):
            apart = max(apart, 1)
        article = article or name in ("article", "main")
        running = name in settings.running if name in settings.blocks else running
    flush()
    return lines


def _prefix_lengths(one: list, two: list) -> np.ndarray:
    """Length of the longest common subsequence of ``one`` with each beginning of ``two``, a bit per line of ``two``.

    The rows of the usual table as bit vectors (Hyyro 2004): memory grows with the lengths, not with their product.
    """
    size = len(two)
    places: dict = {}
    for j, line in enumerate(two):
        places.setdefault(line, []).append(j)
    full = (1 << size) - 1
    row = full
    for line in one:
        at = places.get(line)
        if at is None:
            continue
        if len(at) <= 8:
            mask = 0
            for j in at:
                mask |= 1 << j
        else:
            bits = np.zeros(size, np.uint8)
            bits[at] = 1
            mask = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        met = row & mask
        row = ((row + met) | (row - met)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(size // 8 + 1, "little"), np.uint8), count=size, bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def shared_lines(one: list, two: list, direct_cells: int) -> set[int]:
    """Indexes in ``one`` of a longest common subsequence with ``two``.

    Common ends are taken first. What is left is solved by the usual table where it has at most ``direct_cells`` cells;
    a larger part is halved where the halves' lengths add up to the most (Hirschberg 1975), so the result is exact and
    memory stays linear for pages of any length.
    """
    found: set[int] = set()
    work = [(0, len(one), 0, len(two))]
    while work:
        a, b, c, d = work.pop()
        while a < b and c < d and one[a] == two[c]:
            found.add(a)
            a, c = a + 1, c + 1
        while a < b and c < d and one[b - 1] == two[d - 1]:
            b, d = b - 1, d - 1
            found.add(b)
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= direct_cells:
            table = [[0] * (d - c + 1)]
            for i in range(b - 1, a - 1, -1):
                row, below = [0] * (d - c + 1), table[-1]
                for j in range(d - c - 1, -1, -1):
                    row[j] = below[j + 1] + 1 if one[i] == two[c + j] else max(below[j], row[j + 1])
                table.append(row)
            table.reverse()
            i = j = 0
            while i < b - a and j < d - c:
                if one[a + i] == two[c + j]:
                    found.add(a + i)
                    i, j = i + 1, j + 1
                elif table[i + 1][j] >= table[i][j + 1]:
                    i += 1
                else:
                    j += 1
            continue
        if b - a == 1:
            if one[a] in two[c:d]:
                found.add(a)
            continue
        middle = (a + b) // 2
        head = _prefix_lengths(one[a:middle], two[c:d])
        tail = _prefix_lengths(one[middle:b][::-1], two[c:d][::-1])[::-1]
        cut = c + int((head + tail).argmax())
        work += [(a, middle, c, cut), (middle, b, cut, d)]
    return found


def main_text(lines: list[Line], partner: list[Line] | None, settings: Settings) -> tuple[str, int]:
    """Text of a page, and how many lines it shares with its partner."""
    shared = (
        shared_lines([x.text for x in lines], [x.text for x in partner], settings.direct_cells) if partner else set()
    )
    return kept_text(lines, shared), len(shared)


def body_lines(lines: list[Line]) -> list[tuple[int, Line, bool]]:
    """The lines that may be main text, with their indexes and whether they stay although they stand elsewhere."""
    articles = any(x.article for x in lines)
    return [
        (at, line, line.article and line.running)
        for at, line in enumerate(lines)
        if not line.apart and (line.article or not articles)
    ]


def kept_text(lines: list[Line], deleted: set[int]) -> str:
    """Text of a page whose lines of these indexes stand elsewhere; headings and paragraphs of an article stay."""
    return "\n\n".join(line.text for at, line, stays in body_lines(lines) if stays or at not in deleted)


def _common(one: str, two: str) -> int:
    """Length of the common path, in whole segments, then in characters."""
    size = 0
    for x, y in zip(one, two):
        if x != y:
            break
        size += 1
    return size


@dataclass
class Key:
    """What pairing needs of a page. ``key`` names its host, path and markup, ``same`` the texts of its lines."""

    host: str
    path: str
    key: bytes
    same: bytes
    hashes: np.ndarray
    body: bytes  # per line: 1 if it may be main text


KEY_SCHEMA = "host string, path string, key binary, same binary, hashes array<bigint>, body binary"


def _digest(text: str, size: int) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).digest()


def page_keys(source: DataFrame, settings: Settings) -> DataFrame:
    """Distinct pages by host, path and markup; of the markup only eight bytes a line."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                lines = page_lines(row["html"] or "", settings)
                articles = any(x.article for x in lines)
                rows.append(
                    (
                        row["host"],
                        row["path"],
                        row["key"],
                        _digest("\x00".join(x.text for x in lines), 16),
                        [int.from_bytes(_digest(x.text, 8), "little", signed=True) for x in lines],
                        bytes(not x.apart and (x.article or not articles) for x in lines),
                    )
                )
            kinds = (pa.string(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "path", "key", "same", "hashes", "body"]
            )

    hosted = source.where("host <> ''").select("host", "path", "key", "html")
    return hosted.mapInArrow(keyed, KEY_SCHEMA).dropDuplicates(["key"])


def _befores(keys: list[Key], last: Key | None, other: Key | None) -> tuple[list[Key | None], Key | None, Key | None]:
    """For each key the nearest before it on its host whose texts differ.

    ``last`` is the key before the first and ``other`` the one found for that; the two after the last key are returned.
    """
    found: list[Key | None] = []
    for key in keys:
        if last is None or last.host != key.host:
            other = None
        elif last.same != key.same:
            other = last
        found.append(other)
        last = key
    return found, last, other


def _edges(keys: list[Key]) -> list[Key]:
    """The keys at an end of a range that the next range has to know: its last, and the last that differs before it."""
    _, last, other = _befores(keys, None, None)
    return [x for x in (other, last) if x]


def shared_of_keys(keys: DataFrame, settings: Settings) -> DataFrame:
    """Per key the indexes of the lines it ``shared`` with its partner, and of those to be ``deleted``.

    They are the same, but where most lines of the body are shared, as on a mirror. There those are deleted that also
    stand in further pages of the host: under three paths or more, of pages with equal texts one.

    Keys are ordered by ranges; what a range must know of those beside it, two keys at each end, passes the driver.
    """
    spark = keys.sparkSession
    order = ["host", "path", "key"]
    # Written, so that both steps see the same ranges.
    ranged = cut_lineage(keys.repartitionByRange(task_count(spark), *order).sortWithinPartitions(*order))

    def read(batches: Iterator[pa.RecordBatch]) -> list[Key]:
        rows = (row for batch in batches for row in batch.to_pylist())
        return [Key(**(row | {"hashes": np.array(row["hashes"], np.int64)})) for row in rows]

    def aligned(one: Key, two: Key) -> set[int]:
        return shared_lines(one.hashes.tolist(), two.hashes.tolist(), settings.direct_cells)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = read(batches)
        if found:
            packed = pickle.dumps((_edges(found), _edges(found[::-1])))
            number = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([packed])], ["number", "ends"])

    rows = sorted(ranged.mapInArrow(ends, "number bigint, ends binary").collect())
    numbers = [row["number"] for row in rows]
    tails, heads = zip(*(pickle.loads(bytes(row["ends"])) for row in rows)) if rows else ((), ())
    around: dict[int, list] = {number: [None] * 4 for number in numbers}
    last = other = None
    for number, edge in zip(numbers, tails):
        around[number][:2] = last, other
        _, last, other = _befores(edge, last, other)
    last = other = None
    for number, edge in reversed(list(zip(numbers, heads))):
        around[number][2:] = last, other
        _, last, other = _befores(edge, last, other)
    beside = spark.sparkContext.broadcast(around)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = read(batches)
        if not found:
            return
        last, other, following, differing = beside.value[TaskContext.get().partitionId()]
        before = _befores(found, last, other)[0]
        after = _befores(found[::-1], following, differing)[0][::-1]
        for low in range(0, len(found), 2000):
            part = found[low : low + 2000]
            shared, mirrored = [], []
            for key, *near in zip(part, before[low:], after[low:]):
                near = [x for x in near if x]
                partner = max(near, key=lambda x: _common(key.path, x.path)) if near else None
                met = sorted(aligned(key, partner)) if partner else []
                body = [at for at in met if key.body[at]]
                shared.append(met)
                most = 2 * len(body) > sum(key.body)
                mirrored.append([{"at": at, "line": int(key.hashes[at])} for at in body] if most else None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x.host for x in part], pa.string()),
                    pa.array([x.key for x in part], pa.binary()),
                    pa.array(shared, pa.list_(pa.int32())),
                    pa.array(mirrored, pa.list_(pa.struct([("at", pa.int32()), ("line", pa.int64())]))),
                ],
                ["host", "key", "shared", "mirrored"],
            )

    kinds = "host string, key binary, shared array<int>, mirrored array<struct<at: int, line: bigint>>"
    met = cut_lineage(ranged.mapInArrow(align, kinds))
    asked = met.where("mirrored is not null").select("host", "key", F.inline("mirrored"))
    recurring = (
        ranged.groupBy("host", "same")
        .agg(F.min("path").alias("path"), F.first("hashes").alias("hashes"))
        .select("host", "path", F.explode("hashes").alias("line"))
        .join(asked.select("host", "line").distinct(), ["host", "line"], "left_semi")
        .distinct()
        .groupBy("host", "line")
        .count()
        .where("count >= 3")
        .select("host", "line")
    )
    repeated = asked.join(recurring, ["host", "line"]).groupBy("key").agg(F.collect_list("at").alias("repeated"))
    deleted = F.when(F.col("mirrored").isNull(), F.col("shared")).otherwise(F.col("repeated"))
    return met.join(repeated, "key", "left").select("key", "shared", deleted.alias("deleted"))


def extract_pages(pages: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Main text of every page.

    One row per input row: ``page_id``, ``url``, ``text`` (empty if none), ``n_chars``, and the page's lines and those
    shared with its partner. A null html is empty. A page without a URL, or with no other on its host, has no partner
    and keeps what the markup does not rule out. Pages of equal texts are no partners of each other: the partner is the
    nearest page that differs, and of a page most of whose body it shares only lines of further pages are deleted. It is found on paths and hashes of lines alone, ordered by ranges that know the keys beside
    them, so a host of any size is dealt to many tasks and the result does not depend on their number; a task holds the
    keys of its range. Whole pages are read, twice. An empty table gives no rows; extra columns are not read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                lines = page_lines(row["html"] or "", settings)
                body = body_lines(lines)
                places = [-1 if stays else at for at, _, stays in body]
                texts = zlib.compress("\n".join(line.text for _, line, _ in body).encode("utf-8", "surrogatepass"))
                rows.append((row["page_id"], row["url"], row["key"], len(lines), places, texts))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.binary())
            names = ["page_id", "url", "key", "n_lines", "places", "body"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                deleted = set(row["deleted"] or ())
                texts = zlib.decompress(row["body"]).decode("utf-8", "surrogatepass").split("\n")
                text = "\n\n".join(x for x, at in zip(texts, row["places"]) if at not in deleted)
                rows.append((row["page_id"], row["url"], text, len(text), row["n_lines"], len(row["shared"] or ())))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ["page_id", "url", "text", "n_chars", "n_lines", "n_shared"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    url = F.regexp_replace(F.coalesce(pages["url"], F.lit("")), r"[?#].*$", "")
    source = pages.select(
        pages["page_id"].cast("bigint").alias("page_id"),
        pages["url"].alias("url"),
        pages["html"].alias("html"),
        F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/]*)", 1)).alias("host"),
        F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/]*(.*)$", 1).alias("path"),
    )
    markup = F.concat_ws("\n", "host", "path", F.coalesce("html", F.lit("")))
    source = source.withColumn("key", F.unhex(F.md5(markup.cast("binary"))))
    found = shared_of_keys(page_keys(source, settings), settings)
    # Of a page only the lines that may be its text are shuffled to what is known of them, compressed and without markup;
    # white space in a line is one space, so line feeds divide them, and a line that stays has no place.
    kinds = "page_id bigint, url string, key binary, n_lines bigint, places array<int>, body binary"
    joined = source.select("page_id", "url", "html", "key").mapInArrow(read, kinds).join(found, "key", "left")
    return joined.select("page_id", "url", "n_lines", "places", "body", "shared", "deleted").mapInArrow(finish, SCHEMA)
