"""Benchmark passages in training documents, by a distributed positional inverted index.

``build_index`` cuts the documents into segments of a few MB of text, wherever they lie, and stores for each segment
the postings of every term: the positions at which it stands, by term. Nothing is shuffled. ``search`` takes phrases
(lists of terms), in blocks of bounded size, to every segment. In a segment the terms of a phrase are taken from the
rarest on; the positions of each, less its place in the phrase, are intersected with what the rarer ones have left.
With ``slop`` 0 this finds exact phrases; otherwise terms may stand up to ``slop`` words from their place (proximity).
Terms are 64-bit hashes of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import text_slices, write_shared
from siltstone.llm.words import PLAIN, hashed_words, mixed

SEGMENT = (
    "segment bigint, doc_ids array<bigint>, doc_ends array<int>, terms binary, term_ends binary, postings binary"
)


@dataclass(frozen=True)
class Settings:
    """``window`` consecutive item words; ``segment_bytes`` of text a segment; ``block`` windows sent out at once."""

    window: int = 10
    segment_bytes: int = 4_000_000
    segment_documents: int = 20_000
    block: int = 200_000


def build_index(documents: DataFrame, settings: Settings) -> DataFrame:
    """Write the positional index of all documents to shared storage: one row per segment.

    ``terms`` holds the sorted distinct hashes, ``term_ends`` where each one's postings end, and ``postings`` the
    word positions in the segment, each less the one before it, compressed.
    """

    def invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        packer = zstandard.ZstdCompressor(level=1)
        for part in text_slices(batches, most_bytes=settings.segment_bytes, most_rows=settings.segment_documents):
            words = hashed_words(part.column("text"), PLAIN)
            order = np.argsort(words.hashes, kind="stable")
            terms, first = np.unique(words.hashes[order], return_index=True)
            gaps = np.diff(order, prepend=0)
            gaps[first] = order[first]
            ends = np.append(first[1:], len(order)) if len(first) else first
            yield pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array([number], pa.int64()),
                    "doc_ids": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "doc_ends": pa.array([words.bounds[1:].astype(np.int32)], pa.list_(pa.int32())),
                    "terms": pa.array([terms.tobytes()], pa.binary()),
                    "term_ends": pa.array([packer.compress(ends.astype(np.uint32).tobytes())], pa.binary()),
                    "postings": pa.array([packer.compress(gaps.astype(np.uint32).tobytes())], pa.binary()),
                }
            )
            number += 1

    source = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"])
    return write_shared(source.mapInArrow(invert, SEGMENT), "positional-index", compression="uncompressed")


@dataclass
class Segment:
    terms: np.ndarray
    ends: np.ndarray
    postings: np.ndarray  # positions, by term and ascending
    doc_ends: np.ndarray

    @classmethod
    def unpacked(cls, row: dict) -> Segment:
        reader = zstandard.ZstdDecompressor()
        terms = np.frombuffer(row["terms"], np.uint64)
        ends = np.frombuffer(reader.decompress(row["term_ends"]), np.uint32).astype(np.int64)
        gaps = np.frombuffer(reader.decompress(row["postings"]), np.uint32).astype(np.int64)
        sums = np.cumsum(gaps)
        starts = np.append(0, ends[:-1]) if len(ends) else ends
        before = np.where(starts > 0, sums[starts - 1], 0) if len(ends) else starts
        return cls(terms, ends, sums - np.repeat(before, ends - starts), np.asarray(row["doc_ends"], np.int64))


@dataclass
class Phrases:
    """``terms`` (phrases x longest length) and ``lengths``."""

    keys: np.ndarray
    terms: np.ndarray
    lengths: np.ndarray


def find_phrases(segment: Segment, phrases: Phrases, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index of the phrase and start position of every match in the segment, none across two documents."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(segment.terms) or not len(phrases.keys):
        return none
    width = phrases.terms.shape[1]
    used = np.arange(width) < phrases.lengths[:, None]
    place = np.minimum(np.searchsorted(segment.terms, phrases.terms), len(segment.terms) - 1)
    known = segment.terms[place] == phrases.terms
    possible = np.flatnonzero((known | ~used).all(axis=1))
    if not len(possible):
        return none
    place, used = place[possible], used[possible]
    starts = np.append(0, segment.ends[:-1])
    counts = np.where(used, (segment.ends - starts)[place], np.iinfo(np.int64).max)
    rank = np.argsort(counts, axis=1, kind="stable")  # each phrase's places from the rarest term on
    rows = np.arange(len(possible))
    rarest = rank[:, 0]
    term = place[rows, rarest]
    many = (segment.ends - starts)[term]
    phrase = np.repeat(rows, many)
    within = np.arange(len(phrase)) - np.repeat(np.cumsum(many) - many, many)
    start = segment.postings[np.repeat(starts[term], many) + within] - rarest[phrase]
    # One sorted list of (term, position) stands for all postings lists.
    total = segment.doc_ends[-1] + 1 + 2 * (width + slop)
    listed = np.repeat(np.arange(len(segment.terms)), segment.ends - starts) * total + segment.postings
    for step in range(1, width):
        if not len(phrase):
            return none
        offset = rank[phrase, step]
        checked = used[phrase, offset]
        wanted = place[phrase, offset] * total + start + offset
        at = np.minimum(np.searchsorted(listed, wanted - slop), len(listed) - 1)
        met = (listed[at] >= wanted - slop) & (listed[at] <= wanted + slop) & (start + offset + slop >= 0)
        keep = met | ~checked
        phrase, start = phrase[keep], start[keep]
    phrase = possible[phrase]
    last = start + phrases.lengths[phrase] - 1
    inside = (start >= 0) & (last < segment.doc_ends[-1])
    phrase, start, last = phrase[inside], start[inside], last[inside]
    one = np.searchsorted(segment.doc_ends, start, "right") == np.searchsorted(segment.doc_ends, last, "right")
    return phrase[one], start[one]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals, ascending."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1]) if len(starts) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return starts[first], ends[np.append(first[1:] - 1, len(ends) - 1)] if len(first) else ends[:0]


HITS = "segment bigint, ordinal int, starts array<int>, ends array<int>, phrases array<bigint>"


def search(index: DataFrame, phrases: DataFrame, settings: Settings, slop: int = 0) -> DataFrame:
    """Matches of ``phrases`` (key bigint, terms array<bigint>; distinct keys) in all segments.

    One row per block of phrases, segment and document with a match: the matched word ranges, counted from the
    segment's start, and the keys of the phrases found there. A block holds about ``settings.block`` phrases whatever
    their number, so what is broadcast at once is bounded (80 bytes a phrase of ten words).
    """
    spark = index.sparkSession
    count = phrases.count()
    blocks = -(-count // settings.block)
    found = spark.createDataFrame([], HITS)
    for number in range(blocks):
        rows = phrases.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == number).toArrow()
        lists = rows.column("terms").combine_chunks()
        lengths = np.diff(lists.offsets.to_numpy())
        table = np.zeros((len(lengths), max(1, int(lengths.max(initial=1)))), np.int64)
        table[np.arange(table.shape[1]) < lengths[:, None]] = lists.flatten().to_numpy()
        block = spark.sparkContext.broadcast(
            Phrases(rows.column("key").to_numpy(), table.view(np.uint64), lengths.astype(np.int64))
        )

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    segment = Segment.unpacked(row)
                    which, start = find_phrases(segment, block.value, slop)
                    doc = np.searchsorted(segment.doc_ends, start, "right")
                    order = np.argsort(doc, kind="stable")
                    which, start, doc = which[order], start[order], doc[order]
                    cuts = np.flatnonzero(np.diff(doc, prepend=-1))
                    output: list[tuple] = []
                    for low, high in zip(cuts, np.append(cuts[1:], len(doc))):
                        own = which[low:high]
                        lows, highs = merged(start[low:high], start[low:high] + block.value.lengths[own])
                        output.append((int(doc[low]), lows, highs, np.unique(block.value.keys[own])))
                    columns = list(zip(*output)) if output else [[]] * 4
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["segment"]] * len(output), pa.int64()),
                            pa.array(columns[0], pa.int32()),
                            pa.array([x.astype(np.int32) for x in columns[1]], pa.list_(pa.int32())),
                            pa.array([x.astype(np.int32) for x in columns[2]], pa.list_(pa.int32())),
                            pa.array(list(columns[3]), pa.list_(pa.int64())),
                        ],
                        ["segment", "ordinal", "starts", "ends", "phrases"],
                    )

        hits = index.select("segment", "doc_ends", "terms", "term_ends", "postings").mapInArrow(scan, HITS)
        found = hits if blocks == 1 else found.unionByName(hits)
    return found


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """``key``, ``terms`` and ``item_id`` of every window of every item; a key stands for its list of terms."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            words = hashed_words(part.column("text"), PLAIN)
            ids, keys, lists = [], [], []
            for item, low, high in zip(part.column("item_id").to_pylist(), words.bounds[:-1], words.bounds[1:]):
                for start in range(low, max(low + (high > low), high - window + 1)):
                    terms = words.hashes[start : min(high, start + window)]
                    ids.append(item)
                    lists.append(terms.view(np.int64))
                    powers = np.arange(1, len(terms) + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                    keys.append(mixed(np.array([(mixed(terms * powers)).sum()], np.uint64)).view(np.int64)[0])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                ["item_id", "key", "terms"],
            )

    source = items.select(items["item_id"].cast("bigint").alias("item_id"), items["text"])
    return source.mapInArrow(cut, "item_id bigint, key bigint, terms array<bigint>")


RANGES = """
aggregate(
  array_sort(flatten(collect_list(arrays_zip(starts, ends)))),
  named_struct('upto', -1, 'n', 0L),
  (a, x) -> named_struct(
    'upto', greatest(a.upto, x.ends), 'n', a.n + greatest(0, x.ends - greatest(x.starts, a.upto))),
  a -> a.n)
"""


def contamination(documents: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Words of each document that lie in a window of an item, and the items met.

    One row per input row, repeated rows included, with ``doc_id``, ``n_words``, ``n_hit``, ``n_items``,
    ``items_sha256`` (of the distinct item ids, sorted as text and joined by commas), ``contaminated``. Null or empty
    texts have no words and no hits. An item with fewer words than the window is one window; one without words has
    none. Items with a null id or text are not searched; items sharing an id count once. Empty tables give no rows or
    no hits. Extra columns are not read.
    """
    index = build_index(documents, settings)
    listed = index.select(
        "segment", F.posexplode(F.arrays_zip("doc_ids", "doc_ends")).alias("ordinal", "doc"), "doc_ends"
    ).select(
        "segment",
        "ordinal",
        F.col("doc.doc_ids").alias("doc_id"),
        (
            F.col("doc.doc_ends")
            - F.when(F.col("ordinal") > 0, F.expr("doc_ends[ordinal - 1]")).otherwise(F.lit(0))
        )
        .cast("bigint")
        .alias("n_words"),
    )
    windows = write_shared(
        item_windows(items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()), settings.window), "windows"
    )
    phrases = windows.groupBy("key").agg(F.first("terms").alias("terms"))
    hits = write_shared(search(index, phrases, settings), "hits")
    ranges = hits.groupBy("segment", "ordinal").agg(F.expr(RANGES).alias("n_hit"))
    met = (
        hits.select("segment", "ordinal", F.explode("phrases").alias("key"))
        .join(windows.select("key", "item_id").distinct(), "key")
        .groupBy("segment", "ordinal")
        .agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    )
    no_items = F.array().cast("array<string>")
    items_met = F.coalesce("items", no_items)
    return (
        listed.join(ranges, ["segment", "ordinal"], "left")
        .join(met, ["segment", "ordinal"], "left")
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
            F.size(items_met).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(items_met, ",").cast("binary"), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


ORACLE = r"""
with words as (
  select rowid as r, doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') as w
  from (select row_number() over () as rowid, * from documents)),
items as (
  select item_id, list_filter(string_split(regexp_replace(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), lambda w: w <> '') as w
  from benchmark where item_id is not null and text is not null),
windows as (
  select distinct item_id, least(10, len(w)) as n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') as p
  from items, range(0, greatest(1, len(w) - 9)) t(i) where len(w) > 0),
lengths as (select distinct n from windows),
spots as (
  select r, i, n, array_to_string(w[i + 1 : i + n], ' ') as p
  from words, lengths, range(0, len(w) - n + 1) t(i) where len(w) >= n),
hits as (select distinct r, i, s.n, item_id from spots s join windows v on s.n = v.n and s.p = v.p),
covered as (select r, count(distinct i + k) as c from hits, range(0, n) t(k) group by r),
met as (select r, count(distinct item_id) as c, sha256(string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar))) as h from hits group by r)
select doc_id, len(w) as n_words, coalesce(c.c, 0) as n_hit, coalesce(m.c, 0) as n_items,
  coalesce(h, sha256('')) as items_sha256, coalesce(c.c, 0) > 0 as contaminated
from words left join covered c using (r) left join met m using (r)
"""
