"""Runs of periodic word sequences, found with an enhanced suffix array and no suffix tree nodes.

A run is a stretch with smallest period q and at least two periods that cannot be extended. Its last square of period q
branches: the suffixes at the square's start and q words on agree in exactly q words. So for each LCP interval of depth d,
every suffix i of all its children but the largest is tested: a suffix at i + d (or i - d), found through the inverse suffix
array, that lies in the interval but in another child, is a branching tandem repeat. Rotating such a square to the left as
far as words repeat gives the run; squares whose root is itself a power end where the run of the shorter period ends,
lie in it, and are left out.

All steps work on the words of many documents at once. Words are numbered within their document, so that suffixes of
different documents never share a first word and every LCP interval lies in one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import text_slices

RUNS = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
# Words are parted by ASCII white space alone, which is what ``bytes.split`` takes.
WORD = r"[^\x20\x09-\x0D]+"
# Suffixes of children tested at a time.
_AT_ONCE = 4_000_000


@dataclass(frozen=True)
class Settings:
    """A reported run has at least ``least_length`` words and ``least_exponent`` periods."""

    least_length: int = 6
    least_exponent: int = 4
    slice_bytes: int = 1_000_000


class SuffixArray:
    """Suffixes of many texts in one order, their ranks, and common prefixes by doubling.

    ``words`` numbers the words so that equal numbers mean equal words of the same text. ``levels[k]`` ranks the
    positions by their first 2**k words; equal ranks mean equal words, within one text.
    """

    def __init__(self, words: np.ndarray):
        count = len(words)
        order = np.argsort(words, kind="stable").astype(np.int64)
        rank = np.empty(count, np.int32)
        first = np.concatenate([[True], words[order][1:] != words[order][:-1]])[:count]
        rank[order] = _last_true(first)
        self.levels, step = [rank], 1
        # Each round orders the suffixes of still equal rank by the rank that follows ``step`` words on; a rank is the
        # place of its first suffix, so ranks of settled suffixes never change.
        while True:
            ordered = rank[order]
            same = np.concatenate([[False], ordered[1:] == ordered[:-1]])
            open_ = same | np.concatenate([same[1:], [False]])
            at = np.flatnonzero(open_)
            if not len(at):
                break
            suffixes = order[at]
            behind = suffixes + step
            following = np.where(behind < count, rank[np.minimum(behind, count - 1)], -1)
            # The next text's words differ from all words of this one, so looking past the end parts suffixes rightly.
            keys = ordered[at].astype(np.int64) * (count + 1) + following + 1
            by = np.argsort(keys, kind="stable")
            suffixes, keys = suffixes[by], keys[by]
            order[at] = suffixes
            first = np.concatenate([[True], keys[1:] != keys[:-1]])
            rank = rank.copy()
            rank[suffixes] = at[_last_true(first)]
            self.levels.append(rank)
            step *= 2
        self.order, self.rank = order, rank

    def common_prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``a`` and ``b`` (different positions) share at their beginning."""
        count, a, b = len(self.order), a.copy(), b.copy()
        shared = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks, step = self.levels[level], 1 << level
            inside = np.maximum(a, b) < count
            equal = inside & (ranks[np.minimum(a, count - 1)] == ranks[np.minimum(b, count - 1)])
            moved = step * equal
            a, b, shared = a + moved, b + moved, shared + moved
        return shared

    def common_suffix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the prefixes ending before ``a`` and ``b`` share at their end."""
        a, b = a.copy(), b.copy()
        shared = np.zeros(len(a), np.int64)
        for level in range(len(self.levels) - 1, -1, -1):
            ranks, step = self.levels[level], 1 << level
            inside = np.minimum(a, b) >= step
            equal = inside & (ranks[np.maximum(a - step, 0)] == ranks[np.maximum(b - step, 0)])
            moved = step * equal
            a, b, shared = a - moved, b - moved, shared + moved
        return shared


def _last_true(flags: np.ndarray) -> np.ndarray:
    """For each place the last one up to it whose flag is set."""
    return np.maximum.accumulate(np.where(flags, np.arange(len(flags)), 0))


def _smaller_before(values: np.ndarray, or_equal: bool) -> np.ndarray:
    """For each place the last place before it with a smaller (or equal) value, or -1.

    Minima over blocks of doubling size are descended for all places at once, so the time does not depend on the shape.
    """
    count = len(values)
    minima, step = [values], 1
    while 2 * step <= count:
        last = minima[-1]
        minima.append(np.minimum(last[step:], last[: len(last) - step]))
        step *= 2
    at = np.arange(count)  # every place from ``at`` to just before the own one has a larger value
    for level in range(len(minima) - 1, -1, -1):
        step, block = 1 << level, minima[level]
        least = block[np.clip(at - step, 0, len(block) - 1)]
        larger = (least > values) if or_equal else (least >= values)
        at = np.where((at >= step) & larger, at - step, at)
    return at - 1


def lcp_intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Child blocks of all LCP intervals: interval number, depth, interval's first place, and the child's first and last.

    ``lcp[k]`` is the common prefix of the suffixes at places k - 1 and k. Each place with a positive value begins a
    child; the first such place of an interval also ends the interval's first child.
    """
    count = len(lcp)
    places = np.flatnonzero(lcp > 0)
    if not len(places):
        return (np.zeros(0, np.int64),) * 5
    left = _smaller_before(lcp, or_equal=False)[places]  # the interval begins here
    right_equal = count - 1 - _smaller_before(lcp[::-1], or_equal=True)[::-1][places]  # the child ends before
    depth = lcp[places]
    # The places of an interval share its left end and depth.
    order = np.lexsort((places, depth, left))
    first = np.concatenate([[True], (left[order][1:] != left[order][:-1]) | (depth[order][1:] != depth[order][:-1])])
    number = np.empty(len(places), np.int64)
    number[order] = np.cumsum(first) - 1
    begins = np.zeros(len(places), bool)
    begins[order] = first
    return (
        np.concatenate([number, number[begins]]),
        np.concatenate([depth, depth[begins]]),
        np.concatenate([left, left[begins]]),
        np.concatenate([places, left[begins]]),
        np.concatenate([right_equal - 1, places[begins] - 1]),
    )


def branching_squares(suffixes: SuffixArray, least_exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of branching tandem repeats that can end a run of ``least_exponent`` periods.

    A run of e periods puts e suffixes into its interval, so intervals with fewer are not looked at. The largest child
    of an interval is left out, so a suffix is tested at most once for each halving of its text.
    """
    order, rank, count = suffixes.order, suffixes.rank, len(suffixes.order)
    lcp = np.zeros(count, np.int64)
    if count > 1:
        lcp[1:] = suffixes.common_prefix(order[:-1], order[1:])
    number, depth, left, low, high = lcp_intervals(lcp)
    if not len(number):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = high - low + 1
    whole = np.bincount(number, size).astype(np.int64)
    largest = np.lexsort((-size, number))
    largest = largest[np.concatenate([[True], number[largest][1:] != number[largest][:-1]])]
    wanted = whole[number] >= least_exponent
    wanted[largest] = False
    depth, left, low, size = depth[wanted], left[wanted], low[wanted], size[wanted]
    right = left + whole[number[wanted]] - 1
    starts, periods = [], []
    # A bounded number of suffixes at a time, and one child at least.
    group = (np.cumsum(size) - 1) // _AT_ONCE
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(size)]]) if len(size) else []
    for a, b in zip(cuts[:-1], cuts[1:]):
        of = np.repeat(np.arange(a, b), size[a:b])
        place = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b])
        suffix, by = order[place], depth[of]
        for other, start in ((suffix + by, suffix), (suffix - by, suffix - by)):
            inside = (other >= 0) & (other < count)
            there = rank[np.clip(other, 0, count - 1)]
            inside &= (there >= left[of]) & (there <= right[of])
            inside &= (there < low[of]) | (there >= low[of] + size[of])
            starts.append(start[inside])
            periods.append(by[inside])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A square may be found from both of its suffixes.
    found = np.unique(np.concatenate(periods) * count + np.concatenate(starts))
    return found % count, found // count


def find_runs(words: np.ndarray, least_length: int, least_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start``, ``length`` and smallest ``period`` of all runs of the numbered words, by start, then period."""
    none = np.zeros(0, np.int64)
    if len(words) < 2:
        return none, none, none
    suffixes = SuffixArray(words)
    start, period = branching_squares(suffixes, least_exponent)
    end = start + 2 * period
    order = np.lexsort((period, end))
    start, period, end = start[order], period[order], end[order]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    # Of the squares with one end, the shortest is rotated to its run; multiples of its period within the run follow
    # from it. Each round leaves squares that reach further left than all runs before, so there are few rounds.
    while len(start):
        first = np.concatenate([[True], end[1:] != end[:-1]])
        begins = start[first] - suffixes.common_suffix(start[first], start[first] + period[first])
        found.append((begins, end[first], period[first]))
        of = np.cumsum(first) - 1
        inside = (period % period[first][of] == 0) & (start >= begins[of])
        left = ~inside
        start, period, end = start[left], period[left], end[left]
    begins, ends, periods = (np.concatenate(x) for x in zip(*found)) if found else (none, none, none)
    lengths = ends - begins
    kept = (lengths >= least_length) & (lengths >= least_exponent * periods)
    begins, lengths, periods = begins[kept], lengths[kept], periods[kept]
    order = np.lexsort((periods, begins))
    return begins[order], lengths[order], periods[order]


def numbered_words(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray]:
    """Each text's words, numbers of all words (told apart by text), and where each text's words begin."""
    words = [x.split() for x in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in words], dtype=np.int64)]).astype(np.int64)
    flat = pa.chunked_array([pa.array(x, pa.binary()) for x in words] or [pa.array([], pa.binary())])
    codes = flat.combine_chunks().dictionary_encode()
    numbers = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(words)), np.diff(bounds))
    return words, owner * max(1, len(codes.dictionary)) + numbers, bounds


def repeated_runs(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (by start, then period) and ``collapsed``: the words with repeats taken out.

    A word is taken out if it stands in a run after the run's first period; the others are joined by one space. One row
    per input row. A null text, or one without words, has no runs and an empty ``collapsed``. A null doc_id stays null.
    Texts of any length are treated whole; equal rows give equal rows. An empty table gives no rows. Extra columns are
    not read.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most_bytes=settings.slice_bytes):
            texts = [(x or "").encode() for x in part.column("text").to_pylist()]
            words, numbers, bounds = numbered_words(texts)
            begins, lengths, periods = find_runs(numbers, settings.least_length, settings.least_exponent)
            limits = np.searchsorted(begins, bounds)
            owner = np.searchsorted(bounds, begins, "right") - 1
            change = np.zeros(len(numbers) + 1, np.int64)
            np.add.at(change, begins + periods, 1)
            np.add.at(change, begins + lengths, -1)
            dropped = np.cumsum(change[:-1]) > 0
            collapsed = []
            for at, own in enumerate(words):
                if limits[at] < limits[at + 1]:
                    kept = ~dropped[bounds[at] : bounds[at + 1]]
                    own = [own[x] for x in np.flatnonzero(kept)]
                collapsed.append(b" ".join(own))
            rows = pa.StructArray.from_arrays(
                [pa.array(x, pa.int64()) for x in (begins - bounds[owner], lengths, periods)],
                ["start", "length", "period"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(np.diff(bounds), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(limits, pa.int32()), rows),
                    pa.array(collapsed, pa.binary()).cast(pa.string()),
                ],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    source = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"])
    return source.mapInArrow(find, RUNS)


def planted_text(doc_id: Column, text: Column) -> Column:
    """The text of every tenth document (by a hash of its id) made periodic from some word on; others as they are.

    With h = crc32(doc_id), g = h div 10 and n words, word i >= a becomes word a + (i - a) % p, where a = g % n and
    p = 1 + (n - a) div (3 + g % 8). A null doc_id counts as the empty text.
    """
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def plant(own: Column) -> Column:
        n, g = F.size(own), F.floor(h / 10)
        a = g % F.greatest(n, F.lit(1))
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        picked = F.transform(own, lambda _, i: F.get(own, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n == 0, text).otherwise(F.array_join(picked, " "))

    # The words are bound once, as a list of one element.
    made = F.get(F.transform(F.array(words), plant), F.lit(0))
    return F.when(h % 10 == 0, made).otherwise(text)


def run_digests(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Runs of all documents after planting: their number, the greatest (ties: first, then shortest period), digests."""
    planted = documents.select(
        documents["doc_id"], planted_text(documents["doc_id"], documents["text"]).alias("text")
    )
    found = repeated_runs(planted, settings)
    best = F.reduce(
        F.col("runs"),
        F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"),
        lambda held, x: F.when(held.isNull() | (x["length"] > held["length"]), x).otherwise(held),
    )
    spelled = F.array_join(
        F.transform("runs", lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), ""
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(spelled.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
