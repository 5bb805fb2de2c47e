"""Token alignment of two vocabularies: which tokens of one cover bytes of the other, and where both end a token.

Texts are encoded with a byte-level vocabulary (A) and a piece vocabulary with byte fallback (B), part by part, and every
part once while it is met often. Alignment is two ``merge_asof`` passes keyed by document over a batch: each token start
finds the other side's covering token; the union of both directions is every pair of tokens whose byte ranges overlap.

How many documents of the corpus hold a pair of ids is counted from block dictionaries: a block of documents names each of
its pairs once with its number of documents, so the shuffled rows of the commonest pair are one a block. The counts
return to the blocks, which hold their documents' pairs as packed indexes into the block's dictionary.
"""

from __future__ import annotations

import hashlib
import os
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.errors import ConfigurationError
from siltstone.llm.pretokens import Remembered, id_bytes, pre_tokens
from siltstone.llm.shared import text_slices, write_shared

BLOCKS = (
    "shard int, block int, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
    "n_links array<bigint>, groups_sha256 array<string>, pairs array<bigint>, holders array<bigint>, "
    "entries array<bigint>, payload binary"
)
ALIGNED = (
    "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
    "groups_sha256 string"
)

# A pair of ids in one number: the A id above the B id, either below 2**20.
_B_BITS, _PAIR_BITS = 20, 40


@dataclass(frozen=True)
class Settings:
    """``bytes_file``: A, a byte-level vocabulary in one file; ``pieces_file``: B, a piece model with byte fallback."""

    bytes_file: str
    pieces_file: str
    block_bytes: int = 2_000_000
    remembered: int = 200_000


def _byte_letters() -> dict[str, int]:
    """The printable letter that a byte-level vocabulary writes for each byte: printable bytes stand for themselves,
    the others, in ascending order, for the code points from 256."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [x for x in range(256) if x not in printable]
    return {chr(x): x for x in printable} | {chr(256 + at): x for at, x in enumerate(others)}


@dataclass
class Side:
    """One vocabulary: ``parts_of`` cuts a text, ``known`` gives coded ids of parts, ``spelled`` the bytes of every id."""

    parts_of: Callable[[str], list[str]]
    known: Remembered
    spelled: pa.Array
    lengths: np.ndarray


    def coded(self, texts: list[str]) -> list[bytes]:
        return self.known.coded([self.parts_of(x) for x in texts])


def _side(
    parts_of: Callable[[str], list[str]], code: Callable[[list[str]], Iterator[bytes]], most: int, spelled: list[bytes]
) -> Side:
    lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
    return Side(parts_of, Remembered(code, most), pa.array(spelled, pa.binary()), lengths)


def byte_side(settings: Settings) -> Side:
    """A: matches of the pattern, each encoded by the library; a special token's string is ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(settings.bytes_file)
    library.encode_special_tokens = True
    letters = _byte_letters()
    spelled = [b""] * (max(library.get_vocab().values()) + 1)
    for token, number in library.get_vocab(with_added_tokens=False).items():
        spelled[number] = bytes(letters[x] for x in token)

    def code(parts: list[str]) -> Iterator[bytes]:
        return (id_bytes(x.ids) for x in library.encode_batch_fast(parts, add_special_tokens=False))

    return _side(pre_tokens, code, settings.remembered, spelled)


def _seams(pieces: list[str]) -> re.Pattern:
    """Parts of a text that no merge of the piece vocabulary crosses.

    A merge joins two neighbours into a piece, so it never crosses two characters that no piece has next to each other.
    Parts end before a space that follows another character, around line ends and tabs, and before those marks that
    no piece has after an ASCII letter.
    """
    neighbours = {pair for piece in pieces for pair in zip(piece, piece[1:])}
    if any(b in "▁\n\t" and a != "▁" or a in "\n\t" for a, b in neighbours):
        raise ConfigurationError("the piece vocabulary joins words or lines, so texts cannot be encoded in parts")
    marks = "".join(x for x in ",.;:!?" if not any((a, x) in neighbours for a in string.ascii_letters))
    inner = rf"(?:[^ \n\t{marks}]|(?<![A-Za-z])[{marks}])*" if marks else r"[^ \n\t]*"
    # The rest of a word begins with such a mark, or follows a line end or tab.
    return re.compile(rf" +{inner}|[^ \n\t]{inner}|[\n\t]")


def piece_side(settings: Settings) -> Side:
    """B, part by part. The library puts a space before what it encodes: a part that begins with spaces gives one of
    them up, any other is encoded after a line end."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=settings.pieces_file)
    pieces = [library.id_to_piece(x) for x in range(library.get_piece_size())]
    joined = [x for at, x in enumerate(pieces) if not (library.is_byte(at) or library.is_control(at))]
    spelled = [
        bytes([int(x[3:5], 16)]) if library.is_byte(at) else x.replace("▁", " ").encode()
        for at, x in enumerate(pieces)
    ]
    space, parts_of = library.piece_to_id("▁"), _seams(joined).findall

    def code(parts: list[str]) -> Iterator[bytes]:
        given = [x[1:] if x.startswith(" ") else "\n" + x for x in parts]
        for part, ids in zip(parts, library.encode(given, num_threads=1) if given else []):
            yield id_bytes([space] if part == " " else ids if part.startswith(" ") else ids[2:])

    return _side(parts_of, code, settings.remembered, spelled)


@cache
def sides_of(settings: Settings) -> tuple[Side, Side]:
    """Both vocabularies, held by a worker process for all its tasks."""
    return byte_side(settings), piece_side(settings)


def _buffer(strings: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and joined bytes of an array of strings or binaries."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32, len(strings) + 1, strings.offset * 4)
    data = strings.buffers()[2]
    return offsets, memoryview(data).cast("B") if data is not None else memoryview(b"")


@dataclass
class Tokens:
    """Tokens of many parts in order: part number, id, and where their bytes begin, counted through all parts."""

    part: np.ndarray
    ids: np.ndarray
    start: np.ndarray


def _tokens(coded: list[bytes], side: Side, bases: np.ndarray) -> Tokens:
    counts = np.fromiter((len(x) // 4 for x in coded), np.int64, len(coded))
    ids = np.frombuffer(b"".join(coded), "<u4").astype(np.int64)
    part = np.repeat(np.arange(len(coded)), counts)
    lengths = side.lengths[ids]
    ends = np.cumsum(lengths)
    # Ranges are counted from each part's own base, so that one side's wrong bytes cannot shift a later part.
    before = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])[:-1]]
    return Tokens(part, ids, ends - lengths + np.repeat(bases - before, counts))


def _spelled_right(tokens: Tokens, side: Side, texts: list[bytes]) -> np.ndarray:
    """Which parts' tokens spell the part."""
    offsets, data = _buffer(side.spelled.take(pa.array(tokens.ids, pa.uint32())))
    limits = offsets[np.searchsorted(tokens.part, np.arange(len(texts) + 1))]
    return np.array([data[low:high] == x for low, high, x in zip(limits[:-1], limits[1:], texts)], bool)


@dataclass
class Links:
    """Positions (in A's tokens, in B's) of all overlapping pairs, and which tokens of each side begin where the other's do."""

    a: np.ndarray
    b: np.ndarray
    shared_a: np.ndarray
    shared_b: np.ndarray


def covering_links(a: Tokens, b: Tokens) -> Links:
    """All pairs of tokens that overlap.

    Tokens of a part follow each other without gaps, so two tokens overlap where one's start lies in the other. Each
    start finds the covering token; pairs that both directions find have equal starts and are kept once.
    """
    left = pd.DataFrame({"part": a.part, "at": a.start, "a": np.arange(len(a.ids))})
    right = pd.DataFrame({"part": b.part, "at": b.start, "b": np.arange(len(b.ids))})
    covering_b = pd.merge_asof(left, right, on="at", by="part")["b"].to_numpy(np.int64)
    covering_a = pd.merge_asof(right, left, on="at", by="part")["a"].to_numpy(np.int64)
    shared_a, shared_b = b.start[covering_b] == a.start, a.start[covering_a] == b.start
    inner = np.flatnonzero(~shared_b)
    return Links(
        np.concatenate([left["a"].to_numpy(), covering_a[inner]]), np.concatenate([covering_b, inner]), shared_a, shared_b
    )


@cache
def _number_table(size: int) -> pa.Array:
    """Every id in decimal with each of the marks that can follow it: a comma, a bar, a semicolon."""
    return pa.array([f"{x}{mark}" for x in range(size) for mark in ",|;"])


def group_texts(a: Tokens, b: Tokens, links: Links, size: int) -> tuple[np.ndarray, memoryview, np.ndarray]:
    """The groups' spelling ``a1,a2|b1;a3|b2,b3;``: offsets and bytes by token in written order, and each token's part.

    A group begins where tokens of both sides do, which is where the groups before it end on both sides.
    """
    count_a, count_b = len(a.ids), len(b.ids)
    first_a = np.append(np.flatnonzero(links.shared_a), count_a)
    first_b = np.append(np.flatnonzero(links.shared_b), count_b)
    # Of a group, all tokens of A are written before those of B.
    place_a = np.arange(count_a) + first_b[np.cumsum(links.shared_a) - 1]
    place_b = np.arange(count_b) + first_a[np.cumsum(links.shared_b)]
    codes, part = np.empty(count_a + count_b, np.int64), np.empty(count_a + count_b, np.int64)
    codes[place_a], codes[place_b] = 3 * a.ids, 3 * b.ids
    codes[place_a[first_a[1:] - 1]] += 1
    codes[place_b[first_b[1:] - 1]] += 2
    part[place_a], part[place_b] = a.part, b.part
    offsets, data = _buffer(_number_table(size).take(pa.array(codes)))
    return offsets, data, part


def _parts_of(text: str, most: int) -> list[str]:
    """A long text with its leading space in parts, each beginning where both vocabularies begin a token.

    That is a single space between two other characters that are no white space. A text without one stays whole.
    """
    full, parts, start = " " + text, [], 0
    if len(full) <= most:
        return [full]
    seam = re.compile(r"(?<=\S) (?=\S)")
    while len(full) - start > most and (found := seam.search(full, start + most)):
        parts.append(full[start : found.start()])
        start = found.start()
    return [*parts, full[start:]]


class Block:
    """What a block of documents adds up to, part by part."""

    def __init__(self, count: int, settings: Settings):
        self.settings = settings
        self.sums = np.zeros((4, count), np.int64)  # n_a, n_b, n_groups, n_links
        self.digests = [hashlib.sha256() for _ in range(count)]
        self.open = np.zeros(count, bool)
        self.wrong = np.zeros(count, bool)
        self.keys = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def add(self, parts: list[tuple[int, str]]) -> None:
        """Align parts; a document's parts come in order."""
        a_side, b_side = sides_of(self.settings)
        owner = np.array([x for x, _ in parts], np.int64)
        texts = [x.encode() for _, x in parts]
        bases = np.cumsum([0, *map(len, texts)])[:-1].astype(np.int64)
        a, b = (_tokens(side.coded([x for _, x in parts]), side, bases) for side in (a_side, b_side))
        right = _spelled_right(a, a_side, texts) & _spelled_right(b, b_side, texts)
        if not right.all():
            self.wrong[owner[~right]] = True
            a, b = (Tokens(*(x[right[t.part]] for x in (t.part, t.ids, t.start))) for t in (a, b))
        links = covering_links(a, b)
        linked = a.part[links.a]
        for row, part in enumerate((a.part, b.part, a.part[links.shared_a], linked)):
            np.add.at(self.sums[row], owner, np.bincount(part, minlength=len(parts)))
        size = max(len(a_side.lengths), len(b_side.lengths))
        offsets, data, part = group_texts(a, b, links, size)
        limits = offsets[np.searchsorted(part, np.arange(len(parts) + 1))]
        for document, low, high in zip(owner.tolist(), limits[:-1].tolist(), limits[1:].tolist()):
            if low < high:
                if self.open[document]:
                    self.digests[document].update(b";")
                self.digests[document].update(data[low : high - 1])
                self.open[document] = True
        # A document's number in its block and two ids take less than 63 bits.
        pairs = a.ids[links.a] << _B_BITS | b.ids[links.b]
        keys, times = np.unique(owner[linked] << _PAIR_BITS | pairs, return_counts=True)
        if len(self.keys):
            keys, where = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
            times = np.bincount(where, np.concatenate([self.times, times])).astype(np.int64)
        self.keys, self.times = keys, times

    def row(self, doc_ids: pa.Array, shard: int, number: int) -> pa.RecordBatch:
        """The block as one row; a document whose bytes differ counts as one without tokens."""
        self.sums[:, self.wrong] = 0
        kept = ~self.wrong[self.keys >> _PAIR_BITS]
        keys, times = self.keys[kept], self.times[kept]
        pairs, index, holders = np.unique(keys & ((1 << _PAIR_BITS) - 1), return_inverse=True, return_counts=True)
        entries = np.bincount(keys >> _PAIR_BITS, minlength=len(doc_ids))
        payload = np.concatenate([index, times]).astype("<u4")
        shown = [x.hexdigest() if n else "" for x, n in zip(self.digests, self.sums[0])]
        bigints = pa.list_(pa.int64())
        return pa.RecordBatch.from_pydict(
            {
                "shard": pa.array([shard], pa.int32()),
                "block": pa.array([number], pa.int32()),
                "doc_ids": pa.array([doc_ids.to_pylist()], bigints),
                **{
                    name: pa.array([self.sums[row]], bigints)
                    for row, name in enumerate(("n_a", "n_b", "n_groups", "n_links"))
                },
                "groups_sha256": pa.array([shown], pa.list_(pa.string())),
                "pairs": pa.array([pairs], bigints),
                "holders": pa.array([holders], bigints),
                "entries": pa.array([entries], bigints),
                "payload": pa.array([_packed(payload)], pa.binary()),
            }
        )


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, so that their mostly zero high bytes take no room."""
    return zstandard.compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpacked(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(payload), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def aligned_blocks(documents: DataFrame, settings: Settings) -> DataFrame:
    """The written blocks: per document the counts and the digest of its groups, and all its pairs of ids."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, most = TaskContext.get().partitionId(), 0, settings.block_bytes
        for rows in text_slices(batches, most_bytes=most):
            texts = rows.column("text").to_pylist()
            block, parts, held = Block(len(texts), settings), [], 0
            for at, text in enumerate(texts):
                # A text with the mark that B writes for a space cannot be spelled by B.
                for part in _parts_of(text, most) if text and "▁" not in text else ():
                    parts.append((at, part))
                    held += len(part)
                    if held >= most:
                        block.add(parts)
                        parts, held = [], 0
            if parts:
                block.add(parts)
            yield block.row(rows.column("doc_id"), shard, number)
            number += 1

    source = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"])
    return write_shared(source.mapInArrow(align, BLOCKS), "aligned-blocks", compression="zstd")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair`` of ids, ``n_docs`` that hold it linked, and whether it is its A id's ``best``."""
    held = blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("x")).select("x.pairs", "x.holders")
    counts = held.groupBy(F.col("pairs").alias("pair")).agg(F.sum("holders").alias("n_docs"))
    # An A id has at most as many pairs as B has ids.
    of_a = Window.partitionBy(F.shiftright("pair", _B_BITS))
    return counts.select("pair", "n_docs", (F.col("n_docs") == F.max("n_docs").over(of_a)).alias("best"))


def _with_counts(key: tuple, blocks: pa.Table, counts: pa.Table) -> pa.Table:
    row = blocks.to_pylist()[0]
    counts = counts.sort_by("pair")
    if counts.column("pair").to_pylist() != row["pairs"]:
        raise ConfigurationError(f"block {key} lacks counts of its pairs")
    n_docs = counts.column("n_docs").to_numpy().astype(np.int64)
    best = counts.column("best").to_numpy(zero_copy_only=False).astype(np.int64)
    index, times = np.split(_unpacked(row["payload"]), 2)
    owner = np.repeat(np.arange(len(row["doc_ids"])), row["entries"])
    sums = []
    for values in (best, n_docs):
        total = np.zeros(len(row["doc_ids"]), np.int64)
        np.add.at(total, owner, times * values[index])
        sums.append(pa.array(total, pa.int64()))
    given = [pa.array(row[x], pa.int64()) for x in ("doc_ids", "n_a", "n_b", "n_groups", "n_links")]
    return pa.Table.from_arrays(
        [*given, *sums, pa.array(row["groups_sha256"], pa.string())], [x.split()[0] for x in ALIGNED.split(", ")]
    )


def align_documents(documents: DataFrame, settings: Settings) -> DataFrame:
    """Per document the tokens of both sides, groups, links, and how common its linked id pairs are in the corpus.

    One row per input row; repeated rows are documents of their own in every count. A null or empty text, and one whose
    tokens do not spell a space and the text, has zeros and an empty ``groups_sha256``. A null doc_id stays null. Texts of
    any length are aligned whole, long ones in parts that begin where both sides begin a token. An empty table gives no
    rows. Extra columns are not read.
    """
    blocks = aligned_blocks(documents, settings)
    named = blocks.select(
        F.col("shard").alias("of_shard"), F.col("block").alias("of_block"), F.explode("pairs").alias("pair")
    )
    found = named.join(pair_counts(blocks), "pair")
    return (
        blocks.drop("holders")
        .groupBy("shard", "block")
        .cogroup(found.groupBy("of_shard", "of_block"))
        .applyInArrow(_with_counts, ALIGNED)
    )
