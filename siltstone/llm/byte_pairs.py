"""Byte-level BPE of whole texts: chunks pre-tokenised in parallel, stitched, encoded; decoding joins raw bytes.

A text beyond ``chunk_chars`` is cut into chunks, each seen with ``overlap_chars`` of the next. The pattern looks only
ahead, so two chunks that share one boundary of pre-tokens agree on all that follows. Each chunk is pre-tokenised by
itself, wherever it lies; the first boundary that a chunk and its successor share within their overlap is the cut
between them. Where they share none (one pre-token longer than the overlap), the chunks are joined into one run and
pre-tokenised together. Then the runs are encoded, each in its own task, and joined by document.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.errors import ValidationError
from siltstone.llm.pretokens import Remembered, id_bytes, pre_token_ends, pre_tokens
from siltstone.llm.shared import text_slices, write_shared

ENCODED = "doc_id bigint, n_tokens bigint, ids binary"
# The longest look ahead of the pattern past the end of a match: the two letters of a contraction.
_AHEAD = 2


@dataclass(frozen=True)
class Settings:
    """``ranks``: path of the rank file; ``remembered``: distinct pre-tokens whose ids a worker keeps."""

    ranks: str
    chunk_chars: int = 16_384
    overlap_chars: int = 512
    remembered: int = 300_000


@cache
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers, pre-token by pre-token."""

    def __init__(self, settings: Settings):
        # The library merges the bytes of one pre-token by rank; the pattern is not used here.
        self.library = tiktoken.Encoding(
            "ranks", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(settings.ranks), special_tokens={}
        )
        self.known = Remembered(self._merged, settings.remembered)

    def _merged(self, parts: list[str]) -> Iterator[bytes]:
        return (id_bytes(self.library.encode_ordinary(x)) for x in parts)

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.known.coded([pre_tokens(x) for x in texts])


@cache
def encoder_of(settings: Settings) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(settings)


@cache
def _token_bytes(path: str) -> pa.Array:
    """The bytes of every id; an id without a rank is null."""
    ranks = read_ranks(path)
    known = {rank: token for token, rank in ranks.items()}
    return pa.array([known.get(x) for x in range(max(known) + 1)], pa.binary())


def joined_bytes(ids: np.ndarray, path: str) -> bytes:
    """The raw bytes of the ids, one after the other."""
    if not len(ids):
        return b""
    table = _token_bytes(path)
    if int(ids.max()) >= len(table):
        raise ValidationError(f"id {int(ids.max())} has no bytes in the vocabulary")
    taken = table.take(pa.array(ids, pa.uint32()))
    if taken.null_count:
        raise ValidationError("an id has no bytes in the vocabulary")
    ends = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4)
    return taken.buffers()[2][int(ends[0]) : int(ends[-1])].to_pybytes()


def _cut(settings: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A row per chunk: its own characters and the overlap with the next."""
    size, more = settings.chunk_chars, settings.overlap_chars

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                digest = hashlib.sha256(text.encode()).hexdigest()
                for low in range(0, len(text), 64 * size):  # rows of a long text leave some chunks at a time
                    starts = range(low, min(low + 64 * size, len(text)), size)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array([doc_id] * len(starts), pa.int64()),
                            "digest": pa.array([digest] * len(starts)),
                            "chunk": pa.array([x // size for x in starts], pa.int32()),
                            "last": pa.array([x + size >= len(text) for x in starts]),
                            "piece": pa.array([text[x : x + size + more] for x in starts]),
                        }
                    )

    return cut


def _boundaries(settings: Settings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each chunk: boundaries shared with the chunk before (``head``) and the next (``tail``), from where they overlap.

    A boundary nearer to a chunk's visible end than the pattern looks ahead may be an effect of the cut and is left out.
    """
    size, more = settings.chunk_chars, settings.overlap_chars

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, tails = [], []
            for piece, last in zip(batch.column("piece").to_pylist(), batch.column("last").to_pylist()):
                surely = len(piece) if last else len(piece) - _AHEAD
                ends = [x for x in [0, *pre_token_ends(piece)] if x <= surely]
                heads.append([x for x in ends if x < more])
                tails.append([x - size for x in ends if x >= size])
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(x) for x in ("doc_id", "digest", "chunk", "copies")),
                    pa.array(heads, pa.list_(pa.int32())),
                    pa.array(tails, pa.list_(pa.int32())),
                ],
                ["doc_id", "digest", "chunk", "copies", "head", "tail"],
            )

    return find


def stitches(chunks: DataFrame, settings: Settings) -> DataFrame:
    """For every chunk its ``run``, and where its run begins (``low``, in the first chunk) and ends (``high``, in the last).

    A cut is the first boundary that a chunk's tail and the next one's head share; a chunk without one belongs to the
    run of the chunk before. Only boundaries within overlaps are shuffled by document, no text.
    """
    marks = chunks.mapInArrow(
        _boundaries(settings),
        "doc_id bigint, digest string, chunk int, copies bigint, head array<int>, tail array<int>",
    )
    ordered = Window.partitionBy("doc_id", "digest").orderBy("chunk")
    before = F.array_min(F.array_intersect(F.lag("tail").over(ordered), "head"))
    cuts = marks.select(
        "doc_id", "digest", "chunk", "copies", F.when(F.col("chunk") == 0, F.lit(0)).otherwise(before).alias("low")
    )
    return cuts.select(
        "doc_id",
        "digest",
        "chunk",
        "copies",
        "low",
        F.count("low").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.lead("low").over(ordered).alias("high"),
    )


def _encode_runs(settings: Settings) -> Callable[[pa.Table], pa.Table]:
    size = settings.chunk_chars

    def encode(group: pa.Table) -> pa.Table:
        rows = group.sort_by("chunk").select(["doc_id", "digest", "run", "piece", "low", "high", "last"]).to_pylist()
        first, last = rows[0], rows[-1]
        text = "".join(x["piece"][:size] for x in rows[:-1]) + last["piece"]
        high = None if last["last"] else size * len(rows) + last["high"]
        # The characters past the end are seen, so that the last pre-tokens are those of the whole text.
        seen = text[first["low"] :] if high is None else text[first["low"] : high + _AHEAD]
        wanted = len(seen) if high is None else high - first["low"]
        parts, held = [], 0
        for part in pre_tokens(seen):
            if held >= wanted:
                break
            parts.append(part)
            held += len(part)
        if held != wanted:
            raise ValidationError(f"document {first['doc_id']}: chunks do not meet at the end of run {first['run']}")
        ids = encoder_of(settings).known.coded([parts])[0]
        return pa.table(
            {
                "doc_id": pa.array([first["doc_id"]], pa.int64()),
                "digest": [first["digest"]],
                "run": pa.array([first["run"]], pa.int64()),
                "copies": pa.array([group.column("copies")[0].as_py()], pa.int64()),
                "ids": pa.array([ids], pa.binary()),
            }
        )

    return encode


def _join_runs(group: pa.Table) -> pa.Table:
    ordered = group.sort_by("run")
    ids = b"".join(ordered.column("ids").to_pylist())
    return pa.table(
        {
            "doc_id": ordered.column("doc_id").slice(0, 1),
            "copies": ordered.column("copies").slice(0, 1),
            "n_tokens": pa.array([len(ids) // 4], pa.int64()),
            "ids": pa.array([ids], pa.binary()),
        }
    )


def encode_documents(documents: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit integers) of every text.

    One row per input row, repeated rows included. A null or empty text has no ids. A null doc_id stays null. Texts of
    any length are encoded whole: those of more than a chunk and its overlap as chunks in several tasks. An empty table
    gives no rows. Extra columns are not read.
    """
    source = documents.select(
        documents["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(documents["text"], F.lit("")).alias("text")
    )
    most = settings.chunk_chars + settings.overlap_chars

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(settings)
        for part in text_slices(batches):
            coded = encoder.encode(part.column("text").to_pylist())
            counts = pa.array([len(x) // 4 for x in coded], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), counts, pa.array(coded, pa.binary())], ["doc_id", "n_tokens", "ids"]
            )

    short = source.where(F.length("text") <= most).mapInArrow(encode, ENCODED)
    cut = source.where(F.length("text") > most).mapInArrow(
        _cut(settings), "doc_id bigint, digest string, chunk int, last boolean, piece string"
    )
    # Chunks are dealt out by document and number; repeated rows become one with a count.
    chunks = write_shared(
        cut.groupBy("doc_id", "digest", "chunk").agg(
            F.first("last").alias("last"), F.first("piece").alias("piece"), F.count("*").alias("copies")
        ),
        "text-chunks",
    )
    found = stitches(chunks, settings).toDF(*(f"at_{x}" for x in ("doc", "digest", "chunk", "copies", "low", "run", "high")))
    located = chunks.join(
        found,
        F.col("doc_id").eqNullSafe(F.col("at_doc"))
        & (F.col("digest") == F.col("at_digest"))
        & (F.col("chunk") == F.col("at_chunk")),
    ).select(
        "doc_id", "digest", "chunk", "last", "piece", "copies",
        F.col("at_low").alias("low"), F.col("at_run").alias("run"), F.col("at_high").alias("high"),
    )
    runs = located.groupBy("doc_id", "digest", "run").applyInArrow(
        _encode_runs(settings), "doc_id bigint, digest string, run bigint, copies bigint, ids binary"
    )
    whole = runs.groupBy("doc_id", "digest").applyInArrow(
        _join_runs, "doc_id bigint, copies bigint, n_tokens bigint, ids binary"
    )
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    long = whole.select("doc_id", "n_tokens", "ids", copies.alias("copy")).drop("copy")
    return short.unionByName(long)


def decode_documents(encoded: DataFrame, settings: Settings) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of all ids in order. An id outside the vocabulary is an error."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                texts = [
                    joined_bytes(np.frombuffer(x or b"", "<u4"), settings.ranks) for x in part.column("ids").to_pylist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"]
                )

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decode, f"{ENCODED}, decoded binary")


def encoding_digests(documents: DataFrame, settings: Settings) -> DataFrame:
    """Per document the number of ids, and digests of the ids and of the bytes they decode to."""
    decoded = decode_documents(encode_documents(documents, settings), settings)
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
