"""Token ids of documents in files: every document compressed by itself, with one dictionary shared by all.

A file set is two Parquet tables. ``dictionary`` holds the shared zstandard dictionary, trained on a bounded sample of
serialized id arrays, with its sha256. ``blocks`` holds one row per block of documents in ascending order of doc_id:
shard and block number, dictionary hash, width of an id in bytes, the documents' ids and token counts, the offset index
(where each document's frame ends in the payload) and the payload of concatenated frames. A short document is read by
its block's id range, one slice of the payload and the dictionary, without touching its neighbours.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.shared import text_slices, write_shared
from siltstone.session import task_count

BLOCKS = (
    "shard int, block int, dictionary_sha256 string, width int, first_doc bigint, last_doc bigint, "
    "doc_ids array<bigint>, counts array<bigint>, ends array<bigint>, payload binary"
)

# White space of the tokenizer's pattern; Python's split() also takes the four separators 1C to 1F.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = "\x1c\x1d\x1e\x1f"
# Marks that end a word; the pattern parts them from a letter before them.
_MARKS = re.compile(r"([,.;:!?%&#*$@](?<=[a-zß-öø-ÿ].)[,.;:!?%&#*$@]*)(?=[ \t\n\r]|\Z)")


@dataclass(frozen=True)
class Settings:
    """``tokenizer``: path of the vocabulary file; ``end``: id after each document."""

    tokenizer: str
    end: int = 1
    dictionary_bytes: int = 64 * 1024
    sample_documents: int = 1024
    sample_chars: int = 4000
    block_bytes: int = 2_000_000
    level: int = 3
    remembered: int = 200_000


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts as little-endian bytes.

    The vocabulary's pattern never joins characters across white space, nor a letter and a mark, and its normalizer
    lower-cases, so a text's ids are those of its parts in order, with A to Z lower-cased; every distinct part is encoded
    once and remembered. Words of letters alone are encoded many at a time and told apart by their last token, which is
    the only one that ends a word. When ``remembered`` parts are known they become the older ones, of which those met again are
    taken over; so at most twice as many are held, and frequent parts are never forgotten. A text that may hold a special
    token's own string is encoded whole.
    """

    def __init__(self, settings: Settings):
        self.tokenizer = _tokenizer(settings.tokenizer)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remembered = settings.remembered
        self.end = np.array([settings.end], self.kind).tobytes()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[number for token, number in vocabulary.items() if token.endswith("</w>")]] = True

    def _learn(self, parts: set[str]) -> None:
        new = parts.difference(self.known)
        if len(self.known) + len(new) > self.remembered:
            self.older, self.known, new = self.known, {}, parts
        again = new.intersection(self.older)
        self.known.update((x, self.older[x]) for x in again)
        fresh = new.difference(again)
        words = [x for x in fresh if x.isalpha()]
        for low in range(0, len(words), 50):
            group = words[low : low + 50]
            ids = np.array(self.tokenizer.encode(" ".join(group), add_special_tokens=False).ids, self.kind)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(group):  # a letter that lower-casing takes apart
                continue
            coded, ends = ids.tobytes(), (ends * self.kind.itemsize).tolist()
            self.known.update((x, coded[low:high]) for x, low, high in zip(group, [0, *ends], ends))
        others = list(fresh.difference(self.known))
        for part, coded in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            self.known[part] = np.array(coded.ids, self.kind).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text and the end id; a null text is empty."""
        cut: list[list[str] | None] = []
        parts: set[str] = set()
        for text in texts:
            text = text or ""
            plain = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
            if any(x in plain for x in self.special):
                cut.append(None)
                continue
            plain = _MARKS.sub(r" \1", plain)
            own = _SPACE.split(plain) if any(x in plain for x in _SEPARATORS) else plain.split()
            cut.append(own)
            parts.update(own)
        self._learn(parts)
        return [
            b"".join(map(self.known.__getitem__, own)) + self.end
            if own is not None
            else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes() + self.end
            for text, own in zip(texts, cut)
        ]


@cache
def encoder_of(settings: Settings) -> Encoder:
    """One encoder for all tasks of a worker process, so that what it remembers serves the next task."""
    return Encoder(settings)


def train_dictionary(documents: DataFrame, settings: Settings) -> bytes:
    """Dictionary from a sample: one document piece in each of ``sample_documents`` slots of the texts' hash.

    One task encodes the pieces and trains on them, so the driver loads no vocabulary.
    """
    slot = F.pmod(F.xxhash64("text"), F.lit(settings.sample_documents))
    pieces = (
        documents.where(F.length("text") > 0)
        .groupBy(slot.alias("slot"))
        .agg(F.min_by(F.substring("text", 1, settings.sample_chars), F.xxhash64("text")).alias("piece"))
    )  # at most sample_documents pieces of sample_chars

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(batch.column(name).to_pylist() for name in ("slot", "piece"))))
        content = _trained(encoder_of(settings).encode([piece for _, piece in rows]), settings)
        yield pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

    found = pieces.repartition(1).mapInArrow(learn, "content binary").collect()
    return bytes(found[0]["content"]) if found else _trained([], settings)


def _trained(samples: list[bytes], settings: Settings) -> bytes:
    try:
        return zstandard.train_dictionary(settings.dictionary_bytes, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their own bytes serve as content
        return (b"".join(samples) or bytes(8))[: settings.dictionary_bytes].ljust(8, b"\0")


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(content)


@dataclass
class TokenFiles:
    """A written file set."""

    dictionary: DataFrame
    blocks: DataFrame


def write_tokens(documents: DataFrame, settings: Settings) -> TokenFiles:
    """Encode all documents and write them in ascending order of doc_id (null first, equal ids by their texts' hash)."""
    spark: SparkSession = documents.sparkSession
    source = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"])
    content = train_dictionary(source, settings)
    digest = hashlib.sha256(content).hexdigest()
    dictionary = write_shared(
        spark.createDataFrame([(digest, content)], "dictionary_sha256 string, content binary"), "token-dictionary"
    )
    shared = spark.sparkContext.broadcast(content)  # dictionary_bytes at most

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(settings)
        packer = zstandard.ZstdCompressor(level=settings.level, dict_data=_dictionary(shared.value))
        shard = TaskContext.get().partitionId()
        for block, part in enumerate(text_slices(batches, most_bytes=settings.block_bytes, most_rows=5000)):
            coded = encoder.encode(part.column("text").to_pylist())
            frames = [packer.compress(x) for x in coded]
            ids = part.column("doc_id")
            width = encoder.kind.itemsize
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "dictionary_sha256": pa.array([digest]),
                    "width": pa.array([width], pa.int32()),
                    "first_doc": pa.array([ids[0].as_py()], pa.int64()),
                    "last_doc": pa.array([ids[-1].as_py()], pa.int64()),
                    "doc_ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())),
                    "counts": pa.array([[len(x) // width for x in coded]], pa.list_(pa.int64())),
                    "ends": pa.array([np.cumsum([len(x) for x in frames])], pa.list_(pa.int64())),
                    "payload": pa.array([b"".join(frames)], pa.binary()),
                }
            )

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    sorted_rows = source.repartitionByRange(task_count(spark), *order).sortWithinPartitions(*order)
    blocks = write_shared(sorted_rows.mapInArrow(pack, BLOCKS), "token-blocks", compression="uncompressed")
    return TokenFiles(dictionary, blocks)


def read_tokens(files: TokenFiles) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids_crc32`` of every stored document.

    Starts are summed within a shard and over shards; only one count per shard meets in one task.
    """
    spark = files.blocks.sparkSession
    content = {row[0]: bytes(row[1]) for row in files.dictionary.collect()}  # one row
    shared = spark.sparkContext.broadcast(content)
    sizes = files.blocks.select("shard", "block", F.expr("aggregate(counts, 0L, (a, x) -> a + x)").alias("n"))
    before = Window.unboundedPreceding
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n"))
    offsets = shards.select(
        "shard",
        F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(before, -1)), F.lit(0)).alias("offset"),
    )
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(before, -1)
    starts = (
        sizes.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets, "shard")
        .select("shard", "block", (F.col("inner") + F.col("offset")).alias("start"))
    )

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers: dict[str, zstandard.ZstdDecompressor] = {}
        for batch in batches:
            for row in batch.to_pylist():
                digest = row["dictionary_sha256"]
                if digest not in readers:
                    readers[digest] = zstandard.ZstdDecompressor(dict_data=_dictionary(shared.value[digest]))
                kind, low, lengths, sums = np.dtype(f"<u{row['width']}"), 0, [], []
                for high in row["ends"]:
                    ids = np.frombuffer(readers[digest].decompress(row["payload"][low:high]), kind)
                    lengths.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    low = high
                starts = row["start"] + np.cumsum([0, *lengths[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"], pa.int64()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    located = files.blocks.select("shard", "block", "dictionary_sha256", "width", "doc_ids", "ends", "payload").join(
        starts, ["shard", "block"]
    )
    return located.drop("shard", "block").mapInArrow(
        unpack, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def read_document(files: TokenFiles, doc_id: int) -> list[np.ndarray]:
    """Ids of the documents with one doc_id (one array per row that has it), from their blocks alone."""
    found = []
    content = {row[0]: bytes(row[1]) for row in files.dictionary.collect()}
    for row in files.blocks.where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id)).collect():
        reader = zstandard.ZstdDecompressor(dict_data=_dictionary(content[row["dictionary_sha256"]]))
        for at, known in enumerate(row["doc_ids"]):
            if known == doc_id:
                low = row["ends"][at - 1] if at else 0
                frame = bytes(row["payload"][low : row["ends"][at]])
                found.append(np.frombuffer(reader.decompress(frame), f"<u{row['width']}").astype(np.uint32))
    return found


def token_digests(documents: DataFrame, settings: Settings) -> DataFrame:
    """Write the token files and report every document as read back from them.

    One row per input row. A null or empty text is the end id alone. A null doc_id comes first; rows that repeat an id
    follow each other in the order of their texts' hash. An empty table gives no rows. Texts of any length are encoded
    whole; a block ends at the document that fills it. Extra columns are not read.
    """
    return read_tokens(write_tokens(documents, settings))
