"""Runs, token alignment and byte-level encoding against plain recomputations, on small tables with nulls, copies and odd texts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from siltstone.errors import ConfigurationError, ValidationError
from siltstone.llm import byte_pairs, crosswalk, periodicity
from siltstone.llm.pretokens import Remembered, id_bytes, library_class, pre_token_ends, pre_tokens, stand_ins

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, runs int, ids string, block int, copies int, piece string"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SIDES = crosswalk.Settings(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
ODD = [
    "", None, " ", " \n\t ", "  two  spaces ", "<|endoftext|> <s></s> <unk> <0x41>", "don't we'll 's 'S ''re", "a▁b", "▁",
    "tab\tline\r\nend\x0bv\x0cf", "\x1c\x1d\x85 　x ", "日本語 12½ ²", "é é ﬁ ß", "🙂🙂 👩‍👩‍👧", "\U00011dc1 Ɤ x", "\x00\x01",
    "a a a a a a a", "x " * 30, "ab cd " * 9 + "ab", "one two three " * 4 + "end " + "one two three " * 5,
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect()
    data = [(r.doc_id, r.text) for r in rows]
    data += [(20_000 + at, x) for at, x in enumerate(ODD)]
    # Repeated rows, a repeated id with another text, null ids, very long texts with and without breaks.
    data += [(20_003, ODD[3]), (rows[0].doc_id, rows[0].text), (rows[1].doc_id, rows[2].text), (None, "no id a a a a a a a a")]
    data += [(None, None), (30_000, "long word here. " * 5_000), (30_000, "long word here. " * 5_000), (30_001, "x" * 40_000)]
    data += [(30_002, "it's " + " " * 30_000 + "'re!!'s " * 4_000 + "e" * 9_000 + "'ll " * 500)]
    return data


@pytest.fixture(scope="module")
def documents(spark, texts):
    return spark.createDataFrame([(*x, "en", 1, "i", 2, 3, "p") for x in texts], SCHEMA).repartition(5).cache()


def rows_of(frame):
    return Counter(tuple(row) for row in frame.collect())


# Runs


def plain_runs(words, least_length=6, least_exponent=4):
    found, n = [], len(words)
    for q in range(1, n // least_exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j + q - i
            if j > i and length >= max(least_length, least_exponent * q):
                run = words[start : start + length]
                if not any(run[r:] == run[:-r] for r in range(1, q)):
                    found.append((start, length, q))
            i = max(j, i + 1)
    return sorted((s, n_words, q) for s, n_words, q in found)


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [x if i < a else words[a + (i - a) % p] for i, x in enumerate(words)]
    runs = plain_runs(words)
    dropped = {x for s, length, q in runs for x in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = " ".join(x for i, x in enumerate(words) if i not in dropped)
    return (
        doc_id,
        len(runs),
        *(best or (None,) * 3),
        1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(),
        hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_runs_equal_all_periods_tried():
    rng = np.random.default_rng(5)
    for _ in range(400):
        words = rng.integers(0, rng.integers(1, 5), rng.integers(0, 70))
        if rng.random() < 0.5 and len(words) > 4:
            a, p = int(rng.integers(0, len(words) - 2)), 1 + int(rng.integers(0, 9))
            words[a:] = [words[a + i % p] if a + i % p < len(words) else 0 for i in range(len(words) - a)]
        for least in ((6, 4), (2, 2), (1, 3)):
            found = periodicity.find_runs(words.astype(np.int64), *least)
            assert list(zip(*(x.tolist() for x in found))) == plain_runs(words.tolist(), *least)


def test_suffix_array_orders_suffixes():
    rng = np.random.default_rng(6)
    for size in (1, 2, 50):
        words = rng.integers(0, 3, size)
        made = periodicity.SuffixArray(words)
        suffixes = [words[i:].tolist() for i in range(size)]
        assert made.order.tolist() == sorted(range(size), key=suffixes.__getitem__)
        assert made.rank[made.order].tolist() == list(range(size))
        a, b = np.divmod(np.arange(size * size), size)
        apart = a != b
        shared = made.common_prefix(a[apart], b[apart])
        for x, y, n in zip(a[apart], b[apart], shared):
            assert suffixes[x][:n] == suffixes[y][:n] and (suffixes[x][n : n + 1] != suffixes[y][n : n + 1])


def test_lcp_intervals_cover_children():
    rng = np.random.default_rng(7)
    for _ in range(50):
        lcp = rng.integers(0, 4, 30)
        lcp[0] = 0
        number, depth, left, low, high = periodicity.lcp_intervals(lcp)
        for one in set(number.tolist()):
            own = number == one
            begin, end, d = int(left[own][0]), int(high[own].max()), int(depth[own][0])
            assert lcp[begin] < d and (end + 1 == len(lcp) or lcp[end + 1] < d) and lcp[begin + 1 : end + 1].min() == d
            cuts = [begin, *(k for k in range(begin + 1, end + 1) if lcp[k] == d), end + 1]
            children = sorted(zip(low[own].tolist(), high[own].tolist()))
            assert children == [(a, b - 1) for a, b in zip(cuts, cuts[1:])]


def test_run_digests(documents, texts):
    small = [(i, x) for i, x in texts if len(x or "") < 30_000]
    wanted = Counter(plain_digest(*x) for x in small)
    found = periodicity.run_digests(documents.where("coalesce(length(text), 0) < 30000"))
    assert found.columns[:6] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli"]
    assert rows_of(found) == wanted
    assert sum(1 for x in wanted if x[1]) > 5


def test_run_digests_do_not_depend_on_slices(documents):
    small = periodicity.run_digests(documents, periodicity.Settings(slice_bytes=100))
    assert rows_of(small) == rows_of(periodicity.run_digests(documents))


def test_long_periodic_texts_take_linear_rounds():
    for words, wanted in ((np.zeros(100_000), (0, 100_000, 1)), (np.arange(100_000) % 7, (0, 100_000, 7))):
        found = periodicity.find_runs(words.astype(np.int64), 6, 4)
        assert [tuple(int(y[0]) for y in found)] == [wanted] and len(found[0]) == 1


# Alignment


@pytest.fixture(scope="module")
def libraries():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(SIDES.bytes_file)
    tokenizer.encode_special_tokens = True
    return tokenizer, SentencePieceProcessor(model_file=SIDES.pieces_file)


def plain_alignment(text, libraries):
    tokenizer, pieces = libraries
    if not text:
        return None
    ids = tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)
    spelled = [[side.spelled[x].as_py() for x in own] for side, own in zip(crosswalk.sides_of(SIDES), ids)]
    if any(b"".join(x) != (" " + text).encode() for x in spelled):
        return None
    ends_a, ends_b = (np.cumsum([len(x) for x in own]).tolist() for own in spelled)
    links, at = [], 0
    for x, end in enumerate(ends_a):
        start = end - len(spelled[0][x])
        while ends_b[at] <= start:
            at += 1
        y = at
        while y < len(ends_b) and ends_b[y] - len(spelled[1][y]) < end:
            links.append((ids[0][x], ids[1][y]))
            y += 1
    groups, a, b = [], [], []
    own = {end: x for x, end in zip(ids[0], ends_a)}, {end: x for x, end in zip(ids[1], ends_b)}
    for end in sorted({*own[0], *own[1]}):
        for held, side in ((a, own[0]), (b, own[1])):
            if end in side:
                held.append(str(side[end]))
        if end in own[0] and end in own[1]:
            groups.append(f"{','.join(a)}|{','.join(b)}")
            a, b = [], []
    return len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()


def test_alignment_equals_plain_alignment(documents, texts, libraries):
    plain = [(i, plain_alignment(x, libraries)) for i, x in texts]
    counts = Counter(pair for _, x in plain if x for pair in set(x[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    wanted = Counter(
        (i, *x[:3], len(x[3]), sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), x[4])
        if x
        else (i, 0, 0, 0, 0, 0, 0, "")
        for i, x in plain
    )
    assert rows_of(crosswalk.align_documents(documents, SIDES)) == wanted
    # Long texts in many parts, one document a block: the same rows.
    small = crosswalk.Settings(SIDES.bytes_file, SIDES.pieces_file, block_bytes=3_000, remembered=50)
    assert rows_of(crosswalk.align_documents(documents, small)) == wanted
    assert sum(x is None for _, x in plain) >= 5


def odd_texts(count=3_000):
    parts = [" ", "  ", "\n", "\t", "\r", "the", "don't", "'re", "'", "<|endoftext|>", "<s>", "12", "a,", "b.c", "d;e", ":", "½", "日本", "🙂", "\x00", "\x1c", " ", "?!"]
    parts += [chr(x) for x in sorted(stand_ins()[1])[::500]]
    rng = np.random.default_rng(8)
    return ["".join(parts[x] for x in rng.integers(0, len(parts), rng.integers(1, 25))) for _ in range(count)]


def test_parts_give_the_libraries_ids(libraries):
    tokenizer, pieces = libraries
    a, b = crosswalk.sides_of(SIDES)
    texts = odd_texts()
    whole = [id_bytes(x.ids) for x in tokenizer.encode_batch([" " + x for x in texts], add_special_tokens=False)]
    assert a.coded([" " + x for x in texts]) == whole
    assert b.coded([" " + x for x in texts]) == [id_bytes(x) for x in pieces.encode(texts)]
    assert all("".join(b.parts_of(x)) == x for x in texts)
    with pytest.raises(ConfigurationError):
        crosswalk._seams(["a▁b"])


def test_long_texts_are_cut_where_both_sides_begin_a_token():
    text = "a  b c\n d e.f  g h"
    parts = crosswalk._parts_of(text, 4)
    assert "".join(parts) == " " + text and len(parts) > 2
    assert all(re.match(r" \S", x) for x in parts)
    assert crosswalk._parts_of("x" * 50, 4) == [" " + "x" * 50]


# Byte-level encoding


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_pairs.read_ranks(RANKS), special_tokens={}
    )


def test_encoding_equals_the_library(documents, texts, library):
    wanted = Counter()
    for doc_id, text in texts:
        ids = library.encode_ordinary(text or "")
        decoded = hashlib.sha256((text or "").encode()).hexdigest()
        wanted[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), decoded] += 1
    for size, overlap in ((16_384, 512), (1_000, 64), (500, 500), (64, 16)):
        settings = byte_pairs.Settings(RANKS, size, overlap, remembered=1_000)
        assert rows_of(byte_pairs.encoding_digests(documents, settings)) == wanted, (size, overlap)


def test_chunks_without_a_shared_boundary_become_one_run(spark):
    text = "some words " * 20 + "x" * 500 + " and more words" * 20
    settings = byte_pairs.Settings(RANKS, 100, 20)
    cut = byte_pairs._cut(settings)
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string").mapInArrow(
        cut, "doc_id bigint, digest string, chunk int, last boolean, piece string"
    )
    found = byte_pairs.stitches(frame.selectExpr("*", "1L as copies"), settings).orderBy("chunk").collect()
    runs = Counter(x.run for x in found)
    assert max(runs.values()) >= 5 and len(runs) > 4
    ends = set(pre_token_ends(text))
    for row in found:
        if row.high is not None:
            assert (row.chunk + 1) * 100 + row.high in ends


def test_encoding_of_odd_texts(library):
    texts = odd_texts()
    encoder = byte_pairs.Encoder(byte_pairs.Settings(RANKS))
    assert encoder.encode(texts) == [id_bytes(library.encode_ordinary(x)) for x in texts]
    assert all("".join(pre_tokens(x)) == x and pre_token_ends(x)[-1] == len(x) for x in texts)


def test_classes_are_those_of_both_libraries():
    from tokenizers import Regex, pre_tokenizers

    points = "".join(chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000)
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        other = "".join(x for x, _ in pre_tokenizers.Split(Regex(f"{kind}+"), "removed").pre_tokenize_str(points))
        assert library_class(kind, points) == set(points).difference(other)
        replaced = points.translate(stand_ins()[1])
        assert {x for x, y in zip(points, replaced) if regex.match(kind, y)} == library_class(kind, points)


def test_decoding_joins_bytes_and_refuses_unknown_ids():
    ids = np.array([0, 50_255, 198], "<u4")
    known = {rank: token for token, rank in byte_pairs.read_ranks(RANKS).items()}
    assert byte_pairs.joined_bytes(ids, RANKS) == b"".join(known[int(x)] for x in ids)
    assert byte_pairs.joined_bytes(ids[:0], RANKS) == b""
    with pytest.raises(ValidationError):
        byte_pairs.joined_bytes(np.array([50_256], "<u4"), RANKS)


def test_remembered_parts_are_bounded():
    asked = []
    known = Remembered(lambda parts: (asked.append(x) or x.encode() for x in parts), 3)
    assert known.coded([["a", "b", "a"], []]) == [b"aba", b""]
    assert known.coded([["c", "d", "a"]]) == [b"cda"]
    assert len(known.recent) <= 3 and asked.count("a") == 1
    assert known.coded([["e", "f", "g", "h"]]) == [b"efgh"]


# Empty tables


@pytest.mark.parametrize(
    "query",
    [
        periodicity.run_digests,
        lambda x: crosswalk.align_documents(x, SIDES),
        lambda x: byte_pairs.encoding_digests(x, byte_pairs.Settings(RANKS)),
    ],
)
def test_empty_table_gives_no_rows(spark, query):
    assert query(spark.createDataFrame([], SCHEMA)).collect() == []


def test_all_operators_are_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {x.split("_")[0] for x in names if x.startswith("op")} == {f"op{n}" for n in range(1, 14)} and "pipeline" in names
