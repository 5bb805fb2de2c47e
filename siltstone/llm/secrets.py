"""Secrets in texts: fixed patterns, and windows of high entropy in strings that look like keys.

For each candidate string (a run of at least ``least`` key characters) a window of ``width`` code points slides along
it. The counts of the characters in the window are updated by one in and one out, and with them the sum of c * log2 c,
so that every window's entropy costs two updates. A window is judged against the bound of its character class (hex
digits, letters and digits, base64); windows above the bound are merged into spans. A candidate that the allow list
matches (an address, a path of words, an identifier without digits, a number) is suppressed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed patterns of the result's contract.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")

SCHEMA = (
    "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_entropy bigint"
)


@dataclass(frozen=True)
class Settings:
    """``width`` of the window, ``least`` length of a candidate, entropy bounds in bits by character class."""

    width: int = 16
    least: int = 16
    hexadecimal: float = 2.6
    alphanumeric: float = 3.2
    base64: float = 3.4
    allowed: tuple[str, ...] = (
        r"[^0-9]*",  # no digit: words run together
        r"[0-9._+=/-]+",  # numbers, dates, rules of dashes
        r"(?:[A-Za-z]*[0-9]{0,4}[_./-])+[A-Za-z]*[0-9]{0,4}",  # paths and identifiers made of words
        r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",  # UUIDs
    )


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans (start, kind, end) of the three fixed patterns, by start and kind."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def window_spans(text: str, settings: Settings, candidate: re.Pattern, allowed: re.Pattern) -> list[tuple[int, int, int]]:
    """Merged spans of the windows whose entropy reaches the bound of their character class."""
    found: list[tuple[int, int, int]] = []
    width = settings.width
    for match in candidate.finditer(text):
        string, base = match[0], match.start()
        if allowed.fullmatch(string):
            continue
        counts: dict[str, int] = {}
        total = 0.0  # sum of c * log2 c over the characters in the window
        other = symbols = 0  # characters beyond hex digits, and beyond letters and digits
        last = -1
        for at, char in enumerate(string):
            c = counts.get(char, 0)
            total += _STEPS[c] if c < len(_STEPS) else _growth(c)
            counts[char] = c + 1
            other += char not in _HEX_DIGITS
            symbols += char in "+/_=-"
            if at >= width:
                out = string[at - width]
                c = counts[out] - 1
                total -= _STEPS[c] if c < len(_STEPS) else _growth(c)
                counts[out] = c
                other -= out not in _HEX_DIGITS
                symbols -= out in "+/_=-"
            if at >= width - 1:
                bound = settings.base64 if symbols else settings.alphanumeric if other else settings.hexadecimal
                if log2(width) - total / width >= bound:
                    start, end = base + at - width + 1, base + at + 1
                    if last >= start:
                        found[-1] = (found[-1][0], 3, end)
                    else:
                        found.append((start, 3, end))
                    last = end
    return found


def _growth(c: int) -> float:
    return (c + 1) * log2(c + 1) - (c * log2(c) if c else 0.0)


_STEPS = [_growth(c) for c in range(64)]
_HEX_DIGITS = frozenset("0123456789abcdefABCDEF")


def spelled(spans: list[tuple[int, int, int]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{kinds[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts, digest and spans of secrets for every document.

    One row per input row, in no order; repeated rows are repeated. A null or empty text has zero counts, the digest of
    the empty text and an empty span list. Texts of any length are scanned whole: every pattern is linear in the text.
    Other columns of the input are not read. An empty table gives an empty result.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidate = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % settings.least)
        allowed = re.compile("|".join(f"(?:{x})" for x in settings.allowed))
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                entropy = window_spans(text, settings, candidate, allowed)
                kinds = [kind for _, kind, _ in base]
                rows.append(
                    (
                        *(kinds.count(k) for k in range(3)),
                        hashlib.sha256(spelled(base).encode()).hexdigest(),
                        spelled(sorted(base + entropy)),
                        len(entropy),
                    )
                )
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:3])]
                + [pa.array(c, pa.string()) for c in columns[3:5]]
                + [pa.array(columns[5], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
            )

    source = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"])
    return source.mapInArrow(scan, SCHEMA)
