"""Pre-tokens of a byte-level vocabulary's pattern, and ids of parts that are met again and again.

The pattern's classes (letters, numbers, white space) follow the Unicode tables of the library that matches it. Those of
the ``regex`` module are newer, so the classes are asked of the library once a process, and a character that the two see
differently is replaced by a stand-in of the library's class before the pattern runs.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Callable, Iterable
from functools import cache
from itertools import chain

import public_tokenizers
import regex
import tiktoken

_PATTERN = regex.compile(public_tokenizers.PATTERN)
# What stands for a character of each class; none takes part in a contraction.
_STAND_INS = {r"\p{L}": "x", r"\p{N}": "0", r"\s": " "}


def _ranges(points: list[int]) -> str:
    """Ascending code points as the inside of a character class."""
    parts, start = [], 0
    for at, point in enumerate(points):
        if at + 1 == len(points) or points[at + 1] != point + 1:
            parts.append(f"{re.escape(chr(points[start]))}-{re.escape(chr(point))}")
            start = at + 1
    return "".join(parts)


def library_class(kind: str, points: str) -> set[str]:
    """The characters of ``points`` that the tokenizer library puts into a class of the pattern."""
    single = {bytes([byte]): byte for byte in range(256)}
    found = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks=single, special_tokens={}).encode_ordinary(points)
    return set(bytes(found).decode())


@cache
def stand_ins() -> tuple[re.Pattern, dict[int, str]]:
    """A pattern for the characters whose class differs, and what replaces each of them."""
    points = "".join(chr(x) for x in range(0x110000) if not 0xD800 <= x < 0xE000)
    theirs = {kind: library_class(kind, points) for kind in _STAND_INS}
    differing: set[str] = set()
    for kind, members in theirs.items():
        differing |= members.symmetric_difference(regex.findall(kind, points))
    table = {
        ord(x): next((_STAND_INS[kind] for kind, members in theirs.items() if x in members), "!") for x in differing
    }
    return re.compile(f"[{_ranges(sorted(table))}]" if table else r"(?!)"), table


def _differs(text: str) -> bool:
    """Whether a character's class differs; those of the first 256 code points do not."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return bool(stand_ins()[0].search(text))
    return False


def pre_tokens(text: str) -> list[str]:
    """The matches of the pattern in order; together they are the whole text."""
    if not _differs(text):
        return _PATTERN.findall(text)
    return [text[x.start() : x.end()] for x in _PATTERN.finditer(text.translate(stand_ins()[1]))]


def pre_token_ends(text: str) -> list[int]:
    """Where each match of the pattern ends."""
    return [x.end() for x in _PATTERN.finditer(text.translate(stand_ins()[1]) if _differs(text) else text)]


def id_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    numbers = array("I", ids)
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class Remembered:
    """Coded forms of parts, each coded once while it is met often.

    When ``most`` recent parts are known they become the older ones, of which those met again are taken over: at most
    twice as many are held (and the parts of one call), and frequent parts are never forgotten.
    """

    def __init__(self, code: Callable[[list[str]], Iterable[bytes]], most: int):
        self.code, self.most = code, most
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def coded(self, texts: list[list[str]]) -> list[bytes]:
        """The coded parts of each text, joined."""
        wanted = set(chain.from_iterable(texts))
        new = wanted.difference(self.recent)
        if len(self.recent) + len(new) > self.most:
            self.older, self.recent, new = self.recent, {}, wanted
        again = [x for x in new if x in self.older]
        self.recent.update((x, self.older[x]) for x in again)
        fresh = list(new.difference(again))
        self.recent.update(zip(fresh, self.code(fresh)))
        return [b"".join(map(self.recent.__getitem__, parts)) for parts in texts]
