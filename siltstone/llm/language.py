"""Language of a text by cross-parsing: how few phrases of a language's labelled text it takes to spell the text.

A suffix automaton of the labelled text of each language knows every string in it. A text is cut into phrases, each the
longest string that the automaton still knows (Ziv and Merhav 1993); the language that needs the fewest phrases, each
weighed with log2 of its labelled text's length, wins. Automata are kept as lists of their edges, whatever the size of
the alphabet, and looked up in a hash table, so that many blocks of text take each step at once in numpy. A text is
parsed in blocks of ``block`` code points; a phrase ends with its block, for every language alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.shared import remainder, text_slices

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"


@dataclass(frozen=True)
class Settings:
    """``sample_chars``: labelled text learned per language; ``piece``: of one document; ``block``: parsed at once."""

    sample_chars: int = 60_000
    piece: int = 600
    block: int = 512


class Steps:
    """Transitions of an automaton: edges sorted by state and letter, and a hash table of them made on first use.

    ``steps[state, letter]`` is the next state, 0 for none. Only the edges are pickled.
    """

    def __init__(self, degrees: np.ndarray, letters: np.ndarray, targets: np.ndarray, alphabet: int):
        self.degrees, self.letters, self.targets, self.alphabet = degrees, letters, targets, alphabet
        self._keys: np.ndarray | None = None

    def __reduce__(self):
        return Steps, (self.degrees, self.letters, self.targets, self.alphabet)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _fill(self) -> None:
        """Open addressing with at most a quarter of the slots in use, all edges placed at once."""
        keys = np.repeat(np.arange(len(self.degrees), dtype=np.int64), self.degrees) * self.alphabet + self.letters
        bits = max(4, int(4 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        table, values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        open_, place = np.arange(len(keys)), self._place(keys)
        while len(open_):
            free = table[place] == -1
            table[place[free]] = keys[open_[free]]  # of edges that meet in a slot one stays
            stays = table[place] == keys[open_]
            values[place[stays]] = self.targets[open_[stays]]
            open_, place = open_[~stays], (place[~stays] + 1) & self._mask
        self._values, self._keys = values, table

    def next(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        if self._keys is None:
            self._fill()
        keys = states * self.alphabet + letters
        place = self._place(keys)
        found = self._keys[place]
        step = np.where(found == keys, self._values[place], 0)
        at = np.flatnonzero((found != keys) & (found != -1))
        place = place[at]
        while len(at):
            place = (place + 1) & self._mask
            found = self._keys[place]
            same = found == keys[at]
            step[at[same]] = self._values[place[same]]
            more = ~same & (found != -1)
            at, place = at[more], place[more]
        return step

    def __getitem__(self, edge: tuple[int, int]) -> int:
        return int(self.next(np.array([edge[0]], np.int64), np.array([edge[1]], np.int64))[0])


@dataclass
class Automaton:
    """``steps[state, letter]`` is the next state, 0 for none; state 1 is the root."""

    language: str
    steps: Steps
    cost: float


def suffix_automaton(text: list[int], alphabet: int) -> Steps:
    """Transitions of the suffix automaton (Blumer et al. 1985) of a sequence of letters below ``alphabet``."""
    nexts: list[dict[int, int]] = [{}, {}]
    link, length = [0, 0], [0, 0]
    last = 1
    for letter in text:
        current = len(nexts)
        nexts.append({})
        link.append(1)
        length.append(length[last] + 1)
        state = last
        while state and letter not in nexts[state]:
            nexts[state][letter] = current
            state = link[state]
        if state:
            target = nexts[state][letter]
            if length[target] == length[state] + 1:
                link[current] = target
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[target]))
                link.append(link[target])
                length.append(length[state] + 1)
                while state and nexts[state].get(letter) == target:
                    nexts[state][letter] = clone
                    state = link[state]
                link[target] = link[current] = clone
        last = current
    edges = [edge for row in nexts for edge in sorted(row.items())]
    letters, targets = np.array(edges, np.int32).reshape(-1, 2).T.copy()
    return Steps(np.array([len(row) for row in nexts], np.int32), letters, targets, alphabet)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


SPACES = np.array([9, 10, 11, 12, 13, 32], np.uint32)


def alphabet_of(samples: dict[str, str]) -> np.ndarray:
    """Code points of all samples in order, without white space; the letter of the first is 2."""
    seen = [np.unique(points(text)) for text in samples.values()]
    return np.setdiff1d(np.concatenate([np.zeros(0, np.uint32), *seen]), SPACES)


def letter_table(alphabet: np.ndarray) -> np.ndarray:
    """Letter of every code point: 1 for white space, 0 for what no sample holds."""
    table = np.zeros(0x110000, np.int32)
    table[alphabet] = np.arange(2, 2 + len(alphabet))
    table[SPACES] = 1
    return table


def learn(documents: DataFrame, settings: Settings) -> tuple[np.ndarray, list[Automaton]]:
    """Alphabet and automata from labelled rows outside the held-out fold. Every code point of the samples is a letter.

    The sample is bounded: of each language the rows with the smallest hashes of their texts, ``piece`` characters of
    each, ``sample_chars`` in all. Equal inputs give equal samples; copies count once.
    """
    fold = documents.where((remainder(F.col("doc_id"), 5) != 0) & F.col("lang").isNotNull() & (F.length("text") > 0))
    count = max(1, settings.sample_chars // settings.piece)
    pieces = (
        fold.select("lang", F.xxhash64("text").alias("h"), F.substring("text", 1, settings.piece).alias("piece"))
        .groupBy("lang", (F.pmod("h", F.lit(64 * count))).alias("slot"))
        .agg(F.min_by("piece", "h").alias("piece"), F.min("h").alias("h"))
        .groupBy("lang")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct("slot", "h", "piece"))), 1, 4 * count).alias("rows"))
    )
    samples = {}
    for row in pieces.collect():  # one bounded row per language
        text = " ".join(r["piece"] for r in row["rows"])
        samples[row["lang"]] = text[: settings.sample_chars]
    alphabet = alphabet_of(samples)
    table = letter_table(alphabet)
    automata = []
    for language in sorted(samples):
        letters = table[points(samples[language])]
        steps = suffix_automaton(letters.tolist(), 2 + len(alphabet))
        automata.append(Automaton(language, steps, float(np.log2(max(2, len(letters))))))
    return alphabet, automata


def phrase_counts(blocks: np.ndarray, automaton: Automaton) -> np.ndarray:
    """Phrases in each column of ``blocks`` (steps x blocks; the type's highest number pads the end, 0 is unknown to all)."""
    steps, pad = automaton.steps, np.iinfo(blocks.dtype).max
    state = np.ones(blocks.shape[1], np.int64)
    phrases = np.zeros(blocks.shape[1], np.int64)
    for letters in blocks:
        live = letters != pad
        letter = np.where(live, letters, 0).astype(np.int64)
        step = steps.next(state, letter)
        broken = (step == 0) & live
        if broken.any():
            at = np.flatnonzero(broken)
            # A phrase ends before this letter, unless it has not begun; an unknown letter is a phrase by itself.
            phrases[at] += state[at] != 1
            again = steps.next(np.ones(len(at), np.int64), letter[at])
            phrases[at] += again == 0
            step[at] = np.where(again == 0, 1, again)
        state = np.where(live, step, state).astype(np.int64)
    return phrases + (state != 1)


def predict(texts: list[str | None], table: np.ndarray, automata: list[Automaton], block: int) -> list[tuple[str, float]]:
    """Language and score of each text; ``und`` and 0 where there is no letter or nothing was learned."""
    kept = [i for i, x in enumerate(texts) if x and automata and any(map(str.isalpha, x))]
    result: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
    if not kept:
        return result
    codes = [table[points(texts[i])] for i in kept]
    parts = np.array([max(1, -(-len(c) // block)) for c in codes])
    first = np.concatenate([[0], np.cumsum(parts)])
    blocks = np.full((int(first[-1]), block), np.iinfo(np.int32).max, np.int32)
    for row, c in zip(first, codes):
        blocks[row : row + -(-len(c) // block)].ravel()[: len(c)] = c
    blocks = np.ascontiguousarray(blocks.T)
    costs = np.stack([np.add.reduceat(phrase_counts(blocks, a), first[:-1]) * a.cost for a in automata])
    best = costs.argmin(axis=0)
    low = costs[best, np.arange(len(kept))]
    # Share of the winner in weights that halve with each tenth of relative cost above it.
    weights = np.exp2(-10.0 * (costs - low) / np.maximum(low, 1.0))
    for i, at, score in zip(kept, best, 1.0 / weights.sum(axis=0)):
        result[i] = (automata[at].language, float(score))
    return result


def identify_language(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Predicted language of every document.

    One row per input row. ``und`` with score 0 for a null text, a text without a letter, and for all texts if no row
    carries a language to learn from. Ties go to the language first by code point. Whole texts are parsed, in blocks;
    the model (at most two states and three edges per learned character of a language) has a size fixed by ``Settings``. Null
    languages are not learned; a null doc_id falls in the fold of the empty text. Extra columns are not read.
    """
    spark: SparkSession = documents.sparkSession
    source = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"], documents["lang"])
    model = spark.sparkContext.broadcast(learn(source, settings))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alphabet, automata = model.value
        table = letter_table(alphabet)
        for part in text_slices(batches, most_bytes=4_000_000):
            found = predict(part.column("text").to_pylist(), table, automata, settings.block)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array([x[0] for x in found], pa.string()),
                    pa.array([x[1] for x in found], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    held = source.select("doc_id", "text", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"))
    return held.mapInArrow(label, SCHEMA)
