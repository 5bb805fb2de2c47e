"""Toxicity of documents by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word is spelled by a bidirectional GRU over its characters, pooled by attention, next to an embedding of the word.
A second bidirectional GRU with attention pooling reads the words of a window. Every window of ``window`` words, each
``stride`` words after the last, is scored, and a document scores as its worst window. A label speaks for a document, not
for its windows; so training starts with the windows of toxic documents whose words and word beginnings tell toxic
documents from others, and then takes the windows that the network itself finds worst.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.recurrent import (
    Adam,
    Params,
    attend,
    attend_gradient,
    attention_params,
    both_ways,
    both_ways_gradient,
    gru_gradient,
    gru_params,
    gru_states,
    looked_up_states,
    sigmoid,
    weights,
)
from siltstone.llm.shared import remainder, text_slices
from siltstone.llm.words import mixed

SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, n_windows bigint"
WORD = re.compile(r"[^\W\d_]+|\d+")


@dataclass(frozen=True)
class Settings:
    """``sample``: most labelled documents learned, toxic and other, none longer than ``sample_chars``.

    One of ``calibration`` of them is kept from training and tells where to cut.
    """

    window: int = 24
    stride: int = 12
    spelling: int = 16  # a longer word is read in pieces
    sample: tuple[int, int] = (600, 1800)
    calibration: int = 4
    updates: int = 110  # fewest of a round
    sample_chars: int = 12_000
    characters: int = 64
    char_size: int = 8
    char_hidden: int = 8
    buckets: int = 4096
    word_size: int = 6
    hidden: int = 12
    rounds: tuple[int, ...] = (3, 2, 2)  # epochs of each round
    batch: int = 96
    rate: float = 0.02
    slight: float = 9.0  # a G statistic below this counts as none
    word_dropout: float = 0.3
    cut: float = 0.7
    remembered: int = 250_000
    seed: int = 5


@dataclass
class Model:
    params: Params
    letters: np.ndarray  # letter number of every code point
    strength: dict[str, float]  # of words and word beginnings that stand in toxic documents more often
    shift: float  # added to a window's logit, so that the cut lies where it divides the labelled sample best


def pieces_of(text: str, spelling: int) -> list[str]:
    """Words of a text in lower case; long ones in pieces."""
    words = WORD.findall(text.lower())
    if max(map(len, words), default=0) <= spelling:
        return words
    return [w[i : i + spelling] for w in words for i in range(0, len(w), spelling)]


def spelled_table(words: list[str], model: Model, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers (longest x words) and bucket of each word; 0 stands for a letter that was not learned."""
    lengths = np.array([len(w) for w in words])
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    spots = np.arange(max(1, lengths.max(initial=1)))[:, None] < lengths
    codes = np.zeros(spots.shape, np.int64)
    codes.T[spots.T] = points
    powers = np.multiply.accumulate(np.full(len(codes), 0x9E3779B97F4A7C15, np.uint64))
    sums = (mixed(codes.astype(np.uint64)) * powers[:, None] * spots).sum(axis=0, dtype=np.uint64)
    return model.letters[codes].astype(np.int64), (mixed(sums) % np.uint64(settings.buckets)).astype(np.int64)


BEGINNINGS = (4, 5, 6, 7)


def word_hints(words: list[str], strength: dict[str, float]) -> np.ndarray:
    """How surely each word, or its beginning, speaks for a toxic document, as the logarithm of its G statistic."""
    get = strength.get
    found = [max(get(w, 0.0), *(get(w[:n] + "*", 0.0) for n in BEGINNINGS)) for w in words] if strength else []
    return np.log1p(np.array(found or [0.0] * len(words), np.float32)) / np.float32(3.0)


def word_vectors(words: list[str], model: Model, settings: Settings) -> np.ndarray:
    """Input of the window network for each word, words of like length together."""
    params = model.params
    lengths = np.array([len(w) for w in words])
    size = 2 * settings.char_hidden
    vectors = np.zeros((len(words), size + settings.word_size + 1), np.float32)
    vectors[:, -1] = word_hints(words, model.strength)
    order = np.argsort(lengths, kind="stable")
    for low in range(0, len(words), 4096):
        own = order[low : low + 4096]
        codes, buckets = spelled_table([words[i] for i in own], model, settings)
        live = np.arange(codes.shape[0])[:, None] < lengths[own]
        states = looked_up_states(params, "char", params["letters"], codes, live, gru_states)
        vectors[own, :size] = attend(params, "spell", states, live)[0]
        vectors[own, size:-1] = params["words"][buckets]
    return vectors


def windows_of(bounds: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every window; a document of fewer words is one window, one without words none."""
    starts, owners = [], []
    for doc, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
        if high > low:
            last = max(low, high - settings.window)
            own = np.arange(low, last + 1, settings.stride)
            if own[-1] != last:
                own = np.append(own, last)
            starts.append(own)
            owners.append(np.full(len(own), doc))
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none
    start, owner = np.concatenate(starts), np.concatenate(owners)
    return start, np.minimum(start + settings.window, bounds[1:][owner]), owner


def score_windows(words: np.ndarray, vectors: np.ndarray, start: np.ndarray, end: np.ndarray, model: Model, settings: Settings):
    """Logit of each window of the word sequence ``words`` (rows of ``vectors``)."""
    params = model.params
    logits = np.zeros(len(start), np.float32)
    for low in range(0, len(start), 4096):
        first, last = start[low : low + 4096], end[low : low + 4096]
        at = first + np.arange(settings.window)[:, None]
        live = at < last
        rows = words[np.minimum(at, len(words) - 1)]
        states = looked_up_states(params, "word", vectors, rows, live, gru_states)
        pooled = attend(params, "read", states, live)[0]
        logits[low : low + 4096] = pooled @ params["out"] + params["bias"][0]
    return logits + model.shift


class Scorer:
    """Scores texts, remembering the inputs of up to ``settings.remembered`` words."""

    def __init__(self, model: Model, settings: Settings):
        self.model, self.settings = model, settings
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((0, 2 * settings.char_hidden + settings.word_size + 1), np.float32)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Logit of the worst window of each text (a low one where there is none), and its number of windows."""
        if len(self.known) > self.settings.remembered:
            self.known, self.vectors = {}, self.vectors[:0]
        known, before = self.known, len(self.known)
        sequence: list[int] = []
        bounds = [0]
        for text in texts:
            sequence += [known.setdefault(w, len(known)) for w in pieces_of(text or "", self.settings.spelling)]
            bounds.append(len(sequence))
        start, end, owner = windows_of(np.array(bounds), self.settings)
        worst = np.full(len(texts), -30.0)
        if len(start):
            if len(known) > before:
                new = word_vectors(list(known)[before:], self.model, self.settings)
                self.vectors = np.concatenate([self.vectors, new])
            used, words = np.unique(np.array(sequence), return_inverse=True)
            logits = score_windows(words, self.vectors[used], start, end, self.model, self.settings)
            np.maximum.at(worst, owner, logits)
        return worst, np.bincount(owner, minlength=len(texts))


def score_texts(texts: list[str | None], model: Model, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    return Scorer(model, settings).score(texts)


def _loss_gradient(params: Params, codes, spelled, buckets, hints, dropped, rows, live, target, weight):
    """Gradient of the weighed logistic loss over one batch of windows."""
    letters = params["letters"][codes]
    states, kept = both_ways(params, "char", letters, spelled, gru_states)
    shape, kept_spell = attend(params, "spell", states, spelled)
    own = np.where(dropped[:, None], 0.0, params["words"][buckets]).astype(np.float32)
    vectors = np.concatenate([shape, own, np.where(dropped, 0.0, hints)[:, None].astype(np.float32)], axis=1)
    inputs = vectors[rows]
    word_states, kept_word = both_ways(params, "word", inputs, live, gru_states)
    pooled, kept_read = attend(params, "read", word_states, live)
    delta = ((sigmoid(pooled @ params["out"] + params["bias"][0]) - target) * weight).astype(np.float32)
    grads = {"out": pooled.T @ delta, "bias": np.array([delta.sum()], np.float32)}
    own_grads, grad = attend_gradient(params, "read", word_states, kept_read, delta[:, None] * params["out"])
    grads |= own_grads
    own_grads, grad = both_ways_gradient(params, "word", inputs, live, grad, kept_word, gru_gradient)
    grads |= own_grads
    grad_vectors = np.zeros_like(vectors)
    np.add.at(grad_vectors, rows.ravel(), grad.reshape(-1, grad.shape[2]))
    size = shape.shape[1]
    grads["words"] = np.zeros_like(params["words"])
    np.add.at(grads["words"], buckets, np.where(dropped[:, None], 0.0, grad_vectors[:, size:-1]))
    own_grads, grad = attend_gradient(params, "spell", states, kept_spell, grad_vectors[:, :size])
    grads |= own_grads
    own_grads, grad = both_ways_gradient(params, "char", letters, spelled, grad, kept, gru_gradient)
    grads |= own_grads
    grads["letters"] = np.zeros_like(params["letters"])
    np.add.at(grads["letters"], codes.ravel(), grad.reshape(-1, grad.shape[2]))
    return grads


def _evidence(documents: list[list[str]], toxic: np.ndarray, slight: float) -> dict[str, float]:
    """How surely a word, or a beginning shared with other words, stands in toxic documents more often: its G statistic."""
    counts = (Counter(), Counter())
    for words, label in zip(documents, toxic):
        own = set(words)
        counts[int(label)].update(own | {w[:n] + "*" for w in own for n in BEGINNINGS if len(w) > n})
    clean, foul = (max(1, int((toxic == k).sum())) for k in (0, 1))
    strength = {}
    for word, n in counts[1].items():
        m = counts[0][word]
        if n * clean > m * foul:
            both = (n + m) / (clean + foul)
            strength[word] = 2.0 * (n * np.log(n / foul / both) + (m * np.log(m / clean / both) if m else 0.0))
    return {word: value for word, value in strength.items() if value >= slight}


def train(texts: list[str], toxic: np.ndarray, settings: Settings) -> Model:
    """Network for labelled texts, and the shift that cuts the part kept from training best."""
    kept = np.zeros(len(toxic), bool)
    for label in (0, 1):
        own = np.flatnonzero(toxic == label)
        if len(own) >= 4 * settings.calibration:
            kept[own[:: settings.calibration]] = True
    model = fit([x for x, k in zip(texts, kept) if not k], toxic[~kept], settings)
    if len(toxic) and toxic.min() != toxic.max():
        judged = np.flatnonzero(kept) if kept.any() else np.arange(len(toxic))
        scores, _ = score_texts([texts[i] for i in judged], model, settings)
        model.shift = _cut_shift(scores, toxic[judged], settings.cut)
    return model


def fit(texts: list[str], toxic: np.ndarray, settings: Settings) -> Model:
    """Train the network; without both classes it scores everything lowest."""
    rng = np.random.default_rng(settings.seed)
    documents = [pieces_of(x, settings.spelling) for x in texts]
    common = Counter(c for words in documents for w in set(words) for c in w)
    ranked = sorted(common, key=lambda c: (-common[c], c))[: settings.characters - 1]
    letters = np.zeros(0x110000, np.uint8)
    letters[[ord(c) for c in ranked]] = np.arange(1, len(ranked) + 1)
    inputs = 2 * settings.char_hidden + settings.word_size + 1
    params: Params = {
        "letters": weights(rng, settings.characters, settings.char_size) * np.float32(4.0),
        "words": weights(rng, settings.buckets, settings.word_size),
        "out": weights(rng, 2 * settings.hidden),
        "bias": np.zeros(1, np.float32),
    }
    for name, size, hidden in (("char", settings.char_size, settings.char_hidden), ("word", inputs, settings.hidden)):
        for way in "fb":
            params |= gru_params(rng, f"{name}.{way}", size, hidden)
    params |= attention_params(rng, "spell", 2 * settings.char_hidden, settings.char_hidden)
    params |= attention_params(rng, "read", 2 * settings.hidden, settings.hidden)
    model = Model(params, letters, {}, 0.0)
    if not len(toxic) or toxic.min() == toxic.max():
        model.shift = -30.0
        params["out"][:] = 0.0
        return model
    known: dict[str, int] = {}
    words = np.array([known.setdefault(w, len(known)) for own in documents for w in own], np.int64)
    bounds = np.cumsum([0, *map(len, documents)])
    start, end, owner = windows_of(bounds, settings)
    spelled_words = list(known)
    model.strength = _evidence(documents, toxic, settings.slight)
    hints = word_hints(spelled_words, model.strength)
    at = start + np.arange(settings.window)[:, None]
    hint = np.where(at < end, hints[words[np.minimum(at, len(words) - 1)]], 0.0).max(axis=0)
    adam = Adam(params, settings.rate)
    for number, epochs in enumerate(settings.rounds):
        adam.rate = settings.rate / (1 + number)
        worst = hint if number == 0 else score_windows(words, word_vectors(spelled_words, model, settings), start, end, model, settings)
        # Of a toxic document the worst window; of another the worst, those found bad by mistake, and some by chance.
        order = np.lexsort((-worst, owner))
        first = order[np.append(True, np.diff(owner[order]) > 0)]
        if number == 0:
            first = first[(toxic[owner[first]] == 0) | (worst[first] > 0)]
        clean = np.flatnonzero(toxic[owner] == 0)
        some = rng.permutation(clean)[: len(first)]
        wrong = clean[np.argsort(-worst[clean], kind="stable")[: len(first)]] if number else some
        chosen = np.unique(np.concatenate([first, wrong, some]))
        label = toxic[owner[chosen]].astype(np.float32)
        share = label.mean()
        weight = np.where(label == 1, 0.5 / max(share, 1e-6), 0.5 / max(1 - share, 1e-6))
        epochs = max(epochs, -(-settings.updates * settings.batch // len(chosen)))
        for epoch in range(epochs):
            if number and epoch == epochs - 2:
                adam.rate /= 3
            for low in range(0, len(chosen), settings.batch):
                if low == 0:
                    mixed = rng.permutation(len(chosen))
                own = mixed[low : low + settings.batch]
                first_at, last_at = start[chosen[own]], end[chosen[own]]
                at = first_at + np.arange(settings.window)[:, None]
                live = at < last_at
                used, rows = np.unique(words[np.minimum(at, len(words) - 1)], return_inverse=True)
                codes, buckets = spelled_table([spelled_words[i] for i in used], model, settings)
                spelled = np.arange(codes.shape[0])[:, None] < np.array([len(spelled_words[i]) for i in used])
                dropped = rng.random(len(used)) < settings.word_dropout
                grads = _loss_gradient(
                    params, codes, spelled, buckets, hints[used], dropped, rows.reshape(at.shape), live, label[own], weight[own] / len(own)
                )
                adam.update(grads)
    return model


def _cut_shift(scores: np.ndarray, toxic: np.ndarray, cut: float) -> float:
    """Shift that puts the cut in the middle of the widest gap among the best dividing points."""
    order = np.argsort(scores)
    ranked, label = scores[order], toxic[order]
    below_toxic = np.append(0, np.cumsum(label))
    above_clean = np.append(np.cumsum((1 - label)[::-1])[::-1], 0)
    errors = below_toxic + above_clean
    edges = np.concatenate([[ranked[0] - 2.0], ranked, [ranked[-1] + 2.0]])
    best = np.flatnonzero(errors == errors.min())
    widest = best[np.argmax(edges[best + 1] - edges[best])]
    return float(np.log(cut / (1 - cut)) - (edges[widest] + edges[widest + 1]) / 2)


def labelled_sample(documents: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id``, ``text`` and ``toxic`` of at most ``sample`` documents of each class outside the held-out fold, by hash of the id."""
    marked = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    fold = documents.where(F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), 3) != 1)).where(
        F.length("text").between(1, settings.sample_chars)
    )
    known = fold.select("doc_id").distinct().join(marked, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    chosen = known.where("toxic = 1").orderBy("h").limit(settings.sample[0]).unionByName(
        known.where("toxic = 0").orderBy("h").limit(settings.sample[1])
    )
    picked = {row["doc_id"]: int(row["toxic"]) for row in chosen.collect()}  # at most the two sample sizes
    told = F.broadcast(documents.sparkSession.createDataFrame(list(picked.items()), "doc_id bigint, toxic int"))
    rows = fold.where(F.col("doc_id").isin(list(picked))).groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows.join(told, "doc_id").select("doc_id", "text", "toxic")


def trained(sample: DataFrame, settings: Settings) -> Model:
    """The network for a bounded ``labelled_sample``: one task trains it, so the driver holds no texts and none of its arrays."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(row for batch in batches for row in zip(*(batch.column(name).to_pylist() for name in ("doc_id", "text", "toxic"))))
        model = train([text for _, text, _ in rows], np.array([toxic for _, _, toxic in rows], np.int64), settings)
        packed = pickle.dumps((model.params, model.letters, model.strength, model.shift))
        yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], ["model"])

    found = sample.repartition(1).mapInArrow(learn, "model binary").collect()
    return Model(*pickle.loads(bytes(found[0]["model"]))) if found else train([], np.zeros(0, np.int64), settings)


def score_documents(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Toxicity of every document.

    One row per input row: ``doc_id``, ``held_out``, ``score``, ``predicted`` (score at least ``cut``) and ``n_windows``.
    All windows of whole texts are scored. A null or empty text, or one without a word, scores 0. Labels are learned only
    from rows outside the held-out fold; null labels are not learned, and a document labelled twice counts as toxic if one
    label says so. Without labels of both classes everything scores near 0. A null doc_id falls in the fold of the empty
    text. An empty table gives no rows; extra columns are not read.
    """
    spark: SparkSession = documents.sparkSession
    source = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"])
    marks = labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    model = spark.sparkContext.broadcast(trained(labelled_sample(source, marks, settings), settings))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value, settings)
        for part in text_slices(batches):
            logits, count = scorer.score(part.column("text").to_pylist())
            scores = np.where(count > 0, sigmoid(logits.astype(np.float64)), 0.0)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("held_out"),
                    pa.array(scores),
                    pa.array((scores >= settings.cut).astype(np.int32)),
                    pa.array(count.astype(np.int64)),
                ],
                ["doc_id", "held_out", "score", "predicted", "n_windows"],
            )

    held = source.select("doc_id", "text", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"))
    return held.mapInArrow(score, SCHEMA)
