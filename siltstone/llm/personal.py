"""Personal data in texts: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The network learns from spans that the fixed patterns label in a bounded sample. A text is cut into overlapping windows;
each is decoded on its own (best path of a conditional random field over begin and inside tags), and the windows' spans
are reconciled over the whole text: a span cut off by a window's edge gives way to the window that holds it whole, equal
spans count once, and of overlapping ones the surest stays. A span without a digit or an @ is none of the four kinds, so
windows that hold neither are not decoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.recurrent import (
    Adam,
    Params,
    both_ways,
    both_ways_gradient,
    looked_up_states,
    lstm_gradient,
    lstm_params,
    lstm_states,
    weights,
)
from siltstone.llm.shared import text_slices

KINDS = ("email", "ip", "card", "phone")
SCHEMA = (
    "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, "
    "n_added bigint"
)
Span = tuple[int, int, int]  # kind, start, end

# Fixed patterns of the result's contract. What stands before the @ of an email is taken from the left of it below.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SIGN = re.compile(r"[0-9@]")


@dataclass(frozen=True)
class Settings:
    """``sample`` documents, none longer than ``sample_chars``, label at most ``windows`` windows for training."""

    window: int = 80
    stride: int = 40
    characters: int = 96
    char_size: int = 12
    hidden: int = 14
    sample: int = 3000
    sample_chars: int = 20_000
    windows: int = 2400
    epochs: int = 5
    batch: int = 96
    rate: float = 0.015
    sure: float = 0.9
    seed: int = 11


def base_spans(text: str) -> list[Span]:
    """Spans (kind, start, end) of the four fixed patterns, by kind and start."""
    found: list[Span] = []
    if "@" in text:
        taken = 0
        for match in _DOMAIN.finditer(text):
            start = at = match.start()
            while start > taken and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                found.append((0, start, match.end()))
                taken = match.end()
    if not _DIGIT.search(text):
        return found
    for match in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in match[0].split(".")):
            found.append((1, match.start(), match.end()))
    for match in _CARD.finditer(text):
        digits = match[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append((2, match.start(), match.end()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 8 <= sum("0" <= c <= "9" for c in match[0]) <= 15:
                found.append((3, match.start(), match.end()))
    return found


def _luhn(digits: str) -> bool:
    values = [int(c) for c in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


@dataclass
class Model:
    params: Params
    letters: np.ndarray


TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def allowed_steps() -> np.ndarray:
    """0 where a tag may follow another, a large negative number elsewhere."""
    table = np.zeros((TAGS, TAGS), np.float32)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        table[:, inside] = -1e4
        table[inside - 1, inside] = table[inside, inside] = 0.0
    return table


def tags_of(spans: list[Span], size: int) -> np.ndarray:
    tags = np.zeros(size, np.int64)
    for kind, start, end in spans:
        if not tags[start:end].any():
            tags[start:end] = 2 + 2 * kind
            tags[start] = 1 + 2 * kind
    return tags


def _spread(scores: np.ndarray, axis: int) -> np.ndarray:
    top = scores.max(axis=axis, keepdims=True)
    return np.log(np.exp(scores - top).sum(axis=axis)) + top.squeeze(axis)


def marginals(emissions: np.ndarray, steps: np.ndarray, live: np.ndarray):
    """Log weights forward and backward, and the log of the total, for (steps, lanes, tags) emissions."""
    length = len(emissions)
    ahead, behind = np.zeros_like(emissions), np.zeros_like(emissions)
    ahead[0] = emissions[0]
    for t in range(1, length):
        moved = _spread(ahead[t - 1][:, :, None] + steps, 1) + emissions[t]
        ahead[t] = np.where(live[t][:, None], moved, ahead[t - 1])
    for t in range(length - 2, -1, -1):
        moved = _spread(steps[None] + (emissions[t + 1] + behind[t + 1])[:, None, :], 2)
        behind[t] = np.where(live[t + 1][:, None], moved, 0.0)
    return ahead, behind, _spread(ahead[-1], 1)


def best_paths(emissions: np.ndarray, steps: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Best tags (steps, lanes); dead steps are outside."""
    length, lanes, _ = emissions.shape
    score, back = emissions[0], []
    for t in range(1, length):
        both = score[:, :, None] + steps
        back.append(both.argmax(axis=1))
        score = np.where(live[t][:, None], both.max(axis=1) + emissions[t], score)
    tags = np.zeros((length, lanes), np.int64)
    last = score.argmax(axis=1)
    rows = np.arange(lanes)
    for t in range(length - 1, 0, -1):
        tags[t] = np.where(live[t], last, 0)
        last = np.where(live[t], back[t - 1][rows, last], last)
    tags[0] = np.where(live[0], last, 0)
    return tags


def train(texts: list[str], settings: Settings) -> Model:
    """Network and transitions from windows round labelled spans, and from others with digits or an @ or neither."""
    rng = np.random.default_rng(settings.seed)
    width = settings.window
    near, other = [], []
    for text in texts:
        spans = base_spans(text)
        tags = tags_of(spans, len(text))
        for _, start, end in spans:
            low = max(0, min(start - int(rng.integers(0, max(1, width - min(width - 1, end - start)))), len(text) - width))
            near.append((text[low : low + width], tags[low : low + width]))
        sign = _SIGN.search(text, int(rng.integers(0, len(text))))
        low = max(0, (sign.start() if sign else int(rng.integers(0, len(text)))) - int(rng.integers(0, width)))
        other.append((text[low : low + width], tags[low : low + width]))
    near = [near[i] for i in rng.permutation(len(near))[: settings.windows * 2 // 3]]
    other = [other[i] for i in rng.permutation(len(other))[: settings.windows // 3]]
    counts = np.zeros(0x110000, np.int64)
    for text, _ in near + other:
        counts += np.bincount([ord(c) for c in text], minlength=0x110000)
    ranked = np.argsort(-counts, kind="stable")[: settings.characters - 1]
    ranked = ranked[counts[ranked] > 0]
    letters = np.zeros(0x110000, np.uint8)
    letters[ranked] = np.arange(1, len(ranked) + 1)
    params: Params = {
        "letters": weights(rng, settings.characters, settings.char_size) * np.float32(5.0),
        "out": weights(rng, 2 * settings.hidden, TAGS),
        "bias": np.zeros(TAGS, np.float32),
        "steps": np.zeros((TAGS, TAGS), np.float32),
    }
    for way in "fb":
        params |= lstm_params(rng, f"char.{way}", settings.char_size, settings.hidden)
    if not near:
        params["bias"][0] = 30.0
        return Model(params, letters)
    examples = near + other
    codes = np.zeros((width, len(examples)), np.int64)
    gold = np.zeros((width, len(examples)), np.int64)
    live = np.zeros((width, len(examples)), bool)
    for at, (text, tags) in enumerate(examples):
        codes[: len(text), at] = letters[[ord(c) for c in text]]
        cut = tags.copy()
        for t in range(len(cut)):  # a span that began before the window begins anew
            if cut[t] > 0 and cut[t] % 2 == 0 and (t == 0 or cut[t - 1] not in (cut[t], cut[t] - 1)):
                cut[t] -= 1
        gold[: len(text), at], live[: len(text), at] = cut, True
    adam = Adam(params, settings.rate)
    for epoch in range(settings.epochs):
        adam.rate = settings.rate * (1.0 - 0.7 * epoch / settings.epochs)
        order = rng.permutation(len(examples))
        for low in range(0, len(order), settings.batch):
            own = order[low : low + settings.batch]
            adam.update(crf_gradient(params, codes[:, own], gold[:, own], live[:, own]))
    return Model(params, letters)


def crf_gradient(params: Params, codes: np.ndarray, gold: np.ndarray, live: np.ndarray) -> Params:
    """Gradient of the mean negative log likelihood of the gold tags."""
    inputs = params["letters"][codes]
    states, kept = both_ways(params, "char", inputs, live, lstm_states)
    emissions = states @ params["out"] + params["bias"]
    steps = params["steps"] + allowed_steps()
    ahead, behind, total = marginals(emissions, steps, live)
    lanes = codes.shape[1]
    share = np.exp(ahead + behind - total[:, None])
    delta = (share - np.eye(TAGS, dtype=np.float32)[gold]) * live[:, :, None] / lanes
    grad_steps = np.zeros_like(params["steps"])
    for t in range(1, len(codes)):
        pair = ahead[t - 1][:, :, None] + steps + (emissions[t] + behind[t])[:, None, :] - total[:, None, None]
        grad_steps += (np.exp(pair) * live[t][:, None, None]).sum(axis=0)
        np.add.at(grad_steps, (gold[t - 1][live[t]], gold[t][live[t]]), -1.0)
    delta = delta.astype(np.float32)
    flat = delta.reshape(-1, TAGS)
    grads = {
        "out": states.reshape(-1, states.shape[2]).T @ flat,
        "bias": flat.sum(axis=0),
        "steps": grad_steps / lanes,
    }
    own, grad = both_ways_gradient(params, "char", inputs, live, delta @ params["out"].T, kept, lstm_gradient)
    grads |= own
    grads["letters"] = np.zeros_like(params["letters"])
    np.add.at(grads["letters"], codes.ravel(), grad.reshape(-1, grad.shape[2]))
    return grads


def decoded_windows(texts: list[str], model: Model, settings: Settings, every: bool = False) -> list[list[tuple]]:
    """Spans (kind, start, end, sureness, whole) met in the windows of each text.

    ``every`` decodes windows without a digit or an @ as well.
    """
    found: list[list[tuple]] = [[] for _ in texts]
    owners, starts, parts = [], [], []
    for doc, text in enumerate(texts):
        last = max(0, len(text) - settings.window)
        spots = list(range(0, last, settings.stride)) + [last]
        if not every:
            # Only windows that reach a digit or an @.
            wanted = set()
            at = _SIGN.search(text)
            while at:
                low = max(0, (at.start() - settings.window) // settings.stride)
                wanted.update(range(low, min(len(spots), at.start() // settings.stride + 2)))
                at = _SIGN.search(text, at.start() + 1)
            spots = [s for n, s in enumerate(spots) if n in wanted or (s == last and wanted)]
        for start in spots:
            part = text[start : start + settings.window]
            if part and (every or _SIGN.search(part)):
                owners.append(doc)
                starts.append(start)
                parts.append(part)
    steps = model.params["steps"] + allowed_steps()
    for low in range(0, len(parts), 2048):
        own = parts[low : low + 2048]
        lengths = np.array([len(x) for x in own])
        live = np.arange(lengths.max())[:, None] < lengths
        codes = np.zeros(live.shape, np.int64)
        points = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes.T[live.T] = model.letters[points]
        states = looked_up_states(model.params, "char", model.params["letters"], codes, live, lstm_states)
        emissions = states @ model.params["out"] + model.params["bias"]
        tags = best_paths(emissions, steps, live)
        lanes = np.flatnonzero((tags > 0).any(axis=0))
        if not len(lanes):
            continue
        ahead, behind, total = marginals(emissions[:, lanes], steps, live[:, lanes])
        share = np.exp(ahead + behind - total[:, None])
        for at, lane in enumerate(lanes):
            doc, base = owners[low + lane], starts[low + lane]
            path = tags[: lengths[lane], lane]
            begins = np.flatnonzero(path % 2 == 1)
            for begin in begins:
                end = begin + 1
                while end < len(path) and path[end] == path[begin] + 1:
                    end += 1
                surety = float(share[np.arange(begin, end), at, path[begin:end]].min())
                whole = (begin > 0 or base == 0) and (end < len(path) or base + end == len(texts[doc]))
                found[doc].append(((int(path[begin]) - 1) // 2, int(base + begin), int(base + end), surety, whole))
    return found


def reconciled(text: str, spans: list[tuple], base: list[Span], settings: Settings) -> list[Span]:
    """Spans that the network adds to the base spans: sure, whole, with a digit or an @, and overlapping nothing."""
    best: dict[Span, float] = {}
    for kind, start, end, surety, whole in spans:
        if whole and surety >= settings.sure and _SIGN.search(text, start, end):
            best[kind, start, end] = max(surety, best.get((kind, start, end), 0.0))
    taken = [(start, end) for _, start, end in base]
    added: list[Span] = []
    for kind, start, end in sorted(best, key=lambda x: (-best[x], x[1], x[0], x[2])):
        if all(end <= low or start >= high for low, high in taken):
            taken.append((start, end))
            added.append((kind, start, end))
    return sorted(added)


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in spans)


def find_personal_data(documents: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts, digest and spans of personal data for every document.

    One row per input row. A null or empty text has zero counts, the digest of the empty text and an empty span list. Whole
    texts are scanned and decoded in windows. The sample of training texts is one document in each of ``sample`` slots of
    the texts' hash; without a labelled span in it the network adds nothing. Repeated rows are repeated; an empty table
    gives no rows; extra columns are not read.
    """
    spark: SparkSession = documents.sparkSession
    source = documents.select(documents["doc_id"].cast("bigint").alias("doc_id"), documents["text"])
    h = F.xxhash64("text")
    drawn = (
        source.where(F.length("text").between(1, settings.sample_chars) & F.col("text").rlike(r"@|[0-9]{3}"))
        .groupBy(F.pmod(h, F.lit(settings.sample)).alias("slot"))
        .agg(F.min_by("text", h).alias("text"))
        .orderBy("slot")
        .collect()
    )  # at most ``sample`` texts
    model = spark.sparkContext.broadcast(train([row["text"] for row in drawn], settings))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, most_bytes=4_000_000):
            texts = [x or "" for x in part.column("text").to_pylist()]
            rows = []
            for text, windows in zip(texts, decoded_windows(texts, model.value, settings)):
                base = base_spans(text)
                added = reconciled(text, windows, base, settings)
                kinds = [kind for kind, _, _ in base]
                digest = hashlib.sha256(spelled(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in range(4)), digest, spelled(sorted(base + added)), len(added)))
            columns = list(zip(*rows)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
            )

    return source.mapInArrow(scan, SCHEMA)
