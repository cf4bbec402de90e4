"""Secret scanning: fixed patterns, and character Markov models of random and ordinary strings."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches
from .text import cuts, raw

KINDS = ("assign", "access", "hex", "random")

# The patterns of the known kinds (letters of the key words in either case).
ASSIGN = re.compile(rb"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
LEAST = 16  # characters of a random string: the shortest that the models are trained on

HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True
CANDIDATE = np.zeros(256, bool)
CANDIDATE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")] = True
SYMBOLS = 68  # a class for each candidate byte, and one for the string's edge
CLASS = np.zeros(256, np.int64)
CLASS[np.flatnonzero(CANDIDATE)] = np.arange(1, SYMBOLS)


class CharMarkov:
    """An order-``order`` character model: log2 probabilities with additive smoothing towards the order below."""

    def __init__(self, samples: Iterable[str], order: int = 2, weight: float = 2.0) -> None:
        self.order = order
        counts = [np.zeros((SYMBOLS,) * (k + 1)) for k in range(order + 1)]
        for sample in samples:
            codes = [0] * order + [int(c) for c in CLASS[np.frombuffer(sample.encode(), np.uint8)]]
            for at in range(order, len(codes)):
                for k in range(order + 1):
                    counts[k][tuple(codes[at - k : at + 1])] += 1
        prob = np.full(SYMBOLS, 1 / SYMBOLS)
        for k in range(order + 1):
            seen = counts[k].sum(axis=-1, keepdims=True)
            prob = (counts[k] + weight * np.broadcast_to(prob, counts[k].shape)) / (seen + weight)
        self.log = np.log2(prob).ravel()

    def score(self, text: bytes) -> float:
        """Mean log2 probability of a character of ``text``."""
        return float(self.each(text).mean())

    def each(self, text: bytes) -> np.ndarray:
        """Log2 probability of each character of ``text``."""
        codes = np.concatenate([np.zeros(self.order, np.int64), CLASS[np.frombuffer(text, np.uint8)]])
        at = np.zeros(len(text), np.int64)
        for k in range(self.order + 1):
            at = at * SYMBOLS + codes[k : k + len(text)]
        return self.log[at]


def labelled_samples(words: list[str], n: int = 4000, seed: int = 7) -> list[tuple[str, int]]:
    """(string, 1 if random) for training: drawn strings over the usual alphabets, and joined words.

    Ordinary strings are one to four of ``words`` joined as identifiers, paths and long words
    are, some with a number. The draw is fixed by ``seed``.
    """
    draw = random.Random(seed)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    sets = ["0123456789abcdef", "0123456789ABCDEF", lower + digits, upper + digits, lower + upper + digits, lower + upper + digits + "+/", lower + upper + digits + "-_"]
    out = [("".join(draw.choice(chars) for _ in range(draw.randrange(16, 65))), 1) for chars in sets for _ in range(n // len(sets))]
    joins = [lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: "".join(x.capitalize() for x in w), lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: "".join(w), lambda w: "_".join(w).upper()]
    while len(out) < 2 * n:
        text = draw.choice(joins)([draw.choice(words) for _ in range(draw.randrange(2, 7))])
        if draw.random() < 0.2:
            text += draw.choice(["", "_", "-"]) + str(draw.randrange(10 ** draw.randrange(1, 5)))
        if len(text) >= 8:
            out.append((text[:64], 0))
    return out


def vocabulary_words(model_path: str) -> list[str]:
    """Words of a public vocabulary: pieces of at least three ASCII letters that begin a word, and syllables."""
    from .pieces import load

    return sorted({p.lstrip("▁").lower() for p in load(model_path).ids if re.fullmatch("▁?[A-Za-z]{3,}", p)})


class SecretModel:
    """Two character models and the log-likelihood ratio, per character, from which a string counts as random."""

    def __init__(self, samples: list[tuple[str, int]], order: int = 2, false_rate: float = 1e-3) -> None:
        train, held = samples[::2], samples[1::2]
        self.random = CharMarkov((s for s, y in train if y), order)
        self.ordinary = CharMarkov((s for s, y in train if not y), order)
        scores = sorted(self.ratio(s.encode()) for s, y in held if not y)
        self.bits, self.least = math.inf, LEAST
        sums = sorted(self.best(s.encode())[0] for s, y in held if not y)
        self.threshold = max(0.0, scores[min(len(scores) - 1, math.ceil((1 - false_rate) * len(scores)))]) if scores else 0.0
        self.bits = max(0.0, sums[min(len(sums) - 1, math.ceil((1 - false_rate) * len(sums)))]) if sums else 0.0

    def ratio(self, text: bytes) -> float:
        """Log2 likelihood ratio of random to ordinary, per character."""
        return self.random.score(text) - self.ordinary.score(text)

    def is_secret(self, text: bytes) -> bool:
        """Whether a candidate has digits and letters and its ratio is over the threshold."""
        kinds = sum(bool(re.search(k, text)) for k in (rb"[0-9]", rb"[A-Za-z]"))
        return kinds == 2 and self.ratio(text) > self.threshold

    def best(self, text: bytes) -> tuple[float, int, int]:
        """(bits, start, end) of the part of ``text`` with the largest sum of ratios; 0 bits if it cannot be a key.

        Ends within four characters of one of ``/_=-`` or the end of ``text`` are moved there; a
        part must then have ``least`` characters, digits and letters.
        """
        total = np.concatenate([[0.0], np.cumsum(self.random.each(text) - self.ordinary.each(text))])
        low = np.minimum.accumulate(total)
        end = int(np.argmax(total - low))
        start = int(np.argmin(total[: end + 1]))
        bits = float(total[end] - total[start])
        for k in range(1, 5):
            if start - k < 0 or text[start - k] in b"/_=-":
                start -= k - 1
                break
        for k in range(5):
            if end + k >= len(text) or text[end + k] in b"/_=-":
                end += k
                break
        part = text[start:end]
        fits = len(part) >= self.least and re.search(rb"[0-9]", part) and re.search(rb"[A-Za-z]", part)
        return (bits if fits else 0.0), start, end

    def secrets(self, text: bytes) -> list[tuple[int, int]]:
        """(start, end) of the parts of a run that count as random: the whole of it, or parts of the most evidence."""
        if len(text) < self.least:
            return []
        bits, start, end = self.best(text)
        if bits <= self.bits or len(text) - (end - start) < 8:
            return [(0, len(text))] if self.is_secret(text) or bits > self.bits else []
        rest = [(start, end)] + self.secrets(text[:start])
        return rest + [(end + a, end + b) for a, b in self.secrets(text[end:])]


@lru_cache(maxsize=2)
def default_model(model_path: str) -> SecretModel:
    return SecretModel(labelled_samples(vocabulary_words(model_path)))


def runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the maximal runs of at least ``least`` marked bytes within one text."""
    padded = np.zeros(inside.size + 2, bool)
    padded[1:-1] = inside
    cut = np.zeros(inside.size + 1, bool)
    cut[offsets] = True
    starts = np.flatnonzero(padded[1:] & (cut | ~padded[:-1]))
    ends = np.flatnonzero(padded[:-1] & (cut | ~padded[1:]))
    long = ends - starts >= least
    return starts[long], ends[long]


def gaps(start: int, end: int, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of start to end that no span of the sorted ``spans`` covers."""
    for s, _, e in spans:
        if e > start and s < end:
            if s > start:
                yield start, s
            start = e
    if start < end:
        yield start, end


def text_spans(column: pa.Array, model: SecretModel, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """Per text its spans (start, kind's place in ``KINDS``, end) in bytes, sorted.

    The known kinds are matched leftmost and without overlap, each for itself. ``random`` spans
    are runs of at least ``least`` characters ``[A-Za-z0-9+/_=-]``, outside the spans of the known
    kinds, that the models call random, or the parts of such runs that they do.
    """
    data, offsets = raw(column)
    found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    whole = data.tobytes()
    for i in range(len(column)):
        lo, hi = int(offsets[i]), int(offsets[i + 1])
        text = whole[lo:hi]
        if b"=" in text or b":" in text:
            found[i] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
        if b"AKIA" in text:
            found[i] += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    for start, end in zip(*runs(HEX[data], offsets, HEX_LEAST), strict=True):
        i = int(np.searchsorted(offsets, start, side="right")) - 1
        found[i].append((int(start - offsets[i]), 2, int(end - offsets[i])))
    known = [sorted(spans) for spans in found]
    for start, end in zip(*runs(CANDIDATE[data], offsets, least), strict=True):
        i = int(np.searchsorted(offsets, start, side="right")) - 1
        a, b = int(start - offsets[i]), int(end - offsets[i])
        for c, d in gaps(a, b, known[i]):
            if d - c >= least:
                found[i] += [(c + x, 3, c + y) for x, y in model.secrets(whole[int(offsets[i]) + c : int(offsets[i]) + d])]
    return [sorted(spans) for spans in found]


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans with byte places turned into code point places."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[s]), k, int(before[e])) for s, k, e in spans]


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", model: SecretModel | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row.

    ``spans`` lists kind:start:end in code points, end exclusive, by start and then kind;
    ``base_sha256`` is the SHA-256 of the same list of the known kinds alone. A null text is an
    empty one: counts 0 and an empty list. Ids may be null or repeat.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model or default_model(model_path)
        for batch in batches:
            for cut in cuts(batch, "text"):
                data, offsets = raw(cut.column(1))
                rows = []
                for i, spans in enumerate(text_spans(cut.column(1), own)):
                    spans = in_code_points(data[offsets[i] : offsets[i + 1]].tobytes(), spans) if spans else spans
                    counts = [sum(k == n for _, k, _ in spans) for n in range(4)]
                    base = joined(x for x in spans if x[1] < 3)
                    rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), joined(spans)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [cut.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string()), pa.array(columns[5], pa.string())],
                    ["id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
                )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string")
    return out.withColumnRenamed("id", id_col)
