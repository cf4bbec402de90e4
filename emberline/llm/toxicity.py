"""Toxicity by compression distance: which of two dictionaries packs a text's windows smaller.

Both dictionaries are trained by Zstandard. The ordinary one is trained on the ordinary texts. The toxic one is that, and behind it what is
trained on the toxic texts alone, of which only the segments are taken that these use far more often than
the ordinary ones do: a whole toxic text is mostly ordinary prose, which would fill the dictionary. The ordinary
one is padded to the same length, so that references to what both hold cost the same. A window of words that compresses
shorter with the toxic dictionary is evidence, and thresholds on a text's window
differences are calibrated on documents that the dictionaries were not trained on.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import bound_batches
from .text import Words, cuts

WINDOW_WORDS, WINDOW_BYTES, LEVEL = 8, 512, 3
FEATURES = 6
SEGMENT = 6  # bytes of a segment
ORDINARY_BYTES, TOXIC_BYTES = 64 << 10, 2 << 10
LEAD, RATIO = 3.0, 5.0  # what makes a segment a class's own: its lead in standard deviations, and how many times as often it must occur
DICT_MAGIC = b"\x37\xa4\x30\xec"
FIRST_REPEATS = bytes([1, 0, 0, 0, 4, 0, 0, 0, 8, 0, 0, 0])  # ends the header of a trained dictionary; its content follows


@dataclass
class ToxicityModel:
    """The two dictionaries, and the calibration of window differences to a score."""

    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    shift: float


def _trained(samples: list[bytes], size: int, piece: int) -> bytes:
    """The content of a dictionary that Zstandard's trainer makes of ``samples``; of too few, their end."""
    samples = [x for x in samples if len(x) >= 8]
    try:
        whole = zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 2)), samples, k=piece, d=SEGMENT).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]
    return whole[whole.index(FIRST_REPEATS) + len(FIRST_REPEATS) :] if whole[:4] == DICT_MAGIC else whole


def _segments(text: bytes) -> np.ndarray:
    """Each run of ``SEGMENT`` bytes of ``text`` as a number."""
    data = np.frombuffer(text, np.uint8).astype(np.uint64)
    out = np.zeros(max(0, data.size - SEGMENT + 1), np.uint64)
    for j in range(SEGMENT if out.size else 0):
        out = (out << np.uint64(8)) | data[j : j + out.size]
    return out


def _spread(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(segment, number of texts that hold it), sorted."""
    return np.unique(np.concatenate([np.unique(_segments(t)) for t in texts]), return_counts=True)


def _own(text: bytes, own: np.ndarray) -> bytes:
    """The parts of ``text`` that segments of the sorted ``own`` cover, one after the other."""
    keys = _segments(text)
    if not keys.size or not own.size:
        return b""
    at = np.searchsorted(own, keys)
    at[at == own.size] = 0
    begins = np.flatnonzero(own[at] == keys)
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + SEGMENT, -1)
    return np.frombuffer(text, np.uint8)[np.cumsum(change)[:-1] > 0].tobytes()


def dictionaries(toxic: list[str], ordinary: list[str], seed: int = 1) -> tuple[bytes, bytes]:
    """(ordinary, toxic) raw-content dictionaries trained on the texts of each class; a text that repeats counts once."""
    bad, plain = ([b" " + b" ".join(t.encode().lower().split()) + b" " for t in dict.fromkeys(texts)] for texts in (toxic, ordinary))
    windows = []
    for text in plain:
        words = text.split()
        windows += [b" " + b" ".join(words[k : k + WINDOW_WORDS]) + b" " for k in range(0, len(words), WINDOW_WORDS)]
    random.Random(seed).shuffle(windows)
    base = _trained(windows[:60_000], ORDINARY_BYTES, 24)
    keys, n = _spread(bad)
    others, m = _spread(plain)
    at = np.searchsorted(others, keys)
    at[at == others.size] = 0
    there = np.where(others[at] == keys, m[at], 0) * (len(bad) / len(plain))
    own = keys[((n - there) / np.sqrt(n + there + 1) > LEAD) & (n > RATIO * there)]
    part = _trained([x for x in (_own(t, own) for t in bad) if x], TOXIC_BYTES, 16)
    return base + bytes(len(part)), base + part


def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=how)
    data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=how)


class Scorer:
    """Window differences, their features and scores, for batches of texts."""

    def __init__(self, ordinary: bytes, toxic: bytes) -> None:
        self.ordinary, self.toxic = _packer(ordinary), _packer(toxic)

    def features(self, column: pa.Array) -> np.ndarray:
        """Per text: whether it has windows, and the largest, second largest, share and number of large, and mean difference."""
        words = Words(column)
        buf, starts, ends = words.spaced()
        whole = b" " + buf.tobytes()  # byte k of the buffer is byte k + 1 of this
        plain, toxic = self.ordinary.compress, self.toxic.compress
        out = np.zeros((len(column), FEATURES))
        for i in range(len(column)):
            lo, hi = int(words.edges[i]), int(words.edges[i + 1])
            if lo == hi:
                continue
            spans = zip(starts[lo:hi:WINDOW_WORDS].tolist(), [*starts[lo + WINDOW_WORDS : hi : WINDOW_WORDS].tolist(), int(ends[hi - 1])], strict=True)
            found = []
            for a, b in spans:
                for at in range(a, max(b, a + 1), WINDOW_BYTES):
                    window = whole[at : min(b, at + WINDOW_BYTES) + 1]
                    found.append(len(plain(window)) - len(toxic(window)))
            d = np.array(found)
            top = np.partition(d, d.size - 2)[-2:] if d.size > 1 else np.array([0, d[0]])
            large = int((d >= 2).sum())
            out[i] = 1.0, min(top[1], 12), min(top[0], 12), large / d.size * 10, np.log1p(large), np.clip(d.mean(), -5, 5)
        return out


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * np.clip(p * (1 - p), 1e-6, None))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_shift(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The logit above which calling a text toxic gives the best F1."""
    order = np.argsort(-logits, kind="stable")
    hit, all_ = np.cumsum(weight[order] * y[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * y).sum())
    k = int(np.argmax(f1))
    after = logits[order[k + 1]] if k + 1 < order.size else logits[order[k]] - 1
    return float((logits[order[k]] + after) / 2)


def fit(toxic: list[str], ordinary: list[str], counts: tuple[int, int] | None = None, parts: int = 4) -> ToxicityModel:
    """A model from labelled texts; ``counts`` are the classes' sizes (toxic, ordinary) where the texts are a sample.

    Window differences for the calibration come from dictionaries trained on the
    texts of the other ``parts``. Without texts of both classes the model scores every text 0.
    """
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"", np.array([0.0] * FEATURES + [-20.0]), 0.0)
    counts = counts or (len(toxic), len(ordinary))
    x, y = [], []
    for part in range(parts):
        rest = [[t for k, t in enumerate(texts) if k % parts != part] or texts for texts in (toxic, ordinary)]
        scorer = Scorer(*dictionaries(*rest))
        for label, texts in ((1, toxic[part::parts]), (0, ordinary[part::parts])):
            if texts:
                x.append(scorer.features(pa.array(texts)))
                y += [label] * len(texts)
    x, y = np.concatenate(x), np.array(y)
    weight = np.where(y == 1, counts[0] / max(1, (y == 1).sum()), counts[1] / max(1, (y == 0).sum()))
    weight *= len(y) / weight.sum()
    weights = fit_logistic(x, y, weight)
    shift = best_shift(np.column_stack([x, np.ones(len(x))]) @ weights, y, weight)
    return ToxicityModel(*dictionaries(toxic, ordinary), weights, shift)


def fold(id_col: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(id_col.cast("string")) % parts


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", parts: int = 5, held_out: int = 0, most: int = 1500, most_bytes: int = 8 << 20) -> ToxicityModel:
    """A model from the whole texts of at most ``most`` labelled documents of each class.

    Rows of fold ``held_out``, with a null id or without a label of 0 or 1 are not learned
    from; the sample is the smallest ids by hash, fewer where their texts are over ``most_bytes`` together.
    An id that several labels name counts as toxic if one says so.
    """
    own = labels.filter(F.col(label_col).isin(0, 1) & (fold(F.col(id_col), parts) != held_out))
    own = own.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    chosen, sizes = [], []
    for y in (1, 0):
        some = own.filter(F.col("y") == y)
        sizes.append(some.count())
        chosen.append(some.orderBy(F.xxhash64("id"), "id").limit(most))
    ids = chosen[0].union(chosen[1])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).filter("t IS NOT NULL").join(F.broadcast(ids), "id").groupBy("id").agg(F.min("t").alias("t"), F.max("y").alias("y"))
    before = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("t").cast("long")
    rows = rows.withColumn("held", F.coalesce(F.sum(size).over(before), F.lit(0).cast("long")) + size).filter((F.col("held") <= most_bytes) | (F.col("held") == size)).drop("held").collect()
    rows.sort(key=lambda r: r.id)
    return fit([r.t for r in rows if r.y == 1], [r.t for r in rows if r.y == 0], (sizes[0], sizes[1]))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, over the whole text; ids may be null or repeat, a null text is an empty one.

    ``score`` is 0.5 or more where the model calls a text toxic. A text without words has no
    window and scores what the calibration gives for none.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.ordinary, model.toxic)
        for batch in batches:
            for cut in cuts(batch, "text", 1 << 20):
                logits = scorer.features(cut.column(1)) @ model.weights[:-1] + model.weights[-1] - model.shift
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -500, 500))), pa.float64())], ["id", "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that score under 0.5."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.ordinary, model.toxic)
        for batch in batches:
            for cut in cuts(batch, batch.schema.names[at], 1 << 20):
                logits = scorer.features(cut.column(at)) @ model.weights[:-1] + model.weights[-1] - model.shift
                yield cut.filter(pa.array(logits < 0))

    return docs.mapInArrow(run, docs.schema)
