"""Exact token counts of every prefix, so that truncation and budgets need no further encoding.

What is stored per text is one signed byte per code point: by how much the token count of the
prefix that ends there differs from that of the prefix before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pieces import LONG, PieceModel, UnitCache, load
from .scratch import bound_batches
from .text import cuts

_deltas: dict[str, UnitCache] = {}


def _unit_deltas(counts: list[int]) -> bytes:
    """The changes from prefix to prefix as signed bytes; one that does not fit, which no model with pieces of under 128 characters makes, is an error."""
    changes = [b - a for a, b in zip(counts, counts[1:], strict=False)]
    if changes and not -128 <= min(changes) <= max(changes) <= 127:
        raise ValueError("a token count changes by more than a signed byte holds")
    return bytes([x & 255 for x in changes])


def deltas(model: PieceModel, texts: list[str], cache: UnitCache) -> list[bytes]:
    """For each text a signed byte per code point, the change in token count that it makes."""
    if not model.plain:
        raise ValueError("prefix counts need a model that does not rewrite its text")
    cut = [model.units(text) for text in texts]
    new = set().union(*cut).difference(cache)
    for unit in [u for u in new if u in cache.older]:
        cache.keep(unit, cache.older[unit])
        new.discard(unit)
    for unit, counts in model.prefix_counts(u for u in new if len(u) <= LONG):
        cache.keep(unit, _unit_deltas(counts))
    out = []
    for units in cut:
        whole = b"".join(map(cache.__getitem__, units))
        # the first two belong together: the mark before the text has no code point of its own
        out.append(bytes([(whole[0] + whole[1]) & 255]) + whole[2:] if whole else b"")
    return out


def delta_cache(model: PieceModel) -> UnitCache:
    """Deltas by unit, found one by one where a batch has not found them together."""
    return UnitCache(lambda unit: _unit_deltas(model.prefixes(unit)[0]))


def counts_of(stored: bytes) -> np.ndarray:
    """Token counts of the prefixes of length 0, 1, 2, ... from what is stored."""
    return np.concatenate([[0], np.cumsum(np.frombuffer(stored, np.int8), dtype=np.int64)])


def longest_within(stored: bytes, budget: int) -> int:
    """Code points in the longest prefix of at most ``budget`` tokens (counts may fall as a prefix grows)."""
    return int(np.flatnonzero(counts_of(stored) <= budget)[-1]) if budget >= 0 else 0


def prefix_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, prefix_deltas binary) of every row; null and empty texts have 0 tokens.

    No begin, end or other special token is counted, and special strings in a text are plain
    text. Ids may be null or repeat. Rows come out as they are in ``docs``.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        cache = _deltas.setdefault(model_path, delta_cache(model))
        for batch in batches:
            for cut in cuts(batch, "text", 1 << 20):
                texts = [t or "" for t in cut.column(1).to_pylist()]
                found = deltas(model, texts, cache)
                sizes = [len(t) if t.isascii() else len(t.encode()) for t in texts]
                totals = [int(np.frombuffer(d, np.int8).sum(dtype=np.int64)) for d in found]
                yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array(found, pa.binary())], ["id", "n_bytes", "n_tokens", "prefix_deltas"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, prefix_deltas binary")
    return out.withColumnRenamed("id", id_col)


def fitting_chars(stored: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens, from stored deltas; null for null."""

    @F.pandas_udf(T.LongType())
    def run(column):
        import pandas as pd

        return pd.Series([None if x is None else longest_within(x, budget) for x in column], dtype="Int64")

    return run(stored)


def tokens_of_prefix(stored: Column, chars: Column) -> Column:
    """Token count of the prefix of ``chars`` code points (the whole text's, if it is shorter); null for a null of either."""

    @F.pandas_udf(T.LongType())
    def run(column, lengths):
        import pandas as pd

        known = [None if x is None or pd.isna(k) else int(np.frombuffer(x, np.int8)[: max(0, int(k))].sum(dtype=np.int64)) for x, k in zip(column, lengths, strict=True)]
        return pd.Series(known, dtype="Int64")

    return run(stored, chars)
