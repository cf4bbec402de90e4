"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A sketch of a long document says nothing of a short item in it, so containment is tested one way, as in containment
MinHash: an item's bottom-k sketch against all shingles of the document. Items are partitioned by their number of shingles (powers of two). Each item of a partition is
sketched by its ``k`` smallest shingle hashes, ``k`` being one more than the shingles that an
item of the partition's largest size may lack. A document that holds the share asked for must
hold one of the ``k``, so the search misses nothing; candidates are verified on the shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import bound_batches, materialise
from .text import Words, combined, cuts


def item_shingles(text: str | None, width: int) -> list[bytes]:
    """Distinct shingles of a text, in order: ``width`` words each, or all its words if they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    spans = range(max(1, len(words) - width + 1))
    return list(dict.fromkeys(b" ".join(words[i : i + width]) for i in spans))


@dataclass
class Sketches:
    """Sketches of a block of items: sorted ``hashes`` with the ``item`` each belongs to, and the items."""

    ids: list
    shingles: list[list[bytes]]
    widths: dict[int, tuple[np.ndarray, np.ndarray]]


def least_shared(n: int, share: float) -> int:
    """The fewest of ``n`` shingles that are at least ``share`` of them."""
    return math.ceil(share * n - 1e-9)


def sketch_size(n: int, share: float) -> int:
    """Sketch length of the partition of sizes that ``n`` falls in: its largest size's misses and one more."""
    top = (1 << n.bit_length()) - 1
    return min(n, top - least_shared(top, share) + 1)


def sketch(items: list[tuple[object, str | None]], width: int, share: float) -> Sketches:
    """Sketches of ``items``; items without words are left out, since nothing contains them."""
    kept = [(i, s) for i, t in items if (s := item_shingles(t, width))]
    found: dict[int, list[tuple[int, int]]] = {}
    for k, (_, shingles) in enumerate(kept):
        words = shingles[0].count(b" ") + 1
        lists = Words(pa.array([s.decode("utf-8", "surrogateescape") for s in shingles]), lower=False)
        hashes = np.sort(combined_rows(lists.hashes(), words))
        for h in hashes[: sketch_size(len(shingles), share)]:
            found.setdefault(words, []).append((int(h), k))
    widths = {}
    for words, pairs in found.items():
        pairs.sort()
        widths[words] = np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs], np.int64)
    return Sketches([i for i, _ in kept], [s for _, s in kept], widths)


def combined_rows(hashes: np.ndarray, words: int) -> np.ndarray:
    """The hash of each consecutive, non-overlapping group of ``words`` word hashes."""
    return combined(hashes, words)[::words]


def candidates(words: Words, sketches: Sketches) -> list[tuple[int, int]]:
    """(text, item) pairs that share a sketch value."""
    hashes = words.hashes()
    found: set[tuple[int, int]] = set()
    for width, (values, items) in sketches.widths.items():
        grams = combined(hashes, width)
        at = np.searchsorted(values, grams)
        at[at == values.size] = 0
        for g in np.flatnonzero(values[at] == grams):
            text = int(np.searchsorted(words.edges, g, side="right")) - 1
            if g + width > words.edges[text + 1]:
                continue  # it runs over the text's end
            k = int(at[g])
            while k < values.size and values[k] == grams[g]:
                found.add((text, int(items[k])))
                k += 1
    return sorted(found)


def contained(words: Words, text: int, shingles: list[bytes]) -> int:
    """How many of ``shingles`` occur in the text as runs of words."""
    own = slice(words.edges[text], words.edges[text + 1])
    tokens = [words.buf[s:e].tobytes() for s, e in zip(words.starts[own], words.ends[own], strict=True)]
    width = shingles[0].count(b" ") + 1
    wanted = set(shingles)
    return len(wanted & {b" ".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)})


def item_blocks(items: DataFrame, item_id: str, item_text: str, most: int) -> Iterator[tuple[list, bool]]:
    """(items, whether more follow) in blocks of about ``most`` bytes of text; one block at a time is on the driver."""
    total = items.agg(F.sum(F.octet_length(F.col(item_text)) + 64)).first()[0] or 0
    blocks = max(1, -(-total // most))
    rows = items.select(item_id, item_text)
    part = F.pmod(F.xxhash64(item_id, item_text), F.lit(blocks))
    for b in range(blocks):
        yield [tuple(r) for r in (rows.filter(part == b) if blocks > 1 else rows).collect()], b < blocks - 1


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, share: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """(id, item id, n_shared, n_shingles, containment) for every document and item it contains.

    ``containment`` is the share of the item's distinct shingles (``width`` words, A-Z
    lower-cased; an item of fewer words is one shingle) that the document holds; pairs of at
    least ``share`` are returned. Items without words, null items and null texts match nothing.
    Rows are not merged: a repeated document row repeats its pairs, and so does an item row.

    Items are searched in blocks of at most about ``block_bytes`` of text, each a pass over
    ``docs`` that is finished before the next block is read; only a block's sketches and shingles travel to the tasks.
    """
    bound_batches(docs.sparkSession)
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, n_shared bigint, n_shingles bigint, containment double"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = None
    for block, more in item_blocks(items, item_id, item_text, block_bytes):
        found = rows.mapInArrow(_search(sketch(block, width, share), share), schema)
        found = materialise(found, "contained") if more or out is not None else found
        out = found if out is None else out.union(found)
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_id), "n_shared", "n_shingles", "containment")


def _search(sketches: Sketches, share: float):
    ids = sketches.ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in cuts(batch, "text"):
                words = Words(cut.column(1))
                hits = []
                for text, item in candidates(words, sketches):
                    wanted = sketches.shingles[item]
                    shared = contained(words, text, wanted)
                    if shared >= least_shared(len(wanted), share):
                        hits.append((text, ids[item], shared, len(wanted)))
                if hits:
                    texts, items, shared, sizes = zip(*hits, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [cut.column(0).take(pa.array(texts)), pa.array(items), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64()), pa.array([a / b for a, b in zip(shared, sizes, strict=True)], pa.float64())],
                        ["id", "item", "n_shared", "n_shingles", "containment"],
                    )

    return run


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, share: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item; texts are judged row by row."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    for block, more in item_blocks(items, item_id, item_text, block_bytes):
        docs = docs.mapInArrow(_clean(sketch(block, width, share), share, at), docs.schema)
        docs = materialise(docs, "clean") if more else docs
    return docs


def _clean(sketches: Sketches, share: float, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in cuts(batch, batch.schema.names[at]):
                words = Words(cut.column(at))
                keep = np.ones(cut.num_rows, bool)
                for text, item in candidates(words, sketches):
                    wanted = sketches.shingles[item]
                    if keep[text] and contained(words, text, wanted) >= least_shared(len(wanted), share):
                        keep[text] = False
                yield cut.filter(pa.array(keep))

    return run
