"""Vectorised words and hashes over Arrow string columns.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; lower-casing touches A-Z only.
Everything works on the batch's byte buffer with numpy, so there is no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PAD = 8
WORD_BYTE = np.ones(256, dtype=bool)
WORD_BYTE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

# The five primes of XXH64.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, starting at offset 0; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    edges = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[edges[0] : edges[-1]], edges - edges[0]


def cuts(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of ``column``; one row at least in each."""
    at = batch.schema.get_field_index(column)
    _, edges = raw(batch.column(at))
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(edges, edges[first] + most, side="right")) - 1
        last = min(max(last, first + 1), batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


class Words:
    """The words of a batch of texts.

    ``buf``: bytes, padded; ``starts``/``ends``: each word's span in it; ``edges``: text i has
    the words ``edges[i]:edges[i+1]``; ``offsets``: text i is ``buf[offsets[i]:offsets[i+1]]``.
    """

    def __init__(self, column: pa.Array, lower: bool = True) -> None:
        data, self.offsets = raw(column)
        n = data.size
        self.buf = np.zeros(n + PAD, np.uint8)
        self.buf[:n] = LOWER[data] if lower else data
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = WORD_BYTE[data]
        cut = np.zeros(n + 1, bool)
        cut[self.offsets] = True
        self.inside = inside[1:-1]
        self.starts = np.flatnonzero(inside[1:] & (cut | ~inside[:-1])).astype(np.int64)
        self.ends = np.flatnonzero(inside[:-1] & (cut | ~inside[1:])).astype(np.int64)
        self.edges = np.searchsorted(self.starts, self.offsets).astype(np.int64)

    @property
    def lens(self) -> np.ndarray:
        return self.ends - self.starts

    @property
    def per_text(self) -> np.ndarray:
        return np.diff(self.edges)

    def owners(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.edges.size - 1), self.per_text)

    def hashes(self, seed: int = 42) -> np.ndarray:
        return xxh64(self.buf, self.starts, self.lens, seed)

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(buffer, starts, ends) of the same words with one space after each."""
        lens = self.lens
        starts = np.zeros(lens.size, np.int64)
        np.cumsum(lens[:-1] + 1, out=starts[1:])
        total = int(lens.sum() + lens.size)
        out = np.full(total + PAD, 0x20, np.uint8)
        at = np.flatnonzero(self.inside)
        out[at + np.repeat(starts - self.starts, lens)] = self.buf[at]
        return out, starts, starts + lens


def sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each segment ``edges[i]:edges[i+1]``; empty segments give 0."""
    total = np.zeros(values.size + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def _left(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(x: np.ndarray) -> np.ndarray:
    return _left(x * P2, 31) * P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of ``buf[starts[i]:starts[i]+lens[i]]``; ``buf`` has eight bytes to spare at its end."""
    out = np.empty(starts.size, np.uint64)
    if not starts.size:
        return out
    eight = np.ndarray((buf.size - 7,), "<u8", buf, strides=(1,))
    four = np.ndarray((buf.size - 3,), "<u4", buf, strides=(1,))
    order = np.argsort(lens.astype(np.uint16) if lens.max() < 65536 else lens, kind="stable")
    ranked = lens[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(ranked)) + 1, [ranked.size]])
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        mine, n = order[lo:hi], int(ranked[lo])
        if mine.size < 4:
            for i in mine:
                out[i] = xxhash.xxh64_intdigest(buf[starts[i] : starts[i] + n].tobytes(), seed)
            continue
        for part in range(0, mine.size, 1 << 15):
            some = mine[part : part + (1 << 15)]
            out[some] = _one_length(buf, eight, four, starts[some], n, np.uint64(seed))
    return out


def _one_length(buf: np.ndarray, eight: np.ndarray, four: np.ndarray, at: np.ndarray, n: int, seed: np.uint64) -> np.ndarray:
    done = 0
    with np.errstate(over="ignore"):
        if n >= 32:
            lanes = [np.full(at.size, x, np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            while done + 32 <= n:
                for k in range(4):
                    lanes[k] = _left(lanes[k] + eight[at + (done + 8 * k)] * P2, 31) * P1
                done += 32
            h = _left(lanes[0], 1) + _left(lanes[1], 7) + _left(lanes[2], 12) + _left(lanes[3], 18)
            for k in range(4):
                h = (h ^ _mixed(lanes[k])) * P1 + P4
        else:
            h = np.full(at.size, seed + P5, np.uint64)
        h = h + np.uint64(n)
        while done + 8 <= n:
            h = _left(h ^ _mixed(eight[at + done]), 27) * P1 + P4
            done += 8
        if done + 4 <= n:
            h = _left(h ^ (four[at + done].astype(np.uint64) * P1), 23) * P2 + P3
            done += 4
        while done < n:
            h = _left(h ^ (buf[at + done].astype(np.uint64) * P5), 11) * P1
            done += 1
        h = (h ^ (h >> np.uint64(33))) * P2
        h = (h ^ (h >> np.uint64(29))) * P3
        return h ^ (h >> np.uint64(32))


def combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` consecutive items, ``hashes.size - width + 1`` of them."""
    n = max(0, hashes.size - width + 1)
    h = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        h = _left(h ^ (hashes[k : k + n] * P2), 27) * P1 + P4
    h = (h ^ (h >> np.uint64(33))) * P2
    return h ^ (h >> np.uint64(29))


def windows(edges: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, text) of every run of ``width`` words inside one text."""
    counts = np.maximum(np.diff(edges) - width + 1, 0)
    owner = np.repeat(np.arange(counts.size), counts)
    first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(edges[:-1], counts)
    return first, owner
