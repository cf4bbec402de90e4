"""SentencePiece encoding that keeps source offsets, and decoding.

Normalisation goes by the longest prefix in the model's compiled character map and notes
where in the source each byte comes from; each piece is projected on the source bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import PieceModel, UnitCache, load, packed
from .scratch import bound_batches
from .text import cuts

_units: dict[str, UnitCache] = {}


def _encoded(model: PieceModel, unit: str) -> tuple[bytes, bytes, str]:
    """(ids, normalised length of each id's piece, as little-endian unsigned 32-bit integers, and what they decode to within a text)."""
    ids, sizes = [], []
    for piece in model.unit_pieces(unit):
        own = model.piece_ids(piece)
        ids += own
        size = len(piece.encode())
        sizes += [size] if len(own) == 1 else [1] * size  # a byte piece covers its byte
    inside = model.ids["a"]  # a piece before, as within a text a mark at the beginning is a blank
    return packed(ids), packed(sizes), model.decode([inside, *ids])[1:]


def encode(model: PieceModel, text: str, bos: bool = True, eos: bool = True, cache: UnitCache | None = None) -> tuple[np.ndarray, np.ndarray, str]:
    """(ids, spans, decoded text): spans[k] is (first, end) of the source bytes of the k-th id.

    The text is normalised by the compiled character map, which records where each byte comes from; its
    units are encoded (or known from ``cache``), and each piece is projected on the source through the record.
    Marks added before the text, begin and end ids have empty spans; bytes that normalisation
    drops belong to the piece before them.
    """
    source = text.encode()
    norm, origin = model.normalised(source)
    units = model.cut.findall(norm.decode()) if norm else []
    parts = [cache[unit] for unit in units] if cache is not None else [_encoded(model, unit) for unit in units]
    ids = np.frombuffer(b"".join([p[0] for p in parts]), "<u4")
    ends = np.cumsum(np.frombuffer(b"".join([p[1] for p in parts]), "<u4"), dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]]) if ends.size else ends
    framed, spans = _framed(model, ids, origin[starts], origin[ends], len(source), bos, eos)
    if model.plain:
        decoded = "".join([p[2] for p in parts])[1:]  # the added mark decodes to nothing
    else:
        decoded = model.decode(framed.tolist())
    return framed, spans, decoded


def _framed(model: PieceModel, ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int, bos: bool, eos: bool) -> tuple[np.ndarray, np.ndarray]:
    head, tail = [model.bos] * bos, [model.eos] * eos
    spans = np.empty((ids.size + bos + eos, 2), "<u4")
    spans[:bos], spans[spans.shape[0] - eos :] = 0, size
    spans[bos : bos + ids.size, 0], spans[bos : bos + ids.size, 1] = starts, ends
    return np.concatenate([head, ids, tail]).astype("<u4"), spans


def encode_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, ``carry`` columns, n_tokens, ids binary, spans binary, decoded) of every row; a null text is an empty one.

    ``ids``: little-endian unsigned 32-bit integers; ``spans``: for each id the first and end
    byte of its source, as two such integers; ``decoded``: what the ids decode to. Ids may be
    null or repeat; an empty text has the begin and end ids alone.
    """
    bound_batches(docs.sparkSession, rows=1000, size="4m")
    kinds = [docs.schema[c].dataType.simpleString() for c in (id_col, *carry)]
    names = [f"c{k}" for k in range(len(kinds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        cache = _units.setdefault(model_path, UnitCache(lambda unit: _encoded(model, unit), 800_000))
        for batch in batches:
            for cut in cuts(batch, "text", 1 << 20):
                found = [encode(model, t or "", bos, eos, cache) for t in cut.columns[-1].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*cut.columns[:-1], pa.array([f[0].size for f in found], pa.int64()), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary()), pa.array([f[2] for f in found], pa.string())],
                    [*names, "n_tokens", "ids", "spans", "decoded"],
                )

    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)) + ", n_tokens bigint, ids binary, spans binary, decoded string"
    out = docs.select(*[F.col(c).alias(n) for c, n in zip((id_col, *carry), names, strict=True)], F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip((id_col, *carry), names, strict=True)], "n_tokens", "ids", "spans", "decoded")
