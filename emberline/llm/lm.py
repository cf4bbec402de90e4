"""Language model scoring by deleted interpolation of n-gram maximum-likelihood estimates.

Counts are exact and cover the corpus. Texts are cut into blocks; each block's distinct n-grams
go with their counts, packed, to the partition that owns their hash range, which sums them and
answers every block with the totals of just the n-grams it holds. Nothing that grows with the
corpus is broadcast or brought to the driver. Longer n-grams are known by as many bits of their hash as the
corpus needs, words by 64; a reply states what others than the asking block have.

Documents set aside from the training ones serve for the weights: an estimate from the rest of
the training documents is mixed over orders, with weights by the longest seen context and how
often it was seen, found by expectation-maximisation on the set-aside counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .scratch import bound_batches, materialise
from .text import P1, P2, P4, Words, _left, cuts

KEPT, AIDE, HELD = 0, 1, 2  # learned from; learned from and used for the weights; not learned from
BEGIN, END = np.uint64(0x9B1C3A5D7E2F4861), np.uint64(0x5E0D7C3B1A294F86)
LEVELS = 48  # context frequencies are classed by powers of two
SPARE = 14  # bits by which hashes of n-grams outnumber the tokens: one in 2^14 n-grams shares its hash with another


def pack(values: np.ndarray) -> bytes:
    """An integer array, its bytes by significance, compressed."""
    flat = np.ascontiguousarray(values).view(np.uint8).reshape(values.size, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(flat.tobytes())


def unpack(data: bytes, dtype: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(flat.reshape(width, flat.size // width).T).view(dtype).ravel()


def pack_sorted(keys: np.ndarray, shift: int = 0) -> bytes:
    return pack(np.diff(keys >> np.uint64(shift), prepend=np.uint64(0)))


def unpack_sorted(data: bytes, shift: int = 0) -> np.ndarray:
    return np.cumsum(unpack(data, "<u8"), dtype=np.uint64) << np.uint64(shift)


def dropped_bits(tokens: int, order: int) -> list[int]:
    """Per order, the low bits of a hash that are not kept in a corpus of so many tokens; words keep all."""
    kept = min(64, max(40, tokens.bit_length() + SPARE))
    return [0] + [64 - kept] * (order - 1)


class Block:
    """Texts' word hashes in sequence, collected up to a size."""

    def __init__(self) -> None:
        self.ids: list = []
        self.counts: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, counts: np.ndarray, hashes: np.ndarray) -> None:
        self.ids += ids
        self.counts.append(counts)
        self.hashes.append(hashes)
        self.size += hashes.size + counts.size

    def row(self) -> tuple[list, bytes, bytes, bytes]:
        hashes = np.concatenate(self.hashes)
        vocab, codes = np.unique(hashes, return_inverse=True)
        return self.ids, pack(np.concatenate(self.counts).astype("<u4")), pack_sorted(vocab), pack(codes.astype("<u4"))


def blocks(docs: DataFrame, role: Column, id_col: str, text_col: str, tokens: int = 400_000) -> DataFrame:
    """(block, role, n_tokens, ids, counts, vocab, codes): the documents by role, in blocks of about ``tokens`` tokens."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = f"block string, role int, n_tokens bigint, ids array<{kind.simpleString()}>, counts binary, vocab binary, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        open_: dict[int, Block] = {}
        id_type = None

        def flush(role: int) -> pa.RecordBatch:
            block = open_.pop(role)
            ids, counts, vocab, codes = block.row()
            return pa.RecordBatch.from_arrays(
                [pa.array([uuid.uuid4().hex]), pa.array([role], pa.int32()), pa.array([block.size], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([counts], pa.binary()), pa.array([vocab], pa.binary()), pa.array([codes], pa.binary())],
                ["block", "role", "n_tokens", "ids", "counts", "vocab", "codes"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for cut in cuts(batch, "text"):
                words = Words(cut.column(2))
                hashes, per_text = words.hashes(), words.per_text
                roles, owners = np.array(cut.column(1).to_pylist()), words.owners()
                ids = cut.column(0).to_pylist()
                for role in np.unique(roles):
                    mine = roles == role
                    block = open_.setdefault(int(role), Block())
                    block.add([ids[i] for i in np.flatnonzero(mine)], per_text[mine], hashes[mine[owners]])
                    if block.size >= tokens:
                        yield flush(int(role))
        for role in list(open_):
            yield flush(role)

    return docs.select(F.col(id_col).alias("id"), role.cast("int").alias("role"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class Sequence:
    """A block's tokens with their n-gram keys: ``keys[k]`` of order k + 1, ``ends`` after each text."""

    def __init__(self, counts: bytes, vocab: bytes, codes: bytes, order: int, shifts: list[int]) -> None:
        words = unpack_sorted(vocab)[unpack(codes, "<u4")]
        per_text = unpack(counts, "<u4").astype(np.int64)
        self.ends = np.cumsum(per_text + 1)
        starts = self.ends - per_text - 1
        inside = np.ones(int(self.ends[-1]) if per_text.size else 0, bool)
        inside[self.ends - 1] = False
        self.tokens = np.full(inside.size, END, np.uint64)
        self.tokens[inside] = words
        place = np.arange(inside.size) - np.repeat(starts, per_text + 1)
        self.begins = [place < k for k in range(order)]  # whether the k-th token before lies before the text
        self.keys = [self.tokens]
        for k in range(1, order):
            before = np.full(inside.size, BEGIN, np.uint64)
            before[k:][~self.begins[k][k:]] = self.tokens[:-k][~self.begins[k][k:]]
            with np.errstate(over="ignore"):
                mixed = _left(self.keys[-1] * P2 + P4, 31) ^ (before * P1)
                mixed = (mixed ^ (mixed >> np.uint64(33))) * P2
            self.keys.append(mixed ^ (mixed >> np.uint64(29)))
        self.keys = [(keys >> np.uint64(n)) << np.uint64(n) if n else keys for keys, n in zip(self.keys, shifts, strict=True)]

    def context(self, order: int, counts: list[np.ndarray], texts: int) -> np.ndarray:
        """How often the ``order`` tokens before each token were seen as a context.

        Every n-gram that does not end a text is a context once, so these are the n-gram
        counts at the token before; a context wholly before the text was seen once per text.
        """
        out = np.full(self.tokens.size, texts, np.int64)
        inside = ~self.begins[1]
        out[inside] = counts[order - 1][np.flatnonzero(inside) - 1]
        return out


def requests(table: DataFrame, partitions: int, order: int, shifts: list[int], slots: np.ndarray) -> DataFrame:
    """(slot, part, order, block, role, keys, counts): each block's distinct n-grams, by the hash range that owns them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sequence = Sequence(row["counts"], row["vocab"], row["codes"], order, shifts)
                for k in range(order):
                    keys, seen = np.unique(sequence.keys[k], return_counts=True)
                    edges = np.searchsorted(owner(keys, partitions), np.arange(partitions + 1))
                    parts = np.flatnonzero(np.diff(edges))
                    cut = [slice(edges[p], edges[p + 1]) for p in parts]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slots[parts], pa.int32()), pa.array(parts, pa.int32()), pa.array([k + 1] * len(cut), pa.int32()), pa.array([row["block"]] * len(cut)), pa.array([row["role"]] * len(cut), pa.int32()), pa.array([pack_sorted(keys[c], shifts[k]) for c in cut], pa.binary()), pa.array([pack(seen[c].astype("<u4")) for c in cut], pa.binary())],
                        ["slot", "part", "order", "block", "role", "keys", "counts"],
                    )

    return table.select("block", "role", "counts", "vocab", "codes").mapInArrow(run, "slot int, part int, order int, block string, role int, keys binary, counts binary")


def spread(spark, partitions: int, most: int = 50_000) -> np.ndarray:
    """A number for each hash range such that shuffling by it to as many tasks gives each task one range.

    With over ``most`` ranges any numbers do: chance deals them evenly enough.
    """
    if partitions > most:
        return np.arange(partitions)
    tried = spark.range(max(64, 20 * partitions)).select(F.col("id").cast("int").alias("n"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(partitions)).alias("at"))
    found = {r.at: r.n for r in tried.groupBy("at").agg(F.min("n").alias("n")).collect()}
    return np.array([found.get(k, 20 * partitions + 64 + k) for k in range(partitions)])


def owner(keys: np.ndarray, partitions: int) -> np.ndarray:
    """The partition whose range of hashes holds each key; it rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(partitions) >> np.uint64(32)).astype(np.int64)


def _totals(shifts: list[int]):
    """Replies to the requests of one hash range, and a row of its totals per order."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {name: [] for name in REPLY}
        rows = table.to_pylist()
        for part, order in sorted({(r["part"], r["order"]) for r in rows}):
            mine = [r for r in rows if (r["part"], r["order"]) == (part, order)]
            keys = [unpack_sorted(r["keys"], shifts[order - 1]) for r in mine]
            seen = [unpack(r["counts"], "<u4").astype(np.int64) for r in mine]
            distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
            edges = np.concatenate([[0], np.cumsum([k.size for k in keys])])
            kept, learned = np.zeros(distinct.size, np.int64), np.zeros(distinct.size, np.int64)
            for k, row in enumerate(mine):
                places = at[edges[k] : edges[k + 1]]  # distinct within a block
                if row["role"] == KEPT:
                    kept[places] += seen[k]
                if row["role"] != HELD:
                    learned[places] += seen[k]
            for k, row in enumerate(mine):
                places = at[edges[k] : edges[k + 1]]
                others = learned[places] - (seen[k] if row["role"] != HELD else 0)
                _reply(out, part, order, row["block"], pack(kept[places].astype("<u8")) if row["role"] == AIDE else None, pack(others.astype("<u8")))
            _reply(out, part, order, None, None, None, [int((kept > 0).sum()), int(kept.sum()), int((learned > 0).sum()), int(learned.sum())])
        return pa.table({n: pa.array(out[n], t) for n, t in REPLY.items()})

    return run


REPLY = {"part": pa.int32(), "order": pa.int32(), "block": pa.string(), "kept": pa.binary(), "learned": pa.binary(), "totals": pa.list_(pa.int64())}


def _reply(out: dict[str, list], *values) -> None:
    for name, value in zip(REPLY, [*values, *[None] * (len(REPLY) - len(values))], strict=True):
        out[name].append(value)


def _counts(replies: list[dict], sequence: Sequence, column: str, order: int, own: bool) -> list[np.ndarray]:
    """Per order, the total of each token's n-gram: the others' that was replied, and the block's ``own`` if it is learned from."""
    out = []
    for k in range(order):
        mine = sorted((r for r in replies if r["order"] == k + 1), key=lambda r: r["part"])
        totals = np.concatenate([unpack(r[column], "<u8") for r in mine]).astype(np.int64)
        keys, at, seen = np.unique(sequence.keys[k], return_inverse=True, return_counts=True)
        if keys.size != totals.size:
            raise ValueError("a block's replies do not fit its n-grams")
        out.append((totals + seen if own else totals)[at])
    return out


def components(sequence: Sequence, counts: list[np.ndarray], tokens: int, texts: int, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(estimates, class): per order the maximum-likelihood probability of each token, and its context class.

    The class is the longest context that was seen and the power of two of its frequency.
    """
    estimates = [counts[0] / max(1, tokens)]
    cls = np.zeros(sequence.tokens.size, np.int64)
    for k in range(1, order):
        seen = sequence.context(k, counts, texts)
        estimates.append(np.where(seen > 0, counts[k] / np.maximum(seen, 1), 0.0))
        level = np.minimum(np.log2(np.maximum(seen, 1)).astype(np.int64), LEVELS - 1)
        cls = np.where(seen > 0, (k - 1) * LEVELS + level + 1, cls)
    return estimates, cls


def _tally(order: int, tokens: int, texts: int, shifts: list[int]):
    """Of set-aside blocks: (cell, n, p1, p2, ...), how many tokens have a context class and powers of two of the estimates, and the sums of these."""
    names = [f"p{k + 1}" for k in range(order)]
    schema = pa.schema([("cell", pa.list_(pa.int32())), ("n", pa.int64()), *[(c, pa.float64()) for c in names]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables = []
        replies = right.to_pylist()
        for row in left.to_pylist():
            sequence = Sequence(row["counts"], row["vocab"], row["codes"], order, shifts)
            estimates, cls = components(sequence, _counts(replies, sequence, "kept", order, False), tokens, texts, order)
            parts = [cls] + [np.where(p > 0, np.floor(np.log2(np.maximum(p, 1e-300))), 1).astype(np.int64) for p in estimates]
            found, at, n = np.unique(np.column_stack(parts).astype(np.int32), axis=0, return_inverse=True, return_counts=True)
            sums = [np.bincount(at.ravel(), weights=p, minlength=len(n)) for p in estimates]
            tables.append(pa.table([pa.array(found.tolist(), schema.field(0).type), pa.array(n, pa.int64()), *[pa.array(x) for x in sums]], schema=schema))
        return pa.concat_tables(tables) if tables else schema.empty_table()

    return run


def mixture(cls: np.ndarray, estimates: np.ndarray, n: np.ndarray, order: int, floor: float, steps: int = 200) -> np.ndarray:
    """Weights by context class: rows of (uniform, order 1, order 2, ...), each summing to 1.

    Expectation-maximisation on ``n`` set-aside tokens of each cell: of one context class, with
    one row of estimates by order. A class without set-aside tokens takes
    the weights of the nearest class with a context as long, or else an even mixture.
    """
    classes = 1 + (order - 1) * LEVELS
    p = np.column_stack([np.full(len(n), floor), estimates]) if len(n) else np.zeros((0, order + 1))
    weights = np.full((classes, order + 1), np.nan)
    for c in range(classes):
        mine = cls == c if len(n) else np.zeros(0, bool)
        if not mine.any():
            continue
        w, own, size = np.full(order + 1, 1 / (order + 1)), p[mine], n[mine].astype(float)
        for _ in range(steps):
            share = own * w
            share /= share.sum(axis=1, keepdims=True)
            new = (share * size[:, None]).sum(axis=0) + 1e-3
            new /= new.sum()
            if np.abs(new - w).max() < 1e-7:
                break
            w = new
        weights[c] = w
    for c in range(classes):
        if np.isnan(weights[c, 0]):
            longest = 0 if c == 0 else 1 + (c - 1) // LEVELS
            same = [x for x in range(classes) if not np.isnan(weights[x, 0]) and (0 if x == 0 else 1 + (x - 1) // LEVELS) == longest]
            weights[c] = weights[min(same, key=lambda x: abs(x - c))] if same else np.r_[np.full(longest + 2, 1 / (longest + 2)), np.zeros(order - longest - 1)]
    return weights


def _scored(order: int, totals: dict[str, int], weights: np.ndarray, id_type: pa.DataType, shifts: list[int]):
    tokens, vocab, texts = totals["tokens"], totals["vocab"], totals["texts"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"id": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []}
        replies = right.to_pylist()
        for row in left.to_pylist():
            sequence = Sequence(row["counts"], row["vocab"], row["codes"], order, shifts)
            counts = _counts(replies, sequence, "learned", order, row["role"] != HELD)
            estimates, cls = components(sequence, counts, tokens, texts, order)
            mix = weights[cls]
            p = mix[:, 0] / (vocab + 1)
            for k in range(order):
                p = p + mix[:, k + 1] * estimates[k]
            base = np.log10((counts[0] + 0.5) / (tokens + 0.5 * (vocab + 1)))
            starts = np.concatenate([[0], sequence.ends[:-1]])
            out["id"] += row["ids"]
            out["n_tokens"] += (sequence.ends - starts).tolist()
            out["n_known"] += np.add.reduceat((counts[0] > 0).astype(np.int64), starts).tolist()
            out["base_score"] += np.add.reduceat(base, starts).tolist()
            out["score"] += np.add.reduceat(np.log10(p), starts).tolist()
        return pa.table({"id": pa.array(out["id"], id_type), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()), "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64())})

    return run


def block_tokens(docs: DataFrame, least: int = 400_000, most: int = 4_000_000) -> int:
    """Tokens of a block: more in a larger corpus, where blocks exchange messages with more hash ranges."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, min(most, size // 2000))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 3, parts: int = 5, held_out: int = 1, aide: int = 0, part_bytes: int = 24 << 20) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row, over whole texts.

    Tokens are the words (A-Z lower-cased) and one end. Documents are dealt by crc32 of the id
    as text, modulo ``parts``: fold ``held_out`` is not learned from, fold ``aide`` gives the
    weights, and counts for scoring come from all but ``held_out``. ``base_score`` is the
    smoothed unigram log10 probability, ``score`` the mixture's. A null text is an empty one
    (its end alone); a row with a null id is scored and not learned from, ``held_out`` false.
    Where nothing is learned from, the mixture is uniform. Rows that repeat are learned from
    and scored as often as they occur; an empty table gives no rows.

    A block exchanges at most one message with each hash range and order, and none where it has no n-gram there,
    so there are never more messages than n-grams.
    """
    fold = F.crc32(F.col(id_col).cast("string")) % parts
    role = F.when(fold.isNull() | (fold == held_out), HELD).when(fold == aide, AIDE).otherwise(KEPT)
    table = materialise(blocks(docs, role, id_col, text_col, block_tokens(docs)), "lm-blocks")
    sizes = {r.role: (r.tokens, r.texts) for r in table.groupBy("role").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.size("ids")).alias("texts")).collect()}
    kept_texts = sizes.get(KEPT, (0, 0))[1]
    texts = kept_texts + sizes.get(AIDE, (0, 0))[1]
    everything = sum(t for t, _ in sizes.values())
    shifts = dropped_bits(everything, order)
    partitions = max(1, everything * order * 8 // part_bytes)
    slots = spread(docs.sparkSession, partitions)
    asked = requests(table, partitions, order, shifts, slots).repartition(partitions, "slot")
    replies = materialise(asked.groupBy("slot").applyInArrow(_totals(shifts), "part int, order int, block string, kept binary, learned binary, totals array<bigint>"), "lm-counts")
    of_words = replies.filter("block IS NULL AND order = 1").agg(*[F.coalesce(F.sum(F.col("totals")[k]), F.lit(0)) for k in range(4)]).first()
    kept_vocab, kept_tokens, vocab, tokens = of_words
    answers = replies.filter("block IS NOT NULL").drop("totals")
    aside = table.filter(F.col("role") == AIDE).select("block", "counts", "vocab", "codes")
    mine = answers.filter("kept IS NOT NULL").drop("learned")
    names = [f"p{k + 1}" for k in range(order)]
    tally = aside.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_tally(order, kept_tokens, kept_texts, shifts), "cell array<int>, n bigint, " + ", ".join(f"{c} double" for c in names))
    cells = tally.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect()
    n = np.array([r.n for r in cells], np.int64)
    estimates = np.array([[r[c] for c in names] for r in cells], float).reshape(len(cells), order) / np.maximum(n, 1)[:, None]
    weights = mixture(np.array([r.cell[0] for r in cells], np.int64), estimates, n, order, 1 / (kept_vocab + 1))
    if not tokens:
        weights = np.tile(np.r_[1.0, np.zeros(order)], (len(weights), 1))

    kind = docs.schema[id_col].dataType
    run = _scored(order, {"tokens": tokens, "vocab": vocab, "texts": texts}, weights, to_arrow_type(kind), shifts)
    scored = table.select("block", "role", "ids", "counts", "vocab", "codes").groupBy("block").cogroup(answers.drop("kept").groupBy("block")).applyInArrow(run, f"id {kind.simpleString()}, n_tokens bigint, n_known bigint, base_score double, score double")
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % parts == held_out, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held.alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
