"""Near duplicates by SimHash: pigeonhole blocks, joins on blocks, Hamming verification."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .scratch import bound_batches, discard, materialise, unused
from .text import Words, combined, cuts, windows, xxh64

ONES = np.uint64(0x0101010101010101)


def text_fingerprints(column: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each text, as int64.

    A bit is set if it is set in over half of the XXH64 values of the text's shingles (runs of
    ``shingle`` space-joined words, repeats included; a text of fewer words is one shingle; a
    text without words, and a null, has fingerprint zero).
    """
    return word_fingerprints(Words(column), shingle, seed)


def word_fingerprints(words: Words, shingle: int, seed: int = 42) -> np.ndarray:
    """The same, from a batch's words."""
    buf, starts, ends = words.spaced()
    first, owner = windows(words.edges, shingle)
    last = first + shingle - 1
    short = np.flatnonzero((words.per_text > 0) & (words.per_text < shingle))
    first = np.concatenate([first, words.edges[short]])
    last = np.concatenate([last, words.edges[short + 1] - 1])
    owner = np.concatenate([owner, short])
    if short.size:
        order = np.argsort(owner, kind="stable")
        first, last, owner = first[order], last[order], owner[order]
    out = np.zeros(words.per_text.size, np.uint64)
    if not first.size:
        return out.view(np.int64)
    hashes = xxh64(buf, starts[first], ends[last] - starts[first], seed)
    counts = np.bincount(owner, minlength=out.size)
    begins = np.cumsum(counts) - counts
    pieces = -(-counts // 255)  # byte-wide counters hold 255 hashes
    of = np.repeat(np.arange(counts.size), pieces)
    rank = np.arange(of.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = begins[of] + 255 * rank
    texts = np.flatnonzero(pieces)
    piece_at = (np.cumsum(pieces) - pieces)[texts]
    half = counts[texts, None]
    for j in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(j)) & ONES, at)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), piece_at, axis=0)
        bits = (2 * ones > half).astype(np.uint64)
        out[texts] |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(j))).sum(axis=1, dtype=np.uint64)
    return out.view(np.int64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tag: bool = False) -> DataFrame:
    """(id, fp long): one row per row of ``docs``, ids null or repeated as they come; ``tag`` adds ``node`` (see ``word_nodes``)."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in cuts(batch, "text"):
                words = Words(cut.column(1))
                found = [cut.column(0), pa.array(word_fingerprints(words, shingle))]
                yield pa.RecordBatch.from_arrays(found + [pa.array(word_nodes(words))] * tag, ["id", "fp"] + ["node"] * tag)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint" + ", node bigint" * tag)


def block_masks(bits: int, blocks: int) -> list[int]:
    """Signed 64-bit masks: every choice of ``blocks - bits`` of ``blocks`` blocks of a fingerprint.

    Two fingerprints that differ in at most ``bits`` bits agree on one of the choices whole.
    """
    edge = [64 * k // blocks for k in range(blocks + 1)]
    whole = [((1 << edge[k + 1]) - 1) ^ ((1 << edge[k]) - 1) for k in range(blocks)]
    masks = [sum(chosen) for chosen in combinations(whole, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, bits: int = 2, blocks: int = 4, bucket: int = 32) -> DataFrame:
    """(a, b): links among distinct fingerprints ``fps(fp)`` whose closure joins all pairs at most ``bits`` apart.

    Pairs come from the blocks they share, verified by Hamming distance. Within a bucket of
    more than ``bucket`` fingerprints pairs are not enumerated: two fingerprints are at most
    two bits apart exactly if some value is at most one bit from both, so each fingerprint
    names itself and its one-bit neighbours outside the shared blocks, and those naming the
    same value are linked to its smallest. No bucket is capped, and work is linear in it.
    """
    if not 0 < bits <= 2:
        raise ValueError("bits must be 1 or 2")
    masks = block_masks(bits, blocks)
    keyed = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    keys = fps.select("fp", keyed.alias("k")).select("k.band", "k.key", "fp")
    sizes = keys.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialise(keys.join(sizes, ["band", "key"]), "buckets")
    few = members.filter(F.col("n") <= bucket).select("band", "key", "fp")
    pairs = few.alias("x").join(few.alias("y"), ["band", "key"]).filter("x.fp < y.fp")
    pairs = pairs.filter(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    many = members.filter(F.col("n") > bucket)
    own = [1 << j if j < 63 else -(1 << 63) for j in range(64)]
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(f).cast("long") for f in own if not f & m]) for m in masks])
    named = many.select("fp", "band", F.explode(flips[F.col("band")]).alias("flip")).select("fp", "band", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"), (F.col("flip") == 0).alias("itself"))
    if bits == 1:  # a point that is itself a member is at most one bit from each that names it
        centre = named.filter("itself").select("band", "point", F.col("fp").alias("a"))
        stars = named.filter("NOT itself").join(centre, ["band", "point"]).select("a", F.col("fp").alias("b"))
    else:
        heads = named.groupBy("band", "point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
        stars = named.join(heads, ["band", "point"]).filter("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)).distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2, blocks: int = 4, bucket: int = 32, tag: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, ``fp`` and ``component_id``, the smallest id reachable over links; ``tag`` adds ``node``.

    Texts with equal fingerprints are linked, so all empty and null texts (fingerprint zero) are
    one group. A null id is never a component's smallest; a component of null ids only has a null
    ``component_id``. Rows that repeat stay repeated; an empty table gives no rows.
    """
    rows = materialise(fingerprints(docs, id_col, text_col, shingle, tag), "fingerprints")
    nodes = materialise(rows.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    roots = connected_components(links(nodes.select("fp"), bits, blocks, bucket)).withColumnRenamed("node", "of")
    rooted = nodes.join(roots, F.col("fp") == F.col("of"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(F.col("id").alias(id_col), "fp", "component_id", *["node"] * tag)


def word_nodes(words: Words) -> np.ndarray:
    """64 bits of each text's lower-cased words, joined by single spaces, as int64: texts of the same words share them."""
    buf, starts, ends = words.spaced()
    edges = words.edges.tolist()
    found = [xxhash.xxh3_64_intdigest(buf[starts[a] : ends[b - 1]].tobytes() if a < b else b"") for a, b in zip(edges, edges[1:], strict=False)]
    return np.array(found, np.uint64).view(np.int64)


def _shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct runs of ``width`` words of each text, by text and then hash."""
    first, owner = windows(words.edges, width)
    values = combined(words.hashes(), width)[first] if first.size else np.zeros(0, np.uint64)
    return _distinct(values, owner)


def _distinct(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(values.size, bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[fresh], owner[fresh]


SKETCH, TRUSTED = 128, 200  # bytes of a sketch; shingles from which on it is relied on


def sketches(values: np.ndarray, owner: np.ndarray, texts: int) -> list[bytes]:
    """Of each text's shingles one byte for each of ``SKETCH`` classes: of the smallest in the class, 0 for none."""
    out = np.zeros((texts, SKETCH), np.uint8)
    cls = (values % np.uint64(SKETCH)).astype(np.int64)
    rest = values // np.uint64(SKETCH)
    order = np.lexsort((rest, cls, owner))
    cell = owner[order] * SKETCH + cls[order]
    lead = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if cell.size else np.zeros(0, np.int64)
    out.reshape(-1)[cell[lead]] = (rest[order][lead] % np.uint64(255)).astype(np.uint8) + 1
    return [row.tobytes() for row in out]


def _lead(words: Words, width: int, share: float, common: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place, size): of each text's distinct shingles the first few, rare ones first, and how many it has.

    Shingles are ordered by how often they were ``seen`` (0 unless in the sorted ``common``), then
    by hash. Of two sets whose Jaccard similarity is ``share`` or more, the first
    n - ceil(share * n) + 1 of the one and of the other have a member in common, whatever the order.
    """
    values, owner = _shingles(words, width)
    counts = np.bincount(owner, minlength=words.per_text.size)
    rank = np.zeros(values.size, np.int64)
    if common.size:
        at = np.minimum(np.searchsorted(common, values), common.size - 1)
        rank = np.where(common[at] == values, seen[at], 0)
    order = np.lexsort((values, rank, owner))
    place = np.arange(values.size) - np.repeat(np.cumsum(counts) - counts, counts)
    most = np.where(counts > 0, counts - np.ceil(share * counts - 1e-9).astype(np.int64) + 1, 0)
    kept = place < np.repeat(most, counts)
    return values[order][kept], owner[kept], place[kept], counts


def _common_shingles(docs: DataFrame, id_col: str, text_col: str, width: int, rows: int = 20_000, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of the shingles seen most often in about ``rows`` texts, by hash.

    They only order the shingles of a text, so the sample decides how much work there is and not what is found.
    """
    bound_batches(docs.sparkSession)
    every = max(1, docs.count() // rows)
    some = docs.filter(F.col(id_col).isNotNull() & (F.pmod(F.xxhash64(F.col(id_col)), F.lit(every)) == 0)).select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in cuts(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(Words(cut.column(0)), width)[0].view(np.int64))], ["key"])

    often = some.mapInArrow(run, "key bigint").groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    found = often.orderBy(F.desc("n"), "key").limit(most).toArrow()
    keys = found.column("key").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("n").to_numpy().astype(np.int64)[order]


def _described(docs: DataFrame, id_col: str, text_col: str, shingle: int, width: int) -> DataFrame:
    """(id, node, fp, size, sketch) of every row: its words, fingerprint, number of shingles and their sketch."""
    bound_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in cuts(batch, "text"):
                words = Words(cut.column(1))
                values, owner = _shingles(words, width)
                sizes = np.bincount(owner, minlength=cut.num_rows)
                found = [cut.column(0), pa.array(word_nodes(words)), pa.array(word_fingerprints(words, shingle)), pa.array(sizes, pa.int64()), pa.array(sketches(values, owner, cut.num_rows), pa.binary())]
                yield pa.RecordBatch.from_arrays(found, ["id", "node", "fp", "size", "sketch"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, node bigint, fp bigint, size bigint, sketch binary")


def _sharing(docs: DataFrame, id_col: str, text_col: str, width: int, share: float) -> DataFrame:
    """(key, node, size, pos, n, head) of the leading shingles that several texts have: ``head`` is the text with fewest.

    Any two texts of the similarity share a key. A text of the same words as one before it in a task is not
    looked at again. Rows are dealt by key once.
    """
    common, seen = _common_shingles(docs, id_col, text_col, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for cut in cuts(batch, "text"):
                words = Words(cut.column(0))
                nodes = word_nodes(words)
                fresh = np.zeros(nodes.size, bool)
                for k, node in enumerate(nodes.tolist()):
                    if node not in done:
                        done.add(node)
                        fresh[k] = True
                keys, owner, place, sizes = _lead(words, width, share, common, seen)
                kept = fresh[owner]
                keys, owner, place = keys[kept], owner[kept], place[kept]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(nodes[owner]), pa.array(sizes[owner] << 32 | place, pa.int64())], ["key", "node", "at"])

    texts = docs.filter(F.col(id_col).isNotNull()).select(F.col(text_col).alias("text"))
    own = W.partitionBy("key")
    rows = texts.mapInArrow(run, "key bigint, node bigint, at bigint")
    rows = rows.withColumns({"n": F.count("*").over(own), "first": F.min(F.struct("at", "node")).over(own), "low": F.min("node").over(own), "high": F.max("node").over(own)})
    rows = rows.filter("low <> high").dropDuplicates(["key", "node"])
    parts = lambda at: [F.shiftright(at, 32).alias("size"), at.bitwiseAND((1 << 32) - 1).alias("pos")]
    return rows.select("key", "node", *parts(F.col("at")), "n", F.struct(F.col("first.node").alias("node"), *parts(F.col("first.at"))).alias("head"))


def _marked(hashes: DataFrame, bits: int = 1 << 25) -> np.ndarray:
    """A bitmap of fixed size in which each of ``hashes(h)`` has its bit set: bounded, however many there are."""
    slot = F.pmod("h", F.lit(bits))
    found = hashes.select(F.floor(slot / 64).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(h, {bits}) % 64 AS int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bit").to_numpy()
    return out


def _alike(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, share: float) -> DataFrame:
    """The ``pairs(a, b)`` whose texts' shingle sets have a Jaccard similarity of ``share`` or more.

    Sizes decide first, then sketches, where both texts have ``TRUSTED`` shingles: of those whose
    similarity is ``share`` they all but never say less than ``share`` - 0.2, five standard deviations. The texts that are left are read again, one
    of each kind, found by a bitmap of their ids; shingles are compared by 32 bits of their hash.
    """
    of = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}")).hint("merge")
    near = pairs.join(of("a"), "a").join(of("b"), "b").filter(F.least("size_a", "size_b") >= share * F.greatest("size_a", "size_b") - 1e-9)

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (3, 4))
            either = np.maximum(((x > 0) | (y > 0)).sum(axis=1), 1)
            keep = (((x == y) & (x > 0)).sum(axis=1) / either >= share - 0.2) | (batch.column(2).to_numpy() < TRUSTED)
            yield batch.select([0, 1]).filter(pa.array(keep))

    chosen = near.select("a", "b", F.least("size_a", "size_b").alias("size"), "sketch_a", "sketch_b").mapInArrow(likely, "a bigint, b bigint")
    chosen = materialise(chosen, "likely")
    ids = nodes.join(chosen.select(F.explode(F.array("a", "b")).alias("node")).distinct().hint("merge"), "node", "left_semi").select(F.xxhash64("least").alias("h"))
    marked = _marked(ids)
    bits = marked.size * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = batch.column(0).to_numpy() % bits
            for cut in cuts(batch.filter(pa.array((marked[slots >> 6] >> (slots & 63)) & 1 == 1)), "text"):
                words = Words(cut.column(1))
                values, owner = _shingles(words, width)
                values, owner = _distinct(values >> np.uint64(32), owner)
                edges = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=cut.num_rows))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(values.astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(word_nodes(words)), lists], ["node", "shingles"])

    texts = docs.filter(F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).alias("text"))
    sets = materialise(texts.mapInArrow(run, "node bigint, shingles array<int>"), "shingles")
    both = chosen.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    found = materialise(both.filter((F.col("shared") > 0) & (F.col("shared") >= share * (F.col("total") - F.col("shared")) - 1e-9)).select("a", "b").distinct(), "alike")
    discard(chosen, sets)
    return found


def _may_be_alike(x: str, y: str, share: float) -> Column:
    """Whether two texts that share a shingle at their ``pos`` can reach ``share``, if they share none before."""
    sizes = F.least(f"{x}.size", f"{y}.size") >= share * F.greatest(f"{x}.size", f"{y}.size") - 1e-9
    left = F.least(F.col(f"{x}.size") - F.col(f"{x}.pos"), F.col(f"{y}.size") - F.col(f"{y}.pos"))
    return sizes & (left >= share / (1 + share) * (F.col(f"{x}.size") + F.col(f"{y}.size")) - 1e-9)


def _apart_sharing(members: DataFrame, roots: DataFrame, share: float, chunk: int, whole: bool) -> DataFrame:
    """(a, b): pairs of ``members(key, node, size, pos, n)`` of one bucket, not in one component, that may be alike.

    Of each pair one at least is outside its bucket's largest component. Pairs of one part of a
    bucket, of about ``chunk`` members, are named; or, with ``whole``, all pairs of the buckets of more than one part.
    """
    if whole:
        members = members.filter(F.col("n") > chunk)
    placed = members.join(roots.withColumnRenamed("node", "of").hint("merge"), F.col("node") == F.col("of"), "left")
    placed = materialise(placed.select("key", "node", "size", "pos", "n", F.coalesce("root", "node").alias("root")), "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("members"))
    mixed = parts.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("members", "root")).alias("top")).filter("parts > 1")
    part = F.lit(0).cast("long") if whole else F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / chunk))
    mixed = placed.join(mixed.hint("merge"), "key").withColumn("part", part)
    x, y = mixed.filter("root <> top").alias("x"), mixed.alias("y").hint("merge")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.root") != F.col("y.root"))
    once = (F.col("y.root") == F.col("y.top")) | (F.col("x.node") < F.col("y.node"))
    found = x.join(y, same & once & _may_be_alike("x", "y", share))
    return found.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _near(nodes: DataFrame, bits: int, blocks: int, whole: int) -> DataFrame:
    """(a, b): texts that share ``whole`` of ``blocks`` blocks with the smallest text there, ``bits`` apart from it at most."""
    keyed = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(block_masks(blocks - whole, blocks))])
    keys = nodes.select(F.explode(keyed).alias("key"), "node", "fp", "size")
    stars = keys.withColumn("head", F.min(F.struct("size", "node", "fp")).over(W.partitionBy("key"))).filter((F.col("node") != F.col("head.node")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("head.fp"))) <= bits))
    return stars.select(F.least("node", "head.node").alias("a"), F.greatest("node", "head.node").alias("b"))


def alike_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: float = 0.8, shingle: int = 2, bits: int = 10, blocks: int = 6, whole: int = 2, bucket: int = 8, tag: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id and ``component_id``, the smallest id reachable over links; ``tag`` adds ``node``.

    Texts of the same words are linked, and all texts whose sets of ``width``-word shingles have a
    Jaccard similarity of ``share`` or more. First candidates come from fingerprints (of ``shingle`` words): each text with the smallest that shares
    ``whole`` of ``blocks`` blocks, if at most ``bits`` bits differ. At this similarity fingerprints
    differ by some ten bits, too many for blocks to name every pair; so texts are compared, too, that share one of
    their rarest shingles, a fifth of each text's, which any two texts of the similarity do.

    Each text is first compared with the smallest of its bucket: of texts that a passage makes alike, that is the one most
    like the others. Where a bucket is left with several components, members outside the largest are compared with
    those of other components, in a bucket of over four times ``bucket`` texts first with their part of it. So no link
    between components is lost, and work is linear in a group that its smallest text holds together.

    Texts without words, and nulls, are one group. Texts of fewer than ``width`` words are linked
    to equal ones only. Rows of null id are not linked; their ``component_id`` is that of a text of the same words, or null.
    Repeated rows stay repeated; an empty table gives no rows.
    """
    rows = materialise(_described(docs, id_col, text_col, shingle, width), "described")
    nodes = materialise(rows.filter("id IS NOT NULL").groupBy("node").agg(F.min("id").alias("least"), *[F.first(c).alias(c) for c in ("fp", "size", "sketch")]), "nodes")
    sharing = materialise(_sharing(docs, id_col, text_col, width, share), "sharing")
    stars = sharing.filter(F.col("node") != F.col("head.node")).select("head", F.struct("node", "size", "pos").alias("own")).filter(_may_be_alike("head", "own", share))
    stars = stars.select(F.least("head.node", "own.node").alias("a"), F.greatest("head.node", "own.node").alias("b"))
    tried = materialise(_near(nodes.filter("size > 0"), bits, blocks, whole).union(stars).distinct(), "pairs")
    how = (nodes.select("node", "least", "size", "sketch"), docs, id_col, text_col, width, share)
    found = _alike(tried, *how)
    for every in (False, True):
        cross = _apart_sharing(sharing.drop("head"), connected_components(found), share, 4 * bucket, every)
        cross = materialise(cross.join(tried.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        if not cross.isEmpty():
            found, tried = found.union(_alike(cross, *how)), tried.union(cross)
    roots = connected_components(found).withColumnRenamed("node", "of")
    rooted = nodes.select("node", "least").join(roots.hint("merge"), F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least.hint("merge"), "root").select("node", "component_id")
    return rows.select("id", "node").join(named.hint("merge"), "node", "left").select(F.col("id").alias(id_col), "component_id", *["node"] * tag)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=simhash_groups, **how) -> DataFrame:
    """``docs`` without the near copies: of each group that ``find`` names the rows with the smallest id stay.

    Rows are told apart by id and words, so an id that several texts share goes only where its
    group has a smaller one, and no group loses all its rows. Rows that share both id and group stay together. A row
    with a null id stays. Empty texts are a group like any other. An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    names = [unused(docs, c) for c in ("__gone", "__words", "__node")]
    groups = find(docs, id_col, text_col, tag=True, **how)
    copies = groups.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias(names[0]), F.col("node").alias(names[1])).distinct()
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in cuts(batch, batch.schema.names[at]):
                yield cut.append_column(names[2], pa.array(word_nodes(Words(cut.column(at)))))

    tagged = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(names[2], T.LongType())]))
    return tagged.join(copies.hint("merge"), (F.col(id_col) == F.col(names[0])) & (F.col(names[2]) == F.col(names[1])), "left_anti").drop(names[2])
