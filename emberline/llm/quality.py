"""Quality rules by tokeniser fertility, beside plain counts.

A public vocabulary that was made for running text spends few characters per token, falls back
to bytes, or repeats few tokens on text that is not of a language it knows. Each document's
characters per token under several vocabularies, byte share and token entropy are held against bands for its language, or
where that has too few texts for bands, for its script.

Line ends are encoded as blanks: the first vocabulary has no piece for them, so that their bytes would say how a text is laid
out, and not whether it is text the vocabulary knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .pieces import PieceModel, UnitCache, id_cache, load
from .scratch import bound_batches, materialise
from .text import Words, combined, cuts, sums, windows

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Least spreads: of tokens per word and characters per token as a share of the median, of entropy in bits. On sf0.01 the languages are at 0.29, 0.17 and mostly 0.04 to 0.08; some classes of long texts are at 0.01 to 0.02.
FLOORS = {"tokens_per_word": 0.15, "chars_per_token": 0.1, "chars_per_token_2": 0.1}
ENTROPY_FLOOR = 0.03
MEASURES = ("chars_per_token", "byte_share", "token_entropy", "chars_per_token_2")
SCRIPTS = ("none", "latin", "greek or cyrillic", "semitic", "indic", "east asian", "hangul", "other")
SCRIPT = np.zeros(256, np.int64)  # the script that a character's first byte speaks for
for _first, _last, _k in ((0x41, 0x5A, 1), (0x61, 0x7A, 1), (0xC3, 0xC9, 1), (0xCD, 0xD3, 2), (0xD4, 0xDB, 3), (0xE0, 0xE1, 4), (0xE3, 0xE9, 5), (0xEA, 0xED, 6), (0xEE, 0xF4, 7)):
    SCRIPT[_first : _last + 1] = _k


def repeated_words(words: Words) -> np.ndarray:
    """Per text, the words in three-word windows that occur at least twice in it."""
    first, owner = windows(words.edges, 3)
    if not first.size:
        return np.zeros(words.edges.size - 1, np.int64)
    keys = combined(words.hashes(), 3)[first] ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    ranked = keys[order]
    same = np.zeros(ranked.size + 1, bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    hit = first[order[same[1:] | same[:-1]]]
    covered = np.zeros(words.starts.size, bool)
    for k in range(3):
        covered[hit + k] = True
    return sums(covered, words.edges)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    filled = [line for line in lines if line.strip(" \t\n\x0b\x0c\r")]
    return len(filled) - len(set(filled))


def entropy(ids: np.ndarray) -> float:
    """Entropy of the distribution of ``ids``, in bits; 0 for none."""
    if not ids.size:
        return 0.0
    counts = np.unique(ids, return_counts=True)[1]
    return float(np.log2(ids.size) - (counts * np.log2(counts)).sum() / ids.size)


def scripts(words: Words) -> list[str]:
    """The script of most letters of each text."""
    kinds = SCRIPT[words.buf[:-8]]
    owner = np.repeat(np.arange(words.offsets.size - 1), np.diff(words.offsets))
    letters = np.flatnonzero(kinds)
    counts = np.bincount(owner[letters] * len(SCRIPTS) + kinds[letters], minlength=(words.offsets.size - 1) * len(SCRIPTS)).reshape(-1, len(SCRIPTS))
    return [SCRIPTS[k] if n else SCRIPTS[0] for k, n in zip(counts.argmax(axis=1), counts.max(axis=1), strict=True)] if len(counts) else []


@lru_cache(maxsize=2)
def byte_vocabulary(path: str, pattern: str):
    """A byte-level vocabulary from a file of ranks; special strings in a text are plain text."""
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def measure(column: pa.Array, model: PieceModel, cache: UnitCache, other=None) -> dict[str, list]:
    """The counts and measures of each text; a null is an empty text. ``other`` is the second vocabulary, if there is one."""
    texts = [t or "" for t in column.to_pylist()]
    words = Words(column, lower=False)
    chars = np.zeros(words.inside.size + 1, np.int64)
    np.cumsum(words.inside & ((words.buf[:-8] & 0xC0) != 0x80), out=chars[1:])
    symbols = np.concatenate([[0], np.cumsum(SYMBOL[words.buf[:-8]])])
    out: dict[str, list] = {
        "n_words": words.per_text.tolist(),
        "word_chars": (chars[words.offsets[1:]] - chars[words.offsets[:-1]]).tolist(),
        "n_symbols": (symbols[words.offsets[1:]] - symbols[words.offsets[:-1]]).tolist(),
        "n_dup_lines": [repeated_lines(t) for t in texts],
        "n_repeat_words": repeated_words(words).tolist(),
        "n_tokens": [],
        "byte_share": [],
        "token_entropy": [],
    }
    for text in texts:
        ids = np.frombuffer(b"".join([cache[u] for u in model.units(text.replace("\n", " "))]), "<u4")
        out["n_tokens"].append(ids.size)
        out["byte_share"].append(float(((ids >= model.first_byte) & (ids <= model.last_byte)).mean()) if ids.size else 0.0)
        out["token_entropy"].append(entropy(ids))
    out["chars_per_token"] = [c / n if n else 0.0 for c, n in zip(out["word_chars"], out["n_tokens"], strict=True)]
    second = [len(other.encode_ordinary(t.replace("\n", " "))) for t in texts] if other else out["n_tokens"]
    out["chars_per_token_2"] = [c / n if n else 0.0 for c, n in zip(out["word_chars"], second, strict=True)]
    out["script"] = scripts(words)
    return out


def measures(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang", second: tuple[str, str] | None = None) -> DataFrame:
    """(id, group, digest of the text, script, counts and measures) of every row; a null group is ``und``, a null text empty."""
    bound_batches(docs.sparkSession)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
    shares = ("byte_share", "token_entropy", "chars_per_token", "chars_per_token_2")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, grp string, digest binary, script string, " + ", ".join([f"{c} bigint" for c in counts] + [f"{c} double" for c in shares])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = load(model_path), id_cache(model_path)
        other = byte_vocabulary(*second) if second else None
        for batch in batches:
            for cut in cuts(batch, "text", 1 << 20):
                found = measure(cut.column(2), model, cache, other)
                columns = [pa.array(found[c], pa.int64()) for c in counts] + [pa.array(found[c], pa.float64()) for c in shares]
                digests = pa.array([xxhash.xxh3_128_digest((t or "").encode()) for t in cut.column(2).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([cut.column(0), cut.column(1), digests, pa.array(found["script"], pa.string()), *columns], ["id", "grp", "digest", "script", *counts, *shares])

    group = F.coalesce(F.col(group_col).cast("string"), F.lit("und"))
    return docs.select(F.col(id_col).alias("id"), group.alias("grp"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def middle(name: str, of: Column) -> Column:
    return F.percentile_approx(of, 0.5, 10_000).alias(name)


def quality_rules(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", group_col: str = "lang", width: float = 5.5, byte_share_most: float = 0.25, least_group: int = 30, second: tuple[str, str] | None = None) -> DataFrame:
    """(id, counts, measures, base_failed, kept) of every row.

    ``base_failed``: under 50 words, or over half the words in repeated three-word windows.
    Bands are learned per group (a language) and per script from the distinct texts that pass the base
    rules. Tokens per word and characters per token vary with one over the square root of a
    text's words, so a text is rejected whose distance from its group's median, times that
    root, is over ``width`` times the group's robust spread (1.4826 x the median of such
    distances, or its floor). Token entropy grows with length and is held against texts of its group within
    the same power of two of tokens. Tokens per word may be off either way; many characters per
    token and a high entropy speak for a text, so these bands are open above. A byte share is rejected over ``byte_share_most`` beyond the
    group's median. ``second`` is a file of ranks of a byte-level vocabulary with its pattern, whose characters per token
    are held against bands of their own. A group of under ``least_group`` distinct texts is held against the bands of the text's
    script, or if that has as few, the outermost bands of all groups that have their own (or, without any, the bands of all texts); a length class of under that against adjacent classes,
    then the group, then all texts. Null texts are empty and fail the base rules; rows that repeat stay repeated; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = measures(docs, model_path, id_col, text_col, group_col, second)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    root = F.sqrt(F.col("n_words").cast("double"))
    length = F.when(F.col("n_tokens") > 0, F.floor(F.log2(F.col("n_tokens").cast("double")))).otherwise(0)
    rows = materialise(rows.withColumns({"base_failed": failed, "root": root, "length": length, "tokens_per_word": F.when(F.col("n_words") > 0, F.col("n_tokens") / F.col("n_words")).otherwise(0.0)}), "measures")

    measured = ("root", "length", "byte_share", "tokens_per_word", "chars_per_token", "token_entropy", "chars_per_token_2")
    texts = materialise(rows.filter("NOT base_failed").select("grp", "digest", "script", *measured).dropDuplicates(["grp", "digest"]), "distinct")
    plain = tuple(FLOORS)

    def learned(some: DataFrame, least: int) -> DataFrame:
        mid = some.groupBy("grp").agg(F.count("*").alias("n"), middle("mid_byte", F.col("byte_share")), *[middle(f"mid_{c}", F.col(c)) for c in plain])
        mid = mid.filter(F.col("n") >= least).drop("n")
        spread = _small(spark, mid, some, "grp").groupBy("grp").agg(*[middle(f"dev_{c}", F.abs(F.col(c) - F.col(f"mid_{c}")) * F.col("root")) for c in plain])
        return mid.join(spread, "grp").withColumns({f"dev_{c}": F.greatest(f"dev_{c}", floor * F.col(f"mid_{c}")) for c, floor in FLOORS.items()})

    bands = materialise(learned(texts, least_group), "bands")
    known = bands if bands.count() else learned(texts.dropDuplicates(["digest"]).withColumn("grp", F.lit("")), 1)
    of_script = learned(texts.withColumn("grp", F.col("script")).dropDuplicates(["grp", "digest"]), least_group)
    of_script = of_script.select(F.col("grp").alias("script"), *[F.col(c).alias(f"script_{c}") for c in of_script.columns if c != "grp"])
    low, high = [f"mid_{c}" for c in plain], ["mid_byte", "mid_tokens_per_word"]
    pool = known.agg(*[F.min(c).alias(f"low_{c}") for c in low], *[F.max(c).alias(f"high_{c}") for c in high], *[F.max(f"dev_{c}").alias(f"all_dev_{c}") for c in plain])
    joined = _small(spark, of_script, _small(spark, bands, rows, "grp", how="left"), "script", how="left").crossJoin(F.broadcast(pool))
    joined = _small(spark, _entropy_bands(spark, texts, least_group), joined, "grp", "length", how="left")
    lowest, highest = ({c: F.coalesce(c, f"script_{c}", f"{edge}_{c}") for c in names} for edge, names in (("low", low), ("high", high)))
    limit = {c: width * 1.4826 * F.coalesce(f"dev_{c}", f"script_dev_{c}", f"all_dev_{c}") for c in plain}
    words = F.col("tokens_per_word")
    outside = F.col("byte_share") > highest["mid_byte"] + byte_share_most
    outside = outside | ((words - highest["mid_tokens_per_word"]) * F.col("root") > limit["tokens_per_word"])
    outside = outside | ((lowest["mid_tokens_per_word"] - words) * F.col("root") > limit["tokens_per_word"])
    for c in ("chars_per_token", "chars_per_token_2"):
        outside = outside | ((lowest[f"mid_{c}"] - F.col(c)) * F.col("root") > limit[c])
    outside = outside | (F.col("mid_entropy") - F.col("token_entropy") > width * 1.4826 * F.col("dev_entropy"))
    rejected = F.coalesce(outside, F.lit(False))
    out = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", "tokens_per_word", *MEASURES, "base_failed")
    return joined.select(F.col("id").alias(id_col), *out, (~F.col("base_failed") & ~rejected).alias("kept"))


def _entropy_bands(spark, texts: DataFrame, least: int) -> DataFrame:
    """(grp, length, mid_entropy, dev_entropy) of every class of ``texts``, from the nearest pool of ``least`` texts.

    The pools are the class, it and the adjacent classes, its group, and all texts, however few. Twice
    the tokens add one bit at most, so a longer text counts in a shorter class with one bit less for each doubling.
    """
    wanted, found = materialise(texts.select("grp", "length").distinct(), "classes"), None
    for reach, alone in ((0, True), (1, True), (None, True), (None, False)):
        to = F.broadcast(wanted.withColumnRenamed("length", "class").withColumnRenamed("grp", "of"))
        near = F.abs(F.col("length") - F.col("class")) <= reach if reach is not None else F.lit(True)
        pool = (texts if alone else texts.dropDuplicates(["digest"])).join(to, near & (F.col("grp") == F.col("of")) if alone else near)
        pool = pool.select(F.col("of").alias("grp"), F.col("class").alias("length"), (F.col("token_entropy") - F.greatest(F.col("length") - F.col("class"), F.lit(0))).alias("e"))
        mid = pool.groupBy("grp", "length").agg(F.count("*").alias("n"), middle("mid_entropy", F.col("e"))).filter(F.col("n") >= (least if alone else 1)).drop("n")
        loose = _small(spark, mid, pool, "grp", "length").groupBy("grp", "length").agg(middle("dev_entropy", F.abs(F.col("e") - F.col("mid_entropy"))))
        bands = mid.join(loose, ["grp", "length"]).withColumn("dev_entropy", F.greatest("dev_entropy", F.lit(ENTROPY_FLOOR)))
        found = materialise(bands if found is None else found.unionByName(bands), "bands")
        wanted = materialise(wanted.join(found, ["grp", "length"], "left_anti"), "classes")
        if not wanted.count():
            break
    return found


def _small(spark, bands: DataFrame, rows: DataFrame, *keys: str, how: str = "inner", most: int = 10_000) -> DataFrame:
    """``rows`` joined with ``bands``; these are broadcast if they are found to be at most ``most`` rows."""
    bands = materialise(bands, "bands")
    return rows.join(F.broadcast(bands) if bands.count() <= most else bands, list(keys), how)
