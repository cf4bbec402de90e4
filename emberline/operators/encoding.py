"""Target and label encodings that never look ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.functions.scalar import composite
from emberline.operators.ordered import placed
from emberline.schema import CATEGORIES, KEYS, LEAST_FREQUENCY, SMOOTHING


def long_keys(rows: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(jid, key_name, key, ...): every row once per encoded key, so that all keys aggregate in one pass."""
    pairs = F.array(*[F.struct(F.lit(n).alias("key_name"), composite(*[F.col(c) for c in cols]).alias("key")) for n, cols in KEYS.items()])
    return rows.select("jid", *more, F.inline(pairs))


def target_stats(rows: DataFrame) -> DataFrame:
    """(key_name, key, positives, n) over all rows: the state that scoring uses."""
    return long_keys(rows, ("target",)).groupBy("key_name", "key").agg(F.sum("target").alias("positives"), F.count("*").alias("n"))


def prior(rows: DataFrame) -> Column:
    """The mean target, 0 without any: a scalar subquery, so that nothing runs ahead of the query that uses it."""
    return F.coalesce(rows.agg(F.avg("target")).scalar(), F.lit(0.0))


def _encoded(rows: DataFrame, p: Column) -> DataFrame:
    te = (F.coalesce("positives", F.lit(0)) + SMOOTHING * p) / (F.coalesce("n", F.lit(0)) + SMOOTHING)
    return rows.select("jid", "key_name", te.alias("te"), F.log1p(F.coalesce("n", F.lit(0)).cast("double")).alias("tc"))


def te_expanding(rows: DataFrame) -> DataFrame:
    """(jid, key_name, te, tc) from strictly earlier months only; a row without a month gets the prior and 0.

    The prior is the mean over all rows, later ones included.
    """
    long = long_keys(rows, ("month", "target"))
    monthly = long.filter("month IS NOT NULL").groupBy("key_name", "key", "month").agg(F.sum("target").alias("p"), F.count("*").alias("c"))
    before = W.partitionBy("key_name", "key").orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    history = monthly.select("key_name", "key", "month", F.sum("p").over(before).alias("positives"), F.sum("c").over(before).alias("n"))
    joined = long.join(history, ["key_name", "key", "month"], "left")
    return _encoded(joined, prior(rows))


def te_transform(rows: DataFrame, fitted: DataFrame) -> DataFrame:
    """(jid, key_name, te, tc) of ``rows`` by the statistics of ``fitted``; an unseen key gets the prior and 0."""
    return with_statistics(rows, target_stats(fitted), prior(fitted))


def with_statistics(rows: DataFrame, stats: DataFrame, p: Column) -> DataFrame:
    """(jid, key_name, te, tc) of ``rows`` by stored ``target_stats`` and the prior."""
    return _encoded(long_keys(rows).join(stats, ["key_name", "key"], "left"), p)


def label_codes(rows: DataFrame, least: int = LEAST_FREQUENCY) -> DataFrame:
    """(field, category, n, code): codes from 1 by falling frequency, then name; 0 under ``least`` occurrences."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c).cast("string"), F.lit("__missing__")).alias("category")) for c in CATEGORIES])
    counts = rows.select(F.inline(pairs)).groupBy("field", "category").agg(F.count("*").alias("n"))
    ranked = placed(counts, ["field"], [F.col("n").desc(), F.col("category").asc()], "__at")
    return ranked.select("field", "category", "n", F.when(F.col("n") >= least, F.col("__at") + 1).otherwise(0).cast("int").alias("code"))


def wide(encoded: DataFrame) -> DataFrame:
    """One row per job: ``te_<key>`` and ``tc_<key>`` columns."""
    out = []
    for n in KEYS:
        mine = F.col("key_name") == n
        out += [F.max(F.when(mine, F.col("te"))).alias(f"te_{n}"), F.max(F.when(mine, F.col("tc"))).alias(f"tc_{n}")]
    return encoded.groupBy("jid").agg(*out)


def with_codes(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """``rows`` with ``cat_<field>`` codes, 0 for an unknown category."""
    for c in CATEGORIES:
        mine = codes.filter(F.col("field") == c).select(F.col("category").alias(f"__{c}"), F.col("code").alias(f"cat_{c}"))
        rows = rows.join(mine, F.coalesce(F.col(c).cast("string"), F.lit("__missing__")) == F.col(f"__{c}"), "left").drop(f"__{c}").fillna(0, [f"cat_{c}"])
    return rows
