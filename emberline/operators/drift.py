"""Identity drift between a training and a scored population, and its remedies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.operators.ordered import running

IDENTITIES = ("username", "jobname", "account")


def unseen_rates(train: DataFrame, reference: DataFrame, fields: tuple[str, ...] = IDENTITIES) -> DataFrame:
    """(field, rate): the share of reference rows whose value training lacks; a null counts as unseen."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])
    known = train.select(F.inline(pairs)).filter("value IS NOT NULL").distinct().withColumn("hit", F.lit(True))
    counts = reference.select(F.inline(pairs)).groupBy("field", "value").agg(F.count("*").alias("n"))
    joined = counts.join(known, ["field", "value"], "left")
    return joined.groupBy("field").agg((F.sum(F.when(F.col("hit").isNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("rate"))


def category_holdout(rows: DataFrame, field: str, rate: float, seed: str) -> DataFrame:
    """(category, n): whole categories, in md5 order, taken while the rows taken so far are under ``rate`` of all.

    Nulls are no category. Running totals go by ranges of the md5, so no task gets them all.
    """
    counts = rows.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("category")).agg(F.count("*").alias("n"))
    keyed = counts.withColumn("__md5", F.md5(F.concat("category", F.lit(seed))))
    taken = running(keyed, [], [F.col("__md5").asc(), F.col("category").asc()], {"taken": F.col("n")})
    return taken.filter(F.col("taken") - F.col("n") < rate * rows.count()).select("category", "n")


def row_mask(jid: Column, rate: float, seed: str) -> Column:
    """True for about ``rate`` of the ids, the same ones wherever the rows are."""
    return F.substring(F.md5(F.concat(jid, F.lit(seed))), 1, 8) < F.lit(f"{min(int(rate * 2**32), 2**32 - 1):08x}")


def identity_columns(columns: list[str], field: str) -> list[str]:
    """Encoded columns that carry ``field``, alone or in a composite key."""
    out = []
    for c in columns:
        kind, _, rest = c.partition("_")
        if kind in ("te", "tc", "cat") and field in rest.split("__"):
            out.append(c)
    return out


def blank_identities(rows: DataFrame, mask: Column, fields: tuple[str, ...], prior: float | Column) -> DataFrame:
    """Encoded identity cells of masked rows as if unseen: target means the prior, counts and codes 0."""
    named = {c for f in fields for c in identity_columns(rows.columns, f)}
    blank = lambda c: F.lit(prior) if c.startswith("te_") and not isinstance(prior, Column) else prior if c.startswith("te_") else F.lit(0)
    return rows.select(*[F.when(mask, blank(c)).otherwise(F.col(c)).alias(c) if c in named else F.col(c) for c in rows.columns])
