"""Splits, ranks, blends, metrics and the output contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.ordered import placed, running
from emberline.schema import PREDICTOR_MARGIN
from emberline.scratch import materialise


def recency_cap(rows: DataFrame, most: int) -> DataFrame:
    """The ``most`` rows that started last; no start counts as -1, ties go by id."""
    return rows.orderBy(F.coalesce("start_epoch", F.lit(-1.0)).desc(), "jid").limit(most)


def recency_biased(rows: DataFrame, most: int, seed: str) -> DataFrame:
    """The newest half of ``most`` rows and the rest drawn from the older ones by md5."""
    newest = recency_cap(rows, most // 2).withColumn("newest", F.lit(1))
    older = rows.join(newest.select("jid"), "jid", "left_anti")
    return newest.unionByName(subsample(older, most - most // 2, seed).withColumn("newest", F.lit(0)))


def subsample(rows: DataFrame, n: int, seed: str) -> DataFrame:
    """``n`` rows in md5 order of their ids: the same ones wherever the rows are."""
    return rows.orderBy(F.md5(F.concat("jid", F.lit(seed))), "jid").limit(n)


def out_of_time_split(rows: DataFrame, holdout: int = 3) -> DataFrame:
    """Labelled rows with ``is_holdout``: the last ``holdout`` of the months that occur."""
    months = rows.filter("month IS NOT NULL AND target IS NOT NULL").select("month").distinct()
    last = [r.month for r in months.orderBy(F.col("month").desc()).limit(holdout + 1).collect()]
    if len(last) <= holdout:
        raise ValueError(f"{len(last)} months leave none to train on")
    return rows.filter("month IS NOT NULL AND target IS NOT NULL").withColumn("is_holdout", F.col("month") >= last[holdout - 1])


def rank_ordinal(rows: DataFrame, score: str, group: str = "cluster", tie: str = "jid") -> DataFrame:
    """Adds ``rank`` from 0 to 1 within ``group``, ties by ``tie``; a group of one has rank 0."""
    ranked = placed(rows, [group], [F.col(score).asc(), F.col(tie).asc()], "__at_", "__size")
    return ranked.withColumn("rank", F.col("__at_") / F.greatest(F.col("__size") - 1, F.lit(1))).drop("__at_", "__size")


def rank_blend(rows: DataFrame, scores: list[str], group: str = "cluster", tie: str = "jid") -> DataFrame:
    """(group, tie, blend): mean ordinal rank over models, mapped on the sorted mean scores by linear interpolation.

    Each score is ranked in one pass over what the pass before kept, so the work grows with the number of models.
    """
    mean = sum((F.col(s) for s in scores), F.lit(0.0)) / len(scores)
    ranked = rows.select(group, tie, *scores, mean.alias("mean"))
    for k, s in enumerate(scores):
        ranked = placed(ranked, [group], [F.col(s).asc(), F.col(tie).asc()], f"__p{k}")
    share = sum((F.col(f"__p{k}") for k in range(len(scores))), F.lit(0)) / len(scores)
    ranked = placed(ranked.select(group, tie, "mean", F.round(share, 9).alias("at")), [group], [F.col("mean").asc(), F.col(tie).asc()], "k")
    ranked = materialise(ranked, "ranked")
    either = F.array(F.struct(F.col("k").alias("at0"), F.col("mean").alias("m0"), F.lit(None).cast("double").alias("m1")), F.struct((F.col("k") - 1).alias("at0"), F.lit(None).cast("double").alias("m0"), F.col("mean").alias("m1")))
    steps = ranked.select(F.col(group).alias("g0"), F.inline(either)).groupBy("g0", "at0").agg(F.max("m0").alias("m0"), F.max("m1").alias("m1"))
    asked = ranked.select(group, tie, "at", F.floor("at").alias("__low"))
    joined = asked.join(steps, F.col(group).eqNullSafe(F.col("g0")) & (F.col("__low") == F.col("at0")))
    beyond = F.col("at") - F.col("__low")
    return joined.select(group, tie, F.when(beyond > 0, F.col("m0") + (F.col("m1") - F.col("m0")) * beyond).otherwise(F.col("m0")).alias("blend"))


def average_precision(rows: DataFrame, score: str = "score", target: str = "target", group: str = "cluster") -> DataFrame:
    """(group, ap): the step-wise area under precision and recall; rows with equal scores are one step. No positives: null."""
    steps = rows.groupBy(group, score).agg(F.sum(target).alias("tp"), F.count("*").alias("n"))
    run = running(steps, [group], [F.col(score).desc()], {"ctp": F.col("tp"), "cn": F.col("n")})
    return run.groupBy(group).agg((F.sum(F.col("tp") * F.col("ctp") / F.col("cn")) / F.nullif(F.sum("tp"), F.lit(0))).alias("ap"))


def macro_ap(ap: DataFrame) -> DataFrame:
    return ap.agg(F.avg("ap").alias("macro_ap"))


def class_weight(rows: DataFrame, group: str = "cluster") -> DataFrame:
    """(group, weight): the root of negatives per positive, within 1 and 6; null without positives."""
    counts = rows.groupBy(group).agg(F.sum("target").alias("p"), F.count("*").alias("n"))
    root = F.sqrt((F.col("n") - F.col("p")) / F.nullif(F.col("p"), F.lit(0)))
    return counts.select(group, F.when(root.isNotNull(), F.least(F.greatest(root, F.lit(1.0)), F.lit(6.0))).alias("weight"))


def choose_predictor(holdout_ap: dict[str, float], preferred: str = "blend", margin: float = PREDICTOR_MARGIN) -> str:
    """The preferred predictor, unless another beats it by more than ``margin``."""
    best = max(sorted(holdout_ap), key=lambda k: holdout_ap[k])
    if preferred in holdout_ap and holdout_ap[best] - holdout_ap[preferred] <= margin:
        return preferred
    return best


def refit_rounds(rounds: int, total: int, train: int, growth: float = 1.4, low: int = 10, high: int = 4000) -> int:
    return max(low, min(high, round(rounds * min(total / max(1, train), growth))))


def submission(sample: DataFrame, scores: DataFrame) -> DataFrame:
    """Every row of ``sample(position, row_id)`` with its clipped probability, null where none is known."""
    return sample.join(scores.select("row_id", F.greatest(F.least("score", F.lit(1.0)), F.lit(0.0)).alias("failure_probability")), "row_id", "left").select("position", "row_id", "failure_probability")


def contract_checks(answers: DataFrame) -> DataFrame:
    """One row of counts that must all be 0: rows without an answer, outside [0, 1], and repeated row ids."""
    p = F.col("failure_probability")
    flags = answers.groupBy("row_id").agg(F.count("*").alias("n"), F.count(F.when(p.isNull(), 1)).alias("missing"), F.count(F.when((p < 0) | (p > 1), 1)).alias("outside"))
    return flags.agg(F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"), F.coalesce(F.sum("outside"), F.lit(0)).alias("outside"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))


def require_contract(answers: DataFrame) -> None:
    found = contract_checks(answers).first().asDict()
    if any(found.values()):
        raise ValueError("the output breaks its contract: " + ", ".join(f"{n} {k}" for k, n in found.items() if n))
