"""Whole-life features of jobs: opt-in, and never part of the early-window matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalar import at_least, log1p_floor, ratio
from emberline.schema import EDGE_SECONDS, MINUTES_UNIT_CLUSTERS, ORDER


def lifespan_agg(rows: DataFrame, by_order: tuple[str, ...] = ("time_epoch", *ORDER[1:])) -> DataFrame:
    """Per job: first and last reading, readings, distinct hosts, first start and time limit."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*by_order))).alias(c)
    return rows.groupBy("jid").agg(F.min("time_epoch").alias("life_first"), F.max("time_epoch").alias("life_last"), F.count("*").alias("life_rows"), F.count_distinct("host").alias("life_hosts"), first("start_epoch"), first("timelimit"))


def lifespan_merge(parts: DataFrame) -> DataFrame:
    """Per-file spans of each job merged: extremes, readings summed, hosts at most those of one file."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("life_first"))).alias(c)
    more = [F.max("chunk_end_epoch").alias("chunk_end_epoch")] if "chunk_end_epoch" in parts.columns else []
    return parts.groupBy("jid").agg(F.min("life_first").alias("life_first"), F.max("life_last").alias("life_last"), F.sum("life_rows").alias("life_rows"), F.max("life_hosts").alias("life_hosts"), first("start_epoch"), first("timelimit"), *more)


def lifespan_features(jobs: DataFrame, spans: DataFrame) -> DataFrame:
    """Ten ``life_`` columns per job of ``jobs(jid, cluster)``; null where a job has no span.

    Time limits are minutes on the clusters known to state minutes and seconds on all others. The start is
    the job's (a column of ``jobs``), or its span's where ``jobs`` has none. A job whose last reading is
    within an hour of its release's end counts as censored.
    """
    unit = F.when(F.col("cluster").isin(*MINUTES_UNIT_CLUSTERS), 60.0).otherwise(1.0)
    if "start_epoch" in jobs.columns:
        joined = jobs.select("jid", "cluster", "start_epoch").join(spans.drop("start_epoch"), "jid", "left")
    else:
        joined = jobs.select("jid", "cluster").join(spans, "jid", "left")
    run = at_least(F.col("life_last") - F.col("start_epoch"), 0.0)
    limit = F.col("timelimit") * unit
    rows, hosts = F.col("life_rows").cast("double"), F.col("life_hosts").cast("double")
    return joined.select(
        "jid",
        run.alias("life_runtime"),
        log1p_floor(run).alias("life_runtime_log"),
        ratio(run, limit).alias("life_runtime_over_limit"),
        F.abs(1 - ratio(run, limit)).alias("life_limit_shortfall"),
        (limit - run).alias("life_remaining_seconds"),
        at_least(F.col("life_last") - F.col("life_first"), 0.0).alias("life_span"),
        rows.alias("life_rows"),
        hosts.alias("life_hosts"),
        ratio(rows, hosts).alias("life_rows_per_host"),
        F.coalesce(F.col("life_last") >= F.col("chunk_end_epoch") - EDGE_SECONDS, F.lit(False)).cast("int").alias("life_right_censored"),
    )
