"""Readings to one row of accumulators per job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.schema import BEFORE_START, DISPERSED, METRICS, NUMERIC, ORDER, PARTS, STATS, STRINGS, WINDOW


def with_anchor(rows: DataFrame, chunk_start: float | Column | None = None, all_started: bool = False) -> DataFrame:
    """Adds ``anchor``: the start, not before ``chunk_start``.

    A reading without a start takes the earliest of its job's readings without one. Only these
    are aggregated for it, and with ``all_started``, for sources that state every start, nothing is.
    """
    start = F.col("start_epoch")
    clamped = start
    if chunk_start is not None:
        edge = chunk_start if isinstance(chunk_start, Column) else F.lit(float(chunk_start))
        clamped = F.when(start < edge, edge).otherwise(start)
    if all_started:
        return rows.withColumn("anchor", clamped)
    earliest = rows.filter(start.isNull()).groupBy(F.col("jid").alias("__jid")).agg(F.min("time_epoch").alias("__earliest"))
    joined = rows.join(earliest, start.isNull() & (F.col("jid") == F.col("__jid")), "left")
    return joined.withColumn("anchor", F.coalesce(clamped, "__earliest")).drop("__jid", "__earliest")


def early_window(rows: DataFrame, before: float = BEFORE_START, after: float = WINDOW) -> DataFrame:
    """Readings from ``before`` seconds ahead of the anchor to ``after`` past it, with ``elapsed``."""
    return rows.withColumn("elapsed", F.col("time_epoch") - F.col("anchor")).filter(F.col("elapsed").between(-before, after))


def bucket(elapsed: Column) -> Column:
    """The bucket of an elapsed time: half open, the last closed; -1 outside."""
    out = F.lit(-1)
    for k, (low, high) in reversed(list(enumerate(PARTS.values()))):
        inside = (elapsed >= low) & ((elapsed <= high) if k == len(PARTS) - 1 else (elapsed < high))
        out = F.when(inside, k).otherwise(out)
    return out


def most_complete(rows: DataFrame, keys: tuple[str, ...] = ("jid", "host", "time_epoch")) -> DataFrame:
    """Of readings that share ``keys`` the one with most metrics; ties go to the first line and part."""
    complete = sum((F.col(m).isNotNull().cast("int") for m in METRICS), F.lit(0))
    order = W.partitionBy(*keys).orderBy(complete.desc(), "line", "part_key")
    return rows.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def window_rows(rows: DataFrame, chunk_start: float | Column | None = None, all_started: bool = False) -> DataFrame:
    """The early window's readings, one per job, host and time, with their bucket; anchors as by ``with_anchor``.

    A column ``chunk_start`` of ``rows`` (see ``read_raw``) is used where no other is given. Readings
    with a start are cut to the window before anything is shuffled. They are dealt by job, once for all that follows: a
    job has no more readings in its window than its hosts times the ticks of 35 minutes.
    """
    if chunk_start is None and "chunk_start" in rows.columns:
        chunk_start = F.col("chunk_start")
    if not all_started:
        edge = F.col("start_epoch") if chunk_start is None else F.greatest("start_epoch", chunk_start if isinstance(chunk_start, Column) else F.lit(float(chunk_start)))
        rows = rows.filter(F.col("start_epoch").isNull() | (F.col("time_epoch") - edge).between(-BEFORE_START, WINDOW))
    inside = early_window(with_anchor(rows, chunk_start, all_started))
    return most_complete(inside.repartition("jid")).withColumn("part", bucket(F.col("elapsed")))


def _stat(metric: str, stat: str, when: Column | None = None) -> Column:
    value = F.col(metric) if when is None else F.when(when, F.col(metric))
    if stat == "cnt":
        return F.count(value)
    if stat == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    if stat == "sq":
        return F.coalesce(F.sum(value * value), F.lit(0.0))
    if stat == "zero":
        return F.count(F.when(value == 0, 1))
    if stat in ("min", "max"):
        return getattr(F, stat)(value)
    order = F.when(value.isNotNull(), F.struct(*ORDER))
    return F.min_by(value, order) if stat == "first" else F.max_by(value, order)


def part_stats(rows: DataFrame, stats: tuple[str, ...] = STATS, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Per job and bucket the named statistics of each metric; first and last skip nulls."""
    return rows.groupBy("jid", "part").agg(*[_stat(m, s).alias(f"{m}_{s}") for m in metrics for s in stats])


def part_shape(rows: DataFrame) -> DataFrame:
    """Per job and bucket: readings, distinct hosts, first and last elapsed time."""
    return rows.groupBy("jid", "part").agg(F.count("*").alias("rows"), F.count_distinct("host").alias("hosts"), F.min("elapsed").alias("tmin"), F.max("elapsed").alias("tmax"))


def host_dispersion(rows: DataFrame) -> DataFrame:
    """Per job, over hosts' mean values: sample standard deviation, smallest, largest, number. Null hosts are left out."""
    means = rows.filter("host IS NOT NULL").groupBy("jid", "host").agg(*[F.avg(m).alias(m) for m in DISPERSED])
    spread = []
    for m in DISPERSED:
        spread += [F.stddev_samp(m).alias(f"hostdisp_{m}_std"), F.min(m).alias(f"hostdisp_{m}_min"), F.max(m).alias(f"hostdisp_{m}_max"), F.count(m).alias(f"hostdisp_{m}_cnt")]
    return means.groupBy("jid").agg(*spread)


def job_meta(rows: DataFrame, more: tuple[str, ...] = ("cluster", "month", "exitcode")) -> DataFrame:
    """Per job the first non-null value of each describing column, in order of its readings."""
    columns = ("start_epoch", "submit_epoch", *NUMERIC, *STRINGS, *[c for c in more if c in rows.columns])
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(*ORDER))).alias(c)
    return rows.groupBy("jid").agg(*[first(c) for c in columns], F.count_distinct("host").alias("n_hosts_seen"))


def column_name(stat: str, part: str) -> str:
    """The stored name of a statistic in a bucket: ``<metric>_<part>_<stat>``, ``rows_<part>``."""
    metric, _, kind = stat.rpartition("_")
    return f"{metric}_{part}_{kind}" if metric in METRICS and kind in STATS else f"{stat}_{part}"


def widen(parts: DataFrame) -> DataFrame:
    """Per-bucket columns side by side, one row per job; counts and sums of an absent bucket are 0."""
    names = [c for c in parts.columns if c not in ("jid", "part")]
    additive = ("_cnt", "_sum", "_sq", "_zero")
    out = []
    for k, part in enumerate(PARTS):
        for c in names:
            value = F.max(F.when(F.col("part") == k, F.col(c)))
            out.append((F.coalesce(value, F.lit(0)) if c.endswith(additive) or c in ("rows", "hosts") else value).alias(column_name(c, part)))
    return parts.groupBy("jid").agg(*out)


def _stat_sql(metric: str, stat: str, inside: str) -> str:
    """The SQL of one statistic of a metric over the readings that are ``inside``; first and last skip nulls."""
    value = f"IF({inside}, {metric}, NULL)"
    edge = f"IF({inside} AND {metric} IS NOT NULL, struct({', '.join(ORDER)}, {metric} AS v), NULL)"
    return {
        "cnt": f"count({value})",
        "sum": f"coalesce(sum({value}), 0D)",
        "sq": f"coalesce(sum({value} * {value}), 0D)",
        "zero": f"count(IF({inside} AND {metric} = 0, 1, NULL))",
        "min": f"min({value})",
        "max": f"max({value})",
        "first": f"min({edge}).v",
        "last": f"max({edge}).v",
    }[stat]


def accumulators(rows: DataFrame, more: tuple[str, ...] = ("cluster", "month", "exitcode")) -> DataFrame:
    """One row per job from readings in the early window (see ``window_rows``): statistics, shape, dispersion, description.

    The readings of a job already lie together, in order of host and time, after the window was made; what
    is per host (a host's first reading, its first in a bucket, its mean) is marked on them in that order, and one
    aggregate makes the row: the window is read once and not dealt again. Null hosts count as readings and
    not as hosts. The aggregates are SQL text, each one call into the JVM.
    """
    meta = ("start_epoch", "submit_epoch", *NUMERIC, *STRINGS, *[c for c in more if c in rows.columns])
    host = W.partitionBy("jid", "host")
    by_time = host.orderBy("time_epoch")
    marked = rows.withColumns({"__of_host": F.row_number().over(by_time), "__before": F.lag("part").over(by_time)} | {f"__mean_{m}": F.avg(m).over(host) for m in DISPERSED})
    out = []
    for k, part in enumerate(PARTS):
        inside = f"part = {k}"
        out += [f"count(IF({inside}, 1, NULL)) AS rows_{part}", f"count(IF({inside} AND host IS NOT NULL AND NOT (__before <=> {k}), 1, NULL)) AS hosts_{part}"]
        out += [f"min(IF({inside}, elapsed, NULL)) AS tmin_{part}", f"max(IF({inside}, elapsed, NULL)) AS tmax_{part}"]
        out += [f"{_stat_sql(m, s, inside)} AS {m}_{part}_{s}" for m in METRICS for s in STATS]
    out += [f"{_stat_sql(c, 'first', 'true')} AS {c}" for c in meta]
    first = "host IS NOT NULL AND __of_host = 1"
    out.append(f"count(IF({first}, 1, NULL)) AS n_hosts_seen")
    for m in DISPERSED:
        mean = f"IF({first}, __mean_{m}, NULL)"
        out += [f"stddev_samp({mean}) AS hostdisp_{m}_std", f"min({mean}) AS hostdisp_{m}_min", f"max({mean}) AS hostdisp_{m}_max", f"count({mean}) AS hostdisp_{m}_cnt"]
    return marked.groupBy("jid").agg(*map(F.expr, out))


def merge_parts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per-bucket statistics of two sets of readings merged into those of both.

    Sums add, extremes combine; ``first`` and ``last`` go by the ``tmin`` and ``tmax`` of their
    side, the left one on ties. Both sides hold ``part_stats`` and ``part_shape`` columns.
    """
    both = left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1)))
    out = []
    for m in METRICS:
        for s in ("cnt", "sum", "sq", "zero"):
            out.append(F.sum(f"{m}_{s}").alias(f"{m}_{s}"))
        out += [F.min(f"{m}_min").alias(f"{m}_min"), F.max(f"{m}_max").alias(f"{m}_max")]
        first, last = F.col(f"{m}_first"), F.col(f"{m}_last")
        out.append(F.min_by(first, F.when(first.isNotNull(), F.struct("tmin", "__side"))).alias(f"{m}_first"))
        out.append(F.max_by(last, F.when(last.isNotNull(), F.struct(F.col("tmax"), -F.col("__side")))).alias(f"{m}_last"))
    out += [F.sum("rows").alias("rows"), F.min("tmin").alias("tmin"), F.max("tmax").alias("tmax")]
    return both.groupBy("jid", "part").agg(*out)


def uncovered(wanted: DataFrame, covered: DataFrame) -> DataFrame:
    """Wanted jobs that no record covers."""
    return wanted.select("jid").distinct().join(covered.select("jid"), "jid", "left_anti")


def first_seen(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Each wanted job's earliest reading, wherever it is."""
    return rows.join(wanted.select("jid").distinct(), "jid", "left_semi").groupBy("jid").agg(F.min("time_epoch").alias("first_seen"))


def fallback_rows(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Window readings of jobs anchored at their first reading instead of their start."""
    anchored = rows.join(seen, "jid").withColumn("anchor", F.col("first_seen")).drop("first_seen")
    return most_complete(early_window(anchored).repartition("jid")).withColumn("part", bucket(F.col("elapsed")))


def prefer_strict(strict: DataFrame, fallback: DataFrame) -> DataFrame:
    """Strict records, and fallback ones of jobs that have none."""
    both = strict.withColumn("source_rank", F.lit(0)).unionByName(fallback.withColumn("source_rank", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__n", F.row_number().over(W.partitionBy("jid").orderBy("source_rank"))).filter("__n = 1").drop("__n")


def least_delayed(releases: list[DataFrame]) -> DataFrame:
    """Of a job's records in several releases the one first observed; ties go to the earlier release."""
    out = None
    for k, rows in enumerate(releases):
        rows = rows.withColumn("release", F.lit(k))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    delay = F.coalesce(*[F.col(f"tmin_{p}") for p in PARTS])
    order = W.partitionBy("jid").orderBy(delay.asc_nulls_last(), "release")
    return out.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def month_prune(rows: DataFrame, low: str | None = None, high: str | None = None) -> DataFrame:
    """Rows whose month lies between two months, both included."""
    rows = rows.filter(F.col("month") >= low) if low else rows
    return rows.filter(F.col("month") <= high) if high else rows


def window_hours(anchors: DataFrame, at: str, before: float = BEFORE_START, after: float = WINDOW) -> DataFrame:
    """Every hour that the windows around timestamp column ``at`` touch, once, with how many windows do."""
    low = F.date_trunc("hour", F.col(at) - F.make_dt_interval(secs=F.lit(before)))
    high = F.date_trunc("hour", F.col(at) + F.make_dt_interval(secs=F.lit(after)))
    hours = anchors.select(F.explode(F.sequence(low, high, F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return hours.groupBy("hour").agg(F.count("*").alias("n_windows"))
