"""Accumulators to the feature matrix of an early window.

Features are written as SQL text: a matrix has over 150 of them, and as text each is one call into the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions.scalar import host_count, is_positive, timelimit_bucket
from emberline.schema import CATEGORIES, DISPERSED, METRICS, PARTS, POSITIVE, TINY

EPSILON = f"{TINY!r}D"


def window_parts(seconds: float) -> list[str]:
    """The buckets that end within ``seconds`` of the start."""
    parts = [p for p, (_, high) in PARTS.items() if high <= seconds]
    if not parts:
        raise ValueError(f"no bucket ends within {seconds} seconds")
    return parts


def _ratio(a: str, b: str) -> str:
    """a / b, null for a zero or null denominator."""
    return f"(({a}) / nullif({b}, 0D))"


def _log(x: str) -> str:
    """ln(1 + max(x, 0)), null for null."""
    return f"ln(1 + IF({x} < 0, 0D, {x}))"


def _sum(names: list[str]) -> str:
    return "CAST(" + " + ".join(f"coalesce({c}, 0)" for c in names) + " AS DOUBLE)" if names else "0D"


def _edge(which: str, names: list[str]) -> str:
    """The least or greatest of columns, nulls aside."""
    return f"{which}({', '.join(names)})" if len(names) > 1 else names[0]


def _over(name: str, parts: list[str]) -> list[str]:
    return [f"{name}_{p}" for p in parts]


def observation(parts: list[str], seconds: float) -> dict[str, str]:
    rows, hosts = _sum(_over("rows", parts)), f"CAST({_edge('greatest', _over('hosts', parts))} AS DOUBLE)"
    first, last = _edge("least", _over("tmin", parts)), _edge("greatest", _over("tmax", parts))
    return {
        "obs_rows": rows,
        "obs_hosts": hosts,
        "obs_first_offset": first,
        "obs_last_offset": last,
        "obs_span": f"{last} - {first}",
        "obs_rows_per_host": _ratio(rows, hosts),
        "obs_delayed": f"IF({first} > 60, 1, 0)",
        "obs_reached_end": f"IF({last} >= {seconds - 120!r}D, 1, 0)",
    } | {f"obs_active_{p}": f"IF(rows_{p} > 0, 1, 0)" for p in parts}


def resources(parts: list[str]) -> dict[str, str]:
    seen = f"CAST({_edge('greatest', _over('hosts', parts))} AS DOUBLE)"
    plain = {c: c for c in ("timelimit", "nhosts", "ncores")}
    return plain | {f"{c}_log": _log(c) for c in plain} | {"cores_per_host": _ratio("ncores", "nhosts"), "hosts_seen_ratio": _ratio(seen, "nhosts"), "hosts_missing": f"nhosts - {seen}"}


def queue_time() -> dict[str, str]:
    waited = "start_epoch - submit_epoch"
    wait = f"IF({waited} < 0, 0D, {waited})"
    start, submit = "timestamp_seconds(start_epoch)", "timestamp_seconds(submit_epoch)"
    return {
        "queue_wait": wait,
        "queue_wait_log": f"ln(1 + {wait})",
        "queue_wait_over_timelimit": _ratio(wait, "timelimit"),
        "start_hour": f"hour({start})",
        "start_dayofweek": f"weekday({start})",
        "start_is_weekend": f"IF(weekday({start}) >= 5, 1, 0)",
        "start_day": f"day({start})",
        "start_hour_sin": f"sin(2 * pi() * hour({start}) / 24)",
        "start_hour_cos": f"cos(2 * pi() * hour({start}) / 24)",
        "submit_hour": f"hour({submit})",
        "submit_dayofweek": f"weekday({submit})",
    }


def metric(name: str, parts: list[str]) -> dict[str, str]:
    """The sixteen features of one metric over the window."""
    over = lambda stat, of: [f"{name}_{p}_{stat}" for p in of]
    cnt, rows = _sum(over("cnt", parts)), _sum(_over("rows", parts))
    mean = mean_of(name, parts)
    spread = f"({_ratio(_sum(over('sq', parts)), cnt)} - {mean} * {mean})"
    std = f"sqrt(IF({spread} < 0, 0D, {spread}))"
    low, high = _edge("least", over("min", parts)), _edge("greatest", over("max", parts))
    first, last = f"coalesce({', '.join(over('first', parts))})", f"coalesce({', '.join(over('last', parts)[::-1])})"
    head = _ratio(_sum(over("sum", parts[:1])), _sum(over("cnt", parts[:1])))
    tail = _ratio(_sum(over("sum", parts[1:])), _sum(over("cnt", parts[1:])))
    out = {
        "cnt": cnt,
        "mean": mean,
        "std": std,
        "cv": f"{std} / (abs({mean}) + {EPSILON})",
        "min": low,
        "max": high,
        "range": f"{high} - {low}",
        "first": first,
        "last": last,
        "delta": f"{last} - {first}",
        "zero_frac": _ratio(_sum(over("zero", parts)), cnt),
        "coverage": _ratio(cnt, rows),
        "head_mean": head,
        "tail_mean": tail,
        "trend": f"{tail} - {head}",
        "trend_ratio": f"{tail} / (abs({head}) + {EPSILON})",
    }
    return {f"{name}_{k}": v for k, v in out.items()}


def mean_of(name: str, parts: list[str]) -> str:
    """A metric's mean over the window."""
    return _ratio(_sum([f"{name}_{p}_sum" for p in parts]), _sum([f"{name}_{p}_cnt" for p in parts]))


def dispersion(parts: list[str]) -> dict[str, str]:
    """Spread over hosts, also relative to the metric's mean in the window."""
    out = {}
    for m in DISPERSED:
        spread = f"(hostdisp_{m}_max - hostdisp_{m}_min)"
        out |= {f"hostdisp_{m}_std": f"hostdisp_{m}_std", f"hostdisp_{m}_range": spread, f"hostdisp_{m}_rel": f"{spread} / (abs({mean_of(m, parts)}) + {EPSILON})", f"hostdisp_{m}_cnt": f"hostdisp_{m}_cnt"}
    return out


def cross(parts: list[str]) -> dict[str, str]:
    """Features that relate metrics to each other and to what was asked for."""
    mean = {m: mean_of(m, parts) for m in METRICS}
    per_host = _ratio("ncores", "nhosts")
    return {
        "mem_per_core": _ratio(mean["memused"], per_host),
        "mem_diskcache_gap": f"{mean['memused']} - {mean['memused_minus_diskcache']}",
        "mem_diskcache_ratio": _ratio(mean["memused_minus_diskcache"], mean["memused"]),
        "cpu_per_core": _ratio(mean["cpuuser"], per_host),
        "io_ratio": f"{mean['nfs']} / (abs({mean['block']}) + {EPSILON})",
    }


def month_of(start: Column) -> Column:
    return F.date_format(F.timestamp_seconds(start), "yyyy-MM")


def _clean(value: str, name: str) -> str:
    """``value`` as a double named ``name``, null where it is no finite number."""
    x = f"CAST({value} AS DOUBLE)"
    return f"IF(abs({x}) < double('infinity'), {x}, NULL) AS {name}"


def numeric(seconds: float) -> list[str]:
    """The numeric features of a window as SQL over accumulators."""
    parts = window_parts(seconds)
    made = observation(parts, seconds) | resources(parts) | queue_time() | dispersion(parts) | cross(parts)
    for m in METRICS:
        made |= metric(m, parts)
    return [_clean(v, k) for k, v in made.items()]


def matrix(acc: DataFrame, seconds: float = 1800.0) -> DataFrame:
    """The feature matrix: one row per job, numeric features null where undefined, then descriptions and the target."""
    listed = host_count(F.col("host_list"))
    lists = [listed.alias("host_list_count"), (listed / F.nullif(F.col("nhosts"), F.lit(0.0))).alias("host_list_ratio")]
    text = [F.col(c) for c in CATEGORIES] + [timelimit_bucket(F.col("timelimit")).alias("timelimit_bucket")]
    month = F.col("month") if "month" in acc.columns else month_of(F.col("start_epoch")).alias("month")
    meta = [F.col("cluster")] * ("cluster" in acc.columns) + [month, F.col("start_epoch"), is_positive(F.col("exitcode"), POSITIVE).alias("target")]
    return acc.select("jid", *text, *meta, *lists, *map(F.expr, numeric(seconds)))


def numeric_features(rows: DataFrame) -> list[str]:
    """The columns that may serve as features: all but the job's id, month, start, target, cluster and categories."""
    other = {"row_id", "jid", "cluster", "start_epoch", "month", "target", "timelimit_bucket", *CATEGORIES}
    return [c for c in rows.columns if c not in other]


def constant_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, low, high, kept): a column is kept if it has values, and nulls or more than one value."""
    stats = [F.struct(F.lit(c).alias("name"), F.count(c).alias("n"), F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high"), F.count("*").alias("total")) for c in columns]
    flat = rows.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    kept = (F.col("n") > 0) & ((F.col("n") < F.col("total")) | (F.col("low") != F.col("high")))
    return flat.select("name", "n", "low", "high", F.coalesce(kept, F.lit(False)).alias("kept"))


def range_guard(train: DataFrame, reference: DataFrame, columns: list[str], share: float = 0.20) -> DataFrame:
    """(name, outside, kept): a column is dropped if over ``share`` of the reference's values lie outside training's range.

    Columns without values on either side are kept.
    """
    ranges = [x for c in columns for x in (F.min(c).cast("double").alias(f"{c}__low"), F.max(c).cast("double").alias(f"{c}__high"))]
    known = train.agg(*ranges).first().asDict()
    out = []
    for c in columns:
        low, high = known[f"{c}__low"], known[f"{c}__high"]
        beyond = F.count(F.when((F.col(c) < low) | (F.col(c) > high), 1)) / F.nullif(F.count(c), F.lit(0)) if low is not None else F.lit(None).cast("double")
        out.append(F.struct(F.lit(c).alias("name"), beyond.alias("outside")))
    flat = reference.agg(F.array(*out).alias("s")).select(F.inline("s"))
    return flat.select("name", "outside", (~F.coalesce(F.col("outside") > share, F.lit(False))).alias("kept"))
