"""DuckDB forms of the queries, written against the raw tables."""

from __future__ import annotations

from emberline.schema import CATEGORIES, DISPERSED, KEYS, METRICS, PARTS, STATS

HOST = "'NODE' || l_suppkey"
COMPLETE = " + ".join(f"CAST({m} IS NOT NULL AS INT)" for m in METRICS)

TEL = f"""
per AS (SELECT l_orderkey AS job_key, CAST(max(p_size) * 60 AS DOUBLE) AS timelimit, CAST(count(*) AS DOUBLE) AS nhosts, CAST(sum(p_size) AS DOUBLE) AS ncores,
        CASE WHEN l_orderkey % 11 <> 0 THEN '{{' || array_to_string(list_sort(list(DISTINCT {HOST})), ',') || '}}' END AS host_list
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
tel AS (SELECT r_name AS cluster, 'JOB' || o_orderkey AS jid, {HOST} AS host,
        CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS time_epoch,
        CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) - o_orderkey % 30 AS DOUBLE) AS submit_epoch,
        CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS start_epoch,
        timelimit, nhosts, ncores, c_mktsegment AS account, o_orderpriority AS queue, l_returnflag AS unit, p_type AS jobname, 'USER' || o_custkey AS username, host_list,
        CASE o_orderstatus WHEN 'F' THEN 'FAILED' WHEN 'O' THEN 'COMPLETED' ELSE 'CANCELLED' END AS exitcode,
        l_quantity AS cpuuser, CAST(NULL AS DOUBLE) AS gpu, CAST(floor(l_extendedprice) AS DOUBLE) AS memused, CAST(floor(l_extendedprice * (1 - l_discount)) AS DOUBLE) AS memused_minus_diskcache, floor(l_tax * 128) / 128 AS nfs, floor(l_discount * 128) / 128 AS block,
        strftime(o_orderdate, '%Y-%m') AS month, l_linenumber AS line, l_partkey AS part_key
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN per ON l_orderkey = job_key)"""

BUCKET = "CASE WHEN elapsed < -300 OR elapsed > 1800 THEN -1 WHEN elapsed < 300 THEN 0 WHEN elapsed < 900 THEN 1 ELSE 2 END"
ORDER = "row(elapsed, host, line, part_key)"


def windowed(rows: str, name: str = "win") -> str:
    """The early window of ``rows`` (with an ``anchor``), deduplicated, as a common table."""
    return f"""{name}_e AS (SELECT *, time_epoch - anchor AS elapsed FROM {rows} WHERE time_epoch - anchor BETWEEN -300 AND 1800),
{name} AS (SELECT *, {BUCKET} AS part FROM {name}_e
        QUALIFY row_number() OVER (PARTITION BY jid, host, time_epoch ORDER BY {COMPLETE} DESC, line, part_key) = 1)"""


WIN = f"{TEL},\nanchored AS (SELECT *, start_epoch AS anchor FROM tel),\n{windowed('anchored')}"


def r(x: str, places: int = 6, name: str | None = None) -> str:
    return f"round({x}, {places}) AS {name or x}"


def stat(m: str, s: str) -> str:
    return {
        "cnt": f"count({m})",
        "sum": f"coalesce(sum({m}), 0.0)",
        "sq": f"coalesce(sum({m} * {m}), 0.0)",
        "zero": f"count(CASE WHEN {m} = 0 THEN 1 END)",
        "min": f"min({m})",
        "max": f"max({m})",
        "first": f"arg_min({m}, {ORDER}) FILTER (WHERE {m} IS NOT NULL)",
        "last": f"arg_max({m}, {ORDER}) FILTER (WHERE {m} IS NOT NULL)",
    }[s]


def part_stats(rows: str, stats: tuple[str, ...], metrics: tuple[str, ...] = METRICS, places: int = 6) -> str:
    out = []
    for m in metrics:
        for s in stats:
            x = stat(m, s)
            out.append(f"{x} AS {m}_{s}" if s in ("cnt", "zero") else f"round({x}, {places}) AS {m}_{s}")
    return f"SELECT jid, part, {', '.join(out)} FROM {rows} GROUP BY jid, part"


META_COLUMNS = ("start_epoch", "submit_epoch", "timelimit", "nhosts", "ncores", "account", "queue", "unit", "jobname", "username", "host_list", "cluster", "month", "exitcode")
META = "meta AS (SELECT jid, " + ", ".join(f"arg_min({c}, {ORDER}) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in META_COLUMNS) + ", count(DISTINCT host) AS n_hosts_seen FROM win GROUP BY jid)"
LIMIT_BUCKET = "coalesce(printf('%.1f', round_even(ln(1 + greatest(timelimit, 0)), 1)), 'na')"
LABELLED = f"""{WIN}, {META},
lab AS (SELECT jid, cluster, account, queue, unit, username, jobname, start_epoch, month, {LIMIT_BUCKET} AS timelimit_bucket,
        CAST(coalesce(upper(exitcode) IN ('FAILED', 'TIMEOUT', 'NODE_FAIL'), false) AS INT) AS target FROM meta)"""

SHAPE = "shape AS (SELECT jid, part, count(*) AS rows, count(DISTINCT host) AS hosts, min(elapsed) AS tmin, max(elapsed) AS tmax FROM win GROUP BY jid, part)"
DISP = "disp AS (SELECT jid, " + ", ".join(f"stddev_samp({m}) AS hostdisp_{m}_std, min({m}) AS hostdisp_{m}_min, max({m}) AS hostdisp_{m}_max, count({m}) AS hostdisp_{m}_cnt" for m in ("cpuuser", "memused")) + " FROM (SELECT jid, host, avg(cpuuser) AS cpuuser, avg(memused) AS memused FROM win WHERE host IS NOT NULL GROUP BY jid, host) GROUP BY jid)"


def feature_base(parts: tuple[int, ...], metrics: tuple[str, ...]) -> str:
    """A table ``f``: each job's sums and edges over the window's buckets, with its description."""
    inside = f"part IN ({', '.join(map(str, parts))})"
    tail = f"part IN ({', '.join(map(str, parts[1:])) or -1})"
    out = [f"count(*) FILTER (WHERE {inside}) AS n_rows", f"min(elapsed) FILTER (WHERE {inside}) AS first_at", f"max(elapsed) FILTER (WHERE {inside}) AS last_at"]
    for m in metrics:
        out += [f"count({m}) FILTER (WHERE {inside}) AS {m}_n", f"sum({m}) FILTER (WHERE {inside}) AS {m}_s", f"sum({m} * {m}) FILTER (WHERE {inside}) AS {m}_q", f"count(*) FILTER (WHERE {inside} AND {m} = 0) AS {m}_z"]
        out += [f"min({m}) FILTER (WHERE {inside}) AS {m}_lo", f"max({m}) FILTER (WHERE {inside}) AS {m}_hi"]
        out += [f"arg_min({m}, {ORDER}) FILTER (WHERE {inside} AND {m} IS NOT NULL) AS {m}_f", f"arg_max({m}, {ORDER}) FILTER (WHERE {inside} AND {m} IS NOT NULL) AS {m}_l"]
        out += [f"avg({m}) FILTER (WHERE part = 0) AS {m}_head", f"avg({m}) FILTER (WHERE {tail}) AS {m}_tail"]
    return f"{WIN}, {META}, {SHAPE}, {DISP},\ng AS (SELECT jid, {', '.join(out)} FROM win GROUP BY jid),\nh AS (SELECT jid, max(hosts) FILTER (WHERE {inside}) AS top_hosts, {', '.join(f'max(rows) FILTER (WHERE part = {k}) AS rows_{k}' for k in (0, 1, 2))} FROM shape GROUP BY jid),\nf AS (SELECT * FROM meta JOIN g USING (jid) JOIN h USING (jid) LEFT JOIN disp USING (jid))"


def mean(m: str) -> str:
    return f"({m}_s / nullif({m}_n, 0))"


def std(m: str) -> str:
    return f"sqrt(CASE WHEN {m}_q / nullif({m}_n, 0) - {mean(m)} * {mean(m)} < 0 THEN 0 ELSE {m}_q / nullif({m}_n, 0) - {mean(m)} * {mean(m)} END)"


def metric_features(m: str, places: int) -> str:
    made = {
        "cnt": f"CAST({m}_n AS DOUBLE)", "mean": mean(m), "std": std(m), "cv": f"{std(m)} / (abs({mean(m)}) + 1e-6)", "min": f"{m}_lo", "max": f"{m}_hi", "range": f"{m}_hi - {m}_lo",
        "first": f"{m}_f", "last": f"{m}_l", "delta": f"{m}_l - {m}_f", "zero_frac": f"{m}_z / nullif({m}_n, 0)", "coverage": f"{m}_n / nullif(n_rows, 0)",
    }
    return ", ".join(r(v, places, f"{m}_{k}") for k, v in made.items())


def trend_features(m: str, places: int) -> str:
    made = {"head_mean": f"{m}_head", "tail_mean": f"{m}_tail", "trend": f"{m}_tail - {m}_head", "trend_ratio": f"{m}_tail / (abs({m}_head) + 1e-6)"}
    return ", ".join(r(v, places, f"{m}_{k}") for k, v in made.items())


def wide_stat(m: str, s: str, k: int) -> str:
    """One stored statistic of a metric in bucket ``k``, over ``win`` by job."""
    inside = f"FILTER (WHERE part = {k})"
    some = f"FILTER (WHERE part = {k} AND {m} IS NOT NULL)"
    value = {
        "cnt": f"count({m}) {inside}",
        "zero": f"count(*) FILTER (WHERE part = {k} AND {m} = 0)",
        "sum": f"round(coalesce(sum({m}) {inside}, 0.0), 9)",
        "sq": f"coalesce(sum({m} * {m}) {inside}, 0.0)",
        "min": f"round(min({m}) {inside}, 9)",
        "max": f"round(max({m}) {inside}, 9)",
        "first": f"round(arg_min({m}, {ORDER}) {some}, 9)",
        "last": f"round(arg_max({m}, {ORDER}) {some}, 9)",
    }[s]
    return f"{value} AS {m}_p{k}_{s}"


def wide_shape(k: int) -> str:
    inside = f"FILTER (WHERE part = {k})"
    return f"count(*) {inside} AS rows_p{k}, count(DISTINCT host) {inside} AS hosts_p{k}, min(elapsed) {inside} AS tmin_p{k}, max(elapsed) {inside} AS tmax_p{k}"


def key(columns: tuple[str, ...], sep: str) -> str:
    return f" || {sep} || ".join(f"coalesce(CAST({c} AS VARCHAR), '__missing__')" for c in columns)


def long_keys(rows: str, more: str, sep: str = "chr(31)") -> str:
    return " UNION ALL ".join(f"SELECT jid, '{n}' AS key_name, {key(c, sep)} AS key{more} FROM {rows}" for n, c in KEYS.items())


def expanding() -> str:
    return f"""{LABELLED},
lk AS ({long_keys("lab", ", month, target")}),
mo AS (SELECT key_name, key, month, sum(target) AS p, count(*) AS c FROM lk GROUP BY ALL),
hi AS (SELECT key_name, key, month, sum(p) OVER w AS p, sum(c) OVER w AS c FROM mo WINDOW w AS (PARTITION BY key_name, key ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
te AS (SELECT jid, lk.key_name, (coalesce(p, 0) + 25 * (SELECT avg(target) FROM lab)) / (coalesce(c, 0) + 25) AS te, ln(1 + coalesce(c, 0)) AS tc FROM lk LEFT JOIN hi USING (key_name, key, month))"""


SEEN = f"unc AS (SELECT 'JOB' || o_orderkey AS jid FROM orders WHERE 'JOB' || o_orderkey NOT IN (SELECT jid FROM win)), seen AS (SELECT jid, min(time_epoch) AS first_seen FROM tel WHERE jid IN (SELECT jid FROM unc) GROUP BY jid)"
CODES = "ca AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, coalesce({c}, '__missing__') AS category FROM lab" for c in CATEGORIES) + "), cn AS (SELECT field, category, count(*) AS n FROM ca GROUP BY ALL), co AS (SELECT *, CASE WHEN n >= 5 THEN row_number() OVER (PARTITION BY field ORDER BY n DESC, category) ELSE 0 END AS code FROM cn)"
SCORED = """sc AS (SELECT 'JOB' || o_orderkey AS jid, o_orderpriority AS cluster, round(o_totalprice / 600000, 3) AS score_a, round((o_custkey % 997) / 997, 3) AS score_b, CAST(o_orderstatus = 'F' AS INT) AS target FROM orders)"""
AP = f"""{SCORED}, st AS (SELECT cluster, score_a, sum(target) AS tp, count(*) AS n FROM sc GROUP BY ALL),
ru AS (SELECT cluster, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM st WINDOW w AS (PARTITION BY cluster ORDER BY score_a DESC)),
ap AS (SELECT cluster, sum(tp * ctp / cn) / nullif(sum(tp), 0) AS ap FROM ru GROUP BY cluster)"""
ANSWERS = f"""{SCORED}, an AS (SELECT CAST(substr(jid, 4) AS BIGINT) * 3 AS position, cluster || '_' || jid AS row_id,
CASE WHEN score_a * 2 - 0.2 < 1.4 THEN greatest(least(score_a * 2 - 0.2, 1.0), 0.0) END AS failure_probability FROM sc)"""
START = "make_timestamp(CAST(start_epoch * 1000000 AS BIGINT))"
SUBMIT = "make_timestamp(CAST(submit_epoch * 1000000 AS BIGINT))"
DOW = "(isodow({}) - 1)"
WAIT = "greatest(start_epoch - submit_epoch, 0)"
WIDE_SHAPE = ", ".join(f"max(rows) FILTER (WHERE part = {k}) AS rows_p{k}, min(tmin) FILTER (WHERE part = {k}) AS tmin_p{k}" for k in (0, 1, 2))
SPAN = "min(time_epoch) AS life_first, max(time_epoch) AS life_last, count(*) AS life_rows, count(DISTINCT host) AS life_hosts"
BY_TIME = "row(time_epoch, host, line, part_key)"
GUARD = [("start_epoch", "start_epoch"), ("timelimit", "timelimit"), ("cpuuser_mean", mean("cpuuser")), ("obs_rows", "n_rows")]
CONST = [("obs_rows", "n_rows"), ("cpuuser_max", "cpuuser_hi"), ("obs_hosts", "top_hosts")]


def _release(k: int, line: int) -> str:
    return f"SELECT jid, {k} AS release, {WIDE_SHAPE} FROM (SELECT jid, part, count(*) AS rows, min(elapsed) AS tmin FROM win WHERE line % 2 = {line} GROUP BY jid, part) GROUP BY jid"


ORACLE_SQL: dict[str, str] = {
    "prepare_telemetry": f"WITH {TEL} SELECT * FROM tel",
    "cluster_route": f"WITH {TEL} SELECT CASE cluster WHEN 'AFRICA' THEN 'S' WHEN 'AMERICA' THEN 'C' ELSE 'Anvil' END AS routed, count(*) AS n FROM tel GROUP BY 1",
    "month_prune": f"WITH {TEL} SELECT month, count(*) AS n FROM tel WHERE month BETWEEN '1996-03' AND '1997-02' GROUP BY month",
    "hour_enumerate": "SELECT strftime(h, '%Y-%m-%d-%H') AS hour, count(*) AS n_windows FROM (SELECT unnest(generate_series(date_trunc('hour', ts - INTERVAL 300 SECOND), date_trunc('hour', ts + INTERVAL 1800 SECOND), INTERVAL 1 HOUR)) AS h FROM events) GROUP BY 1",
    "dedup_most_complete": f"WITH {TEL}, u AS (SELECT * FROM tel UNION ALL SELECT * REPLACE (CAST(NULL AS DOUBLE) AS memused, -1 AS line) FROM tel), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY jid, host, time_epoch ORDER BY {COMPLETE} DESC, line, part_key) = 1) SELECT jid, count(*) AS n, count(memused) AS n_mem, {r('sum(memused)', 6, 'mem')} FROM k GROUP BY jid",
    "epoch_coerce": "SELECT l_linenumber, count(*) AS n, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE count(*) END AS n_times, CASE WHEN l_linenumber % 3 <> 0 THEN epoch(max(l_shipdate)) END AS latest, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE count(*) END AS n_numbers, CASE WHEN l_linenumber % 2 <> 0 THEN sum(l_quantity) END AS total FROM lineitem GROUP BY l_linenumber",
    "anchor_clamped": f"WITH {TEL} SELECT jid, min(greatest(start_epoch, 9496.0)) AS anchor, max(greatest(start_epoch, 9496.0)) AS anchor_max, min(start_epoch) AS start_epoch FROM tel GROUP BY jid",
    "anchor_missing_start": f"WITH {TEL} SELECT jid, CASE WHEN CAST(substr(jid, 4) AS BIGINT) % 7 <> 0 THEN min(start_epoch) ELSE min(time_epoch) END AS anchor, CASE WHEN CAST(substr(jid, 4) AS BIGINT) % 7 <> 0 THEN count(*) ELSE 0 END AS n_started FROM tel GROUP BY jid",
    "early_window": f"WITH {TEL} SELECT jid, host, line, part_key, time_epoch - start_epoch AS elapsed FROM tel WHERE time_epoch - start_epoch BETWEEN -300 AND 1800",
    "bucket_assign": f"WITH {TEL}, e AS (SELECT time_epoch - start_epoch AS elapsed FROM tel) SELECT {BUCKET} AS part, count(*) AS n, min(elapsed) AS tmin, max(elapsed) AS tmax FROM e GROUP BY 1",
    "acc_sum_stats": f"WITH {WIN} {part_stats('win', ('cnt', 'sum', 'sq', 'zero'))}",
    "acc_min_max": f"WITH {WIN} {part_stats('win', ('min', 'max'))}",
    "acc_first_last": f"WITH {WIN} {part_stats('win', ('first', 'last'))}",
    "acc_rows_hosts": f"WITH {WIN}, {SHAPE} SELECT * FROM shape",
    "host_dispersion": f"WITH {WIN}, {DISP} SELECT jid, " + ", ".join(f"round(hostdisp_{m}_{s}, 4) AS hostdisp_{m}_{s}" if s != "cnt" else f"hostdisp_{m}_cnt" for m in ("cpuuser", "memused") for s in ("std", "min", "max", "cnt")) + " FROM disp",
    "job_meta_first": f"WITH {WIN}, {META} SELECT * FROM meta",
    "merge_partials": f"WITH {WIN} {part_stats('win', STATS, METRICS, 4).replace(' FROM win', ', count(*) AS rows, min(elapsed) AS tmin, max(elapsed) AS tmax FROM win')}",
    "job_accumulators": f"WITH {WIN}, {META}, {DISP}, wide AS (SELECT jid, " + ", ".join([wide_shape(k) for k in range(len(PARTS))] + [wide_stat(m, s, k) for m in METRICS for k in range(len(PARTS)) for s in STATS]) + " FROM win GROUP BY jid) SELECT meta.*, wide.* EXCLUDE (jid), " + ", ".join(f"round(hostdisp_{m}_{s}, {4 if s == 'std' else 9}) AS hostdisp_{m}_{s}" if s != "cnt" else f"hostdisp_{m}_cnt" for m in DISPERSED for s in ("std", "min", "max", "cnt")) + " FROM wide JOIN meta USING (jid) LEFT JOIN disp USING (jid)",
    "raw_file_accumulators": f"WITH {TEL}, raw AS (SELECT * REPLACE (CASE CAST(substr(jid, 4) AS BIGINT) % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'C' ELSE 'Anvil' END AS cluster), CASE WHEN CAST(substr(jid, 4) AS BIGINT) % 7 = 0 THEN min(time_epoch) OVER (PARTITION BY jid) ELSE greatest(start_epoch, CASE CAST(substr(jid, 4) AS BIGINT) % 3 WHEN 1 THEN 10800.0 ELSE 7200.0 END) END AS anchor FROM tel), {windowed('raw')} SELECT jid, min(cluster) AS cluster, min(timelimit) AS timelimit, min(exitcode) AS exitcode, " + ", ".join([wide_shape(k) for k in range(len(PARTS))] + [wide_stat(m, s, k) for m in ("cpuuser", "nfs", "gpu") for k in range(len(PARTS)) for s in ("cnt", "sum", "min", "max")]) + " FROM win GROUP BY jid",
    "uncovered_jobs": f"WITH {WIN}, {SEEN} SELECT jid FROM unc",
    "first_seen": f"WITH {WIN}, {SEEN} SELECT * FROM seen",
    "fallback_accumulators": f"WITH {WIN}, {SEEN}, late AS (SELECT tel.*, first_seen AS anchor FROM tel JOIN seen USING (jid)), {windowed('late', 'fb')} {part_stats('fb', ('cnt', 'sum'), ('cpuuser', 'memused'), 4)}",
    "strict_over_fallback": f"WITH {WIN}, s AS (SELECT jid, count(*) AS rows, 0 AS source_rank FROM win GROUP BY jid) SELECT * FROM s UNION ALL SELECT jid, count(*), 1 FROM tel WHERE jid NOT IN (SELECT jid FROM s) GROUP BY jid",
    "least_delayed_release": f"WITH {WIN}, u AS ({_release(0, 1)} UNION ALL {_release(1, 0)}) SELECT jid, release, coalesce(rows_p0, 0) AS rows_p0, coalesce(rows_p1, 0) AS rows_p1, coalesce(rows_p2, 0) AS rows_p2, tmin_p0, tmin_p1, tmin_p2 FROM u QUALIFY row_number() OVER (PARTITION BY jid ORDER BY coalesce(tmin_p0, tmin_p1, tmin_p2) NULLS LAST, release) = 1",
    "feat_observation": f"WITH {feature_base((0, 1, 2), ('cpuuser',))} SELECT jid, CAST(n_rows AS DOUBLE) AS obs_rows, CAST(top_hosts AS DOUBLE) AS obs_hosts, first_at AS obs_first_offset, last_at AS obs_last_offset, last_at - first_at AS obs_span, round(n_rows / top_hosts, 6) AS obs_rows_per_host, CAST(first_at > 60 AS DOUBLE) AS obs_delayed, CAST(last_at >= 1680 AS DOUBLE) AS obs_reached_end, " + ", ".join(f"CAST(coalesce(rows_{k}, 0) > 0 AS DOUBLE) AS obs_active_p{k}" for k in (0, 1, 2)) + " FROM f",
    "feat_resources": f"WITH {feature_base((0, 1, 2), ('cpuuser',))} SELECT jid, timelimit, nhosts, ncores, {r('ln(1 + timelimit)', 6, 'timelimit_log')}, {r('ln(1 + nhosts)', 6, 'nhosts_log')}, {r('ln(1 + ncores)', 6, 'ncores_log')}, {r('ncores / nhosts', 6, 'cores_per_host')}, {r('top_hosts / nhosts', 6, 'hosts_seen_ratio')}, nhosts - top_hosts AS hosts_missing FROM f",
    "feat_queue_time": f"WITH {feature_base((0, 1, 2), ('cpuuser',))} SELECT jid, start_epoch, CAST({WAIT} AS DOUBLE) AS queue_wait, {r(f'ln(1 + {WAIT})', 6, 'queue_wait_log')}, {r(f'{WAIT} / nullif(timelimit, 0)', 6, 'queue_wait_over_timelimit')}, CAST(hour({START}) AS DOUBLE) AS start_hour, CAST({DOW.format(START)} AS DOUBLE) AS start_dayofweek, CAST({DOW.format(START)} >= 5 AS DOUBLE) AS start_is_weekend, CAST(day({START}) AS DOUBLE) AS start_day, {r(f'sin(2 * pi() * hour({START}) / 24)', 6, 'start_hour_sin')}, {r(f'cos(2 * pi() * hour({START}) / 24)', 6, 'start_hour_cos')}, CAST(hour({SUBMIT}) AS DOUBLE) AS submit_hour, CAST({DOW.format(SUBMIT)} AS DOUBLE) AS submit_dayofweek FROM f",
    "feat_metric": f"WITH {feature_base((0, 1, 2), METRICS)} SELECT jid, {', '.join(metric_features(m, 9) for m in METRICS)} FROM f",
    "feat_trend": f"WITH {feature_base((0, 1, 2), METRICS)} SELECT jid, {', '.join(trend_features(m, 9) for m in METRICS)} FROM f",
    "feat_dispersion": f"WITH {feature_base((0, 1, 2), DISPERSED)} SELECT jid, " + ", ".join(f"round(hostdisp_{m}_std, 4) AS hostdisp_{m}_std, round(hostdisp_{m}_max - hostdisp_{m}_min, 4) AS hostdisp_{m}_range, round((hostdisp_{m}_max - hostdisp_{m}_min) / (abs({mean(m)}) + 1e-6), 4) AS hostdisp_{m}_rel, CAST(hostdisp_{m}_cnt AS DOUBLE) AS hostdisp_{m}_cnt" for m in DISPERSED) + " FROM f",
    "feat_cross": f"WITH {feature_base((0, 1, 2), ('cpuuser', 'memused', 'memused_minus_diskcache', 'nfs', 'block'))} SELECT jid, round({mean('memused')} / nullif(ncores / nhosts, 0), 9) AS mem_per_core, round({mean('memused')} - {mean('memused_minus_diskcache')}, 9) AS mem_diskcache_gap, round({mean('memused_minus_diskcache')} / nullif({mean('memused')}, 0), 9) AS mem_diskcache_ratio, round({mean('cpuuser')} / nullif(ncores / nhosts, 0), 9) AS cpu_per_core, round({mean('nfs')} / (abs({mean('block')}) + 1e-6), 9) AS io_ratio FROM f",
    "timelimit_buckets": f"WITH {LABELLED} SELECT timelimit_bucket, count(*) AS n FROM lab GROUP BY 1",
    "host_list_count": f"WITH {WIN}, {META} SELECT jid, CAST(len(string_split(trim(host_list, '{{}}'), ',')) AS DOUBLE) AS hosts FROM meta",
    "identifier_numbers": f"WITH {WIN}, {META} SELECT jid, CAST(regexp_extract(username, '[0-9]+') AS DOUBLE) AS user_number, CAST(NULL AS DOUBLE) AS account_number FROM meta",
    "target_label": f"WITH {LABELLED} SELECT cluster, CAST(sum(target) AS BIGINT) AS positives, count(*) AS n FROM lab GROUP BY 1",
    "window_15min": f"WITH {feature_base((0, 1), ('cpuuser',))} SELECT jid, CAST(cpuuser_n AS DOUBLE) AS cpuuser_cnt, {r(mean('cpuuser'), 5, 'cpuuser_mean')}, {r('cpuuser_tail - cpuuser_head', 5, 'cpuuser_trend')}, CAST(n_rows AS DOUBLE) AS obs_rows, CAST(coalesce(last_at >= 780, false) AS DOUBLE) AS obs_reached_end FROM f",
    "target_stats": f"WITH {LABELLED}, lk AS ({long_keys('lab', ', target', chr(39) + '|' + chr(39))}) SELECT key_name, key, CAST(sum(target) AS BIGINT) AS positives, count(*) AS n FROM lk GROUP BY ALL",
    "te_expanding": f"WITH {expanding()} SELECT jid, key_name, {r('te')}, {r('tc')} FROM te",
    "te_transform": f"WITH {LABELLED}, tr AS (SELECT * FROM lab WHERE month < '1998-01'), lk AS ({long_keys('tr', ', target')}), st AS (SELECT key_name, key, sum(target) AS p, count(*) AS c FROM lk GROUP BY ALL), nw AS (SELECT * FROM lab WHERE month >= '1998-01'), ln_ AS ({long_keys('nw', '')}) SELECT jid, key_name, round((coalesce(p, 0) + 25 * (SELECT avg(target) FROM tr)) / (coalesce(c, 0) + 25), 6) AS te, round(ln(1 + coalesce(c, 0)), 6) AS tc FROM ln_ LEFT JOIN st USING (key_name, key)",
    "label_codes": f"WITH {LABELLED}, {CODES} SELECT field, category, n, CAST(code AS INT) AS code FROM co",
    "composite_keys": f"WITH {LABELLED} SELECT username || '|' || CASE WHEN queue <> '5-LOW' THEN queue ELSE '__missing__' END AS key, count(*) AS n FROM lab GROUP BY 1",
    "encoded_matrix": f"WITH {expanding()}, {CODES}, tw AS (SELECT jid, " + ", ".join(f"round(max({v}) FILTER (WHERE key_name = '{k}'), 6) AS {v}_{k}" for k in KEYS for v in ("te", "tc")) + " FROM te GROUP BY jid) SELECT tw.*, " + ", ".join(f"CAST(c_{c}.code AS INT) AS cat_{c}" for c in CATEGORIES) + " FROM lab JOIN tw USING (jid) " + " ".join(f"JOIN co c_{c} ON c_{c}.field = '{c}' AND c_{c}.category = coalesce(lab.{c}, '__missing__')" for c in CATEGORIES),
    "unseen_rates": f"WITH {LABELLED} " + " UNION ALL ".join(f"SELECT '{c}' AS field, round(avg(CASE WHEN {c} IN (SELECT {c} FROM lab WHERE month < '1998-01') THEN 0 ELSE 1 END), 6) AS rate FROM lab WHERE month >= '1998-01'" for c in ("username", "jobname", "account")),
    "category_holdout": f"WITH {LABELLED}, c AS (SELECT username AS category, count(*) AS n FROM lab GROUP BY 1), t AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5(category || 'seed'), category ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT category, n FROM t WHERE before < 0.3 * (SELECT count(*) FROM lab)",
    "row_dropout": f"WITH {LABELLED} SELECT jid FROM lab WHERE substr(md5(jid || 'seed'), 1, 8) < '4ccccccc'",
    "blank_identities": f"WITH {expanding()}, w AS (SELECT jid, substr(md5(jid || 'seed'), 1, 8) < '4ccccccc' AS m, " + ", ".join(f"max({v}) FILTER (WHERE key_name = '{k}') AS {v}_{k}" for v, k in (("te", "username"), ("tc", "username"), ("te", "queue"), ("te", "username__queue"))) + " FROM te GROUP BY jid) SELECT jid, round(CASE WHEN m THEN (SELECT avg(target) FROM lab) ELSE te_username END, 6) AS te_username, round(CASE WHEN m THEN 0 ELSE tc_username END, 6) AS tc_username, round(te_queue, 6) AS te_queue, round(CASE WHEN m THEN (SELECT avg(target) FROM lab) ELSE te_username__queue END, 6) AS te_username__queue FROM w",
    "range_guard": f"WITH {feature_base((0, 1, 2), ('cpuuser',))}, x AS (SELECT month, {', '.join(f'CAST({v} AS DOUBLE) AS v_{c}' for c, v in GUARD)} FROM f), o AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER (WHERE v_{c} < (SELECT min(v_{c}) FROM x WHERE month < '1998-01') OR v_{c} > (SELECT max(v_{c}) FROM x WHERE month < '1998-01')) / nullif(count(v_{c}), 0) AS outside FROM x WHERE month >= '1998-01'" for c, _ in GUARD) + " UNION ALL SELECT 'gpu_mean', NULL) SELECT name, round(outside, 6) AS outside, NOT coalesce(outside > 0.2, false) AS kept FROM o",
    "constant_columns": f"WITH {feature_base((0, 1, 2), ('cpuuser',))}, o AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, count({v}) AS n, CAST(min({v}) AS DOUBLE) AS low, CAST(max({v}) AS DOUBLE) AS high, count(*) AS total FROM f" for c, v in CONST) + " UNION ALL SELECT 'gpu_mean', 0, NULL, NULL, count(*) FROM f UNION ALL SELECT 'gpu_cnt', count(*), 0.0, 0.0, count(*) FROM f) SELECT name, n, round(low, 6) AS low, round(high, 6) AS high, coalesce(n > 0 AND (n < total OR low <> high), false) AS kept FROM o",
    "lifespan_agg": f"WITH {TEL} SELECT jid, {SPAN}, arg_min(start_epoch, {BY_TIME}) AS start_epoch, arg_min(timelimit, {BY_TIME}) AS timelimit FROM tel GROUP BY jid",
    "lifespan_merge": f"WITH {TEL}, s AS (SELECT jid, line % 2 AS k, {SPAN}, min(timelimit) AS timelimit FROM tel GROUP BY ALL) SELECT jid, min(life_first) AS life_first, max(life_last) AS life_last, CAST(sum(life_rows) AS BIGINT) AS life_rows, max(life_hosts) AS life_hosts, min(timelimit) AS timelimit FROM s GROUP BY jid",
    "lifespan_features": f"WITH {TEL}, s AS (SELECT jid, {SPAN}, min(start_epoch) AS start_epoch, min(timelimit) AS lim FROM tel GROUP BY jid), u AS (SELECT *, greatest(life_last - start_epoch, 0) AS run FROM s) SELECT jid, CAST(run AS DOUBLE) AS life_runtime, {r('ln(1 + run)', 6, 'life_runtime_log')}, {r('run / nullif(lim, 0)', 6, 'life_runtime_over_limit')}, {r('abs(1 - run / nullif(lim, 0))', 6, 'life_limit_shortfall')}, lim - run AS life_remaining_seconds, greatest(life_last - life_first, 0) AS life_span, CAST(life_rows AS DOUBLE) AS life_rows, CAST(life_hosts AS DOUBLE) AS life_hosts, {r('life_rows / life_hosts', 6, 'life_rows_per_host')}, CAST(life_last >= 11500 - 3600 AS INT) AS life_right_censored FROM u",
    "recency_cap": f"WITH {LABELLED} SELECT jid, start_epoch FROM lab ORDER BY start_epoch DESC, jid LIMIT 500",
    "recency_biased_sample": f"WITH {LABELLED}, nw AS (SELECT jid FROM lab ORDER BY start_epoch DESC, jid LIMIT 200), ol AS (SELECT jid FROM lab WHERE jid NOT IN (SELECT jid FROM nw) ORDER BY md5(jid || 'seed'), jid LIMIT 200) SELECT jid, 1 AS newest FROM nw UNION ALL SELECT jid, 0 FROM ol",
    "holdout_subsample": f"WITH {LABELLED} SELECT jid FROM lab ORDER BY md5(jid || 'seed'), jid LIMIT 300",
    "out_of_time_split": f"WITH {LABELLED}, m AS (SELECT month, dense_rank() OVER (ORDER BY month DESC) <= 3 AS is_holdout FROM lab) SELECT month, is_holdout, count(*) AS n FROM m GROUP BY ALL",
    "rank_ordinal": f"WITH {SCORED} SELECT jid, cluster, round((row_number() OVER (PARTITION BY cluster ORDER BY score_a, jid) - 1) / greatest(count(*) OVER (PARTITION BY cluster) - 1, 1), 6) AS rank FROM sc",
    "rank_blend": f"WITH {SCORED}, k AS (SELECT cluster, jid, (score_a + score_b) / 2 AS mean, ((row_number() OVER (PARTITION BY cluster ORDER BY score_a, jid) - 1) + (row_number() OVER (PARTITION BY cluster ORDER BY score_b, jid) - 1)) / 2 AS pos FROM sc), s AS (SELECT cluster, mean, row_number() OVER (PARTITION BY cluster ORDER BY mean, jid) - 1 AS i FROM k) SELECT k.cluster, k.jid, round(lo.mean + (hi.mean - lo.mean) * (pos - floor(pos)), 6) AS blend FROM k JOIN s lo ON lo.cluster = k.cluster AND lo.i = floor(pos) JOIN s hi ON hi.cluster = k.cluster AND hi.i = ceil(pos)",
    "average_precision": f"WITH {AP} SELECT cluster, {r('ap')} FROM ap",
    "macro_ap": f"WITH {AP} SELECT {r('avg(ap)', 6, 'macro_ap')} FROM ap",
    "class_weight": f"WITH {SCORED} SELECT cluster, round(least(greatest(sqrt((count(*) - sum(target)) / nullif(sum(target), 0)), 1), 6), 6) AS weight FROM sc GROUP BY cluster",
    "submission_join": f"WITH {ANSWERS} SELECT position, row_id, {r('failure_probability')} FROM an",
    "row_ids": f"WITH {SCORED}, n AS (SELECT list_extract(['S', 'C', 'Anvil', 'X'], CAST(substr(jid, 4) AS BIGINT) % 4 + 1) AS c, jid FROM sc), k AS (SELECT CASE WHEN c <> 'X' THEN c END AS cluster, CASE WHEN c <> 'X' THEN jid END AS jid FROM n) SELECT cluster, count(*) AS n, min(jid) AS first, count(DISTINCT jid) AS jobs FROM k GROUP BY cluster",
    "contract_checks": f"WITH {ANSWERS} SELECT count(*) FILTER (WHERE failure_probability IS NULL) AS missing, count(*) FILTER (WHERE failure_probability < 0 OR failure_probability > 1) AS outside, count(*) - count(DISTINCT row_id) AS repeated FROM an",
    "identity_value_counts": f"WITH {LABELLED} SELECT username, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, username) AS place FROM lab GROUP BY username ORDER BY n DESC, username LIMIT 25",
}
