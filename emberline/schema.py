"""Columns and constants of the telemetry model."""

# The telemetry layout, windows, outcome names and limits that results depend on. The names of
# stored columns (``<metric>_<part>_<stat>``, ``hostdisp_*``, ``life_*``, ``start_dayofweek`` ...) are fixed too.
METRICS = ("cpuuser", "gpu", "memused", "memused_minus_diskcache", "nfs", "block")
NUMERIC = ("timelimit", "nhosts", "ncores")
STRINGS = ("account", "queue", "unit", "jobname", "username", "host_list")
TIMES = ("time", "submit_time", "start_time")
RAW = (*TIMES, "jid", "host", *NUMERIC, *STRINGS, *[f"value_{m}" for m in METRICS], "exitcode")
BEFORE_START, WINDOW = 300.0, 1800.0
PARTS = {"p0": (-BEFORE_START, 300.0), "p1": (300.0, 900.0), "p2": (900.0, WINDOW)}
STATS = ("cnt", "sum", "sq", "zero", "min", "max", "first", "last")
DISPERSED = ("cpuuser", "memused")
POSITIVE = ("FAILED", "TIMEOUT", "NODE_FAIL")
CATEGORIES = ("account", "queue", "unit", "username", "jobname")
KEYS = {
    "username": ("username",),
    "account": ("account",),
    "queue": ("queue",),
    "jobname": ("jobname",),
    "username__queue": ("username", "queue"),
    "account__queue": ("account", "queue"),
    "queue__timelimit_bucket": ("queue", "timelimit_bucket"),
}
MISSING = "__missing__"
SMOOTHING, LEAST_FREQUENCY, TINY = 25.0, 5, 1e-6
RANGE_SHARE, PREDICTOR_MARGIN = 0.20, 0.01
EDGE_SECONDS = 3600.0
CLUSTERS = ("S", "C", "Anvil")
MINUTES_UNIT_CLUSTERS = ("S", "C")
TRAINING_FROM = {"S": "2016-01", "C": "2015-10", "Anvil": "2022-07"}
MOST_ROWS, MOST_HOLDOUT_ROWS = 420_000, 120_000
ORDER = ("elapsed", "host", "line", "part_key")  # total order of a job's readings
