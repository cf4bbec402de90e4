"""Registry of the engine's queries; each is an operator over the order tables read as telemetry."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.functions.scalar import composite, epoch, host_count, identifier_number, is_positive, number, timelimit_bucket
from emberline.operators import accumulate as A
from emberline.operators import drift as D
from emberline.operators import encoding as E
from emberline.operators import features as X
from emberline.operators import lifespan as L
from emberline.operators import models
from emberline.operators import selection as S
from emberline.oracles import ORACLE_SQL
from emberline.schema import CATEGORIES, DISPERSED, METRICS, PARTS, POSITIVE
from emberline.scratch import materialise, new_path
from emberline.sources.telemetry import cluster_of, read_raw, rename_parts, split_row_id, telemetry_from_orders

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CUT = "1998-01"  # jobs that started before it are learned from, the others scored


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to ``places`` decimals, so that the order of a sum does not show."""
    return df.selectExpr(*[f"round(`{c}`, {places}) AS `{c}`" if t == "double" else f"`{c}`" for c, t in df.dtypes])


def tel(spark: SparkSession, d: str) -> DataFrame:
    return telemetry_from_orders(spark, d)


def window(spark: SparkSession, d: str) -> DataFrame:
    return A.window_rows(tel(spark, d), all_started=True)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """One row per job of the window: its description, bucket of time limit, month and target."""
    rows = A.job_meta(window(spark, d))
    return rows.select("jid", "cluster", "account", "queue", "unit", "username", "jobname", "start_epoch", "month", timelimit_bucket(F.col("timelimit")).alias("timelimit_bucket"), is_positive(F.col("exitcode"), POSITIVE).alias("target"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Mean, spread and trend of each job's main metric in its early window."""
    rows = window(spark, d)
    wide = A.widen(A.part_stats(rows, metrics=("cpuuser",)).join(A.part_shape(rows), ["jid", "part"]))
    made = X.metric("cpuuser", X.window_parts(1800.0))
    return rounded(wide.selectExpr("jid", *[X._clean(made[f"cpuuser_{s}"], f"cpuuser_{s}") for s in ("cnt", "mean", "std", "trend")]))


# -- readings ------------------------------------------------------------------------------


@query
def prepare_telemetry(spark, d):
    rows = tel(spark, d).withColumn("cpuuser", number(F.col("cpuuser").cast("string")))
    return rounded(rows.filter("jid IS NOT NULL AND time_epoch IS NOT NULL").select("cluster", "jid", "host", "time_epoch", "start_epoch", "submit_epoch", "timelimit", "nhosts", "ncores", "account", "queue", "unit", "jobname", "username", "host_list", "exitcode", *METRICS, "month", "line", "part_key"), 9)


@query
def cluster_route(spark, d):
    suffix = F.when(F.col("cluster") == "AFRICA", "_S").when(F.col("cluster") == "AMERICA", "_C").otherwise("")
    name = F.concat("month", F.lit("-01-00"), suffix, F.lit(".parquet"))
    return tel(spark, d).groupBy(cluster_of(name).alias("routed")).agg(F.count("*").alias("n"))


@query
def month_prune(spark, d):
    return A.month_prune(tel(spark, d), "1996-03", "1997-02").groupBy("month").agg(F.count("*").alias("n"))


@query
def hour_enumerate(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return A.window_hours(events, "ts").select(F.date_format("hour", "yyyy-MM-dd-HH").alias("hour"), "n_windows")


@query
def dedup_most_complete(spark, d):
    rows = tel(spark, d)
    poorer = rows.withColumns({"memused": F.lit(None).cast("double"), "line": F.lit(-1)})
    return rounded(A.most_complete(rows.unionByName(poorer)).groupBy("jid").agg(F.count("*").alias("n"), F.count("memused").alias("n_mem"), F.sum("memused").alias("mem")))


@query
def epoch_coerce(spark, d):
    text = F.when(F.col("l_linenumber") % 3 == 0, "no date").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_linenumber", epoch(text).alias("e"), number(F.when(F.col("l_linenumber") % 2 == 0, "x").otherwise(F.col("l_quantity").cast("string"))).alias("q"))
    return rows.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("e").alias("n_times"), F.max("e").alias("latest"), F.count("q").alias("n_numbers"), F.sum("q").alias("total"))


# -- anchors and buckets -------------------------------------------------------------------


@query
def anchor_clamped(spark, d):
    rows = A.with_anchor(tel(spark, d), 9496.0).groupBy("jid").agg(F.min("anchor").alias("anchor"), F.max("anchor").alias("anchor_max"), F.min("start_epoch").alias("start_epoch"))
    return rows


@query
def anchor_missing_start(spark, d):
    rows = tel(spark, d).withColumn("start_epoch", F.when(F.pmod(F.substring("jid", 4, 20).cast("long"), F.lit(7)) != 0, F.col("start_epoch")))
    return A.with_anchor(rows).groupBy("jid").agg(F.min("anchor").alias("anchor"), F.count("start_epoch").alias("n_started"))


@query
def early_window(spark, d):
    return A.early_window(A.with_anchor(tel(spark, d), all_started=True)).select("jid", "host", "line", "part_key", "elapsed")


@query
def bucket_assign(spark, d):
    rows = A.with_anchor(tel(spark, d), all_started=True).withColumn("elapsed", F.col("time_epoch") - F.col("anchor"))
    return rows.groupBy(A.bucket(F.col("elapsed")).alias("part")).agg(F.count("*").alias("n"), F.min("elapsed").alias("tmin"), F.max("elapsed").alias("tmax"))


# -- accumulators --------------------------------------------------------------------------


@query
def acc_sum_stats(spark, d):
    stats = A.part_stats(window(spark, d), ("cnt", "sum", "sq", "zero"))
    return rounded(stats)


@query
def acc_min_max(spark, d):
    return rounded(A.part_stats(window(spark, d), ("min", "max")))


@query
def acc_first_last(spark, d):
    return rounded(A.part_stats(window(spark, d), ("first", "last")))


@query
def acc_rows_hosts(spark, d):
    return A.part_shape(window(spark, d))


@query
def host_dispersion(spark, d):
    return rounded(A.host_dispersion(window(spark, d)), 4)


@query
def job_meta_first(spark, d):
    return A.job_meta(window(spark, d))


@query
def merge_partials(spark, d):
    rows = window(spark, d)
    halves = [A.part_stats(h).join(A.part_shape(h).drop("hosts"), ["jid", "part"]) for h in (rows.filter("elapsed < 100"), rows.filter("elapsed >= 100"))]
    merged = A.merge_parts(*halves)
    return rounded(merged, 4)


@query
def job_accumulators(spark, d):
    acc = A.accumulators(window(spark, d))
    return rounded(acc.withColumns({f"hostdisp_{m}_std": F.round(f"hostdisp_{m}_std", 4) for m in DISPERSED}), 9)


def raw_files(spark, d):
    """Hourly raw files made of the order lines, and their place: one release for each of three clusters.

    The files differ in the type of a column, some readings have no start, and some are there twice, once less complete.
    """
    rows = tel(spark, d).withColumn("key", F.substring("jid", 4, 20).cast("long"))
    at = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss")
    raw = rows.select(
        at("time_epoch").alias("time"), at("submit_epoch").alias("submit_time"), F.when(F.col("key") % 7 != 0, at("start_epoch")).alias("start_time"),
        "jid", "host", F.col("timelimit").cast("string").alias("timelimit"), "nhosts", "ncores", "account", "queue", "unit", "jobname", "username", "host_list",
        *[F.col(m).alias(f"value_{m}") for m in METRICS], "exitcode", "line", "part_key", "key",
    )
    release = F.col("key") % 3
    poorer = raw.withColumns({f"value_{m}": F.lit(None).cast("double") for m in METRICS[1:]})
    path = new_path(spark, "raw")
    for k, suffix in enumerate(("_S", "_C", "")):
        mine = raw.filter(release == k)
        mine = mine.unionByName(poorer.filter((release == k) & (F.col("line") % 2 == 0)))
        mine = mine.withColumn("value_nfs", F.col("value_nfs").cast("string")) if k == 1 else mine.drop("value_gpu") if k == 2 else mine
        target = f"{path}/{k}"
        kept = mine.repartition(4, "jid").sortWithinPartitions("jid", "host", "time", "line", "part_key")
        kept.drop("key", "line", "part_key").write.parquet(target)
        rename_parts(spark, target, lambda n, k=k, suffix=suffix: f"1970-01-01-{2 + (k == 1) + n:02d}{suffix}.parquet")
    return path


@query
def raw_file_accumulators(spark, d):
    """Accumulators of the readings in raw files, with what anchors, clamping and tolerant reading make of them."""
    acc = A.accumulators(A.window_rows(read_raw(spark, raw_files(spark, d))))
    names = [c for m in ("cpuuser", "nfs", "gpu") for p in PARTS for c in (f"{m}_{p}_cnt", f"{m}_{p}_sum", f"{m}_{p}_min", f"{m}_{p}_max")]
    return rounded(acc.select("jid", "cluster", "timelimit", "exitcode", *[f"{c}_{p}" for p in PARTS for c in ("rows", "hosts", "tmin", "tmax")], *names), 9)


# -- coverage ------------------------------------------------------------------------------


def wanted(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("JOB"), F.col("o_orderkey").cast("string")).alias("jid"))


@query
def uncovered_jobs(spark, d):
    return A.uncovered(wanted(spark, d), window(spark, d))


@query
def first_seen(spark, d):
    return A.first_seen(tel(spark, d), A.uncovered(wanted(spark, d), window(spark, d)))


def _fallback(spark, d):
    seen = A.first_seen(tel(spark, d), A.uncovered(wanted(spark, d), window(spark, d)))
    return A.fallback_rows(tel(spark, d), seen)


@query
def fallback_accumulators(spark, d):
    return rounded(A.part_stats(_fallback(spark, d), ("cnt", "sum"), ("cpuuser", "memused")), 4)


@query
def strict_over_fallback(spark, d):
    shape = lambda rows: rows.groupBy("jid").agg(F.count("*").alias("rows"))
    strict, everything = shape(window(spark, d)), shape(tel(spark, d))
    return A.prefer_strict(strict, everything)


@query
def least_delayed_release(spark, d):
    rows = window(spark, d)
    releases = [A.widen(A.part_shape(rows.filter(f"line % 2 = {k}"))) for k in (1, 0)]
    return A.least_delayed(releases).select("jid", "release", "rows_p0", "rows_p1", "rows_p2", "tmin_p0", "tmin_p1", "tmin_p2")


# -- features ------------------------------------------------------------------------------


def matrix_of(spark, d, seconds=1800.0):
    return X.matrix(A.accumulators(window(spark, d)), seconds)


def columns_of(spark, d, prefixes, places=6, seconds=1800.0):
    m = matrix_of(spark, d, seconds)
    return rounded(m.select("jid", *[c for c in m.columns if any(c == p or (p.endswith("_") and c.startswith(p)) for p in prefixes)]), places)


@query
def feat_observation(spark, d):
    return columns_of(spark, d, ("obs_",))


@query
def feat_resources(spark, d):
    return columns_of(spark, d, ("timelimit", "nhosts", "ncores", "timelimit_log", "nhosts_log", "ncores_log", "cores_per_host", "hosts_seen_ratio", "hosts_missing"))


@query
def feat_queue_time(spark, d):
    return columns_of(spark, d, ("queue_wait", "queue_wait_log", "queue_wait_over_timelimit", "start_", "submit_"))


@query
def feat_metric(spark, d):
    return columns_of(spark, d, tuple(f"{m}_{s}" for m in METRICS for s in ("cnt", "mean", "std", "cv", "min", "max", "range", "first", "last", "delta", "zero_frac", "coverage")), 9)


@query
def feat_trend(spark, d):
    return columns_of(spark, d, tuple(f"{m}_{s}" for m in METRICS for s in ("head_mean", "tail_mean", "trend", "trend_ratio")), 9)


@query
def feat_dispersion(spark, d):
    return columns_of(spark, d, tuple(f"hostdisp_{m}_{s}" for m in DISPERSED for s in ("std", "range", "rel", "cnt")), 4)


@query
def feat_cross(spark, d):
    return columns_of(spark, d, ("mem_per_core", "mem_diskcache_gap", "mem_diskcache_ratio", "cpu_per_core", "io_ratio"), 9)


@query
def timelimit_buckets(spark, d):
    return A.job_meta(window(spark, d)).groupBy(timelimit_bucket(F.col("timelimit")).alias("timelimit_bucket")).agg(F.count("*").alias("n"))


@query
def host_list_count(spark, d):
    return A.job_meta(window(spark, d)).select("jid", host_count(F.col("host_list")).alias("hosts"))


@query
def identifier_numbers(spark, d):
    return A.job_meta(window(spark, d)).select("jid", identifier_number(F.col("username")).alias("user_number"), identifier_number(F.col("account")).alias("account_number"))


@query
def target_label(spark, d):
    return labelled(spark, d).groupBy("cluster").agg(F.sum("target").alias("positives"), F.count("*").alias("n"))


@query
def window_15min(spark, d):
    return columns_of(spark, d, ("cpuuser_cnt", "cpuuser_mean", "cpuuser_trend", "obs_rows", "obs_reached_end"), 5, 900.0)


# -- encodings -----------------------------------------------------------------------------


@query
def target_stats(spark, d):
    rows = E.target_stats(labelled(spark, d))
    return rows.select("key_name", F.replace(F.col("key"), F.lit("\x1f"), F.lit("|")).alias("key"), "positives", "n")


@query
def te_expanding(spark, d):
    return rounded(E.te_expanding(labelled(spark, d)))


@query
def te_transform(spark, d):
    rows = labelled(spark, d)
    return rounded(E.te_transform(rows.filter(F.col("month") >= CUT), rows.filter(F.col("month") < CUT)))


@query
def label_codes(spark, d):
    return E.label_codes(labelled(spark, d))


@query
def composite_keys(spark, d):
    keys = labelled(spark, d).select(composite(F.col("username"), F.when(F.col("queue") != "5-LOW", F.col("queue"))).alias("k"))
    return keys.groupBy(F.replace(F.col("k"), F.lit("\x1f"), F.lit("|")).alias("key")).agg(F.count("*").alias("n"))


@query
def encoded_matrix(spark, d):
    rows = labelled(spark, d)
    return rounded(E.with_codes(rows, E.label_codes(rows)).select("jid", *[f"cat_{c}" for c in CATEGORIES]).join(E.wide(E.te_expanding(rows)), "jid"))


# -- drift ---------------------------------------------------------------------------------


@query
def unseen_rates(spark, d):
    rows = labelled(spark, d)
    return rounded(D.unseen_rates(rows.filter(F.col("month") < CUT), rows.filter(F.col("month") >= CUT)))


@query
def category_holdout(spark, d):
    return D.category_holdout(labelled(spark, d), "username", 0.3, "seed")


@query
def row_dropout(spark, d):
    return labelled(spark, d).filter(D.row_mask(F.col("jid"), 0.3, "seed")).select("jid")


@query
def blank_identities(spark, d):
    rows = labelled(spark, d)
    encoded = E.wide(E.te_expanding(rows)).select("jid", "te_username", "tc_username", "te_queue", "te_username__queue")
    p = E.prior(rows)
    return rounded(D.blank_identities(encoded, D.row_mask(F.col("jid"), 0.3, "seed"), ("username",), p))


@query
def range_guard(spark, d):
    m = matrix_of(spark, d)
    return rounded(X.range_guard(m.filter(F.col("month") < CUT), m.filter(F.col("month") >= CUT), ["start_epoch", "timelimit", "cpuuser_mean", "obs_rows", "gpu_mean"]))


@query
def constant_columns(spark, d):
    return rounded(X.constant_columns(matrix_of(spark, d), ["gpu_mean", "obs_rows", "cpuuser_max", "obs_hosts", "gpu_cnt"]))


# -- whole life (opt-in) -------------------------------------------------------------------


@query
def lifespan_agg(spark, d):
    return L.lifespan_agg(tel(spark, d).withColumn("elapsed", F.col("time_epoch")))


@query
def lifespan_merge(spark, d):
    rows = tel(spark, d)
    spans = [L.lifespan_agg(rows.filter(f"line % 2 = {k}")) for k in (0, 1)]
    return L.lifespan_merge(spans[0].unionByName(spans[1])).select("jid", "life_first", "life_last", "life_rows", "life_hosts", "timelimit")


@query
def lifespan_features(spark, d):
    rows = tel(spark, d)
    jobs = rows.select("jid", "cluster").distinct()
    return rounded(L.lifespan_features(jobs, L.lifespan_agg(rows).withColumn("chunk_end_epoch", F.lit(11500.0))))


# -- selection and scoring -----------------------------------------------------------------


@query
def recency_cap(spark, d):
    return S.recency_cap(labelled(spark, d), 500).select("jid", "start_epoch")


@query
def recency_biased_sample(spark, d):
    return S.recency_biased(labelled(spark, d), 400, "seed").select("jid", "newest")


@query
def holdout_subsample(spark, d):
    return S.subsample(labelled(spark, d), 300, "seed").select("jid")


@query
def out_of_time_split(spark, d):
    return S.out_of_time_split(labelled(spark, d), 3).groupBy("month", "is_holdout").agg(F.count("*").alias("n"))


def scored(spark, d):
    """Jobs with two stand-in model scores, drawn from order and customer columns."""
    rows = spark.read.parquet(f"{d}/orders.parquet")
    return rows.select(
        F.concat(F.lit("JOB"), F.col("o_orderkey").cast("string")).alias("jid"),
        F.col("o_orderpriority").alias("cluster"),
        F.round(F.col("o_totalprice") / 600000, 3).alias("score_a"),
        F.round((F.col("o_custkey") % 997) / 997, 3).alias("score_b"),
        (F.col("o_orderstatus") == "F").cast("int").alias("target"),
    )


@query
def rank_ordinal(spark, d):
    return rounded(S.rank_ordinal(scored(spark, d), "score_a").select("jid", "cluster", "rank"))


@query
def rank_blend(spark, d):
    return rounded(S.rank_blend(scored(spark, d), ["score_a", "score_b"]).select("cluster", "jid", "blend"))


@query
def average_precision(spark, d):
    return rounded(S.average_precision(scored(spark, d), "score_a"))


@query
def macro_ap(spark, d):
    return rounded(S.macro_ap(S.average_precision(scored(spark, d), "score_a")))


@query
def class_weight(spark, d):
    return rounded(S.class_weight(scored(spark, d)))


def _answers(spark, d):
    scores = scored(spark, d)
    sample = scores.select((F.substring("jid", 4, 20).cast("long") * 3).alias("position"), F.concat("cluster", F.lit("_"), "jid").alias("row_id"))
    return S.submission(sample, scores.select(F.concat("cluster", F.lit("_"), "jid").alias("row_id"), (F.col("score_a") * 2 - F.lit(0.2)).alias("score")).filter("score < 1.4"))


@query
def submission_join(spark, d):
    return rounded(_answers(spark, d))


@query
def contract_checks(spark, d):
    return S.contract_checks(_answers(spark, d))


@query
def row_ids(spark, d):
    """Row ids split into cluster and job, and those of no known cluster counted."""
    names = scored(spark, d).select(F.concat(F.element_at(F.array(F.lit("S"), F.lit("C"), F.lit("Anvil"), F.lit("X")), (F.substring("jid", 4, 20).cast("long") % 4 + 1).cast("int")), F.lit("_"), "jid").alias("row_id"))
    of, jid = split_row_id(F.col("row_id"))
    return names.select(of.alias("cluster"), jid.alias("jid")).groupBy("cluster").agg(F.count("*").alias("n"), F.min("jid").alias("first"), F.count_distinct("jid").alias("jobs"))


@query
def gbt_fit_predict(spark, d):
    """Trees fitted on the early months of each cluster's jobs and scored on its late ones."""
    features = ["obs_rows", "timelimit", "cpuuser_mean", "cpuuser_std", "memused_mean", "queue_wait", "gpu_mean"]
    rows = materialise(matrix_of(spark, d).select("jid", "cluster", "month", "target", *features), "matrix")

    def of_cluster(cluster: str) -> DataFrame:
        m = rows.filter(F.col("cluster") == cluster)
        train, fills = models.design(m.filter(F.col("month") < "1999-01"), features)
        late, _ = models.design(m.filter(F.col("month") >= "1999-01"), features, fills)
        return models.score(models.fit(materialise(train.select("features", "target"), "train"), 2.0), late).select("jid", "target", "score")

    clusters = sorted(r.cluster for r in rows.filter("cluster IS NOT NULL").select("cluster").distinct().collect())
    with ThreadPoolExecutor(max(1, len(clusters))) as pool:
        return reduce(DataFrame.unionByName, pool.map(of_cluster, clusters))


@query
def identity_value_counts(spark, d):
    rows = labelled(spark, d)
    top = W.orderBy(F.col("n").desc(), "username")
    return rows.groupBy("username").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "username").limit(25).withColumn("place", F.row_number().over(top))
