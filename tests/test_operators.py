"""Invariants and edge rows of the telemetry operators."""

import math
import random

import pytest
from pyspark.sql import functions as F

from emberline.functions.scalar import composite, epoch, host_count, identifier_number, is_positive, log1p_floor, number, ratio, timelimit_bucket
from emberline.operators import accumulate as A
from emberline.operators import drift as D
from emberline.operators import encoding as E
from emberline.operators import features as X
from emberline.operators import lifespan as L
from emberline.operators import models
from emberline.operators import selection as S
from emberline.plans import stages
from emberline.schema import METRICS, POSITIVE
from emberline.sources import telemetry as T
from emberline.plans import training
from emberline.streaming.incremental import AccumulatorState, accumulate_stream, windowed_counts

READING = "cluster string, jid string, host string, time_epoch double, start_epoch double, submit_epoch double, timelimit double, nhosts double, ncores double, account string, queue string, unit string, jobname string, username string, host_list string, exitcode string, cpuuser double, gpu double, memused double, memused_minus_diskcache double, nfs double, block double, month string, line int, part_key long"


def reading(jid="J1", host="h", at=0.0, start=0.0, cpu=1.0, mem=2.0, line=0, **more):
    row = dict(cluster="S", jid=jid, host=host, time_epoch=at, start_epoch=start, submit_epoch=-10.0, timelimit=60.0, nhosts=2.0, ncores=8.0, account="a", queue="q", unit="u", jobname="n", username="USER7", host_list="{h,i}", exitcode="FAILED", cpuuser=cpu, gpu=None, memused=mem, memused_minus_diskcache=mem, nfs=0.0, block=None, month="1970-01", line=line, part_key=0)
    row.update(more)
    return tuple(row[c.split()[0]] for c in READING.split(", "))


def readings(spark, *rows):
    return spark.createDataFrame(list(rows), READING)


def test_window_bounds_and_buckets(spark):
    at = [-301, -300, 299.999, 300, 900, 1800, 1800.001]
    rows = A.window_rows(readings(spark, *[reading(at=float(t), line=k) for k, t in enumerate(at)])).orderBy("elapsed").collect()
    assert [(r.elapsed, r.part) for r in rows] == [(-300, 0), (299.999, 0), (300, 1), (900, 2), (1800, 2)]
    assert [r.b for r in spark.createDataFrame([(-301.0,), (1800.5,)], "e double").select(A.bucket(F.col("e")).alias("b")).collect()] == [-1, -1]


def test_dedup_keeps_the_most_complete_reading(spark):
    rows = readings(spark, reading(cpu=1.0, mem=None, line=0), reading(cpu=2.0, line=2), reading(cpu=3.0, line=1), reading(host=None, at=5.0), reading(host=None, at=5.0, line=1))
    kept = A.most_complete(rows).orderBy("time_epoch").collect()
    assert [(r.cpuuser, r.line) for r in kept] == [(3.0, 1), (1.0, 0)]


def test_anchor(spark):
    rows = readings(spark, reading("A", start=100.0, at=5.0), reading("B", start=None, at=9.0), reading("B", start=None, at=7.0), reading("C", start=900.0))
    assert {r.jid: r.anchor for r in A.with_anchor(rows, 500.0).collect()} == {"A": 500.0, "B": 7.0, "C": 900.0}


def test_accumulators_of_nulls(spark):
    rows = readings(spark, reading(cpu=None, mem=None, at=1.0), reading(host=None, cpu=4.0, at=2.0), reading("K", at=400.0, cpu=0.0))
    acc = {r.jid: r for r in A.accumulators(A.window_rows(rows)).collect()}
    j = acc["J1"]
    assert (j.cpuuser_p0_cnt, j.cpuuser_p0_sum, j.cpuuser_p0_first, j.rows_p0, j.hosts_p0, j.rows_p1) == (1, 4.0, 4.0, 2, 1, 0)
    assert j.gpu_p0_cnt == 0 and j.gpu_p0_sum == 0 and j.gpu_p0_min is None
    assert j.hostdisp_cpuuser_cnt == 0 and j.hostdisp_memused_std is None
    assert acc["K"].cpuuser_p1_zero == 1 and acc["K"].tmin_p1 == 400.0


def test_accumulators_equal_their_parts(spark):
    """One pass gives what the part tables, dispersion and description give by themselves."""
    draw = random.Random(3)
    many = [reading(f"J{draw.randrange(6)}", draw.choice([None, "h0", "h1", "h2"]), float(draw.randrange(-300, 1801)), cpu=draw.choice([None, 0.0, float(draw.randrange(9))]), line=k, queue=draw.choice([None, "a", "b"])) for k in range(300)]
    rows = A.window_rows(readings(spark, *many)).cache()
    want = A.widen(A.part_stats(rows).join(A.part_shape(rows), ["jid", "part"])).join(A.job_meta(rows), "jid").join(A.host_dispersion(rows), "jid", "left")
    got = A.accumulators(rows)
    assert set(got.columns) == set(want.columns)
    plain = lambda r: [round(v, 6) if isinstance(v, float) else v for v in r]
    names = sorted(want.columns)
    assert sorted(map(repr, map(plain, got.select(names).collect()))) == sorted(map(repr, map(plain, want.select(names).collect())))


def test_window_of_jobs_without_a_start_and_before_the_chunk(spark):
    rows = readings(spark, reading("A", at=100.0, start=None), reading("A", at=5000.0, start=None), reading("B", at=1000.0, start=0.0), reading("B", at=9000.0, start=0.0), reading("C", at=700.0, start=600.0), reading("C", at=50.0, start=None))
    got = {(r.jid, r.time_epoch): r.elapsed for r in A.window_rows(rows, 800.0).collect()}
    assert got == {("A", 100.0): 0.0, ("B", 1000.0): 200.0, ("C", 700.0): -100.0, ("C", 50.0): 0.0}
    started = A.window_rows(rows.filter("start_epoch IS NOT NULL"), 800.0, all_started=True)
    assert {(r.jid, r.elapsed) for r in started.collect()} == {("B", 200.0), ("C", -100.0)}


def test_split_and_merge_equals_one_pass(spark):
    draw = random.Random(1)
    many = [reading(f"J{draw.randrange(6)}", f"h{draw.randrange(3)}", float(draw.randrange(-300, 1801)), cpu=draw.choice([None, 0.0, float(draw.randrange(9))]), line=k) for k in range(300)]
    rows = A.window_rows(readings(spark, *many)).cache()
    side = lambda df: A.part_stats(df).join(A.part_shape(df).drop("hosts"), ["jid", "part"])
    whole, merged = side(rows), A.merge_parts(side(rows.filter("elapsed < 200")), side(rows.filter("elapsed >= 200")))
    names = ["jid", "part", "rows", "tmin", "tmax", *[f"{m}_{s}" for m in METRICS for s in ("cnt", "sum", "sq", "zero", "min", "max", "first", "last")]]
    assert sorted(map(repr, whole.select(names).collect())) == sorted(map(repr, merged.select(names).collect()))


def test_releases_and_coverage(spark):
    part = "jid string, tmin_p0 double, tmin_p1 double, tmin_p2 double"
    one = spark.createDataFrame([("A", None, 450.0, None), ("B", -30.0, None, None), ("C", None, None, None)], part)
    two = spark.createDataFrame([("A", 100.0, None, None), ("B", -30.0, None, None)], part)
    assert {r.jid: r.release for r in A.least_delayed([one, two]).collect()} == {"A": 1, "B": 0, "C": 0}
    jobs = spark.createDataFrame([("A",), ("B",), ("Z",)], "jid string")
    assert [r.jid for r in A.uncovered(jobs, one).collect()] == ["Z"]
    assert {r.jid: r.source_rank for r in A.prefer_strict(one.select("jid"), jobs).collect()} == {"A": 0, "B": 0, "C": 0, "Z": 1}


def test_scalars(spark):
    rows = spark.createDataFrame([("{a,b}", "USER12717_S", "failed", "2017-04-01 00:00:00", "1.5"), ("", "nodigits", "CANCELLED", "bad", "NaN"), (None, None, None, None, "x"), ("{}", "G007", "NODE_FAIL", "2017-04-01", "inf")], "h string, i string, x string, t string, v string")
    got = rows.select(host_count(F.col("h")).alias("h"), identifier_number(F.col("i")).alias("i"), is_positive(F.col("x"), POSITIVE).alias("x"), epoch(F.col("t")).alias("t"), number(F.col("v")).alias("v"), composite(F.col("h"), F.col("i")).alias("k")).collect()
    assert [tuple(r)[:5] for r in got] == [(2.0, 12717.0, 1, 1491004800.0, 1.5), (None, None, 0, None, None), (None, None, 0, None, None), (1.0, 7.0, 1, 1491004800.0, None)]
    assert got[2].k == "__missing__\x1f__missing__"
    limits = spark.createDataFrame([(0.0, 0.0), (None, 1.0), (-5.0, None), (math.e**2 - 1, 2.0)], "l double, d double")
    assert [r.b for r in limits.select(timelimit_bucket(F.col("l")).alias("b")).collect()] == ["0.0", "na", "0.0", "2.0"]
    assert [r.r for r in limits.select(ratio(F.lit(1.0), F.col("d")).alias("r")).collect()] == [None, 1.0, None, 0.5]
    assert [r.r for r in limits.select(log1p_floor(F.col("l")).alias("r")).collect()][:3] == [0.0, None, 0.0]


def test_windows(spark):
    assert X.window_parts(900) == ["p0", "p1"]
    with pytest.raises(ValueError):
        X.window_parts(100)
    rows = A.accumulators(A.window_rows(readings(spark, reading(at=10.0, cpu=2.0), reading(at=400.0, cpu=6.0), reading(at=1000.0, cpu=90.0))))
    short, whole = X.matrix(rows, 900.0).first(), X.matrix(rows, 1800.0).first()
    assert (short.cpuuser_mean, short.cpuuser_trend, short.obs_rows, short.gpu_mean) == (4.0, 4.0, 2.0, None)
    assert (whole.cpuuser_last, whole.cpuuser_head_mean, whole.cpuuser_tail_mean, whole.target) == (90.0, 2.0, 48.0, 1)


KEYED = "jid string, username string, account string, queue string, unit string, jobname string, timelimit_bucket string, month string, target int"


def keyed(spark, *rows):
    return spark.createDataFrame([(f"J{k}", u, "a", "q", "u", "n", "1.0", m, t) for k, (u, m, t) in enumerate(rows)], KEYED)


def test_expanding_encoding_never_looks_ahead(spark):
    rows = keyed(spark, ("x", "2020-01", 1), ("x", "2020-01", 1), ("x", "2020-02", 0), ("x", "2020-03", 0), (None, "2020-01", 0), ("x", None, 1))
    got = {r.jid: r for r in E.te_expanding(rows).filter("key_name = 'username'").collect()}
    p = 3 / 6
    assert got["J0"].te == got["J1"].te == got["J4"].te == got["J5"].te == pytest.approx(p) and got["J0"].tc == got["J5"].tc == 0
    assert got["J2"].te == pytest.approx((2 + 25 * p) / 27) and got["J3"].te == pytest.approx((2 + 25 * p) / 28)
    fresh = {r.te for r in E.te_transform(keyed(spark, ("new", "2021-01", 0)), rows).filter("key_name = 'username'").collect()}
    assert fresh == {p}


def test_label_codes(spark):
    rows = keyed(spark, *[("b", "m", 0)] * 5, *[("a", "m", 0)] * 5, *[("c", "m", 0)] * 4, (None, "m", 0))
    codes = {r.category: r.code for r in E.label_codes(rows).filter("field = 'username'").collect()}
    assert codes == {"a": 1, "b": 2, "c": 0, "__missing__": 0}
    assert {r.cat_username for r in E.with_codes(keyed(spark, ("zz", "m", 0)), E.label_codes(rows)).collect()} == {0}


def test_drift(spark):
    train = spark.createDataFrame([("x", "j", "a"), ("y", "j", "a")], "username string, jobname string, account string")
    ref = spark.createDataFrame([("x", "j", "a"), ("z", "j", "a"), (None, "j", "a"), ("y", "j", "a")], "username string, jobname string, account string")
    assert {r.field: r.rate for r in D.unseen_rates(train, ref).collect()} == {"username": 0.5, "jobname": 0.0, "account": 0.0}
    cats = spark.createDataFrame([("a",)] * 50 + [("b",)] * 30 + [("c",)] * 20 + [(None,)] * 5, "v string")
    for rate in (0.0, 0.1, 0.5, 1.0):
        taken = D.category_holdout(cats, "v", rate, "s").collect()
        assert sum(r.n for r in taken) >= min(rate * 105, 100) and all(r.category for r in taken)
    assert D.identity_columns(["te_username", "te_username__queue", "tc_queue", "cat_username", "obs_rows"], "username") == ["te_username", "te_username__queue", "cat_username"]
    enc = spark.createDataFrame([("J1", 0.3, 2.0, 5, 9.0), ("J2", 0.4, 3.0, 6, 8.0)], "jid string, te_username double, tc_username double, cat_username int, obs_rows double")
    got = {r.jid: tuple(r)[1:] for r in D.blank_identities(enc, F.col("jid") == "J1", ("username",), 0.1).collect()}
    assert got == {"J1": (0.1, 0.0, 0, 9.0), "J2": (0.4, 3.0, 6, 8.0)}
    share = spark.range(4000).select(D.row_mask(F.col("id").cast("string"), 0.3, "s").cast("int").alias("m")).agg(F.avg("m")).first()[0]
    assert abs(share - 0.3) < 0.03


def test_guards(spark):
    train = spark.range(500).select(F.col("id").cast("double").alias("timelike"), (F.col("id") % 10).cast("double").alias("bounded"), F.lit(None).cast("double").alias("empty"))
    ref = spark.range(200).select((F.col("id") + 450).cast("double").alias("timelike"), (F.col("id") % 10).cast("double").alias("bounded"), F.lit(1.0).alias("empty"))
    assert {r.name: r.kept for r in X.range_guard(train, ref, ["timelike", "bounded", "empty"]).collect()} == {"timelike": False, "bounded": True, "empty": True}
    some = spark.createDataFrame([(1.0, 1.0, None), (1.0, None, None)], "c double, n double, e double")
    assert {r.name: r.kept for r in X.constant_columns(some, ["c", "n", "e"]).collect()} == {"c": False, "n": True, "e": False}


def test_lifespan(spark):
    schema = "jid string, life_first double, life_last double, life_rows long, life_hosts long, start_epoch double, timelimit double, chunk_end_epoch double"
    parts = spark.createDataFrame([("A", 100.0, 200.0, 2, 1, 90.0, 1.0, 500.0), ("A", 150.0, 400.0, 3, 2, 90.0, 1.0, 4001.0)], schema)
    merged = L.lifespan_merge(parts)
    r = merged.first()
    assert (r.life_first, r.life_last, r.life_rows, r.life_hosts, r.chunk_end_epoch) == (100.0, 400.0, 5, 2, 4001.0)
    jobs = spark.createDataFrame([("A", "Anvil"), ("B", "S")], "jid string, cluster string")
    got = {r.jid: r for r in L.lifespan_features(jobs, merged).collect()}
    assert got["A"].life_runtime == 310.0 and got["A"].life_runtime_over_limit == 310.0 and got["A"].life_right_censored == 0
    assert got["B"].life_runtime is None and got["B"].life_right_censored == 0


def test_ranks_blend_and_ap(spark):
    rows = spark.createDataFrame([("g", "a", 0.1, 0.4, 0), ("g", "b", 0.1, 0.3, 1), ("g", "c", 0.9, 0.2, 1), ("h", "d", 0.5, 0.5, 0)], "cluster string, jid string, s double, t double, target int")
    assert {r.jid: r.rank for r in S.rank_ordinal(rows, "s").collect()} == {"a": 0.0, "b": 0.5, "c": 1.0, "d": 0.0}
    blend = {r.jid: r.blend for r in S.rank_blend(rows, ["s", "t"]).collect()}
    assert len(blend) == 4 and blend["d"] == 0.5 and min(blend.values()) >= 0.2
    ap = {r.cluster: r.ap for r in S.average_precision(rows, "s").collect()}
    assert ap["g"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3) and ap["h"] is None
    assert S.choose_predictor({"blend": 0.60, "x": 0.605}) == "blend" and S.choose_predictor({"blend": 0.6, "x": 0.62}) == "x"
    assert S.refit_rounds(100, 300, 100) == 140 and S.refit_rounds(1, 1, 1) == 10 and S.refit_rounds(9000, 1, 1) == 4000
    with pytest.raises(ValueError):
        S.out_of_time_split(spark.createDataFrame([("2020-01", 1)], "month string, target int"), 3)


def test_submission_contract(spark, tmp_path):
    import glob

    sample = spark.createDataFrame([(2, "C_JOB2"), (1, "S_JOB1_S"), (3, "Anvil_JOB3")], "position long, row_id string")
    scores = spark.createDataFrame([("S_JOB1_S", 0.25), ("C_JOB2", 1.5), ("Anvil_JOB3", -1.0)], "row_id string, score double")
    whole = S.submission(sample, scores)
    S.require_contract(whole)
    with pytest.raises(ValueError, match="missing"):
        S.require_contract(S.submission(sample, scores.limit(1)))
    T.write_submission(whole, f"{tmp_path}/out")
    (name,) = glob.glob(f"{tmp_path}/out/part-*.csv")
    with open(name) as file:
        assert file.read().splitlines() == ["row_id,failure_probability", "S_JOB1_S,0.25000000", "C_JOB2,1.00000000", "Anvil_JOB3,0.00000000"]
    T.zip_submission(name, f"{tmp_path}/s.zip")
    assert [r.row_id for r in T.read_sample(spark, name).orderBy("position").collect()] == ["S_JOB1_S", "C_JOB2", "Anvil_JOB3"]
    T.update_report(spark, f"{tmp_path}/r.json", "S", {"ap": 1})
    assert T.update_report(spark, f"{tmp_path}/r.json", "C", {"ap": 2}) == {"S": {"ap": 1}, "C": {"ap": 2}}
    of, jid = T.split_row_id(F.col("row_id"))
    assert {(r.c, r.j) for r in sample.select(of.alias("c"), jid.alias("j")).collect()} == {("C", "JOB2"), ("S", "JOB1_S"), ("Anvil", "JOB3")}


def test_raw_files_and_stages(spark, tmp_path):
    cols = "time string, submit_time string, start_time string, jid string, host string, timelimit string, nhosts int, ncores int, account string, queue string, username string, value_cpuuser string, exitcode string"
    row = lambda jid, at, start="2017-04-01 00:00:00": (at, "2017-03-31 23:59:00", start, jid, "h", "60", 1, 4, "a", "q", "USER1", "2.5", "FAILED")
    for name, rows in {"2017-04-01-00_S": [row("A", "2017-04-01 00:01:00"), row(None, "2017-04-01 00:01:00"), row("A", "bad")], "2017-04-01-01_C": [row("B", "2017-04-01 01:02:00", "2017-04-01 01:00:00")], "2017-05-01-00": [row("C", "2017-05-01 00:03:00", "2017-05-01 00:00:00")]}.items():
        spark.createDataFrame(rows, cols).coalesce(1).write.parquet(f"{tmp_path}/tmp")
        import glob
        import os
        import shutil

        os.makedirs(f"{tmp_path}/raw/x", exist_ok=True)
        shutil.move(glob.glob(f"{tmp_path}/tmp/part-*.parquet")[0], f"{tmp_path}/raw/x/{name}.parquet")
        shutil.rmtree(f"{tmp_path}/tmp")
    raw = T.read_raw(spark, f"{tmp_path}/raw")
    assert {(r.jid, r.cluster, r.file_month, r.time_epoch - r.start_epoch, r.cpuuser, r.gpu) for r in raw.collect()} == {("A", "S", "2017-04", 60.0, 2.5, None), ("B", "C", "2017-04", 120.0, 2.5, None), ("C", "Anvil", "2017-05", 180.0, 2.5, None)}
    assert T.read_raw(spark, f"{tmp_path}/raw", cluster="S").count() == 1
    assert T.read_raw(spark, f"{tmp_path}/raw", months=("2017-05", None)).count() == 1
    assert T.read_raw(spark, f"{tmp_path}/raw", hours=["2017-04-01-01"]).count() == 1
    sources = {"train": f"{tmp_path}/raw", "absent": f"{tmp_path}/none"}
    made = stages.matrices(spark, sources, f"{tmp_path}/out")
    assert list(made) == ["train"] and made["train"].count() == 3
    again = stages.stage(spark, f"{tmp_path}/out/train/matrix", lambda: 1 / 0)
    assert again.count() == 3
    acc = A.accumulators(A.window_rows(raw)).withColumn("cluster", F.lit("S"))
    late = acc.filter("jid = 'C'").withColumn("start_epoch", F.lit(None).cast("double"))
    T.write_accumulators(acc.filter("jid <> 'C'").unionByName(late).drop("month"), f"{tmp_path}/acc")
    assert sorted(r.jid for r in T.load_accumulators(spark, f"{tmp_path}/acc", f"{tmp_path}/acc").collect()) == ["A", "B"]


def test_files_that_type_a_column_differently(spark, tmp_path):
    """Mixed types, absent columns, a reading without a start and tied readings."""
    import glob
    import os
    import shutil

    base = {"time": "2017-04-01 00:01:00", "start_time": "2017-04-01 00:00:00", "jid": "A", "host": "h", "nhosts": 1, "value_cpuuser": 2.0, "value_gpu": 1.0}
    files = {
        "2017-04-01-00_S": [base, base | {"value_cpuuser": 7.0}],
        "2017-04-01-01_S": [base | {"jid": "B", "value_gpu": "3.5", "start_time": None, "time": "2017-04-01 01:10:00"}, base | {"jid": "B", "value_gpu": "no number", "start_time": None, "time": "2017-04-01 01:20:00"}],
        "2017-04-01-02_S": [{"time": 1491012000 * 10**9, "jid": "C", "host": None, "value_cpuuser": 1, "value_gpu": 4}],
    }
    os.makedirs(f"{tmp_path}/raw")
    for name, rows in files.items():
        kinds = {str: "string", int: "long", float: "double", type(None): "string"}
        schema = ", ".join(f"{c} {kinds[type(v)]}" for c, v in rows[0].items())
        spark.createDataFrame([tuple(r.values()) for r in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/tmp")
        shutil.move(glob.glob(f"{tmp_path}/tmp/part-*.parquet")[0], f"{tmp_path}/raw/{name}.parquet")
        shutil.rmtree(f"{tmp_path}/tmp")
    raw = T.read_raw(spark, f"{tmp_path}/raw")
    assert sorted((r.jid, r.gpu) for r in raw.collect() if r.gpu is not None) == [("A", 1.0), ("A", 1.0), ("B", 3.5), ("C", 4.0)]
    assert {r.chunk_start for r in raw.collect()} == {1491004800.0}
    rows = {(r.jid, r.elapsed): r.cpuuser for r in A.window_rows(raw).collect()}
    assert rows == {("A", 60.0): 2.0, ("B", 0.0): 2.0, ("B", 600.0): 2.0, ("C", 0.0): 1.0}
    assert T.read_raw(spark, f"{tmp_path}/raw", months=("2030-01", None)).count() == 0


def test_streamed_accumulators_equal_a_batch(spark, tmp_path):
    draw = random.Random(6)
    rows = [reading(f"J{draw.randrange(5)}", "h", float(t), cpu=float(draw.randrange(5)), line=t) for t in draw.sample(range(-300, 1801), 90)]
    rows += [reading("late", "h", 5000.0, start=4900.0), reading("open", "h", 9000.0, start=None, line=1)]
    chunks = [rows[:30], rows[30:60] + rows[10:20], rows[60:], [reading("J0", "h", 50.0, line=7), rows[-1]]]
    for k, chunk in enumerate(chunks):
        readings(spark, *chunk).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    for k in range(len(chunks)):  # files are taken in the order of their times
        import glob
        import os

        for f in glob.glob(f"{tmp_path}/in/{k}/part-*"):
            os.utime(f, (1_000_000 + k, 1_000_000 + k))
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    state = AccumulatorState(spark, f"{tmp_path}/state")
    accumulate_stream(stream, state, f"{tmp_path}/check").awaitTermination()
    assert {r.jid for r in state.closed().collect()} == {"late"} | {f"J{k}" for k in range(5)} and {r.jid for r in state.open(3).collect()} == {"open"}
    assert not stages.exists(spark, f"{tmp_path}/state/open/v=0")
    want, got = A.accumulators(A.window_rows(readings(spark, *rows))), state.flush(3)
    names = sorted(want.columns)
    assert sorted(map(repr, got.select(names).collect())) == sorted(map(repr, want.select(names).collect()))
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:10:00", "b")], "ts string, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r.n for r in windowed_counts(events).collect()) == [1, 2]


def test_trees(spark):
    draw = random.Random(2)
    rows = spark.createDataFrame([(f"J{k}", x, None if k % 9 == 0 else x + draw.random(), int(x > 0.6), "S") for k, x in enumerate([draw.random() for _ in range(300)])], "jid string, a double, b double, target int, cluster string")
    train, fills = models.design(rows, ["a", "b", "absent"])
    model = models.fit(train, 1.5, rounds=10, depth=3)
    ap = S.average_precision(models.score(model, models.design(rows, ["a", "b", "absent"], fills)[0])).first().ap
    assert ap > 0.95
    n, best = models.best_rounds(model, train)
    assert n in (5, 10) and best > 0.95
    forest = models.fit(train, 1.5, rounds=10, depth=3, family="forest")
    assert models.best_rounds(forest, train)[1] > 0.9
    assert models.importances(model, ["a", "b", "absent"], 2)[0][0] == "a"


def hourly(spark, path, jobs, hours, labelled):
    """Raw files of cluster S: each job's readings over its window, failures using more CPU."""
    draw, rows = random.Random(len(jobs)), []
    for k, (jid, start, user, fails) in enumerate(jobs):
        for j in range(4):
            rows.append((start + 300 * j, start - 60, start, jid, f"h{k % 3}", 3600.0, 1, 8, "acct", "q", "u", "n", user, "{a}", 5.0 * fails + draw.random(), 100.0 + k % 7, "FAILED" if fails else "COMPLETED"))
    names = "time long, submit_time long, start_time long, jid string, host string, timelimit double, nhosts int, ncores int, account string, queue string, unit string, jobname string, username string, host_list string, value_cpuuser double, value_memused double, exitcode string"
    frame = spark.createDataFrame(rows, names).withColumns({c: F.timestamp_seconds(c) for c in ("time", "submit_time", "start_time")})
    (frame if labelled else frame.drop("exitcode")).coalesce(1).write.parquet(path)
    T.rename_parts(spark, path, lambda n: f"{hours}_S.parquet")


def test_from_raw_files_to_a_checked_submission(spark, tmp_path):
    import glob

    from emberline import cli

    draw, month = random.Random(9), 30 * 86400
    jobs = [(f"JOB{k}", 1_420_200_000 + (k % 6) * month + 3600 * (k // 6), f"USER{draw.randrange(12)}", int(draw.random() < 0.4)) for k in range(240)]
    hourly(spark, f"{tmp_path}/train", jobs, "2015-01-01-00", True)
    judged = [(f"NEW{k}", 1_440_000_000 + 3600 * k, f"USER{draw.randrange(24)}", k % 2) for k in range(20)]
    hourly(spark, f"{tmp_path}/judge", judged, "2015-08-01-00", False)
    with open(f"{tmp_path}/sample.csv", "w") as file:
        file.write("row_id,failure_probability\n" + "".join(f"S_{j},0\n" for j, *_ in judged[::-1]))
    layout = stages.Layout(f"{tmp_path}/train", f"{tmp_path}/judge", f"{tmp_path}/sample.csv", f"{tmp_path}/out", f"{tmp_path}/none", {"S": None})
    options = training.Options(rounds={"gbt": 4, "forest": 4}, depth=3, seeds=1, holdout=2, dropout="on")
    done = stages.run(spark, layout, options=options, clusters=("S", "C"))
    assert done["train-acc"] == {"S": True, "C": False} and done["fit"]["C"] is None
    report = done["fit"]["S"]
    assert set(report["holdout_ap"]) == {"gbt", "forest", "blend"} and report["holdout_ap"][report["predictor"]] > 0.8 and 0 < report["unseen_rates"]["username"] < 1
    answers = {r.row_id: r.failure_probability for r in done["predict"].collect()}
    failing, other = [answers[f"S_{j}"] for j, *_, f in judged if f], [answers[f"S_{j}"] for j, *_, f in judged if not f]
    assert sum(failing) / len(failing) > sum(other) / len(other) + 0.2
    (csv,) = glob.glob(f"{tmp_path}/out/submission/csv/part-*")
    with open(csv) as file:
        assert [x.partition(",")[0] for x in file.read().splitlines()] == ["row_id", *[f"S_{j}" for j, *_ in judged[::-1]]]
    again = cli.main(["run", "--training", f"{tmp_path}/train", "--judged", f"{tmp_path}/judge", "--sample", f"{tmp_path}/sample.csv", "--output", f"{tmp_path}/out", "--clusters", "S", "--stages", "train-acc", "judge-acc", "fit"], spark)
    assert again["fit"] == {"S": None}
    assert T.read_json(spark, f"{tmp_path}/out/models/validation_report.json")["S"]["jobs"] == 240


def test_wanted_jobs_that_the_window_missed_are_filled_in(spark, tmp_path):
    hourly(spark, f"{tmp_path}/judge", [("A", 1_440_000_000, "u", 0)], "2015-08-19-16", False)
    gone = spark.read.parquet(f"{tmp_path}/judge").withColumns({"jid": F.lit("B"), "time": F.timestamp_seconds(F.lit(1_440_009_000)), "start_time": F.timestamp_seconds(F.lit(1_440_000_000))}).limit(1)
    gone.coalesce(1).write.parquet(f"{tmp_path}/judge/more")
    T.rename_parts(spark, f"{tmp_path}/judge/more", lambda n: "2015-08-19-18_S.parquet")
    out = f"{tmp_path}/out"
    assert stages.accumulate_source(spark, f"{tmp_path}/judge", out, "S")
    assert stages.fill_missing(spark, f"{tmp_path}/judge", out, "S", spark.createDataFrame([("A",), ("B",)], "jid string")) == 1
    both = T.load_accumulators(spark, f"{out}/jobs/S", f"{out}/fallback/S").collect()
    assert {(r.jid, r.source_rank, r.tmin_p0) for r in both} == {("A", 0, 0.0), ("B", 1, 0.0)}
    assert stages.spans(spark, f"{tmp_path}/judge", f"{tmp_path}/life", "S") and not stages.spans(spark, f"{tmp_path}/judge", f"{tmp_path}/life", "C")
    spans = T.load_spans(spark, [f"{tmp_path}/life/S", f"{tmp_path}/life/S"], L.lifespan_merge)
    assert {(r.jid, r.life_rows) for r in spans.collect()} == {("A", 8), ("B", 2)}
