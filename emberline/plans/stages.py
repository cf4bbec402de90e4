"""Stages from raw files to a checked submission; each persists what it makes and is skipped once that is there."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import accumulate, features, lifespan
from emberline.operators import selection as S
from emberline.schema import CLUSTERS, TRAINING_FROM
from emberline.sources import telemetry


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists on whatever file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def done(spark: SparkSession, path: str) -> bool:
    """Whether a whole table is at ``path``."""
    return exists(spark, f"{path}/_SUCCESS")


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The table at ``path``, built and written first unless a whole one is there."""
    if force or not done(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def matrices(spark: SparkSession, sources: dict[str, str], output: str, seconds: float = 1800.0, force: bool = False) -> dict[str, DataFrame]:
    """Accumulators, then the feature matrix, of each named source; sources that do not exist are left out."""
    out = {}
    for name, path in sources.items():
        if not exists(spark, path):
            continue

        def accumulated(path: str = path) -> DataFrame:
            return accumulate.accumulators(accumulate.window_rows(telemetry.read_raw(spark, path)))

        acc = stage(spark, f"{output}/{name}/accumulators", accumulated, force)
        out[name] = stage(spark, f"{output}/{name}/matrix", lambda acc=acc: features.matrix(acc, seconds), force)
    return out


def accumulate_source(spark: SparkSession, source: str, output: str, cluster: str, months: tuple[str | None, str | None] = (None, None), force: bool = False) -> bool:
    """A cluster's accumulators from the raw files below ``source``, under ``output``; False where it has none there."""
    target = f"{output}/jobs/{cluster}"
    if not force and done(spark, target):
        return True
    if not exists(spark, source) or not telemetry.list_files(spark, source, cluster, months):
        return False
    rows = telemetry.read_raw(spark, source, cluster, months)
    telemetry.write_accumulators(accumulate.accumulators(accumulate.window_rows(rows)).withColumn("cluster", F.lit(cluster)), target)
    return True


def fill_missing(spark: SparkSession, source: str, output: str, cluster: str, wanted: DataFrame, force: bool = False) -> int:
    """Records of ``wanted`` jobs that the strict window missed, from their first reading on; how many those were.

    The whole release is read for the first readings, ``jid`` and ``time`` only, and then just the hours that the
    missing jobs' windows touch. Wanted jobs without any reading are an error.
    """
    target = f"{output}/fallback/{cluster}"
    if not force and done(spark, target):
        return spark.read.parquet(target).count()
    strict = f"{output}/jobs/{cluster}"
    have = telemetry.job_ids(spark.read.parquet(strict)) if done(spark, strict) else spark.createDataFrame([], "jid string")
    missing = accumulate.uncovered(wanted, have).cache()
    try:
        n = missing.count()
        if not n:
            return 0
        seen = accumulate.first_seen(telemetry.read_raw(spark, source, cluster, columns=("jid", "time")), missing).cache()
        found = seen.count()
        if not found:
            raise ValueError(f"{cluster}: no telemetry of {n} wanted jobs")
        touched = accumulate.window_hours(seen.select(F.timestamp_seconds("first_seen").alias("at")), "at")
        hours = {r.hour for r in touched.select(F.date_format("hour", "yyyy-MM-dd-HH").alias("hour")).collect()}
        rows = accumulate.fallback_rows(telemetry.read_raw(spark, source, cluster, hours=hours), seen)
        telemetry.write_accumulators(accumulate.accumulators(rows).withColumn("cluster", F.lit(cluster)), target)
        return found
    finally:
        missing.unpersist()


def spans(spark: SparkSession, source: str, output: str, cluster: str, months: tuple[str | None, str | None] = (None, None), force: bool = False) -> bool:
    """A cluster's whole-life spans (opt-in); False where ``source`` has no files of it."""
    target = f"{output}/{cluster}"
    if not force and done(spark, target):
        return True
    files = telemetry.list_files(spark, source, cluster, months) if exists(spark, source) else []
    if not files:
        return False
    rows = telemetry.read_raw(spark, source, cluster, months, columns=("time", "jid", "host", "start_time", "timelimit")).withColumn("elapsed", F.col("time_epoch"))
    made = lifespan.lifespan_agg(rows).withColumn("cluster", F.lit(cluster))
    telemetry.write_spans(made.withColumn("chunk_end_epoch", telemetry.by_cluster(telemetry.chunk_ends(files))), target)
    return True


@dataclass
class Layout:
    """Where inputs are and outputs go; ``training_from`` names each cluster's first month of training files."""

    training: str
    judged: str
    sample: str
    output: str
    validation: str | None = None
    training_from: dict[str, str | None] | None = None

    def accumulators(self, name: str) -> str:
        return f"{self.output}/accumulators/{name}"

    def spans(self, name: str) -> str:
        return f"{self.output}/lifespan/{name}"

    @property
    def models(self) -> str:
        return f"{self.output}/models"

    @property
    def submission(self) -> str:
        return f"{self.output}/submission"


STAGES = ("train-acc", "valid-acc", "judge-acc", "lifespan", "fit", "predict")


def wanted_jobs(spark: SparkSession, sample: str, cluster: str) -> DataFrame:
    """The jobs of a cluster that the sample submission asks for."""
    of, jid = telemetry.split_row_id(F.col("row_id"))
    return telemetry.read_sample(spark, sample).filter(of == cluster).select(jid.alias("jid"))


def _load(spark: SparkSession, layout: Layout, name: str, cluster: str) -> DataFrame | None:
    strict, fallback = (f"{layout.accumulators(name)}/{kind}/{cluster}" for kind in ("jobs", "fallback"))
    if not done(spark, strict):
        return telemetry.load_accumulators(spark, fallback) if done(spark, fallback) else None
    return telemetry.load_accumulators(spark, strict, fallback if done(spark, fallback) else None)


def _spans(spark: SparkSession, layout: Layout, names: tuple[str, ...], cluster: str) -> DataFrame | None:
    paths = [p for p in (f"{layout.spans(n)}/{cluster}" for n in names) if done(spark, p)]
    return telemetry.load_spans(spark, paths, lifespan.lifespan_merge) if paths else None


def run(spark: SparkSession, layout: Layout, stages: tuple[str, ...] = (), whole_life: bool = False, seconds: float = 1800.0, options=None, force: bool = False, clusters: tuple[str, ...] = CLUSTERS) -> dict:
    """Runs the named stages (all but the opt-in ``lifespan`` where none is named) and returns what each did.

    Inputs that do not exist, and clusters without files in one, are left out. Every stage but ``predict`` is
    skipped for a cluster whose output is there, unless ``force``.
    """
    from emberline.plans import training

    stages = stages or tuple(s for s in STAGES if s != "lifespan" or whole_life)
    first = layout.training_from if layout.training_from is not None else TRAINING_FROM
    options, out = options or training.Options(), {}
    if "train-acc" in stages:
        out["train-acc"] = {c: accumulate_source(spark, layout.training, layout.accumulators("train"), c, (first.get(c), None), force) for c in clusters}
    if "valid-acc" in stages and layout.validation:
        out["valid-acc"] = {c: accumulate_source(spark, layout.validation, layout.accumulators("valid"), c, force=force) for c in clusters}
    if "judge-acc" in stages:
        out["judge-acc"] = {}
        for c in clusters:
            if accumulate_source(spark, layout.judged, layout.accumulators("judge"), c, force=force):
                out["judge-acc"][c] = fill_missing(spark, layout.judged, layout.accumulators("judge"), c, wanted_jobs(spark, layout.sample, c), force)
    if "lifespan" in stages:
        for name, source in (("train", layout.training), ("valid", layout.validation), ("judge", layout.judged)):
            if source:
                out[f"lifespan-{name}"] = {c: spans(spark, source, layout.spans(name), c, (first.get(c) if name == "train" else None, None), force) for c in clusters}
    if "fit" in stages:
        out["fit"] = {c: fit(spark, layout, c, seconds, options, whole_life, force) for c in clusters}
    if "predict" in stages:
        out["predict"] = predict(spark, layout, seconds, whole_life, clusters)
    return out


def fit(spark: SparkSession, layout: Layout, cluster: str, seconds: float, options, whole_life: bool = False, force: bool = False) -> dict | None:
    """Trains and keeps a cluster's model and reports on it; None where it has no accumulators, or a model already."""
    from emberline.plans import training

    if not force and exists(spark, f"{layout.models}/{cluster}/manifest.json"):
        return None
    parts = [x for x in (_load(spark, layout, n, cluster) for n in ("train", "valid")) if x is not None]
    if not parts:
        return None
    extra = _spans(spark, layout, ("train", "valid"), cluster) if whole_life else None
    matrix = training.labelled(accumulate.least_delayed(parts), seconds, options, extra)
    judged = _load(spark, layout, "judge", cluster)
    reference = None
    if judged is not None:
        reference = training.with_spans(features.matrix(judged, seconds), _spans(spark, layout, ("judge",), cluster) if whole_life else None)
    model, report = training.train_cluster(cluster, matrix, seconds, options, reference)
    model.save(layout.models)
    telemetry.update_report(spark, f"{layout.models}/validation_report.json", cluster, report)
    return report


def predict(spark: SparkSession, layout: Layout, seconds: float = 1800.0, whole_life: bool = False, clusters: tuple[str, ...] = CLUSTERS) -> DataFrame:
    """Scores the judged jobs, checks the answers against the sample, writes them, and returns them."""
    from emberline.plans import training

    found = {}
    for c in clusters:
        acc = _load(spark, layout, "judge", c)
        if acc is not None:
            found[c] = training.with_spans(features.matrix(acc, seconds), _spans(spark, layout, ("judge",), c) if whole_life else None)
    scores = training.predict_clusters(spark, found, layout.models)
    answers = stage(spark, f"{layout.submission}/answers", lambda: S.submission(telemetry.read_sample(spark, layout.sample), scores), force=True)
    S.require_contract(answers)
    telemetry.write_submission(answers, f"{layout.submission}/csv")
    return answers
