"""Sources and sinks of telemetry: raw hourly files, stored accumulators, and a stand-in from order tables."""

from __future__ import annotations

import json
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.functions.scalar import epoch, number
from emberline.operators.accumulate import prefer_strict
from emberline.schema import CLUSTERS, METRICS, NUMERIC, RAW, STRINGS, TIMES


def cluster_of(name: Column) -> Column:
    """The cluster that a raw file's name stands for."""
    return F.when(name.endswith("_S.parquet"), "S").when(name.endswith("_C.parquet"), "C").otherwise("Anvil")


def cluster_of_name(name: str) -> str:
    """The same, of a name on the driver."""
    return "S" if name.endswith("_S.parquet") else "C" if name.endswith("_C.parquet") else "Anvil"


def list_files(spark: SparkSession, path: str, cluster: str | None = None, months: tuple[str | None, str | None] = (None, None), hours: set[str] | None = None) -> list[str]:
    """The hourly files below ``path``, by name, which is their order in time; their contents are not read.

    ``months`` bounds the name's first seven characters, both ends included; ``hours`` lists wanted first thirteen.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).inputFiles()
    name = lambda p: p.rpartition("/")[2]
    low, high = months
    kept = [p for p in found if (cluster is None or cluster_of_name(name(p)) == cluster) and (not low or name(p)[:7] >= low) and (not high or name(p)[:7] <= high) and (hours is None or name(p)[:13] in hours)]
    return sorted(kept, key=lambda p: (name(p), p))


def file_hour(path: str) -> float | None:
    """The epoch second at which the hour in a file's name begins; null for other names."""
    try:
        return datetime.strptime(path.rpartition("/")[2][:13], "%Y-%m-%d-%H").replace(tzinfo=timezone.utc).timestamp()
    except ValueError:
        return None


def chunk_starts(files: list[str]) -> dict[str, float]:
    """Per cluster the hour of its first file."""
    out: dict[str, float] = {}
    for path in files:
        hour, cluster = file_hour(path), cluster_of_name(path)
        if hour is not None:
            out[cluster] = min(hour, out.get(cluster, hour))
    return out


def chunk_ends(files: list[str]) -> dict[str, float]:
    """Per cluster the end of its last file's hour."""
    out: dict[str, float] = {}
    for path in files:
        hour, cluster = file_hour(path), cluster_of_name(path)
        if hour is not None:
            out[cluster] = max(hour + 3600.0, out.get(cluster, 0.0))
    return out


def by_cluster(values: dict[str, float]) -> Column:
    """A value for each cluster as a column of doubles, null for other clusters."""
    out = F.lit(None).cast("double")
    for cluster, value in values.items():
        out = F.when(F.col("cluster") == cluster, F.lit(value)).otherwise(out)
    return out


def _alike(spark: SparkSession, files: list[str], threads: int = 16) -> list[DataFrame]:
    """Frames over ``files``, one for all if their columns agree in type, else one for each set of types that occurs."""
    if not files:
        return []
    try:
        return [spark.read.option("mergeSchema", True).parquet(*files)]
    except (PySparkException, Py4JJavaError) as error:
        if "MERGE_SCHEMAS" not in str(error):
            raise
    with ThreadPoolExecutor(threads) as pool:
        schemas = list(pool.map(lambda p: spark.read.parquet(p).schema, files))
    sets: dict[str, list[str]] = {}
    for path, schema in zip(files, schemas, strict=True):
        sets.setdefault(schema.simpleString(), []).append(path)
    return [spark.read.parquet(*some) for some in sets.values()]


def read_raw(spark: SparkSession, path: str, cluster: str | None = None, months: tuple[str | None, str | None] = (None, None), hours: list[str] | set[str] | None = None, columns: tuple[str, ...] = RAW) -> DataFrame:
    """Typed readings (see ``prepare``) of all hourly files below ``path``, pruned by file name before any is opened.

    Files may type a column differently, or lack it: each set of types is read as it is and
    coerced. Adds ``cluster``, ``file_month``, ``file_hour``, the ``chunk_start`` of the cluster's files, and
    the file and row that a reading is from, which settle ties. Only ``columns`` are read. No file: no rows.
    """
    files = list_files(spark, path, cluster, months, set(hours) if hours is not None else None)
    name, edges = F.col("_metadata.file_name"), chunk_starts(files)

    def typed(found: DataFrame) -> DataFrame:
        have = [c for c in found.columns if c in columns]
        placed = found.select(*have, cluster_of(name).alias("cluster"), F.substring(name, 1, 7).alias("file_month"), F.substring(name, 1, 13).alias("file_hour"), F.col("_metadata.row_index").alias("line"), F.xxhash64(name).alias("part_key"))
        return prepare(placed)

    parts = [typed(found) for found in _alike(spark, files)]
    if not parts:
        extra = "cluster string, file_month string, file_hour string, line long, part_key long"
        parts = [prepare(spark.createDataFrame([], ", ".join([f"{c} string" for c in columns] + [extra])))]
    return reduce(DataFrame.unionByName, parts).withColumn("chunk_start", by_cluster(edges))


def _epoch(kind: T.DataType | None, column: Column) -> Column:
    """Epoch seconds of a time column; plain numbers are nanoseconds."""
    return number(column) / 1e9 if isinstance(kind, T.NumericType) else epoch(column)


def prepare(raw: DataFrame) -> DataFrame:
    """Typed readings: epoch seconds, finite numbers, text; rows without a job or a time are dropped.

    Columns that ``raw`` lacks are null. ``line`` and ``part_key`` order equal readings; without them a hash of the
    row does, so that which one is kept does not depend on how the rows are dealt.
    """
    kinds = {f.name: f.dataType for f in raw.schema}
    col = lambda c: F.col(c) if c in kinds else F.lit(None).cast("string")
    times = [_epoch(kinds.get(c), col(c)).alias(c.removesuffix("_time") + "_epoch") for c in TIMES]
    extra = [c for c in ("cluster", "file_month", "file_hour") if c in kinds]
    content = F.xxhash64(*[F.col(c) for c in RAW if c in kinds])
    out = raw.select(
        *extra,
        col("jid").cast("string").alias("jid"),
        col("host").cast("string").alias("host"),
        *times,
        *[number(col(c)).alias(c) for c in NUMERIC],
        *[col(c).cast("string").alias(c) for c in (*STRINGS, "exitcode")],
        *[number(col(f"value_{m}")).alias(m) for m in METRICS],
        (F.col("line").cast("long") if "line" in kinds else F.lit(0).cast("long")).alias("line"),
        (F.col("part_key").cast("long") if "part_key" in kinds else content).alias("part_key"),
    )
    return out.filter("jid IS NOT NULL AND time_epoch IS NOT NULL")


def identities(acc: DataFrame) -> DataFrame:
    """The identity columns of stored accumulators, nothing else of which is read."""
    return acc.select("username", "jobname", "account")


def job_ids(acc: DataFrame) -> DataFrame:
    """The jobs that stored accumulators cover, each once; no other column is read."""
    return acc.select("jid").distinct()


def telemetry_from_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines in the shape of telemetry: a job per order, a day standing for a second.

    Metrics are whole numbers, or of 128ths, so that their sums are exact in any order.
    """
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("double")
    host = F.concat(F.lit("NODE"), F.col("l_suppkey").cast("string"))
    lines = t("lineitem").join(t("part").select("p_partkey", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    hosts = F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_set(host)), ","), F.lit("}"))
    per_job = lines.groupBy(F.col("l_orderkey").alias("job_key")).agg(
        (F.max("p_size") * 60).cast("double").alias("timelimit"),
        F.count("*").cast("double").alias("nhosts"),
        F.sum("p_size").cast("double").alias("ncores"),
        F.when(F.first("l_orderkey") % 11 != 0, hosts).alias("host_list"),
    )
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    jobs = t("orders").join(places.select("c_custkey", "c_mktsegment", "r_name"), F.col("o_custkey") == F.col("c_custkey"))
    status = F.col("o_orderstatus")
    return (
        lines.join(jobs, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(per_job, F.col("l_orderkey") == F.col("job_key"))
        .select(
            F.col("r_name").alias("cluster"),
            F.concat(F.lit("JOB"), F.col("o_orderkey").cast("string")).alias("jid"),
            host.alias("host"),
            day("l_shipdate").alias("time_epoch"),
            (day("o_orderdate") - F.col("o_orderkey") % 30).alias("submit_epoch"),
            day("o_orderdate").alias("start_epoch"),
            "timelimit",
            "nhosts",
            "ncores",
            F.col("c_mktsegment").alias("account"),
            F.col("o_orderpriority").alias("queue"),
            F.col("l_returnflag").alias("unit"),
            F.col("p_type").alias("jobname"),
            F.concat(F.lit("USER"), F.col("o_custkey").cast("string")).alias("username"),
            "host_list",
            F.when(status == "F", "FAILED").when(status == "O", "COMPLETED").otherwise("CANCELLED").alias("exitcode"),
            F.col("l_quantity").alias("cpuuser"),
            F.lit(None).cast("double").alias("gpu"),
            F.floor("l_extendedprice").cast("double").alias("memused"),
            F.floor(F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("double").alias("memused_minus_diskcache"),
            (F.floor(F.col("l_tax") * 128) / 128).alias("nfs"),
            (F.floor(F.col("l_discount") * 128) / 128).alias("block"),
            F.date_format("o_orderdate", "yyyy-MM").alias("month"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("part_key"),
        )
    )


def write_accumulators(acc: DataFrame, path: str) -> None:
    """Accumulators as Parquet by cluster and start month; jobs without a start go to ``unknown``."""
    month = F.coalesce(F.date_format(F.timestamp_seconds("start_epoch"), "yyyy-MM"), F.lit("unknown"))
    acc.withColumn("month", month).write.mode("overwrite").partitionBy("cluster", "month").option("compression", "zstd").parquet(path)


def load_accumulators(spark: SparkSession, strict: str, fallback: str | None = None, months: tuple[str | None, str | None] = (None, None), cluster: str | None = None) -> DataFrame:
    """Stored accumulators without the ``unknown`` month; a strict record wins over a fallback one."""

    def read(path: str) -> DataFrame:
        rows = spark.read.option("basePath", path).parquet(path).filter("month <> 'unknown'")
        rows = rows.filter(F.col("cluster") == cluster) if cluster else rows
        low, high = months
        rows = rows.filter(F.col("month") >= low) if low else rows
        return rows.filter(F.col("month") <= high) if high else rows

    return prefer_strict(read(strict), read(fallback)) if fallback else read(strict)


def write_spans(spans: DataFrame, path: str) -> None:
    """Whole-life spans of jobs (see ``lifespan_agg``) as Parquet by cluster, with ``chunk_end_epoch``."""
    spans.write.mode("overwrite").partitionBy("cluster").option("compression", "zstd").parquet(path)


def load_spans(spark: SparkSession, paths: list[str], merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stored spans of several releases, merged: a job seen in two has the union of both, and the later end."""
    return merge(reduce(DataFrame.unionByName, [spark.read.option("basePath", p).parquet(p) for p in paths]))


def row_id(cluster: Column, jid: Column) -> Column:
    """The id by which a job is asked for: ``<cluster>_<jid>``."""
    return F.concat(cluster, F.lit("_"), jid)


def split_row_id(name: Column) -> tuple[Column, Column]:
    """(cluster, jid) of a row id; null where it begins with no known cluster."""
    cluster = reduce(lambda rest, c: F.when(name.startswith(f"{c}_"), c).otherwise(rest), CLUSTERS, F.lit(None).cast("string"))
    return cluster, F.when(cluster.isNotNull(), F.substr(name, F.length(cluster) + 2))


def read_sample(spark: SparkSession, path: str) -> DataFrame:
    """The ``row_id`` column of a sample submission, with its position in the file."""
    rows = spark.read.option("header", True).csv(path).select("row_id")
    indexed = rows.withColumn("__at", F.monotonically_increasing_id())
    return indexed.select("row_id", F.col("__at").alias("position"))


def write_submission(answers: DataFrame, path: str) -> None:
    """``row_id,failure_probability`` in order of ``position``, eight decimals, one file."""
    rows = answers.select("position", "row_id", F.format_string("%.8f", "failure_probability").alias("failure_probability"))
    rows.repartitionByRange(1, "position").sortWithinPartitions("position").drop("position").write.mode("overwrite").option("header", True).csv(path)


def zip_submission(csv_path: str, zip_path: str) -> None:
    """A ZIP that holds ``submission.csv`` alone, opened again to check that."""
    with zipfile.ZipFile(zip_path, "w", zipfile.ZIP_DEFLATED) as out:
        out.write(csv_path, "submission.csv")
    with zipfile.ZipFile(zip_path) as back:
        if back.namelist() != ["submission.csv"] or back.testzip():
            raise ValueError("the archive does not hold submission.csv alone")


def read_json(spark: SparkSession, path: str) -> dict | None:
    """The object in a small JSON file, on whatever file system it is; None where there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Writes an object as a small JSON file, on whatever file system it is."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    finally:
        out.close()


def rename_parts(spark: SparkSession, path: str, name: Callable[[int], str]) -> None:
    """Renames the part files of a table, in order, as ``name`` says; the folder's other files stay."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts = sorted(f.getPath().getName() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for k, part in enumerate(parts):
        system.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}"), spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name(k)}"))


def update_report(spark: SparkSession, path: str, cluster: str, values: dict) -> dict:
    """Adds a cluster's values to a JSON report and returns the whole."""
    report = (read_json(spark, path) or {}) | {cluster: values}
    write_json(spark, path, report)
    return report
