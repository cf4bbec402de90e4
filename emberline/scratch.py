"""Intermediate tables in the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Where that is unset and the master is
local (tests), a temporary folder is made; on any other master it is an error, since a
machine-local folder would not be seen by the executors. All that a session writes lies below
one folder of its own, which is removed when the driver's process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_used: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, without a trailing slash."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="emberline-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return f"file://{_own['dir']}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    own = f"{shared_dir(spark)}/emberline-{spark.sparkContext.applicationId}"
    if own not in _used:
        _used[own] = spark
        atexit.register(_clear, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _clear(path: str) -> None:
    try:
        remove(_used[path], path)
    except Exception:  # noqa: BLE001  the session is gone, and what it wrote is left to the platform
        return


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns it read back, so its lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that ``materialise`` returned; nothing may read them afterwards."""
    for table in tables:
        remove(table.sparkSession, table._scratch)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path on whatever file system it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
