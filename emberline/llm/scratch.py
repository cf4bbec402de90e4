"""What the operators share with the session: scratch tables, Arrow batch limits, free column names."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from emberline.scratch import discard, materialise, new_path, remove, shared_dir

__all__ = ["bound_batches", "discard", "materialise", "new_path", "remove", "shared_dir", "unused"]

UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def _reach(spark: SparkSession) -> None:
    """Lets Python workers on this file system import the package wherever the driver was started."""
    root, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths and os.path.isdir(root):
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def _bytes(size: str) -> int:
    """A size such as ``8m`` in bytes; none and negative ones are no limit."""
    found = re.fullmatch(r"(-?\d+)\s*([bkmgt]?)b?", size.strip().lower())
    n = int(found[1]) * UNITS[found[2]] if found else -1
    return n if n > 0 else 1 << 62


def bound_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Limits what one Arrow batch holds, unless the session already sets tighter limits.

    Batches are cut by rows *and* by bytes, so a run of very long texts stays bounded. Both are settings of the
    session, read when a query is planned, so they stay as the tightest that any operator asked for.
    """
    _reach(spark)
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    if _bytes(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) > _bytes(size):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
