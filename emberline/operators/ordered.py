"""Places and running totals over an order, without bringing a group's rows into one task.

Rows are dealt to tasks by ranges of the order, once, and kept; each task numbers or sums its own,
and the totals of the tasks before it, one small row for each task and group, are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberline.scratch import materialise

SMALL = 200_000  # rows of per-task totals that may be broadcast


def _ranged(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``rows`` dealt by ranges of group and order, and sorted so within each task, with their ``__id``."""
    keys = [*[F.col(g).asc_nulls_first() for g in group], *order]
    return materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id()), "ranged")


def _before(totals: DataFrame, group: list[str], names: list[str]) -> DataFrame:
    """Per task and group what the group's rows in the tasks before add up to, and in all (``__all_``)."""
    earlier = W.partitionBy(*group).orderBy("__task").rowsBetween(W.unboundedPreceding, -1)
    of_group = W.partitionBy(*group)
    sums = {f"__before_{n}": F.coalesce(F.sum(n).over(earlier), F.lit(0)) for n in names}
    return materialise(totals.withColumns(sums | {f"__all_{n}": F.sum(n).over(of_group) for n in names}), "totals")


def _joined(rows: DataFrame, offsets: DataFrame, group: list[str]) -> DataFrame:
    """``rows`` with their task's and group's offsets; these are broadcast if they are found to be few."""
    own = offsets.select(*[F.col(c).alias(f"__o_{c}") if c in ("__task", *group) else F.col(c) for c in offsets.columns])
    same = F.col("__task") == F.col("__o___task")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__o_{g}"))
    few = offsets.count() <= SMALL
    return rows.join(F.broadcast(own) if few else own, same).drop("__o___task", *[f"__o_{g}" for g in group])


def placed(rows: DataFrame, group: list[str], order: list[Column], place: str, size: str | None = None) -> DataFrame:
    """Adds each row's ``place`` from 0 in its group, by ``order``, and the group's ``size``.

    ``order`` must end in a key, or which of equal rows comes first is left open. A value that most rows share
    is split among tasks by the keys after it.
    """
    task, first = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    ranged = _ranged(rows, group, order).withColumns({"__task": task, "__place": first})
    totals = ranged.groupBy("__task", *group).agg(F.count("*").alias("__n"), F.min("__place").alias("__first"))
    joined = _joined(ranged, _before(totals, group, ["__n"]), group)
    out = joined.withColumn(place, F.col("__before___n") + F.col("__place") - F.col("__first"))
    out = out.withColumn(size, F.col("__all___n")) if size else out
    return out.drop("__id", "__task", "__place", "__first", "__n", "__before___n", "__all___n")


def running(rows: DataFrame, group: list[str], order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Adds each of ``values`` summed over the group's rows up to and with the own one, by ``order``."""
    ranged = _ranged(rows, group, order).withColumn("__task", F.shiftright("__id", 33))
    totals = ranged.groupBy("__task", *group).agg(*[F.sum(v).alias(n) for n, v in values.items()])
    offsets = _before(totals, group, list(values)).drop(*values, *[f"__all_{n}" for n in values])
    inside = W.partitionBy("__task", *group).orderBy("__id").rowsBetween(W.unboundedPreceding, 0)
    joined = _joined(ranged, offsets, group)
    out = joined.withColumns({n: F.col(f"__before_{n}") + F.sum(v).over(inside) for n, v in values.items()})
    return out.drop("__id", "__task", *[f"__before_{n}" for n in values])
