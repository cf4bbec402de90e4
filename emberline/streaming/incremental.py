"""Accumulators kept up to date from a stream of readings.

What a stream carries over between micro-batches are the window's readings of the jobs whose window
is still open, each reading once, so a reading sent twice counts once. A job is closed, its accumulators
written and its readings let go, when the latest reading seen is over a whole window past its anchor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberline.operators.accumulate import accumulators, window_rows
from emberline.plans.stages import exists
from emberline.schema import WINDOW
from emberline.scratch import remove
from emberline.sources.telemetry import read_json, write_json


class AccumulatorState:
    """Open readings and closed jobs below a path, by micro-batch; a batch that is retried writes the same again.

    ``chunk_start`` clamps starts as in a batch run. Readings of a job that was closed are late and dropped: by
    their start, or, without one, because the job is among the closed. Open readings of versions that no
    retry can ask for any more are removed.
    """

    def __init__(self, spark: SparkSession, path: str, chunk_start: float | None = None) -> None:
        self.spark, self.path, self.chunk_start = spark, path.rstrip("/"), chunk_start

    def _at(self, kind: str, version: int) -> str:
        return f"{self.path}/{kind}/v={version}"

    def _latest(self, version: int) -> float | None:
        return (read_json(self.spark, f"{self.path}/latest-{version}.json") or {}).get("latest") if version >= 0 else None

    def open(self, version: int) -> DataFrame:
        """The readings carried over after a micro-batch."""
        return self.spark.read.parquet(self._at("open", version))

    def closed(self) -> DataFrame | None:
        """The accumulators of all closed jobs; None before any batch."""
        return self.spark.read.parquet(f"{self.path}/closed").drop("v") if exists(self.spark, f"{self.path}/closed") else None

    def _before(self, version: int) -> list[str]:
        done = [self._at("closed", v) for v in range(version) if exists(self.spark, self._at("closed", v))]
        flushed = self._at("closed", 1 << 40)
        return done + [flushed] * exists(self.spark, flushed)

    def merge(self, batch: DataFrame, version: int) -> None:
        """Takes in a micro-batch; ``version`` counts them from 0."""
        before = self._latest(version - 1)
        rows = batch
        if before is not None:
            anchor = F.col("start_epoch") if self.chunk_start is None else F.greatest("start_epoch", F.lit(float(self.chunk_start)))
            rows = rows.filter(F.col("start_epoch").isNull() | (anchor + WINDOW >= before))
            done = self._before(version)
            if done:
                ids = self.spark.read.parquet(*done).filter("start_epoch IS NULL").select(F.col("jid").alias("__done")).distinct()
                rows = rows.join(ids, F.col("start_epoch").isNull() & (F.col("jid") == F.col("__done")), "left_anti")
            rows = rows.unionByName(self.open(version - 1).drop("anchor", "elapsed", "part"))
        seen = [x for x in (before, batch.agg(F.max("time_epoch")).first()[0]) if x is not None]
        latest = max(seen) if seen else None
        held = self._at("held", version)
        window_rows(rows, self.chunk_start).write.mode("overwrite").parquet(held)
        inside = self.spark.read.parquet(held)
        over = F.lit(False) if latest is None else F.col("anchor") + WINDOW < latest
        accumulators(inside.filter(over)).write.mode("overwrite").parquet(self._at("closed", version))
        inside.filter(~over).write.mode("overwrite").parquet(self._at("open", version))
        write_json(self.spark, f"{self.path}/latest-{version}.json", {"latest": latest})
        remove(self.spark, held)
        if version > 1:
            remove(self.spark, self._at("open", version - 2))
            remove(self.spark, f"{self.path}/latest-{version - 2}.json")

    def flush(self, version: int) -> DataFrame:
        """Closes all jobs still open after micro-batch ``version``, the last, and returns all accumulators."""
        accumulators(self.open(version)).write.mode("overwrite").parquet(self._at("closed", 1 << 40))
        return self.closed()


def accumulate_stream(readings: DataFrame, state: AccumulatorState, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merges a stream of prepared readings into ``state``, a version per micro-batch."""
    writer = readings.writeStream.foreachBatch(lambda batch, k: state.merge(batch, k)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(events: DataFrame, at: str = "ts", late: str = "30 minutes", width: str = "1 hour") -> DataFrame:
    """Readings per tumbling window and type, with a watermark for late ones; works on batch and stream alike."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "event_type", "n")
