"""Corpus-wide line deduplication over levelled sorted runs of line hashes.

A run is a table of the line keys first seen in some batches, bucketed and sorted by hash. A
batch's keys are anti-joined with each run by merging, what is left becomes a run of level 0,
and ``fanout`` runs of a level are merged into one of the next. All of it is DataFrame code.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import discard, materialise, new_path, remove, unused

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
MERGED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends and with A-Z lower-cased."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def line_table(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, text_hash, pos, h1, h2) of every line; the hashes are null for keys under ``min_chars``.

    ``h1`` and ``h2`` are XXH64 of the key under two seeds, 128 bits together.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = rows.select("id", "text_hash", "pos", line_key(F.col("line")).alias("key"))
    long = F.length("key") >= min_chars
    return keyed.select("id", "text_hash", "pos", F.when(long, F.xxhash64("key")).alias("h1"), F.when(long, F.xxhash64(F.lit("second"), "key")).alias("h2"))


class LineRuns:
    """The keys seen so far, each with the id that owns it, as levels of sorted runs."""

    def __init__(self, spark: SparkSession, fanout: int = 2) -> None:
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def read(self) -> DataFrame:
        """(h1, h2, owner): every key once."""
        return reduce(DataFrame.union, [self.spark.table(name) for name in self.runs()])

    def add(self, lines: DataFrame) -> None:
        """Takes in a batch of ``line_table`` rows; its ids must come after those of all earlier batches."""
        keys = lines.filter("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("owner"))
        for name in self.runs():
            keys = keys.join(self.spark.table(name).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        self._write(keys, 0)
        self._compact()

    def _write(self, keys: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        path = new_path(self.spark, "line-run")
        before = self.spark.conf.get(MERGED)
        self.spark.conf.set(MERGED, "true")
        try:
            keys.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).option("compression", "zstd").saveAsTable(name, format="parquet")
        finally:
            self.spark.conf.set(MERGED, before)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _merged(self, one: str, other: str) -> DataFrame:
        """Two runs as one: they are sorted, dealt alike and share no key, so a full merge join reads both in order."""
        x, y = self.spark.table(one).alias("x"), self.spark.table(other).alias("y").hint("merge")
        both = x.join(y, (F.col("x.h1") == F.col("y.h1")) & (F.col("x.h2") == F.col("y.h2")), "full")
        return both.select(*[F.coalesce(f"x.{c}", f"y.{c}").alias(c) for c in ("h1", "h2", "owner")])

    def _compact(self) -> None:
        """Merges the runs of every full level into one run of the next, two at a time."""
        for level in range(60):
            if level >= len(self.levels) or len(self.levels[level]) < self.fanout:
                return
            while len(self.levels[level]) > 1:
                one, other = self.levels[level][:2]
                last = len(self.levels[level]) == 2
                self._write(self._merged(one, other), level + 1 if last else level)
                for name in (one, other):
                    self.levels[level].remove(name)
                    self._drop(name)

    def _drop(self, name: str) -> None:
        path = self.spark.sql(f"DESCRIBE FORMATTED {name}").filter("col_name = 'Location'").first()[1]
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, path)

    def drop(self) -> None:
        for name in self.runs():
            self._drop(name)
        self.levels = [[]]


def batch_bounds(docs: DataFrame, id_col: str, batches: int, sample: int = 1000) -> list:
    """Ids that cut ``docs`` into about equal ranges: quantiles of numbers, of other ids those of ``sample`` chosen by hash."""
    if batches < 2:
        return []
    kind = docs.schema[id_col].dataType
    if isinstance(kind, T.NumericType):
        cuts = docs.agg(F.percentile_approx(id_col, [k / batches for k in range(1, batches)], 1000)).first()[0]
        return sorted(set(cuts or []))
    some = docs.select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(sample)
    ids = [r.id for r in some.orderBy("id").collect()]
    return list(dict.fromkeys(ids[k * len(ids) // batches] for k in range(1, batches))) if ids else []


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, plus ``n_lines`` and ``n_dropped``.

    Text is split at ``\\n`` (null and empty: one empty line). A key (see ``line_key``) of at
    least ``min_chars`` code points that several documents hold loses its lines in all but the
    smallest id; inside that document all its lines stay. Rows that share an id are one
    document. A null id comes after all others. Columns of ``docs`` named ``n_lines`` or
    ``n_dropped`` are replaced; the rest pass through. An empty table gives no rows.

    The table is taken in as ``batches`` ranges of ids. No row stands for more than one line
    and a key is reduced to one row before it is joined, so a line that every document holds
    weighs no more than any other.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType
    bounds = batch_bounds(docs, id_col, batches)
    lines = materialise(line_table(docs, id_col, text_col, min_chars), "lines")
    bare = docs.drop("n_lines", "n_dropped")
    own, of_text, hashed, keep = (unused(bare, f"__{n}") for n in ("id", "text_hash", "hash", "keep"))
    runs = LineRuns(spark, fanout)
    try:
        at = F.col("id")
        edges = [None, *bounds, None]
        for low, high in zip(edges, edges[1:], strict=False):
            batch = lines
            if low is not None:
                batch = batch.filter((at > low) | at.isNull()) if high is None else batch.filter(at > low)
            if high is not None:
                batch = batch.filter(at <= high)
            runs.add(batch)
        owned = runs.read().select("h1", "h2", F.col("owner").alias("__owner"), F.lit(True).alias("owns"))
        same = (lines["h1"] == owned["h1"]) & (lines["h2"] == owned["h2"]) & lines["id"].eqNullSafe(owned["__owner"])
        flagged = lines.join(owned, same, "left").select("id", "text_hash", "pos", (lines["h1"].isNull() | F.col("owns").isNotNull()).alias("keep"))
        per_text = flagged.groupBy("id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("pos", "keep"))).alias("flags"))
        flags = materialise(per_text.select(F.col("id").cast(kind).alias(own), F.col("text_hash").alias(of_text), F.col("flags.keep").alias(keep)), "line-flags")
    finally:
        runs.drop()
    discard(lines)
    text = F.coalesce(F.col(text_col), F.lit(""))
    joined = bare.withColumn(hashed, F.xxhash64(text)).join(flags.hint("merge"), F.col(id_col).eqNullSafe(F.col(own)) & (F.col(hashed) == F.col(of_text)))
    dropped = F.size(F.filter(keep, lambda k: ~k)).cast("long")
    kept = F.array_join(F.zip_with(F.split(text, "\n", -1), F.col(keep), lambda line, k: F.when(k, line)), "\n")
    out = [F.when(dropped == 0, text).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in bare.columns]
    return joined.select(*out, F.size(keep).cast("long").alias("n_lines"), dropped.alias("n_dropped"))
