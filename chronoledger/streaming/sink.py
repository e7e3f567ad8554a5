"""The streaming ledger: spool files in, a deduplicated and gaplessly sequenced
Parquet ledger out.

Each micro-batch is one directory, written by overwrite, beside a manifest of
the sequences it took.  A batch that is tried again finds the manifest of its
predecessor unchanged and writes the very same rows, so a retry neither skips
nor reuses a sequence.  Deduplication asks the ledger's keys and its tombstones:
events may come late without bound, so no state in the stream could be enough.
The keys are indexed by a prefix of their hash, so a small batch reads the
partitions of its own keys only, and `compact` merges what past batches wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.detect import after_capture_horizon
from ..operators.ledger import fresh_records, next_high_water, sequenced, violations

#: Partitions of the key index.
PREFIXES = 256


def _prefix() -> Column:
    return F.pmod(F.xxhash64("dedup_key"), F.lit(PREFIXES)).cast("int").alias("prefix")


class LedgerSink:
    """An append target for foreachBatch under `path`.

    tombstones: gives the table of pruned events (dedup_key), which are not
    appended again.  envelope: the column of envelopes to be validated; rows
    that break a rule go to `rejects` with what is wrong and take no sequence.
    horizon: polled events from before it are dropped.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, tombstones: Callable[[], DataFrame] | None = None, envelope: str | None = None, horizon: float | None = None):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.tombstones, self.envelope, self.horizon = tombstones, envelope, horizon

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self, folder: str, label: str) -> list[int]:
        fs, path = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        if not fs.exists(path):
            return []
        named = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{label}=")]
        ok = [p for p in named if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix(f"{label}=")) for p in ok)

    def _batches(self) -> list[int]:
        return self._complete("high_water", "batch")

    def _read(self, folder: str, before: int | None, schema: str) -> DataFrame:
        batches = [b for b in self._batches() if before is None or b < before]
        paths = [f"{self.path}/{folder}/batch={b}" for b in batches]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self, before: int | None = None) -> DataFrame:
        """All appended events, or those of batches before a batch."""
        return self._read("events", before, f"{self.schema}, producer_sequence bigint")

    def rejects(self) -> DataFrame:
        """Rows that were not valid, with `violations`."""
        return self._read("rejects", None, f"{self.schema}, violations array<string>")

    def high_water(self, before: int | None = None) -> DataFrame:
        batches = [b for b in self._batches() if before is None or b < before]
        if not batches:
            return self.spark.createDataFrame([], "installation_id string, high bigint")
        return self.spark.read.parquet(f"{self.path}/high_water/batch={batches[-1]}")

    def _keys(self, before: int, prefixes: list[int] | None = None) -> DataFrame:
        """(dedup_key) of all batches before a batch, of some prefixes or of all.
        Only the folders of these prefixes are listed and read."""
        merged = [u for u in self._complete("keys", "upto") if u < before][-1:]
        later = [b for b in self._batches() if b < before and (not merged or b > merged[0])]
        parts = [f"{self.path}/keys/upto={u}" for u in merged] + [f"{self.path}/keys/batch={b}" for b in later]
        some = "*" if prefixes is None else "{" + ",".join(map(str, prefixes)) + "}"
        found = [] if prefixes == [] else [s.getPath().toString() for part in parts for s in self._fs().globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{part}/prefix={some}")) or []]
        schema = "dedup_key string"
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*found) if found else self.spark.createDataFrame([], schema)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        """Appends the new events of one micro-batch.  batch: installation_id,
        arrival, dedup_key and what else the schema has."""
        if self.horizon is not None:
            batch = batch.filter(after_capture_horizon(F.col("capture_method"), F.col("occurred_at"), self.horizon))
        if self.envelope is not None:
            told = batch.withColumn("violations", violations(F.col(self.envelope)))
            told.filter(F.size("violations") > 0).write.mode("overwrite").parquet(f"{self.path}/rejects/batch={batch_id}")
            batch = told.filter(F.size("violations") == 0).drop("violations")
        mine = [r[0] for r in batch.select(_prefix()).distinct().collect()]  # at most PREFIXES numbers
        known = self._keys(batch_id, mine)
        marks = self.high_water(batch_id)
        pruned = [] if self.tombstones is None else [self.tombstones()]
        target = f"{self.path}/events/batch={batch_id}"
        sequenced(fresh_records(batch, known, *pruned), marks).write.mode("overwrite").parquet(target)
        new = self.spark.read.schema(f"{self.schema}, producer_sequence bigint").parquet(target)
        new.select("dedup_key", _prefix()).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/keys/batch={batch_id}")
        # The manifest comes last: without it the batch has not happened.
        next_high_water(marks, new).write.mode("overwrite").parquet(f"{self.path}/high_water/batch={batch_id}")

    def compact(self) -> None:
        """Merges the keys of all batches but the newest, which may be tried again."""
        batches = self._batches()
        if len(batches) < 2 or batches[-2] in self._complete("keys", "upto"):
            return
        self._keys(batches[-1]).withColumn("prefix", _prefix()).repartition("prefix").write.mode("overwrite").partitionBy("prefix").parquet(f"{self.path}/keys/upto={batches[-2]}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def source_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Events by type that a pass appended."""
    return after.join(before.select("producer_sequence"), "producer_sequence", "left_anti").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))
