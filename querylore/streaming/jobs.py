"""Incremental forms of batch operators. Input are folders that files arrive in; each job stops when it has read them all."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import StructType

from querylore.operators import states as A
from querylore.operators.feedback import training_rows
from querylore.operators.querylog import extract_sql
from querylore.sources.stores import BUCKETS, KeyedTable


def arriving(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def incremental_training(feedback: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Training rows of arriving feedback, and a log row per batch, source and company.

    The projection keeps no state. A batch writes to folders of its own number, so a batch that is run again after a
    failure replaces what it wrote before.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            rows.write.mode("overwrite").parquet(f"{folder}/training/batch={number}")
            counted = rows.groupBy("kb_id", "company_id").agg(F.count("*").alias("processed"))
            counted.write.mode("overwrite").parquet(f"{folder}/log/batch={number}")
        finally:
            rows.unpersist()

    return (
        training_rows(feedback).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def first_requests(requests: DataFrame, folder: str, checkpoint: str, ttl: str = "1 hour") -> StreamingQuery:
    """Requests less those repeated within ``ttl``. A key is forgotten when the watermark passes it, so it can be held
    longer than in the batch operator, never shorter."""
    kept = requests.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(["request_key"])
    return kept.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SPAN = 86_400  # seconds of one entry of the state
BEFORE_ALL = -(1 << 62)


def chain_marks(seconds: np.ndarray, free: int, ttl: int) -> tuple[np.ndarray, int]:
    """Which of the ascending seconds compute when nothing may before ``free``, and when something may again after them."""
    computed = np.zeros(len(seconds), np.int64)
    at = int(np.searchsorted(seconds, free))
    while at < len(seconds):
        computed[at], free = 1, int(seconds[at]) + ttl
        at = int(np.searchsorted(seconds, free))
    return computed, free


class ReuseChain(StatefulProcessor):
    """The computed and reused seconds of one key. State is a map from spans of time to the span's entry (when it may compute again) and its
    seconds. A batch changes the spans it has rows for, and those behind them as far as their entries change; rows whose mark is new or other than
    before are given out. A timer takes spans that the watermark has passed out of the state and keeps only where their chain leaves."""

    def __init__(self, ttl: int):
        self.ttl, self.span = ttl, max(SPAN, ttl)

    def init(self, handle) -> None:
        self.handle = handle
        self.spans = handle.getMapState("spans", "span bigint", "entry bigint, seconds array<bigint>")
        self.settled = handle.getValueState("settled", "span bigint, free bigint")

    def handleInputRows(self, key, rows, timerValues):
        arrived = np.unique(np.concatenate([frame["second"].to_numpy(np.int64) for frame in rows]))
        number = arrived // self.span
        done, free = self.settled.get() if self.settled.exists() else (BEFORE_ALL, BEFORE_ALL)
        known = sorted(int(k[0]) for k in self.spans.keys())
        touched = {int(n) for n in np.unique(number) if n > done}  # later rows than the watermark allows are left out
        seconds_out, marks_out = [], []
        for span in sorted({*known, *touched}):
            held = self.spans.containsKey((span,))
            entry, old = self.spans.getValue((span,)) if held else (None, [])
            old = np.asarray(old, np.int64)
            if span not in touched and entry == free:
                _, free = chain_marks(old, free, self.ttl)
                continue
            new = np.union1d(old, arrived[number == span])
            marks, leaves = chain_marks(new, free, self.ttl)
            before = np.full(len(new), -1, np.int64)
            if held:
                before[np.searchsorted(new, old)] = chain_marks(old, entry, self.ttl)[0]
            else:
                self.handle.registerTimer((span + 1) * self.span * 1000)
            self.spans.updateValue((span,), (int(free), new.tolist()))
            changed = marks != before
            seconds_out.append(new[changed])
            marks_out.append(marks[changed])
            free = leaves
        if seconds_out:
            yield pd.DataFrame({"request_key": key[0], "second": np.concatenate(seconds_out), "computed": np.concatenate(marks_out)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        span = int(expiredTimerInfo.getExpiryTimeInMs()) // 1000 // self.span - 1
        for old in sorted(int(k[0]) for k in self.spans.keys()):
            if old <= span:
                entry, seconds = self.spans.getValue((old,))
                _, free = chain_marks(np.asarray(seconds, np.int64), entry, self.ttl)
                self.settled.update((old, free))
                self.spans.removeKey((old,))
        yield from ()

    def close(self) -> None:
        pass


def reused_requests(requests: DataFrame, folder: str, checkpoint: str, ttl: int = 3600, delay: str = "1 hour") -> StreamingQuery:
    """The batch operator's rule on a stream: whether a key's second computes or reuses an answer computed less than ``ttl`` seconds before. Reuse
    does not extend an answer's life. Requests (request_key, ts) may come in any order and in any batches, up to ``delay`` late; marks that a
    late row changes are given out again, so ``latest_state`` by key and second has what the batch operator says. State is kept for ``delay`` and a span."""
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    timed = requests.withWatermark("ts", delay).select("request_key", "ts", F.unix_seconds("ts").alias("second"))
    marks = timed.groupBy("request_key").transformWithStateInPandas(
        ReuseChain(ttl), outputStructType="request_key string, second bigint, computed bigint", outputMode="Update", timeMode="EventTime")
    return _upsert(marks, folder, checkpoint)


def _upsert(changes: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the changed rows of every batch under its number."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_state(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The newest version of every key among the changes of all batches."""
    changes = spark.read.parquet(folder)
    values = [c for c in changes.columns if c not in [*keys, "batch"]]
    newest = F.max_by(F.struct(*values), "batch").alias("newest")
    return changes.groupBy(*keys).agg(newest).select(*keys, "newest.*")


def running_analytics(messages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Use count, first and last time per company and question."""
    asked = messages.filter("message_type = 'user'").groupBy("company_id", F.md5("content").alias("question_hash"))
    changes = asked.agg(F.count("*").alias("use_count"), F.min("created_at").alias("first_used"), F.max("created_at").alias("last_used"))
    return _upsert(changes, folder, checkpoint)


def hourly_analytics(messages: DataFrame, folder: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Messages per company and hour; state of hours that lie ``delay`` behind is dropped."""
    hour = F.window("created_at", "1 hour").alias("hour")
    counts = messages.withWatermark("created_at", delay).groupBy("company_id", hour).agg(F.count("*").alias("messages"))
    return _upsert(counts.select("company_id", F.col("hour.start").alias("hour_start"), "messages"), folder, checkpoint)


def _growing(rows: DataFrame, state: Callable, merged: Callable, keys: list[str], path: str, buckets: int) -> StreamingQuery:
    """Merges the state of every batch into a keyed table. The checkpoint lies in the table's folder, as batch numbers mean nothing without it."""
    KeyedTable.open(rows.sparkSession, path, state(rows).schema, keys, buckets)

    def write(batch: DataFrame, number: int) -> None:
        new = state(batch).persist()
        try:
            KeyedTable(batch.sparkSession, path).merge(new, merged, number)
        finally:
            new.unpersist()

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/_checkpoint").trigger(availableNow=True).start()


def growing_catalog(files: DataFrame, path: str, buckets: int = BUCKETS) -> StreamingQuery:
    """The unique queries of all files so far, from a stream of query files; files of earlier batches are not read again."""
    return _growing(files, lambda batch: A.query_state(extract_sql(batch)), A.merged_queries, A.CATALOG_KEYS, path, buckets)


def growing_sales(counted: DataFrame, path: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Sales states of days from a stream of counted orders, each of which arrives once."""
    return _growing(counted, A.sales_state, A.merged_sales, A.SALES_KEYS, path, buckets)
