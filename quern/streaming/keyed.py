"""Streams with keyed state: the newest rows of a log, its last week by day, and a feed of changes to documents.

Keys are cut into shards, so a busy day or the whole log is dealt over several tasks; readers merge the shards' small rows. Every sink
writes over what a repeated micro-batch wrote before.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import catalog
from ..operators.chunking import chunk_corpus
from ..sources import clustered
from ..sources.shared import discard, stored
from .jobs import stream_table

CHANGES = "document_id long, version long, deleted boolean, text string, ts timestamp"
_NEWEST = "shard int, id long, response_time double, micros long"
_DAYS = "day date, shard int, n long"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_DAY_MS = 86_400_000


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """View events of a folder as a streamed log: id, response_time, ts."""
    events = stream_table(spark, folder, "events", "event_id long, ts timestamp_ntz, event_type string, value double")
    return events.filter("event_type = 'view'").select(F.col("event_id").alias("id"), F.col("value").alias("response_time"), F.col("ts").cast("timestamp").alias("ts"))


class Newest(StatefulProcessor):
    """Keeps a shard's newest rows and gives them all out whenever some came in."""

    def __init__(self, rows: int):
        self.rows = rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "id long", "micros long, response_time double")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = {k[0]: (v[0], v[1]) for k, v in self.kept.iterator()}
        before = set(held)
        for r in rows:
            held[r["id"]] = (r["micros"], r["response_time"])
            if len(held) > 4 * self.rows:
                held = self.best(held)
        held = self.best(held)
        for gone in before - held.keys():
            self.kept.removeKey((gone,))
        for one, value in held.items():
            self.kept.updateValue((one,), value)
            yield Row(shard=key[0], id=one, response_time=value[1], micros=value[0])

    def best(self, held: dict) -> dict:
        return dict(sorted(held.items(), key=lambda x: (x[1][0], x[0]), reverse=True)[: self.rows])

    def close(self) -> None:
        pass


class DayCount(StatefulProcessor):
    """Counts the rows of a day's shard; a timer drops the count once the watermark has left the week."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.count.get() if self.count.exists() else None
        if held is None:
            start = int(dt.datetime.combine(key[0], dt.time(), dt.timezone.utc).timestamp() * 1000)
            self.handle.registerTimer(start + (self.days + 1) * _DAY_MS)
        n = (held[0] if held else 0) + sum(1 for _ in rows)
        self.count.update((n,))
        yield Row(day=key[0], shard=key[1], n=n)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        self.count.clear()
        return iter(())

    def close(self) -> None:
        pass


def _to_end(stream: DataFrame, path: str, checkpoint: str, *parts: str) -> None:
    """Hand all that is there now to a table, each micro-batch writing over the parts it has rows of. Started again, it goes on where it stopped."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, _ROCKS)
    try:
        stream.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(name, before) if before else conf.unset(name)


def keep_newest(log: DataFrame, path: str, checkpoint: str, rows: int = 1000, shards: int = 8) -> None:
    """Keep up the newest ``rows`` rows of each shard of a streamed log (id, response_time, ts) in the table at ``path``; an id that comes twice counts once."""
    keyed = log.select("id", "response_time", F.unix_micros("ts").alias("micros"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard")).filter("micros IS NOT NULL").groupBy("shard")
    _to_end(keyed.transformWithState(Newest(rows), _NEWEST, "Update", "None"), path, checkpoint, "shard")


def newest(spark: SparkSession, path: str, rows: int = 1000) -> DataFrame:
    """The newest rows of the log that ``keep_newest`` keeps up, by time, then id."""
    kept = spark.read.schema(_NEWEST).parquet(path).select("id", "response_time", F.timestamp_micros("micros").alias("ts"))
    return catalog.newest(kept, rows)


def keep_week(log: DataFrame, path: str, checkpoint: str, late: str = "7 days", days: int = 7, shards: int = 8) -> None:
    """Keep up the counts of each day of a streamed log in the table at ``path``; rows later than ``late`` behind the newest are dropped."""
    placed = log.withWatermark("ts", late).withColumns({"day": F.to_date("ts"), "shard": F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")})
    _to_end(placed.groupBy("day", "shard").transformWithState(DayCount(days), _DAYS, "Update", "EventTime"), path, checkpoint, "day", "shard")


def week(spark: SparkSession, path: str, days: int = 7) -> DataFrame:
    """day, label (M/D) and n of the last days up to the newest in the table that ``keep_week`` keeps up, days without rows included."""
    counts = spark.read.schema(_DAYS).parquet(path).groupBy("day").agg(F.sum("n").alias("n"))
    last = counts.agg(F.max("day").alias("last")).filter("last IS NOT NULL")
    calendar = last.select(F.explode(F.sequence(F.date_sub("last", days - 1), "last")).alias("day"))
    return calendar.join(counts, "day", "left").select("day", F.concat_ws("/", F.month("day"), F.dayofmonth("day")).alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def apply_changes(changes: DataFrame, path: str, checkpoint: str, late: str = "1 hour", strategy: str = "paragraphs", buckets: int = 16) -> None:
    """Bring streamed changes of documents (document_id, version, deleted, text, ts) into the clustered tables documents and chunks under ``path``.

    A change counts if its version is above the one the table holds, so order does not matter and a change that comes again, or a batch that runs again,
    alters nothing. Repeats within ``late`` are dropped before any table is read. A new text replaces all chunks of its document; a deletion
    removes them and leaves the document's version behind.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        last = rows.groupBy("document_id").agg(F.max(F.struct("version", "deleted", "text")).alias("change")).select("document_id", "change.*").filter("document_id IS NOT NULL")
        if clustered.exists(spark, f"{path}/documents"):
            held = clustered.lookup_all(spark, f"{path}/documents", last.select("document_id")).select("document_id", F.col("version").alias("held"))
            last = last.join(held, "document_id", "left").filter("held IS NULL OR version > held").drop("held")
        fresh, folder = stored(last)
        chunks = chunk_corpus(fresh.filter("NOT deleted").select("document_id", "text"), strategy=strategy)
        # versions last: a batch that is cut off before them is done again in full
        for name, new in (("chunks", chunks), ("documents", fresh.select("document_id", "version", "deleted"))):
            if clustered.exists(spark, f"{path}/{name}"):
                clustered.replace(spark, f"{path}/{name}", fresh.select("document_id"), new)
            else:
                clustered.create(new, f"{path}/{name}", buckets=buckets)
        discard(spark, folder)

    distinct = changes.withWatermark("ts", late).dropDuplicatesWithinWatermark(["document_id", "version"])
    distinct.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
