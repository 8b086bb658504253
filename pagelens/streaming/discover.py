"""Image references of responses as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagelens.config import ScopeConfig
from pagelens.extract import columns as X
from pagelens.operators import policy
from pagelens.operators.ordered import first_by
from pagelens.operators.politeness import BAD_STATUSES
from pagelens.schema import RESPONSE


def responses(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(RESPONSE).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def image_refs(stream: DataFrame, scope: ScopeConfig) -> DataFrame:
    """`url, kind, context, page_url, skip_reason` of HTML responses, batch or stream."""
    pages = stream.filter((F.col("status") == 200) & policy.is_html(F.col("content_type"), F.col("body")))
    found = pages.select(F.col("url").alias("page_url"), X.html_refs(X.decode(F.col("body"), F.col("content_type")), F.col("url")).alias("h"))
    refs = found.select("page_url", F.explode_outer("h.images").alias("r")).filter("r is not null").select("r.url", "r.kind", "r.context", "page_url")
    return refs.withColumn("skip_reason", policy.image_reason(F.col("url"), scope))


def append_new(batch: DataFrame, batch_id: int, table: str) -> None:
    """Appends the URLs of a micro-batch that the table lacks. A batch that is repeated replaces its own part, so nothing is doubled."""
    spark = batch.sparkSession
    try:
        known = spark.read.parquet(table).filter(F.col("batch") < batch_id).select("url")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        known = spark.createDataFrame([], "url string")
    fresh = first_by(batch, ["url"], ["page_url", "kind"]).join(known, "url", "left_anti")
    fresh.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")


def run_available(stream: DataFrame, table: str, checkpoint: str) -> None:
    """Takes in all that is there now."""
    q = stream.writeStream.foreachBatch(lambda df, i: append_new(df, i, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


class _Streaks(StatefulProcessor):
    """The streak, the interval and the block of a host. Requests wait in slots of event time, each with a timer of its own, and
    are taken in order once the watermark has passed their slot; so what is held of a host is what is late, not a micro-batch."""

    def __init__(self, max_streak: int, interval: float, cap: float, slot_ms: int):
        self.max_streak, self.interval, self.cap, self.slot_ms = max_streak, float(interval), cap, slot_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "streak int, every double, blocked boolean")
        self.waiting = handle.getMapState("waiting", "slot long", "rows array<struct<at:long,seq:long,status:int>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new: dict[int, list] = {}
        for r in rows:
            at = int(r.at.timestamp() * 1000)
            new.setdefault(at // self.slot_ms, []).append((at, r.seq, r.status))
        for slot, own in new.items():
            if self.waiting.containsKey((slot,)):
                own = [tuple(x) for x in self.waiting.getValue((slot,))[0]] + own
            else:
                self.handle.registerTimer((slot + 1) * self.slot_ms)
            self.waiting.updateValue((slot,), (own,))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        slot = expiredTimerInfo.getExpiryTimeInMs() // self.slot_ms - 1
        streak, every, blocked = self.at.get() if self.at.exists() else (0, self.interval, False)
        for at, seq, status in sorted(tuple(x) for x in self.waiting.getValue((slot,))[0]):
            streak = streak + 1 if status in BAD_STATUSES else 0
            if streak and streak % 3 == 0:
                every = min(every * 2, self.cap)
            blocked = blocked or streak >= self.max_streak
            yield Row(host=key[0], seq=seq, streak=streak, interval=every, blocked=blocked)
        self.waiting.removeKey((slot,))
        self.at.update((streak, every, blocked))

    def close(self) -> None:
        pass


def host_streaks(log: DataFrame, max_streak: int = 15, interval: float = 1.0, cap: float = 60.0, slot: float = 60.0) -> DataFrame:
    """A row for each request of a streamed log `(host, at, seq, status)` with a watermark on `at`: its host's streak of bad statuses, interval and block, in the
    order of (at, seq), kept as state across micro-batches. A row comes once the watermark has passed its slot of `slot` seconds.

    The state needs the RocksDB provider (`spark.sql.streaming.stateStore.providerClass`)."""
    out = "host string, seq long, streak int, interval double, blocked boolean"
    processor = _Streaks(max_streak, interval, cap, int(slot * 1000))
    return log.groupBy("host").transformWithState(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")


def distinct_urls(stream: DataFrame, at: str, lateness: str) -> DataFrame:
    """A URL feed with repeats inside the watermark dropped; an addition for feeds that never end."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark(["url"])
