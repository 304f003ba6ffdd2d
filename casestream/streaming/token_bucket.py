"""The dual token bucket over a stream: one state row for each client, kept in the state store."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.limits import HOUR, SHORT, STATE, Bucket, step

OUT = "key string, event_id bigint, allowed boolean, reason string, retry_after_ms bigint"


class BucketProcessor(StatefulProcessor):
    """Folds a client's requests in time order inside each batch. A client that has been idle for both refill
    periods has full buckets, as a new one has: with `expire` a timer then takes its state away."""

    def __init__(self, hour: Bucket, short: Bucket, expire: bool, idle_ms: int | None = None):
        self.hour, self.short, self.expire = hour, short, expire
        self.idle_ms = max(hour.period_ms, short.period_ms) if idle_ms is None else idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("buckets", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.state.get()  # null for a new client: one call instead of two
        todo = sorted(((r.now, r.event_id) for r in rows), key=lambda r: (r[0], r[1] is None, r[1]))
        for now, event_id in todo:
            state, ok, reason, retry = step(state, now, self.hour, self.short)
            yield Row(key=key[0], event_id=event_id, allowed=ok, reason=reason, retry_after_ms=retry)
        self.state.update(state)
        if self.expire:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def token_bucket_stream(events: DataFrame, key: str, hour: Bucket = HOUR, short: Bucket = SHORT, ts: str = "ts", event_id: str = "event_id", expire: bool = True, idle_ms: int | None = None) -> DataFrame:
    """A streaming DataFrame of verdicts. Order holds inside a micro-batch; a late event is
    judged when it comes, as a server would. `expire` drops idle clients' state (after `idle_ms`, by default the
    longer refill period), for queries that run on; those that take what is there and stop have no clock to expire by."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(event_id).alias("event_id"), F.unix_millis(F.col(ts).cast("timestamp")).alias("now"))
    return rows.groupBy("key").transformWithState(BucketProcessor(hour, short, expire, idle_ms), outputStructType=OUT, outputMode="Append", timeMode="ProcessingTime" if expire else "None")


def bucket_states(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(key, hour_tokens, hour_last, five_tokens, five_last): the buckets of every client as the last batch left them, read from
    the state store that a query keeps under its checkpoint."""
    held = spark.read.format("statestore").option("stateVarName", "buckets").load(checkpoint)
    return held.select("key.key", "value.*")
