"""Admission control: dual token buckets, fixed windows, a single-server queue."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bucket:
    """`tokens` at most, one more every `per_token_ms`."""

    tokens: int
    per_token_ms: int

    @property
    def period_ms(self) -> int:
        return self.tokens * self.per_token_ms


HOUR, SHORT = Bucket(1000, 3_600), Bucket(5, 1_000)
STATE = "hour_tokens bigint, hour_last bigint, five_tokens bigint, five_last bigint"
_VERDICT = "allowed boolean, reason string, retry_after_ms bigint"


def step(state: tuple[int, int, int, int] | None, now: int, hour: Bucket = HOUR, short: Bucket = SHORT):
    """(state, allowed, reason, retry after): one request at `now` (ms). Both buckets refill first;
    the hour is asked first. The times move only when a request passes, so a denied
    one leaves refilled tokens behind without moving them."""
    if state is None:
        state = (hour.tokens, now, short.tokens, now)
    h, h_last, s, s_last = state
    h_more, s_more = (now - h_last) // hour.per_token_ms, (now - s_last) // short.per_token_ms
    h = min(hour.tokens, h + h_more) if h_more > 0 else h
    s = min(short.tokens, s + s_more) if s_more > 0 else s
    if h <= 0:
        return (h, h_last, s, s_last), False, "hour", hour.period_ms - (now - h_last)
    if s <= 0:
        return (h, h_last, s, s_last), False, "5s", short.period_ms - (now - s_last)
    return (h - 1, now, s - 1, now), True, "ok", None


def token_bucket(events: DataFrame, key: str, hour: Bucket = HOUR, short: Bucket = SHORT, ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """Each event with allowed, reason and retry_after_ms. A client's events are folded in
    time order; rows stream through sorted partitions with one state in memory, so a busy
    client takes time but no room."""
    rows = events.select(F.col(key).alias("key"), F.col(event_id).alias("event_id"), F.unix_millis(F.col(ts).cast("timestamp")).alias("now"))
    dealt = rows.repartition("key").sortWithinPartitions("key", "now", "event_id")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, state, begun = None, None, False
        for batch in batches:
            out = []
            for k, now in zip(batch["key"], batch["now"], strict=True):
                if not begun or k != client:
                    begun, client, state = True, k, None
                state, ok, reason, retry = step(state, int(now), hour, short)
                out.append((ok, reason, retry))
            verdict = pd.DataFrame(out, columns=["allowed", "reason", "retry_after_ms"])
            verdict["retry_after_ms"] = verdict["retry_after_ms"].astype("Int64")
            yield pd.concat([batch[["key", "event_id"]].reset_index(drop=True), verdict], axis=1)

    key_type = rows.schema["key"].dataType.simpleString()
    return dealt.mapInPandas(fold, f"key {key_type}, event_id bigint, {_VERDICT}").withColumnRenamed("key", key)


def fixed_windows(events: DataFrame, key: str, first: tuple[str, int], second: tuple[str, int], ts: str = "ts", event_id: str = "event_id") -> DataFrame:
    """Each event with pass_first and allowed: at most n in each window of a client. The
    second window counts only what passed the first. Windows align to the epoch."""

    def start(width: str) -> Column:
        return F.window(F.col(ts).cast("timestamp"), width)["start"]

    def nth(*parts: Column) -> Column:
        return F.row_number().over(Window.partitionBy(*parts).orderBy(ts, event_id))

    rows = events.withColumn("__w1", start(first[0]))
    rows = rows.withColumn("pass_first", nth(F.col(key), F.col("__w1")) <= first[1]).withColumn("__w2", start(second[0]))
    rows = rows.withColumn("allowed", F.col("pass_first") & (nth(F.col(key), F.col("__w2"), F.col("pass_first")) <= second[1]))
    return rows.drop("__w1", "__w2")


def queue_times(jobs: DataFrame, queue: list[str], arrival: str, service: str, job: str) -> DataFrame:
    """Start and end of each job in a first-come queue with one server. The start is the
    latest of all arrivals so far plus the work since: a running maximum, no loop."""
    order = Window.partitionBy(*queue).orderBy(arrival, job)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.sum(service).over(upto) - F.col(service)
    rows = jobs.withColumn("__before", before)
    start = F.max(F.col(arrival) - F.col("__before")).over(upto) + F.col("__before")
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.col(service)).drop("__before")
