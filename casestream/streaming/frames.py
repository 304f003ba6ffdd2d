"""Event frames over a stream of text chunks that may come in any order.

A connection's chunks are numbered from 0. One that comes before its turn waits in a map in the state
store, in the block of BLOCK numbers that it is in (a call for each block, not for each chunk), and leaves it when all
before it have come; a frame that is not yet closed by a blank line waits too. What follows the last blank line comes out as a last frame with the
chunk that is marked as the connection's end.

Memory: BATCH chunks, one block and the open frame of one connection. The map is as large as the gap: a stream in order
never writes to it. A number that has been read already counts once, so a source that
repeats chunks does no harm. With `patience`, a connection whose missing chunk doesn't come within that time after
its last chunk is given up: one row with `error` names the missing number, and its state goes. Such a query has a clock to run
by; one that takes what there is and stops has none, and waits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Numbers of chunks that wait together.
BLOCK = 64
#: Chunks that are looked at together.
BATCH = 10_000
OUT = "key string, frame_no bigint, payload string, error string"
_FRAME = Row("key", "frame_no", "payload", "error")


class FrameProcessor(StatefulProcessor):
    def __init__(self, patience_ms: int | None = None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "rest string, next_chunk bigint, next_frame bigint, held boolean")
        self.waiting = handle.getMapState("waiting", "block bigint", "seqs array<bigint>, chunks array<string>, ends array<boolean>")
        self.timer = handle.getValueState("timer", "at bigint")

    def _block(self, number: int) -> dict[int, tuple[str, bool]]:
        """The chunks of a block that wait, by their numbers."""
        found = self.waiting.getValue((number,))
        return {s: (c, e) for s, c, e in zip(*found, strict=True)} if found else {}

    def _store(self, number: int, chunks: dict[int, tuple[str, bool]], first: int) -> None:
        """A block's chunks from number `first` on, or none."""
        left = {s: x for s, x in chunks.items() if s >= first}
        if left:
            self.waiting.updateValue((number,), (list(left), [c for c, _ in left.values()], [e for _, e in left.values()]))
        else:
            self.waiting.removeKey((number,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        rest, expected, number, held = self.place.get() or ("", 0, 0, False)  # `held`: whether chunks may wait in the map
        ended = False
        at, block = None, {}  # the block of waiting chunks that the expected one is in
        while batch := list(islice(rows, BATCH)):
            fresh = {}
            for r in batch:
                if r.seq >= expected and not ended:
                    fresh[r.seq] = (r.chunk or "", bool(r.ended))
            while not ended:
                found = fresh.pop(expected, None)
                if found is None and held:
                    if expected // BLOCK != at:
                        if at is not None:
                            self._store(at, {}, expected)
                        at = expected // BLOCK
                        block = self._block(at)
                    found = block.pop(expected, None)
                if found is None:
                    break
                text, ended = found
                frames = (rest + text).split("\n\n")
                rest = "" if ended else frames.pop()
                yield from (_FRAME(key[0], number + k, f.replace("data: ", "", 1), None) for k, f in enumerate(frames) if f.lstrip().startswith("data:"))
                number, expected = number + len(frames), expected + 1
            early: dict[int, dict[int, tuple[str, bool]]] = {}
            for seq, x in fresh.items() if not ended else ():
                early.setdefault(seq // BLOCK, {})[seq] = x
            for k, chunks in early.items():
                held = True
                if k == at:
                    block |= chunks
                else:
                    self._store(k, self._block(k) | chunks, expected)
        if ended:
            self._forget(held)
        else:
            if at is not None:
                self._store(at, block, expected)
            self.place.update((rest, expected, number, held))
            self._wait(timerValues)

    def _wait(self, timerValues) -> None:
        """Set the timer anew while there is a gap."""
        if self.patience_ms is None:
            return
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        if self.waiting.exists():
            at = timerValues.getCurrentProcessingTimeInMs() + self.patience_ms
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def _forget(self, held: bool = True) -> None:
        if self.patience_ms is not None and self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
            self.timer.clear()
        self.place.clear()
        if held:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, expected, number, _ = self.place.get()
        self.timer.clear()
        self._forget()
        yield _FRAME(key[0], number, None, f"chunk {expected} is missing")

    def close(self) -> None:
        pass


def frame_stream(chunks: DataFrame, key: str = "conv_id", patience_ms: int | None = None) -> DataFrame:
    """`chunks` has the key, seq, chunk and, if a connection's end is known, ended: (key, frame_no, payload), and
    with `patience_ms` error. Rows without a number are no chunks."""
    ended = "ended" if "ended" in chunks.columns else "false as ended"
    rows = chunks.where("seq is not null").selectExpr(f"cast({key} as string) as key", "cast(seq as bigint) as seq", "chunk", ended)
    out = rows.groupBy("key").transformWithState(FrameProcessor(patience_ms), outputStructType=OUT, outputMode="Append", timeMode="None" if patience_ms is None else "ProcessingTime")
    return out.drop("error") if patience_ms is None else out


def finished_frames(frames: DataFrame) -> DataFrame:
    """The frames of connections that weren't given up."""
    given_up = frames.where(F.col("error").isNotNull()).select("key")
    return frames.where(F.col("error").isNull()).join(given_up, "key", "left_anti")
