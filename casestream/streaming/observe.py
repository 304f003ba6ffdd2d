"""Progress and counts of a run from observed metrics: they are worked out in the pass that does the work, for
batches and for streams, and no second pass counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def run_counts(error: str = "error", text: str = "text") -> dict[str, Column]:
    """The counts of an analysis: files, those that failed, and characters read."""
    return {"n_files": F.count(F.lit(1)), "n_failed": F.count(F.when(F.col(error).isNotNull(), 1)), "n_chars": F.coalesce(F.sum(F.length(text)), F.lit(0))}


def observed(df: DataFrame, metrics: dict[str, Column], name: str = "run") -> tuple[DataFrame, Observation]:
    """`df`, and what its next action observes: `.get` waits for that action and gives the metrics by name."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in metrics.items()]), seen


def observed_stream(df: DataFrame, metrics: dict[str, Column], name: str = "run") -> DataFrame:
    """A stream whose micro-batches report the metrics under `name`, to `Progress` and in the query's own progress."""
    return df.observe(name, *[c.alias(k) for k, c in metrics.items()])


def totals(query: StreamingQuery, name: str = "run") -> dict[str, int]:
    """The sums of a stopped query's metrics over the micro-batches that it remembers (the last 100 by default)."""
    out: dict[str, int] = {}
    for p in query.recentProgress:
        if name in p["observedMetrics"]:
            for k, v in p["observedMetrics"][name].asDict().items():
                out[k] = out.get(k, 0) + (v or 0)
    return out


class Progress(StreamingQueryListener):
    """Calls back with a plain dict: step (starting, processing, complete or error), run, and for each micro-batch its
    number, rows and observed metrics. Register it with `spark.streams.addListener`; a callback that fails is ignored, as
    the work doesn't depend on who watches it."""

    def __init__(self, callback: Callable[[dict], None]):
        self.callback = callback

    def _tell(self, **what) -> None:
        try:
            self.callback(what)
        except Exception as e:  # noqa: BLE001
            print(f"progress callback failed: {e}")

    def onQueryStarted(self, event) -> None:
        self._tell(step="starting", run=str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        metrics = {name: row.asDict() for name, row in p.observedMetrics.items()}
        self._tell(step="processing", run=str(p.runId), batch=p.batchId, rows=p.numInputRows, metrics=metrics)

    def onQueryTerminated(self, event) -> None:
        self._tell(step="error" if event.exception else "complete", run=str(event.runId), message=event.exception)
