"""A store of model replies by the content of their prompts: equal prompts are asked once, over all runs.

    path/run=<name>/…   (prompt_hash, reply, error) of what one run asked, complete when Spark's write is

A run takes its distinct prompts, drops those that the store has a reply to, asks the rest, each once, and
appends. Failed calls are written too, so that the run's rows can say why, but count as not
asked: the next run tries them again. A run that stopped leaves an incomplete folder, which nobody reads. Runs at the same time
may ask the same; then the smallest reply counts, for all alike."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versioned import Folder

SCHEMA = "prompt_hash string, reply string, error string"


class ReplyStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self) -> list[str]:
        folder = Folder(self.spark, self.path)
        return sorted(n for n in folder.names() if n.startswith("run=") and folder.complete(n))

    def rows(self, runs: list[str] | None = None) -> DataFrame:
        """What the given runs asked, or all: (prompt_hash, reply, error, run)."""
        there = self.runs() if runs is None else runs
        if not there:
            return self.spark.createDataFrame([], f"{SCHEMA}, run string")
        parts = [self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{n}").withColumn("run", F.lit(n.partition("=")[2])) for n in there]
        return reduce(DataFrame.unionAll, parts)

    def replies(self) -> DataFrame:
        """(prompt_hash, reply, run): one row for each prompt that has a reply."""
        made = self.rows().where("error is null")
        return made.groupBy("prompt_hash").agg(F.min(F.struct("reply", "run")).alias("x")).select("prompt_hash", "x.*")

    def compact(self) -> None:
        """One run in place of all. No other run may be at work."""
        old = self.runs()
        if len(old) > 1:
            self._write(self.replies().select("prompt_hash", "reply", F.lit(None).cast("string").alias("error")), f"compact-{uuid.uuid4().hex}")
            for name in old:
                Folder(self.spark, f"{self.path}/{name}").delete()

    def _write(self, rows: DataFrame, run: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/run={run}")

    def ask(self, rows: DataFrame, prompt: str, make: Callable[[], Callable[[str], str]], run: str | None = None) -> DataFrame:
        """`rows` with reply, error and, for a reply, the run that made it. A null prompt isn't asked and gets nulls. `run`
        names this run (a run of that name that is complete is used as it is, so a replay asks nothing)."""
        from .analyze import calls

        run = run or uuid.uuid4().hex
        keyed = rows.withColumn("prompt_hash", F.sha2(F.encode(prompt, "UTF-8"), 256))
        if f"run={run}" not in self.runs():
            wanted = keyed.where(F.col(prompt).isNotNull()).groupBy("prompt_hash").agg(F.first(prompt).alias("prompt"))
            missing = wanted.join(self.replies(), "prompt_hash", "left_anti")
            self._write(missing.select("prompt_hash", calls(make)("prompt").alias("r")).select("prompt_hash", "r.*"), run)
        failed = self.rows([f"run={run}"]).where("error is not null").groupBy("prompt_hash").agg(F.min("error").alias("error"))
        return keyed.join(self.replies(), "prompt_hash", "left").join(failed, "prompt_hash", "left").drop("prompt_hash")
