"""Change detection as micro-batches: new entries in, notices out, cursors moved after delivery.

A notice is of a term's newest entry that has documents, with the analysis that an
injected function makes of it, once for each term.

Subscriptions are a `VersionedTable` by id. A batch works in steps, each a complete write of its own:

    1. due/batch=<n>     changed subscriptions with their entry and its analysis, or the analysis' error
    2. mail/batch=<n>    the outbox: notices of what could be analysed, and those of the batch before that weren't delivered
    3. sent/batch=<n>    what the injected delivery says went out
    4. the table         a version with the cursors of what went out, which names the batch as applied

A batch that stopped anywhere and runs again keeps what is complete and goes on from there. A complete outbox is never
written anew, and what has gone out isn't handed to the delivery again, unless it stopped between delivering and
step 3: at least once, as the key (subscription, identifier) lets a receiver see. One failing
analysis or delivery holds up its own subscriptions only: entries that couldn't be analysed are looked at again with
the next batch, unless it has newer ones of their term."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.payload import mail_outbox
from ..operators.select import with_documents
from ..operators.subscriptions import active, advance
from ..plans.analysis import daily_check
from ..sources.versioned import Folder, VersionedTable

JOB = "change_feed"


def _before(folder: Folder, kind: str, batch_id: int) -> str | None:
    """The newest complete earlier batch of a kind."""
    ids = sorted((int(n.partition("=")[2]) for n in folder.names(kind) if n.startswith("batch=")), reverse=True)
    return next((f"{kind}/batch={i}" for i in ids if i < batch_id and folder.complete(f"{kind}/batch={i}")), None)


def _undelivered(subscriptions: DataFrame, mail: DataFrame, sent: DataFrame | None, due: DataFrame) -> DataFrame:
    """Of the last batch's mail what didn't go out, is still wanted, and has no newer notice now."""
    key = ["subscription_id", "identifier"]
    left = mail if sent is None else mail.join(sent.select(*key), key, "left_anti")
    wanted = active(subscriptions).select(F.col("id").alias("subscription_id"), F.col("last_seen_case_identifier").alias("__seen"))
    left = left.join(wanted, "subscription_id").where(~F.col("identifier").eqNullSafe(F.col("__seen"))).drop("__seen")
    return left.join(due.select("subscription_id"), "subscription_id", "left_anti")


def check_batch(entries: DataFrame, batch_id: int, cursor: VersionedTable, outbox: str, deliver: Callable[[DataFrame], DataFrame] | None = None, analyse: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """One batch: `entries` are all or new entries with result_pos and their document link. `deliver`
    returns the outbox rows that went out; those that failed keep their old cursor and come again with the next batch.
    `analyse` maps entries to (search_term, analysis) and, if analyses can fail, error."""
    if cursor.applied(JOB) >= batch_id:
        return
    spark, folder = entries.sparkSession, Folder(entries.sparkSession, outbox)
    found, mail, sent = (f"{kind}/batch={batch_id}" for kind in ("due", "mail", "sent"))
    if not folder.complete(found):
        last_found = _before(folder, "due", batch_id)
        if last_found:
            failed = spark.read.parquet(f"{outbox}/{last_found}").where("error is not null").select(*entries.columns).distinct()
            entries = entries.unionByName(failed.join(with_documents(entries).select("search_term"), "search_term", "left_anti"))
        due = daily_check(cursor.read(), entries, analyse)
        (due if "error" in due.columns else due.withColumn("error", F.lit(None).cast("string"))).write.mode("overwrite").parquet(f"{outbox}/{found}")
    if not folder.complete(mail):
        due = mail_outbox(spark.read.parquet(f"{outbox}/{found}").where("error is null"))
        last_mail = _before(folder, "mail", batch_id)
        if last_mail:
            last_sent = last_mail.replace("mail", "sent", 1)
            gone = spark.read.schema(due.schema).parquet(f"{outbox}/{last_sent}") if folder.complete(last_sent) else None
            due = due.unionByName(_undelivered(cursor.read(), spark.read.schema(due.schema).parquet(f"{outbox}/{last_mail}"), gone, due))
        due.write.mode("overwrite").parquet(f"{outbox}/{mail}")
    there = spark.read.parquet(f"{outbox}/{mail}")
    if not folder.complete(sent):
        (deliver(there) if deliver else there).write.mode("overwrite").parquet(f"{outbox}/{sent}")
    went_out = spark.read.schema(there.schema).parquet(f"{outbox}/{sent}").select(F.col("subscription_id").alias("id"), "identifier")
    cursor.update(went_out, lambda rows, new: advance(rows, new.select(F.col("id").alias("subscription_id"), "identifier")), JOB, batch_id)


def change_feed(entries: DataFrame, cursor: VersionedTable, outbox: str, checkpoint: str, deliver: Callable[[DataFrame], DataFrame] | None = None, analyse: Callable[[DataFrame], DataFrame] | None = None):
    """Start the query: all there is now, then stop."""

    def batch(df: DataFrame, batch_id: int) -> None:
        check_batch(df, batch_id, cursor, outbox, deliver, analyse)

    return entries.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
