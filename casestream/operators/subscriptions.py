"""Subscriptions: inserts under a unique key, soft deletes, change detection, cursors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identifier, truthy
from ..session import scratch

KEY = ["email", "search_term"]


def active(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.where("is_active")


def split_requests(requests: DataFrame, subscriptions: DataFrame, order: str = "request_no") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inserts, conflicts, refused). A request without email or term is refused; one whose
    key is there, active or not, or came earlier in the batch, conflicts."""
    filled = requests.where(truthy("email") & truthy("search_term"))
    refused = requests.where(~(truthy("email") & truthy("search_term")))
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy(order))
    known = subscriptions.select(*KEY).distinct().withColumn("__known", F.lit(True))
    judged = filled.withColumn("__nth", nth).join(known, KEY, "left")
    fresh = (F.col("__nth") == 1) & F.col("__known").isNull()
    return judged.where(fresh).drop("__nth", "__known"), judged.where(~fresh).drop("__nth", "__known"), refused


def numbered(rows: DataFrame, order: str, label: str = "numbered") -> DataFrame:
    """`rows` with `__line`, from 1 in the given order, without bringing them to one task: ranges of the order are sorted and
    numbered each by itself, written once, and moved up by the rows of the ranges before."""
    spark, folder = rows.sparkSession, scratch(rows.sparkSession, label)
    dealt = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    dealt.withColumn("__at", F.monotonically_increasing_id()).write.parquet(folder)
    # That id is the partition's number, shifted by 33 bits, and the row's place in it from 0.
    there = spark.read.parquet(folder).withColumn("__part", F.shiftright("__at", 33))
    counts = there.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    ahead = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__ahead"))
    line = F.col("__ahead") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return there.join(F.broadcast(ahead), "__part").withColumn("__line", line).drop("__part", "__at", "__ahead")


def insert(inserts: DataFrame, subscriptions: DataFrame, order: str = "request_no") -> DataFrame:
    """New rows: ids follow the largest one, in request order; defaults fill the rest."""
    top = subscriptions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    placed = numbered(inserts, order, "subscribe").crossJoin(F.broadcast(top))  # the broadcast side is one row
    return placed.select(
        (F.col("__top") + F.col("__line")).cast("long").alias("id"),
        *KEY,
        F.lit(None).cast("string").alias("last_seen_case_identifier"),
        F.lit(True).alias("is_active"),
        F.current_timestamp().alias("created_at"),
        F.uuid().alias("unsubscribe_token"),
    )


def unsubscribe(subscriptions: DataFrame, tokens: DataFrame) -> DataFrame:
    """All rows, those of a token inactive. Tokens that match nothing do nothing, and that is no error."""
    gone = tokens.select(F.col("unsubscribe_token").alias("__t")).distinct()
    joined = subscriptions.join(gone, F.col("unsubscribe_token") == F.col("__t"), "left")
    return joined.withColumn("is_active", F.when(F.col("__t").isNotNull(), F.lit(False)).otherwise(F.col("is_active"))).drop("__t")


def changes(subscriptions: DataFrame, latest: DataFrame) -> DataFrame:
    """Active subscriptions whose term's newest entry differs from what was seen last; none
    seen counts as different. `latest` has one row for each term: a term is looked up once,
    however many subscribe to it."""
    now = latest.withColumn("identifier", identifier("case_number", "date"))
    return active(subscriptions).join(now, "search_term").where(~F.col("identifier").eqNullSafe(F.col("last_seen_case_identifier")))


def advance(subscriptions: DataFrame, delivered: DataFrame) -> DataFrame:
    """All rows, with the identifier of what was delivered (subscription_id, identifier) as last seen."""
    new = delivered.groupBy(F.col("subscription_id").alias("__id")).agg(F.max("identifier").alias("__new"))
    joined = subscriptions.join(new, F.col("id") == F.col("__id"), "left")
    return joined.withColumn("last_seen_case_identifier", F.coalesce("__new", "last_seen_case_identifier")).drop("__id", "__new")
