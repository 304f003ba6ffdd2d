"""Mixing sources to target weights by Sainte-Lague apportionment.

Every source has a weight and a share of a token budget. Tokens are dealt in
blocks of equal size: each block goes to the highest quotient target / (2k + 1),
k being the blocks that a source has already. In the same way a source's blocks
are dealt to its shards, which hold about the same number of documents each.
Inside a shard the documents stand in an order that the seed gives, the blocks
are counted along it, and the shard's quota is a run of blocks from a seeded
start, round the end: whole rounds are repeats. DataFrame and SQL functions only.

Defined cases: a null text or one without words has size 0 and is never taken;
null sources form one source, the last; a null doc_id sorts as an empty one; an empty
table gives no rows; rows that repeat a doc_id are documents of their own; a text may
be of any length; columns other than doc_id, text and source aren't read by
`mix_documents`, and `mixing_stage` hands them on, whatever their names. No source gets more than `most`
times its own size, and so no document more than `most` times its words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, words_of

WEIGHTS = (5, 2, 1)


def _seats(rows: DataFrame, by: list[str], tie: list[str]) -> DataFrame:
    """`rows` with the column `seats`: Sainte-Lague's deal of `n_seats` (the
    same in all rows of a group `by`) by `votes`, at most `most_seats` each.

    Only quotients near the last seat's are laid out: about six for each row.
    With S rows the divisor that deals all seats moves a row's seats by less
    than 3 * S * share + 3 from its rounded share.
    """
    group = Window.partitionBy(*by)
    rows = rows.withColumns({"__all": F.sum("votes").over(group), "__s": F.count(F.lit(1)).over(group)})
    share = F.when(F.col("__all") > 0, F.col("votes") / F.col("__all")).otherwise(0.0)
    middle = F.round(F.col("n_seats") * share)
    reach = F.ceil(3.0 * F.col("__s") * share) + 3
    low = F.greatest(F.lit(0), F.least("most_seats", middle - reach)).cast("long")
    high = F.least("most_seats", middle + reach).cast("long")
    rows = rows.withColumns({"__low": low, "__high": high}).drop("__all", "__s")
    sure = F.sum("__low").over(group)
    tried = rows.withColumn("__left", F.col("n_seats") - sure).where("votes > 0 and __high > __low")
    tried = tried.select(*by, *[c for c in tie if c not in by], "votes", "__left", F.explode(F.sequence("__low", F.col("__high") - 1)).alias("__k"))
    order = Window.partitionBy(*by).orderBy((F.col("votes") / (2 * F.col("__k") + 1)).desc(), *tie, "__k")
    won = tried.withColumn("__rank", F.row_number().over(order)).where("__rank <= __left")
    more = won.groupBy(*tie).agg(F.count(F.lit(1)).alias("__won"))
    cond = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in tie]
    joined = rows.alias("l").join(more.alias("r"), cond, "left")
    return joined.select("l.*", (F.col("__low") + F.coalesce("__won", F.lit(0))).alias("seats")).drop("__low", "__high")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """(source, rank, source_size, n_docs, target) of (source, size) rows. The weights
    repeat along the sources by code point, null last. A source's target stops at
    `most` times its size; the rest is shared again by weight."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    line = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("rank", F.row_number().over(line))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1)
    per = per.withColumns({"weight": weight.cast("long"), "cap": F.col("source_size") * most})
    everything = Window.partitionBy(F.lit(0))
    filled = everything.orderBy((F.col("cap") / F.col("weight")).asc(), "rank").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns(
        {
            "__budget": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(filled), F.lit(0)),
            "__weights": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0)),
        }
    )
    # Along growing cap / weight a source stops at its cap as long as the level of those still open would lift it above.
    per = per.withColumn("__full", F.col("__budget") * F.col("weight") >= F.col("cap") * F.col("__weights"))
    level = F.max(F.when(~F.col("__full"), F.struct("__weights", "__budget"))).over(everything)
    per = per.withColumn("__level", level)
    share = F.col("weight") * F.col("__level.__budget") / F.col("__level.__weights")
    target = F.when(F.col("__full"), F.col("cap").cast("double")).otherwise(share.cast("double"))
    return per.select("source", "rank", "source_size", "n_docs", target.alias("target"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, most: int = 3, block: int = 32, shard_docs: int = 1024, most_shards: int = 65536, seed: int = 7) -> DataFrame:
    """One row for each row of `docs`: doc_id, source, size, source_size, target
    and taken, the words that the mix takes of it with repeats.

    `block` is the most words in a block; it shrinks where the smallest target
    would be under 64 blocks. A shard has about `shard_docs` documents, and a
    source at most `most_shards` shards, so each task stays bounded.
    """
    return _mixed(docs, weights, most, block, shard_docs, most_shards, seed).drop("th")


def _mixed(docs: DataFrame, weights=WEIGHTS, most: int = 3, block: int = 32, shard_docs: int = 1024, most_shards: int = 65536, seed: int = 7) -> DataFrame:
    """The rows of `mix_documents` and th, the hash of their texts."""
    # The order and the shards hang on doc_id alone, so that a rerun takes the same words.
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("__key")
    sized = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), key, F.xxhash64("text").alias("th"))
    sized = stage(sized, "mix-sizes")
    targets = stage(source_targets(sized, weights, most), "mix-targets")

    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy(F.lit(0)))
    size_of_block = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.coalesce(least, F.lit(0.0)) / 64))).cast("long")
    quota = targets.withColumn("block", size_of_block)
    total = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / F.col("block"))
    quota = quota.withColumns({"votes": F.col("target"), "n_seats": total.cast("long"), "most_seats": F.ceil(F.col("source_size") * most / F.col("block")), "__one": F.lit(0)})
    quota = _seats(quota, ["__one"], ["rank"]).withColumnRenamed("seats", "blocks")
    shards = F.least(F.lit(most_shards), F.ceil(F.col("n_docs") / shard_docs)).cast("long")
    quota = stage(quota.select("source", "rank", "source_size", "target", "block", "blocks", shards.alias("shards")), "mix-quota")

    q = quota.withColumnRenamed("source", "__source")
    # Sources are few and this table is staged, so the planner knows its size: it is sent to all tasks only below
    # Spark's threshold, and a hot source's side is split by AQE otherwise.
    placed = sized.join(q, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    placed = placed.withColumn("shard", F.pmod(F.conv(F.substring("__key", 1, 8), 16, 10).cast("long"), F.col("shards")))
    shard = placed.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("block").alias("block"), F.first("blocks").alias("n_seats"))
    shard = shard.withColumns({"votes": F.col("shard_size").cast("double"), "most_seats": F.ceil(F.col("shard_size") * most / F.col("block"))})
    shard = _seats(shard, ["rank"], ["rank", "shard"])
    words = F.least(F.col("seats") * F.col("block"), F.col("shard_size") * most)
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block")))
    begin = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "rank", "shard")), 1, 8), 16, 10).cast("long"), n_blocks) * F.col("block")
    shard = shard.select(F.col("rank").alias("__rank"), F.col("shard").alias("__shard"), "shard_size", words.alias("words"), begin.alias("begin"))

    along = Window.partitionBy("rank", "shard").orderBy("__key", "size", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("__to", F.sum("size").over(along)).withColumn("__from", F.col("__to") - F.col("size"))
    placed = placed.join(shard, (F.col("rank") == F.col("__rank")) & (F.col("shard") == F.col("__shard")))
    whole = F.greatest(F.col("shard_size"), F.lit(1))
    placed = placed.withColumns({"__rounds": F.floor(F.col("words") / whole), "__part": F.pmod("words", whole)})
    end = F.col("begin") + F.col("__part")
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(F.col("__to"), b) - F.greatest(F.col("__from"), a))
    run = overlap(F.col("begin"), F.least(end, F.col("shard_size"))) + overlap(F.lit(0), end - F.col("shard_size"))
    taken = (F.col("__rounds") * F.col("size") + run).cast("long")
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "th")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the mix takes, each once for every
    started repeat (a document of which two and a half copies are taken stands
    three times); those of which nothing is taken go. A document without words
    has nothing to take and goes too. Each row goes by its own doc_id, source and
    text; rows that repeat all three stand as often as the one of which most is taken."""
    key = ["doc_id", "source", "th"]
    times = _mixed(docs).where("taken > 0").withColumn("times", F.ceil(F.col("taken") / F.col("size")).cast("int"))
    times = stage(times.groupBy(*key).agg(F.max("times").alias("times")).withColumn("key", F.xxhash64(*key)), "mix-times")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    own = [F.col("row.doc_id"), F.col("row.source"), F.xxhash64("row.text")]
    same = F.col("row_key") == F.col("key")
    for mine, theirs in zip(own, key, strict=True):
        same = same & mine.eqNullSafe(F.col(theirs))
    out = rows.withColumn("row_key", F.xxhash64(*own)).join(times, same)
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table, weights 5, 2, 1 in turn, budget all words."""
    return mix_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
