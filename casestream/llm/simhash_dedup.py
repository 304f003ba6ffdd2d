"""Near-duplicate documents by SimHash fingerprints and deletion-variant signatures.

A fingerprint has 64 bits, each the majority over the XXH64 hashes of a text's three-word
shingles; fingerprints that differ in at most DISTANCE bits are linked. Cut into two
halves, one of the halves differs in at most one bit. So a fingerprint is indexed under
both halves, and under each half with one bit as a wildcard: linked fingerprints are
equal in a half, or meet under a wildcard where one has a 0 and the other a 1. They meet by equality
and are verified on all bits.

Documents with one fingerprint are one node from the start. The halves come first; the wildcards then only
need the keys under which several groups, with both bits, still meet. No key turns into all its pairs: one of
at most BUCKET nodes is worked on as a row of its own, which gives a spanning forest of its links. The nodes of a larger
one, which all share that half but for a bit, are indexed again within it, by halves of
the other half, and of what is left then; after three levels a key has 8 free bits and 3
wildcards, so at most 2,048 nodes, whatever the input. Nothing is left out on the way.

Defined cases: texts are lower-cased in A-Z; with fewer words than three the whole sequence
is the one shingle; null texts and texts without words have the fingerprint 0, which is linked like any other;
a text may be of any length (it is hashed in pieces); rows that repeat a doc_id each have their own
fingerprint; a null doc_id comes last, so it is a component's id only where no row has another;
an empty table gives no rows; columns besides doc_id and text, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, join_by_key, maybe_in, member_bitmap, stage

BITS, DISTANCE, WIDTH, SEED = 64, 3, 3, 42
#: Nodes under a key that are compared at once.
BUCKET = 2048
#: Index keys that a task makes, about, and most tasks. A fingerprint is small and has BITS keys, so tasks by bytes would each make too many.
TASK_KEYS, MOST_TASKS = 1_000_000, 50_000
#: Bytes of a text that are split into words at once.
PIECE = 1 << 20
_GAPS = b" \t\n\x0b\x0c\r"
_LINKS = "a bigint, b bigint"


# -- fingerprints ----------------------------------------------------------


def _pieces(data: bytes, most: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about `most` bytes."""
    at = 0
    while at < len(data):
        end = at + most
        while end < len(data) and data[end] not in _GAPS:
            end += 1
        yield data[at:end].lower().split()
        at = end


def shingle_hashes(data: bytes, width: int = WIDTH) -> Iterator[np.ndarray]:
    """XXH64 of all shingles, repeats included, in pieces."""
    held: list[bytes] = []
    made = False
    for words in _pieces(data):
        words = held + words
        if len(words) >= width:
            line = b" ".join(words)
            starts = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
            made = True
            yield np.array([xxhash.xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, starts[width:], strict=False)], np.uint64)
        held = words[len(words) - min(len(words), width - 1) :]
    if held and not made:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(held), SEED)], np.uint64)


def fingerprint(data: bytes, width: int = WIDTH) -> int:
    """Bit by bit whether more than half the shingles' hashes have it set."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(data, width):
        n += len(hashes)
        for a in range(0, len(hashes), 4096):
            ones += np.unpackbits(hashes[a : a + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", width) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "node"])

    return run


# -- the index -------------------------------------------------------------


def _keys(at: Column, size: Column, wildcard: bool) -> Column:
    """array<struct<slot, key, side, at, size>>: a node's keys in a level. Of its `size` open bits from bit `at` on,
    each half in turn is the key and the other stays open (`at`, `size`). `side` is the node's bit under the wildcard."""
    half = (size / 2).cast("int")

    def one(n: Column) -> Column:
        first = n % 2 == 0
        begin = at + F.when(first, 0).otherwise(half)
        other = at + F.when(first, half).otherwise(0)
        value = F.call_function("shiftrightunsigned", F.col("node"), begin).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), half) - 1)
        bit = (n / 2).cast("int")
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        if wildcard:
            side = F.call_function("shiftrightunsigned", value, bit).bitwiseAND(F.lit(1)).cast("int")
            value = value.bitwiseAND(F.bitwise_not(mask))
        else:
            side = F.lit(None).cast("int")
        slot = n.cast("long") + (2 * BITS if wildcard else 0)
        key = F.xxhash64("parent", slot, value)
        return F.struct(key.alias("key"), side.alias("side"), other.cast("int").alias("at"), half.alias("size"))

    return F.transform(F.sequence(F.lit(0), (2 * half - 1) if wildcard else F.lit(1)), one)


def _forest(distance: int):
    """Rows (nodes) to (a, b): a spanning forest of the links among the nodes, by breadth-first search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held in batch.column("nodes"):
                left = held.values.to_numpy().view(np.uint64)
                a, b = [], []
                while len(left):
                    front, left = left[:1], left[1:]
                    while len(front) and len(left):
                        here, front = front[0], front[1:]
                        near = np.bitwise_count(left ^ here) <= distance
                        met, left = left[near], left[~near]
                        if len(met):
                            a.append(np.full(len(met), here))
                            b.append(met)
                            front = np.concatenate([front, met])
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return run


def _rooted(nodes: DataFrame, groups: DataFrame | None) -> DataFrame:
    """`nodes` with the group that each is in so far; those without a link are their own."""
    if groups is None:
        return nodes.withColumn("root", F.col("node"))
    return nodes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))


def link_nodes(nodes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(node, root) of every node that links reach, from distinct fingerprints (node)."""
    if distance > 3:
        raise ValueError("halves with one wildcard find links of at most 3 bits")
    links, groups = None, None
    tasks = max(1, min(MOST_TASKS, -(-nodes.count() * BITS // TASK_KEYS)))
    open_ = nodes.repartition(tasks, "node").select(F.lit(0).cast("long").alias("parent"), "node", F.lit(0).alias("at"), F.lit(BITS).alias("size"))
    for level in range(3):
        later = []
        for wildcard in (False, True):
            index = _rooted(open_, groups).select("node", "root", F.explode(_keys(F.col("at"), F.col("size"), wildcard)).alias("k")).select("node", "root", "k.*")
            seen = [F.count(F.lit(1)).alias("n"), F.min("root").alias("__low"), F.max("root").alias("__high"), F.min("side").alias("__zero"), F.max("side").alias("__one")]
            several = index.groupBy("key").agg(*seen).where("__low < __high and (__zero is null or __zero < __one)")
            several = stage(several.select("key", "n"), "simhash-keys")
            n_keys = several.count()
            if not n_keys:
                continue
            members = maybe_in(index, "key", member_bitmap(several, "key", n_keys)).join(several, "key")
            members = stage(members.select("key", "n", "node", "at", "size"), "simhash-members")
            small = F.lit(True) if level == 2 else F.col("n") <= bucket
            met = members.where(small).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes")).select("nodes").distinct()
            found = stage(met.mapInArrow(_forest(distance), _LINKS), "simhash-links")
            links = found if links is None else links.union(found)
            groups = components(links, "simhash")
            later.append(members.where(~small).select(F.col("key").alias("parent"), "node", "at", "size"))
        if level == 2 or all(x.isEmpty() for x in later):
            break
        open_ = later[0] if len(later) == 1 else later[0].union(later[1])
    return groups if groups is not None else nodes.sparkSession.createDataFrame([], "node bigint, root bigint")


def simhash_components(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest doc_id that links reach) for each row of `docs`."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = stage(texts.mapInArrow(_fingerprints(width), "doc_id bigint, node bigint"), "simhash-signed")
    nodes = stage(signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("times")), "simhash-nodes")
    groups = link_nodes(nodes.select("node"), distance)
    placed = nodes.join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("times").alias("n"))
    # Documents that are linked with nothing are their own component: they need no join.
    firsts = firsts.where("n > 1")
    known = stage(join_by_key(placed.select("node", "root", "times"), firsts, ["root"], "n").where("component_id is not null or n is not null").select("node", "component_id", "times", F.lit(True).alias("known")), "simhash-known")
    out = join_by_key(signed, known, ["node"], "times")
    text = F.lower(F.lpad(F.hex("node"), 16, "0"))
    return out.select("doc_id", text.alias("fingerprint"), F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table: three-word shingles, fingerprints that differ in at most 3 bits."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
