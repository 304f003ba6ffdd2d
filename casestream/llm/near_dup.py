"""Near-duplicate documents by b-bit MinHash signatures and a multi-index
Hamming join, confirmed on full shingle sets.

A document's set holds the 64-bit hashes of its distinct five-word shingles
(A-Z lower-cased; with fewer words the whole sequence is the only shingle).
Documents with equal sets form a node. A node's signature has 48 lanes of 16
bits, the low bits of 48 MinHash minima, in 12 chunks of four lanes. Two nodes
that differ in at most 23 lanes agree, by pigeonhole, on all but one lane of
some chunk; so each chunk is indexed four times, every time with another lane
left out. All pairs at that distance meet in a bucket, and most others at a
similarity of 0.75 do too: of 10,000 such pairs about two are farther apart, and
those fail to meet only if besides no chunk happens to agree.

A bucket never turns into all its pairs. First each node is compared with the
nearest of the smallest and largest nodes of its buckets; the links that full sets
confirm give a first grouping. Links inside a group can't change the groups, so only
nodes that meet other groups in a bucket are left. Where one group is big, its nodes and
the outside nodes that meet it in some bucket are laid in tiles, blocks of both sides'
full sets. Of the others, whatever the size of a bucket, each node lists the rarest
shingles of its set, as many as similar sets must have one of in common: if the first
shingle that two sets share, counted from the rarest, stands behind these, they share too
few. Nodes of different groups that list the same shingle are put in one cluster, and a
cluster's full sets are compared in tiles, so that is exact for all nodes that take part.
Copies with many changes of their own list little but those and mostly stay apart.
A tile only gives links that join its groups, fewer than it has nodes. Tables grow with
nodes, their keys and shingles; only a large cluster's tiles grow with the square of its bytes.

Defined cases: null texts and texts without words have an empty set, are linked
with nothing and form their own component; a text may be of any length; rows that
repeat a doc_id are linked each by its own text, and rows that repeat doc_id and text
get equal rows out; a null doc_id comes last, so it is a component's id only where no
row has another; an empty table gives an empty result; columns besides doc_id and text
aren't read by `link_components`, and `near_duplicate_stage` hands them on, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, join_by_key, maybe_in, member_bitmap, mix, shingle_sets, stage, text_slices, word_hashes

LANES, CHUNK, LANE_BITS = 48, 4, 16
CHUNKS = LANES // CHUNK
#: The distance up to which the index finds every pair. The first round looks at no others.
MOST_LANES = 2 * CHUNKS - 1
#: Pairs of each node that the first round confirms at most.
FIRST_TRIES = 4
#: Groups of so many nodes are compared with outside nodes; tiles have about TILE_BYTES of shingles each side.
BIG_GROUP, TILE_BYTES = 32, 2_000_000


def _sizes_allow(one, two, percent: int):
    """Whether sets of such sizes can be that similar: the smaller holds all they share, the larger is part of their union."""
    least, most = (F.least, F.greatest) if isinstance(one, Column) else (np.minimum, np.maximum)
    return 100 * least(one, two) >= percent * most(one, two)


_RANDOM = np.random.default_rng(48)
_MULTIPLY = _RANDOM.integers(0, 2**63, LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 2**63, LANES, dtype=np.uint64)

_SIGNED = "doc_id bigint, th bigint, n_shingles bigint, node bigint, check bigint, " + ", ".join(f"s{i} bigint" for i in range(CHUNKS))


def _signature(shingles: np.ndarray) -> np.ndarray:
    """CHUNKS 64-bit words, each with four lanes of a minimum's low 16 bits."""
    least = np.full(LANES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096, None] * _MULTIPLY + _ADD
        np.minimum(least, (part ^ (part >> np.uint64(29))).min(axis=0), out=least)
    lanes = (mix(least) & np.uint64(0xFFFF)).reshape(CHUNKS, CHUNK)
    return np.bitwise_or.reduce(lanes << (np.arange(CHUNK, dtype=np.uint64) * np.uint64(LANE_BITS)), axis=1)


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    for row, data, offsets in text_slices(batch.column("text")):
        hashed, first = word_hashes(data, offsets)
        yield row, shingle_sets(hashed, first, width)


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in _sets(batch, width):
                n = np.array([len(s) for s in sets], dtype=np.int64)
                with np.errstate(over="ignore"):
                    node = np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                    check = np.array([mix(s + np.uint64(99)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
                    signatures = np.array([_signature(s) if len(s) else np.zeros(CHUNKS, np.uint64) for s in sets]).view(np.int64)
                out = [*(batch.column(c).slice(row, len(sets)) for c in ("doc_id", "th")), pa.array(n), pa.array(node.view(np.int64)), pa.array(check.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*out, *(pa.array(np.ascontiguousarray(signatures[:, i])) for i in range(CHUNKS))], [f.split()[0] for f in _SIGNED.split(", ")])

    return run


def _node_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, sets in _sets(batch, width):
                out = [batch.column("node").slice(row, len(sets)), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["node", "shingles"])

    return run


def _confirm(percent: int):
    """Keeps pairs with 100 * intersection >= percent * union; both sets are sorted and distinct."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([one, two]), kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _chunk_lanes(a: str, b: str) -> list[Column]:
    """For each chunk the number of 16-bit lanes in which two signatures differ."""
    out = []
    for i in range(CHUNKS):
        d = F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))
        # Folded to 14 bits a lane, a lane that isn't 0 carries into bit 14, and none into the next lane.
        for kept in (0x7FFF7FFF7FFF7FFF, 0x3FFF3FFF3FFF3FFF):
            d = F.shiftrightunsigned(d, 1).bitwiseOR(d).bitwiseAND(F.lit(kept))
        out.append(F.bit_count((d + F.lit(0x3FFF3FFF3FFF3FFF)).bitwiseAND(F.lit(0x4000400040004000))))
    return out


def _lanes_apart(a: str, b: str) -> Column:
    return sum(_chunk_lanes(a, b)[1:], _chunk_lanes(a, b)[0])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingle) of (node, shingles)."""
    for batch in batches:
        sets = batch.column("shingles")
        flat = np.frombuffer(b"".join(sets.to_pylist()), np.int64)
        node = np.repeat(batch.column("node").to_numpy(), pc.binary_length(sets).to_numpy() // 8)
        for a in range(0, len(flat), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 17)]) for x in (node, flat)], ["node", "shingle"])


def _tile(percent: int):
    """(a, b): links between nodes of `one` and of `two`, but only such as join groups that the tile's
    links so far don't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, two = batch.column("one")[row].as_py(), batch.column("two")[row].as_py()
                names = {r: i for i, r in enumerate({m["root"] for m in one + two})}
                root, other = (np.array([names[m["root"]] for m in side]) for side in (one, two))
                sets = [np.frombuffer(m["shingles"], np.uint64) for m in one]
                sizes = np.array([len(x) for x in sets])
                flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
                order = np.argsort(flat, kind="stable")
                flat, owner = flat[order], owner[order]
                group, found = np.arange(len(names)), []
                for i, o in enumerate(two):
                    own = np.frombuffer(o["shingles"], np.uint64)
                    low, high = np.searchsorted(flat, own), np.searchsorted(flat, own, "right")
                    n = high - low
                    at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    common = np.bincount(owner[at], minlength=len(sets))
                    linked = 100 * common >= percent * (sizes + len(own) - common)
                    for m in np.flatnonzero(linked & (group[root] != group[other[i]])):
                        if group[root[m]] != group[other[i]]:
                            found.append((one[m]["node"], o["node"]))
                            group[group == group[root[m]]] = group[other[i]]
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _blocks(nodes: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """(group, node, root) to (group, part, parts, [name]): lists of nodes and sets of about TILE_BYTES."""
    held = stage(nodes.join(sets, "node"), "near-held")
    per = held.groupBy("group").agg(F.ceil(F.sum(F.length("shingles")) / TILE_BYTES).cast("int").alias("parts"), F.count(F.lit(1)).alias("times"))
    part = F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int")
    dealt = join_by_key(held, stage(per, "near-per"), ["group"], "times")
    return dealt.groupBy("group", "parts", part.alias("part")).agg(F.collect_list(F.struct("node", "root", "shingles")).alias(name))


def _tiles(inside: DataFrame, outside: DataFrame, sets: DataFrame) -> DataFrame:
    """(one, two): each block of a group's nodes with each block of its outside nodes. A tile has a key
    of its own, so that a large group's are spread."""
    one, two = _blocks(inside, sets, "one"), _blocks(outside, sets, "two")
    n_one, n_two = one.select("group", F.col("parts").alias("ps")).distinct(), two.select("group", F.col("parts").alias("qs")).distinct()
    one = one.join(n_two, "group").select("group", F.col("part").alias("p"), F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("q"), "one")
    two = two.join(n_one, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("ps") - 1)).alias("p"), F.col("part").alias("q"), "two")
    return one.join(two, ["group", "p", "q"]).select("one", "two")


def _own_tiles(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """(one, two): the pairs of blocks of each cluster (group, node, root), an only block with itself without a join."""
    blocks = stage(_blocks(clusters, sets, "block"), "near-blocks")
    alone = blocks.where("parts = 1").select(F.col("block").alias("one"), F.col("block").alias("two"))
    many = blocks.where("parts > 1")
    one = many.select("group", F.col("part").alias("p"), F.explode(F.sequence("part", F.col("parts") - 1)).alias("q"), F.col("block").alias("one"))
    two = many.select("group", F.explode(F.sequence(F.lit(0), "part")).alias("p"), F.col("part").alias("q"), F.col("block").alias("two"))
    return alone.union(one.join(two, ["group", "p", "q"]).select("one", "two"))


def _clusters(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(group, node, root) of those of `nodes` (node, root, n_shingles) whose sets may be similar to one of another root.
    Similar sets share at least `percent` of the larger one's shingles, so in any order of all shingles the first that
    they share stands at a place of either where so many are left. The order is by number of sets, then by hash.
    No shingle has a large part of the rows, as a set has it once."""
    shingles = stage(nodes.join(sets, "node").select("node", "shingles").mapInArrow(_shingles, "node bigint, shingle bigint"), "near-shingles")
    shared = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    ordered = shingles.join(shared, "shingle").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("s"))
    first = F.col("n_shingles") - F.ceil(F.col("n_shingles") * percent / 100) + 1
    # Those that no other set has come first.
    some = F.slice("s", 1, F.greatest(F.lit(0), first - F.col("n_shingles") + F.size("s")).cast("int"))
    rare = stage(ordered.join(nodes, "node").select("node", "root", F.explode(some).alias("s")).select("node", "root", F.col("s.shingle").alias("shingle")), "near-rare")
    meet = rare.groupBy("shingle").agg(F.min("node").alias("b"), F.min("root").alias("__low"), F.max("root").alias("__high")).where("__low < __high")
    links = rare.join(meet, "shingle").select(F.col("node").alias("a"), "b")
    return components(links, "near-cluster").select("node", F.col("root").alias("group")).join(nodes.select("node", "root"), "node")


def _place(doc_id: str = "doc_id", th: str = "th") -> Column:
    """Sorts rows by doc_id, null last, and then by the hash of the text."""
    return F.struct(F.col(doc_id).isNull().alias("last"), F.col(doc_id).alias("doc_id"), F.col(th).alias("th"))


def link_rows(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, th (the hash of the text), n_shingles and first, the (last, doc_id, th) of the first
    row that links reach, for each row of `docs`."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    signed = stage(texts.mapInArrow(_sign(width), _SIGNED), "near-signed")
    words = [f"s{i}" for i in range(CHUNKS)]
    nodes = signed.where("n_shingles > 0").groupBy("node", "check", "n_shingles")
    nodes = stage(nodes.agg(F.min(_place()).alias("first_row"), *[F.first(w).alias(w) for w in words]), "near-nodes")

    # The multi-index: 4 keys for each chunk, every time with one lane left out.
    masks = [((1 << 64) - 1) ^ (0xFFFF << (LANE_BITS * z)) for z in range(CHUNK)]
    signed_masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = [F.xxhash64(F.lit(i * CHUNK + z), F.col(w).bitwiseAND(F.lit(m))) for i, w in enumerate(words) for z, m in enumerate(signed_masks)]
    index = nodes.select("node", F.posexplode(F.array(*keys)).alias("slot", "key"))
    buckets = index.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high")
    members = stage(index.join(buckets, "key"), "near-members")

    signatures = nodes.select("node", "n_shingles", *words)
    tried = members.select("node", F.explode(F.array("low", "high")).alias("hub")).where("node <> hub")
    tried = tried.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    tried = tried.join(signatures.alias("x"), F.col("a") == F.col("x.node")).join(signatures.alias("y"), F.col("b") == F.col("y.node"))
    tried = tried.where(_sizes_allow(F.col("x.n_shingles"), F.col("y.n_shingles"), percent))
    tried = stage(tried.select("a", "b", _lanes_apart("x", "y").alias("apart")).where(F.col("apart") <= MOST_LANES), "near-tried")
    both = tried.select(F.col("a").alias("node"), "a", "b", "apart").union(tried.select(F.col("b").alias("node"), "a", "b", "apart"))
    # The nearest of each of a few random classes of a node's pairs: minima, which combine before the shuffle.
    kind = F.pmod(F.xxhash64("a", "b"), F.lit(FIRST_TRIES))
    tries = [F.min_by(F.struct("a", "b"), F.when(kind == i, F.struct("apart", "a", "b"))) for i in range(FIRST_TRIES)]
    nearest = both.groupBy("node").agg(F.array(*tries).alias("t")).select(F.explode("t").alias("p")).where("p is not null").select("p.a", "p.b").distinct()
    known = members.select("node").distinct()
    there = signed.join(known, "node", "left_semi").groupBy("node", "doc_id", "th").agg(F.count(F.lit(1)).alias("times"))
    there = stage(there.groupBy("node").agg(F.min_by(F.struct("doc_id", "th", "times"), _place()).alias("x")).select("node", "x.*"), "near-there")
    sets = _sets_of(texts, there, width)
    links = stage(_confirmed(nearest, sets, percent), "near-links")
    grouped = components(links, "near-first")

    # Buckets that still hold several groups.
    big = stage(grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BIG_GROUP).select("root", F.lit(True).alias("big")), "near-big")
    placed = members.select("key", "slot", "node").join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node")).join(big, "root", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    several = placed.groupBy("key").agg(F.min("root").alias("__low"), F.max("root").alias("__high")).where("__low < __high").select("key")
    open_ = stage(placed.join(several, "key"), "near-open")

    # One group is big: its nodes against the outside nodes that it meets, in tiles.
    hosts = open_.where("big").select("key", F.col("root").alias("group")).distinct()
    outside = open_.select("key", "node", "root", "big").join(hosts, "key").where((F.col("root") != F.col("group")) & (~F.col("big") | (F.col("root") < F.col("group"))))
    outside = stage(outside.select("group", "node", "root").distinct(), "near-outside")
    inside = grouped.join(outside.select(F.col("group").alias("root")).distinct(), "root", "left_semi").select(F.col("root").alias("group"), "node", "root")
    across = stage(_tiles(inside, outside, sets).mapInArrow(_tile(percent), "a bigint, b bigint"), "near-across")
    if not across.isEmpty():
        grouped = components(links.union(across), "near-second")

    # Neither group is big: the nodes that still meet a different group.
    small = open_.where("not big").drop("root").join(grouped, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = small.groupBy("key").agg(F.min("root").alias("__low"), F.max("root").alias("__high")).where("__low < __high").select("key")
    small = small.join(several, "key").select("node", "root").distinct().join(signatures.select("node", "n_shingles"), "node")
    clusters = _clusters(stage(small, "near-small"), sets, percent)
    later = stage(_own_tiles(clusters, sets).mapInArrow(_tile(percent), "a bigint, b bigint"), "near-later")

    final = components(links.union(later).union(across), "near-final")

    node_root = nodes.join(final, "node", "left").select("node", "check", "n_shingles", "first_row", F.coalesce("root", "node").alias("root"))
    first = node_root.groupBy("root").agg(F.min("first_row").alias("first"))
    node_root = stage(node_root.join(first, "root").select("node", "check", "n_shingles", "first"), "near-roots")
    out = signed.select("doc_id", "th", "n_shingles", "node", "check").join(node_root, ["node", "check", "n_shingles"], "left")
    return out.select("doc_id", "th", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(_place()).alias("first"))


def link_components(docs: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach)
    and kept (doc_id is that smallest) for each row of `docs`."""
    component = F.col("first.doc_id")
    return link_rows(docs, width, percent).select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _sets_of(texts: DataFrame, there: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes that share a bucket, made again from the texts of one row
    each: far less to write than the sets of all documents."""
    key = F.xxhash64("doc_id", "th").alias("key")
    wanted = there.select(key, "node", F.col("doc_id").alias("d"), F.col("th").alias("t"))
    some = maybe_in(texts.select("doc_id", "th", "text", key), "key", member_bitmap(wanted, "key", there.count()))
    some = some.join(wanted, "key").where(F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))).select("node", "text")
    if not there.where("times > 1").isEmpty():  # equal rows: one is enough
        some = some.groupBy("node").agg(F.first("text").alias("text"))
    return stage(some.mapInArrow(_node_sets(width), "node bigint, shingles binary"), "near-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), "a bigint, b bigint")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component the row with the smallest doc_id stays (null last; of rows with
    that doc_id one by the hash of the text), and rows that repeat its doc_id and text with it.
    Each row goes by its own text. Rows without words stay."""
    found = link_rows(docs).where((F.col("n_shingles") > 0) & ~_place().eqNullSafe(F.col("first")))
    gone = stage(found.select(F.xxhash64("doc_id", "th").alias("gone_key"), F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct(), "near-gone")
    doc, th = F.col("row.doc_id").cast("long"), F.xxhash64("row.text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("key", F.xxhash64(doc, th))
    bitmap = member_bitmap(gone, "gone_key", gone.count())
    hit = (F.col("key") == F.col("gone_key")) & doc.eqNullSafe(F.col("gone_id")) & (th == F.col("gone_th"))
    left = maybe_in(rows, "key", bitmap).join(gone, hit, "left_anti")
    return left.union(maybe_in(rows, "key", bitmap, inverse=True)).select("row.*")


def op3_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table: five-word shingles, similarity 0.75 or more."""
    return link_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
