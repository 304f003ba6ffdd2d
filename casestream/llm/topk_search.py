"""Exact top-k search by inner product on a bit-sliced index.

A component x becomes floor(256 * x). The index holds blocks of rows; in a block,
slice b of attribute d is a bitmap of the rows whose value has bit b. A query
adds slices: attribute d stands in its score as often as its own component says, so
for every set bit i of that component slice b goes to the sum's bit i + b (for
negative components the complement of the slice). Carry-save adders turn three
bitmaps of one weight into one of that weight and one of the next, for all rows
and for a batch of queries at a time. The top rows are then chosen from the most
significant slice of the sum downward; rows that are still equal at the boundary
have equal scores, and the smallest ids of them win.

Queries are met with the index in tiles: a block of rows and a block of queries.
The tiles form a grid, cut into cells that are dealt out one by one, so a block of rows
goes to one cell for each band of queries and not to each query block. Only k rows for
each query leave a tile.

Defined cases: vectors that are null or hold null or non-finite components take no
part; scores are exact, and where a component or a score of some row might not be a
64-bit integer the search fails and says so; missing components of shorter vectors are 0; an empty vector scores 0; rows that repeat a vec_id all take
part, but for a query of that id; a null vec_id is no query and comes last among
ties; an empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage

#: Scaled components and scores are under this; floats tell, which round, so there is a bit to spare.
BOUND = 1 << 61
BLOCK_ROWS, QUERY_BLOCK, QUERY_BATCH = 4096, 256, 16
#: Blocks of a cell's side at most.
CELL_SIDE = 16
_NO_ID = np.iinfo(np.int64).max
_INDEX = "block int, rows int, dims int, bits int, low bigint, ids binary, slices binary"
_HIT = "query_id bigint, vec_id bigint, score bigint"


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component; null for vectors that take no part."""

    def floor(x: Column) -> Column:
        wide = F.abs(x.cast("double") * 256) >= float(BOUND)
        return F.when(wide, F.raise_error(F.lit("a component times 256 is no 64-bit integer")).cast("long")).otherwise(F.floor(x.cast("double") * 256).cast("long"))

    scaled = F.transform(vector, floor)
    fine = F.forall(vector, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when(vector.isNotNull() & fine, scaled)


def _padded(lists: list) -> np.ndarray:
    dims = max(map(len, lists), default=0)
    out = np.zeros((len(lists), dims), np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _slice_block(ids: np.ndarray, values: np.ndarray) -> list:
    """One index block: rows by id, bitmaps of 64-row words for every attribute and bit."""
    order = np.argsort(ids, kind="stable")
    ids, values = ids[order], values[order]
    low = int(values.min()) if values.size else 0
    bits = max(1, int(values.max() - low).bit_length()) if values.size else 1
    padded = np.zeros((values.shape[1], -(-len(ids) // 64) * 64), np.int64)
    padded[:, : len(ids)] = (values - low).T
    slices = np.stack([np.packbits((padded >> b) & 1 == 1, axis=1, bitorder="little") for b in range(bits)], axis=1) if values.shape[1] else np.zeros(0, np.uint8)
    return [len(ids), values.shape[1], bits, low, ids.tobytes(), np.ascontiguousarray(slices).tobytes()]


def _build(most_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lists, number = [], [], TaskContext.get().partitionId()

        def block():
            made = _slice_block(np.array([_NO_ID if i is None else i for i in ids], np.int64), _padded(lists))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([number, *made], (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], [f.split()[0] for f in _INDEX.split(", ")])

        for batch in batches:
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                ids.append(i)
                lists.append(v)
                if len(ids) == most_rows:
                    yield block()
                    ids, lists = [], []
        if ids:
            yield block()

    return run


def _added(addends: dict[int, np.ndarray]) -> list[np.ndarray]:
    """Bitmaps of the sum, least significant first. addends[p]: (queries, n, words), each of weight 2^p."""
    out, p = [], 0
    while addends:
        here = addends.pop(p, None)
        while here is not None and here.shape[1] > 1:
            three = here.shape[1] // 3
            if three:
                a, b, c = here[:, :three], here[:, three : 2 * three], here[:, 2 * three : 3 * three]
                half = a ^ b
                total, carry, rest = half ^ c, (a & b) | (half & c), here[:, 3 * three :]
            else:
                a, b = here[:, :1], here[:, 1:]
                total, carry, rest = a ^ b, a & b, here[:, 2:]
            here = np.concatenate([total, rest], axis=1) if rest.shape[1] else total
            addends[p + 1] = np.concatenate([addends[p + 1], carry], axis=1) if p + 1 in addends else carry
        out.append(None if here is None else here[:, 0])
        p += 1
    return out


def search_block(block: dict, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec id, score): the k best rows of a block for each query."""
    n, dims, bits, low = block["rows"], min(block["dims"], queries.shape[1]), block["bits"], block["low"]
    ids, words = np.frombuffer(block["ids"], np.int64), -(-n // 64)
    raw = np.frombuffer(block["slices"], np.uint64).reshape(block["dims"] * bits, words)[: dims * bits]
    # Rows of `slices`: the slices, their complements, and an empty bitmap.
    slices = np.concatenate([raw, ~raw, np.zeros((1, words), np.uint64)])
    weight, queries = np.abs(queries[:, :dims]), queries[:, :dims]
    top = (1 << bits) - 1
    if bits > 61 or (weight.astype(float).sum(axis=1) * (max(abs(low), abs(low + top)) + top)).max(initial=0) >= BOUND:
        raise OverflowError("a score might be no 64-bit integer")
    plus = np.where(queries < 0, -weight * (top + low), weight * low).sum(axis=1)
    addends: dict[int, list[np.ndarray]] = {}
    for i in range(int(weight.max(initial=0)).bit_length()):
        has = (weight >> i) & 1 == 1
        for b in range(bits):
            at = np.arange(dims) * bits + b + np.where(queries < 0, dims * bits, 0)
            addends.setdefault(i + b, []).append(np.where(has, at, 2 * dims * bits))
    taken = {}
    for p, parts in addends.items():
        at = np.sort(np.concatenate(parts, axis=1), axis=1)  # the empty bitmap comes last
        most = int((at < 2 * dims * bits).sum(axis=1).max())
        if most:
            taken[p] = slices[at[:, :most]]
    total = _added(taken)

    rows = np.zeros(words * 64, bool)
    rows[:n] = True
    allowed = np.repeat(np.packbits(rows, bitorder="little").view(np.uint64)[None], len(queries), axis=0)
    for j, q in enumerate(query_ids):
        for own in range(int(np.searchsorted(ids, q)), int(np.searchsorted(ids, q, "right"))):
            allowed[j, own // 64] &= ~(np.uint64(1) << np.uint64(own % 64))
    sure, equal = np.zeros_like(allowed), allowed
    for bitmap in reversed([t for t in total if t is not None]):
        both = sure | (equal & bitmap)
        over = (np.bitwise_count(both).sum(axis=1) > k)[:, None]
        sure, equal = np.where(over, sure, both), np.where(over, equal & bitmap, equal & ~bitmap)
    bit = lambda m: np.unpackbits(m.view(np.uint8), axis=1, bitorder="little").astype(bool)
    chosen, tied = bit(sure), bit(equal)
    need = k - chosen.sum(axis=1)
    chosen |= tied & (np.cumsum(tied, axis=1) <= need[:, None])
    q, row = np.nonzero(chosen)
    score = plus[q]
    for p, bitmap in enumerate(total):
        if bitmap is not None:
            score = score + (((bitmap[q, row // 64] >> (row % 64).astype(np.uint64)) & np.uint64(1)).astype(np.int64) << p)
    return query_ids[q], ids[row], score


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                tile = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                ids = np.array([x["query_id"] for x in tile["queries"]], np.int64)
                values = _padded([x["v"] for x in tile["queries"]])
                for a in range(0, len(ids), QUERY_BATCH):
                    q, v, s = search_block(tile, ids[a : a + QUERY_BATCH], values[a : a + QUERY_BATCH], k)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v, mask=v == _NO_ID), pa.array(s)], ["query_id", "vec_id", "score"])

    return run


def build_index(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The bit-sliced index of (vec_id, v) rows: a row for each block of at most 2 * block_rows."""
    parts = max(1, -(-vectors.count() // block_rows))
    dealt = vectors.repartition(parts, F.xxhash64("vec_id", "v"))
    return stage(dealt.mapInArrow(_build(2 * block_rows), _INDEX), "topk-index")


def top_k(vectors: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: for each of `queries` (query_id, v) the
    k best of all `vectors` (vec_id, v) but those with the query's own id."""
    index = build_index(vectors, block_rows)
    blocks, asked_blocks = max(1, index.count()), max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.withColumn("qb", F.pmod(F.xxhash64("query_id", "v"), F.lit(asked_blocks)).cast("int")).groupBy("qb").agg(F.collect_list(F.struct("query_id", "v")).alias("queries"))
    # Cells of the grid of tiles: as many a side as give each core a few, and at most CELL_SIDE.
    side = max(1, round((blocks * asked_blocks / (4 * queries.sparkSession.sparkContext.defaultParallelism)) ** 0.5))
    side = min(side, CELL_SIDE)
    wide, high = -(-blocks // side), -(-asked_blocks // side)
    parts = wide * high
    column = F.col("block") % wide
    rows = index.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(high - 1)), lambda y: column * high + y)))
    cols = asked.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda x: x * high + F.col("qb") % high)))
    tiles = rows.repartition(parts, "cell").join(cols.repartition(parts, "cell").hint("shuffle_hash"), "cell")
    hits = tiles.select("rows", "dims", "bits", "low", "ids", "slices", "queries").mapInArrow(_search(k), _HIT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `embeddings`; the queries are those whose vec_id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = rows.select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("v")).where("v is not null")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v")
    return top_k(vectors, queries, 5)


ORACLE = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT vec_id, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM good),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM part q JOIN part c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY 1, 2)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""
