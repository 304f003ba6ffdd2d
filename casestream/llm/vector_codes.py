"""Vector code compression: product quantisation whose codebooks come from Lloyd's
rounds with the filtering method.

A vector's components become integers floor(SCALE * x); it is cut into PARTS equal
parts, each coded by the nearest of ENTRIES codebook entries. Every partition cuts its
vectors into blocks of about BLOCK_VALUES components and builds, once, a kd-tree over
each part of a block: points in leaf order, and for each node its bounding box, the sum
of its points and (by the tree's shape) their count. The trees are a staged table. A round
sends the small codebooks to them: from the root down a node keeps the entries that may be nearest to
some point of its box; when one is left, the node's cached sum and count go to it
and the subtree is done. Only leaves with several entries look at points. An entry is
dropped against another if the box's corner that favours it most is farther from it (or
as far, and its index is larger), so ties go to the lower index exactly as by points.
Sums are added up by Spark; the driver gets at most PARTS x ENTRIES rows a round.

All arithmetic is on integers, so results don't depend on blocks, partitions or order.

Defined cases: rows with a null vector, null or non-finite components take no part and
don't come out; vectors shorter than the longest, and lengths that PARTS doesn't divide, are
filled up with zeros; the first entries come from the smallest vec_ids (null last, of
equal ids the smaller vector), so fewer than ENTRIES rows make as many entries; equal entries tie to the first, and
an entry without points stays as it is; rows that repeat a vec_id get a code each; an
empty table gives no rows; components so large that sums of squares might not fit 64 bits are
refused with an error; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, stage

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components of a block's vectors, about, and points of a leaf at most.
BLOCK_VALUES, LEAF = 1 << 19, 32
#: Largest component, in integers: squared distances from twice a box's centre then fit 62 bits for parts of 2^10 components.
LARGEST = 1 << 24

_TREES = "ids array<bigint>, labels array<string>, parts array<struct<perm binary, points binary, low binary, high binary, sum binary>>"


def _bounds(n: int, depth: int) -> np.ndarray:
    """Where the nodes of a level begin, and n: halves of halves of n points."""
    edges = np.array([0, n], dtype=np.int64)
    for _ in range(depth):
        middle = (edges[:-1] + edges[1:]) // 2
        edges = np.insert(edges, np.arange(1, len(edges)), middle)
    return edges


def _depth(n: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, n) / LEAF))))


class Tree:
    """A kd-tree over points: level by level its nodes' boxes and sums; a level's nodes are slices of the points."""

    def __init__(self, perm: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray):
        self.perm, self.points, self.low, self.high, self.total = perm, points, low, high, total
        self.depth = _depth(len(points))

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        n, depth = len(points), _depth(len(points))
        perm, boxes = np.arange(n), []
        for level in range(depth + 1):
            edges, here = _bounds(n, level), points[perm]
            low, high = (f.reduceat(here, edges[:-1], axis=0) for f in (np.minimum, np.maximum))
            boxes.append((low, high, np.add.reduceat(here, edges[:-1], axis=0)))
            if level < depth:  # each node's points in order of the axis on which it is widest
                node = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
                axis = (high - low).argmax(axis=1)
                perm = perm[np.lexsort((here[np.arange(n), axis[node]], node))]
        return cls(perm, points[perm], *(np.concatenate([b[i] for b in boxes]) for i in range(3)))

    def pack(self) -> dict[str, bytes]:
        kinds = {"perm": np.int32, "points": np.int32, "low": np.int32, "high": np.int32, "total": np.int64}
        return {("sum" if k == "total" else k): getattr(self, k).astype(t).tobytes() for k, t in kinds.items()}

    @classmethod
    def unpack(cls, held: dict[str, bytes], width: int) -> Tree:
        perm = np.frombuffer(held["perm"], np.int32)
        whole = [np.frombuffer(held[k], np.int64 if k == "sum" else np.int32).astype(np.int64).reshape(-1, width) for k in ("points", "low", "high", "sum")]
        return cls(perm, *whole)

    def assign(self, book: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(entries, firsts, lasts, sums) of whole subtrees, and of single points from leaves: the slices of points that go to an entry."""
        n, k, offset = len(self.points), len(book), 0
        live, kept = np.zeros(1, np.int64), np.ones((1, k), dtype=bool)
        for level in range(self.depth + 1):
            edges = _bounds(n, level)
            low, high = self.low[offset + live], self.high[offset + live]
            kept = _possible(book, low, high, kept)
            one = kept.sum(axis=1) == 1
            done = live[one]
            yield kept[one].argmax(axis=1), edges[done], edges[done + 1], self.total[offset + done]
            live, kept = live[~one], kept[~one]
            if level < self.depth:
                offset += len(edges) - 1
                live, kept = np.repeat(2 * live, 2) + np.tile([0, 1], len(live)), np.repeat(kept, 2, axis=0)
        if len(live):
            at = _slices(edges[live], edges[live + 1])
            points = self.points[at]
            yield _nearest(points, book, np.repeat(kept, edges[live + 1] - edges[live], axis=0)), at, at + 1, points


_FAR = np.iinfo(np.int64).max


def _slices(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The places in slices, one slice after the other."""
    sizes = last - first
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances (points, entries), entry by entry."""
    return np.stack([((points - z) ** 2).sum(axis=1) for z in book], axis=1)


def _nearest(points: np.ndarray, book: np.ndarray, kept: np.ndarray) -> np.ndarray:
    return np.where(kept, _distances(points, book), _FAR).argmin(axis=1)


def _possible(book: np.ndarray, low: np.ndarray, high: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """Of each box's entries those that may be nearest to a point in it, as a mask. The entry nearest to the box's
    centre is held against every other at the corner that lies farthest towards the other."""
    centre = low + high
    best = np.where(kept, _distances(centre, 2 * book), _FAR).argmin(axis=1)
    hub, out = book[best], kept.copy()
    for i, z in enumerate(book):
        corner = np.where(z > hub, high, low)
        margin = ((corner - z) ** 2).sum(axis=1) - ((corner - hub) ** 2).sum(axis=1)
        out[:, i] &= (best == i) | (margin < 0) | ((margin == 0) & (i < best))
    return out


def _build(width: int):
    """Blocks of rows (vec_id, label, v) to rows of _TREES; `width` components of each part."""
    length, rows = PARTS * width, max(1, BLOCK_VALUES // (PARTS * width))

    def trees(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        v = table.column("v").combine_chunks()
        sizes = v.value_lengths().to_numpy()
        whole = np.zeros((len(v), length), dtype=np.int64)
        whole[np.arange(length) < sizes[:, None]] = v.flatten().to_numpy()
        parts = [Tree.build(np.ascontiguousarray(whole[:, p * width : (p + 1) * width])).pack() for p in range(PARTS)]
        kind = pa.list_(pa.struct([(k, pa.binary()) for k in ("perm", "points", "low", "high", "sum")]))
        columns = [pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([table.column("label").to_pylist()], pa.list_(pa.string())), pa.array([parts], kind)]
        return pa.RecordBatch.from_arrays(columns, ["ids", "labels", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                take = min(batch.num_rows, rows - n)
                held.append(batch.slice(0, take))
                batch, n = batch.slice(take), n + take
                if n == rows:
                    yield trees(held)
                    held, n = [], 0
        if held:
            yield trees(held)

    return run


def _round(books: np.ndarray):
    """Rows of _TREES to (part, entry, n, total): what each codebook entry gets, added up for a task."""
    entries, width = books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((PARTS, entries), np.int64), np.zeros((PARTS, entries, width), np.int64)
        for batch in batches:
            for held in batch.column("parts"):
                for p, packed in enumerate(held.as_py()):
                    for entry, first, last, sums in Tree.unpack(packed, width).assign(books[p]):
                        np.add.at(count[p], entry, last - first)
                        np.add.at(total[p], entry, sums)
        part, entry = np.nonzero(count)
        sums = pa.array(list(total[part, entry]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), sums], ["part", "entry", "n", "total"])

    return run


def _codes(books: np.ndarray):
    """Rows of _TREES to (vec_id, label, code, error)."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, held in zip(*(batch.column(c) for c in ("ids", "labels", "parts")), strict=True):
                n = len(ids)
                code, error = np.zeros((n, PARTS), np.int64), np.zeros(n, np.int64)
                for p, packed in enumerate(held.as_py()):
                    tree = Tree.unpack(packed, width)
                    found = np.zeros(n, np.int64)
                    for entry, first, last, _ in tree.assign(books[p]):
                        found[_slices(first, last)] = np.repeat(entry, last - first)
                    code[tree.perm, p] = found
                    error[tree.perm] += ((tree.points - books[p][found]) ** 2).sum(axis=1)
                text = ["".join(f"{c:02x}" for c in row) for row in code]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def quantised(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, v): the rows that take part, with integer components; labels as text."""
    x = F.transform(vector, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x")).where(F.col("x").isNotNull() & ~bad)
    scaled = F.transform("x", lambda c: F.floor(F.when(F.abs(c) * SCALE <= LARGEST, c * SCALE)))
    fits = F.forall(scaled, lambda c: c.isNotNull())
    refused = F.raise_error(F.lit(f"a component is beyond {LARGEST // SCALE}")).cast("array<bigint>")
    return rows.select("vec_id", "label", F.when(fits, scaled).otherwise(refused).alias("v"))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, np.ndarray | None]:
    """((vec_id, label, code, error), codebooks[part, entry, component]); no codebooks without rows."""
    spark = vectors.sparkSession
    rows = quantised(vectors, vector)
    smallest = F.struct(F.col("vec_id").isNull().alias("last"), "vec_id", "v")
    longest = rows.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "vec_id bigint, label string, code string, error bigint"), None
    width = max(1, -(-longest // PARTS))
    first = [r.v for r in rows.select("v", smallest.alias("place")).orderBy("place").limit(ENTRIES).collect()]
    start = np.zeros((len(first), PARTS * width), dtype=np.int64)
    for i, v in enumerate(first):
        start[i, : len(v)] = v
    books = np.ascontiguousarray(start.reshape(len(first), PARTS, width).transpose(1, 0, 2))
    trees = stage(rows.mapInArrow(_build(width), _TREES), "vector-trees")
    for _ in range(ROUNDS):
        sums = trees.select("parts").mapInArrow(_round(books), "part int, entry int, n bigint, total array<bigint>")
        sums = sums.select("part", "entry", "n", F.posexplode("total").alias("i", "x")).groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        new = books.copy()
        for r in sums.collect():  # bounded by the codebooks' size
            new[r.part, r.entry, r.i] = r.x // r.n
        books = new
    return trees.mapInArrow(_codes(books), "vec_id bigint, label string, code string, error bigint"), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `embeddings` table: vec_id, code, error, the error of its label, and the digest of the codebooks."""
    coded, books = vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    coded = stage(coded, "vector-codes")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    out = join_by_key(coded, labels, ["label"], "n")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books) if books is not None else None).cast("string").alias("codebooks_sha256"))


def _oracle() -> str:
    """The same by plain distances, a pair of common tables for each round; vectors of one length that PARTS divides."""
    steps = [f"""
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT r, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS w FROM kept, range({PARTS}) t(p)),
x AS (SELECT r, p, i, w[i + 1] AS c FROM cut, LATERAL (SELECT unnest(range(len(w))) AS i)),
b0 AS (SELECT p, r - 1 AS e, i, c FROM x WHERE r <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""
d{k} AS (SELECT r, x.p, e, sum((x.c - b.c) * (x.c - b.c)) AS d FROM x JOIN b{k} b ON x.p = b.p AND x.i = b.i GROUP BY r, x.p, e),
a{k} AS (SELECT r, p, arg_min(e, (d, e)) AS e, CAST(min(d) AS BIGINT) AS d FROM d{k} GROUP BY r, p)""")
        if k < ROUNDS:
            steps.append(f"""
m{k} AS (SELECT x.p, e, i, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM x JOIN a{k} a ON x.r = a.r AND x.p = a.p GROUP BY x.p, e, i),
b{k + 1} AS (SELECT b.p, b.e, b.i, CASE WHEN n IS NULL THEN b.c ELSE (s - ((s % n) + n) % n) // n END AS c FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e AND b.i = m.i)""")
    return ",".join(steps) + f""",
done AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{ROUNDS}) AS codebooks_sha256
FROM kept JOIN done USING (r)
"""


ORACLE = _oracle()
