"""Best-fit packing of documents into sequences of a fixed length.

Documents are encoded with a public tokenizer, closed with an end id, and cut
only where they are longer than a sequence. Best-fit decreasing then runs over
the whole corpus at once: lengths are integers up to the capacity, so their
counts (at most `capacity` numbers, whatever the corpus) are all that the
driver needs. A segment tree over the remaining capacities finds the tightest
open bin in logarithmic time; equal documents that meet equal bins are placed
together. The outcome is a list of runs: "the next n pieces of length l go, m
to a bin, to bins b, b + 1, ... at offset o". Every piece then finds its place
from its rank among the pieces of its length.

Defined cases: a null or empty text is one piece holding the end id; a text may be of
any length; a null doc_id is handed on; other columns aren't read; rows that
repeat a doc_id are documents of their own, told apart by their text or, where
that is equal too, interchangeable; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import public_tokenizer, stage, text_slices
from .tokens import encoder

CAPACITY, END_ID = 2048, 0
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_SALTS = 256


class OpenBins:
    """A segment tree over remaining capacities 0..capacity: how many open bins
    have each, and the smallest capacity of at least x that some bin has."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.width)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def _mark(self, room: int, here: bool) -> None:
        at = self.width + room
        self.some[at] = here
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] | self.some[2 * at + 1]

    def add(self, room: int, first: int, count: int) -> None:
        """`count` bins, numbered from `first`, have `room` left."""
        self.bins.setdefault(room, []).append((first, count))
        if len(self.bins[room]) == 1:
            self._mark(room, True)

    def take(self, room: int, most: int) -> tuple[int, int]:
        """Up to `most` of the bins with `room` left; they are open no more."""
        first, count = self.bins[room].pop()
        if count > most:
            self.bins[room].append((first + most, count - most))
        elif not self.bins[room]:
            self._mark(room, False)
        return first, min(count, most)

    def tightest(self, least: int) -> int | None:
        """The smallest room of at least `least` that an open bin has."""
        at = self.width + least
        if self.some[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.width
            at //= 2
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, rank from, rank to, first bin, offset, pieces a bin) for all
    pieces of the lengths counted, by best-fit decreasing."""
    bins, runs, n_bins = OpenBins(capacity), [], 0
    for length in sorted((x for x in counts if x > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                # As the tightest fit fills a new bin before it opens another, bins open full of this length.
                room, per = capacity, capacity // length
                first, count = n_bins, max(1, left // per)
                n_bins += count
            else:
                per = room // length
                first, count = bins.take(room, max(1, left // per))
            per = min(per, left)
            runs.append((length, rank, rank + per * count, first, capacity - room, per))
            rank, left = rank + per * count, left - per * count
            if room > per * length:
                bins.add(room - per * length, first, count)
    return runs


def _cut(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            for row, data, offsets in text_slices(batch.column("text")):
                ids, at = encode(data, offsets)
                rows = []
                for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                    own = np.append(ids[a:b], np.int32(end_id)).astype("<u4")
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        rows.append((row + i, k, s, len(part), zlib.crc32(part.tobytes())))
                where, *rest = (np.array(x) for x in zip(*rows, strict=True))
                columns = [batch.column("doc_id").take(pa.array(where)), *(pa.array(x, t) for x, t in zip(rest, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _PIECES.split(", ")])

    return run


def _place(runs: np.ndarray):
    """Sequence and offset by (length, rank). `runs` is sorted by both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = runs[:, 0] * (1 << 44) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            _, low, _, first, offset, per = runs[np.searchsorted(keys, length * (1 << 44) + rank, "right") - 1].T
            sequence, nth = first + (rank - low) // per, (rank - low) % per
            out = {"sequence_id": pa.array(sequence), "offset": pa.array(offset + nth * length)}
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _PIECE_NAMES), *out.values()], [*_PIECE_NAMES, *out])

    return run


_PIECE_NAMES = [f.split()[0] for f in _PIECES.split(", ")]


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32,
    sequence_id and offset."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = texts.mapInArrow(_cut(tokenizer, capacity, end_id), _PIECES)
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(_SALTS)).cast("int")
    pieces = stage(pieces.withColumn("salt", salt), "pack-pieces")

    counted = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = stage(counted.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))), "pack-counts")
    # At most `capacity` rows.
    per_length = ahead.groupBy("length").agg(F.sum("n").alias("n")).collect()
    runs = sorted(best_fit_runs({r["length"]: r["n"] for r in per_length}, capacity))

    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("nth", F.row_number().over(inside))
    ranked = ranked.join(ahead.select("length", "salt", "ahead"), ["length", "salt"])
    ranked = ranked.select(*_PIECE_NAMES, (F.col("ahead") + F.col("nth") - 1).alias("rank"))
    return ranked.mapInArrow(_place(np.array(runs, dtype=np.int64).reshape(-1, 6)), f"{_PIECES}, sequence_id bigint, offset bigint")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents and their places."""
    return pack_documents(docs, public_tokenizer())


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table, sequences of 2048."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())
