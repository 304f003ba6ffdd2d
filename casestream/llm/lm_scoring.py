"""Language-model scores from a log-frequency Bloom filter.

Words (A-Z lower-cased) and word pairs of the training texts are counted by
64-bit hash, whose lowest bit tells pairs from words. A count c has the level
1 + floor(log c / log BASE); an n-gram of level q is put into the filter q times,
each time hashed with another of the numbers 1..q. A count is read back by probing
1, 2, ... until a probe fails, so a false positive can lift it by a level now and
then but never lowers it. Each word's probability is a mixture of the pair's and the
word's own smoothed relative frequency.

The filter has BITS_EACH bits for each number put in, as the histogram of all
n-grams' levels says, and leaves none out. Up to BROADCAST_BITS it is sent to all
workers. A larger one stays a table of pages, and texts go in blocks of about BLOCK
tokens: a block asks for each of its distinct n-grams once, the tasks that hold a
bucket's pages answer, and answers meet their block's texts. An n-gram, however frequent, is
asked for once by a block; level 1, which most have, needs no answer. Both ways make
the same probes and give the same scores.

The base score takes exact counts of single words: the levels that hold at most TOP of them, from the
highest down, are sent to the workers as two arrays; occurrences of all other
words meet their counts in a join.

Defined cases: a null or empty text is the end token alone; a text may be of any
length; a null doc_id counts as an empty string for the split; rows that repeat a
doc_id are scored each; with no training text every probability is 1, so scores are 0;
an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, stage, text_slices, word_hashes

BASE = 1.5
PAGE_BITS = 1 << 15
BROADCAST_BITS = 1 << 29
BITS_EACH = 6
TOP = 1 << 18
BLOCK = 1 << 22
FOLDS, HELD_OUT = 5, 1
PAIR_SHARE = 0.6

_END = np.uint64(0x5851F42D4C957F2D)
_U = np.uint64
_BIT = np.left_shift(1, np.arange(8)).astype(np.uint8)


def _streams(batch: pa.RecordBatch, column: str = "text"):
    """(first row, tokens, first token of each text): word hashes, each text closed with the end token."""
    for row, data, offsets in text_slices(batch.column(column)):
        hashed, first = word_hashes(data, offsets)
        yield row, np.insert(hashed, first[1:], _END), first + np.arange(len(first))


def _before(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The token before each one; the end token also stands before a text."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = _END
    return before


def _word_keys(tokens: np.ndarray) -> np.ndarray:
    return tokens & ~_U(1)


def _pair_keys(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _U(0x9E3779B97F4A7C15) + tokens + _U(2)) | _U(1)


def _page(h: np.ndarray, buckets: int, pages: int) -> np.ndarray:
    """An n-gram's page: one of its bucket's. `buckets` is a power of two and divides `pages`."""
    each = pages // buckets
    return (h >> _U(40) & _U(buckets - 1)) * _U(each) + (h >> _U(20) & _U(0xFFFFF)) % _U(each)


def _bucket(buckets: int):
    return F.shiftrightunsigned("h", 40).bitwiseAND(F.lit(buckets - 1)).cast("int")


def _count(most: int = 1_500_000):
    """(h, c) with the counts of up to `most` tokens put together in memory."""

    def flush(parts):
        for n in (0, 1):
            h, c = np.unique(np.concatenate([p[n] for p in parts]), return_counts=True)
            for a in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[a : a + 100_000].view(np.int64)), pa.array(c[a : a + 100_000].astype(np.int64))], ["h", "c"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, tokens, first in _streams(batch):
                parts.append((_word_keys(tokens), _pair_keys(_before(tokens, first), tokens)))
                held += len(tokens)
                if held >= most:
                    yield from flush(parts)
                    parts, held = [], 0
        if parts:
            yield from flush(parts)

    return run


def levels(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(count) / np.log(BASE) + 1e-9).astype(np.int64)


def _probe_bits(h: np.ndarray, level: int) -> tuple[np.ndarray, ...]:
    g = mix(h + _U(level * 0xA0761D6478BD642F % (1 << 64)))
    return tuple((g >> _U(15 * i)) & _U(PAGE_BITS - 1) for i in range(3))


def _fill(buckets: int, pages: int):
    """(page, bits): the filter's pages that a task's n-grams set."""
    size = PAGE_BITS // 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bits = np.zeros(0, _U), np.zeros(0, np.uint8)
        for batch in batches:
            h, level = batch.column("h").to_numpy().view(_U), levels(batch.column("c").to_numpy())
            page = _page(h, buckets, pages)
            every = np.union1d(known, page)
            if len(every) > len(known):
                grown = np.zeros((len(every), size), np.uint8)
                grown[np.searchsorted(every, known)] = bits.reshape(-1, size)
                known, bits = every, grown.ravel()
            base = np.searchsorted(known, page) * size
            for q in range(1, int(level.max(initial=0)) + 1):
                some = level >= q
                for at in _probe_bits(h[some], q):
                    np.bitwise_or.at(bits, base[some] + (at >> _U(3)).astype(np.int64), _BIT[(at & _U(7)).astype(np.int64)])
        for a in range(0, len(known), 256):
            part = range(a, min(a + 256, len(known)))
            yield pa.RecordBatch.from_arrays([pa.array(known[part.start : part.stop].astype(np.int64)), pa.array([bits[i * size : (i + 1) * size].tobytes() for i in part], pa.binary())], ["page", "bits"])

    return run


def _probed(bits: np.ndarray, base: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The level of each hash, whose page begins at byte `base`, by probing 1, 2, ... until one fails."""
    level = np.zeros(len(h), np.int64)
    at = np.arange(len(h))
    for q in range(1, 200):
        hit = np.ones(len(at), bool)
        for place in _probe_bits(h[at], q):
            hit &= (bits[base[at] + (place >> _U(3)).astype(np.int64)] >> (place & _U(7)).astype(np.uint8)) & 1 == 1
        at = at[hit]
        if not len(at):
            break
        level[at] = q
    return level


def read_levels(bits: np.ndarray, buckets: int, h: np.ndarray) -> np.ndarray:
    """The level of each hash in a whole filter."""
    size = PAGE_BITS // 8
    return _probed(bits, _page(h, buckets, len(bits) // size).astype(np.int64) * size, h)


def _answer(buckets: int, pages: int, most: int = 1_000_000):
    """(block, h, q): the levels of the n-grams that blocks ask a bucket for, but for level 1. About `most` are probed at a time."""
    each, size = pages // buckets, PAGE_BITS // 8

    def run(key: tuple, asked: pa.Table, filled: pa.Table) -> pa.Table:
        bits = np.zeros((each, size), np.uint8)
        for page, own in zip(filled.column("page").to_pylist(), filled.column("bits"), strict=True):
            bits[page % each] = np.frombuffer(own.as_buffer(), np.uint8)
        blocks, found = asked.column("block").to_numpy(), []
        grams = [np.frombuffer(x.as_buffer(), _U) for x in asked.column("asked")]
        part = np.cumsum([len(g) for g in grams]) // most
        for k in np.unique(part):
            rows = np.flatnonzero(part == k)
            h = np.concatenate([grams[i] for i in rows])
            q = _probed(bits.ravel(), _page(h, buckets, pages).astype(np.int64) % each * size, h)
            ends = np.append(0, np.cumsum([len(grams[i]) for i in rows]))
            for i, a, b in zip(rows, ends[:-1], ends[1:], strict=True):
                keep = q[a:b] != 1
                if keep.any():
                    found.append((blocks[i], h[a:b][keep].tobytes(), q[a:b][keep].astype(np.uint8).tobytes()))
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "h", "q"])

    return run


def level_counts() -> np.ndarray:
    """The count that stands for each level: the middle of its range, 0 for level 0."""
    low = np.ceil(BASE ** np.arange(200) - 1e-9)
    return np.concatenate([[0.0], (low[:-1] + np.maximum(low[1:] - 1, low[:-1])) / 2])


_SCORED = "key bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, rare array<bigint>, block bigint, text string"


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int64) if values.dtype != _U else values.view(np.int64)))


def _log_p(tokens: np.ndarray, first: np.ndarray, read, whole: float, pair_share: float) -> np.ndarray:
    """log10 of each token's probability; `read` gives the levels of hashes."""
    means, before = level_counts(), _before(tokens, first)
    unique, of = np.unique(_word_keys(tokens), return_inverse=True)
    word, pair = means[read(unique)], means[read(_pair_keys(before, tokens))]
    # The end token stands before each text and closes it, so all words before others are among `unique`.
    ahead = word[np.searchsorted(unique, _word_keys(before))]
    ratio = np.minimum(1.0, pair / np.maximum(ahead, 1.0))
    share = np.where(ahead > 0, pair_share, 0.0)
    return np.log10(np.minimum(1.0, share * ratio + (1 - share) * ((word + 0.5) / whole)[of]))


def _score(model, pair_share: float, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        bits, n, v = m["bits"], m["n"], m["v"]
        top_h, top_c = np.frombuffer(m["top_h"], _U), np.frombuffer(m["top_c"], np.int64)
        whole = n + 0.5 * (v + 1)
        key = block = TaskContext.get().partitionId() << 33
        held = 0
        for batch in batches:
            for row, tokens, first in _streams(batch):
                docs = len(first) - 1
                unique, of = np.unique(_word_keys(tokens), return_inverse=True)
                at = np.minimum(np.searchsorted(top_h, unique), max(0, len(top_h) - 1))
                hot = top_h[at] == unique if len(top_h) else np.zeros(len(unique), bool)
                log_base = np.where(hot, np.log10(((top_c[at] if len(top_h) else 0) + 0.5) / whole), 0.0)
                rare_at = np.flatnonzero(~hot[of])
                rare = _lists(unique[of[rare_at]], np.searchsorted(rare_at, first))
                if bits is None:
                    if held and held + len(tokens) > most:
                        block, held = block + 1, 0
                    held += len(tokens)
                    log_p, later = np.zeros(len(tokens)), [pa.array(np.full(docs, block)), batch.column("text").slice(row, docs)]
                else:
                    whole_filter = np.frombuffer(bits, np.uint8)
                    log_p = _log_p(tokens, first, lambda h, f=whole_filter: read_levels(f, m["buckets"], h), whole, pair_share)
                    later = [pa.nulls(docs, pa.int64()), pa.nulls(docs, pa.string())]
                sums = [np.add.reduceat(x, first[:-1]) for x in (hot[of].astype(np.int64), log_base[of], log_p)]
                columns = [pa.array(np.arange(key, key + docs)), batch.column("doc_id").slice(row, docs), batch.column("held_out").slice(row, docs), pa.array(np.diff(first)), *(pa.array(s) for s in sums), rare, *later]
                key += docs
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _SCORED.split(", ")])

    return run


def _ask(buckets: int):
    """(block, bucket, asked): the distinct n-grams of each block by bucket. A block that is read in two parts asks twice for what both have."""

    def flush(block, parts):
        h = np.unique(np.concatenate(parts))
        bucket = (h >> _U(40) & _U(buckets - 1)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        h, bucket = h[order], bucket[order]
        cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(h))
        for a in range(0, len(cuts) - 1, 1000):
            some = cuts[a : a + 1001]
            columns = [pa.array(np.full(len(some) - 1, block)), pa.array(bucket[some[:-1]]), pa.array([h[x:y].tobytes() for x, y in zip(some[:-1], some[1:], strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "bucket", "asked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, parts = None, []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            starts = np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])) if len(blocks) else []
            for a, b in zip(starts, [*starts[1:], len(blocks)], strict=True):
                if parts and blocks[a] != last:
                    yield from flush(last, parts)
                    parts = []
                last = blocks[a]
                for _, tokens, first in _streams(batch.slice(a, b - a)):
                    parts.append(np.unique(np.concatenate([_word_keys(tokens), _pair_keys(_before(tokens, first), tokens)])))
        if parts:
            yield from flush(last, parts)

    return run


def _score_block(whole: float, pair_share: float):
    """(key, score) of a block's texts with the answers to what it asked."""

    def run(key: tuple, texts: pa.Table, answers: pa.Table) -> pa.Table:
        h, at = np.unique(np.frombuffer(b"".join(answers.column("h").to_pylist()), _U), return_index=True)
        q = np.frombuffer(b"".join(answers.column("q").to_pylist()), np.uint8)[at].astype(np.int64)

        def read(x: np.ndarray) -> np.ndarray:
            if not len(h):
                return np.ones(len(x), np.int64)
            at = np.minimum(np.searchsorted(h, x), len(h) - 1)
            return np.where(h[at] == x, q[at], 1)

        scores = [np.zeros(0)]
        for batch in texts.to_batches():
            for _, tokens, first in _streams(batch):
                scores.append(np.add.reduceat(_log_p(tokens, first, read, whole, pair_share), first[:-1]))
        return pa.table({"key": texts.column("key"), "paged_score": np.concatenate(scores)})

    return run


def _score_by_page(scored: DataFrame, filled: DataFrame, buckets: int, pages: int, whole: float, pair_share: float) -> DataFrame:
    """(key, paged_score) of `scored` with a filter that stays a table of pages."""
    asked = scored.select("block", "text").mapInArrow(_ask(buckets), "block bigint, bucket int, asked binary")
    held = filled.withColumn("bucket", F.floor(F.col("page") / (pages // buckets)).cast("int"))
    answers = asked.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInArrow(_answer(buckets, pages), "block bigint, h binary, q binary")
    texts = scored.select("block", "key", "text")
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_block(whole, pair_share), "key bigint, paged_score double")


def score_texts(docs: DataFrame, bits_each: int = BITS_EACH, broadcast_bits: int = BROADCAST_BITS, top: int = TOP, pair_share: float = PAIR_SHARE, block: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of `docs`."""
    spark = docs.sparkSession
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold == HELD_OUT).alias("held_out"))

    # Buckets, and with them pages, are dealt out by hash, so that each page is filled by one task; a page's n-grams
    # come from all tasks, but each task has put its own occurrences of an n-gram together.
    buckets = 1 << (32 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    partial = texts.where("not held_out").select("text").mapInArrow(_count(), "h bigint, c bigint")
    counts = partial.withColumn("bucket", _bucket(buckets)).repartition("bucket").groupBy("bucket", "h").agg(F.sum("c").alias("c"))
    counts = stage(counts.select("h", "c"), "lm-counts")
    words = counts.where(F.col("h").bitwiseAND(F.lit(1)) == 0)
    # Two rows for each level: under 400.
    level = F.floor(F.log("c") / F.lit(float(np.log(BASE))) + 1e-9) + 1
    by_level = counts.groupBy(F.col("h").bitwiseAND(F.lit(1)).alias("is_pair"), level.alias("q")).agg(F.count(F.lit(1)).alias("k"), F.sum("c").alias("n")).collect()
    singles = {r["q"]: r["k"] for r in by_level if not r["is_pair"]}
    n, v = sum(r["n"] for r in by_level if not r["is_pair"]), sum(singles.values())
    put_in = sum(r["q"] * r["k"] for r in by_level)
    pages = buckets * max(1, -(-put_in * bits_each // (buckets * PAGE_BITS)))
    filled = counts.mapInArrow(_fill(buckets, pages), "page bigint, bits binary")
    filled = filled.groupBy("page").agg(F.bitmap_or_agg("bits").alias("bits"))
    bits = None
    if pages * PAGE_BITS <= broadcast_bits:
        bits = bytearray(pages * PAGE_BITS // 8)
        for r in filled.toLocalIterator():
            bits[r["page"] * (PAGE_BITS // 8) : (r["page"] + 1) * (PAGE_BITS // 8)] = r["bits"]

    # The lowest level from which on words are sent: at most `top` of them, and no sort over all words to find them.
    sent, from_level = 0, None
    for q in sorted(singles, reverse=True):
        sent += singles[q]
        if sent > top:
            break
        from_level = q
    frequent = words.where(level >= from_level if from_level else F.lit(False)).select("h", "c").toPandas()
    h = frequent["h"].to_numpy(np.int64).view(_U)
    order = np.argsort(h)
    model = {"bits": bits, "buckets": buckets, "n": n, "v": v, "top_h": h[order].tobytes(), "top_c": frequent["c"].to_numpy(np.int64)[order].tobytes()}
    scored = stage(texts.mapInArrow(_score(spark.sparkContext.broadcast(model), pair_share, block), _SCORED), "lm-scored")

    whole = n + 0.5 * (v + 1)
    rare = scored.select("key", F.explode("rare").alias("h")).groupBy("key", "h").agg(F.count(F.lit(1)).alias("times"))
    rare = rare.join(words.select("h", "c"), "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    log_p = F.log10((F.col("c") + 0.5) / whole)
    rare = rare.groupBy("key").agg(F.sum(F.col("times") * log_p).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = scored.drop("rare", "block", "text").join(rare, "key", "left")
    score = F.col("score")
    if bits is None:
        out = out.join(_score_by_page(scored, stage(filled, "lm-filter"), buckets, pages, whole, pair_share), "key", "left")
        score = F.col("paged_score")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        score.alias("score"),
    )


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents`, learning from four of five."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
