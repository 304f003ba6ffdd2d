"""Shared parts of the training-data operators: staged tables in the shared
folder, vectorised word and shingle hashing, bounded bitmap prefilters and
distributed connected components."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Executors get the functions of this package inside the task, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__.rpartition(".")[0]])

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


# -- staged tables ---------------------------------------------------------


#: Folders of this machine by application, where the setting is absent.
_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a folder of
    this machine only where the setting is absent (local mode, tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = _LOCAL[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="casestream-")
        atexit.register(shutil.rmtree, found, True)
    return found


_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder for a staged table."""
    path = f"{shared_folder(spark).rstrip('/')}/casestream/{label}-{uuid.uuid4().hex}"
    if (made := _STAGED.get()) is not None:
        made.append(path)
    return path


@contextmanager
def staged() -> Iterator[list[str]]:
    """The folders that are made inside, for `drop_staged`: a list of this caller's own, whatever other threads stage meanwhile."""
    made: list[str] = []
    token = _STAGED.set(made)
    try:
        yield made
    finally:
        _STAGED.reset(token)


def drop_staged(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables, which nothing reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write `df` to the shared folder and read it back: a cut of the lineage
    that survives lost executors and that tells the planner its size."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# -- words and hashes ------------------------------------------------------

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_GAP = np.zeros(256, dtype=bool)
_IS_GAP[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_STEP = 0x9E3779B97F4A7C15


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: two xor-shift and multiply steps."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def text_slices(column, most_bytes: int = 2_000_000):
    """(first row, bytes, offsets) over slices of an Arrow string column that
    hold about `most_bytes`; a longer text makes a slice of its own. Null
    texts count as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(ends, ends[row] + most_bytes, "right")) - 1)
        last = min(last, len(column))
        yield row, data[ends[row] : ends[last]], ends[row : last + 1] - ends[row]
        row = last


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words in order, for each text the index of its first
    word (one more entry at the end), and where words begin and how long they are.
    With `lower`, A-Z hash as a-z."""
    n = len(offsets) - 1
    none = np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(0, _U), np.zeros(n + 1, np.int64), none, none
    gap = _IS_GAP[data]
    inside = ~gap
    first = inside.copy()
    first[1:] &= gap[:-1]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    first[begins] = inside[begins]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(n + 1, np.int64), none, none
    at = np.flatnonzero(inside)
    ahead = np.searchsorted(at, starts)
    lengths = np.diff(np.append(ahead, len(at)))
    within = np.arange(len(at)) - np.repeat(ahead, lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _STEP, dtype=_U))
    chars = data[at]
    weighed = _BYTE[_LOWER[chars] if lower else chars] * powers[within]
    hashed = mix(np.add.reduceat(weighed, ahead) + lengths.astype(_U))
    return hashed, np.searchsorted(starts, offsets), starts, lengths


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    return words(data, offsets, lower)[:2]


def shingle_sets(hashed: np.ndarray, first: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text with fewer
    words than `width` has its whole sequence as the only one."""
    n = len(hashed)
    run = np.zeros(n, _U)
    whole = max(0, n - width + 1)
    if whole:
        acc = np.zeros(whole, _U)
        for j in range(width):
            acc = mix(acc * _U(31) + hashed[j : j + whole] + _U(j + 1))
        run[:whole] = acc
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            s = np.sort(run[a : b - width + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif b > a:
            acc = np.full(1, b - a, _U)
            for j in range(a, b):
                acc = mix(acc * _U(31) + hashed[j] + _U(7))
            out.append(acc)
        else:
            out.append(np.zeros(0, _U))
    return out


# -- bounded prefilter -----------------------------------------------------

#: Hashed bits of a bitmap at most and at least; between them it has sixteen or more for each key.
MOST_BITS, LEAST_BITS = 1 << 25, 1 << 20
_PAGE_BITS = 1 << 15


class Bitmap(NamedTuple):
    """`pages`: (page, 32-bit words), a row for each 2^15 bits of which one is set; the words take 8 KB."""

    pages: DataFrame
    bits: int


def member_bitmap(keys: DataFrame, column: str, n_keys: int) -> Bitmap:
    """A bitmap of hashed bits that are set for the keys. `n_keys`, about how many there are, sizes it: at
    most MOST_BITS, which are 8 MB, whatever the number of keys."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (16 * n_keys).bit_length()))
    bit = F.pmod(F.xxhash64(F.col(column), F.lit(17)), F.lit(bits))
    pages = keys.select(bit.alias("__bit")).groupBy((F.col("__bit") / _PAGE_BITS).cast("long").alias("__page")).agg(F.bitmap_construct_agg(F.col("__bit") % _PAGE_BITS).alias("__bits"))
    words = F.transform(F.sequence(F.lit(0), F.lit(_PAGE_BITS // 32 - 1)), lambda i: F.conv(F.hex(F.substring("__bits", 4 * i + 1, F.lit(4))), 16, 10).cast("long"))
    return Bitmap(pages.select("__page", words.alias("__words")), bits)


def maybe_in(df: DataFrame, column: str, bitmap: Bitmap, inverse: bool = False) -> DataFrame:
    """Rows of `df` whose key may be among the bitmap's keys: all that are, and
    some that are not. Used before a join, so that rows without a partner aren't
    shuffled. `inverse` gives the rows that surely have none."""
    bit = F.pmod(F.xxhash64(F.col(column), F.lit(17)), F.lit(bitmap.bits))
    marked = df.withColumn("__bit", bit).withColumn("__page", (F.col("__bit") / _PAGE_BITS).cast("long"))
    # The bytes of a word stand from the highest down, the bits of a byte from the lowest up.
    inside = (F.col("__bit") % _PAGE_BITS).cast("int")
    place = (24 - inside.bitwiseAND(F.lit(24))) + inside.bitwiseAND(F.lit(7))
    is_set = F.getbit(F.get("__words", F.shiftright(inside, 5)), place) == 1
    joined = marked.join(F.broadcast(bitmap.pages), "__page", "left")
    hit = F.coalesce(is_set, F.lit(False))
    return joined.where(~hit if inverse else hit).drop("__page", "__bit", "__words")


# -- joins that hot keys can't hurt ------------------------------------------

#: A key with more than one in so many of all rows is hot: there are at most so many such keys, and they are broadcast.
HOT_SHARE = 1000


def join_by_key(rows: DataFrame, values: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Every row with the columns of its key in `values`, null keys being equal; without a match they are null. `values` has
    one row for each key, and in `count` how many of the rows have it: keys that hold more than a thousandth of
    all rows, at most HOT_SHARE, are broadcast, so that none of them is shuffled to one task."""
    total = values.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_SHARE > total
    named = values.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    drop = [f"__{k}" for k in keys]
    few = named.where(hot).withColumn("__hot", F.lit(True))
    marked = rows.join(F.broadcast(few), same, "left")
    rest = marked.where(F.col("__hot").isNull()).select(*rows.columns).join(named.where(~hot), same, "left")
    return marked.where("__hot").drop("__hot", *drop).unionByName(rest.drop(*drop))


# -- connected components --------------------------------------------------


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node
    that links reach. Each round hooks every node to its smallest neighbour,
    shortens the paths and contracts the graph, so the rounds grow with the
    logarithm of the node count; only sums and minima are kept by key, which
    Spark combines before the shuffle, so a hub may hold any share of links."""
    spark = edges.sparkSession
    rest = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{label}-edges")
    steps: list[DataFrame] = []
    while not rest.isEmpty():
        hook = rest.select(F.col("b").alias("node"), F.col("a").alias("up")).union(rest.select(F.col("a").alias("node"), F.col("a").alias("up")))
        hook = stage(hook.groupBy("node").agg(F.min("up").alias("up")), f"{label}-hook")
        for _ in range(2):
            over = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(over, "up").select("node", F.col("top").alias("up"))
        hook = stage(hook, f"{label}-up")
        steps.append(hook)
        one = hook.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        two = hook.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        moved = rest.join(one, "a").join(two, "b").where("ra <> rb")
        rest = stage(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{label}-edges")
    if not steps:
        return spark.createDataFrame([], "node bigint, root bigint")
    roots = steps[-1].select("node", F.col("up").alias("root"))
    for hook in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("up"), F.col("root").alias("__r"))
        roots = hook.join(later, "up", "left").select("node", F.coalesce("__r", "up").alias("root"))
    return stage(roots, f"{label}-roots")


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


__all__ = ["GAP", "WORD", "Window", "components", "maybe_in", "member_bitmap", "mix", "public_tokenizer", "scratch_path", "shared_folder", "shingle_sets", "stage", "text_slices", "word_hashes", "words_of"]
