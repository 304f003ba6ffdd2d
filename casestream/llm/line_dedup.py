"""Line dedup by MinHash over character shingles. DataFrame and SQL functions only.

Lines are the \\n-separated parts of a text that hold a word. Equal lines fold by
hash. For the others, a signature is the SIGNATURE smallest hashes of a line's
shingles: of ANCHOR characters from each word start and each eighth character of
longer words; short lines have shingles of fewer characters from every character, in
the length classes of SHORT that they are in, which overlap by more than the lengths
of similar lines differ. Every signature value is a band: lines that share one are
candidates.

All lines of a band are compared, whatever its size; pairs that can't be similar are told apart inside the join,
so that only the others are rows. Bands of two lines are pairs as they are. The lines of a band of at most BAND
are compared with each other. Of a larger band, which share a frequent passage, each line is first
compared with its hubs, the lines that meet most others; if it still holds several groups after that, all its lines of
different groups are compared, in tiles of TILE lines a side. Of pairs that may be similar, one for each line is confirmed first;
of the others only those that don't meet in a group by then (`_linked`), as links inside a group can't change the groups.

A pair is confirmed by the exact Jaccard similarity of its sets of all WIDTH-character
shingles (by 64-bit hash), at PERCENT or more. Nothing but what follows from PERCENT comes before it: a line
has a bitmap of BITS hashed bits, set for its shingles, and each bit that only one of two lines has is at least one shingle
that only this line has (`_may_be_similar`). Confirmed links are closed by distributed
union-find (`components`), and of each component the first line by (doc_id, line
number) stays.

Defined cases: null and empty texts stay as they are; lines without a word are never
duplicates; a line shorter than WIDTH is one shingle, itself; a line may be of any
length; rows with equal doc_id and text count as one document and come out alike; a
null doc_id is the last; an empty table gives no rows; `dedup_lines` keeps all columns
of its input, whatever their names, and sets text and, if there is one, n_chars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, components, drop_staged, maybe_in, member_bitmap, stage, staged

ANCHOR, SIGNATURE, WIDTH, PERCENT = 20, 6, 5, 75
#: Least and most characters of the classes of short lines, and the width of the shingles that sign them.
SHORT = ((0, 14, WIDTH), (10, 20, 6), (15, 28, 8), (21, 40, 12), (30, 60, 16))
#: Lines above this length have anchored shingles.
LONG = 45
#: Most lines of a small band; lines of a tile's side; bits of a line's bitmap.
BAND, TILE, BITS = 64, 512, 1024
#: Hubs of a larger band; most rounds in which one pair for each line is compared before all that are left.
HUBS, ROUNDS = 3, 2
_NEWLINE = "\n"
_EMPTY = "array<bigint>"


def _hashes(shingles: Column) -> Column:
    return F.transform(shingles, lambda s: F.xxhash64(s))


def _every(line: Column, width: int) -> Column:
    """Hashes of all `width`-character shingles, in order; a shorter line is its own only shingle. In UTF-32 a
    shingle is a slice of bytes at a known place."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), 4 * (F.length(line) - width) + 1), F.lit(4))
    return _once(F.encode(line, "UTF-32"), lambda b: F.transform(starts, lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * width)))))


def _anchored(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(rf"(?s)(?=(.{{{ANCHOR}}}))[^\x20\x09-\x0D]{{1,8}}+[\x20\x09-\x0D]*+"), 1)


def _least(hashes: Column, n: int = SIGNATURE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, n)


def _signature(line: Column) -> Column:
    size, none = F.length(line), F.array().cast(_EMPTY)
    short = [F.when(size.between(low, high), _least(_every(line, width))).otherwise(none) for low, high, width in SHORT]
    longest = max(high for _, high, _ in SHORT)
    some = F.array_distinct(F.concat(*short, F.when(size > LONG, _least(_hashes(_anchored(line)))).otherwise(none)))
    return F.when(size > longest, _least(_hashes(_anchored(line)))).otherwise(some)


def _once(value: Column, then) -> Column:
    """`then` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _similar(x: Column, y: Column, percent: int, n: Column | None = None, m: Column | None = None) -> Column:
    """Whether two lines' sets of shingles are similar: 100 * intersection >= percent * union. `n` and `m` are the
    sizes of the sets, where they are known: no shingle is made of lines that these tell apart."""

    def common(s: Column) -> Column:
        return F.size(F.array_intersect(s["x"], s["y"]))

    sets = F.struct(_every(x, WIDTH).alias("x"), _every(y, WIDTH).alias("y"))
    if n is None or m is None:
        return _once(sets, lambda s: 100 * common(s) >= percent * F.size(F.array_union(s["x"], s["y"])))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & _once(sets, lambda s: (100 + percent) * common(s) >= percent * (n + m))


#: The columns of a bitmap's words of 64 bits.
_WORDS = [f"w{k}" for k in range(BITS // 64)]


def _bitmaps(texts: DataFrame) -> DataFrame:
    """(h, n, ones, w0 to w15, ones_all, bits) of lines (h, line): the number of a line's shingles, a bitmap of BITS bits set for
    their hashes, and the numbers of bits set. Sets of more than BITS have a bitmap of four, 16 or 64 times as many bits as well, in the array `bits`."""
    parts = F.when(F.col("n") <= BITS, 1).when(F.col("n") <= 4 * BITS, 4).when(F.col("n") <= 16 * BITS, 16).otherwise(64)
    # Outer, as explode would first have the shingles made to see whether there are any.
    each = texts.select("h", F.array_distinct(_every(F.col("line"), WIDTH)).alias("set")).select("h", F.size("set").alias("n"), "set")
    each = each.select("h", "n", F.explode_outer("set").alias("x")).withColumn("x", F.col("x").bitwiseAND(F.lit(64 * BITS - 1)).cast("int"))
    part, word = F.shiftright("x", BITS.bit_length() - 1).bitwiseAND(parts - 1), F.shiftright("x", 6).bitwiseAND(F.lit(len(_WORDS) - 1))
    each = each.select("h", "n", part.alias("part"), word.alias("word"), F.expr("shiftleft(1L, x & 63)").alias("bit"))
    zero = F.lit(0).cast("long")
    rows = each.groupBy("h", "n", "part").agg(*[F.bit_or(F.when(F.col("word") == k, F.col("bit")).otherwise(zero)).alias(w) for k, w in enumerate(_WORDS)])
    rows = stage(rows, "line-bits")

    ones = sum((F.bit_count(w) for w in _WORDS), F.lit(0)).alias("ones")
    short = rows.where(F.col("n") <= BITS).select("h", "n", ones, *_WORDS, F.lit(None).cast(_EMPTY).alias("bits"), F.lit(None).cast("int").alias("ones_all"))
    full = rows.where(F.col("n") > BITS).groupBy("h", "n").agg(*[F.bit_or(w).alias(w) for w in _WORDS], F.collect_list(F.struct("part", F.array(*_WORDS).alias("words"))).alias("full"))
    # A part without a bit has no row.
    found = F.map_from_entries("full")
    bits = F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), lambda k: F.coalesce(F.try_element_at(found, k), F.array_repeat(zero, len(_WORDS)))))
    full = full.select("h", "n", ones, *_WORDS, bits.alias("bits"))
    return short.unionByName(full.withColumn("ones_all", F.aggregate("bits", F.lit(0), lambda k, w: k + F.bit_count(w))))


def _alike(percent: int, apart: Column, ones: str) -> Column:
    """False only for pairs (a, b) that `apart` bits of one line alone tell apart. Such a bit is at least one shingle of this line alone, so
    they leave at most the smaller rest in common, and a union of as many and `apart` at least."""
    # Bits of a alone are (apart + ones_a - ones_b) / 2. So put, `apart` is worked out once.
    more = F.col(f"{ones}_a") - F.col(f"{ones}_b")
    return (100 - percent) * F.least(2 * F.col("n_a") - more, 2 * F.col("n_b") + more) >= (100 + percent) * apart


def _may_be_similar(percent: int) -> Column:
    """False only for pairs (a, b) that can't be similar, by sizes and the bitmaps of BITS."""
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in _WORDS), F.lit(0))
    return (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & _alike(percent, apart, "ones")


def _larger_may_be_similar(percent: int) -> Column:
    """The same by the larger bitmaps, where both have one of a size."""
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda k, c: k + c)
    return F.col("bits_a").isNull() | F.col("bits_b").isNull() | (F.size("bits_a") != F.size("bits_b")) | _alike(percent, apart, "ones_all")


def _side(bitmaps: DataFrame, side: str) -> DataFrame:
    return bitmaps.select(F.col("h").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("n", "ones", *_WORDS, "bits", "ones_all")])


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, th, no, line): the lines with a word of each document; th tells documents of one id apart."""
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("th"), "text")
    return texts.select("doc", "th", F.posexplode_outer(F.split("text", _NEWLINE, -1)).alias("no", "line")).where(F.col("line").rlike(WORD))


def _likely(pairs: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may be similar."""
    both = pairs.join(_side(bitmaps, "a"), "a").join(_side(bitmaps, "b"), "b")
    return both.where(_may_be_similar(percent)).where(_larger_may_be_similar(percent)).select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The similar ones of staged pairs (a, b). Lines go through the shuffle, which are smaller by far than their
    shingles, and only those that some pair needs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h"))
    texts = maybe_in(texts, "h", member_bitmap(ends, "h", 2 * pairs.count()))
    one, two = texts.select(F.col("h").alias("a"), F.col("line").alias("x")), texts.select(F.col("h").alias("b"), F.col("line").alias("y"))
    found = pairs.join(one, "a").join(two, "b").where(_similar(F.col("x"), F.col("y"), percent))
    return stage(found.select("a", "b"), "line-links")


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _placed(members: DataFrame, groups: DataFrame | None) -> DataFrame:
    """`members` with the group `root` of each line."""
    if groups is None:
        return members.withColumn("root", F.col("h"))
    return members.join(groups.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))


def _pairs_in(rows: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of different groups that may be similar, of bands with n lines (band, n, h, root), dealt out by tiles."""
    parts = F.ceil(F.col("n") / TILE).cast("int")
    rows = rows.select("band", "h", "root", parts.alias("parts")).withColumn("part", F.pmod(F.xxhash64("h", F.lit(4)), F.col("parts")).cast("int"))
    dealt = rows.join(bitmaps.select("h", "n", "ones", *_WORDS), "h")

    def end(side: str, *tile: Column) -> DataFrame:
        return dealt.select("band", *tile, F.col("root").alias(f"root_{side}"), *[F.col(c).alias(f"{c}_{side}") for c in ("h", "n", "ones", *_WORDS)])

    one = end("a", F.col("part").alias("p"), F.explode_outer(F.sequence("part", F.col("parts") - 1)).alias("q"))
    two = end("b", F.explode_outer(F.sequence(F.lit(0), "part")).alias("p"), F.col("part").alias("q"))
    met = one.join(two, ["band", "p", "q"]).where("root_a <> root_b and (p < q or h_a < h_b)").where(_may_be_similar(percent))
    met = stage(met.select(*_ordered("h_a", "h_b"), (F.least("n_a", "n_b") > BITS).alias("larger")).distinct(), "line-met")
    # The larger bitmaps, of few lines, are not dealt out with the bands.
    return met.where("not larger").select("a", "b").union(_likely(met.where("larger").select("a", "b"), bitmaps.where("bits is not null"), percent))


def _hub_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): each line of a band and its hubs. Hubs are the lines that meet most others in all their bands: in a cloud of
    lines with few changes each, those with the fewest are like most of them."""
    degree = rows.groupBy("h").agg(F.sum("n").alias("degree"))
    best = F.row_number().over(Window.partitionBy("band").orderBy(F.col("degree").desc(), "h"))
    hubs = rows.join(degree, "h").withColumn("nth", best).where(F.col("nth") <= HUBS).select("band", F.col("h").alias("hub"))
    return rows.join(hubs, "band").where("h <> hub").select(*_ordered("h", "hub"))


def _linked(groups: DataFrame | None, pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """`groups` with those that the similar ones of staged `pairs` join. One pair for each line goes first; what is left are pairs of lines
    that are still in different groups. While these are many, that repeats, at most ROUNDS times, and then all of them are compared."""
    for k in range(ROUNDS):
        one = F.min_by("a", F.xxhash64("a", "b", F.lit(k))).alias("a")
        tried = stage(pairs.groupBy("b").agg(one).select("a", "b"), "line-tried")
        groups = _joined(groups, _confirmed(tried, texts, percent))
        root = {side: groups.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")) for side in "ab"}
        rest = pairs.join(tried, ["a", "b"], "left_anti").join(root["a"], "a", "left").join(root["b"], "b", "left")
        pairs = stage(rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "line-rest")
        if pairs.count() <= 4 * tried.count():
            break
    return groups if pairs.isEmpty() else _joined(groups, _confirmed(pairs, texts, percent))


def _joined(groups: DataFrame | None, found: DataFrame) -> DataFrame:
    """`groups` with those that links reach joined; the links of earlier calls are in the groups already."""
    if groups is None:
        return components(found, "line")
    if found.isEmpty():
        return groups
    known = groups.select("node", F.col("root").alias("up"))
    roots = found.join(known.withColumnsRenamed({"node": "a", "up": "ra"}), "a", "left").join(known.withColumnsRenamed({"node": "b", "up": "rb"}), "b", "left")
    ends = roots.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"))
    joined = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b")), "line").select(F.col("node").alias("up"), "root")
    new = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ra").alias("up")), F.struct(F.col("b").alias("node"), F.col("rb").alias("up")))).alias("x")).select("x.*")
    return stage(known.union(new).distinct().join(joined, "up", "left").select("node", F.coalesce("root", "up").alias("root")), "line-groups")


def line_groups(members: DataFrame, texts: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the lines that similarity links, from bands (band, h)
    of at least two lines and the lines (h, line)."""
    sizes = stage(members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("a"), F.max("h").alias("b")), "line-sizes")
    more = stage(members.join(sizes.where("n > 2").select("band", "n"), "band"), "line-more")
    large = more.where(F.col("n") > BAND)
    # Most bands have two lines. Such pairs are compared as they are: bitmaps would cost more than they spare.
    bitmaps = stage(_bitmaps(maybe_in(texts, "h", member_bitmap(more, "h", more.count()))), "line-bitmaps")

    pairs = sizes.where("n = 2").select("a", "b").union(_likely(_hub_pairs(large).distinct(), bitmaps, percent))
    pairs = pairs.union(_pairs_in(more.where(F.col("n") <= BAND).withColumn("root", F.col("h")), bitmaps, percent)).distinct()
    groups = _linked(None, stage(pairs, "line-waiting"), texts, percent)

    placed = _placed(large, groups)
    several = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    left = stage(_pairs_in(placed.join(several, "band"), bitmaps, percent), "line-waiting")
    return groups if left.isEmpty() else _linked(groups, left, texts, percent)


def duplicate_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc, th, no) of every line that goes."""
    lines = _lines(docs.select("doc_id", "text"))
    h = F.xxhash64("line", F.lit(1)).alias("h")
    place = F.struct(F.col("doc").isNull().alias("last"), "doc", "no", "th").alias("place")
    signed = lines.select("doc", "th", "no", h, _signature(F.col("line")).alias("bands"))
    signed = stage(signed, "line-signed")

    with staged() as made:
        # Straight from the lines: equal ones repeat their bands, which costs less than to carry bands through the grouping.
        banded = signed.select("h", F.explode("bands").alias("band"))
        shared = stage(banded.groupBy("band").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high").select("band"), "line-shared")
        members = stage(maybe_in(banded, "band", member_bitmap(shared, "band", shared.count())).join(shared, "band").distinct(), "line-members")

        texts = maybe_in(lines.select(h, "line"), "h", member_bitmap(members, "h", members.count()))
        # Dealt out before equal lines fold, so that they are sorted once; the few that are in no band do no harm.
        texts = stage(texts.repartition("h").groupBy("h").agg(F.first("line").alias("line")), "line-texts")
        groups = line_groups(members, texts, percent)
    roots = stage(groups, "line-grouped")
    drop_staged(docs.sparkSession, made)

    # Only lines that repeat or are linked need the first of their places.
    again = signed.groupBy("h").agg(F.count(F.lit(1)).alias("times")).where("times > 1").join(roots, F.col("h") == F.col("node"), "left_anti")
    kinds = stage(roots.union(again.select("h", F.col("h").alias("root"))), "line-kinds")
    firsts = maybe_in(signed.drop("bands"), "h", member_bitmap(kinds, "node", kinds.count())).groupBy("h").agg(F.min(place).alias("first"))
    firsts = stage(firsts.join(kinds, F.col("h") == F.col("node")).select(F.col("h").alias("kind"), "root", "first"), "line-firsts")
    several = stage(firsts.join(firsts.groupBy("root").agg(F.min("first").alias("stay")), "root").select("kind", "stay"), "line-several")
    found = maybe_in(signed.drop("bands"), "h", member_bitmap(several, "kind", several.count())).join(several, F.col("h") == F.col("kind"))
    return found.where(~place.eqNullSafe(F.col("stay"))).select("doc", "th", "no")


def dedup_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(row, n_dropped): each row of `docs` as a struct, with the text of the lines that stay, and how many went."""
    gone = duplicate_lines(docs, percent).groupBy("doc", "th").agg(F.collect_set("no").alias("gone"))
    gone = stage(gone.select("doc", "th", "gone", F.xxhash64("doc", "th").alias("gone_key")), "line-gone")
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    doc, th = F.col("row.doc_id").cast("long"), F.xxhash64("row.text")
    marked = marked.withColumn("key", F.xxhash64(doc, th))
    # Documents without a line to drop don't go through the join: the bitmap tells them.
    bitmap = member_bitmap(gone, "gone_key", gone.count())
    some, rest = maybe_in(marked, "key", bitmap), maybe_in(marked, "key", bitmap, inverse=True)
    joined = some.join(gone, (F.col("key") == F.col("gone_key")) & doc.eqNullSafe(F.col("doc")) & (th == F.col("th")), "left")
    left = F.filter(F.split("row.text", _NEWLINE, -1), lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(left, _NEWLINE))
    joined = joined.withColumn("left", text)
    changed = {"text": F.col("left")} | ({"n_chars": F.length("left").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    row = F.struct(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
    joined = joined.select(row.alias("row"), F.coalesce(F.size("gone"), F.lit(0)).alias("n_dropped"))
    return joined.union(rest.select("row", F.lit(0).alias("n_dropped")))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without their duplicate lines. A document that loses
    all its lines with a word says nothing new and goes; others stay."""
    return dedup_lines(docs).where((F.col("n_dropped") == 0) | F.col("row.text").rlike(WORD)).select("row.*")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table: doc_id, the lines dropped, and the length and crc32 of what is left."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    left = F.coalesce("row.text", F.lit(""))
    return out.select("row.doc_id", F.col("n_dropped").cast("long").alias("n_dropped"), F.length(left).cast("long").alias("left_chars"), F.crc32(left).alias("left_crc32"))
