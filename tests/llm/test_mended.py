"""Cases that once went wrong: lines whose edits stand together, token files of equal ids, long texts' variety, the
scorer's own sums, and whether Bloom filters skip rows."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casestream.llm import common, line_dedup, near_dup, quality_classifier, token_files

SCHEMA = "doc_id long, text string, n_words long, score double, row string, pick string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, 0.5, "r", "p") for i, t in rows], SCHEMA)


def jaccard(x, y, width=5):
    one, two = ({s[i : i + width] for i in range(max(1, len(s) - width + 1))} for s in (x, y))
    return len(one & two) / len(one | two)


def test_lines_whose_edits_stand_together_fold(spark):
    """URLs with a few one-letter words that all differ: many words changed, few shingles."""
    rng = random.Random(7)
    rows, similar = [], 0
    for i in range(120):
        url = "http://" + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789/") for _ in range(66))
        one, two = (url + " " + " ".join(rng.sample(letters, 5)) for letters in ("abcdefg", "tuvwxyz"))
        if jaccard(one, two) >= 0.75:
            similar += 1
        rows.append((i, f"{one}\n{two}"))
    dropped = {(r.doc, r.no) for r in line_dedup.duplicate_lines(table(spark, rows)).collect()}
    want = {(i, 1) for i, t in rows if jaccard(*t.split("\n")) >= 0.75}
    assert similar >= 100 and dropped == want


def test_similar_lines_by_sizes_and_intersections(spark):
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        x = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 60)))
        y = list(x)
        for _ in range(rng.randrange(4)):
            y[rng.randrange(len(y))] = rng.choice("abcdz")
        pairs.append((x, "".join(y) + "tail" * rng.randrange(3)))
    got = spark.createDataFrame(pairs, "x string, y string").select("x", "y", line_dedup._similar(F.col("x"), F.col("y"), 75).alias("s")).collect()
    assert all(r.s == (100 * round(jaccard(r.x, r.y), 12) >= 75) for r in got) and 30 < sum(r.s for r in got) < 290


def test_sizes_only_rule_out_what_cannot_be_similar():
    n, m = np.array([75, 74, 1, 100, 30]), np.array([100, 100, 1, 75, 41])
    assert near_dup._sizes_allow(n, m, 75).tolist() == [True, False, True, True, False]


def test_token_files_of_equal_ids(spark, tmp_path):
    """`start` leads to the row's own ids in the files, whatever texts share its doc_id."""
    rng = random.Random(3)
    rows = [(rng.choice([7, 7, 7, 8, None]), " ".join(f"word{rng.randrange(50)}" for _ in range(rng.randrange(6)))) for _ in range(150)]
    rows += [(7, None), (7, ""), rows[0], rows[0]]
    token_files.write_token_files(table(spark, rows), str(tmp_path / "t"), common.public_tokenizer())
    files = sorted((tmp_path / "t").glob("part-*.orc"))
    import pyarrow.orc as orc

    flat = np.concatenate([np.array(x, "<u4") for f in files for x in orc.ORCFile(f).read(["ids"]).column(0).to_pylist()])
    index = token_files.token_index(spark, str(tmp_path / "t")).collect()
    assert len(index) == len(rows) and sum(r.n_tokens for r in index) == len(flat)
    assert all(zlib.crc32(flat[r.start : r.start + r.n_tokens].tobytes()) == r.ids_crc32 for r in index)
    assert len({r.start for r in index}) == len(rows)


def scanned(df):
    """Rows that the files' reader handed on, before Spark's own filter."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    return plan.metrics().get("numOutputRows").get().value()


def test_bloom_filters_skip_row_groups(spark, tmp_path):
    rows = table(spark, [(2 * i, f"word{i}") for i in range(4000)]).coalesce(1)
    path, bare = str(tmp_path / "with"), str(tmp_path / "without")
    token_files.write_token_files(rows, path, common.public_tokenizer())
    token_files.read_token_files(spark, path).write.option("orc.row.index.stride", "1000").orc(bare)
    absent = [2 * i + 1 for i in range(100, 3900, 190)]  # inside every range of ids, in no file
    read = {p: sum(scanned(token_files.read_token_files(spark, p).where(F.col("doc_id") == i)) for i in absent) for p in (path, bare)}
    assert read[bare] >= 900 * len(absent)  # without the filter a row group is read for each
    assert read[path] <= 1000 * 3  # with it next to none (a false positive in a hundred)
    assert token_files.read_token_files(spark, path).where("doc_id = 400").count() == 1


# -- the classifier


def test_variety_does_not_fall_with_length():
    rng = np.random.default_rng(2)
    words = np.array([f"w{k}" for k in range(30_000)])
    zipf = 1 / np.arange(1, 30_001)
    texts = [" ".join(words[rng.choice(30_000, n, p=zipf / zipf.sum())]) for n in (400, 20_000, 100_000)]
    (_, data, offsets), = common.text_slices(pa.array(texts), 1 << 30)
    n, ratios, *_ = quality_classifier.measure(data, offsets)
    assert np.ptp(ratios["variety"]) < 0.05 and ratios["variety"].min() > 0.4
    j = [name for name, *_ in quality_classifier.LABELLERS].index("variety")
    assert (quality_classifier.votes(n, ratios)[:, j] == quality_classifier.GOOD).all()
    for t, x in zip(texts[:2], ratios["variety"], strict=False):
        w = t.split()
        assert math.isclose(x, sum(len(set(w[a : a + 400])) for a in range(0, len(w), 400)) / len(w))


@pytest.fixture(scope="module")
def judged():
    rng = random.Random(8)
    rows = [(i, " ".join(f"wo{rng.randrange(400)}rd" for _ in range(rng.randrange(5, 60))) + (" !!! $$$ &&& ###" * 6 if i % 5 == 0 else ".")) for i in range(150)]
    return [*rows, (None, "no id here at all"), (None, None), (200, ""), (201, " \n\t"), (202, "A " * 20_000), rows[0], (3, "SHOUTING!!! TEXT!!! OF AN ID")]


def test_scores_equal_plain_sums(spark, judged):
    """The score, text by text and word by word, from the model's own weights."""
    Q = quality_classifier
    model = Q.fit(table(spark, judged))
    got = Q.classify(table(spark, judged), model).collect()
    w, want = model["weights"], []
    for i, t in judged:
        (_, data, offsets), = common.text_slices(pa.array([t], pa.string()))
        n, ratios, word, shape, _ = Q.measure(data, offsets)
        n = int(n[0])
        votes = Q.votes(np.array([n]), ratios)[0].tolist()
        bad = sum(v == Q.BAD for v in votes)
        if n == 0:
            want.append((i, 0, bad, 0.0, 0.0, False))
            continue
        line = sum(w[a] + w[Q._WORDS + b] for a, b in zip(word.tolist(), shape.tolist(), strict=True)) / n
        bins = Q._bins(ratios)[0].tolist()
        line += sum(w[Q._WORDS + Q._SHAPES + b] for b in bins) / len(bins) + model["bias"]
        weak = float(model["posterior"][sum(v * 3**k for k, v in enumerate(votes))])
        score = (n / (1 + math.exp(-max(-50, min(50, line)))) + Q.SHRINK * weak) / (n + Q.SHRINK)
        want.append((i, n, bad, weak, score, score >= Q.LEAST))
    key = lambda x: (x[0] is None, x[0] or 0, x[1], round(x[4], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and a[5] == b[5] and math.isclose(a[3], b[3], abs_tol=1e-9) and math.isclose(a[4], b[4], abs_tol=1e-6)
    assert {r.kept for r in got} == {True, False} and not any(r.kept for r in got if r.doc_id in (200, 201))


@pytest.mark.parametrize("tile", [4_000, 2_000_000])
def test_a_cloud_of_near_copies_is_linked_without_a_row_for_each_pair(spark, monkeypatch, tile):
    """Copies with changes of their own, most below the similarity asked for of all others."""
    rng, made, write = random.Random(3), {}, near_dup.stage
    base, texts = [f"w{i}" for i in range(100)], []
    for i in range(320):
        words = list(base)
        for place in rng.sample(range(100), 3):
            words[place] = f"own{i}x{place}"
        texts.append(f"{texts[-1]} end" if i % 20 == 19 else " ".join(words))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in map(str.split, texts)]
    group = list(range(320))
    for i in range(320):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]

    def counted(df, label):
        out = write(df, label)
        made[label] = max(made.get(label, 0), out.count())
        return out

    monkeypatch.setattr(near_dup, "stage", counted)
    monkeypatch.setattr(near_dup, "TILE_BYTES", tile)
    monkeypatch.setattr(near_dup, "BIG_GROUP", 10_000)
    got = {r.doc_id: r.component_id for r in near_dup.link_components(table(spark, list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(group)) and 200 < len(set(group)) < 310
    assert max(made.values()) <= 320 * 100 < 320 * 319 // 2


def test_line_sizes_are_compared_first_and_grouping_leaves_no_tables(spark):
    long = "a line of many words that says something of its own about a matter"
    rows = [(0, f"{long}\n{long} too\n{'abcde' * 20}"), (1, long + " that goes on for much longer than any other line here does")]
    with common.staged() as made:
        gone = {(r.doc, r.no) for r in line_dedup.duplicate_lines(table(spark, rows)).collect()}
    assert gone == {(0, 1)} and not any("line-texts" in path or "line-tried" in path for path in made)
    # Sizes that can't go together settle it, whatever the lines are.
    line, n = F.lit(long), F.lit(60)
    first = spark.range(1).select(*[line_dedup._similar(line, line, 75, n, F.lit(m)) for m in (60, 81)]).first()
    assert tuple(first) == (True, False)


def test_line_bitmaps_only_rule_out_what_cannot_be_similar(spark):
    """Pairs of lines of all sizes, some near PERCENT: each similar pair passes, those far apart don't."""
    rng = random.Random(17)
    pairs = []
    for size in [1, 3, 5, 6, 12, 40, 90, 300, 1020, 1030, 4000, 4300, 17000] * 4:
        x = "".join(rng.choice("abcdefghij klmé") for _ in range(size))
        y = list(x)
        for _ in range(rng.randrange(max(2, size // 25))):
            y[rng.randrange(size)] = rng.choice("xyz")
        pairs += [(x, "".join(y)), (x, "".join(rng.choice("abcdefghij klmé") for _ in range(size))), (x * 3, x * 2 + "!")]
    lines = sorted({line for p in pairs for line in p})
    number = {line: i for i, line in enumerate(lines)}
    bitmaps = line_dedup._bitmaps(spark.createDataFrame(list(enumerate(lines)), "h long, line string")).localCheckpoint()
    sets = {i: {line[k : k + 5] for k in range(max(1, len(line) - 4))} for i, line in enumerate(lines)}
    assert {r.h: r.n for r in bitmaps.collect()} == {i: len(s) for i, s in sets.items()}
    ends = {(number[x], number[y]) for x, y in pairs}
    passed = {tuple(r) for r in line_dedup._likely(spark.createDataFrame(sorted(ends), "a long, b long"), bitmaps, 75).collect()}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in ends}
    assert all(e in passed for e in ends if share[e] >= 0.75) and sum(v >= 0.75 for v in share.values()) > 60
    # Bitmaps of two sizes, whose sets lie on either side of a power of four, are not compared.
    large = lambda i: sum(len(sets[i]) > line_dedup.BITS * 4**k for k in range(3))
    apart = [e for e in ends if share[e] < 0.4 and len(sets[e[0]]) >= 12 and large(e[0]) == large(e[1])]
    assert len(apart) > 20 and not any(e in passed for e in apart)


def test_lines_that_share_bands_are_told_apart_before_their_texts_are_read(spark, monkeypatch):
    """Sixty lines with a common beginning and nothing else in common, and one near copy: no pair but that of the copy is staged."""
    rng = random.Random(18)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    start = " ".join(word() for _ in range(4))
    texts = [start + " " + " ".join(word() for _ in range(20)) for _ in range(60)]
    texts.append(texts[7] + " more")
    made, stage = {}, line_dedup.stage

    def counted(df, label):
        out = stage(df, label)
        made[label] = max(made.get(label, 0), out.count())
        return out

    monkeypatch.setattr(line_dedup, "stage", counted)
    gone = {(r.doc, r.no) for r in line_dedup.duplicate_lines(table(spark, list(enumerate(texts)))).collect()}
    assert gone == {(60, 0)} and made["line-tried"] <= 1 and made["line-waiting"] <= 1 and made["line-links"] == 1


def test_all_lines_of_a_large_band_are_compared(spark):
    """Lines with a common beginning, in pairs whose rest differs in each twelfth character, so that beyond the beginning they share no run of twelve."""
    rng = random.Random(19)
    text = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    start, lines = text(300), []
    for _ in range(100):
        rest = text(150)
        lines += [start + rest, start + "".join("#" if i % 12 == 11 else c for i, c in enumerate(rest))]
    sets = [{x[k : k + 5] for k in range(len(x) - 4)} for x in lines]
    alike = {(i, j) for i in range(200) for j in range(i) if len(sets[i] & sets[j]) >= 0.75 * len(sets[i] | sets[j])}
    assert alike == {(i, i - 1) for i in range(1, 200, 2)}
    members = spark.createDataFrame([(1, i) for i in range(200)], "band long, h long").localCheckpoint()
    groups = line_dedup.line_groups(members, spark.createDataFrame(list(enumerate(lines)), "h long, line string").localCheckpoint())
    assert {r.node: r.root for r in groups.collect()} == {i: i - i % 2 for i in range(200)}
