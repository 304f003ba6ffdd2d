"""Each operator against a brute-force version, an exact round trip or held-out accuracy,
with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from casestream.llm import chat_format, common, line_dedup, lm_scoring, mixing, near_dup, packing, quality_classifier, quality_rules, token_files, topk_search

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, shard int, words int, key int"


def documents(spark, rows):
    """Rows (doc_id, text, source), with columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 1, "n", 2, 3, 4) for i, t, s in rows], SCHEMA)


def words(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, i = [], 0
    bases = [words(rng, 60) for _ in range(12)]
    for b in bases:
        for _ in range(6):
            copy = list(b)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(1000)}"
            rows.append((i, " ".join(copy).upper() if i % 5 == 0 else " ".join(copy), f"s{i % 3}" if i % 7 else None))
            i += 1
    rows += [(i, None, "s0"), (i + 1, "", "s1"), (i + 2, " \n\t ", None), (i + 3, "two words", "s1"), (i + 4, "Two  words", "s2"), (i + 5, " ".join(words(rng, 3000)), "s0")]
    return rows + [rows[1], rows[-1]]  # repeated rows


def brute_components(rows, width=5):
    sets = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sets, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("big", [64, 2])
def test_near_duplicates(spark, corpus, monkeypatch, big):
    monkeypatch.setattr(near_dup, "BIG_GROUP", big)
    want = brute_components(corpus)
    got = near_dup.link_components(documents(spark, corpus)).collect()
    assert len(got) == len(corpus)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicate_stage_and_empty_table(spark, corpus):
    docs = documents(spark, corpus)
    want = brute_components(corpus)
    left = near_dup.near_duplicate_stage(spark, docs, "")
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {c for _, c in want.values()}
    assert near_dup.link_components(docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30))


def test_mixing_meets_targets(spark, corpus):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, rng.choice([0, 3, 40, 90]))), ["b", "a", None, "hot", "hot", "hot"][i % 6]) for i in range(300)] + corpus
    docs = documents(spark, rows)
    got = mixing.mix_documents(docs, shard_docs=40).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix_documents(docs.repartition(7), shard_docs=40).collect())
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    size, taken, target = Counter(), Counter(), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size >= r.size
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    want, open_, budget = {}, set(order), sum(size.values())
    while True:
        level = budget / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not full:
            break
        want |= {s: 3 * size[s] for s in full}
        budget -= sum(3 * size[s] for s in full)
        open_ -= full
    want |= {s: weight[s] * level for s in open_}
    assert all(math.isclose(target[s], want[s]) for s in order)
    assert all(abs(taken[s] - want[s]) <= max(40, 0.02 * want[s]) for s in order)
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_seats_are_highest_quotients(spark):
    rng = random.Random(9)
    rows = [(0, i, float(rng.choice([1, 5, 7.5, 40, 300])), 137, 30) for i in range(25)]
    got = {r.i: r.seats for r in mixing._seats(spark.createDataFrame(rows, "g int, i int, votes double, n_seats long, most_seats long"), ["g"], ["i"]).collect()}
    want = Counter()
    for _ in range(137):
        best = max((r for r in rows if want[r[1]] < 30), key=lambda r: (r[2] / (2 * want[r[1]] + 1), -r[1]))
        want[best[1]] += 1
    assert got == {i: want[i] for i in range(25)}


def test_mixing_stage_keeps_columns(spark, corpus):
    docs = documents(spark, corpus)
    assert mixing.mixing_stage(spark, docs, "").columns == docs.columns


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.public_tokenizer())


TRICKY = ["<|endoftext|>x, a.", "İß é é", "don't DON'T 'S", "a\x1cb\x85c　d", "漢字 漢字, 12ab.", None, "", "x" * 300, "a,b. a,, .a"]


def test_encoder_equals_the_library(tokenizer):
    import pyarrow as pa

    from casestream.llm.tokens import WordEncoder

    rng = random.Random(4)
    bits = ["a", "B", "é", "́", "'s", " ", "\n", "\x1c", " ", "1", ".", "!!", "<|endoftext|>", "漢", "😀", "-"]
    texts = TRICKY + ["".join(rng.choice(bits) for _ in range(rng.randrange(20))) for _ in range(500)]
    encode = WordEncoder(common.public_tokenizer()).encode
    for row, data, offsets in common.text_slices(pa.array(texts), 500):
        ids, at = encode(data, offsets)
        for k in range(len(at) - 1):
            assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(texts[row + k] or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark, tokenizer, corpus, tmp_path):
    rows = corpus + [(1000 + i, t, "s") for i, t in enumerate(TRICKY)]
    token_files.write_token_files(documents(spark, rows), str(tmp_path / "t"), common.public_tokenizer())
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_index(spark, str(tmp_path / "t")).collect())
    start, want = 0, []
    for i, t, _ in sorted(rows, key=lambda r: r[0]):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    one = token_files.read_token_files(spark, str(tmp_path / "t")).where("doc_id = 3")
    assert one.count() == 1 and "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,3)]" in one._jdf.queryExecution().executedPlan().toString()


def test_packing_is_whole_and_tight(spark, tokenizer, corpus):
    got = packing.pack_documents(documents(spark, corpus), common.public_tokenizer(), capacity=128).collect()
    total, bins = Counter(), defaultdict(list)
    for r in got:
        total[(r.doc_id, r.piece)] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 128
    for i, t, _ in corpus:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want = {(k, s, min(128, len(ids) - s), zlib.crc32(ids[s : s + 128].tobytes())) for k, s in enumerate(range(0, len(ids), 128))}
        assert want == {(r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == i}


def test_runs_equal_best_fit_decreasing_one_by_one():
    rng = random.Random(6)
    for capacity in (7, 50, 128):
        lengths = [rng.randrange(1, capacity + 1) for _ in range(400)]
        room = []
        for x in sorted(lengths, reverse=True):
            fits = [r for r in room if r >= x]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - x)
            else:
                room.append(capacity - x)
        runs = packing.best_fit_runs(Counter(lengths), capacity)
        filled = Counter()
        for length, low, high, first, offset, per in runs:
            for k in range(high - low):
                filled[first + k // per] += length
        assert sorted(capacity - v for v in filled.values()) == sorted(room)


def brute_rules(t):
    w = (t or "").encode().split()
    lines = [x for x in (t or "").split("\n") if x.encode().split()]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered)


def test_rules(spark):
    rng = random.Random(8)
    rows = [(i, "".join(rng.choice(["a ", "b ", "c\n", "d#", "é ", "\t", "  ", "a\n"]) for _ in range(rng.randrange(0, 90))), "s") for i in range(80)] + [(900, None, "s"), (901, "", "s"), (902, "x " * 5000, "s")]
    book = quality_rules.ledger(documents(spark, rows))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in book.collect()}
    assert got == {i: brute_rules(t) for i, t, _ in rows}
    kept = quality_rules.apply_policy(book)
    table = {r.rule: r for r in quality_rules.ablations(book).collect()}
    flags = [r.failed for r in kept.collect()]
    for k, rule in enumerate(quality_rules.RULES):
        if rule.name in table:
            assert table[rule.name].n_failed == sum(f >> k & 1 for f in flags) and table[rule.name].n_failed_alone == sum(f == 1 << k for f in flags)


def brute_scores(rows):
    """{row: (held_out, n_tokens, n_known, train tokens, base score, score)} from exact counts, quantised for the score."""
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    pairs = lambda t: list(zip([None, *tokens(t)[:-1]], tokens(t), strict=True))
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1
    train = [t for i, t, _ in rows if not held(i)]
    count, both = Counter(x for t in train for x in tokens(t)), Counter(x for t in train for x in pairs(t))
    n, v, mean = sum(count.values()), len(count), lm_scoring.level_counts()
    about = lambda c: mean[1 + math.floor(math.log(c) / math.log(lm_scoring.BASE) + 1e-9)] if c else 0.0
    whole, out = n + 0.5 * (v + 1), []
    for i, t, _ in rows:
        score = 0.0
        for before, word in pairs(t):
            share = lm_scoring.PAIR_SHARE if count[before] else 0.0
            ratio = min(1.0, about(both[before, word]) / max(about(count[before]), 1.0))
            score += math.log10(min(1.0, share * ratio + (1 - share) * (about(count[word]) + 0.5) / whole))
        base = sum(math.log10((count[x] + 0.5) / whole) for x in tokens(t))
        out.append((-1 if i is None else i, held(i), len(tokens(t)), sum(x in count for x in tokens(t)), n, round(base, 6), round(score, 6)))
    return sorted(out)


@pytest.mark.parametrize(("top", "broadcast_bits", "block"), [(1 << 18, 1 << 29, 1 << 22), (20, 1 << 29, 1 << 22), (1 << 18, 0, 1 << 22), (20, 0, 300)])
def test_scores(spark, corpus, top, broadcast_bits, block):
    rows = [*corpus, (None, "w1 w2 w3", "s"), (700, "w1 w2 " * 20_000, "s")]
    got = lm_scoring.score_texts(documents(spark, rows), bits_each=200, broadcast_bits=broadcast_bits, top=top, block=block).collect()
    want = brute_scores(rows)
    rounded = sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got)
    assert [r[:5] for r in rounded] == [r[:5] for r in want]
    for k in (5, 6):  # with so many bits next to no probe hits by chance
        assert np.allclose([r[k] for r in rounded], [r[k] for r in want], rtol=1e-6 if k == 5 else 1e-3)
    out = [r for r in got if r.held_out and r.n_tokens > 20]
    assert all(r.score <= 0 for r in got) and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_paged_filter_reads_what_a_broadcast_one_does(spark, corpus):
    """With two bits for a number many probes hit by chance, and in both ways the same ones do."""
    rows = documents(spark, [*corpus, (None, None, "s"), (701, "w1 " * 5_000, "s"), (701, "w1 " * 5_000, "s")])
    one, two, three = (
        sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in lm_scoring.score_texts(rows, bits_each=2, broadcast_bits=b, block=block).collect())
        for b, block in ((1 << 29, 1), (0, 1 << 22), (0, 1))
    )
    assert one == two == three


def test_blocks_ask_once_for_what_they_hold():
    """A block's n-grams stand together and once, whatever batches its texts come in; a repeated text asks no more."""
    batch = pa.RecordBatch.from_pydict({"block": pa.array([5, 5, 6, 6], pa.int64()), "text": ["a b a b", "A  b", None, "a b"]})
    for cut in (4, 1, 3):
        out = [r for x in lm_scoring._ask(4)(iter([batch.slice(i, cut) for i in range(0, 4, cut)])) for r in x.to_pylist()]
        asked = [(r["block"], h) for r in out for h in np.frombuffer(r["asked"], np.uint64).tolist()]
        assert len(asked) == len(set(asked)) and [b for b, _ in asked] == sorted(b for b, _ in asked)
        assert all((h >> 40) % 4 == r["bucket"] for r in out for h in np.frombuffer(r["asked"], np.uint64).tolist())
        # a, b and the end; (end, a), (a, b), (b, a), (b, end); and in block 6 (end, end) for the empty text, without (b, a).
        assert Counter(b for b, _ in asked) == {5: 7, 6: 7}


def test_scores_without_training_text(spark):
    rows = documents(spark, [(3, "a b", "s"), (3, None, "s")])
    assert zlib.crc32(b"3") % 5 == lm_scoring.HELD_OUT
    assert [(r.score, r.base_score, r.n_tokens) for r in lm_scoring.score_texts(rows).orderBy("n_tokens").collect()] == [(0, 0, 1), (0, 0, 3)]
    for bits in (0, 1 << 29):
        assert lm_scoring.score_texts(rows.limit(0), broadcast_bits=bits).count() == 0


def test_filter_never_reads_a_level_too_low():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    h, c = rng.integers(0, 2**63, 3000, dtype=np.uint64), rng.integers(1, 500, 3000)
    buckets, pages = 8, 16
    batch = pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c)], ["h", "c"])
    bits = np.zeros(pages * lm_scoring.PAGE_BITS // 8, np.uint8)
    for out in lm_scoring._fill(buckets, pages)(iter([batch.slice(0, 1000), batch.slice(1000)])):
        for page, own in zip(*out.columns, strict=True):
            a = page.as_py() * lm_scoring.PAGE_BITS // 8
            bits[a : a + lm_scoring.PAGE_BITS // 8] = np.frombuffer(own.as_py(), np.uint8)
    read, true = lm_scoring.read_levels(bits, buckets, h), lm_scoring.levels(c)
    assert (read >= true).all() and (read == true).mean() > 0.8


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6) / 3]) for i in range(240)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (350, None), (400, [0.1, None] * 3), (450, [float("nan")] * 6), (500, []), (550, [float("inf")] * 6), (600, [100.5] * 6), (601, [-0.001] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, rank string")
    good = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    good |= {None: [math.floor(256 * float(np.float32(0.1)))] * 6}
    df = df.union(spark.createDataFrame([(None, [0.1] * 6, "x")], df.schema))
    vectors = df.select("vec_id", topk_search.quantised(F.col("embedding")).alias("v")).where("v is not null")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), 5, block_rows=70).collect()}
    want = {}
    for q in (i for i in good if i is not None and i % 50 == 0):
        scored = sorted((-sum(a * b for a, b in zip(good[q], v, strict=False)), i is None, i) for i, v in good.items() if i is None or i != q)
        want |= {(q, k + 1): (i, -s) for k, (s, _, i) in enumerate(scored[:5])}
    assert got == want
    assert topk_search.top_k(vectors.limit(0), vectors.limit(0).select(F.col("vec_id").alias("query_id"), "v"), 5).count() == 0


def test_top_k_of_large_components(spark):
    """Scores are exact as long as they are 64-bit integers; beyond, the search refuses."""

    def search(rows):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        vectors = df.select("vec_id", topk_search.quantised(F.col("embedding")).alias("v")).where("v is not null")
        return [(r.vec_id, r.score) for r in topk_search.top_k(vectors, vectors.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "v"), 5).orderBy("rank").collect()]

    assert search([(0, [1e6]), (1, [1e6]), (2, [2e6]), (3, [-3e6])]) == [(2, 131072000000000000), (1, 65536000000000000), (3, -196608000000000000)]
    assert search([(0, [1.0]), (1, [1e12]), (2, [-1e12])]) == [(1, 256 * 256 * 10**12), (2, -256 * 256 * 10**12)]
    for rows in ([(0, [1e12]), (1, [1e12])], [(0, [1e300]), (1, [0.0])]):
        with pytest.raises(Exception, match="64-bit"):
            search(rows)


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] &lt; ok [/INST]", "<|done|><|turn|>user<|says|>", "&amp;amp;", "", None, "é😀\n"]
    rows = [(c, t, ["user", "assistant", "<x>", None][t % 4], nasty[(c + t) % len(nasty)], 9) for c in range(5) for t in range(7)] + [(0, None, "user", "last", 9), (3, 1, "assistant", "x", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq int")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(chat_format.text_parts(df))).collect()}
    for c in range(5):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].n_turns == len(own) and got[c].loss_chars == len(learned)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_parts_become_placeholders(spark):
    parts = [("text", "see <this>", None, None), ("image", None, "a.png", 100_000), ("document", None, "b.pdf", None), ("audio", None, "c.wav", 6400)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None)])], f"conv_id long, turn long, role string, parts array<{chat_format.PART}>")
    one, two = chat_format.format_turns(df).orderBy("seq").collect()
    assert one.formatted == "<|turn|>user<|says|>see &lt;this><|image:1:98|><|document:2:8|><|audio:3:16|><|done|>"
    assert one.refs == ["a.png", "b.pdf", "c.wav"] and one.attachment_tokens == 122 and one.spans == []
    assert two.formatted[two.spans[0] : two.spans[1]] == "ok"


def test_line_dedup(spark):
    rng = random.Random(11)
    base = [" ".join(words(rng, 30)) for _ in range(30)]
    near = lambda x: x.replace("w1", "q1", 1)
    rows = [(i, "\n".join([base[i], near(base[(i + 1) % 30]) if i % 2 else f"own line {rng.random()}", "", "same short"]), "s") for i in range(30)]
    rows += [(40, None, "s"), (41, "", "s"), (42, "same short\nsame short", "s"), (43, "\n \n", "s"), rows[3]]
    docs = documents(spark, rows)
    shingles = lambda x: {x[k : k + 5] for k in range(max(1, len(x) - 4))}
    first, gone = [], defaultdict(set)
    places = sorted({(i, n, x) for i, t, _ in rows for n, x in enumerate((t or "").split("\n")) if x.strip()})
    parent = {x: x for *_, x in places}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(list(parent), 2):
        if 100 * len(shingles(a) & shingles(b)) >= 75 * len(shingles(a) | shingles(b)):
            parent[find(a)] = find(b)
    for i, n, x in places:
        (gone[i].add(n) if find(x) in first else first.append(find(x)))
    got = line_dedup.dedup_lines(docs)
    assert got.select("row.*").columns == docs.columns
    for r in got.select("row.*").collect():
        text = dict((i, t) for i, t, _ in rows)[r.doc_id]
        assert r.text == (text if not gone[r.doc_id] else "\n".join(x for n, x in enumerate(text.split("\n")) if n not in gone[r.doc_id]))
    left = {r.doc_id for r in line_dedup.line_dedup_stage(spark, docs, "").collect()}
    assert 42 not in left and {40, 41, 43} <= left
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def brute_dropped(rows):
    """Of documents of one line each, whether the line goes."""
    sets = {i: {t[k : k + 5] for k in range(max(1, len(t) - 4))} for i, t, _ in rows}
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if root[a] != root[b] and 4 * min(len(sets[a]), len(sets[b])) >= 3 * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root[a], root[b]))
            root = {i: x if r == y else r for i, r in root.items()}
    return {i: int(r != i) for i, r in root.items()}


def test_line_dedup_compares_all_of_a_band(spark):
    """Pairs of similar lines that share their frequent start with a smaller hub, and with it nothing else."""
    rng = random.Random(21)
    start = " ".join(rng.choice("abcdefgh") for _ in range(60)) + " "
    base = [start + "".join(rng.choice("klmnopqrstuvwxyz") for _ in range(160)) for _ in range(40)]
    rows = [(2 * i + k, b + end, "s") for i, b in enumerate(base) for k, end in enumerate(["", "."])]
    got = {r[0]: r[1] for r in line_dedup.dedup_lines(documents(spark, rows)).select("row.doc_id", "n_dropped").collect()}
    assert sum(got.values()) == len(base)
    assert got == brute_dropped(rows)


def test_line_dedup_of_lines_with_a_common_beginning(spark):
    """1,000 lines with the same 16 words first and eight of their own behind, in pairs with one to four typed errors."""
    rng = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    start = " ".join(word() for _ in range(16))
    rows = []
    for i in range(500):
        line = f"{start} " + " ".join(word() for _ in range(8))
        other = list(line)
        for _ in range(1 + i % 4):
            other[rng.randrange(len(start), len(line))] = rng.choice(letters)
        rows += [(2 * i, line, "s"), (2 * i + 1, "".join(other), "s")]
    want = brute_dropped(rows)
    got = {r[0]: r[1] for r in line_dedup.dedup_lines(documents(spark, rows)).select("row.doc_id", "n_dropped").collect()}
    assert not any(got[i] > want[i] for i in got)
    recall = sum(got.values()) / sum(want.values())
    print(f"recall {recall:.3f} of {sum(want.values())} lines")
    assert recall >= 0.9


def test_line_dedup_of_short_lines(spark):
    """Short lines of all lengths whose last characters are changed, added or missing."""
    rng = random.Random(22)
    rows = [(0, "Subscribe to our letter", "s"), (1, "Subscribe to our letter.", "s"), (2, "Enülich schbe nicht er.", "s"), (3, "Enülich schbe nicht.", "s")]
    for n in range(1, 45):
        line = "".join(rng.choice("abcdefghij ") for _ in range(n - 1)) + "k"
        rows += [(10 * n + k, x, "s") for k, x in enumerate([line, line[:-1] + "x", line[:-2] + "yz", line + "!", line + "??", line[:-1]]) if x.strip()]
    got = {r[0]: r[1] for r in line_dedup.dedup_lines(documents(spark, rows)).select("row.doc_id", "n_dropped").collect()}
    assert got == brute_dropped(rows)


def test_classifier_on_held_out_labels(spark):
    rng = random.Random(12)
    good = lambda: " ".join(rng.choice(["the", "of", "and", f"wo{rng.randrange(900)}rd"]) for _ in range(rng.randrange(60, 200))).capitalize() + "."
    bad = [lambda: good().upper().replace(" ", "!! "), lambda: good().replace(" ", "$$$ "), lambda: (good()[:60] + "\n") * 30]
    rows = [(i, bad[i % 3]() if i % 6 == 0 else good(), "s") for i in range(600)] + [(900, None, "s"), (901, "", "s"), (902, "Short.", "s"), (0, "Short.", "s")]
    docs = documents(spark, rows)
    got = {(r.doc_id, r.n_words): r.kept for r in quality_classifier.classify(docs).collect()}
    verdict = {i: k for (i, _), k in got.items()}
    assert sum(verdict[i] == (i % 6 != 0) for i in range(1, 600)) > 590
    assert not verdict[900] and not verdict[901] and verdict[902]
    kept = quality_classifier.classifier_stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("doc_id = 902").count() == 1
    assert quality_classifier.classify(docs.limit(0)).count() == 0


def test_bitmap_keeps_every_member(spark):
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    rows = spark.range(5000).withColumnRenamed("id", "k")
    bitmap = common.member_bitmap(keys, "k", 700)
    hit, miss = common.maybe_in(rows, "k", bitmap), common.maybe_in(rows, "k", bitmap, inverse=True)
    assert hit.join(keys, "k").count() == keys.count() and hit.count() + miss.count() == 5000 and hit.count() < 2500
