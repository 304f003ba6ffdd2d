"""Odd rows for every operator, and the corpus pipeline, each stage against a brute-force version."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import brute_dropped, brute_rules, brute_scores, words

import corpus_pipeline
from casestream.llm import chat_format, common, line_dedup, lm_scoring, mixing, near_dup, packing, quality_classifier, quality_rules, token_files

#: Names that operators use inside.
CLASHES = ("__key", "key", "row", "gone", "copy", "th", "band", "first", "node")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *(f"{c}{n}" for c in CLASHES)) for n, (i, t, s) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    """Null ids, one id with two texts, repeated rows, empty texts, a text of 20,000 words and one long word."""
    rng = random.Random(31)
    base = " ".join(words(rng, 80))
    rows = [(3, base, "a"), (5, base + " more", "a"), (5, " ".join(words(rng, 70)), "b"), (None, base + " again", None), (None, " ".join(words(rng, 60)), "b"), (None, None, "a")]
    rows += [(7, "", "a"), (8, None, None), (9, " \n\t", "b"), (10, " ".join(words(rng, 20_000, 5000)), "a"), (11, "x" * 30_000, "b"), (12, "é漢😀 <|endoftext|>", "c")]
    return rows + [rows[2], rows[2], rows[4]]


def split(t):
    return (t or "").encode().lower().split()


def brute_groups(rows):
    """For each row the rows that it reaches by five-word shingles."""
    sets = []
    for _, t, _ in rows:
        w = split(t)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    return root, sets


def order(row):
    return row[0] is None, row[0] or 0


def test_near_duplicates_of_odd_rows(spark, odd):
    root, sets = brute_groups(odd)
    want = []
    for k, (i, _, _) in enumerate(odd):
        own = [r[0] for j, r in enumerate(odd) if root[j] == root[k] and r[0] is not None] if sets[k] else [i]
        first = min(own) if own and own[0] is not None or own else None
        want.append((i, len(sets[k]), first, i == first))
    got = [tuple(r) for r in near_dup.link_components(table(spark, odd)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    left = near_dup.near_duplicate_stage(spark, table(spark, odd), "")
    rows = [(r.doc_id, r.text, r["__key"]) for r in left.collect()]
    assert left.columns == table(spark, odd).columns and len({k for *_, k in rows}) == len(rows)
    kept = Counter((i, t) for i, t, _ in rows)
    assert kept[3, odd[0][1]] == 1 and kept[5, odd[1][1]] == 0 and kept[None, odd[3][1]] == 0
    assert kept[5, odd[2][1]] == 3 and kept[None, odd[4][1]] == 2  # repeated rows stay together
    assert all(kept[i, t] for i, t, _ in odd[5:])


def test_lines_of_odd_rows(spark, odd):
    docs = table(spark, odd)
    left = line_dedup.line_dedup_stage(spark, docs, "")
    assert left.columns == docs.columns
    got = Counter((r.doc_id, r.text) for r in left.collect())
    assert got[3, odd[0][1]] == 1 and not got[5, odd[1][1]] and got[5, odd[2][1]] == 3 and got[None, None] == 1 and got[10, odd[9][1]] == 1
    assert {r["__key"] for r in left.collect()} <= {f"__key{n}" for n in range(len(odd))}


def test_mixing_of_odd_rows(spark, odd):
    docs = table(spark, odd)
    mixed = mixing.mix_documents(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in mixed) == Counter((i, s, len(split(t))) for i, t, s in odd)
    times = defaultdict(int)
    for r in mixed:
        if r.taken:
            times[r.doc_id, r.source, r.size] = max(times[r.doc_id, r.source, r.size], math.ceil(r.taken / r.size))
    out = mixing.mixing_stage(spark, docs, "")
    assert out.columns == docs.columns
    copies = Counter((r.doc_id, r.source, len(split(r.text)), r["__key"]) for r in out.collect())
    assert copies == Counter({(i, s, len(split(t)), f"__key{n}"): times[i, s, len(split(t))] for n, (i, t, s) in enumerate(odd) if times[i, s, len(split(t))]})


def test_rules_and_scores_of_odd_rows(spark, odd):
    docs = table(spark, odd)
    book = [(r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in quality_rules.ledger(docs).collect()]
    assert sorted(book, key=repr) == sorted(((i, brute_rules(t)) for i, t, _ in odd), key=repr)
    got = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in lm_scoring.score_texts(docs).collect()]
    assert sorted(got) == [r[:5] for r in brute_scores(odd)]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(common.public_tokenizer())


def test_tokens_of_odd_rows(spark, odd, tokenizer, tmp_path):
    ids = lambda t, end: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, end], "<u4")
    token_files.write_token_files(table(spark, odd), str(tmp_path / "t"), common.public_tokenizer())
    got = token_files.token_index(spark, str(tmp_path / "t")).collect()
    want = Counter((i, len(ids(t, 1)), zlib.crc32(ids(t, 1).tobytes())) for i, t, _ in odd)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted((i for i, *_ in odd), key=lambda i: (i is not None, i or 0))
    pieces = packing.pack_documents(table(spark, odd), common.public_tokenizer()).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in pieces) == Counter((i, s, zlib.crc32(ids(t, 0)[s : s + 2048].tobytes())) for i, t, _ in odd for s in range(0, len(ids(t, 0)), 2048))


def test_stripes_row_indexes_and_bloom_filters(spark, tmp_path):
    import pyarrow.orc as orc

    rows = [(i, f"word{i} and {i * 7}", "s") for i in range(6000)]
    token_files.write_token_files(table(spark, rows), str(tmp_path / "t"), common.public_tokenizer())
    files = sorted((tmp_path / "t").glob("part-*.orc"))
    assert len(files) == 4 and sum(orc.ORCFile(f).nrows for f in files) == 6000
    for f in files:
        file = orc.ORCFile(f)
        assert file.row_index_stride == 1000 and file.nstripes >= 1 and file.compression == "ZSTD"
        ids = [x for k in range(file.nstripes) for x in file.read_stripe(k, ["doc_id"]).column(0).to_pylist()]
        assert ids == sorted(ids)
        assert b"BLOOM" in f.read_bytes() or file.stripe_statistics_length > 0
    assert token_files.read_token_files(spark, str(tmp_path / "t")).where("doc_id in (17, 5999, 70000)").count() == 2


def test_encoder_of_a_tokenizer_that_keeps_case(tokenizer):
    from tokenizers import Tokenizer

    from casestream.llm.tokens import WordEncoder

    path = common.public_tokenizer("byte_bpe_50k.json")
    other, encoder = Tokenizer.from_file(path), WordEncoder(path)
    texts = ["Hello World, hello.", "", "a  b\n\tc", "<|endoftext|> É漢"]
    assert not encoder.by_word
    for row, data, offsets in common.text_slices(pa.array(texts)):
        flat, at = encoder.encode(data, offsets)
        assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [other.encode(t, add_special_tokens=False).ids for t in texts[row:]]
    mine = WordEncoder(common.public_tokenizer())
    assert mine.by_word and mine.cuts and mine.lowers


def test_empty_tables(spark):
    none = table(spark, [(1, "x", "s")]).limit(0)
    assert mixing.mix_documents(none).count() == mixing.mixing_stage(spark, none, "").count() == 0
    assert quality_rules.ledger(none).count() == quality_rules.apply_policy(quality_rules.ledger(none)).count() == 0
    assert packing.pack_documents(none, common.public_tokenizer()).count() == 0
    chats = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.read_back(chat_format.format_turns(chat_format.text_parts(chats))).count() == 0
    assert near_dup.near_duplicate_stage(spark, none, "").count() == 0


def test_empty_token_files(spark, tmp_path):
    none = table(spark, [(1, "x", "s")]).limit(0)
    token_files.write_token_files(none, str(tmp_path / "t"), common.public_tokenizer())
    assert token_files.token_index(spark, str(tmp_path / "t")).count() == 0


# -- the classifier's parts


def test_measures_equal_a_plain_count():
    texts = ["Some words here. Some words here. ok!", "SHOUT! $$$ a1", "", "é é ÄB", "one\ntwo two"]
    (_, data, offsets), = common.text_slices(pa.array(texts))
    n, ratios, *_ = quality_classifier.measure(data, offsets)
    for k, t in enumerate(texts):
        w = t.encode().split()
        plain = [x.lower() for x in w]
        assert n[k] == len(w)
        if not w:
            continue
        upper, lower = sum(c.isascii() and c.isupper() for c in t), sum(c.isascii() and c.islower() for c in t)
        seen = Counter(tuple(plain[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if seen[tuple(plain[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        want = {
            "capitals": upper / max(1, upper + lower), "symbols": sum(c in "#*$%&|<>" for c in t) / len(w), "shouting": t.count("!") / len(w), "repeats": len(covered) / len(w),
            "marked": sum(chr(x[-1]) in "#*$%&|<>!" for x in w) / len(w), "variety": len(set(plain)) / len(w), "short": sum(len(x) <= 3 for x in w) / len(w),
        }
        assert all(math.isclose(ratios[name][k], x) for name, x in want.items()), (t, {name: (ratios[name][k], x) for name, x in want.items()})


def test_estimate_finds_the_labellers_accuracies():
    rng = np.random.default_rng(3)
    n, k = 40_000, len(quality_classifier.LABELLERS)
    kind = np.where(rng.random(n) < 0.2, rng.integers(1, k + 1, n), 0)
    votes = np.full((n, k), quality_classifier.GOOD)
    votes[rng.random((n, k)) < 0.3] = quality_classifier.NOTHING
    for j in range(k):
        own = (kind == j + 1) & (rng.random(n) < 0.9)
        votes[own | (rng.random(n) < 0.002), j] = quality_classifier.BAD
    patterns, counts = np.unique(votes @ (3 ** np.arange(k)), return_counts=True)
    model = quality_classifier.estimate(patterns, counts)
    assert abs(model["bad"] - (kind > 0).mean()) < 0.05
    for j in range(k):
        assert abs(model["votes"][j + 1, j, quality_classifier.BAD] - 0.9) < 0.1 and model["votes"][0, j, quality_classifier.BAD] < 0.02
    posterior = model["posterior"][votes @ (3 ** np.arange(k))]
    assert ((posterior > 0.5) == (kind == 0)).mean() > 0.95


def test_trained_scorer_separates():
    rng = np.random.default_rng(4)
    x, y = rng.random((400, quality_classifier.DIMS)).astype(np.float32), rng.random(400) < 0.5
    x[y, 0] += 1
    w, b = quality_classifier.train(x, y.astype(float))
    assert (((x @ w + b) > 0) == y).mean() > 0.97


# -- the pipeline


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(41)
    sentence = lambda: " ".join(rng.choice(["the", "of", "and", f"wo{rng.randrange(900)}rd"]) for _ in range(rng.randrange(8, 20))).capitalize() + "."
    text = lambda: "\n".join(" ".join(sentence() for _ in range(2)) for _ in range(rng.randrange(3, 8)))
    rows = [(i, text(), "abc"[i % 3]) for i in range(90)]
    for i in range(0, 90, 9):
        rows.append((100 + i, rows[i][1], "a"))  # exact copy
        rows.append((200 + i, "\n".join([*rows[i][1].split("\n")[:-1], sentence()]), "b"))  # most lines are another's
        rows.append((300 + i, rows[i][1].upper().replace(" ", "!! "), "c"))  # shouting
    return [*rows, (400, None, "a"), (401, "", "b"), (402, "Tiny.", None)]


def plain_rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_pipeline_and_its_stages(spark, corpus, tmp_path, tokenizer):
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality classifier", "line dedup", "near-duplicate removal", "source mixing", "best-fit packing"]
    done = {}
    for name, step in corpus_pipeline.STAGES:
        before, out = docs, common.stage(step(spark, docs, str(tmp_path)), "test")
        done[name] = (before, out)
        docs = out
        if name != "best-fit packing":
            assert out.columns == before.columns

    before, out = done["quality classifier"]
    judged = [r.doc_id for r in quality_classifier.classify(before).where("kept").collect()]
    kept = plain_rows(out)
    assert sorted(i for i, *_ in kept) == sorted(judged) and not any(300 <= i < 400 for i in judged) and sum(i < 90 for i in judged) == 90

    before, out = done["line dedup"]
    lines, at = [], {}
    for i, t, _ in sorted(plain_rows(before)):
        for no, line in enumerate(t.split("\n")):
            if line.strip():
                at[len(lines)] = (i, no)
                lines.append((len(lines), line, ""))
    gone = {at[k] for k, drop in brute_dropped(lines).items() if drop}
    left = {i: "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone) for i, t, _ in plain_rows(before)}
    assert sorted((i, t) for i, t, _ in plain_rows(out)) == sorted((i, t) for i, t in left.items() if t.split())

    before, out = done["near-duplicate removal"]
    rows = sorted(plain_rows(before), key=order)
    root, _ = brute_groups(rows)
    assert sorted(plain_rows(out)) == sorted(r for k, r in enumerate(rows) if root[k] == k)

    before, out = done["source mixing"]
    taken = {r.doc_id: math.ceil(r.taken / r.size) for r in mixing.mix_documents(before).where("taken > 0").collect()}
    assert Counter(i for i, *_ in plain_rows(out)) == Counter(taken)

    before, out = done["best-fit packing"]
    pieces = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    ids = [(i, np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")) for i, t, _ in plain_rows(before)]
    assert pieces(out) == sorted((i, k, s, len(x[s : s + 2048]), zlib.crc32(x[s : s + 2048].tobytes())) for i, x in ids for k, s in enumerate(range(0, len(x), 2048)))
    filled = Counter()
    for r in out.collect():
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048 and sum(filled.values()) > 2048 * (len(filled) - 2)

    assert pieces(corpus_pipeline.run(spark, str(tmp_path))) == pieces(out)


def test_pipeline_drops_its_tables(spark, tmp_path):
    other = common.stage(spark.range(5), "other")  # of another run: it stays
    with common.staged() as made:
        a = common.stage(spark.range(3), "one")
        b = common.stage(a.selectExpr("id + 1 AS id"), "two")
    common.drop_staged(spark, made[:-1])
    assert other.count() == 5
    assert b.agg(F.sum("id")).first()[0] == 6
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT_EXIST|FileNotFound"):
        a.count()


def test_classifier_agrees_with_given_labels(spark):
    """Held-out accuracy: the model never sees `labels`."""
    folder = "/root/testdata/sf0.01"
    if not os.path.exists(f"{folder}/labels.parquet"):
        pytest.skip("no test data here")
    judged = quality_classifier.op2_quality_classifier(spark, folder)
    rows = judged.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").select("quality", "kept").collect()
    bad, good = [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.quality == 1]
    print(f"rejected {1 - sum(bad) / len(bad):.3f} of {len(bad)} low-quality, {1 - sum(good) / len(good):.3f} of {len(good)} others")
    assert sum(bad) <= 0.1 * len(bad) and sum(good) >= 0.97 * len(good)
