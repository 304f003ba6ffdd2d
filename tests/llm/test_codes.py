"""SimHash links, vector codes and fill-in-middle against plain versions, with odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casestream.llm import fill_middle, simhash_dedup, vector_codes

CLASHES = ("row", "key", "node", "root", "marked", "whole", "n", "form")
DOCS = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHES)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", *CLASHES) for i, t in rows], DOCS)


# -- fill-in-middle --------------------------------------------------------


def plain_fim(doc_id, text):
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t, re.DOTALL)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, None, t
    spm = h[3] % 100 < 20
    return len(units), "spm" if spm else "psm", p, m, s, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(13)
    alphabet = ["a", "Bc", " ", "\n", "\t", "0", "1", "\x01", "\x02", "\x02\x01", "é", "漢", "😀", "<", "P>", "$1", "\\", "\r\n", " ", "\x00"]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(40)))) for i in range(250)]
    rows += [(300, None), (301, ""), (302, "a <P> b"), (303, "<S>"), (304, "<M"), (305, "\x02" * 30), (306, "\x01" * 30), (307, "word " * 30_000), (308, "x" * 100_000)]
    return [*rows, (None, "of no id"), (None, None), rows[3], (3, "another text of the id 3")]


def test_fill_in_middle_equals_a_plain_version(spark, texts):
    out = fill_middle.fill_in_middle(documents(spark, texts))
    back = fill_middle.restore(F.col("output"), F.col("form")).alias("back")
    got = sorted(repr((r.doc_id, r.text, r.n, r.form, r.prefix, r.middle, r.suffix, r.output, r.back)) for r in out.select("row.doc_id", "row.text", "n", "form", "prefix", "middle", "suffix", "output", back).collect())
    assert got == sorted(repr((i, t, *plain_fim(i, t), t or "")) for i, t in texts)
    forms = {f for i, t in texts for f in [plain_fim(i, t)[1]]}
    assert forms == {"plain", "psm", "spm"}
    row = out.select("row.*")
    assert row.columns == documents(spark, []).columns and out.where("row.form <> 'form'").isEmpty()


def test_fill_in_middle_parameters_and_empty_tables(spark, texts):
    assert fill_middle.fill_in_middle(documents(spark, [])).isEmpty()
    some = documents(spark, texts[:60])
    assert {r.form for r in fill_middle.fill_in_middle(some, plain_percent=100).select("form").collect()} == {"plain"}
    assert "psm" not in {r.form for r in fill_middle.fill_in_middle(some, plain_percent=0, spm_percent=100).select("form").collect()}
    one, two = (fill_middle.fill_in_middle(some, seed=s).select("output") for s in ("1", "2"))
    assert not one.exceptAll(two).isEmpty()


# -- SimHash ---------------------------------------------------------------


def plain_fingerprint(text):
    s = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", s) if w]
    shingles = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)] * bool(ws)
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints):
    """The smallest index that each reaches over at most 3 differing bits."""
    root = np.arange(len(prints))
    values = np.array(prints, np.uint64)
    while True:
        new = np.array([root[np.bitwise_count(values ^ v) <= 3].min() for v in values])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def test_simhash_components_equal_brute_force(spark):
    rng = random.Random(11)
    base = [f"w{rng.randrange(500)}" for _ in range(300)]
    rows = []
    for i in range(60):
        copy = list(base) if i % 2 else [f"v{rng.randrange(500)}" for _ in range(30)]
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            copy[rng.randrange(len(copy))] = f"x{i}"
        rows.append((100 - i, " ".join(copy).upper() if i % 5 == 0 else " \n".join(copy)))
    rows += [(500, None), (501, ""), (7, " \t"), (502, "one"), (503, "ONE two"), (504, "one  two"), (505, "É x y"), (None, "one"), (None, "alone in this form"), (502, "another text of the id"), rows[3]]
    rows.append((600, " ".join(f"l{rng.randrange(9000)}" for _ in range(30_000))))
    got = simhash_dedup.simhash_components(documents(spark, rows)).collect()
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = plain_groups(prints)
    least = {g: min((rows[i][0] for i in np.flatnonzero(groups == g) if rows[i][0] is not None), default=None) for g in set(groups)}
    want = sorted(repr((i, f"{p:016x}", least[g])) for (i, _), p, g in zip(rows, prints, groups, strict=True))
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    assert len(set(groups)) < len(rows) - 20
    assert simhash_dedup.simhash_components(documents(spark, [])).isEmpty()


def test_fingerprints_in_pieces(monkeypatch):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("aBcé\u2003") for _ in range(rng.randrange(1, 9))) for _ in range(400)) + "\n\n"
    want, pieces = plain_fingerprint(text), simhash_dedup._pieces
    for most in (1, 2, 7, 50, 1 << 20):
        monkeypatch.setattr(simhash_dedup, "_pieces", lambda data, most=most: pieces(data, most))
        assert simhash_dedup.fingerprint(text.encode()) == want


@pytest.mark.parametrize("bucket", [2048, 6])
def test_links_of_large_buckets(spark, bucket):
    """A cloud around one value, chains of steps of three bits, and values that share a half; `bucket` sends them through all levels."""
    rng = random.Random(bucket)
    values = {rng.getrandbits(64) for _ in range(150)}
    for centre in (rng.getrandbits(64), 0, 2**64 - 1):
        for _ in range(120):
            values.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))))
    step = rng.getrandbits(64)
    for _ in range(40):
        step ^= sum(1 << b for b in rng.sample(range(64), 3))
        values.add(step)
    low = rng.getrandbits(32)
    values |= {(rng.getrandbits(32) << 32) | low for _ in range(40)} | {(low << 32) | (rng.getrandbits(8) << 5) for _ in range(60)}
    prints = sorted(values)
    nodes = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in prints], "node bigint")
    found = {r.node: r.root for r in simhash_dedup.link_nodes(nodes, bucket=bucket).collect()}
    groups = plain_groups(prints)
    got = [found.get(int(np.uint64(v).astype(np.int64)), None) for v in prints]
    pairs = {(g, r) for g, r in zip(groups, got, strict=True) if (groups == g).sum() > 1}
    assert len(pairs) == len({g for g, _ in pairs}) == len({r for _, r in pairs}) and None not in {r for _, r in pairs}
    assert all(r is None for g, r in zip(groups, got, strict=True) if (groups == g).sum() == 1)


def test_distances_beyond_the_method_are_refused(spark):
    with pytest.raises(ValueError, match="3 bits"):
        simhash_dedup.link_nodes(spark.createDataFrame([(1,)], "node bigint"), distance=4)


# -- vector codes ----------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string, n long, v string, ids long"


def vectors(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, label, "c", 1, "v", 2) for i, v, label in rows], VECTORS).repartition(parts)


def plain_codes(rows):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max(1, -(-max(len(v) for _, v, _ in kept) // 8))
    whole = np.zeros((len(kept), 8 * width), np.int64)
    for k, (_, v, _) in enumerate(kept):
        whole[k, : len(v)] = np.floor(4096 * np.array(v, np.float32).astype(float)).astype(np.int64)
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k].tolist()))[:16]
    x = whole.reshape(-1, 8, width)
    books = x[first].transpose(1, 0, 2).copy()
    for step in range(7):
        d = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        code = d.argmin(axis=2)
        for p in range(8):
            for e in range(len(first)):
                mine = x[code[:, p] == e, p]
                if step < 6 and len(mine):
                    books[p, e] = mine.sum(axis=0) // len(mine)
    error = d.min(axis=2).sum(axis=1)
    text = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return [(i, label, "".join(f"{c:02x}" for c in row), int(e)) for (i, _, label), row, e in zip(kept, code, error, strict=True)], text


def check_codes(spark, rows, **options):
    coded, books = vector_codes.vector_codes(vectors(spark, rows, **options))
    want, text = plain_codes(rows)
    got = sorted(repr((r.vec_id, None if r.label is None else int(r.label), r.code, r.error)) for r in coded.collect())
    assert got == sorted(map(repr, want))
    assert vector_codes.digest(books) == text


def test_codes_equal_plain_rounds(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(30, 24))
    v = (centres[rng.integers(0, 30, 900)] + rng.normal(scale=0.2, size=(900, 24))).astype(np.float32)
    rows = [(5 * k % 1801, v[k].tolist(), k % 4 if k % 3 else None) for k in range(900)]
    rows += [(2000, None, 1), (2001, [None] * 24, 1), (2002, [float("nan")] * 24, 1), (2003, [float("inf")] * 24, 1), (2004, [0.0] * 24, 1)]
    rows += [(2010 + k, v[0].tolist(), 2) for k in range(300)] + [rows[1], (rows[1][0], v[7].tolist(), 3), (None, v[8].tolist(), None)]
    check_codes(spark, rows)
    monkeypatch.setattr(vector_codes, "BLOCK_VALUES", 24 * 100)  # many small trees give the same
    check_codes(spark, rows, parts=2)


@pytest.mark.parametrize(
    "rows",
    [
        [(3, [0.5] * 8, 1)],
        [(k, [0.25, -0.5, 1.0] * (1 + k % 4), k % 2) for k in range(40)],  # lengths differ; PARTS doesn't divide them
        [(k, [float(k % 3)] * 16, 0) for k in range(50)],  # equal entries: ties to the first
        [(1, [], 1), (2, [], None)],
    ],
)
def test_codes_of_few_and_odd_vectors(spark, rows):
    check_codes(spark, rows)


def test_codes_without_rows_and_refused_components(spark):
    for rows in ([], [(1, None, 1), (2, [float("nan")], 1)]):
        coded, books = vector_codes.vector_codes(vectors(spark, rows))
        assert coded.isEmpty() and books is None
    with pytest.raises(Exception, match="a component is beyond"):
        vector_codes.vector_codes(vectors(spark, [(1, [1e9] * 8, 1)]))


def test_boxes_drop_most_entries():
    """A whole subtree goes to one entry where points lie apart: far fewer points are looked at than there are."""
    rng = np.random.default_rng(4)
    points = (rng.integers(-50, 50, (4096, 3)) + 5000 * rng.integers(0, 4, (4096, 1))).astype(np.int64)
    tree = vector_codes.Tree.build(points)
    book = np.array([[5000 * k] * 3 for k in range(4)], np.int64)
    alone, n = 0, 0
    for entry, first, last, sums in tree.assign(book):
        alone += int((last - first == 1).sum())
        n += int((last - first).sum())
        for e, a, b, s in zip(entry, first, last, sums, strict=True):
            assert (vector_codes._distances(tree.points[a:b], book).argmin(axis=1) == e).all() and (tree.points[a:b].sum(axis=0) == s).all()
    assert n == 4096 and alone < 300
