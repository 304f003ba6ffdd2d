"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every document. Their accuracies
aren't known; expectation-maximisation estimates, for good and for bad documents,
how often each labeller gives each vote, from the counts of all vote patterns of
the whole corpus (at most 3 ** 8 patterns, so the driver gets a bounded table).
The posterior of a pattern is the weak label of its documents. A logistic scorer
over hashed features (words, word shapes, binned ratios) learns the posteriors of
about SAMPLE documents, and of 2 * SAMPLE at most, which the hash of doc_id and text
picks and orders; one task trains it, in a few seconds whatever the corpus. It
then judges all.

Defined cases: a null text or one without words is rejected with score 0; a text may
be of any length; a null doc_id is handed on; rows that repeat a doc_id are judged each;
an empty table gives no rows; other columns aren't read by `classify`, and
`classifier_stage` hands them on, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, text_slices, word_hashes

DIMS, SAMPLE = 2048, 4000
LEAST, SHRINK = 0.3, 20
_SHAPES, _BINS = 256, 256
_WORDS = DIMS - _SHAPES - _BINS
#: Words of a text whose distinct ones are counted together.
VARIETY_WORDS = 400
BAD, NOTHING, GOOD = 0, 1, 2

_U = np.uint64
_KIND = np.zeros((5, 256), bool)  # capitals, small letters, digits, symbols, letters
_KIND[0, 65:91] = True
_KIND[1, 97:123] = True
_KIND[2, 48:58] = True
_KIND[3, [ord(c) for c in "#*$%&|<>"]] = True
_KIND[4] = _KIND[0] | _KIND[1]
_KIND[4, 0xC3:0xF5] = True  # the first byte of most letters beyond ASCII

#: Each labeller: its name, the ratio it looks at, and the ranges that it calls bad and good.
LABELLERS = (
    ("capitals", "capitals", (0.6, np.inf), (-np.inf, 0.3)),
    ("symbols", "symbols", (0.3, np.inf), (-np.inf, 0.02)),
    ("shouting", "shouting", (0.2, np.inf), (-np.inf, 0.02)),
    ("repeats", "repeats", (0.85, np.inf), (-np.inf, 0.3)),
    ("letters", "letters", (-np.inf, 0.6), (0.85, np.inf)),
    ("marked_words", "marked", (0.5, np.inf), (-np.inf, 0.25)),
    ("variety", "variety", (-np.inf, 0.2), (0.4, np.inf)),
)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(number of words, ratios, word feature, shape feature, first word) of texts."""
    hashed, first = word_hashes(data, offsets)
    n = np.diff(first).astype(np.float64)
    kinds = [_sums(_KIND[i][data], offsets) for i in range(5)]
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    chars = _sums(~gap & ((data & 0xC0) != 0x80), offsets)
    loud = _sums(data == 33, offsets)
    # Words: where they begin and end in the bytes, for shapes.
    inside = ~gap
    start = inside & np.append(True, gap[:-1]) if len(data) else inside
    begins = offsets[:-1][offsets[:-1] < len(data)]
    start[begins] = inside[begins]
    starts = np.flatnonzero(start)
    if len(starts):
        cum = [np.concatenate([[0], np.cumsum(_KIND[i][data])]) for i in range(5)]
        ends = np.append(starts[1:], len(data))
        in_word = [c[ends] - c[starts] for c in cum]
        size = np.concatenate([[0], np.cumsum(inside)])
        length = size[ends] - size[starts]
        plain = in_word[4] > 0
        last = starts + length - 1
        shape = np.minimum(in_word[0], 3) * 64 + np.minimum(in_word[3], 3) * 16 + np.minimum(length // 4, 3) * 4 + (data[last] == 33) * 2 + plain
        marked = (_KIND[3][data[last]] | (data[last] == 33)).astype(np.float64)
        short = (length <= 3).astype(np.float64)
    else:
        shape, marked, short = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    of = np.repeat(np.arange(len(n)), np.diff(first)).astype(_U)
    # Three-word windows that occur twice in their text, and the words inside them.
    covered = np.zeros(len(hashed), bool)
    if len(hashed) > 2:
        window = mix(mix(mix(hashed[:-2] + _U(1)) + hashed[1:-1]) + hashed[2:] + of[:-2] * _U(0x9E3779B97F4A7C15))
        whole = of[:-2] == of[2:]
        _, back, times = np.unique(window, return_inverse=True, return_counts=True)
        twice = whole & (times[back] > 1)
        for j in range(3):
            covered[j : len(hashed) - 2 + j] |= twice
    # Distinct words are counted in blocks of VARIETY_WORDS, so that a long text isn't judged by its length.
    block = (np.arange(len(hashed)) - np.repeat(first[:-1], np.diff(first))) // VARIETY_WORDS
    place = mix(of * _U(0x9E3779B97F4A7C15) + block.astype(_U))
    kind, where = np.unique(mix(hashed + place * _U(0x9E3779B97F4A7C15)), return_index=True)
    fresh = np.zeros(len(hashed))
    fresh[where] = 1
    per = np.maximum(n, 1)
    ratios = {
        "capitals": kinds[0] / np.maximum(kinds[0] + kinds[1], 1),
        "symbols": kinds[3] / per,
        "shouting": loud / per,
        "repeats": _sums(covered, first) / per,
        "letters": kinds[4] / np.maximum(chars, 1),
        "marked": _sums(marked, first) / per,
        "variety": _sums(fresh, first) / per,
        "short": _sums(short, first) / per,
    }
    return n, ratios, (hashed % _U(_WORDS)).astype(np.int64), shape.astype(np.int64), first


def votes(n: np.ndarray, ratios: dict[str, np.ndarray]) -> np.ndarray:
    """One column a labeller."""
    out = np.full((len(n), len(LABELLERS)), NOTHING, np.int64)
    for j, (_, ratio, bad, good) in enumerate(LABELLERS):
        x = ratios[ratio]
        out[(x >= good[0]) & (x <= good[1]), j] = GOOD
        out[(x >= bad[0]) & (x <= bad[1]), j] = BAD
    return out


def _bins(ratios: dict[str, np.ndarray]) -> np.ndarray:
    """The hashed bin of each ratio, one column a ratio."""
    names = sorted(ratios)
    step = [np.minimum((ratios[k] * 20).astype(np.int64), 31) for k in names]
    return np.stack([(mix((s + 1000 * (j + 1)).astype(_U)) % _U(_BINS)).astype(np.int64) for j, s in enumerate(step)], axis=1)


def _pattern(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(v.shape[1]))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern, n): counts of a task's vote patterns."""
    counts = np.zeros(3 ** len(LABELLERS), np.int64)
    for batch in batches:
        for _, data, offsets in text_slices(batch.column("text")):
            n, ratios, *_ = measure(data, offsets)
            counts += np.bincount(_pattern(votes(n, ratios))[n > 0], minlength=len(counts))
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["pattern", "n"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pick, pattern, features): the hashed features of the sample."""
    for batch in batches:
        for row, data, offsets in text_slices(batch.column("text")):
            n, ratios, word, shape, first = measure(data, offsets)
            x = np.zeros((len(n), DIMS), np.float32)
            of = np.repeat(np.arange(len(n)), np.diff(first))
            per = 1 / np.maximum(n, 1)
            np.add.at(x, (of, word), per[of])
            np.add.at(x, (of, _WORDS + shape), per[of])
            for b in _bins(ratios).T:
                x[np.arange(len(n)), _WORDS + _SHAPES + b] += 1 / len(ratios)
            keep = np.flatnonzero(n > 0)
            columns = [batch.column("pick").slice(row, len(n)).take(pa.array(keep)), pa.array(_pattern(votes(n, ratios))[keep]), pa.array([x[i].tobytes() for i in keep], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["pick", "pattern", "x"])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> dict:
    """EM for good documents and, for each labeller, a kind of bad ones that begins
    as those it calls bad: documents are bad in one way and look good in all others.
    Given the kind, labellers are independent. Returns the share of bad documents, each
    labeller's votes by kind (0: good), and the posterior of being good for each possible pattern."""
    n = len(LABELLERS)
    every = (np.arange(3**n)[:, None] // 3 ** np.arange(n)) % 3
    seen = every[patterns]
    bad = (seen == BAD).astype(np.float64)
    kinds = np.concatenate([np.where(bad.any(axis=1), 0.05, 1.0)[:, None], bad], axis=1)
    kinds /= np.maximum(kinds.sum(axis=1, keepdims=True), 1e-12)
    for _ in range(rounds):
        weight = kinds * counts[:, None]
        share = weight.sum(axis=0) + 1e-3
        table = np.stack([weight.T @ (seen == v) for v in range(3)], axis=2) + 0.01
        table /= table.sum(axis=2, keepdims=True)
        log = np.log(share / share.sum()) + np.stack([np.log(table[c][np.arange(n), every]).sum(axis=1) for c in range(n + 1)], axis=1)
        all_kinds = np.exp(log - log.max(axis=1, keepdims=True))
        all_kinds /= all_kinds.sum(axis=1, keepdims=True)
        kinds = all_kinds[patterns]
    return {"bad": float(1 - share[0] / share.sum()), "votes": table, "posterior": all_kinds[:, 0]}


def train(x: np.ndarray, y: np.ndarray, rounds: int = 300, rate: float = 0.3, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on soft labels; both classes weigh the same. `x` is float32 and isn't copied."""
    w, b = np.zeros(x.shape[1]), 0.0
    if not len(x):
        return w, 3.0
    each = y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)
    each /= each.sum()
    m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -50, 50)))
        d = each * (p - y)
        g = np.append(d.astype(np.float32) @ x + decay * w, d.sum())
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _train(posterior: np.ndarray):
    """(weights, bias, n): one row, from all the rows of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, patterns = [np.zeros((0, DIMS), np.float32)], [np.zeros(0, np.int64)]
        for batch in batches:
            patterns.append(batch.column("pattern").to_numpy())
            x.append(np.array([np.frombuffer(v.as_buffer(), np.float32) for v in batch.column("x")], np.float32).reshape(-1, DIMS))
        x, patterns = np.concatenate(x), np.concatenate(patterns)
        w, b = train(x, posterior[patterns])
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([float(b)]), pa.array([len(x)])], ["weights", "bias", "n"])

    return run


_JUDGED = "doc_id bigint, n_words bigint, n_bad_votes int, weak_label double, score double, kept boolean"


def _judge(posterior: np.ndarray, w: np.ndarray, b: float, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, offsets in text_slices(batch.column("text")):
                n, ratios, word, shape, first = measure(data, offsets)
                v = votes(n, ratios)
                lin = _sums(w[word] + w[_WORDS + shape], first) / np.maximum(n, 1) + w[_WORDS + _SHAPES + _bins(ratios)].mean(axis=1) + b
                weak = np.where(n > 0, posterior[_pattern(v)], 0.0)
                # A short text has few features, so its weak label counts as SHRINK words.
                score = np.where(n > 0, (n / (1 + np.exp(-np.clip(lin, -50, 50))) + SHRINK * weak) / (n + SHRINK), 0.0)
                columns = [batch.column("doc_id").slice(row, len(n)), pa.array(n.astype(np.int64)), pa.array((v == BAD).sum(axis=1).astype(np.int32)), pa.array(weak), pa.array(score), pa.array((score >= least) & (n > 0))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _JUDGED.split(", ")])

    return run


def fit(docs: DataFrame, sample: int = SAMPLE) -> dict:
    """The model: labellers' accuracies from all rows, the scorer from at most about `sample` of them."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = texts.select("text").mapInArrow(_vote, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).collect()
    patterns, counts = (np.array([r[k] for r in counted], np.int64) for k in ("pattern", "n"))
    model = estimate(patterns, counts)
    total = max(1, int(counts.sum()))
    # Equal rows share their hash, so the order, and with it the model, is the same in each run.
    pick = F.xxhash64("doc_id", "text", F.lit(5))
    some = texts.select(pick.alias("pick"), "text").where(F.pmod("pick", F.lit(total)) < sample)
    rows = some.mapInArrow(_features, "pick bigint, pattern bigint, x binary").orderBy("pick").limit(2 * sample)
    made = rows.coalesce(1).mapInArrow(_train(model["posterior"]), "weights binary, bias double, n bigint").first()
    return model | {"weights": np.frombuffer(made["weights"]), "bias": made["bias"], "sampled": made["n"]}


def classify(docs: DataFrame, model: dict | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, n_words, n_bad_votes, weak_label, score (both the probability of
    being good) and kept for each row of `docs`."""
    model = model or fit(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_judge(model["posterior"], model["weights"], model["bias"], least), _JUDGED)


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: rows that the scorer keeps. Judged in the pass that reads them, without a join."""
    model = fit(docs)
    judge = _judge(model["posterior"], model["weights"], model["bias"], LEAST)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], ["doc_id", "text"])
            kept = pa.concat_arrays([x.column("kept") for x in judge(iter([plain]))]) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.filter(kept)

    return docs.mapInArrow(keep, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table, judged by the model that it trains."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
