"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every document. The ledger keeps the
measurements and one failure bit for each rule; a policy is a versioned mask
over those bits, applied without a text. What a rule costs on its own, and what
dropping it would give back, comes from bitwise aggregation over the ledger.
DataFrame and SQL functions only.

Defined cases: a null text has no words and fails `few_words`; a text of white
space alone too; a text may be of any length; a null doc_id is handed on; rows that repeat a
doc_id are judged each; an empty table gives an empty ledger; `ledger` reads doc_id and text, whatever other columns there are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, words_of

# The characters that count as symbols, and white space between words.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"


@dataclass(frozen=True)
class Rule:
    """`fails` tells from the measurements whether a document fails."""

    name: str
    fails: str


# The order gives the bits; new rules go at the end, so that old ledgers stay readable.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > 3 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 and 2 * n_dup_lines > n_lines"),
    Rule("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 20 * n_words)"),
    Rule("capitals", "n_letters > 0 and 2 * n_capitals > n_letters"),
    Rule("few_letters", "n_words > 0 and 10 * n_letters < 4 * word_chars"),
)


@dataclass(frozen=True)
class Policy:
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r.name in self.rules)


BASE = ("few_words", "repeats")
POLICIES = {1: Policy(1, BASE), 2: Policy(2, tuple(r.name for r in RULES))}
PRODUCTION = 2


def _without(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more. The windows'
    hashes are sorted with their places; equal neighbours give the places of
    repeated windows, and the windows' union is summed along them."""
    n = F.size(words)
    at = F.sequence(F.lit(0), n - 3)
    window = F.transform(at, lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))
    # Null stands in front of and behind the sorted windows.
    line = F.sort_array(window)
    same = lambda line, x, j: (x["h"] == F.get(line, j - 1)["h"]).eqNullSafe(True) | (x["h"] == F.get(line, j + 1)["h"]).eqNullSafe(True)
    twice = F.transform(F.array(line), lambda s: F.transform(F.filter(s, lambda x, j: same(s, x, j)), lambda x: x["i"]))
    places = F.sort_array(F.get(twice, 0))
    covered = F.transform(F.array(places), lambda p: F.aggregate(F.transform(p, lambda i, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - i, F.lit(3)))), F.lit(0), lambda a, x: a + x))
    return F.when(n < 3, F.lit(0)).otherwise(F.get(covered, 0))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and every measurement, each text being read once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumns({"words": words_of(F.col("text")), "lines": F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, SPACES, "") != "")})
    long = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.translate("text", SPACES, "")),
        "n_symbols": _without(F.col("text"), SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": _repeat_words(F.col("words")),
        "n_lines": F.size("lines"),
        "n_letters": F.length(F.regexp_replace("text", r"[^\p{L}]+", "")),
        "n_capitals": F.length(F.regexp_replace("text", r"[^\p{Lu}]+", "")),
    }
    return base.select("doc_id", *[c.cast("long").alias(k) for k, c in long.items()])


def ledger(docs: DataFrame) -> DataFrame:
    """Measurements and `failed`, bit i of which says that RULES[i] fails."""
    bits: Column = F.lit(0).cast("long")
    for i, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs).withColumn("failed", bits)


def apply_policy(book: DataFrame, policy: Policy = POLICIES[PRODUCTION]) -> DataFrame:
    """The ledger with `kept` and the policy's version."""
    return book.withColumns({"kept": F.col("failed").bitwiseAND(F.lit(policy.mask)) == 0, "policy": F.lit(policy.version)})


def ablations(book: DataFrame, policy: Policy = POLICIES[PRODUCTION]) -> DataFrame:
    """For each rule of a policy: documents that fail it, that fail it alone (so
    that dropping the rule gives them back), and that the policy keeps. One
    pass; the partial sums have at most 2 ** rules rows."""
    by_bits = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    named = [(1 << i, r.name) for i, r in enumerate(RULES) if r.name in policy.rules]
    rules = F.explode(F.array(*[F.struct(F.lit(b).cast("long").alias("bit"), F.lit(n).alias("rule")) for b, n in named]))
    each = by_bits.select("bits", "n", rules.alias("r")).select("bits", "n", "r.*")
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).cast("long")
    hit, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    return each.groupBy("rule").agg(count(hit).alias("n_failed"), count(alone).alias("n_failed_alone"), count(F.col("bits") == 0).alias("n_kept"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table under the production policy."""
    base = POLICIES[1].mask
    book = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    failed = (F.col("failed").bitwiseAND(F.lit(base)) != 0).alias("base_failed")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed, "kept", "failed")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of the whole `documents` table, stored once, and the ablations of every policy from it."""
    book = stage(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")), "rule-ledger")
    each = [ablations(book, p).withColumn("policy", F.lit(v)) for v, p in sorted(POLICIES.items())]
    return each[0].unionByName(each[1])


_FAILS = " | ".join(f"(CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END)" for i, r in enumerate(RULES))

ORACLE = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents),
g AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS c
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
p AS (
  SELECT doc_id, count(DISTINCT k) AS n
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM g WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(t, '[^\\pL]', '', 'g')) AS BIGINT) AS n_letters,
         CAST(length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) AS BIGINT) AS n_capitals
  FROM w LEFT JOIN p USING (doc_id)),
f AS (SELECT *, CAST({_FAILS} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & {POLICIES[1].mask}) <> 0 AS base_failed, (failed & {POLICIES[PRODUCTION].mask}) = 0 AS kept, failed
FROM f
"""

_RULE_ROWS = ", ".join(f"({v}, {p.mask}, {1 << i}, '{r.name}')" for v, p in POLICIES.items() for i, r in enumerate(RULES) if r.name in p.rules)

ABLATIONS = f"""
WITH book AS ({ORACLE}), rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) AS x(policy, mask, bit, rule))
SELECT policy, rule, count(*) FILTER ((failed & mask & bit) <> 0) AS n_failed, count(*) FILTER ((failed & mask) = bit) AS n_failed_alone, count(*) FILTER ((failed & mask) = 0) AS n_kept
FROM book, rules GROUP BY policy, rule
"""
