"""Fill-in-middle transformation by escaped marker injection. DataFrame and SQL functions only.

A text's units are runs of letters A-Z and a-z, and single other characters. The delimiter
is escaped in the text; then `regexp_replace` appends one after each unit, their number is the number of units, and
`substring_index` takes the first, the middle and the last so many units, which are
unescaped and assembled around the markers.

Two cuts, the form and the order of a row come from the hex sha256 of `<seed>:<doc_id>`,
in groups of eight digits, so reruns agree wherever a row is processed.

Defined cases: a null text is empty; an empty text, and one that holds a marker, stay plain;
a null doc_id is hashed as an empty string; rows that repeat a doc_id are cut by the same
hash, each in its own text; a text may be of any length (a row is worked on by itself); an
empty table gives no rows; all columns of the input are handed on in the struct `row`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_DELIMITER, _ESCAPE = "\x01", "\x02"
#: A unit of an escaped text: an escaped character counts as the one that it stands for.
_UNIT = rf"[A-Za-z]+|{_ESCAPE}[01]|[^A-Za-z]"


def _replaced(value: Column, old: str, new: str) -> Column:
    return F.replace(value, F.lit(old), F.lit(new))


def _marked(text: Column) -> Column:
    """The escaped text with a delimiter after each unit."""
    escaped = _replaced(_replaced(text, _ESCAPE, f"{_ESCAPE}1"), _DELIMITER, f"{_ESCAPE}0")
    return F.regexp_replace(escaped, _UNIT, f"$0{_DELIMITER}")


def _plain(part: Column) -> Column:
    """A part of a marked text without delimiters, unescaped."""
    return _replaced(_replaced(_replaced(part, _DELIMITER, ""), f"{_ESCAPE}0", _DELIMITER), f"{_ESCAPE}1", _ESCAPE)


def _part(column: str, count: str) -> Column:
    """`substring_index` with a count from a column."""
    return F.expr(f"substring_index({column}, '\\u0001', {count})")


def _number(digest: str, group: int) -> Column:
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: str = "1", plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """(row, n, form, prefix, middle, suffix, output): each row of `docs` (doc_id, text, ...) with its number of
    units, its form plain, psm or spm, the three parts (null if plain) and the transformed text."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))), 256)
    rows = rows.select("row", digest.alias("digest"), F.coalesce("row.text", F.lit("")).alias("whole"))
    rows = rows.select("*", _marked(F.col("whole")).alias("marked"))
    n = F.length("marked") - F.length(_replaced(F.col("marked"), _DELIMITER, ""))
    rows = rows.select("*", n.cast("long").alias("n"))
    cuts = [_number("digest", k) % (F.col("n") + 1) for k in (0, 1)]
    rows = rows.select("*", F.least(*cuts).cast("int").alias("low"), F.greatest(*cuts).cast("int").alias("high"))

    held = F.lit(False)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains("whole", F.lit(marker))
    is_plain = (F.col("whole") == "") | held | (_number("digest", 2) % 100 >= 100 - plain_percent)
    form = F.when(is_plain, "plain").when(_number("digest", 3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("*", form.alias("form"))

    def cut(part: Column) -> Column:
        return F.when(F.col("form") != "plain", _plain(part))

    # A delimiter stands after the last unit too: counted from the end, the last piece is an empty one.
    parts = rows.select(
        "row", "n", "form", "whole",
        cut(_part("marked", "low")).alias("prefix"),
        cut(_part("substring_index(marked, '\\u0001', high)", "low - high")).alias("middle"),
        cut(_part("marked", "cast(high - n - 1 as int)")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("whole"))
    return parts.select("row", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The exact text, from output and form alone: no part holds a marker, so each stands once."""

    def between(first: str, then: str) -> Column:
        return F.substring_index(F.substring_index(output, first, -1), then, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole `documents` table: form, lengths of the parts, and the digests of the output and of the text restored from it."""
    out = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    back = restore(F.col("output"), F.col("form"))
    chars = [F.length(c).cast("long").alias(f"{c}_chars") for c in ("prefix", "middle")]
    digests = [F.sha2(F.encode(x, "UTF-8"), 256).alias(name) for x, name in ((F.col("output"), "output_sha256"), (back, "restored_sha256"))]
    return out.select("row.doc_id", "n", "form", *chars, *digests)


ORACLE = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u
  FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(u) + 1) AS b,
             CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 AS s FROM t),
f AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form,
         array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(u[greatest(a, b) + 1:], '') AS x
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m WHEN 'spm' THEN '<S>' || x || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM f
"""
