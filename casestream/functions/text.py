"""Column helpers for text rules that differ from SQL's: white space beyond the
space, empty strings that count as missing, first-only replacement, file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as white space for trimming, and file types by MIME type.
WHITE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
MIME_EXTENSION = {
    "application/pdf": "pdf",
    "application/zip": "zip",
    "application/json": "json",
    "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/octet-stream": "bin",
    "image/png": "png",
    "image/jpeg": "jpg",
    "image/gif": "gif",
    "image/webp": "webp",
    "text/plain": "txt",
    "text/html": "html",
    "text/css": "css",
    "text/csv": "csv",
}


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trimmed(x: Column | str) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(_col(x), f"^[{WHITE}]+", ""), f"[{WHITE}]+$", "")


def is_blank(x: Column | str) -> Column:
    """Null, empty or white space only."""
    return F.coalesce(trimmed(x), F.lit("")) == ""


def truthy(x: Column | str) -> Column:
    """Neither null nor empty; never null itself."""
    return F.coalesce(_col(x) != "", F.lit(False))


def or_else(x: Column | str, other: Column | str) -> Column:
    """x unless it is null or empty."""
    return F.coalesce(F.nullif(_col(x), F.lit("")), other if isinstance(other, Column) else F.lit(other))


def without_fences(x: Column | str) -> Column:
    """Text without code fences, trimmed."""
    return trimmed(F.regexp_replace(_col(x), "```json\n|```", ""))


def one_space(x: Column | str) -> Column:
    return F.regexp_replace(trimmed(x), f"[{WHITE}]+", " ")


def without_first(x: Column | str, part: str) -> Column:
    """Text without the first occurrence of `part`."""
    return F.array_join(F.split(_col(x), rf"\Q{part}\E", 2), "")


def download_name(x: Column | str) -> Column:
    """A file name from a link's text: at most 40 safe characters."""
    return F.left(F.regexp_replace(or_else(x, "document"), "[^a-zA-Z0-9_-]", "_"), F.lit(40))


def export_name(x: Column | str) -> Column:
    return F.concat(F.regexp_replace(_col(x), "[^a-zA-Z0-9]", "_"), F.lit(".md"))


def extension(name: Column | str) -> Column:
    """The last dot and what follows in the last part of a path; '' for none and for names that begin with their only dot."""
    last = F.regexp_replace(_col(name), "^.*/", "")
    return F.regexp_extract(last, r"^.*[^/](\.[^./]*)$", 1)


def percent_decoded(x: Column | str) -> Column:
    """Percent-decoding that keeps plus signs; null where an escape is bad."""
    return F.try_url_decode(F.replace(_col(x), F.lit("+"), F.lit("%2B")))


def extension_of_download(disposition: Column | str, mime: Column | str, link_text: Column | str) -> Column:
    """An extension from the server's file name, else its MIME type unless that is
    generic, else from the word zip in the link's text, else .bin. Null where the
    server's file name can't be decoded: such a download fails."""
    named = F.regexp_extract(_col(disposition), r"filename\*?=(?:UTF-8'')?([^;]+)", 1)
    plain = percent_decoded(F.replace(named, F.lit('"'), F.lit("")))
    by_name = F.nullif(extension(plain), F.lit(""))
    kinds = F.create_map(*[F.lit(v) for kv in MIME_EXTENSION.items() for v in kv])
    kind = kinds[F.trim(F.split_part(F.lower(_col(mime)), F.lit(";"), F.lit(1)))]
    by_kind = F.when(kind != "bin", F.concat(F.lit("."), kind))
    by_text = F.when(F.contains(F.lower(_col(link_text)), F.lit("zip")), F.lit(".zip"))
    bad = truthy(named) & plain.isNull()
    return F.when(~bad, F.coalesce(by_name, by_kind, by_text, F.lit(".bin")))


def text_size(x: Column | str) -> Column:
    """16 to 18; 16 for what isn't a number."""
    return F.least(F.greatest(F.coalesce(_col(x).try_cast("int"), F.lit(16)), F.lit(16)), F.lit(18))


def identifier(number: Column | str, date: Column | str) -> Column:
    """The identifier of an entry; a missing part reads null."""
    return F.concat(F.coalesce(_col(number).cast("string"), F.lit("null")), F.lit(" - "), F.coalesce(_col(date).cast("string"), F.lit("null")))


def ordered_text(value: Column, order: Column, separator: str) -> Column:
    """Aggregate: the non-null values in `order`, joined."""
    rows = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))))
    return F.array_join(F.transform(rows, lambda r: r["v"]), separator)


def is_search_term(x: Column | str, least: int = 8) -> Column:
    """Whether a term has enough characters, outer white space aside."""
    return F.coalesce(F.length(trimmed(x)) >= least, F.lit(False))


def iso_time(ts: Column | str) -> Column:
    """A time in UTC as ISO text with milliseconds."""
    return F.date_format(F.to_utc_timestamp(_col(ts).cast("timestamp"), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def data_url(content: Column | str, mime: str) -> Column:
    """Bytes as a data URL, as a request carries them inline."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.regexp_replace(F.base64(_col(content)), "\\s", ""))
