"""Files as rows: admission of uploads, archives to documents, text by suffix with OCR as
last resort, downloads through an injected function. Bytes stay in the row they belong to,
are never shuffled, and a file that can't be read is a row with an error."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank

# What may be uploaded.
UPLOAD_MIME = ("application/pdf", "image/jpeg", "image/png", "image/gif", "image/webp")
UPLOAD_BYTES = 2 * 1024 * 1024
#: Bytes of entries that leave a task at once, but for one larger entry.
MOST_BYTES = 16 << 20
_PARAGRAPH = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, length and content of the files under `path`."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length", "content")


def admitted(files: DataFrame, mime: str = "mime", length: str = "length", most: int = UPLOAD_BYTES) -> DataFrame:
    """Uploads of an allowed kind and size."""
    return files.where(F.col(mime).isin(*UPLOAD_MIME) & (F.col(length) <= most))


# -- archives --------------------------------------------------------------

#: One entry of an archive's directory: where its packed bytes are, and what they must give.
_MEMBER = "struct<name:string,folder:boolean,method:int,locked:boolean,at:bigint,packed:bigint,size:bigint,crc:bigint>"


def _members(content: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        found = z.infolist()
    out = []
    for e in found:
        # The local header repeats the name, with extra fields of its own; the packed bytes follow.
        name, extra = struct.unpack_from("<HH", content, e.header_offset + 26)
        out.append({"name": e.filename, "folder": e.is_dir(), "method": e.compress_type, "locked": bool(e.flag_bits & 1), "at": e.header_offset + 30 + name + extra, "packed": e.compress_size, "size": e.file_size, "crc": e.CRC})
    return out


def _directories(contents: pd.Series) -> pd.DataFrame:
    out = []
    for c in contents:
        try:
            out.append((None if c is None else _members(c), None if c is not None else "no content"))
        except Exception as x:  # noqa: BLE001  a file that is no archive is data
            out.append((None, str(x) or type(x).__name__))
    return pd.DataFrame(out, columns=["members", "error"])


def directory(content: Column) -> Column:
    """struct<members, error> of an archive's bytes; its entries' bytes aren't unpacked."""
    return F.pandas_udf(_directories, f"members array<{_MEMBER}>, error string")(content)


def archive_listing(files: DataFrame) -> DataFrame:
    """path, status, extracted_files (all entries, folders too) and error_message of each file, read as an archive."""
    read = files.select("path", directory(F.col("content")).alias("d"))
    status = F.when(F.col("d.error").isNull(), "success").otherwise("error")
    return read.select("path", status.alias("status"), F.transform("d.members", lambda m: m["name"]).alias("extracted_files"), F.col("d.error").alias("error_message"))


def _inflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unpacks the deflated `content` that has no error; what fails is null with an error. Rows leave by MOST_BYTES."""
    for batch in batches:
        heads = [c for c in batch.schema.names if c not in ("content", "error")]
        contents, errors = batch.column("content"), batch.column("error").to_pylist()
        packed = [m == 8 and e is None for m, e in zip(batch.column("method").to_pylist(), errors, strict=True)]
        rows, found, held = [], [], 0

        def flush():
            kept = batch.select(heads).take(pa.array(rows))
            return pa.RecordBatch.from_arrays([*kept.columns, pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], [*heads, "content", "error"])

        for i in range(batch.num_rows):
            content, error = contents[i].as_py() if errors[i] is None else None, errors[i]
            if packed[i]:
                try:
                    content = zlib.decompress(content, -15)
                except Exception as x:  # noqa: BLE001  one entry's failure is its own
                    content, error = None, str(x) or type(x).__name__
            rows.append(i)
            found.append((content, error))
            held += len(content or b"")
            if held >= MOST_BYTES:
                yield flush()
                rows, found, held = [], [], 0
        if rows:
            yield flush()


def expand_archives(files: DataFrame, path: str = "path", keep: list[str] | None = None, spread: int | None = None) -> DataFrame:
    """One row for each document: entries of archives (suffix .zip in any case) that aren't folders, other files as
    they are. Adds entry_pos, entry_name, and error; `content` is the document's. An archive's directory is read first and its packed
    entries, cut out of its bytes, become rows; each is then unpacked by itself and held against its size and checksum. With
    `spread` that happens in so many tasks, whichever archive the entries are from."""
    keep = keep or []
    is_zip = F.lower(F.col(path)).endswith(".zip")
    read = files.select(path, *keep, "content", is_zip.alias("zip"), directory(F.when(is_zip, F.col("content"))).alias("d"))

    def entry(name: Column, content: Column, error: Column, *checks: Column) -> Column:
        return F.struct(name.cast("string").alias("entry_name"), content.cast("binary").alias("content"), error.cast("string").alias("error"), *[c.cast("bigint").alias(k) for k, c in zip(("method", "size", "crc"), checks, strict=True)])

    def member(m: Column) -> Column:
        refused = F.when(m["locked"], F.lit("the entry is encrypted")).when(~m["method"].isin(0, 8), F.concat(F.lit("compression method "), m["method"], F.lit(" isn't supported")))
        packed = F.substring(F.col("content"), (m["at"] + 1).cast("int"), m["packed"].cast("int"))
        return entry(m["name"], F.when(refused.isNull(), packed), refused, m["method"], m["size"], m["crc"])

    none = F.lit(None)
    inside = F.transform(F.filter("d.members", lambda m: ~m["folder"]), member)
    broken = F.array(entry(none, none, F.col("d.error"), none, none, none))
    plain = F.array(entry(F.regexp_replace(path, "^.*/", ""), F.col("content"), none, none, none, none))
    entries = F.when(~F.col("zip"), plain).when(F.col("d.error").isNull(), inside).otherwise(broken)
    packed = read.select(path, *keep, F.posexplode(entries).alias("entry_pos", "e")).select(path, *keep, "entry_pos", "e.entry_name", "e.method", "e.size", "e.crc", "e.content", "e.error")
    packed = packed.repartition(spread, path, "entry_pos") if spread else packed
    whole = packed.mapInArrow(_inflate, packed.schema)
    wrong = F.col("error").isNull() & ((F.octet_length("content") != F.col("size")) | (F.crc32("content") != F.col("crc")))
    whole = whole.withColumn("error", F.when(wrong, F.concat(F.lit("Bad CRC-32 for file "), "entry_name")).otherwise(F.col("error")))
    return whole.select(path, *keep, "entry_pos", "entry_name", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error")


# -- texts -----------------------------------------------------------------


def docx_text(content: bytes) -> str:
    """The paragraphs of a Word document, each followed by an empty line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ("".join(t.text or "" for t in p.iter(f"{_PARAGRAPH}t")) for p in body.iter(f"{_PARAGRAPH}p"))
    return "".join(f"{line}\n\n" for line in lines)


def _no_pdf(content: bytes) -> str:
    """No PDF reader here: such files go on to OCR."""
    return ""


def _no_ocr(content: bytes) -> list[str]:
    return []


def _read_by(read: Callable[[bytes], object], kind: str):
    """A column function over bytes; null stays null, and what can't be read is null."""

    def run(contents: pd.Series) -> pd.Series:
        out = []
        for c in contents:
            try:
                out.append(None if c is None else read(c))
            except Exception:  # noqa: BLE001  unreadable is the same as empty
                out.append(None)
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, kind)


def extract_text(documents: DataFrame, pdf: Callable[[bytes], str] = _no_pdf, ocr: Callable[[bytes], list[str]] = _no_ocr, name: str = "entry_name") -> DataFrame:
    """`documents` with text by suffix, in small letters only; '' for others and on any failure; the bytes go. If it is
    blank and the suffix is .pdf in any case, the pages that OCR reads, each followed by an empty line. Each reader gets
    the bytes of its own kind only, OCR those of which the first reading was blank; plain text isn't read in Python at all."""
    named = F.coalesce(F.col(name), F.lit(""))
    of = lambda suffix: F.when(named.endswith(suffix), F.col("content"))
    plain = F.make_valid_utf8(of(".txt").cast("string"))
    first = documents.withColumn("text", F.coalesce(plain, _read_by(pdf, "string")(of(".pdf")), _read_by(docx_text, "string")(of(".docx")), F.lit("")))
    blank = is_blank("text") & F.lower(named).endswith(".pdf")
    scanned = first.withColumn("__pages", _read_by(ocr, "array<string>")(F.when(blank, F.coalesce("content", F.lit(b"")))))
    pages = F.array_join(F.transform("__pages", lambda p: F.concat(p, F.lit("\n\n"))), "")
    return scanned.withColumn("text", F.when(blank, F.coalesce(pages, F.lit(""))).otherwise(F.col("text"))).drop("content", "__pages")


def download(links: DataFrame, fetch: Callable[[str], tuple[bytes, dict[str, str]]], url: str = "url") -> DataFrame:
    """`links` with content, disposition, mime and error from an injected fetch; a failed one keeps its row."""

    @F.pandas_udf("content binary, disposition string, mime string, error string")
    def get(urls: pd.Series) -> pd.DataFrame:
        out = []
        for u in urls:
            try:
                content, headers = fetch(u)
                out.append((content, headers.get("content-disposition"), headers.get("content-type"), None))
            except Exception as x:  # noqa: BLE001
                out.append((None, None, None, str(x) or type(x).__name__))
        return pd.DataFrame(out, columns=["content", "disposition", "mime", "error"])

    return links.withColumn("__got", get(url)).select(*links.columns, "__got.*")


def write_files(files: DataFrame, path: str) -> None:
    """Write downloads (file_name, content), a row for each, so that a reader takes them by name; a job's
    folder holds them until it is deleted as a whole."""
    files.select("file_name", "content").write.mode("overwrite").parquet(path)


def unreadable(documents: DataFrame) -> DataFrame:
    """Dead letters: documents without text."""
    return documents.where(is_blank("text"))
