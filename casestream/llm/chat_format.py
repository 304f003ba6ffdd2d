"""Chat formatting with typed content parts.

A turn's content is a list of parts: text, image, audio or document. A visitor
flattens them in order: text is escaped, an attachment becomes a placeholder
with its number in the conversation, and its reference and expanded token count
are recorded. The template marks turns; control strings inside a text are
escaped, so that no text can open or close a turn, and reading gives them back.

    <|turn|>ROLE<|says|>CONTENT<|done|>

One row of the output is one turn: its formatted text and, within that, the
spans under the loss mask (the text parts of assistant turns). A conversation's
formatted text is its rows' texts in order, so no task ever holds more of a
conversation than a turn, however long the conversation is. Rows go through the
tasks sorted by conversation and turn.

Escaping: & becomes &amp;, < becomes &lt;, [ becomes &lb;. Without < and [, no
<|turn|>, </s> or [INST] is left in a text. Reading undoes it from the last to the first.

Defined cases: a null text is empty, a null role too; null conversation ids
form one conversation; a null turn comes last; rows with equal turns go by
role and text; rows that repeat all of it are turns of their own; an empty table
gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

# The template's marks and the escapes.
OPEN, SAYS, DONE = "<|turn|>", "<|says|>", "<|done|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lb;"))

#: Tokens that an attachment stands for: so many at least, and one for each so many units of its size.
EXPANSION = {"image": (64, 1024), "audio": (16, 640), "document": (8, 4)}

PART = "struct<type:string,text:string,ref:string,size:bigint>"
_TURN = "conv_id bigint, turn bigint, role string, parts array<" + PART + ">"
_OUT = "conv_id bigint, seq bigint, formatted string, spans array<bigint>, refs array<string>, attachment_tokens bigint"
_READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape(text: str) -> str:
    for plain, safe in ESCAPES:
        text = text.replace(plain, safe)
    return text


def unescape(text: str) -> str:
    for plain, safe in reversed(ESCAPES):
        text = text.replace(safe, plain)
    return text


class Flattener:
    """Visits the parts of one turn after the other. Attachments are numbered
    through a conversation; `begin` starts a new one."""

    def begin(self) -> None:
        self.attachments = 0

    def turn(self, role: str, parts: list[dict]) -> tuple[str, list[int], list[str], int]:
        """Formatted text, begins and ends of loss spans in it, references, attachment tokens."""
        self.out, self.spans, self.refs, self.tokens = [OPEN, escape(role), SAYS], [], [], 0
        self.at, self.learn = sum(map(len, self.out)), role == "assistant"
        for part in parts:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)
        self._put(DONE)
        return "".join(self.out), self.spans, self.refs, self.tokens

    def _put(self, text: str) -> None:
        self.out.append(text)
        self.at += len(text)

    def visit_text(self, part: dict) -> None:
        begin = self.at
        self._put(escape(part.get("text") or ""))
        if self.learn and self.at > begin:
            self.spans += [begin, self.at]

    def _attach(self, kind: str, part: dict) -> None:
        least, per = EXPANSION[kind]
        count = max(least, -(-(part.get("size") or 0) // per))
        self.attachments += 1
        self.tokens += count
        self.refs.append(part.get("ref") or "")
        self._put(f"<|{kind}:{self.attachments}:{count}|>")

    def visit_image(self, part: dict) -> None:
        self._attach("image", part)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part)

    def visit_unknown(self, part: dict) -> None:
        """A part of another type keeps its text, if it has one."""
        self.visit_text(part)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    visit, conv, seq, begun = Flattener(), None, 0, False
    for batch in batches:
        rows = []
        for c, role, parts in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "parts")), strict=True):
            if not begun or c != conv:
                begun, conv, seq = True, c, 0
                visit.begin()
            rows.append((c, seq, *visit.turn(role or "", parts or [])))
            seq += 1
        types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64())
        columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _OUT.split(", ")])


_SHAPE = re.compile(re.escape(OPEN) + "([^<]*)" + re.escape(SAYS) + "(.*)" + re.escape(DONE), re.DOTALL)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stay as they are."""
    role, content = _SHAPE.fullmatch(formatted).groups()
    return unescape(role), unescape(content)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = [f.split()[0] for f in _READ.split(", ")]
    conv, begun = None, False

    def row():
        return (conv, turns, said.hexdigest(), loss_chars, loss.hexdigest(), chars)

    for batch in batches:
        done = []
        for c, text, spans in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "spans")), strict=True):
            if not begun or c != conv:
                if begun:
                    done.append(row())
                begun, conv, turns, chars, loss_chars = True, c, 0, 0, 0
                said, loss = hashlib.sha256(), hashlib.sha256()
            role, content = parse_turn(text)
            said.update(f"{role}\n{content}\n".encode())
            turns, chars = turns + 1, chars + len(text)
            for a, b in zip(spans[::2], spans[1::2], strict=True):
                learned = unescape(text[a:b])
                loss.update(learned.encode())
                loss_chars += len(learned)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names)
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), types, strict=True)], names)


def format_turns(turns: DataFrame) -> DataFrame:
    """`turns` has conv_id, turn, role and parts. One row for each turn:
    conv_id, seq (from 0), formatted, spans, refs and attachment_tokens."""
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.col("parts").cast(f"array<{PART}>").alias("parts"))
    dealt = plain.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", F.to_json("parts"))
    return dealt.mapInArrow(_format, _OUT)


def read_back(formatted: DataFrame) -> DataFrame:
    """The digests of each conversation, from its formatted turns."""
    dealt = formatted.select("conv_id", "seq", "formatted", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return dealt.mapInArrow(_read, _READ)


def text_parts(rows: DataFrame) -> DataFrame:
    """Plain rows (conv_id, turn, role, text) as turns of one text part each."""
    part = F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("size"))
    return rows.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `conversations` and conversation -1, written and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(stage(format_turns(text_parts(rows.unionByName(more))), "chat-turns"))
