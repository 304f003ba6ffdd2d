"""Per-document analysis through injected functions, with errors as a column.

An analyzer maps a prompt to a reply, an OCR function bytes to a text; both are
plain Python callables, made once for each partition by a factory, and run in Arrow
batches. No row ever fails a stage: what goes wrong is text in `error`."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, without_fences
from .replies import ReplyStore

# The most characters of a text that are sent, and the texts of errors and prompts.
TEXT_LIMIT = 25_000
NO_TEXT = "Could not extract text from file. It may be empty, corrupted, or an image-based document."
_STRIPPED = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_PERSON = "struct<name:string,oib:string,address:string,role:string>"
PARTIES = f"array<{_PERSON}>"
_RESULT = "struct<case_number:string,decision_date:string,summary:string>"
_REPLY = f"result {_RESULT}, raw_json string, error string"


def prompt(text: Column, participants: Column) -> Column:
    """The request for one document. Participants that are known but none still read as a list."""
    # The wording of the request.
    people = F.when(participants.isNotNull(), F.concat(F.lit("The main participants in this case are: "), pretty_json(participants), F.lit(".")))
    known = F.coalesce(people, F.lit("Participant information was not available from the source page."))
    ask = (
        ' From the court document text below, extract key information as a JSON object with the following keys: "caseNumber", "decisionDate", and "summary" '
        "(a medium-sized paragraph, nicely formatted, to be in Croatian please, as that is what our customers speak).\n"
        "                Do include any important figures (currency amounts) you find in the summary. Provide ONLY the json object and nothing else. Text:\n\n"
    )
    return F.concat(known, F.lit(ask), F.left(text, F.lit(TEXT_LIMIT)))


def _indented(packed: pd.Series) -> pd.Series:
    return packed.map(lambda x: None if x is None else json.dumps(json.loads(x), indent=2, ensure_ascii=False))


def pretty_json(value: Column) -> Column:
    """JSON with an indent of two, byte for byte as usual (Spark's own pretty form differs)."""
    return F.pandas_udf(_indented, "string")(F.to_json(value, {"ignoreNullFields": "false"}))


def strict_reply(reply: str | None) -> dict:
    """Result, raw JSON and error of a reply. Only a whole JSON object passes; of a repeated key the last counts."""
    cleaned = reply or ""

    def refuse(constant: str):
        raise ValueError(f"Unexpected token {constant}")

    if not (cleaned.startswith("{") and cleaned.endswith("}")):
        return {"error": f'AI returned non-JSON response: "{cleaned[:100]}..."'}
    try:
        found = json.loads(cleaned, parse_constant=refuse)
    except ValueError as e:
        return {"error": str(e)}
    say = lambda k: found.get(k) if isinstance(found.get(k), str | None) else json.dumps(found[k], ensure_ascii=False)
    return {"result": {"case_number": say("caseNumber"), "decision_date": say("decisionDate"), "summary": say("summary")}, "raw_json": json.dumps(found, ensure_ascii=False)}


def _frame(rows: list[dict]) -> pd.DataFrame:
    """Rows of `strict_reply` as a frame; missing fields are null."""
    full = [{"result": None, "raw_json": None, "error": None} | x for x in rows]
    frame = pd.DataFrame(full, columns=["result", "raw_json", "error"])
    none = {"case_number": None, "decision_date": None, "summary": None}
    frame["result"] = [x["result"] or none for x in full]
    return frame


def _parsed(cleaned: pd.Series) -> pd.DataFrame:
    return _frame([strict_reply(x) for x in cleaned])


def _parsed_replies(replies: pd.Series) -> pd.DataFrame:
    """As `_answers` reads what a call gives."""
    return _frame([strict_reply(plain(x)) for x in replies])


def parse_reply(reply: Column) -> Column:
    """struct<result, raw_json, error> of a model's reply, fences taken off first."""
    return F.pandas_udf(_parsed, _REPLY)(without_fences(reply))


def calls(make: Callable[[], Callable[[str], str]]):
    """A column function over prompts: `make` runs once for each batch stream. A failing call gives its message in `error`."""

    @F.pandas_udf("reply string, error string")
    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = make()
        for batch in prompts:
            out = []
            for p in batch:
                try:
                    out.append((None, None) if p is None else (call(p), None))
                except Exception as e:  # noqa: BLE001  a row's failure is data
                    out.append((None, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["reply", "error"])

    return run


def _answers(make: Callable[[], Callable[[str], str]]):
    """A column function from prompts to struct<result, raw_json, error>: call and strict reading in one pass."""

    def run(prompts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = make()
        for batch in prompts:
            rows = []
            for p in batch:
                try:
                    rows.append({} if p is None else strict_reply(plain(call(p))))
                except Exception as e:  # noqa: BLE001  a row's failure is data
                    rows.append({"error": str(e) or type(e).__name__})
            yield _frame(rows)

    return F.pandas_udf(run, _REPLY)


def plain(reply: str | None) -> str | None:
    """A reply without fences and outer white space; `without_fences` for one string."""
    return None if reply is None else re.sub("```json\n|```", "", reply).strip(_STRIPPED)


def whole_text(prompt_text: str) -> str:
    """The default analyzer: the text itself as summary, no model at all."""
    text = prompt_text.partition("Text:\n\n")[2]
    return "```json\n" + json.dumps({"caseNumber": None, "decisionDate": None, "summary": text}, ensure_ascii=False) + "\n```"


def default_analyzer() -> Callable[[str], str]:
    return whole_text


def analyze(files: DataFrame, make: Callable[[], Callable[[str], str]] = default_analyzer, store: ReplyStore | None = None, run: str | None = None) -> DataFrame:
    """`files` (text, participants, ...) with ai_result, raw_json and error. Parties
    come from the entry, whatever the model says of them; blank texts aren't sent. With a `store` of replies equal
    prompts are asked once over all its runs, and what is read is what it holds; without one, each row is asked where it is read."""
    asked = files.withColumn("__asked", F.when(~is_blank("text"), prompt(F.col("text"), F.col("participants").cast(PARTIES))))
    if store is None:
        read = asked.withColumn("__read", _answers(make)("__asked"))
    else:
        own = [c for c in asked.columns if c != "__asked"]
        told = store.ask(asked.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("__row"), "__asked"), "__asked", make, run)
        said = told.withColumn("__parsed", F.pandas_udf(_parsed_replies, _REPLY)("reply"))
        failed = F.struct(F.lit(None).cast(_RESULT).alias("result"), F.lit(None).cast("string").alias("raw_json"), F.col("error").alias("error"))
        read = said.select("__row.*", "__asked", F.when(F.col("error").isNotNull(), failed).otherwise(F.col("__parsed")).alias("__read"))
    error = F.when(F.col("__asked").isNull(), F.lit(NO_TEXT)).otherwise(F.col("__read.error"))
    parties = F.coalesce(F.col("participants").cast(PARTIES), F.array().cast(PARTIES))
    done = read.withColumn("error", error)
    result = F.when(F.col("error").isNull(), F.col("__read.result").withField("parties", parties))
    return done.withColumn("ai_result", result).withColumn("raw_json", F.when(F.col("error").isNull(), F.col("__read.raw_json"))).drop("__asked", "__read")


def status(has_documents: Column, error: Column) -> Column:
    return F.when(~F.coalesce(has_documents, F.lit(False)), F.lit("no_documents")).when(error.isNotNull(), F.lit("analysis_failed")).otherwise(F.lit("analyzed"))
