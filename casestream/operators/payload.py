"""Result shapes: nested payload, progress events, exports and outgoing mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import export_name, or_else, truthy

CASE_FIELDS = ("title", "case_number", "court", "date", "detail_link", "participants")


def nested_payload(files: DataFrame, synthesis: DataFrame, term: str = "search_term") -> DataFrame:
    """One row for each term: processed_cases, in order, and comparative_analysis.
    An entry without files has empty arrays. `files` has the entry's fields, case_pos,
    doc_pos, url, text, ai_result and error."""
    there = F.col("doc_pos").isNotNull()
    link = F.when(there, F.struct("doc_pos", "url", "text"))
    done = F.when(there, F.struct("doc_pos", F.col("text").alias("fileName"), F.col("ai_result").alias("aiResult"), "error"))
    by_entry = files.groupBy(term, "case_pos").agg(
        F.first(F.struct(*CASE_FIELDS)).alias("caseResult"),
        F.array_sort(F.collect_list(link)).alias("files"),
        F.array_sort(F.collect_list(done)).alias("analyses"),
    )
    entry = F.struct(
        "case_pos",
        "caseResult",
        F.transform("files", lambda f: F.struct(f["url"].alias("url"), f["text"].alias("text"))).alias("files"),
        F.struct(F.transform("analyses", lambda a: F.struct(a["fileName"].alias("fileName"), a["aiResult"].alias("aiResult"), a["error"].alias("error"))).alias("individualAnalyses")).alias("analysis"),
    )
    cases = by_entry.groupBy(term).agg(F.array_sort(F.collect_list(entry)).alias("__cases"))
    slim = F.transform("__cases", lambda c: F.struct(c["caseResult"].alias("caseResult"), c["files"].alias("files"), c["analysis"].alias("analysis")))
    return cases.join(synthesis, term, "left").select(term, slim.alias("processed_cases"), F.col("context").alias("comparative_analysis"))


def progress_events(entries: DataFrame, term: str = "search_term") -> DataFrame:
    """The events of a successful run for each term, by seq: step, progress and message.
    `entries` has case_pos (from 1), title and n_docs."""
    n = F.count(F.lit(1)).over(Window.partitionBy(term))
    cases = entries.select(term, "case_pos", "title", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), n.alias("n"))
    # The steps, their progress and the wording of the messages, here and in `error_events`.
    event = lambda step, progress, message: F.struct(F.lit(step).alias("step"), progress.cast("double").alias("progress"), message.alias("message"))
    none, say = F.lit(None), lambda *x: F.concat(*[v if isinstance(v, Column) else F.lit(v) for v in x])
    at = F.col("case_pos").cast("string")
    per_case = F.array(
        event("processing_case", 25 + (F.col("case_pos") - 1) / F.col("n") * 50, say("Obrađujem objavu ", at, " od ", F.col("n").cast("string"), ": ", F.coalesce("title", F.lit("undefined")))),
        event("downloading", none, say("Preuzimam arhivu za objavu ", at, "...")),
        event("unzipping", none, say("Raspakiram datoteke za objavu ", at, "...")),
        event("analyzing", none, say("Analiziram ", F.col("n_docs").cast("string"), " datoteka za objavu ", at, "...")),
    )
    shown = F.when(F.col("n_docs") > 0, per_case).otherwise(F.slice(per_case, 1, 3))
    middle = cases.select(term, "n", F.posexplode(shown).alias("k", "e"), "case_pos").select(term, (F.col("case_pos") * 4 + F.col("k")).alias("place"), "e")
    once = cases.select(term, "n").distinct()
    before = F.array(event("starting", F.lit(5), F.lit("Vaš zahtjev je započeo s obradom...")), event("scraping", F.lit(10), F.lit("Pretražujem sudske zapise za nedavne objave...")), event("processing_setup", F.lit(20), say("Pronađeno ", F.col("n").cast("string"), " objava za analizu.")))
    done = F.lit("Analiza je završena!")
    after = F.array(event("comparing", F.lit(85), F.lit("Generiram usporednu analizu i zaključak...")), event("complete", F.lit(100), done), event("complete", F.lit(100), done))
    first = once.select(term, F.posexplode(before).alias("k", "e")).select(term, (F.col("k") - 10).alias("place"), "e")
    last = once.select(term, "n", F.posexplode(after).alias("k", "e")).select(term, (F.col("n") * 4 + 10 + F.col("k")).alias("place"), "e")
    all_events = first.unionByName(middle).unionByName(last)
    seq = F.row_number().over(Window.partitionBy(term).orderBy("place"))
    return all_events.select(term, seq.alias("seq"), "e.step", "e.progress", "e.message")


def error_events(failed: DataFrame, term: str = "search_term", default: str = "Došlo je do greške u obradi.") -> DataFrame:
    """The events of a run that ends early, in the same columns: `failed` has the term, `message` (null:
    the default) and `begun`, whether the search had begun. The pipeline and the server both report an error."""
    event = lambda step, progress, message: F.struct(F.lit(step).alias("step"), F.lit(float(progress)).alias("progress"), message.alias("message"))
    said = or_else("message", default)
    start = event("starting", 5, F.lit("Vaš zahtjev je započeo s obradom..."))
    scraping = event("scraping", 10, F.lit("Pretražujem sudske zapise za nedavne objave..."))
    wrong = [event("error", 100, said)]
    events = F.when(F.col("begun"), F.array(start, scraping, *wrong * 2)).otherwise(F.array(start, *wrong))
    return failed.select(term, F.posexplode(events).alias("k", "e")).select(term, (F.col("k") + 1).alias("seq"), "e.step", "e.progress", "e.message")


def download_progress(files: DataFrame, case: list[str], position: str) -> DataFrame:
    """Each downloaded file's progress from 50 to 80."""
    done = F.count(F.lit(1)).over(Window.partitionBy(*case).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.count(F.lit(1)).over(Window.partitionBy(*case))
    return files.withColumn("progress", 50 + F.floor(done / total * 30 + 0.5))


def markdown_export(files: DataFrame) -> DataFrame:
    """An outbox of one file for each analysis: file_name and content. `doc_pos` counts from 0."""
    # The names and headings of exports, here and in `comparison_export`.
    name = or_else("text", F.concat(F.lit("Document_"), (F.col("doc_pos") + 1).cast("string")))
    content = F.concat(F.lit("# "), name, F.lit("\n\n"), or_else("summary", "No analysis available"))
    return files.withColumns({"file_name": export_name(name), "content": content})


def comparison_export(synthesis: DataFrame, number: str = "case_number", text: str = "context") -> DataFrame:
    name = F.when(truthy(number), F.concat(F.lit("Usporedna_Analiza_"), F.col(number))).otherwise(F.lit("Usporedna_Analiza"))
    return synthesis.withColumns({"file_name": export_name(name), "content": F.concat(F.lit("# Usporedna Analiza i Zaključak\n\n"), F.col(text))})


def write_exports(exports: DataFrame, path: str) -> None:
    """Write an outbox as JSON lines; whoever delivers the files reads them there."""
    exports.select("file_name", "content").write.mode("overwrite").json(path)


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def mail_outbox(changes: DataFrame, base_url: str = "", escape: bool = False) -> DataFrame:
    """subscription_id, identifier, recipient, subject and body of each notice. The pair of
    the first two is the delivery's key, so that a repeated run sends nothing twice."""
    text = lambda c: (_escaped if escape else lambda x: x)(F.coalesce(F.col(c).cast("string"), F.lit("undefined")))
    line = lambda label, c: F.concat(F.lit(f"<p><strong>{label}:</strong> "), text(c), F.lit("</p>\n"))
    # The wording of the mail and its subject.
    body = F.concat(
        F.lit("<h1>Pronađena je nova sudska objava!</h1>\n<p>Pronašli smo novu objavu za pojam koji pratite: <strong>"),
        text("search_term"),
        F.lit("</strong></p>\n<hr>\n<h2>Detalji objave:</h2>\n"),
        line("Naziv", "title"),
        line("Broj predmeta", "case_number"),
        line("Sud", "court"),
        line("Datum objave", "date"),
        F.lit("<hr>\n<h2>AI Analiza:</h2>\n<div>"),
        text("analysis"),
        F.lit("</div>\n<p><a href=\""),
        text("detail_link"),
        F.lit("\">Pogledajte originalnu objavu</a></p>\n<hr>\n<p>Ne želite više primati ove obavijesti? <a href=\""),
        F.concat(F.lit(f"{base_url}/api/unsubscribe/"), F.coalesce(F.col("unsubscribe_token"), F.lit("undefined"))),
        F.lit("\">Odjavite se</a>.</p>\n"),
    )
    subject = F.concat(F.lit("Nova objava za Vašu pretragu: "), F.col("search_term"))
    return changes.select(F.col("id").alias("subscription_id"), "identifier", F.col("email").alias("recipient"), subject.alias("subject"), body.alias("body"))


def document_summary(entries: DataFrame) -> DataFrame:
    """summary, document_count and documents (name, url) from document_links."""
    documents = F.transform("document_links", lambda d: F.struct(d["text"].alias("name"), d["url"].alias("url")))
    return entries.withColumns({"summary": F.lit("Document analysis would go here"), "document_count": F.size("document_links"), "documents": documents})


def display(entries: DataFrame, columns: list[str]) -> DataFrame:
    """Fields for display: N/A for what is missing."""
    return entries.withColumns({c: or_else(c, "N/A") for c in columns})
