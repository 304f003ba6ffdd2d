"""DuckDB SQL with the results of the library's queries."""

from __future__ import annotations

_ENTRIES = """
e AS (SELECT source AS search_term, doc_id, lang, text,
             row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS pos FROM documents)"""


def _case_rows(n: int) -> str:
    return f"""{_ENTRIES},
t AS (SELECT e.search_term, e.pos, e.doc_id, 'Document ' || e.doc_id AS title, e.lang AS date,
             nullif(CASE WHEN l.doc_id IS NOT NULL THEN e.text END, '') AS summary
      FROM e LEFT JOIN labels l ON l.doc_id = e.doc_id WHERE e.pos <= {n})"""


# The wording of texts and prompts here and below.
_NO = "Analiza dokumenata nije uspješno izvršena za jedinu pronađenu objavu."


def _terms(per_case: str) -> str:
    """Context by term out of rows (search_term, case_pos, title, date, n_docs, lines, single)."""
    return f"""
b AS (SELECT search_term, case_pos, n_docs, single,
             '--- Case Entry ' || case_pos || ' ---' || chr(10) || 'Title: ' || coalesce(title, 'undefined') || chr(10) || 'Date: ' ||
             coalesce(date, 'undefined') || chr(10) || 'Summary of Documents:' || chr(10) || coalesce(lines, '') || chr(10) || chr(10) AS block
      FROM ({per_case})),
d AS (SELECT search_term, count(*) AS n_cases, CAST(sum(n_docs) AS BIGINT) AS n_docs,
             CASE WHEN count(*) = 1 THEN coalesce(nullif(any_value(single), ''), '{_NO}')
                  ELSE string_agg(block, '' ORDER BY case_pos) END AS context
      FROM b GROUP BY search_term)"""


_TWO = "SELECT search_term, pos AS case_pos, title, date, 1 AS n_docs, summary AS lines, summary AS single FROM t"
_SINGLE = """SELECT search_term, 1 AS case_pos, any_value(title) AS title, any_value(date) AS date, count(*) AS n_docs,
  string_agg(summary, chr(10) ORDER BY pos) AS lines, string_agg(summary, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS single
  FROM t GROUP BY search_term"""

_DIGEST = f"WITH {_case_rows(2)}, {_terms(_TWO)} SELECT * FROM d"
_ONE_CASE = f"WITH {_case_rows(3)}, {_terms(_SINGLE)} SELECT * FROM d"

_SUBS = "subs AS (SELECT c_custkey AS id, c_name AS email, c_mktsegment AS search_term, c_acctbal > 0 AS is_active, md5(c_name) AS token FROM customer)"
_REQUESTS = f"""{_SUBS},
r AS (SELECT o_orderkey AS request_no, email,
             CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN search_term ELSE o_orderpriority END AS search_term
      FROM orders JOIN subs ON o_custkey = id),
j AS (SELECT r.*, row_number() OVER (PARTITION BY r.email, r.search_term ORDER BY request_no) = 1
             AND NOT EXISTS (SELECT 1 FROM subs s WHERE s.email = r.email AND s.search_term = r.search_term) AS fresh
      FROM r WHERE search_term <> '')"""

_FOLLOW = f"""{_SUBS},
latest AS (SELECT CAST(o_custkey AS VARCHAR) AS search_term, CAST(o_orderkey AS VARCHAR) AS case_number, strftime(o_orderdate, '%Y-%m-%d') AS date, o_orderpriority AS title
           FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1),
f AS (SELECT id, email, CAST(id AS VARCHAR) AS search_term, is_active, token, case_number, date, title, case_number || ' - ' || date AS identifier,
             CASE id % 3 WHEN 1 THEN case_number || ' - ' || date WHEN 2 THEN 'old' END AS last_seen
      FROM subs LEFT JOIN latest ON latest.search_term = CAST(id AS VARCHAR)),
due AS (SELECT * FROM f WHERE is_active AND identifier IS NOT NULL AND identifier IS DISTINCT FROM last_seen)"""

_SYSTEM = (
    "You are a helpful legal assistant that excels at being factual, while also being kind and formal. "
    "Depending on the user inquiry, you can be informative beyond the immediate question. "
    "You frequently work with the elderly in need of free legal advice. "
    "You only provide answers in Croatian."
)

_BUCKET = """
WITH RECURSIVE ev AS (
  SELECT event_id, user_id, epoch_us(ts) // 1000 AS now, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
f AS (
  SELECT event_id, user_id, n, true AS allowed, 'ok' AS reason, CAST(NULL AS BIGINT) AS retry_after_ms, 4 AS h, now AS hl, 2 AS s, now AS sl FROM ev WHERE n = 1
  UNION ALL
  SELECT event_id, user_id, n, h2 > 0 AND s2 > 0, CASE WHEN h2 <= 0 THEN 'hour' WHEN s2 <= 0 THEN '5s' ELSE 'ok' END,
         CASE WHEN h2 <= 0 THEN 144000000 - (now - hl) WHEN s2 <= 0 THEN 43200000 - (now - sl) END,
         CASE WHEN h2 > 0 AND s2 > 0 THEN h2 - 1 ELSE h2 END, CASE WHEN h2 > 0 AND s2 > 0 THEN now ELSE hl END,
         CASE WHEN h2 > 0 AND s2 > 0 THEN s2 - 1 ELSE s2 END, CASE WHEN h2 > 0 AND s2 > 0 THEN now ELSE sl END
  FROM (SELECT ev.event_id, ev.user_id, ev.n, ev.now, f.hl, f.sl,
               CAST(least(5, f.h + (ev.now - f.hl) // 28800000) AS INTEGER) AS h2, CAST(least(3, f.s + (ev.now - f.sl) // 14400000) AS INTEGER) AS s2
        FROM f JOIN ev ON ev.user_id = f.user_id AND ev.n = f.n + 1))
SELECT event_id, user_id, allowed, reason, CAST(retry_after_ms AS BIGINT) AS retry_after_ms FROM f
"""

_FRAMES = """
rows AS (SELECT conv_id, turn, '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '}' AS payload FROM conversations)"""

ORACLES = {
    "digest_latest_two": _DIGEST,
    "single_case_summary": _ONE_CASE,
    "latest_n_with_documents": """
SELECT source AS search_term, CAST(case_pos AS INTEGER) AS case_pos, doc_id, quality
FROM (SELECT source, d.doc_id, quality, row_number() OVER (PARTITION BY source ORDER BY d.doc_id DESC) AS case_pos FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
WHERE case_pos <= 3""",
    "first_with_documents": """
SELECT source AS search_term, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source""",
    "latest_per_case": """
WITH o AS (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey || '/' || o_orderpriority ELSE '' END AS case_number,
                  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS title FROM orders),
k AS (SELECT *, coalesce(nullif(case_number, ''), title) AS c FROM o)
SELECT o_orderkey, case_number, title FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM k WHERE c IS NOT NULL) WHERE n = 1""",
    "status_annotation": """
SELECT d.doc_id, CASE WHEN n_chars < 300 THEN 'no_documents' WHEN quality IS NULL THEN 'analysis_failed' ELSE 'analyzed' END AS status
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "case_counts": """
SELECT source AS search_term, count(*) AS n_results, CAST(count(DISTINCT lang) AS INTEGER) AS document_count,
       string_agg(DISTINCT lang || '=file:' || lang, ';' ORDER BY lang || '=file:' || lang) AS documents
FROM documents GROUP BY source""",
    "comparative_context": f"""
WITH t AS (SELECT * FROM (SELECT source AS search_term, d.doc_id, d.doc_id // 20 AS entry, dense_rank() OVER (PARTITION BY source ORDER BY d.doc_id // 20 DESC) AS case_pos,
                  nullif(CASE WHEN quality = 1 THEN text END, '') AS summary
           FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) WHERE case_pos <= 3), {_terms('''
  SELECT search_term, case_pos, 'Entry ' || any_value(entry) AS title, CAST(NULL AS VARCHAR) AS date, count(*) AS n_docs,
         string_agg(summary, chr(10) ORDER BY doc_id) AS lines, string_agg(summary, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) AS single
  FROM t GROUP BY search_term, case_pos''')}
SELECT * FROM d""",
    "synthesis_prompts": f"""
WITH u AS (SELECT search_term, n_cases, context FROM ({_DIGEST}) UNION ALL SELECT search_term || '*', n_cases, context FROM ({_ONE_CASE}))
SELECT search_term, md5(CASE WHEN n_cases = 1 AND context = '{_NO}' THEN NULL
  WHEN n_cases = 1 THEN 'Synthesize the following summaries into a coherent overview (in Croatian):' || chr(10) || chr(10) || context || '. Try to extrapolate what might happen next in the case going forward, and what the next steps are for the parties involved.'
  ELSE 'Synthesize the following ' || n_cases || ' summaries into a coherent overview, in Croatian. Try to predict the most likely developments in the case, as well as what the next steps are for the parties involved.' || chr(10) || '    Here is the data:' || chr(10) || context || '. In case there are any numerical figures try to arrange them into a table for clarity.' END) AS prompt_md5
FROM u""",
    "payload_shape": f"""
WITH {_ENTRIES}
SELECT search_term, CAST(count(*) AS INTEGER) AS n_cases, CAST(count(*) FILTER (doc_id % 5 <> 0) AS INTEGER) AS n_files,
       CAST(count(*) FILTER (doc_id % 5 <> 0 AND regexp_matches(text, '[^\\s]')) AS INTEGER) AS n_good, 'Document ' || max(doc_id) AS first_title
FROM e WHERE pos <= 2 GROUP BY search_term""",
    "prompt_text": """
SELECT doc_id, md5((CASE WHEN doc_id % 3 = 0 THEN 'The main participants in this case are: [].'
  WHEN doc_id % 3 = 1 THEN 'The main participants in this case are: [' || chr(10) || person || ',' || chr(10) || person || chr(10) || '].' ELSE 'Participant information was not available from the source page.' END)
  || ' From the court document text below, extract key information as a JSON object with the following keys: "caseNumber", "decisionDate", and "summary" (a medium-sized paragraph, nicely formatted, to be in Croatian please, as that is what our customers speak).'
  || chr(10) || '                Do include any important figures (currency amounts) you find in the summary. Provide ONLY the json object and nothing else. Text:' || chr(10) || chr(10)
  || left(text, 25000)) AS prompt_md5
FROM (SELECT *, '  {' || chr(10) || '    "name": "Ana \\"A\\"",' || chr(10) || '    "oib": "00000000001",' || chr(10) || '    "address": null,' || chr(10) || '    "role": "' || lang || '"' || chr(10) || '  }' AS person FROM documents)""",
    "model_extract": """
WITH d AS (SELECT doc_id, length(left(text, 25000)) % 5 AS k, left(text, 25000) AS t, doc_id % 11 = 0 OR NOT regexp_matches(text, '[^\\s]') AS blank FROM documents)
SELECT doc_id, CASE WHEN NOT blank AND k > 1 THEN t END AS summary, CASE WHEN NOT blank AND k > 1 THEN CAST(CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) END AS n_parties,
       CASE WHEN blank THEN 'Could not extract text from file. It may be empty, corrupted, or an image-based document.' WHEN k = 0 THEN 'the model is down'
            WHEN k = 1 THEN 'AI returned non-JSON response: "Sorry,..."' END AS error FROM d""",
    "progress_events": f"""
WITH {_case_rows(2)},
c AS (SELECT *, count(*) OVER (PARTITION BY search_term) AS n, CASE WHEN summary IS NOT NULL THEN 1 ELSE 0 END AS docs FROM t),
x AS (
  SELECT DISTINCT search_term, unnest([-3, -2, -1]) AS place, unnest(['starting', 'scraping', 'processing_setup']) AS step, CAST(unnest([5, 10, 20]) AS DOUBLE) AS progress,
         unnest(['Vaš zahtjev je započeo s obradom...', 'Pretražujem sudske zapise za nedavne objave...', 'Pronađeno ' || n || ' objava za analizu.']) AS message FROM c
  UNION ALL SELECT search_term, pos * 4, 'processing_case', 25 + (pos - 1) / n * 50, 'Obrađujem objavu ' || pos || ' od ' || n || ': ' || title FROM c
  UNION ALL SELECT search_term, pos * 4 + 1, 'downloading', NULL, 'Preuzimam arhivu za objavu ' || pos || '...' FROM c
  UNION ALL SELECT search_term, pos * 4 + 2, 'unzipping', NULL, 'Raspakiram datoteke za objavu ' || pos || '...' FROM c
  UNION ALL SELECT search_term, pos * 4 + 3, 'analyzing', NULL, 'Analiziram ' || docs || ' datoteka za objavu ' || pos || '...' FROM c WHERE docs > 0
  UNION ALL SELECT DISTINCT search_term, unnest([1000, 1001, 1002]), unnest(['comparing', 'complete', 'complete']), CAST(unnest([85, 100, 100]) AS DOUBLE),
         unnest(['Generiram usporednu analizu i zaključak...', 'Analiza je završena!', 'Analiza je završena!']) FROM c)
SELECT search_term, CAST(row_number() OVER (PARTITION BY search_term ORDER BY place) AS INTEGER) AS seq, step, progress, message FROM x""",
    "download_progress": """
SELECT source AS search_term, doc_id, CAST(50 + floor(row_number() OVER (PARTITION BY source ORDER BY doc_id) / count(*) OVER (PARTITION BY source) * 30 + 0.5) AS BIGINT) AS progress
FROM documents""",
    "safe_names": """
WITH n AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || ' č/' || p_partkey || '.Pdf' END AS x FROM part)
SELECT p_partkey, left(regexp_replace(coalesce(nullif(x, ''), 'document'), '[^a-zA-Z0-9_-]', '_', 'g'), 40) AS download_name,
       regexp_replace(coalesce(nullif(x, ''), 'Document_' || p_partkey), '[^a-zA-Z0-9]', '_', 'g') || '.md' AS export_name FROM n""",
    "markdown_export": f"""
WITH {_case_rows(2)}, {_terms(_TWO)},
n AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'Document_1' ELSE 'file ' || doc_id END AS x FROM t)
SELECT search_term, CAST(pos AS INTEGER) AS case_pos, regexp_replace(x, '[^a-zA-Z0-9]', '_', 'g') || '.md' AS file_name,
       '# ' || x || chr(10) || chr(10) || coalesce(summary, 'No analysis available') AS content FROM n
UNION ALL
SELECT search_term, 0, 'Usporedna_Analiza' || CASE WHEN search_term <> 'src1' THEN '_' || search_term ELSE '' END || '.md', '# Usporedna Analiza i Zaključak' || chr(10) || chr(10) || context FROM d""",
    "extension_ladder": """
WITH p AS (SELECT page_id, page_id % 4 AS k, CAST(page_id // 4 % 4 AS INTEGER) AS m, page_id % 3 = 0 AS zipped FROM pages)
SELECT page_id, CASE WHEN k = 1 THEN NULL WHEN k = 0 THEN '.pdf' WHEN m = 1 THEN '.pdf' WHEN m = 2 THEN '.html' WHEN zipped THEN '.zip' ELSE '.bin' END AS extension FROM p""",
    "fence_strip_parse": """
SELECT event_id, CASE event_id % 4 WHEN 2 THEN NULL WHEN 3 THEN '{"summary": "s", "k": 1}' ELSE props END AS raw_json,
       CASE WHEN event_id % 4 = 3 THEN 's' END AS summary,
       CASE WHEN event_id % 4 = 2 THEN 'AI returned non-JSON response: "' || left('Here: ' || props, 100) || '..."' END AS error FROM events""",
    "subscribe_inserts": f"WITH {_REQUESTS} SELECT request_no, email, search_term FROM j WHERE fresh",
    "subscribe_conflicts": f"WITH {_REQUESTS} SELECT request_no, email, search_term FROM j WHERE NOT fresh",
    "subscribe_ids": f"""
WITH {_REQUESTS} SELECT (SELECT max(id) FROM subs) + row_number() OVER (ORDER BY request_no) AS id, email, search_term, true AS is_active,
       CAST(NULL AS VARCHAR) AS last_seen_case_identifier FROM j WHERE fresh""",
    "unsubscribe": f"WITH {_SUBS} SELECT id, is_active AND id % 10 <> 0 AS is_active FROM subs",
    "active_subscriptions": "SELECT c_custkey AS id, c_name AS email FROM customer WHERE c_acctbal > 0",
    "change_detection": f"WITH {_FOLLOW} SELECT id, email, search_term, identifier, last_seen AS last_seen_case_identifier FROM due",
    "cursor_advance": f"""
WITH {_FOLLOW} SELECT id, CASE WHEN id % 4 <> 0 AND id IN (SELECT id FROM due) THEN identifier ELSE last_seen END AS last_seen_case_identifier FROM f""",
    "mail_outbox": f"""
WITH {_FOLLOW}
SELECT id AS subscription_id, identifier, email AS recipient, 'Nova objava za Vašu pretragu: ' || search_term AS subject,
  md5('<h1>Pronađena je nova sudska objava!</h1>' || chr(10) || '<p>Pronašli smo novu objavu za pojam koji pratite: <strong>' || search_term || '</strong></p>' || chr(10)
  || '<hr>' || chr(10) || '<h2>Detalji objave:</h2>' || chr(10) || '<p><strong>Naziv:</strong> ' || title || '</p>' || chr(10) || '<p><strong>Broj predmeta:</strong> ' || case_number || '</p>' || chr(10)
  || '<p><strong>Sud:</strong> N/A</p>' || chr(10) || '<p><strong>Datum objave:</strong> ' || date || '</p>' || chr(10) || '<hr>' || chr(10) || '<h2>AI Analiza:</h2>' || chr(10) || '<div>Analysis of ' || case_number || '</div>' || chr(10)
  || '<p><a href="http://host.example">Pogledajte originalnu objavu</a></p>' || chr(10) || '<hr>' || chr(10) || '<p>Ne želite više primati ove obavijesti? <a href="/api/unsubscribe/' || token || '">Odjavite se</a>.</p>' || chr(10)) AS body_md5
FROM due""",
    "change_feed": f"""
WITH {_FOLLOW},
w AS (SELECT CAST(o_custkey AS VARCHAR) AS term, CAST(o_orderkey AS VARCHAR) AS num, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS name,
             row_number() OVER (PARTITION BY o_custkey ORDER BY pos) AS n
      FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS pos FROM orders) WHERE o_orderkey % 2 = 0),
n AS (SELECT f.id, f.last_seen, token, term, num, day, name, num || ' - ' || day AS now, f.is_active AND num || ' - ' || day IS DISTINCT FROM f.last_seen AND w.term IS NOT NULL AS changed
      FROM f LEFT JOIN w ON w.term = f.search_term AND w.n = 1)
SELECT id, CASE WHEN changed AND id % 4 <> 0 THEN now ELSE last_seen END AS last_seen_case_identifier,
  CASE WHEN changed THEN md5('<h1>Pronađena je nova sudska objava!</h1>' || chr(10) || '<p>Pronašli smo novu objavu za pojam koji pratite: <strong>' || term || '</strong></p>' || chr(10)
  || '<hr>' || chr(10) || '<h2>Detalji objave:</h2>' || chr(10) || '<p><strong>Naziv:</strong> ' || name || '</p>' || chr(10) || '<p><strong>Broj predmeta:</strong> ' || num || '</p>' || chr(10)
  || '<p><strong>Sud:</strong> N/A</p>' || chr(10) || '<p><strong>Datum objave:</strong> ' || day || '</p>' || chr(10) || '<hr>' || chr(10) || '<h2>AI Analiza:</h2>' || chr(10) || '<div>About ' || num || '</div>' || chr(10)
  || '<p><a href="http://host.example">Pogledajte originalnu objavu</a></p>' || chr(10) || '<hr>' || chr(10) || '<p>Ne želite više primati ove obavijesti? <a href="/api/unsubscribe/' || token || '">Odjavite se</a>.</p>' || chr(10)) END AS body_md5
FROM n""",
    "synthesis_texts": f"""
WITH u AS (SELECT search_term, n_cases, context FROM ({_DIGEST}) UNION ALL SELECT search_term || '*', n_cases, context FROM ({_ONE_CASE})
           UNION ALL SELECT search_term || '?', 0, NULL FROM ({_DIGEST})),
p AS (SELECT *, CASE WHEN n_cases = 0 OR (n_cases = 1 AND context = '{_NO}') THEN NULL
  WHEN n_cases = 1 THEN 'Synthesize the following summaries into a coherent overview (in Croatian):' || chr(10) || chr(10) || context || '. Try to extrapolate what might happen next in the case going forward, and what the next steps are for the parties involved.'
  ELSE 'Synthesize the following ' || n_cases || ' summaries into a coherent overview, in Croatian. Try to predict the most likely developments in the case, as well as what the next steps are for the parties involved.' || chr(10) || '    Here is the data:' || chr(10) || context || '. In case there are any numerical figures try to arrange them into a table for clarity.' END AS prompt FROM u)
SELECT search_term, n_cases, CASE WHEN n_cases = 0 THEN 'Nema dostupnih podataka za generiranje analize.' WHEN prompt IS NULL THEN context
  WHEN length(prompt) % 3 = 0 THEN CASE WHEN n_cases = 1 THEN 'Greška pri generiranju završnog sažetka.' ELSE 'Greška pri generiranju usporedne analize.' END
  ELSE 'Overview of ' || length(prompt) END AS analysis FROM p""",
    "progress_errors": """
WITH o AS (SELECT o_orderkey AS search_term, CASE WHEN o_orderkey % 3 = 0 THEN 'Došlo je do greške u obradi.' ELSE 'No entry for ' || o_orderpriority END AS said, o_orderkey % 2 = 0 AS begun FROM orders)
SELECT search_term, 1 AS seq, 'starting' AS step, CAST(5 AS DOUBLE) AS progress, 'Vaš zahtjev je započeo s obradom...' AS message FROM o
UNION ALL SELECT search_term, 2, 'scraping', 10, 'Pretražujem sudske zapise za nedavne objave...' FROM o WHERE begun
UNION ALL SELECT search_term, 3, 'error', 100, said FROM o WHERE begun
UNION ALL SELECT search_term, 4, 'error', 100, said FROM o WHERE begun
UNION ALL SELECT search_term, 2, 'error', 100, said FROM o WHERE NOT begun""",
    "token_frames": """
SELECT conv_id, turn, CASE WHEN turn = 3 THEN 'data: {"error":"Streaming failed"}' ELSE 'data: {"content":"' || role || '"}' END || chr(10) || chr(10) AS frame
FROM conversations WHERE turn = 3 OR (turn % 2 = 1 AND (turn < 3 OR conv_id NOT IN (SELECT conv_id FROM conversations WHERE turn = 3)))""",
    "nested_payload": f"""
WITH {_ENTRIES},
c AS (SELECT *, doc_id % 5 <> 0 AS there, NOT regexp_matches(text, '[^\\s]') AS blank FROM e WHERE pos <= 2),
p AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '[{{"name":"Ana","oib":"00000000001","address":"N/A","role":"' || lang || '"}}]' END AS people FROM c),
j AS (SELECT search_term, pos, CASE WHEN there AND NOT blank THEN left(text, 25000) END AS summary, 'Document ' || doc_id AS title, lang, there,
        '{{"caseResult":{{"title":"Document ' || doc_id || '","case_number":"' || doc_id || '","court":"Court","date":"' || lang || '","detail_link":"http://host.example/' || doc_id || '"'
        || CASE WHEN people IS NULL THEN '' ELSE ',"participants":' || people END || '}},"files":[' || CASE WHEN there THEN '{{"url":"http://host.example/a.zip","text":"a.txt"}}' ELSE '' END
        || '],"analysis":{{"individualAnalyses":[' || CASE WHEN NOT there THEN ''
             WHEN blank THEN '{{"fileName":"a.txt","error":"Could not extract text from file. It may be empty, corrupted, or an image-based document."}}'
             ELSE '{{"fileName":"a.txt","aiResult":{{"summary":' || CAST(to_json(left(text, 25000)) AS VARCHAR) || ',"parties":' || coalesce(people, '[]') || '}}}}' END || ']}}}}' AS body FROM p),
{_terms("SELECT search_term, pos AS case_pos, title, lang AS date, 1 AS n_docs, summary AS lines, summary AS single FROM j")}
SELECT search_term, (SELECT '[' || string_agg(body, ',' ORDER BY pos) || ']' FROM j WHERE j.search_term = d.search_term) AS processed_cases, context AS comparative_analysis FROM d""",
    "daily_check_notices": f"""
WITH {_FOLLOW} SELECT id, identifier, 'About ' || case_number AS analysis FROM due WHERE CAST(case_number AS BIGINT) % 2 = 0""",
    "chat_normalised": f"""
SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS pos, 'system' AS kind, '{_SYSTEM}' AS content FROM conversations
UNION ALL SELECT conv_id, turn, CASE role WHEN 'user' THEN 'human' ELSE 'ai' END, text FROM conversations WHERE role IN ('user', 'assistant', 'model') AND text <> ''""",
    "chat_attachment": """
WITH l AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, turn AS pos, text || CASE WHEN turn = last AND conv_id % 2 = 0 THEN chr(10) || chr(10) || '(Attached ' || CASE WHEN conv_id % 4 = 0 THEN 'PDF' ELSE 'image' END || ': file-' || conv_id || ')' ELSE '' END AS content
FROM l WHERE role = 'user' AND text <> ''""",
    "chat_last_n": """
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3""",
    "chat_without_last": "SELECT conv_id, turn, role FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS m FROM conversations) WHERE turn < m",
    "chat_running_text": "SELECT conv_id, turn, md5(string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn)) AS running_md5 FROM conversations",
    "chat_client_messages": """
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, CAST(length(text) AS BIGINT) AS n_chars FROM conversations
WHERE turn <> 3 AND regexp_matches(text, '[^\\s]')""",
    "chat_json_bodies": """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text AS content FROM conversations WHERE conv_id % 10 > 1""",
    "token_stream": """
SELECT conv_id, turn, role AS said FROM conversations WHERE turn % 2 = 1 OR turn % 3 = 0""",
    "token_bucket": _BUCKET,
    "token_bucket_stream": _BUCKET,
    "fixed_windows": """
WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) <= 1 AS pass_first FROM events)
SELECT event_id, pass_first, pass_first AND row_number() OVER (PARTITION BY user_id, date_trunc('day', ts), pass_first ORDER BY ts, event_id) <= 5 AS allowed FROM a""",
    "queue_times": """
WITH RECURSIVE j AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS arrival, (event_id % 7 + 1) * 3600000 AS service, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events),
q AS (SELECT event_id, user_id, n, arrival AS s, arrival + service AS e FROM j WHERE n = 1
  UNION ALL SELECT j.event_id, j.user_id, j.n, greatest(j.arrival, q.e), greatest(j.arrival, q.e) + j.service FROM q JOIN j ON j.user_id = q.user_id AND j.n = q.n + 1)
SELECT event_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end" FROM q""",
    "sse_frames": f"WITH {_FRAMES} SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS frame_no, payload FROM rows",
    "sse_frames_unbuffered": f"""
WITH {_FRAMES},
w AS (SELECT conv_id, string_agg('data: ' || payload || chr(10) || chr(10), '' ORDER BY turn) AS whole FROM rows GROUP BY conv_id),
c AS (SELECT conv_id, seq, string_split(substr(whole, seq * 40 + 1, 40), chr(10) || chr(10)) AS parts FROM (SELECT conv_id, whole, unnest(range(0, (length(whole) - 1) // 40 + 1)) AS seq FROM w)),
p AS (SELECT conv_id, seq, k, parts[k] AS part FROM (SELECT conv_id, seq, parts, unnest(range(1, len(parts) + 1)) AS k FROM c))
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY seq, k) - 1 AS frame_no, substr(part, 7) AS payload FROM p WHERE starts_with(part, 'data: ')""",
    "html_entries": """
SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS result_pos, 'Title ' || o_orderkey AS title,
       'http://host.example/objave/' || o_orderkey AS detail_link, 'St-' || o_orderkey || '/2000' AS case_number, 'Court ' || o_orderpriority AS court,
       strftime(o_orderdate, '%Y-%m-%d') AS date, CASE WHEN o_orderkey % 2 = 0 THEN 'http://host.example/d/preuzimanje' END AS document_download_link,
       'Ana ' || o_orderpriority || '|00000000001|N/A|Party' AS person
FROM orders""",
    "html_entries_plain": """
SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS result_pos, 'Title ' || o_orderkey AS title, 'Court ' || o_orderpriority AS court
FROM orders""",
    "html_links": "SELECT page_id, CAST(0 AS INTEGER) AS link_pos, '/x' || page_id || '/preuzimanje' AS path, 'A b' AS text FROM pages",
    "html_navigation": """
SELECT page_id, CAST(len(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>'), '<li><a href=')) AS BIGINT) AS n_links FROM pages
WHERE regexp_matches(html, '(?s)<nav>.*?<li><a href=.*?</nav>')""",
    "zip_entries": """
SELECT doc_id, CAST(0 AS INTEGER) AS entry_pos, 'inner/a.txt' AS entry_name, CAST(length(text) AS BIGINT) AS n_chars, false AS failed FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT doc_id, 1, 'b.bin', 0, false FROM documents WHERE doc_id % 10 <> 0
UNION ALL SELECT doc_id, 0, NULL, 0, true FROM documents WHERE doc_id % 10 = 0""",
    "text_by_suffix": """
WITH d AS (SELECT doc_id, text, octet_length(encode(text)) AS size, doc_id % 6 AS k FROM documents),
t AS (SELECT doc_id, CASE WHEN k = 0 THEN text WHEN k IN (1, 2) AND size % 7 <> 0 THEN 'page one of ' || size || chr(10) || chr(10) || 'page two' || chr(10) || chr(10) ELSE '' END AS text FROM d)
SELECT doc_id, md5(text) AS text_md5, NOT regexp_matches(text, '[^\\s]') AS unreadable FROM t""",
    "archive_listing": """
SELECT CASE WHEN doc_id % 2 = 1 THEN doc_id || '.ZIP' ELSE doc_id || '.zip' END AS path, CASE WHEN doc_id % 10 = 0 THEN 'error' ELSE 'success' END AS status,
       CASE WHEN doc_id % 10 <> 0 THEN 'inner/,inner/a.txt,b.bin' END AS names, doc_id % 10 = 0 AS failed FROM documents""",
    "download_files": """
SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN 'Page_' || page_id || CASE WHEN page_id % 2 = 1 THEN '.pdf' ELSE '.docx' END END AS file_name,
       CASE WHEN page_id % 5 <> 0 THEN CAST(octet_length(encode(url || '#' || page_id)) AS BIGINT) END AS n_bytes, CASE WHEN page_id % 5 = 0 THEN '404 for ' || page_id END AS error FROM pages""",
    "detail_page_cases": """
WITH n AS (SELECT source AS search_term, max(doc_id) AS entry_id FROM documents WHERE doc_id % 7 = 3 GROUP BY source)
SELECT search_term, entry_id, array_to_string([ 'http://host.example/' || entry_id || '/' || k || '=Doc ' || k FOR k IN range(0, entry_id % 3 + 1)], ';') AS links FROM n""",
    "chat_turn": """
WITH m AS (SELECT conv_id, count(*) FILTER (role IN ('user', 'assistant', 'model') AND text <> '') + 1 AS n,
                  arg_max(length(text), turn) FILTER (role IN ('user', 'assistant', 'model') AND text <> '') AS size FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN n % 4 <> 0 THEN n || ' messages, the last of ' || size END AS reply, CASE WHEN n % 4 = 0 THEN 'the model is down' END AS error FROM m""",
    "chat_history": """
SELECT conv_id, turn, role, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4""",
    "term_checks": "SELECT p_partkey, length(trim(left(p_name, CAST(p_partkey % 12 AS INTEGER)))) >= 8 AS enough FROM part",
    "iso_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, CAST(year(ts) AS INTEGER) AS year FROM events",
    "inline_data": "SELECT page_id, md5('data:image/png;base64,' || to_base64(encode(html))) AS url_md5 FROM pages",
    "upload_admission": """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'application/pdf' ELSE 'image/png' END AS mime, CAST(length(html) * 200 AS BIGINT) AS length FROM pages
WHERE page_id % 4 < 2 AND length(html) * 200 <= 2097152""",
    "clamp_settings": """
SELECT event_id, CAST(CASE WHEN event_id % 6 < 2 THEN 16 ELSE least(greatest(event_id % 23, 16), 18) END AS INTEGER) AS size FROM events""",
    "search_by_term": "SELECT doc_id, lang FROM documents WHERE source = 'src3'",
    "display_defaults": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN o_orderpriority ELSE 'N/A' END AS court FROM orders",
    "whitespace": """
SELECT p_partkey, p_name || chr(160) || chr(8195) || ' OIB OIB x' AS trimmed, regexp_replace(p_name, '\\s+', ' ', 'g') || ' OIB OIB x' AS one_space,
       p_name || chr(160) || chr(8195) || '  OIB x' AS without_first FROM part""",
}
