import random

import pytest
from pyspark.sql import functions as F

from casestream.operators import analyze as A
from casestream.operators import chat as C
from casestream.operators import digest as D
from casestream.operators import limits as L
from casestream.operators import select as S
from casestream.operators import subscriptions as U
from casestream.plans.analysis import processed_cases


@pytest.mark.parametrize("parts", [1, 7])
def test_latest_n_comes_after_the_link_filter(spark, parts):
    rows = [("t", i, None if i % 2 else "u") for i in range(8)]
    df = spark.createDataFrame(rows, "search_term string, result_pos int, document_download_link string").repartition(parts)
    got = S.latest_n(S.with_documents(df), 2).orderBy("case_pos").collect()
    assert [r.result_pos for r in got] == [0, 2]


def test_first_per_case_keeps_the_sentinel_as_a_key(spark):
    rows = [(0, "N/A", "a"), (1, "N/A", "b"), (2, "", "c"), (3, None, None), (4, "", "c")]
    df = spark.createDataFrame(rows, "result_pos int, case_number string, title string")
    assert sorted(r.result_pos for r in S.latest_per_case(df).collect()) == [0, 2]


@pytest.mark.parametrize("parts", [1, 7])
def test_digest_by_number_of_entries(spark, parts):
    rows = [
        ("one", 1, "T", "d", 0, ""), ("one", 1, "T", "d", 1, None),
        ("two", 1, "A", "x", 1, "s2"), ("two", 1, "A", "x", 0, "s1"), ("two", 2, None, "y", 0, None),
        ("solo", 1, "A", "x", 1, "b"), ("solo", 1, "A", "x", 0, "a"),
    ]
    df = spark.createDataFrame(rows, "search_term string, case_pos int, title string, date string, doc_pos int, summary string").repartition(parts)
    got = {r.search_term: r.context for r in D.per_term(D.per_entry(df)).collect()}
    assert got["one"] == D.NO_SUMMARY
    assert got["solo"] == "a\n\n---\n\nb"
    assert got["two"] == "--- Case Entry 1 ---\nTitle: A\nDate: x\nSummary of Documents:\ns1\ns2\n\n--- Case Entry 2 ---\nTitle: undefined\nDate: y\nSummary of Documents:\n\n\n"


def test_replies_are_parsed_strictly(spark):
    rows = ['```json\n{"summary": "a", "caseNumber": 3}\n```', '{"a": 1} x}', "no", '{"k": NaN}', '{"k": 1, "k": 2}', None]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, r string")
    got = {r.i: r.p for r in df.select("i", A.parse_reply(F.col("r")).alias("p")).collect()}
    assert got[0].result.summary == "a" and got[0].result.case_number == "3"
    assert got[1].error and got[3].error and got[1].raw_json is None
    assert got[2].error == 'AI returned non-JSON response: "no..."'
    assert got[4].raw_json == '{"k": 2}' and got[5].error


def test_analysis_keeps_parties_and_errors(spark):
    people = [("Ana", "00000000001", "N/A", "x")]
    df = spark.createDataFrame([(0, "text", people), (1, "  ", None), (2, "boom", None)], f"i int, text string, participants {A.PARTIES}")

    def make():
        def call(p):
            if "boom" in p:
                raise RuntimeError("down")
            return '{"summary": "s", "parties": "other"}'

        return call

    got = {r.i: r for r in A.analyze(df, make).collect()}
    assert got[0].ai_result.parties[0].name == "Ana" and got[0].error is None
    assert got[1].error == A.NO_TEXT and got[1].ai_result is None
    assert got[2].error == "down"


def test_case_without_files_has_empty_arrays(spark):
    schema = "search_term string, case_pos int, title string, case_number string, court string, date string, detail_link string, participants array<struct<name:string,oib:string,address:string,role:string>>, doc_pos int, url string, file_name string, text string"
    df = spark.createDataFrame([("t", 1, "a", "1", "c", "d", "l", None, None, None, None, None), ("t", 2, "b", "2", "c", "d", "l", [], 0, "u", "f.txt", "hello")], schema)
    row = processed_cases(df).first()
    first, second = row.processed_cases
    assert first.files == [] and first.analysis.individualAnalyses == []
    assert second.files[0].url == "u" and second.analysis.individualAnalyses[0].aiResult.summary == "hello"
    assert "hello" in row.comparative_analysis


def test_chat_note_only_on_a_valid_last_message(spark):
    rows = [(1, 0, "user", "a", None), (1, 1, "user", "", [("b",)]), (2, 0, "user", "a", None), (2, 1, "user", "", None), (3, 0, "tool", "x", None), (3, 1, "", "y", None)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, content string, parts array<struct<text:string>>")
    files = spark.createDataFrame([(1, "application/pdf", "f.pdf"), (2, "image/png", "g.png")], "conv_id int, mime_type string, original_filename string")
    got = {(r.conv_id, r.pos): r.content for r in C.normalise(df, files=files).collect() if r.pos >= 0}
    assert got == {(1, 0): "a", (1, 1): "b\n\n(Attached PDF: f.pdf)", (2, 0): "a"}


def test_frames_over_chunks(spark):
    chunks = [(1, 0, 'data: {"a"'), (1, 1, ': 1}\n'), (1, 2, '\nignored\n\ndata: {"b": 2}')]
    df = spark.createDataFrame(chunks, "conv_id int, seq int, chunk string")
    assert [r.payload for r in C.frames(df).orderBy("frame_no").collect()] == ['{"a": 1}', '{"b": 2}']
    assert [r.payload for r in C.frames(df, buffered=False).orderBy("frame_no").collect()] == ['{"a"', '{"b": 2}']


def test_subscribing_twice_conflicts_even_if_inactive(spark):
    subs = spark.createDataFrame([(7, "a", "x", False)], "id long, email string, search_term string, is_active boolean")
    asked = spark.createDataFrame([(1, "a", "x"), (2, "a", "x "), (3, "b", "y"), (4, "b", "y"), (5, "", "z")], "request_no int, email string, search_term string")
    fresh, conflict, refused = U.split_requests(asked, subs)
    assert sorted(r.request_no for r in fresh.collect()) == [2, 3]
    assert sorted(r.request_no for r in conflict.collect()) == [1, 4]
    assert [r.request_no for r in refused.collect()] == [5]
    assert sorted(r.id for r in U.insert(fresh, subs).collect()) == [8, 9]


def test_no_cursor_means_changed(spark):
    subs = spark.createDataFrame([(1, "t", None, True), (2, "t", "n - d", True), (3, "t", "old", False)], "id long, search_term string, last_seen_case_identifier string, is_active boolean")
    latest = spark.createDataFrame([("t", "n", "d")], "search_term string, case_number string, date string")
    assert [r.id for r in U.changes(subs, latest).collect()] == [1]


def model(events, hour, short):
    """The buckets of one client, written out plainly."""
    out, state = [], None
    for now in events:
        state = state or {"h": hour.tokens, "hl": now, "s": short.tokens, "sl": now}
        for k, b in (("h", hour), ("s", short)):
            add = (now - state[k + "l"]) // b.per_token_ms
            if add > 0:
                state[k] = min(b.tokens, state[k] + add)
        if state["h"] <= 0 or state["s"] <= 0:
            out.append(False)
            continue
        out.append(True)
        state.update(h=state["h"] - 1, s=state["s"] - 1, hl=now, sl=now)
    return out


def test_token_bucket_against_a_model(spark):
    rng = random.Random(5)
    hour, short = L.Bucket(6, 700), L.Bucket(3, 250)
    rows, want = [], {}
    for client in range(6):
        now, times = 0, []
        for i in range(60):
            now += rng.choice([0, 0, 50, 200, 400, 1500])
            times.append(now)
            rows.append((client, client * 1000 + i, now))
        want |= {client * 1000 + i: ok for i, ok in enumerate(model(times, hour, short))}
    df = spark.createDataFrame(rows, "c int, event_id long, ms long").withColumn("ts", F.timestamp_millis("ms")).repartition(5)
    got = {r.event_id: r.allowed for r in L.token_bucket(df, "c", hour, short).collect()}
    assert got == want and not all(got.values())


def test_five_pass_and_the_sixth_waits(spark):
    df = spark.createDataFrame([("a", i, 0) for i in range(6)], "c string, event_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    got = {r.event_id: (r.allowed, r.reason, r.retry_after_ms) for r in L.token_bucket(df, "c").collect()}
    assert [got[i][0] for i in range(6)] == [True] * 5 + [False] and got[5][1:] == ("5s", 5000)


def test_one_server_queue(spark):
    df = spark.createDataFrame([("q", i, 0 if i < 3 else 100, 10) for i in range(4)], "q string, j int, arrival long, service long")
    got = {r.j: (r.start, r.end) for r in L.queue_times(df, ["q"], "arrival", "service", "j").collect()}
    assert got == {0: (0, 10), 1: (10, 20), 2: (20, 30), 3: (100, 110)}
