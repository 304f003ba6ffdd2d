"""Sources, sinks and state that live longer than a query: search, event sink, replies, buckets, observers, files, JDBC."""

import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from casestream.operators import analyze as A
from casestream.operators import chat as C
from casestream.operators import subscriptions as U
from casestream.operators.limits import Bucket
from casestream.operators.replies import ReplyStore
from casestream.plans import analysis
from casestream.session import scratch
from casestream.sources import events as E
from casestream.sources import tables as T
from casestream.streaming import ingest as I
from casestream.streaming import observe as O
from casestream.streaming.token_bucket import bucket_states, token_bucket_stream


def run(stream, path, checkpoint):
    stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(path)).awaitTermination()


# -- search ----------------------------------------------------------------


def page(*numbers):
    return "<ul>" + "".join(f'<li class="item row"><a href="/objave/{k}" target="_blank">T{k}</a><a href="?text=1">N{k}</a><a href="/d{k}/preuzimanje">Get</a></li>' for k in numbers) + "</ul>"


def archive(spark, folder, rows, **more):
    T.write_archive(spark.createDataFrame([(t, p, "http://h.example/s", page(*ks)) for t, p, ks in rows], "search_term string, page int, url string, html string"), str(folder), **more)


PAGES = [("a b/č=1", 0, (1, 2)), ("a b/č=1", 1, (3,)), ("two", 0, (4,)), ("two", 2, (5, 6)), ("other", 0, (7,))]


def test_search_reads_only_the_pushed_terms(spark, tmp_path):
    archive(spark, tmp_path / "a", PAGES)
    found = T.find_entries(spark, ["a b/č=1", "two", "none"], archive=str(tmp_path / "a"), pages_each="1")
    assert Counter((r.search_term, r.page, r.result_pos, r.title) for r in found.collect()) == Counter([("a b/č=1", 0, 0, "T1"), ("a b/č=1", 0, 1, "T2"), ("a b/č=1", 1, 0, "T3"), ("two", 0, 0, "T4"), ("two", 2, 0, "T5"), ("two", 2, 1, "T6")])
    pages = T.search_pages(spark, ["a b/č=1", "two", "none"], archive=str(tmp_path / "a"), pages_each="1")
    assert pages.rdd.getNumPartitions() == 5  # one for each page here; the term without pages has none
    one = pages.where("search_term = 'two'")
    plans = one._jdf.queryExecution()
    assert "= two" in plans.analyzed().toString() and "= two" not in plans.executedPlan().toString()  # the source has taken the filter
    assert sorted(r.page for r in one.collect()) == [0, 2] and one.rdd.getNumPartitions() == 3
    assert pages.where("search_term = 'nothing'").count() == 0 and found.where("search_term = 'two'").count() == 3
    with pytest.raises(Exception, match="search term is needed"):
        T.find_entries(spark, [], archive=str(tmp_path / "a")).collect()


def test_a_search_stream_repeats_nothing_after_a_restart(spark, tmp_path):
    for k, rows in enumerate([PAGES[:3], PAGES[3:], [("two", 3, (8,))]]):
        archive(spark, tmp_path / "a", rows)
        run(T.entry_stream(spark, ["a b/č=1", "two"], archive=str(tmp_path / "a")), tmp_path / "out", tmp_path / "state")
        got = sorted(r.title for r in spark.read.parquet(str(tmp_path / "out")).collect())
        assert got == [["T1", "T2", "T3", "T4"], ["T1", "T2", "T3", "T4", "T5", "T6"], ["T1", "T2", "T3", "T4", "T5", "T6", "T8"]][k]


def test_the_whole_analysis_from_terms(spark, tmp_path):
    """Terms in, nested results out: searched, downloaded, read and analysed."""
    archive(spark, tmp_path / "a", PAGES)

    def fetch(url):
        return f"text of {url}".encode(), {"content-disposition": 'attachment; filename="x.txt"'}

    out = {r.search_term: r for r in analysis.run_terms(spark, ["a b/č=1", "two"], fetch, {"archive": str(tmp_path / "a")}, n=2).collect()}
    titles = {t: [c.caseResult.title for c in r.processed_cases] for t, r in out.items()}
    assert titles == {"a b/č=1": ["T1", "T2"], "two": ["T4", "T5"]}
    assert out["two"].processed_cases[0].analysis.individualAnalyses[0].aiResult.summary == "text of http://h.example/d4/preuzimanje"


# -- event sink ------------------------------------------------------------


def frames(spark, path, rows):
    spark.createDataFrame(rows, E.FRAMES).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(E.FRAMES).parquet(str(path))


def send(spark, tmp_path, rows, change=lambda df: df):
    E.write_events(change(frames(spark, tmp_path / "in", rows)), str(tmp_path / "sink"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()


def sent(spark, tmp_path):
    return sorted((r.key, r.seq, r.frame) for r in E.read_events(spark, str(tmp_path / "sink")).collect())


def test_nothing_follows_a_close(spark, tmp_path):
    assert sent(spark, tmp_path) == []
    send(spark, tmp_path, [("a", 0, "x", False), ("a", 1, "end", True), ("a", 2, "late", False), ("b", 0, "y", False), (None, 0, "n", True), (None, 1, "m", False)])
    send(spark, tmp_path, [("a", 3, "later", False), ("a", 0, "again", True), ("b", 1, "z", False)])
    assert Counter(sent_rows for sent_rows in E.read_events(spark, str(tmp_path / "sink")).select("key", "seq", "frame").collect()) == Counter([("a", 0, "x"), ("a", 1, "end"), ("b", 0, "y"), ("b", 1, "z"), (None, 0, "n")])


def test_a_failed_task_leaves_no_frame(spark, tmp_path):
    down = F.when(F.col("key") == "bad", F.raise_error(F.lit("task down"))).otherwise(F.col("frame"))
    rows = [(k, 0, k, False) for k in ("a", "b", "c", "bad")]
    with pytest.raises(Exception, match="task down|TASK_WRITE_FAILED|aborted"):
        send(spark, tmp_path, rows, lambda df: df.repartition(4, "key").withColumn("frame", down))
    assert sent(spark, tmp_path) == []
    send(spark, tmp_path, [("d", 0, "d", False)])
    assert [k for k, *_ in sent(spark, tmp_path)] == ["a", "b", "bad", "c", "d"]
    E.purge(str(tmp_path / "sink"))
    assert len(sent(spark, tmp_path)) == 5


def test_a_batch_that_is_committed_again_counts_once(spark, tmp_path):
    writer = E._Writer(str(tmp_path / "sink"))
    row = {"key": "k", "seq": 0, "frame": "f", "closes": False}
    first, second = writer.write(iter([row])), writer.write(iter([row]))
    assert writer.write(iter([])).file is None
    writer.commit([first, None], 0)
    writer.commit([second], 0)
    assert sent(spark, tmp_path) == [("k", 0, "f")] and len(os.listdir(tmp_path / "sink" / "staged")) == 1
    lost = writer.write(iter([row] * 3))
    assert lost.frames == 3 and E.purge(str(tmp_path / "sink")) == 1 and sent(spark, tmp_path) == [("k", 0, "f")]


# -- replies ---------------------------------------------------------------


def counting(path):
    """A model that writes down each call; prompts with "down" fail."""

    def make():
        def reply(prompt):
            with open(path, "a") as f:
                f.write(prompt.replace("\n", " ") + "\n")
            if "down" in prompt:
                raise RuntimeError("no model")
            return f"```json\n{{\"summary\": \"{len(prompt)}\"}}\n```"

        return reply

    return make


def calls(path):
    return Counter(open(path).read().splitlines()) if os.path.exists(path) else Counter()


def test_equal_prompts_are_asked_once_over_all_runs(spark, tmp_path):
    store, log = ReplyStore(spark, scratch(spark, "replies-test")), str(tmp_path / "log")
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(["x", "y", "x", None, "down", "x", "", "down"])], "i int, p string").repartition(4)
    first = {r.i: (r.reply is not None, r.error) for r in store.ask(rows, "p", counting(log)).collect()}
    assert first == {0: (True, None), 1: (True, None), 2: (True, None), 3: (False, None), 4: (False, "no model"), 5: (True, None), 6: (True, None), 7: (False, "no model")}
    assert calls(log) == Counter({"x": 1, "y": 1, "down": 1, "": 1})
    more = rows.union(spark.createDataFrame([(9, "new")], "i int, p string"))
    assert store.ask(more, "p", counting(log), "named").count() == 9
    assert calls(log) == Counter({"x": 1, "y": 1, "down": 2, "": 1, "new": 1})  # what failed is tried again, once
    store.ask(more, "p", counting(log), "named").collect()  # a replay of a whole run
    assert calls(log)["down"] == 2 and len(store.runs()) == 2
    store.compact()
    assert len(store.runs()) == 1 and store.replies().count() == 4
    store.ask(more, "p", counting(log)).collect()
    assert calls(log) == Counter({"x": 1, "y": 1, "down": 3, "": 1, "new": 1})


def test_a_run_that_stopped_is_not_read(spark, tmp_path):
    store, log = ReplyStore(spark, scratch(spark, "replies-test")), str(tmp_path / "log")
    rows = spark.createDataFrame([(0, "x")], "i int, p string")
    spark.createDataFrame([("h", "r", None)], "prompt_hash string, reply string, error string").write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{store.path}/run=half")
    assert store.runs() == [] and store.ask(rows, "p", counting(log)).first().reply and store.replies().count() == 1


def test_documents_are_analysed_once(spark, tmp_path):
    """Calls are as many as distinct prompts, in one analysis and over two, and answers are those of the plain path."""
    log, store = str(tmp_path / "log"), ReplyStore(spark, scratch(spark, "replies-test"))
    person = F.array(F.struct(F.lit("Ana").alias("name"), F.lit("1").alias("oib"), F.lit("N/A").alias("address"), F.lit("P").alias("role"))).cast(A.PARTIES)
    files = spark.range(40).select(
        F.concat(F.lit("t"), F.col("id") % 4).alias("search_term"), (F.col("id") % 2 + 1).cast("int").alias("case_pos"), F.lit("T").alias("title"), F.lit("1").alias("case_number"), F.lit("c").alias("court"), F.lit("d").alias("date"), F.lit("l").alias("detail_link"),
        F.when(F.col("id") % 4 < 2, person).alias("participants"), F.when(F.col("id") % 10 != 9, F.floor(F.col("id") / 4)).cast("int").alias("doc_pos"), F.lit("u").alias("url"), F.lit("f").alias("file_name"), F.when(F.col("id") % 7 == 0, F.lit(" ")).otherwise(F.concat(F.lit("text "), F.col("id") % 5)).alias("text"),
    )
    one = {r.search_term: r for r in analysis.processed_cases(files, counting(log), store=store).collect()}
    asked = calls(log)
    assert set(asked.values()) == {1} and len(asked) <= 10
    analysis.processed_cases(files, counting(log), store=store).collect()
    assert calls(log) == asked
    plain = {(r.search_term, r.case_pos, r.doc_pos): (r.error, r.ai_result and r.ai_result.summary) for r in A.analyze(files, counting(log)).collect()}
    stored = {(r.search_term, r.case_pos, r.doc_pos): (r.error, r.ai_result and r.ai_result.summary) for r in A.analyze(files, counting(log), store).collect()}
    assert plain == stored and len(one) == 4


# -- token buckets ---------------------------------------------------------

EVENTS = "event_id bigint, ts timestamp, user string"


def test_bucket_states_outlive_a_stop(spark, tmp_path):
    rows = [(k, 1_000_000 + k * 700, "ab"[k % 2]) for k in range(30)]
    buckets = Bucket(6, 4_000), Bucket(3, 1_500)
    for part in (rows[:11], rows[11:]):
        spark.createDataFrame(part, "event_id bigint, ms bigint, user string").select("event_id", F.timestamp_millis("ms").alias("ts"), "user").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        run(token_bucket_stream(stream, "user", *buckets, expire=False), tmp_path / "out", tmp_path / "state")
    from casestream.operators.limits import step

    state, want = {}, {}
    for k, now, user in rows:
        state[user], ok, reason, retry = step(state.get(user), now, *buckets)
        want[k] = (ok, reason, retry)
    got = {r.event_id: (r.allowed, r.reason, r.retry_after_ms) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want and {ok for ok, *_ in want.values()} == {True, False}
    assert {r.key: tuple(r)[1:] for r in bucket_states(spark, str(tmp_path / "state")).collect()} == state


def test_an_idle_clients_state_goes(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "event_id bigint, user string").select("event_id", F.current_timestamp().alias("ts"), "user").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
    query = token_bucket_stream(stream, "user", idle_ms=500).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).start()
    end, rows = time.monotonic() + 60, []
    while time.monotonic() < end and query.isActive:
        rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
        if rows and max(rows) > 0 and rows[-1] == 0:
            break
        time.sleep(0.3)
    query.stop()
    assert max(rows) > 0 and rows[-1] == 0


# -- observed metrics ------------------------------------------------------


def test_metrics_come_with_the_pass_that_works(spark, tmp_path):
    rows = spark.createDataFrame([("ab", None), ("c", "bad"), (None, "bad"), ("", None)], "text string, error string")
    df, seen = O.observed(rows, O.run_counts())
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_files": 4, "n_failed": 2, "n_chars": 3}
    empty, seen = O.observed(rows.limit(0), O.run_counts())
    empty.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_files": 0, "n_failed": 0, "n_chars": 0}


def test_progress_of_a_stream_is_told(spark, tmp_path):
    told = []
    listener = O.Progress(told.append)
    spark.streams.addListener(listener)
    try:
        for k in range(3):
            spark.createDataFrame([("x" * (k + 1), None)], "text string, error string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("text string, error string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = O.observed_stream(stream, O.run_counts()).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        end = time.monotonic() + 20
        while time.monotonic() < end and not any(t["step"] == "complete" for t in told):
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(listener)
    assert told[0]["step"] == "starting" and told[-1]["step"] == "complete" and told[-1]["message"] is None
    seen = [t["metrics"]["run"]["n_chars"] for t in told if t["step"] == "processing" and t["rows"]]
    assert sorted(seen) == [1, 2, 3] and O.totals(query) == {"n_files": 3, "n_failed": 0, "n_chars": 6}
    O.Progress(lambda e: 1 / 0)._tell(step="x")  # who watches can't stop the work


# -- dropped files ---------------------------------------------------------


def test_files_are_admitted_by_size_and_deleted(spark, tmp_path):
    drop, out = tmp_path / "drop", str(tmp_path / "out")
    drop.mkdir()
    for k in range(1, 6):
        (drop / f"f{k}.txt").write_bytes(b"x" * (k * 10))
    (drop / "g.tmp").write_bytes(b"y")
    for more in ((), ("late.txt",)):
        for name in more:
            (drop / name).write_bytes(b"late")
        I.ingest(I.file_stream(spark, str(drop), "*.txt", 2), out, str(tmp_path / "state"), limit=30).awaitTermination()
    names = lambda df: sorted(r.path.rpartition("/")[2] for r in df.collect())
    assert names(I.admitted(spark, out)) == ["f1.txt", "f2.txt", "f3.txt", "late.txt"]
    assert [(r.path[-6:], r.length) for r in I.refused(spark, out).orderBy("length").collect()] == [("f4.txt", 40), ("f5.txt", 50)]
    assert I.admitted(spark, out).select("batch").distinct().count() >= 2
    I.sweep(spark, out, str(drop))
    assert sorted(os.listdir(drop)) == ["g.tmp"] and I.sweep(spark, out, str(drop)) == 0
    assert I.drop_job(spark, out) and not os.path.exists(out) and not I.drop_job(spark, out)


# -- subscriptions ---------------------------------------------------------


def test_subscriptions_over_jdbc(spark, tmp_path):
    rows = spark.range(100).select("id", F.concat(F.lit("u"), "id").alias("email"), (F.col("id") % 3 == 0).alias("is_active"))
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows.write.format("jdbc").options(url=url, dbtable="subscriptions").save()
    found = T.subscriptions_jdbc(spark, url, (0, 99), 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(is_active,true)" in plan.split("PushedFilters")[1]
    assert sorted((r.id, r.email) for r in found.collect()) == sorted((r.id, r.email) for r in U.active(rows).collect())
    assert found.rdd.getNumPartitions() == 4 and T.subscriptions_jdbc(spark, url).count() == 34


def test_ids_follow_in_order_without_one_task(spark):
    rows = spark.range(1000).select((F.lit(5000) - F.col("id") * 3).alias("request_no"), F.concat(F.lit("e"), "id").alias("email"), F.lit("t").alias("search_term")).repartition(7)
    subs = spark.createDataFrame([(41, "x")], "id bigint, email string")
    got = U.insert(rows, subs).collect()
    number = {r.email: r.id for r in got}
    assert [number[f"e{k}"] for k in range(999, -1, -1)] == list(range(42, 1042))
    assert len({r.unsubscribe_token for r in got}) == 1000 and all(r.created_at is not None and r.is_active for r in got)
    assert U.insert(rows.limit(0), subs).count() == 0
    inserts, conflicts, refused = U.split_requests(spark.createDataFrame([(1, "a", "t"), (2, "", "t"), (3, "a", None), (4, "a", "t")], "request_no int, email string, search_term string"), spark.createDataFrame([], "email string, search_term string"))
    assert [r.request_no for r in inserts.collect()] == [1] and [r.request_no for r in conflicts.collect()] == [4] and sorted(r.request_no for r in refused.collect()) == [2, 3]


def test_running_text_and_digest(spark, monkeypatch):
    rows = [(c, t, f"{c}:{t} é" if t % 3 else None) for c in ("a", "b", None) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, text string").repartition(5)
    want, so_far = {}, {}
    for c, t, x in rows:
        so_far[c] = so_far.get(c, "") + (x or "")
        want[c, t] = so_far[c]
    monkeypatch.setattr(C, "RUNNING_CHARS", 50)
    assert {(r.conv_id, r.turn): r.running for r in C.running_text(df).collect()} == want
    import hashlib

    digests = {(r.conv_id, r.turn): (r.n_chars, r.running_md5) for r in C.running_digest(df).collect()}
    assert digests == {k: (len(v), hashlib.md5(v.encode()).hexdigest()) for k, v in want.items()}


def test_a_conversation_of_a_million_turns(spark):
    rows = spark.range(1_000_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("ab").alias("text"))
    assert C.running_digest(rows).agg(F.max("n_chars"), F.count("running_md5")).first()[:] == (2_000_000, 1_000_000)
