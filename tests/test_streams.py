"""Streams and sinks: the change feed with replays, event frames with their rest, stored history."""

import random
import time

import pytest
from pyspark.sql import functions as F

from casestream.operators import chat as C
from casestream.operators import payload as P
from casestream.plans import analysis
from casestream.session import scratch
from casestream.sources.versioned import VersionedTable
from casestream.streaming import change_feed
from casestream.streaming.change_feed import check_batch
from casestream.streaming.frames import OUT, finished_frames, frame_stream

SUBS = "id bigint, email string, search_term string, last_seen_case_identifier string, is_active boolean, created_at timestamp, unsubscribe_token string"
ENTRIES = "search_term string, result_pos int, title string, case_number string, court string, date string, detail_link string, document_download_link string, document_link_text string"


def feed(spark):
    folder = scratch(spark, "feed-test")
    subs = [(1, "a", "t", None, True, None, "x"), (2, "b", "t", "2 - d", True, None, "y"), (3, "c", "u", None, True, None, "z"), (4, "d", "t", None, False, None, "w"), (5, "e", "v", None, True, None, "v")]
    cursor = VersionedTable.create(spark.createDataFrame(subs, SUBS), f"{folder}/cursor", ["id"], buckets=4)
    rows = [("t", 0, "new", "1", "c", "d", "l", None, None), ("t", 1, "older", "2", "c", "d", "l", "url", None), ("u", 0, "other", "9", "c", "d", "l", "", None), ("v", 0, "third", "7", "c", "d", "l", "url", None)]
    return folder, cursor, spark.createDataFrame(rows, ENTRIES)


def seen(cursor):
    return {r.id: r.last_seen_case_identifier for r in cursor.read().collect()}


def outbox(spark, folder, batch):
    return sorted(r.subscription_id for r in spark.read.parquet(f"{folder}/outbox/mail/batch={batch}").collect())


def test_notices_are_of_the_newest_entry_with_documents(spark):
    folder, cursor, entries = feed(spark)
    analysed = []

    def analyse(cases):
        analysed.extend(sorted(r.case_number for r in cases.collect()))
        return cases.selectExpr("search_term", "concat('About ', case_number) AS analysis")

    check_batch(entries, 0, cursor, f"{folder}/outbox", analyse=analyse)
    assert seen(cursor) == {1: "2 - d", 2: "2 - d", 3: None, 4: None, 5: "7 - d"}
    mail = {m.subscription_id: m.body for m in spark.read.parquet(f"{folder}/outbox/mail").collect()}
    assert set(mail) == {1, 5} and "About 2" in mail[1] and analysed == ["2", "7"]


def test_failed_deliveries_come_again_and_replays_keep_the_outbox(spark):
    folder, cursor, entries = feed(spark)
    check_batch(entries, 0, cursor, f"{folder}/outbox", deliver=lambda mail: mail.where("subscription_id = 5"))
    assert seen(cursor)[1] is None and seen(cursor)[5] == "7 - d"
    check_batch(entries, 0, cursor, f"{folder}/outbox")  # applied: nothing is sent or written again
    assert seen(cursor)[1] is None and outbox(spark, folder, 0) == [1, 5]
    handed = []

    def deliver(mail):
        handed.extend(r.subscription_id for r in mail.collect())
        return mail

    check_batch(entries.limit(0), 1, cursor, f"{folder}/outbox", deliver)  # nothing new: the notice that failed
    assert handed == [1] and seen(cursor)[1] == "2 - d"
    check_batch(entries.limit(0), 2, cursor, f"{folder}/outbox", deliver)
    assert handed == [1] and outbox(spark, folder, 0) == [1, 5] and outbox(spark, folder, 2) == []


def test_a_newer_notice_and_an_unsubscription_replace_what_waits(spark):
    folder, cursor, entries = feed(spark)
    check_batch(entries, 0, cursor, f"{folder}/outbox", deliver=lambda mail: mail.limit(0))
    gone = cursor.read().where("id = 5").withColumn("is_active", F.lit(False))
    cursor.upsert(gone)
    newer = spark.createDataFrame([("t", 0, "newest", "3", "c", "d", "l", "url", None)], ENTRIES)
    check_batch(newer, 1, cursor, f"{folder}/outbox")
    mail = spark.read.parquet(f"{folder}/outbox/mail/batch=1").collect()
    assert sorted((m.subscription_id, m.identifier) for m in mail) == [(1, "3 - d"), (2, "3 - d")]
    assert seen(cursor) == {1: "3 - d", 2: "3 - d", 3: None, 4: None, 5: None}


def test_one_failing_analysis_holds_up_its_own_term(spark):
    folder, cursor, entries = feed(spark)
    down = {"t"}

    def analyse(cases):
        bad = F.col("search_term").isin(*down) if down else F.lit(False)
        return cases.select("search_term", F.when(~bad, F.concat(F.lit("About "), "case_number")).alias("analysis"), F.when(bad, F.lit("down")).alias("error"))

    check_batch(entries, 0, cursor, f"{folder}/outbox", analyse=analyse)
    assert outbox(spark, folder, 0) == [5] and seen(cursor)[1] is None
    check_batch(entries.limit(0), 1, cursor, f"{folder}/outbox", analyse=analyse)  # still down
    down.clear()
    check_batch(entries.limit(0), 2, cursor, f"{folder}/outbox", analyse=analyse)
    assert outbox(spark, folder, 1) == [] and outbox(spark, folder, 2) == [1]
    assert seen(cursor) == {1: "2 - d", 2: "2 - d", 3: None, 4: None, 5: "7 - d"}


@pytest.mark.parametrize("step", ["due", "mail", "sent", "bucket", "manifest"])
def test_a_stop_after_every_write(spark, monkeypatch, step):
    """The batch stops right after a write, runs again, and neither loses nor repeats a notice."""
    folder, cursor, entries = feed(spark)
    handed = []

    def deliver(mail):
        handed.extend(r.subscription_id for r in mail.collect())
        return mail

    class Stop(Exception):
        pass

    def stop(*_):
        raise Stop

    with monkeypatch.context() as m, pytest.raises(Stop):
        if step == "due":
            m.setattr(change_feed, "mail_outbox", stop)
        elif step == "mail":
            m.setattr(change_feed.Folder, "complete", lambda self, name, real=change_feed.Folder.complete: stop() if name.startswith("sent") and real(self, "mail/batch=0") else real(self, name))
        elif step == "sent":
            m.setattr(VersionedTable, "update", stop)
        elif step == "bucket":
            m.setattr(VersionedTable, "_publish", stop)
        else:
            real = VersionedTable._publish
            m.setattr(VersionedTable, "_publish", lambda self, manifest: (real(self, manifest), stop()))
        check_batch(entries, 0, cursor, f"{folder}/outbox", deliver)
    if step != "manifest":
        assert seen(cursor)[1] is None and cursor.versions() == [0]  # what is half-written isn't read
    check_batch(entries, 0, cursor, f"{folder}/outbox", deliver)
    assert sorted(handed) == [1, 5] and outbox(spark, folder, 0) == [1, 5]
    assert seen(cursor) == {1: "2 - d", 2: "2 - d", 3: None, 4: None, 5: "7 - d"} and cursor.versions() == [0, 1]


def test_frames_of_a_stream_end_with_their_rest(spark, tmp_path):
    text = 'data: {"a":1}\n\nnoise\n\ndata: {"b":2}\n\ndata: {"c":3}'
    chunks = [(7, k, text[k * 9 : k * 9 + 9], k == len(text) // 9) for k in range(len(text) // 9 + 1)]
    schema = "conv_id bigint, seq bigint, chunk string, ended boolean"
    rows = spark.createDataFrame(chunks, schema)
    for part in range(3):
        rows.where(f"seq % 3 = {part}").orderBy("seq").coalesce(1).write.parquet(str(tmp_path / "all" / f"p={part}"))
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "all" / "p=*"))
    frame_stream(source).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted((r.frame_no, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, '{"a":1}'), (2, '{"b":2}'), (3, '{"c":3}')]
    batch = sorted((r.frame_no, r.payload) for r in C.frames(rows).collect())
    assert batch == got


def run_frames(spark, tmp_path, batches, patience_ms=None, name="f"):
    """The frames of chunks that come in the given micro-batches."""
    schema = "conv_id bigint, seq bigint, chunk string, ended boolean"
    source, out = tmp_path / name / "in", str(tmp_path / name / "out")
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        writer = frame_stream(stream, patience_ms=patience_ms).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / name / "state"))
        writer.trigger(availableNow=True).start(out).awaitTermination()
        yield k, spark.read.parquet(out)


def test_chunks_in_any_order_over_micro_batches(spark, tmp_path):
    rng = random.Random(6)
    texts = {c: "".join(f"data: {{\"n\": {k}}}\n\n" if k % 3 else "noise\n\n" for k in range(30)) + f"data: rest {c}" for c in range(4)}
    chunks = [(c, k, t[5 * k : 5 * k + 5], k == (len(t) - 1) // 5) for c, t in texts.items() for k in range((len(t) - 1) // 5 + 1)]
    rows = spark.createDataFrame(chunks, "conv_id bigint, seq bigint, chunk string, ended boolean")
    want = sorted((str(r.conv_id), r.frame_no, r.payload) for r in C.frames(rows).collect())
    rng.shuffle(chunks)
    again = [(c, k, t, e) for c, k, t, e in chunks[:40] if not e]  # chunks that come twice count once
    cuts = [chunks[:150], again + chunks[150:300] + [(0, None, "lost", False)], chunks[300:]]
    for _, got in run_frames(spark, tmp_path, cuts):
        rows = sorted((r.key, r.frame_no, r.payload) for r in got.collect())
    assert rows == want
    left = spark.read.format("statestore").option("stateVarName", "waiting").option("flattenCollectionTypes", "true").load(str(tmp_path / "f" / "state"))
    assert left.count() == 0  # nothing waits any more


def test_gaps_wait_and_can_be_given_up(spark, tmp_path):
    first, gap = [(1, 0, "data: a\n\nda", False), (1, 2, "data: c\n\n", True)], [(1, 1, "ta: b\n\n", False)]
    seen = [sorted((r.frame_no, r.payload) for r in got.collect()) for _, got in run_frames(spark, tmp_path, [first, gap], name="late")]
    assert seen == [[(0, "a")], [(0, "a"), (1, "b"), (2, "c")]]
    rows = [*first, (2, 0, "data: x\n\n", True), (3, 0, "data: y", False)]
    schema, folder = "conv_id bigint, seq bigint, chunk string, ended boolean", tmp_path / "lost"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "in"))
    out = frame_stream(spark.readStream.schema(schema).parquet(str(folder / "in")), patience_ms=1)
    # A clock of its own: such a query runs on, so it is watched and stopped.
    got = []
    query = out.writeStream.foreachBatch(lambda df, _: got.extend(df.collect())).option("checkpointLocation", str(folder / "state")).start()
    end = time.monotonic() + 60
    while time.monotonic() < end and query.isActive and not any(r.error for r in got):
        time.sleep(0.2)
    query.stop()
    assert {(r.key, r.frame_no, r.error) for r in got if r.error} == {("1", 1, "chunk 1 is missing")}
    assert sorted(r.payload for r in finished_frames(spark.createDataFrame(got, OUT)).collect()) == ["x"]


def test_history_and_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(60)], "conv_id bigint, turn bigint, role string, text string")
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert C.read_history(spark, str(tmp_path / "none"), schema).count() == 0
    C.write_history(rows, str(tmp_path / "h"))
    assert sorted(r.turn for r in C.read_history(spark, str(tmp_path / "h"), schema).collect()) == list(range(10, 60))
    P.write_exports(spark.createDataFrame([("a.md", "# A")], "file_name string, content string"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).first().content == "# A"


def test_chat_turns_keep_failures(spark):
    def broken():
        def reply(chat):
            raise RuntimeError("down")

        return reply

    rows = spark.createDataFrame([(1, 0, "user", "hi")], "conv_id bigint, turn bigint, role string, content string")
    (got,) = analysis.chat_turn(rows, broken).collect()
    assert (got.reply, got.error) == (None, "down")
    (frame,) = C.encode_frames(rows, ["role"]).collect()
    assert frame.frame == 'data: {"role":"user"}\n\n'


class _Held:
    """A state of one key that counts the calls to it."""

    def __init__(self, calls):
        self.calls, self.value, self.map = calls, None, {}

    def __getattr__(self, name):
        plain = {
            "get": lambda: self.value, "update": lambda x: setattr(self, "value", x), "clear": lambda: (setattr(self, "value", None), self.map.clear()),
            "getValue": self.map.get, "updateValue": self.map.__setitem__, "removeKey": lambda k: self.map.pop(k, None),
        }[name]
        return lambda *a: (self.calls.append(name), plain(*a))[1]


class _Handle:
    def __init__(self):
        self.calls = []

    def getValueState(self, *_):
        return _Held(self.calls)

    getMapState = getValueState


def test_a_client_costs_two_state_calls_a_batch():
    from pyspark.sql import Row

    from casestream.operators.limits import Bucket
    from casestream.streaming.token_bucket import BucketProcessor

    handle, made = _Handle(), BucketProcessor(Bucket(2, 1000), Bucket(1, 100), expire=False)
    made.init(handle)
    one = list(made.handleInputRows(("a",), iter([Row(key="a", event_id=2, now=500), Row(key="a", event_id=1, now=0)]), None))
    two = list(made.handleInputRows(("a",), iter([Row(key="a", event_id=3, now=550)]), None))
    assert [(r.event_id, r.reason) for r in one + two] == [(1, "ok"), (2, "ok"), (3, "hour")] and handle.calls == ["get", "update"] * 2


def test_chunks_in_order_cost_two_state_calls_a_batch():
    from pyspark.sql import Row

    from casestream.streaming.frames import FrameProcessor

    def take(*chunks):
        handle.calls.clear()
        rows = iter([Row(key="a", seq=s, chunk=c, ended=e) for s, c, e in chunks])
        return [(r.frame_no, r.payload) for r in made.handleInputRows(("a",), rows, None)], list(handle.calls)

    handle, made = _Handle(), FrameProcessor()
    made.init(handle)
    assert take((0, "data: x\n", False)) == ([], ["get", "update"])
    assert take((1, "\ndata: y", False), (3, "data: z\n\n", True))[0] == [(0, "x")]  # 3 waits
    assert take((2, "\n\n", False))[0] == [(1, "y"), (2, "z")]
    assert made.place.value is None and not made.waiting.map
