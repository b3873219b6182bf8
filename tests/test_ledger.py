import datetime as dt
import json

import pytest

from tasksieve.operators.ledger import ReviewLedger, id_prefix
from tasksieve.schema import REVIEW_EVENTS
from tasksieve.streaming.decisions import DecisionStream

DAY = dt.datetime(2024, 5, 1, 12)


def decision(number, task_id="a", reviewer="r1", status="accepted", rationale="because", hours=0):
    return (number, task_id, reviewer, status, rationale, DAY + dt.timedelta(hours=hours))


@pytest.fixture
def events_of(spark):
    return lambda *rows: spark.createDataFrame(list(rows), REVIEW_EVENTS)


@pytest.fixture
def book(spark, task, tasks_of, tmp_path):
    ledger = ReviewLedger(spark, str(tmp_path / "ledger"))
    ledger.import_tasks(tasks_of(task("a"), task("b")))
    return ledger


def test_import_ignores_known_ids(spark, task, tasks_of, book):
    assert book.import_tasks(tasks_of(task("b", title="new"), task("c", title="one"), task("c", title="two"))) == 1
    stored = {r.task_id: json.loads(r.task_json) for r in book.tasks().collect()}
    assert set(stored) == {"a", "b", "c"}
    assert stored["b"]["title"] == "Add up b" and stored["c"]["title"] == "one"
    assert stored["a"] == task("a")


def test_record_takes_valid_decisions_only(book, events_of):
    rejects = book.record(events_of(
        decision(1), decision(2, reviewer=" "), decision(3, rationale=None), decision(4, status="unreviewed"),
        decision(5, status="other"), decision(6, task_id="zz"), decision(7, task_id="zz", reviewer=""),
        decision(8, status="rejected"),
    ))
    assert {r.event_id: r.reject_reason for r in rejects.collect()} == {
        2: "missing_reviewer_or_rationale", 3: "missing_reviewer_or_rationale", 4: "unreviewed_status",
        5: "unknown_status", 6: "unknown_task", 7: "missing_reviewer_or_rationale",
    }
    assert [r.status for r in book.history("a").collect()] == ["accepted", "rejected"]
    assert book.history("b").count() == 0 and book.history("zz").count() == 0


def test_decisions_without_ids_are_numbered_on(book, events_of):
    book.record(events_of(decision(41)))
    book.record(events_of(decision(0, status="revised")).drop("event_id", "created_at"))
    rows = book.history("a").collect()
    assert [r.status for r in rows] == ["accepted", "revised"] and rows[1].created_at is not None
    assert sorted(r.event_id for r in book.events().collect())[1] > 41


def test_strict_record_raises_and_stores_nothing(book, events_of):
    with pytest.raises(KeyError):
        book.record(events_of(decision(1), decision(2, task_id="zz")), strict=True)
    with pytest.raises(ValueError, match="unreviewed_status"):
        book.record(events_of(decision(1), decision(2, status="unreviewed")), strict=True)
    assert book.events().count() == 0


def run(stream, spark, folder):
    stream.start(spark.readStream.schema(REVIEW_EVENTS).parquet(folder)).awaitTermination()


@pytest.mark.parametrize("watermark", [None, "2 hours"])
def test_stream_equals_batch_with_replays_and_restarts(spark, book, events_of, tmp_path, watermark):
    inbox = str(tmp_path / "inbox")
    rows = [decision(1), decision(2, reviewer=""), decision(3, task_id="b", status="revised", hours=1),
            decision(4, task_id="zz", hours=1)]
    events_of(*rows[:2], rows[0]).coalesce(1).write.mode("append").parquet(inbox)
    checkpoint = str(tmp_path / "checkpoint")
    run(DecisionStream(book, checkpoint, watermark), spark, inbox)
    # Restart from the checkpoint; two old events are delivered again.
    events_of(*rows).coalesce(1).write.mode("append").parquet(inbox)
    stream = DecisionStream(book, checkpoint, watermark)
    run(stream, spark, inbox)
    assert sorted(r.event_id for r in book.events().collect()) == [1, 3]
    assert {r.event_id: r.reject_reason for r in book.rejects().collect()} == {
        2: "missing_reviewer_or_rationale", 4: "unknown_task",
    }
    # The same batch run again, as after a crash before the commit, changes nothing.
    stream._store(events_of(*rows), 1)
    assert sorted(r.event_id for r in book.events().collect()) == [1, 3]
    # History shows streamed decisions, and recording them again adds nothing.
    assert [r.status for r in book.history("b").collect()] == ["revised"]
    assert book.record(events_of(*rows)).count() == 0
    assert sorted(r.event_id for r in book.judged().collect()) == [1, 2, 3, 4]
    book.record(events_of(decision(9, task_id="b")).drop("event_id"))
    assert sorted(r.event_id for r in book.events().collect())[2] > 4
    assert [r.status for r in book.history("b").collect()] == ["revised", "accepted"]


def test_recording_twice_stores_once_and_the_first_delivery_wins(book, events_of):
    batch = events_of(decision(1, rationale="z"), decision(1, rationale="a"), decision(2, task_id="zz"))
    assert book.record(batch).count() == 1
    assert book.record(batch).count() == 0
    assert [(r.event_id, r.rationale) for r in book.events().collect()] == [(1, "a")]


def test_an_id_delivered_again_under_another_day_is_the_same_event(book, events_of):
    book.record(events_of(decision(1), decision(2)))
    assert book.record(events_of(decision(1, hours=300, rationale="later"), decision(2, task_id="zz", hours=-90))).count() == 0
    assert sorted((r.event_id, r.rationale, r.created_at) for r in book.judged().collect()) == [(1, "because", DAY), (2, "because", DAY)]


def test_events_without_an_id_are_rejected_one_by_one(book, events_of):
    rows = events_of(decision(None), decision(None), decision(None, reviewer=""), decision(5))
    assert sorted(r.reject_reason for r in book.record(rows).collect()) == ["missing_event_id"] * 2 + ["missing_reviewer_or_rationale"]
    assert [r.event_id for r in book.events().collect()] == [5]


def input_files(frame):
    return {name.rsplit("/", 1)[1] for name in frame.inputFiles()}


def test_a_batch_reads_only_the_index_files_its_ids_can_be_in(spark, task, tasks_of, tmp_path, events_of):
    ledger = ReviewLedger(spark, str(tmp_path / "ledger"), file_rows=100)
    ledger.import_tasks(tasks_of(task("a")))
    ledger.store(events_of(*(decision(i) for i in range(8000))), "load-0")
    manifest = ledger.runs.manifest()
    index = manifest.runs[0]["files"]["ids"]
    assert len(index) == 10 and all(a["high"] <= b["low"] for a, b in zip(index, index[1:]))
    prefixes = [r.prefix for r in events_of(decision(17), decision(4711)).select(id_prefix()).collect()]
    known = ledger._known_ids(manifest, prefixes)
    assert len(input_files(known)) <= 2 and known.where("event_id IN (17, 4711)").count() == 2
    assert ledger.record(events_of(decision(17, hours=5), decision(4711, hours=9))).count() == 0
    assert ledger.judged().count() == 8000


def test_many_small_batches_leave_few_files(spark, task, tasks_of, tmp_path, events_of):
    """There are at most fan_in runs a tier, and a look-up opens at most one file of each."""
    ledger = ReviewLedger(spark, str(tmp_path / "ledger"), fan_in=3, grace_seconds=0)
    ledger.import_tasks(tasks_of(*(task(f"t{i}") for i in range(5))))
    for n in range(14):
        ledger.store(events_of(*(decision(10 * n + i, task_id=f"t{i}") for i in range(5))), f"s-{n}")
    runs = ledger.runs.manifest().runs
    tiers = [r["tier"] for r in runs]
    assert max(tiers.count(t) for t in tiers) <= 3 and max(tiers) == 2
    assert len(list((tmp_path / "ledger/log").rglob("*.parquet"))) <= 2 * len(runs)
    assert len(list((tmp_path / "ledger/log/manifests").glob("0*"))) <= ledger.runs.keep_manifests
    opened = ledger.runs.read(ledger.runs.manifest(), "events", keys=["t3"])
    assert len(input_files(opened)) <= len(runs)
    assert ledger.history("t3").count() == 14 and ledger.judged().count() == 70
    assert ledger.store(events_of(decision(3, task_id="t1")), "s-14").count() == 0


def test_of_two_writers_the_second_sees_the_ids_of_the_first(spark, book, events_of, monkeypatch):
    other = ReviewLedger(spark, book.path)
    commit, done = book.runs.commit, []

    def overtaken(base, *rest):
        if not done:
            done.append(other.store(events_of(decision(1, rationale="first")), "other-0"))
        return commit(base, *rest)

    monkeypatch.setattr(book.runs, "commit", overtaken)
    assert [r.event_id for r in book.store(events_of(decision(1, rationale="second"), decision(2)), "own-0").collect()] == [2]
    assert sorted((r.event_id, r.rationale) for r in book.events().collect()) == [(1, "first"), (2, "because")]


def test_readers_of_an_older_manifest_can_finish(spark, task, tasks_of, tmp_path, events_of):
    ledger = ReviewLedger(spark, str(tmp_path / "ledger"), fan_in=2)
    ledger.import_tasks(tasks_of(task("a")))
    ledger.store(events_of(decision(1)), "s-0")
    before = ledger.judged()
    ledger.store(events_of(decision(2)), "s-1")
    assert ledger.runs.compact() == 1
    assert [r["tier"] for r in ledger.runs.manifest().runs] == [1]
    assert [r.event_id for r in before.collect()] == [1]


def test_an_empty_batch_and_events_without_a_time(book, events_of):
    assert book.record(events_of(decision(1)).limit(0)).count() == 0 and book.events().count() == 0
    unknown_time = (7, "a", "r1", "accepted", "because", None)
    book.record(events_of(unknown_time))
    book.record(events_of(unknown_time))
    assert [r.created_at for r in book.events().collect()] == [None]
    book.record(events_of(decision(8)).drop("created_at"))
    book.record(events_of(decision(8)).drop("created_at"))
    assert sorted(r.event_id for r in book.events().collect()) == [7, 8]


def test_late_events_are_kept_without_a_watermark(spark, book, events_of, tmp_path):
    inbox, checkpoint = str(tmp_path / "inbox"), str(tmp_path / "checkpoint")
    events_of(decision(1, hours=100)).write.mode("append").parquet(inbox)
    run(DecisionStream(book, checkpoint), spark, inbox)
    events_of(decision(2, hours=0)).write.mode("append").parquet(inbox)
    run(DecisionStream(book, checkpoint), spark, inbox)
    assert sorted(r.event_id for r in book.events().collect()) == [1, 2]
