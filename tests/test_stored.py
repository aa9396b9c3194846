"""Tables by key, session writes and phase runs."""

import datetime
import glob
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kgspark.operators.sessions import SessionStore
from kgspark.plans import runs
from kgspark.plans.runs import PhaseRuns
from kgspark.sources.keyed import KeyedTable, buckets_for

SCHEMA = "doc_id long, n int, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(table, value=None):
    return sorted((tuple(r) for r in table.read(value).collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=4)


def test_put_replaces_keys_and_append_adds(spark, table):
    assert held(table) == []
    assert table.put(frame(spark, [(d, k, "old") for d in range(6) for k in range(3)] + [(None, 0, None)]), "1")
    table.put(frame(spark, [(2, 9, "new"), (None, 1, "new")]), "2")
    table.put(frame(spark, []), "3", keys=frame(spark, [(4, 0, ""), (77, 0, "")]))
    table.append(frame(spark, [(2, 10, "more"), (4, 1, "back")]), "4")
    want = [(d, k, "old") for d in (0, 1, 3, 5) for k in range(3)] + [(2, 9, "new"), (2, 10, "more"), (4, 1, "back"), (None, 1, "new")]
    assert held(table) == sorted(want, key=repr)
    assert held(table, 2) == [(2, 10, "more"), (2, 9, "new")] and held(table, 77) == []


def test_a_batch_is_stored_once(spark, table):
    rows = frame(spark, [(1, 1, "a"), (1, 1, "a")])
    assert table.append(rows, "b") and not table.append(rows, "b") and not table.put(rows, "b")
    assert held(table) == [(1, 1, "a"), (1, 1, "a")]


def test_an_attempt_without_its_line_is_not_seen(spark, table):
    table.append(frame(spark, [(1, 1, "a")]), "1")
    table._write(frame(spark, [(1, 2, "cut off"), (2, 2, "cut off")]), "rows", "an attempt that died")
    table._write(frame(spark, [(1, 2, "cut off")]).select("doc_id"), "keys", "an attempt that died")
    assert held(table) == [(1, 1, "a")]
    table.put(frame(spark, [(1, 2, "done")]), "2")
    assert held(table) == [(1, 2, "done")]


def test_replacing_a_document_writes_its_bucket_only(spark, table):
    table.put(frame(spark, [(d, 0, "old") for d in range(200)]), "1")
    files = lambda: {f: os.path.getmtime(f) for f in glob.glob(f"{table.path}/rows/**/*.parquet", recursive=True)}
    before = files()
    table.put(frame(spark, [(17, 1, "new")]), "2")
    after = files()
    assert all(after[f] == t for f, t in before.items())
    assert len({os.path.dirname(f) for f in set(after) - set(before)}) == 1


def test_compaction_keeps_the_rows(spark, table, tmp_path):
    for k in range(5):
        table.put(frame(spark, [(d, k, f"v{k}") for d in range(k, 20)]), f"p{k}")
    table.put(frame(spark, []), "gone", keys=frame(spark, [(19, 0, "")]))
    before = held(table)
    assert table.compact(3) and held(table) == before
    assert {r.n for r in table.batches().collect()} == {1} and table.compact(3) == []
    table.put(frame(spark, [(3, 9, "after"), (19, 9, "after")]), "p9")
    table.append(frame(spark, [(4, 9, "after")]), "a9")
    want = [r for r in before if r[0] != 3] + [(3, 9, "after"), (19, 9, "after"), (4, 9, "after")]
    assert held(table) == sorted(want, key=repr)
    assert held(KeyedTable(spark, str(tmp_path / "t"), SCHEMA, buckets=99)) == held(table)


def test_buckets_follow_the_bytes(spark):
    rows = spark.range(1000).select("id", F.lit("x" * 100).alias("text"), F.array("id").alias("list"))
    assert buckets_for(rows, 10_000) > buckets_for(rows, 50_000) > 1 == buckets_for(rows) == buckets_for(rows.limit(0))


def at(second):
    return datetime.datetime(2024, 1, 1, 0, 0, second)


def test_messages_move_updated_at_once(spark, tmp_path):
    sessions = KeyedTable(spark, str(tmp_path / "s"), "session_id long, created_at timestamp, updated_at timestamp, url string", "session_id")
    schema = "session_id long, id long, ts timestamp, role string, content string"
    store = SessionStore(sessions, KeyedTable(spark, str(tmp_path / "m"), schema, "session_id"))
    message = lambda s, i, t: (s, i, at(t), "user", "x")
    some = lambda *rows: spark.createDataFrame(list(rows), schema)
    store.create(spark.createDataFrame([(1, at(0), "a"), (2, at(0), "b")], "session_id long, created_at timestamp, url string"), "new")
    first, second = some(message(1, 1, 5), message(1, 2, 9), message(3, 1, 7)), some(message(1, 3, 4), message(2, 1, 6))
    assert store.add_messages(first, "m1") and not store.add_messages(first, "m1")
    # Cut off between the two tables: the messages are there, the sessions aren't moved.
    store.messages.append(second, "m2")
    assert store.add_messages(second, "m2")
    assert store.messages.read().count() == 5
    assert {(r.session_id, r.updated_at.second, r.url) for r in sessions.read().collect()} == {(1, 9, "a"), (2, 6, "b")}
    store.delete(spark.createDataFrame([(1,)], "session_id long"), "d")
    assert {r.session_id for r in sessions.read().collect()} == {2} and {r.session_id for r in store.messages.read().collect()} == {2, 3}


# Runs ---------------------------------------------------------------------------



def upper(rows: pd.DataFrame) -> pd.DataFrame:
    if (rows["text"] == "bad").any():
        raise ValueError("bad text")
    return rows.assign(text=rows["text"].str.upper())


def log_of(runs_, phase="p"):
    return {(r.doc_id, r.turn, r.status, r.error, r.n_rows) for r in runs_.history(phase).collect()}


def test_documents_fail_alone_and_are_done_once(spark, tmp_path, table):
    made = PhaseRuns(spark, str(tmp_path / "runs"))
    step = runs.isolated(upper, SCHEMA)
    rows = [(d, k, "bad" if d == 3 and k else "text") for d in range(5) for k in range(2)]
    wanted = spark.createDataFrame([(d,) for d in (0, 3, 4, 9)], "doc_id long")
    assert made.run("p", frame(spark, rows), step, table, wanted, parts=3) == 4
    one = {(0, 1, "done", None, 2), (4, 1, "done", None, 2), (3, 1, "failed", "ValueError: bad text", 0), (9, 1, "missing", "no input", 0)}
    assert log_of(made) == one and {r[0] for r in held(table)} == {0, 4}
    # The rest and what failed; document 4 has changed.
    changed = [r for r in rows if r[0] != 4] + [(4, 0, "changed")]
    assert made.run("p", frame(spark, changed), step, table) == 4
    two = {(1, 2, "done", None, 2), (2, 2, "done", None, 2), (4, 2, "done", None, 1), (3, 2, "failed", "ValueError: bad text", 0)}
    assert log_of(made) == one | two and [r for r in held(table) if r[0] == 4] == [(4, 0, "CHANGED")]
    mended = [(d, k, "text" if d == 3 else t) for d, k, t in changed]
    assert made.run("p", frame(spark, mended), step, table) == 1
    assert made.run("p", frame(spark, mended), step, table) == 0
    assert made.run("other phase", frame(spark, mended), step, table) == 5
    assert {(r.doc_id, r.status) for r in made.latest("p").collect()} == {(0, "done"), (1, "done"), (2, "done"), (3, "done"), (4, "done"), (9, "missing")}


def test_a_failed_document_keeps_its_results(spark, tmp_path, table):
    made, step = PhaseRuns(spark, str(tmp_path / "runs")), runs.isolated(upper, SCHEMA)
    made.run("p", frame(spark, [(1, 0, "good")]), step, table)
    made.run("p", frame(spark, [(1, 0, "bad")]), step, table)
    assert held(table) == [(1, 0, "GOOD")] and made.latest("p").first()["status"] == "failed"


def test_a_run_is_taken_up_where_it_was_cut_off(spark, tmp_path, table):
    made = PhaseRuns(spark, str(tmp_path / "runs"))
    rows, seen = frame(spark, [(d, 0, "x") for d in range(40)]), []

    def step(some):
        ids = {r.doc_id for r in some.collect()}
        if len(seen) == 2:
            seen.append(set())
            raise KeyboardInterrupt
        seen.append(ids)
        return some, some.limit(0).select("doc_id", F.lit("").alias("error"))

    with pytest.raises(KeyboardInterrupt):
        made.run("p", rows, step, table, parts=4)
    n = made.run("p", rows, step, table, parts=4)
    assert n == 40 - len(seen[0] | seen[1]) > 0
    done = [d for ids in seen for d in ids]
    assert sorted(done) == list(range(40)) and len(held(table)) == 40


def test_documents_that_break_the_job_are_found(spark, tmp_path, table):
    made = PhaseRuns(spark, str(tmp_path / "runs"))
    rows = frame(spark, [(d, 0, "x" if d == 11 else str(d)) for d in range(60)])

    def step(some):
        return some.withColumn("n", F.col("text").cast("int")), some.limit(0).select("doc_id", F.lit("").alias("error"))

    made.run("p", rows, step, table)
    last = {r.doc_id: (r.status, r.error) for r in made.latest("p").collect()}
    failed = {d for d, (status, _) in last.items() if status == "failed"}
    assert 11 in failed and len(failed) <= 6 and len(last) == 60 and "broke" in last[11][1]
    assert {r[0] for r in held(table)} == set(range(60)) - failed


def test_no_documents(spark, tmp_path, table):
    made = PhaseRuns(spark, str(tmp_path / "runs"))
    assert made.run("p", frame(spark, []), runs.isolated(upper, SCHEMA), table) == 0 and held(table) == []


def test_digests_follow_the_rows_not_their_order(spark):
    a = [(1, 0, "a"), (1, 1, None), (2, 0, "b"), (2, 0, "b")]
    digest = lambda rows: {r.doc_id: r.digest for r in runs.input_digests(frame(spark, rows).withColumn("m", F.array("n"))).collect()}
    assert digest(a) == digest(a[::-1])
    assert digest(a)[2] != digest(a[:3])[2] and digest(a)[1] != digest([(1, 0, "a"), (1, 2, None)])[1]
