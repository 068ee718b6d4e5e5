import os

import pytest
from conftest import rows_of, write_lines
from test_ingest import EVENING, MODEL, answered, said

from turnledger.operators.pricing import price_table
from turnledger.plans import ingest as plan
from turnledger.plans.ingest import ingest
from turnledger.sources import store as stores
from turnledger.sources import totals
from turnledger.streaming.ingest import start_ingest

MORE = [said("m-1", 50), answered("m-2", 51, "ask-2"), answered("m-3", 52, "ask-3"), "{torn"]


@pytest.fixture
def prices(spark):
    return price_table(spark, [("anthropic", MODEL, 4.0, 20.0, 1.0, None)])


def stored(spark, store):
    rows = rows_of(stores.read_events(spark, store).drop("seq"))
    return sorted(rows, key=lambda row: row["id"])


def stream(spark, folder, prices, **options):
    query = start_ingest(
        spark, f"{folder}/landing", f"{folder}/store", prices, f"{folder}/checkpoint", **options
    )
    query.awaitTermination()
    assert query.exception() is None
    return query


@pytest.mark.parametrize("horizon", [None, "1 hour"])
def test_two_runs_of_the_stream_equal_one_batch_run(spark, folder, prices, horizon):
    write_lines(folder, "landing/1.jsonl", EVENING)
    stream(spark, folder, prices, copy_horizon=horizon)
    write_lines(folder, "landing/2.jsonl", MORE)
    write_lines(folder, "landing/3.jsonl", EVENING)
    stream(spark, folder, prices, copy_horizon=horizon)

    write_lines(folder, "whole/1.jsonl", EVENING)
    write_lines(folder, "whole/2.jsonl", MORE)
    ingest(spark, f"{folder}/whole", f"{folder}/expected", prices, 1)
    assert stored(spark, f"{folder}/store") == stored(spark, f"{folder}/expected")
    texts = [row["text"] for row in rows_of(stores.read_prompts(spark, f"{folder}/store"))]
    assert texts == ["rename the flag"] * 3


def test_old_records_are_never_too_late(spark, folder, prices):
    write_lines(folder, "landing/1.jsonl", [said("new", 1, timestamp="2026-08-01T00:00:00Z")])
    stream(spark, folder, prices, copy_horizon="1 minute")
    write_lines(folder, "landing/2.jsonl", [said("old", 1, timestamp="2020-01-01T00:00:00Z")])
    stream(spark, folder, prices, copy_horizon="1 minute")
    assert len(stored(spark, f"{folder}/store")) == 2


def test_the_first_line_of_a_request_counts_in_a_stream_too(spark, folder, prices):
    lines = [answered(f"a{n}", 1, "req", tokens=n + 1) for n in range(40)]
    write_lines(folder, "landing/1.jsonl", lines)
    stream(spark, folder, prices, copy_horizon="1 hour")
    counted = [row["input_tok"] for row in stored(spark, f"{folder}/store") if row["input_tok"]]
    assert counted == [1]


def test_differing_records_of_one_id_keep_the_first_line(spark, folder, prices):
    # The id does not cover the counts, so these two are one event.
    lines = [answered("same", 1, "ask", tokens=n) for n in (11, 4)]
    write_lines(folder, "landing/1.jsonl", [lines[0], lines[1], lines[1]])
    stream(spark, folder, prices, copy_horizon="1 hour")
    assert [row["input_tok"] for row in stored(spark, f"{folder}/store")] == [11]


def test_what_batches_count_is_kept(spark, folder, prices):
    write_lines(folder, "landing/1.jsonl", EVENING)
    stream(spark, folder, prices)
    write_lines(folder, "landing/2.jsonl", MORE)
    stream(spark, folder, prices)
    runs = rows_of(stores.read_runs(spark, f"{folder}/store").orderBy("run"))
    counted = [(r["new_events"], r["new_prompts"], r["skipped_unparseable"]) for r in runs]
    assert counted == [(5, 2, 1), (3, 1, 1)]


@pytest.mark.parametrize("step", ["append_notes", "append_prompts", "append_events"])
@pytest.mark.parametrize("done", [False, True])
def test_counts_of_a_batch_that_dies_on_the_way(spark, folder, prices, monkeypatch, step, done):
    """The batch runs again; its counts say what all of it added, and once."""
    write_lines(folder, "landing/1.jsonl", EVENING)
    real = getattr(plan, step)

    def fail(*args):
        if done:
            real(*args)
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(plan, step, fail)
        with pytest.raises(Exception, match="lost"):
            stream(spark, folder, prices)
    stream(spark, folder, prices)
    (run,) = rows_of(stores.read_runs(spark, f"{folder}/store"))
    counts = ("new_events", "new_prompts", "skipped_unparseable", "duplicates")
    assert [run[name] for name in counts] == [5, 2, 1, 0]
    assert len(stored(spark, f"{folder}/store")) == 5
    assert totals.read_sums(spark, f"{folder}/store").agg({"events": "sum"}).first()[0] == 5


def test_two_streams_of_one_store_count_apart(spark, folder, prices):
    for name, lines in (("a", EVENING), ("b", MORE)):
        write_lines(folder, f"{name}/1.jsonl", lines)
        place = (f"{folder}/{name}", f"{folder}/store", prices, f"{folder}/checkpoint-{name}")
        start_ingest(spark, *place).awaitTermination()
    counted = rows_of(stores.read_runs(spark, f"{folder}/store"))
    assert sorted((r["stream"][-1], r["run"], r["new_events"]) for r in counted) == [("a", 0, 5), ("b", 0, 3)]


@pytest.mark.parametrize("horizon", [None, "1 hour"])
def test_a_landed_file_ends_at_bytes_that_are_no_text(spark, folder, prices, horizon):
    for name in "12":
        path = write_lines(folder, f"landing/{name}.jsonl", [])
        with open(path, "wb") as out:
            out.write(b"\n".join([said(f"u{name}", 1).encode(), b"\xff", said(f"v{name}", 2).encode()]))
    write_lines(folder, "landing/3.jsonl", [said("w", 3)], end="")
    stream(spark, folder, prices, copy_horizon=horizon)
    assert len(stored(spark, f"{folder}/store")) == 3
    # With a horizon a batch without lines may follow.
    runs = rows_of(stores.read_runs(spark, f"{folder}/store"))
    assert sum(run["skipped_unparseable"] for run in runs) == 2


def test_a_replayed_batch_adds_nothing(spark, folder, prices):
    write_lines(folder, "landing/1.jsonl", EVENING)
    stream(spark, folder, prices)
    before = stored(spark, f"{folder}/store")
    # As after a loss between the write and the commit: the commit log is behind.
    commits = f"{folder}/checkpoint/commits"
    for name in os.listdir(commits):
        os.remove(os.path.join(commits, name))
    stream(spark, folder, prices)
    assert stored(spark, f"{folder}/store") == before
    assert stores.read_prompts(spark, f"{folder}/store").count() == 2


def test_files_are_taken_in_batches(spark, folder, prices):
    for number in range(3):
        write_lines(folder, f"landing/{number}.jsonl", [said(f"u{number}", number)])
    query = stream(spark, folder, prices, files_per_batch=1)
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    assert len(stored(spark, f"{folder}/store")) == 3


def test_shuffle_files_of_a_batch_go_with_it(spark, folder, prices, monkeypatch):
    done = []
    monkeypatch.setattr("turnledger.streaming.ingest.let_go", lambda own: done.append(own))
    for number in range(2):
        write_lines(folder, f"landing/{number}.jsonl", [said(f"u{number}", number)])
    stream(spark, folder, prices, files_per_batch=1)
    assert len(done) == 2
