import json
import os

import pytest
from conftest import AUG, one, rows_of, write_lines
from pyspark.sql import functions as F

from turnledger.functions.clock import Window
from turnledger.operators.pricing import price_table
from turnledger.plans import ingest as plan
from turnledger.plans.ingest import Source, ingest
from turnledger.sources import store as stores
from turnledger.sources import transcripts
from turnledger.sources.transcripts import (
    changed_files,
    list_files,
    parse_lines,
    read_lines,
    source_sessions,
)

MODEL = "lantern-large"


def entry(kind, uuid, when, **fields):
    """A transcript line of one session; ``when`` is a full time or a second."""
    stamp = when if isinstance(when, str) else f"2026-03-30T22:15:{when:02}.250Z"
    own = {"type": kind, "uuid": uuid, "timestamp": stamp, "sessionId": "evening", "cwd": "/srv/blue"}
    return json.dumps(own | fields)


def said(uuid, when, text="rename the flag", **fields):
    return entry("user", uuid, when, message={"content": text}, **fields)


def answered(uuid, when, request, tokens=40, **fields):
    used = {"type": "tool_use", "name": "Grep", "input": {"pattern": f"flag_{uuid}"}}
    message = {
        "model": MODEL,
        "usage": {"input_tokens": tokens, "output_tokens": 3, "cache_read_input_tokens": 7},
        "content": [used, {"type": "tool_use", "name": "Bash", "input": {}}],
    }
    return entry("assistant", uuid, when, requestId=request, message=message, **fields)


# An evening that runs into another month, with one request on both sides of it.
EVENING = [
    said("p-10", "2026-03-30T22:15:04Z"),
    answered("r-11", "2026-03-30T22:15:40Z", "ask-1", tokens=25),
    answered("r-12", "2026-03-31T23:59:58Z", "ask-2"),
    "[1, 2",
    answered("r-13", "2026-04-01T00:00:03Z", "ask-2", tokens=90),
    json.dumps({"type": "summary", "leafUuid": "r-13"}),
    said("p-14", "2026-04-01T08:00:00Z", isSidechain=True),
]


@pytest.fixture
def prices(spark):
    return price_table(spark, [("anthropic", MODEL, 4.0, 20.0, 1.0, None)])


def stored(spark, store):
    """What the store says, apart from row numbers."""
    rows = rows_of(stores.read_events(spark, store).drop("seq"))
    return sorted(rows, key=lambda row: row["id"])


def run(spark, folder, prices, now=1, **options):
    return one(ingest(spark, f"{folder}/logs", f"{folder}/store", prices, now, **options))


def test_an_evening(spark, folder, prices):
    write_lines(folder, "logs/blue/1.jsonl", EVENING)
    write_lines(folder, "logs/blue/1.jsonl.bak", ["of no concern"])
    assert run(spark, folder, prices) == {
        "adapter": "claude-code",
        "files_seen": 1,
        "files_read": 1,
        "new_events": 5,
        "new_prompts": 2,
        "skipped_unparseable": 1,
        "skipped_oversized": 0,
        "duplicates": 0,
        "unreadable_files": 0,
        "cursors_written": True,
    }
    rows = rows_of(stores.read_events(spark, f"{folder}/store").orderBy("ts"))
    assert [row["month"] for row in rows] == ["2026-03"] * 3 + ["2026-04"] * 2
    assert [row["input_tok"] for row in rows] == [None, 25, 40, None, None]
    # 25 or 40 at 4, 3 at 20 and 7 at 1 a million; a sibling keeps its calls only.
    assert [row["cost_est"] for row in rows] == pytest.approx([None, 167e-6, 227e-6, None, None])
    assert [len(row["tool_calls"]) for row in rows] == [0, 2, 2, 2, 0]
    prompts = rows_of(stores.read_prompts(spark, f"{folder}/store").orderBy("month"))
    assert [row["event_id"] for row in prompts] == [rows[0]["id"], rows[4]["id"]]
    assert len({row["text_hash"] for row in prompts}) == 1


def test_folders_sort_by_name_and_not_by_the_whole_path(spark, folder, prices):
    write_lines(folder, "logs/blue/z.jsonl", [answered("a", 9, "ask", tokens=5)])
    write_lines(folder, "logs/blue-2/a.jsonl", [answered("b", 1, "ask", tokens=8)])
    write_lines(folder, "logs/blue 1+1/a.jsonl", [answered("c", 1, "ask", tokens=13)])
    assert run(spark, folder, prices)["new_events"] == 3
    counted = [row["input_tok"] for row in stored(spark, f"{folder}/store") if row["input_tok"]]
    assert counted == [5]


def test_a_request_counted_months_ago_stays_counted(spark, folder, prices):
    write_lines(folder, "logs/1.jsonl", [answered("a", "2026-01-05T10:00:00Z", "ask", tokens=5)])
    write_lines(folder, "logs/2.jsonl", [said("b", "2026-02-05T10:00:00Z", sessionId="other")])
    run(spark, folder, prices)
    write_lines(folder, "logs/3.jsonl", [answered("c", "2026-06-05T10:00:00Z", "ask", tokens=8)])
    run(spark, folder, prices, now=2)
    counted = [row["input_tok"] for row in stored(spark, f"{folder}/store") if row["input_tok"]]
    assert counted == [5]
    # The months looked at are those of the session, not all there are.
    lines = read_lines(spark, f"{folder}/logs")
    notes = stores.notes_of(parse_lines(lines).where("session_id = 'evening'"))
    assert sorted(plan._claim_months(spark, f"{folder}/store", notes)) == ["2026-01", "2026-06"]


def test_a_run_that_died_between_its_notes_and_its_events(spark, folder, prices, monkeypatch):
    write_lines(folder, "logs/1.jsonl", EVENING)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(plan, "append_prompts", fail)
        with pytest.raises(RuntimeError):
            run(spark, folder, prices)
    assert stores.read_notes(spark, f"{folder}/store").count() == 2
    assert run(spark, folder, prices, now=2)["new_events"] == 5
    counted = [row["input_tok"] for row in stored(spark, f"{folder}/store") if row["input_tok"]]
    assert sorted(counted) == [25, 40]


def test_a_store_without_notes_gets_them_by_a_run_and_not_by_a_reader(spark, folder, prices):
    write_lines(folder, "logs/1.jsonl", [answered("a", "2026-01-05T10:00:00Z", "ask", tokens=5)])
    run(spark, folder, prices)
    for name in ("notes", "notes_base"):
        os.rename(f"{folder}/store/{name}", f"{folder}/{name}-elsewhere")
    assert stores.read_notes(spark, f"{folder}/store").count() == 0
    assert not os.path.exists(f"{folder}/store/notes")
    write_lines(folder, "logs/2.jsonl", [answered("c", "2026-06-05T10:00:00Z", "ask", tokens=8)])
    run(spark, folder, prices, now=2)
    counted = [row["input_tok"] for row in stored(spark, f"{folder}/store") if row["input_tok"]]
    assert counted == [5]


def test_a_turn_without_session_opens_no_foreign_month(spark, folder, prices):
    """Requests without session share none of their notes, so each finds its own month."""
    months = range(1, 5)
    for month in months:
        line = answered(f"u{month}", f"2026-0{month}-05T10:00:00Z", f"ask-{month}", sessionId=None)
        write_lines(folder, f"logs/{month}.jsonl", [line])
    run(spark, folder, prices)
    again = answered("late", "2026-09-05T10:00:00Z", "ask-2", sessionId=None, tokens=90)
    write_lines(folder, "logs/9.jsonl", [again])
    lines = read_lines(spark, f"{folder}/logs").where("path LIKE '%/9.jsonl'")
    notes = stores.notes_of(parse_lines(lines))
    assert plan._claim_months(spark, f"{folder}/store", notes) == ["2026-02"]
    buckets = stores.buckets_of(notes)
    assert len(buckets) == 1
    scan = stores.read_notes(spark, f"{folder}/store", buckets)._jdf.queryExecution().executedPlan().toString()
    pruned = scan[scan.index("PartitionFilters") :]
    assert f"(bucket#" in pruned and f"= {buckets[0]})" in pruned[: pruned.index("PushedFilters")]
    run(spark, folder, prices, now=2)
    counted = [row["input_tok"] for row in stored(spark, f"{folder}/store") if row["input_tok"]]
    assert sorted(counted) == [40] * 4


def test_notes_do_not_grow_with_batches_of_known_sessions(spark, folder, prices):
    for number in range(4):
        write_lines(folder, f"logs/{number}.jsonl", [answered(f"u{number}", number, f"ask-{number}")])
        run(spark, folder, prices, now=number)
    notes = stores.read_notes(spark, f"{folder}/store")
    assert (notes.count(), len(notes.inputFiles())) == (1, 1)


def test_many_small_files_of_notes_are_merged(spark, folder, prices):
    store = f"{folder}/store"
    lines = [answered(f"u{n}", n, f"ask-{n}", sessionId=f"s{n % 7}") for n in range(40)]
    for number in range(2):
        write_lines(folder, f"logs/{number}.jsonl", lines[number::2])
        run(spark, folder, prices, now=number)
    before = rows_of(stores.read_notes(spark, store).select("session", "month").distinct().orderBy("session"))
    stores.prepare_notes(spark, store, many_files=1)
    notes = stores.read_notes(spark, store)
    assert rows_of(notes.select("session", "month").orderBy("session")) == before
    assert {row["generation"] for row in notes.collect()} == {1}
    assert not os.path.exists(f"{store}/notes/generation=0")


def write_bytes(folder, name, lines, end=b"\n"):
    path = write_lines(folder, name, [])
    with open(path, "wb") as out:
        out.write(b"\n".join(line if isinstance(line, bytes) else line.encode() for line in lines) + end)
    return path


def offsets(spark, folder):
    latest = stores.read_cursors(spark, f"{folder}/store").orderBy("ts").collect()
    return {row["path"].rsplit("/", 1)[1]: row["offset"] for row in latest}


def test_a_file_is_taken_up_to_its_first_bytes_that_are_no_text(spark, folder, prices):
    good = [said(f"u{n}", n, text="@").replace("@", "größer") for n in range(6)]
    broken = good[3].encode().replace("ö".encode(), b"\xc3")
    path = write_bytes(folder, "logs/a.jsonl", [*good[:3], broken, *good[4:], b"\xff"])
    write_lines(folder, "logs/b.jsonl", [said("other", 9)])
    before = sum(len(line.encode()) + 1 for line in good[:3])
    for now, new in ((1, 4), (2, 0)):
        found = run(spark, folder, prices, now=now)
        assert (found["new_events"], found["skipped_unparseable"], found["files_read"]) == (new, 1, 3 - now)
        assert offsets(spark, folder) == {"a.jsonl": before, "b.jsonl": os.path.getsize(f"{folder}/logs/b.jsonl")}
    # Mended, the rest comes in; an untouched file is not opened again after that.
    write_bytes(folder, "logs/a.jsonl", good)
    found = run(spark, folder, prices, now=3)
    assert (found["new_events"], found["duplicates"], found["skipped_unparseable"]) == (3, 3, 0)
    assert offsets(spark, folder)["a.jsonl"] == os.path.getsize(path)
    assert run(spark, folder, prices, now=4)["files_read"] == 0


def test_a_line_still_being_written_is_left_for_later_even_if_complete(spark, folder, prices):
    first, second = said("u1", 1), said("u2", 2)
    for name, mark in (("a", b""), ("b", b"\xef\xbb\xbf")):
        lines = [entry("user", name + line[0], 1) for line in ("1", "2")]
        write_bytes(folder, f"logs/{name}.jsonl", [mark + lines[0].encode(), lines[1]], end=b"")
    write_bytes(folder, "logs/c.jsonl", [first], end=b"")
    write_bytes(folder, "logs/d.jsonl", [b"\xef\xbb\xbf" + first.encode(), second])
    found = run(spark, folder, prices)
    assert (found["new_events"], found["skipped_unparseable"]) == (4, 3)
    assert offsets(spark, folder)["c.jsonl"] == 0
    for name in "abc":
        with open(f"{folder}/logs/{name}.jsonl", "a") as out:
            out.write("\n")
    found = run(spark, folder, prices, now=2)
    assert (found["new_events"], found["skipped_unparseable"], found["duplicates"]) == (2, 0, 3)
    assert run(spark, folder, prices, now=3)["files_read"] == 0


def test_split_files_stop_at_the_same_line(spark, folder, prices):
    lines = [said(f"u{n}", n % 50, text="x" * 300) for n in range(60)]
    write_bytes(folder, "logs/a.jsonl", [*lines[:40], b"\xf0\x28", *lines[40:]])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        found = run(spark, folder, prices)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert (found["new_events"], found["skipped_unparseable"]) == (40, 1)
    assert offsets(spark, folder)["a.jsonl"] == sum(len(line) + 1 for line in lines[:40])


def test_half_characters_are_no_records(spark, folder, prices):
    texts = [
        r"x\ud83dy", r"\udc00", r"\uDC00\ud83d", r"\\\ud83d", r"\ud83d\\udc00", r"\ud83d\ud83d\udc00",
        r"\ud83d\udc00", r"\\ud83d", r"\uD83D\uDC00 \\udc00", r"\ue000", r"a\\\ud83d\udc00",
    ]
    lines = [said(f"u{n}", n, text="@").replace("@", text) for n, text in enumerate(texts)]
    lines.append(said("u20", 20, other="@").replace("@", r"\udfff"))
    write_lines(folder, "logs/a.jsonl", lines)
    found = run(spark, folder, prices)
    assert (found["new_events"], found["skipped_unparseable"]) == (5, 7)
    kept = {row["text"] for row in rows_of(stores.read_prompts(spark, f"{folder}/store"))}
    assert kept == {json.loads(f'"{text}"') for text in texts[6:]}


def test_hidden_names_and_carriage_returns(spark, folder, prices):
    for number, name in enumerate(("_work/a", ".dot/a", "ok/_x", "ok/a", ".dot/_in/.b")):
        line = answered(f"u{number}", number, f"ask-{number}")
        write_lines(folder, f"logs/{name}.jsonl", [line.replace(', "', ', \r"')])
    summary = run(spark, folder, prices)
    assert (summary["files_seen"], summary["new_events"], summary["skipped_unparseable"]) == (5, 3, 0)
    # No reader of Spark opens a file of such a name, so these two are told of.
    assert (summary["files_read"], summary["unreadable_files"]) == (3, 2)


def test_one_old_file_does_not_open_the_newer_ones(spark, folder, prices):
    for number in range(1, 4):
        path = write_lines(folder, f"logs/{number}.jsonl", [said(f"u{number}", number)])
        os.utime(path, (number * 10**6, number * 10**6))
    run(spark, folder, prices)
    path = write_lines(folder, "logs/0.jsonl", [said("u0", 0)])
    os.utime(path, (5 * 10**5, 5 * 10**5))
    lines = read_lines(spark, f"{folder}/logs", days=["1970-01-06"])
    assert [row["path"][-7:] for row in lines.select("path").distinct().collect()] == ["0.jsonl"]
    summary = run(spark, folder, prices, now=2)
    assert (summary["files_read"], summary["new_events"], summary["duplicates"]) == (1, 1, 0)


def test_one_changed_file_of_many_of_a_day_is_the_only_one_opened(spark, folder, prices, monkeypatch):
    for number in range(40):
        name = f"logs/p {number % 3}+/[{number}]{{x}}%é*.jsonl"
        write_lines(folder, name, [said(f"u{number}", number)])
    assert run(spark, folder, prices)["new_events"] == 40
    with open(f"{folder}/{name}", "a") as out:
        out.write(said("late", 50) + "\n")
    listed = list_files(spark, f"{folder}/logs")
    picked = changed_files(listed, stores.read_cursors(spark, f"{folder}/store"))
    lines = plan._lines_to_read(spark, f"{folder}/logs", Source(), picked)
    scan = lines._jdf.queryExecution().executedPlan().toString()
    assert "file_path" in scan and lines.select("path").distinct().count() == 1
    # More files than a scan is given by name are told by their days.
    monkeypatch.setattr(plan, "MOST_PATHS", 0)
    again = plan._lines_to_read(spark, f"{folder}/logs", Source(), picked)
    assert sorted(again.select("value", "path").collect()) == sorted(lines.select("value", "path").collect())
    assert run(spark, folder, prices, now=2)["new_events"] == 1


def test_a_file_from_before_the_epoch_is_left_out_on_every_run(spark, folder, prices):
    path = write_lines(folder, "logs/a.jsonl", [said("u1", 1)])
    os.utime(path, (-1000, -1000))
    write_lines(folder, "logs/b.jsonl", [said("u2", 2)])
    for now in (1, 2):
        summary = run(spark, folder, prices, now=now)
        assert (summary["unreadable_files"], summary["files_read"]) == (1, 2 - now)


def test_a_second_run_changes_nothing(spark, folder, prices):
    path = write_lines(folder, "logs/a.jsonl", EVENING)
    run(spark, folder, prices)
    before = stored(spark, f"{folder}/store")
    again = run(spark, folder, prices, now=2)
    assert (again["files_read"], again["new_events"]) == (0, 0)
    # The file grows: known lines are duplicates, the new one is not.
    with open(path, "a") as out:
        out.write(said("u5", 9) + "\n")
    grown = run(spark, folder, prices, now=3)
    assert (grown["files_read"], grown["new_events"], grown["duplicates"]) == (1, 1, 5)
    assert len(stored(spark, f"{folder}/store")) == len(before) + 1


def test_parts_equal_the_whole(spark, folder, prices):
    path = write_lines(folder, "logs/a.jsonl", EVENING[:4])
    run(spark, folder, prices)
    with open(path, "a") as out:
        out.write("\n".join(EVENING[4:]) + "\n")
    run(spark, folder, prices, now=2)
    write_lines(folder, "whole/logs/a.jsonl", EVENING)
    run(spark, f"{folder}/whole", prices)
    assert stored(spark, f"{folder}/store") == stored(spark, f"{folder}/whole/store")


def test_a_project_run_stores_that_project_and_no_cursor(spark, folder, prices):
    write_lines(folder, "logs/a.jsonl", EVENING)
    other = run(spark, folder, prices, project="other")
    assert (other["new_events"], other["cursors_written"]) == (0, False)
    assert stores.read_cursors(spark, f"{folder}/store").count() == 0
    blue = run(spark, folder, prices, project="blue")
    assert (blue["new_events"], blue["files_read"]) == (5, 1)


def test_text_can_be_left_out(spark, folder, prices):
    write_lines(folder, "logs/a.jsonl", [said("u1", 1), said("u2", 2)])
    run(spark, folder, prices, source=Source(index_text=False))
    rows = rows_of(stores.read_prompts(spark, f"{folder}/store"))
    assert [row["text"] for row in rows] == [None, None]
    assert len({row["text_hash"] for row in rows}) == 1
    assert [row["text_indexed"] for row in rows] == [False, False]


def test_the_period_selects_files_not_rows(spark, folder, prices):
    old = write_lines(folder, "logs/old.jsonl", [said("u1", 1)])
    new = write_lines(folder, "logs/new.jsonl", [said("u2", 2), said("u3", 3)])
    os.utime(old, (1000, 1000))
    os.utime(new, (2000, 2000))
    summary = run(spark, folder, prices, window=Window(1_500_000, 2_000_001))
    assert (summary["files_seen"], summary["files_read"], summary["new_events"]) == (2, 1, 2)
    assert run(spark, folder, prices, window=Window(0, 1_000_000))["files_read"] == 0


def test_first_means_first_in_path_and_line_order(spark, folder, prices):
    filler = [said(f"f{n}", 1, text="x" * 200) for n in range(50)]
    write_lines(folder, "logs/b.jsonl", [answered("late", 1, "req", tokens=7)])
    write_lines(
        folder, "logs/a.jsonl", [*filler, answered("first", 5, "req", tokens=5), *filler[:1]]
    )
    write_lines(folder, "logs/a/z.jsonl", [answered("nested", 0, "req", tokens=9)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        summary = run(spark, folder, prices)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (summary["new_events"], summary["duplicates"]) == (53, 1)
    counted = [row for row in stored(spark, f"{folder}/store") if row["input_tok"] is not None]
    # The folder "a" sorts before "a.jsonl" and "b.jsonl".
    assert [row["input_tok"] for row in counted] == [9]


def test_a_third_of_all_lines_being_copies(spark, folder, prices):
    copies = [answered("copy", 1, "req_c")] * 300
    others = [answered(f"o{n}", 2, "hot", tokens=n + 1) for n in range(300)]
    for number in range(3):
        lines = copies[number::3] + others[number::3]
        write_lines(folder, f"logs/{number}.jsonl", lines)
    summary = run(spark, folder, prices)
    assert (summary["new_events"], summary["duplicates"]) == (301, 299)
    counted = [row["input_tok"] for row in stored(spark, f"{folder}/store") if row["input_tok"]]
    assert sorted(counted) == [1, 40]


def test_a_run_that_died_after_its_prompts_is_completed(spark, folder, prices, monkeypatch):
    write_lines(folder, "logs/a.jsonl", EVENING)

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(plan, "append_events", fail)
        with pytest.raises(RuntimeError):
            run(spark, folder, prices)
    assert stores.read_prompts(spark, f"{folder}/store").count() == 2
    assert run(spark, folder, prices, now=2)["new_events"] == 5
    assert stores.read_prompts(spark, f"{folder}/store").count() == 2
    assert stores.read_events(spark, f"{folder}/store").count() == 5


def test_torn_last_line(spark, folder, prices):
    whole = answered("u9", 9, "req_9")
    path = write_lines(folder, "logs/a.jsonl", [said("u1", 1), whole[:40]], end="")
    torn = run(spark, folder, prices)
    assert (torn["new_events"], torn["skipped_unparseable"]) == (1, 1)
    with open(path, "a") as out:
        out.write(whole[40:] + "\n")
    whole_run = run(spark, folder, prices, now=2)
    assert (whole_run["new_events"], whole_run["skipped_unparseable"]) == (1, 0)


def test_changed_files(spark, folder):
    for name in ("same", "grown", "shrunk", "new"):
        write_lines(folder, f"logs/{name}.jsonl", ["x" * 10])
    write_lines(folder, "logs/empty.jsonl", [], end="")
    listed = list_files(spark, f"{folder}/logs")
    sizes = {"same": 11, "grown": 5, "shrunk": 20}
    name = F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)
    known = listed.withColumn("name", name).where(F.col("name").isin(*sizes))
    stale = known.withColumn("size", F.lit(11)).where("name = 'grown'")
    stores.append_cursors(stale, f"{folder}/store", "claude-code", 1)
    size = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair])[F.col("name")]
    latest = known.withColumn("size", size)
    stores.append_cursors(latest, f"{folder}/store", "claude-code", 2)
    stores.append_cursors(listed, f"{folder}/store", "another", 3)
    cursors = stores.read_cursors(spark, f"{folder}/store")
    changed = changed_files(listed, cursors).select(name.alias("name"))
    assert sorted(row["name"] for row in changed.collect()) == ["grown", "new", "shrunk"]


def test_sources_that_do_not_exist(spark, folder, prices):
    assert list_files(spark, f"{folder}/nowhere").count() == 0
    summary = one(ingest(spark, f"{folder}/nowhere", f"{folder}/store", prices, 1))
    assert (summary["files_seen"], summary["new_events"]) == (0, 0)


def test_old_files_are_pruned_before_reading(spark, folder):
    for number in range(1, 4):
        path = write_lines(folder, f"logs/{number}.jsonl", ["x"])
        os.utime(path, (10**6 * number, 10**6 * number))
    lines = read_lines(spark, f"{folder}/logs", days=["1970-02-04"])
    assert lines.count() == 1
    scan = lines._jdf.queryExecution().executedPlan().toString()
    assert "file_modification_time" in scan


def test_source_sessions(spark, folder):
    for name in ("p/a.jsonl", "q/a.jsonl", "q/b.c.jsonl"):
        write_lines(folder, f"logs/{name}", ["x"])
    assert one(source_sessions(list_files(spark, f"{folder}/logs"))) == {"sessions": 2}


def test_months_are_told_by_event_time(spark, folder, prices):
    stamps = ["2026-07-31T23:59:59.999Z", "2026-08-01T00:00:00.000Z"]
    lines = [said(f"u{n}", 0, timestamp=stamp) for n, stamp in enumerate(stamps)]
    write_lines(folder, "logs/a.jsonl", lines)
    run(spark, folder, prices)
    months = {row["ts"]: row["month"] for row in stored(spark, f"{folder}/store")}
    assert months == {AUG - 1: "2026-07", AUG: "2026-08"}
    assert sorted(name for name in os.listdir(f"{folder}/store/events") if "=" in name) == [
        "month=2026-07", "month=2026-08",
    ]


def test_a_run_walks_the_folders_once(spark, folder, no_prices, monkeypatch):
    os.makedirs(f"{folder}/logs/.hidden")
    with open(f"{folder}/logs/.hidden/1.jsonl", "w") as file:
        file.write('{"type":"user","timestamp":"2026-08-01T10:00:00Z","message":{"content":"x"}}\n')
    walks, original = [], transcripts.walked

    def counted(*given):
        walks.append(given)
        return original(*given)

    monkeypatch.setattr(transcripts, "walked", counted)
    monkeypatch.setattr(plan, "walked", counted)
    assert one(ingest(spark, f"{folder}/logs", f"{folder}/store", no_prices, 1))["new_events"] == 1
    assert len(walks) == 1
