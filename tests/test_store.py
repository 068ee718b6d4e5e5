import json

from conftest import AUG, DAY, at, call, event, events_frame, one, rows_of, used, write_lines
from pyspark.sql import functions as F

from turnledger.functions.clock import Window, month_of
from turnledger.functions.ids import text_hash
from turnledger.operators.pricing import price_table
from turnledger.operators.scope import Scope, in_window
from turnledger.plans import health, notes
from turnledger.sources import store as stores

JUN, JUL, AUGUST = AUG - 45 * DAY, AUG - 15 * DAY, AUG + 5 * DAY


def monthly(spark, rows):
    return events_frame(spark, rows).withColumn("month", month_of(F.col("ts")))


def three_months(spark, store, fmt="parquet"):
    rows = [event("jun", JUN), event("jul", JUL), event("aug", AUGUST)]
    stores.append_events(monthly(spark, rows), store, fmt)


def files_read(df):
    return len(df.select("_metadata.file_path").distinct().collect())


def test_events_come_back_as_written(spark, folder):
    rows = [
        used("a", JUL, "p", "m", 1, 2, cost_est=0.5, stop_reason="end", is_sidechain=True,
             tool_calls=[call("Read", "x"), call("Bash")]),
        event("b", AUGUST),
    ]
    written = monthly(spark, rows)
    for fmt in ("parquet", "json"):
        stores.append_events(written, f"{folder}/{fmt}", fmt)
        back = stores.read_events(spark, f"{folder}/{fmt}", fmt=fmt)
        assert sorted(rows_of(back), key=lambda row: row["id"]) == rows_of(written)


def test_only_months_of_the_period_are_opened(spark, folder):
    three_months(spark, folder)
    window = Window(AUG - 22 * DAY, AUG + 19 * DAY)
    found = in_window(stores.read_events(spark, folder, window), window)
    assert sorted(row["id"] for row in found.collect()) == ["aug", "jul"]
    scan = found._jdf.queryExecution().executedPlan().toString()
    pruned = scan[scan.index("PartitionFilters"):]
    assert "month" in pruned[: pruned.index("PushedFilters")]
    assert "GreaterThanOrEqual(ts" in scan
    # A report over the unpruned table still prunes, through its own window.
    found = in_window(stores.read_events(spark, folder), window)
    assert files_read(found) == 2


def test_a_month_of_plain_row_numbers_is_dealt_to_many_tasks(spark, folder):
    """However rows are numbered, none of the tasks gets a whole large month."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = [event(f"e{n}", AUGUST, seq=n) for n in range(200)]
    few = monthly(spark, rows).repartition(4).withColumn("seq", F.col("seq") * 2000)
    spark.conf.set(size, "1000")
    try:
        stores.append_events(few, folder)
    finally:
        spark.conf.unset(size)
    found = stores.read_events(spark, folder)
    assert files_read(found) > 1
    assert sorted(r["seq"] for r in found.collect()) == [2000 * n for n in range(200)]
    files = {}
    for r in found.select("seq", F.col("_metadata.file_path").alias("path")).collect():
        files.setdefault(r["path"], []).append(r["seq"])
    assert all(own == sorted(own) for own in files.values())


def test_a_store_not_written_yet_is_empty(spark, folder):
    nowhere = f"{folder}/nowhere"
    for fmt in ("parquet", "json"):
        assert stores.read_events(spark, nowhere, fmt=fmt).count() == 0
        assert stores.read_prompts(spark, nowhere, fmt=fmt).count() == 0
    assert stores.read_events(spark, nowhere, month_files=True).count() == 0
    assert stores.read_prompts(spark, nowhere, month_files=True).count() == 0
    assert stores.read_cursors(spark, nowhere).count() == 0


def stored_line(id, ts, **fields):
    row = {key: value for key, value in event(id, ts, **fields).items() if value is not None}
    return json.dumps(row)


def month_store(folder):
    write_lines(folder, "events/2026-06.jsonl", [stored_line("jun", JUN)])
    write_lines(
        folder,
        "events/2026-08.jsonl",
        [
            stored_line("a", AUGUST, project="p", future={"x": 1}),
            "",
            stored_line("b", AUGUST + 1, v=2, tool_calls=[call("Read", "x")]),
            stored_line("c", AUG, project="p"),
            '{"v":1,"id":"torn","ts":178',
        ],
        end="",
    )
    write_lines(folder, "events/2026-13.jsonl", [stored_line("no-month", AUGUST)])
    write_lines(folder, "events/backup-2026-08.jsonl", [stored_line("backup", AUGUST)])


def test_a_store_of_month_files(spark, folder):
    month_store(folder)
    window = Window(AUG, None)
    lines = stores.read_event_lines(spark, folder, window, month_files=True)
    assert one(stores.scan_stats(lines, window)) == {
        "partitions_read": 1, "lines_read": 4, "lines_skipped": 1, "events_filtered": 0,
    }
    assert one(stores.scan_stats(lines, Window(AUG + 1, None), "p")) == {
        "partitions_read": 1, "lines_read": 4, "lines_skipped": 1, "events_filtered": 2,
    }
    events = stores.read_events(spark, folder, month_files=True)
    assert [row["id"] for row in events.orderBy("month", "seq").collect()] == ["jun", "a", "b", "c"]
    assert files_read(stores.read_events(spark, folder).limit(0)) == 0


def test_notes_tell_of_skipped_lines(spark, folder, no_prices):
    month_store(folder)
    lines = stores.read_event_lines(spark, folder, month_files=True)
    stats = stores.scan_stats(lines)
    events = lines.where("usable")
    noted = one(notes.scan_notes(events, no_prices, scan_stats=stats))
    assert (noted["events"], noted["lines_skipped"]) == (4, 1)


def test_lines_that_break_the_contract_are_skipped(spark, folder):
    bad = [
        stored_line("no-agent", AUGUST, agent=None),
        stored_line("no-role", AUGUST, role=None),
        stored_line("negative", AUGUST, input_tok=-1),
        stored_line("nameless", AUGUST, tool_calls=[{"tool_target": "x"}]),
        stored_line("wrong-type", AUGUST, output_tok="many"),
        '{"v":1}',
    ]
    good = [stored_line("ok", AUGUST, input_tok=0), stored_line("other-version", AUGUST, v=9)]
    write_lines(folder, "events/2026-08.jsonl", bad + good)
    lines = stores.read_event_lines(spark, folder, month_files=True)
    kept = [row["id"] for row in lines.where("usable").orderBy("seq").collect()]
    assert kept == ["ok", "other-version"]
    assert one(stores.scan_stats(lines))["lines_skipped"] == 6


def test_order_of_lines_in_a_file_read_in_many_blocks(spark, folder):
    lines = [stored_line(f"e{n:05}", AUGUST, project="p" * 50) for n in range(2000)]
    write_lines(folder, "events/2026-08.jsonl", lines)
    write_lines(folder, "events/2026-07.jsonl", lines[:7])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = stores.read_events(spark, folder, month_files=True).orderBy("month", "seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    ids = [f"e{n:05}" for n in range(2000)]
    assert [row["id"] for row in rows] == ids[:7] + ids


def prompts_frame(spark, texts, month="2026-08"):
    rows = [(f"e{n}", text, n, month) for n, text in enumerate(texts)]
    frame = spark.createDataFrame(rows, "event_id string, text string, seq long, month string")
    return frame.withColumn("text_hash", text_hash(F.coalesce("text", F.lit("?"))))


def test_prompts_come_back_and_bad_lines_do_not(spark, folder):
    for fmt in ("parquet", "json"):
        store = f"{folder}/{fmt}"
        stores.append_prompts(prompts_frame(spark, ["a", "b"]), store, fmt=fmt)
        stores.append_prompts(prompts_frame(spark, ["c"]), store, index_text=False, fmt=fmt)
        back = stores.read_prompts(spark, store, fmt=fmt)
        found = sorted(back.select("text", "text_indexed", "month").collect(), key=lambda row: row["text"] or "")
        assert [tuple(row) for row in found] == [
            (None, False, "2026-08"), ("a", True, "2026-08"), ("b", True, "2026-08"),
        ]
    good = json.dumps({"event_id": "e", "text": "t", "text_hash": "h"})
    write_lines(folder, "prompts/2026-08.jsonl", [good, "{torn", '{"text":"x"}', ""])
    row = one(stores.read_prompts(spark, folder, month_files=True))
    assert (row["event_id"], row["text_indexed"]) == ("e", True)


def test_footprint(spark, folder):
    assert one(health.store_footprint(stores.read_prompts(spark, folder))) == {
        "files": 0, "records": 0, "bytes": 0,
    }
    stores.append_prompts(prompts_frame(spark, ["a", "b"]), folder)
    stores.append_prompts(prompts_frame(spark, ["c"], "2026-07"), folder)
    found = one(health.store_footprint(stores.read_prompts(spark, folder)))
    assert (found["files"], found["records"]) == (2, 3) and found["bytes"] > 0


def test_health_names_models_without_a_price(spark):
    rows = [
        used("a", JUL, "p", "known", 1, 1),
        used("b", AUGUST, "p", "<synthetic>", 1, 1),
        used("c", AUGUST, "q", None, 1, 1),
        event("d", AUGUST, model="silent"),
    ]
    frame = events_frame(spark, rows)
    prices = price_table(spark, [("anthropic", "known", 1.0, 1.0, 1.0, None)])
    assert one(health.store_health(frame, prices)) == {
        "partitions": 2, "oldest": "2026-07", "events": 4, "bytes": 0,
        "unpriced_models": ["(unknown model)", "<synthetic>"],
    }
    unpriced = one(health.store_health(frame, price_table(spark, []), Scope(project="p")))
    assert unpriced["unpriced_models"] == ["<synthetic>", "known"]


def test_coverage(spark, no_prices):
    rows = [
        used("e0", at(1), "p", "m", 1, 1, tool_calls=[call("Read")], is_sidechain=False),
        event("e1", at(1), role="user"),
        event("x", at(1), agent="other", duration_ms=0, cache_read_tok=0),
    ]
    found = rows_of(
        health.kpi_coverage(events_frame(spark, rows), prompts_frame(spark, ["a", "b", "c"]), no_prices)
    )
    counts = {(row["agent"], row["kpi"]): row["recorded"] for row in found}
    assert len(found) == 16
    assert {kpi for (agent, kpi), count in counts.items() if agent == "other" and count} == {
        "cache", "duration_ms",
    }
    assert counts["claude-code", "prompts"] == 2 and counts["claude-code", "tokens"] == 1
    assert counts["claude-code", "cost"] == 0
    assert all(row["supported"] == (row["recorded"] > 0) for row in found)
