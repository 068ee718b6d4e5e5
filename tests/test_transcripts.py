import json

import pytest
from conftest import TEXT, one, rows_of
from pyspark.sql import functions as F

from turnledger.sources.transcripts import parse_lines


def parsed(spark, *lines):
    texts = [line if isinstance(line, str) else json.dumps(line) for line in lines]
    frame = spark.createDataFrame([[text] for text in texts], TEXT)
    return rows_of(parse_lines(frame))


def record(spark, line):
    (row,) = parsed(spark, line)
    assert row["status"] == "record"
    return row


def user(content, **fields):
    line = {"type": "user", "timestamp": "2026-08-01T10:00:00Z", "message": {"content": content}}
    return {**line, **fields}


def assistant(message, **fields):
    line = {"type": "assistant", "timestamp": "2026-08-01T10:00:00.000Z", "message": message}
    return {**line, **fields}


def test_every_field_of_a_reply(spark):
    content = [
        {"type": "tool_use", "name": "Fetch", "input": {"url": "http://localhost/x", "file": "y"}},
        {"type": "thinking", "thinking": "..."},
        {"type": "tool_use", "name": "List", "input": {"depth": 2}},
    ]
    usage = {"cache_creation_input_tokens": 0, "cache_read_input_tokens": 640, "output_tokens": 77}
    row = record(
        spark,
        assistant(
            {"content": content, "usage": usage, "stop_reason": "max_tokens", "model": "m-9"},
            isSidechain=True,
            cwd="/srv/teams/harbour/",
            requestId="q",
            sessionId="night",
            uuid="x-77",
            gitBranch=["extra", {"deep": False}],
        ),
    )
    expected = {
        "v": 1, "ts": 1785578400000, "month": "2026-08", "role": "assistant",
        "agent": "claude-code", "provider": "anthropic", "model": "m-9",
        "project": "harbour", "session_id": "night", "turn_id": "q",
        "input_tok": None, "output_tok": 77, "cache_read_tok": 640, "cache_write_tok": 0,
        "stop_reason": "max_tokens", "is_sidechain": True,
        "duration_ms": None, "cost_est": None, "prompt_text": None,
    }
    assert {name: row[name] for name in expected} == expected
    assert [tuple(call.values()) for call in row["tool_calls"]] == [
        ("Fetch", "http://localhost/x"), ("List", None),
    ]


def test_a_string_of_25_million_characters_is_read(spark):
    line = json.dumps(user("short", toolUseResult="x" * 25_000_000))
    assert record(spark, line)["prompt_text"] == "short"


@pytest.mark.parametrize(
    "line",
    [
        {"type": "attachment"},
        {"type": "mode"},
        {"type": "file-history-snapshot", "timestamp": 5},
        {"type": "system"},
        "",
        "  \t　",
    ],
)
def test_skipped_lines(spark, line):
    assert parsed(spark, line)[0]["status"] == "skipped"


@pytest.mark.parametrize(
    "line",
    [
        "{not json",
        "{}",
        {"type": 5, "timestamp": "2026-08-01T10:00:00Z"},
        {"type": "assistant"},
        {"type": "user", "timestamp": "2026-08-01"},
        {"type": "user", "timestamp": 1785578400000},
        "5",
        "null",
        '"user"',
        '[{"type":"user","timestamp":"2026-08-01T10:00:00Z"}]',
        '{"type":"user","timestamp":"2026-08-01T10:00:00Z"',
        '{"type":"user","timestamp":"2026-08-01T10:00:00Z"}}',
        '{"type":"user","timestamp":"2026-08-01T10:00:00Z"} x',
        '{"type":"mode"}{"type":"mode"}',
        "{'type':'mode'}",
        '{"type":"mode","a":NaN}',
        '{"type":"mode","a":tru}',
        '{"type":"user","timestamp":"2026-08-01T10:00:00Z","message":{"content":[1,}}',
    ],
)
def test_unparseable_lines(spark, line):
    row = parsed(spark, line)[0]
    assert row["status"] == "unparseable"
    assert row["id"] is None and row["prompt_text"] is None


def test_types_are_strict(spark):
    row = record(
        spark,
        assistant(
            {
                "model": 5,
                "stop_reason": ["x"],
                "usage": {
                    "input_tokens": "12",
                    "output_tokens": 1.5,
                    "cache_read_input_tokens": -1,
                    "cache_creation_input_tokens": 7,
                },
                "content": [
                    {"type": "tool_use", "name": 7, "input": {"path": "a"}},
                    {"type": "tool_use", "input": {"path": "a"}},
                    {"type": "tool_use", "name": "A", "input": {"file_path": 5, "path": "p"}},
                    {"type": "tool_use", "name": "B", "input": {"file_path": "", "path": "p"}},
                    {"type": "tool_use", "name": "C", "input": {"command": "ls"}},
                    {"type": "tool_use", "name": "D", "input": "s"},
                    {"type": "tool_use", "name": "E"},
                    "text",
                    5,
                    None,
                    ["x"],
                ],
            },
            uuid=1,
            sessionId=2,
            requestId=True,
            cwd={"a": 1},
            isSidechain="true",
        ),
    )
    for name in ("model", "stop_reason", "input_tok", "output_tok", "cache_read_tok"):
        assert row[name] is None
    for name in ("session_id", "turn_id", "project", "is_sidechain"):
        assert row[name] is None
    assert row["cache_write_tok"] == 7
    targets = {call["tool_name"]: call["tool_target"] for call in row["tool_calls"]}
    assert targets == {"A": "p", "B": None, "C": None, "D": None, "E": None}


@pytest.mark.parametrize("message", ["text", 5, None, [1], {"usage": 5, "content": {"type": "text"}}])
def test_odd_messages_still_make_records(spark, message):
    row = record(spark, assistant(message))
    assert row["tool_calls"] == [] and row["input_tok"] is None


def test_prompt_texts(spark):
    texts = {
        "run the tests": "run the tests",
        "  padded ": "  padded ",
        " 　\n": None,
    }
    for content, expected in texts.items():
        assert record(spark, user(content))["prompt_text"] == expected
    blocks = [
        {"type": "text", "text": "fix it"},
        {"type": "tool_result", "text": "no"},
        {"type": "text", "text": 5},
        {"type": "text", "text": "now"},
    ]
    assert record(spark, user(blocks))["prompt_text"] == "fix it\nnow"
    assert record(spark, user([{"type": "tool_result", "content": "x"}]))["prompt_text"] is None
    assert record(spark, user({"type": "text", "text": "x"}))["prompt_text"] is None
    assert record(spark, assistant({"content": "x"}))["prompt_text"] is None


def test_usage_of_users_is_not_read(spark):
    row = record(spark, {**user("x"), "message": {"content": "x", "usage": {"input_tokens": 5}}})
    assert row["input_tok"] is None


def test_the_last_of_two_equal_keys_counts(spark):
    row = record(
        spark,
        '{"type":"mode","type":"user","timestamp":"2026-08-01T10:00:00Z",'
        '"message":{"content":"a","content":"b"}}',
    )
    assert row["prompt_text"] == "b"


def test_ids_depend_on_what_identifies_a_record(spark):
    base = user("x", uuid="u", sessionId="s")
    ids = [
        record(spark, line)["id"]
        for line in (base, user("other text", uuid="u", sessionId="s"), user("x", uuid="v", sessionId="s"))
    ]
    assert ids[0] == ids[1] != ids[2]


def test_agent_and_provider_are_parameters(spark):
    frame = spark.createDataFrame([[json.dumps(user("x"))]], TEXT)
    row = one(parse_lines(frame, "other", "someone"))
    assert (row["agent"], row["provider"]) == ("other", "someone")


def test_strings_are_taken_from_json_strings_only(spark):
    blocks = [
        {"type": "tool_use", "name": 7, "input": {"path": "a"}},
        {"type": "tool_use", "name": "Read", "input": {"file_path": 7, "path": True, "url": "b"}},
        {"type": "tool_use", "name": "Edit", "input": {"file_path": "", "path": "c"}},
        {"type": "tool_use", "name": "Bash", "input": {"path": {"x": 1}, "url": ["y"], "file": None}},
        {"type": 1, "name": "Read"},
        "tool_use",
        {"type": "text", "text": 5},
        {"type": "text", "text": "größe\u0000"},
    ]
    message = {"model": 1.5, "stop_reason": "end", "content": blocks, "usage": {"input_tokens": "3", "output_tokens": 4}}
    line = {"type": "user", "timestamp": "2026-08-01T00:00:00Z", "sessionId": 12, "cwd": "/a/../b.c/", "message": message}
    lines = spark.createDataFrame([(json.dumps(line),)], "value string")
    found = parse_lines(lines).first()
    assert [tuple(call) for call in found["tool_calls"]] == [("Read", "b"), ("Edit", None), ("Bash", None)]
    assert (found["prompt_text"], found["model"], found["stop_reason"]) == ("größe\u0000", None, "end")
    assert (found["session_id"], found["project"]) == (None, "b.c")


def test_no_schema_is_worked_out_for_a_string(spark):
    """The type of a leaf as text, asked for each, cost more than decoding the line."""
    lines = spark.createDataFrame([("{}",)], "value string")
    plan = parse_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    # What is left: four counts, each named twice, and the sidechain flag.
    assert plan.lower().count("schemaofvariant.schemaofvariant") <= 9


def test_a_filter_on_the_status_types_no_line_twice(spark):
    lines = spark.range(3).select(F.concat(F.lit('{"type":"user","n":'), "id", F.lit("}")).alias("value"))
    kept = parse_lines(lines).where(F.col("status") == "record").select("id", "ts")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("isValid()") == 1
