from collections import defaultdict

import pytest
from conftest import at, event, events_frame, one, rows_of
from pyspark.sql import functions as F

from turnledger.functions.clock import Window
from turnledger.functions.ids import text_hash
from turnledger.operators.scope import Scope
from turnledger.plans import repeats

SHORT = "bump the version"
LONG = (
    "go through the open questions in the notes file one after another, answer each from the "
    "code and mark those that need a decision"
)
NOW = at(20)


def store(spark, sent):
    """Events and prompts from ``(text, project, day)``, one of each per entry."""
    rows = [
        event(f"e{n:03}", at(day), role="user", project=project)
        for n, (_, project, day) in enumerate(sent)
    ]
    prompts = spark.createDataFrame(
        [(f"e{n:03}", text, n) for n, (text, _, _) in enumerate(sent)],
        "event_id string, text string, seq long",
    ).select(
        "event_id",
        "text",
        text_hash(F.col("text")).alias("text_hash"),
        F.lit(True).alias("text_indexed"),
        "seq",
    )
    return prompts, events_frame(spark, rows)


# Text, project and day, in no order of either.
SENT = [
    (LONG, "mill", 9),
    (SHORT, None, 8),
    ("thanks", "mill", 8),
    (SHORT, "quay", 12),
    (SHORT, "quay", 7),
    (LONG, "mill", 10),
    (SHORT, "mill", 11),
]


def test_repeated_prompts(spark):
    found = rows_of(repeats.suggestions(*store(spark, SENT)))
    shown = [(r["text"], r["count"], r["last_ts"], r["projects"], r["suggestion"]) for r in found]
    assert shown == [
        (SHORT, 4, at(12), ["mill", "quay"], "slash-command"),
        (LONG, 2, at(10), ["mill"], "skill"),
    ]
    assert [r["skill_name"] for r in found] == [None, "go-through-open-questions"]
    assert all(r["id"] == r["text_hash"][:8] and len(r["text_hash"]) == 32 for r in found)


def test_period_and_project_come_from_the_events(spark):
    prompts, events = store(spark, SENT)
    for scope, counts in (
        (Scope(Window(at(8), at(12))), [2, 2]),
        (Scope(Window(at(9), at(10))), []),
        (Scope(project="quay"), [2]),
    ):
        found = repeats.suggestions(prompts, events, scope)
        assert [row["count"] for row in rows_of(found)] == counts


def test_row_numbers_that_start_anew_every_month(spark):
    prompts, events = store(spark, [(LONG, "mill", day) for day in (3, 4, 5, 6)])
    month = F.when(F.col("event_id") < "e002", "2026-07").otherwise("2026-08")
    prompts = prompts.withColumn("month", month).withColumn("seq", F.col("seq") % 2)
    (row,) = rows_of(repeats.suggestions(prompts, events))
    assert (row["count"], row["text"]) == (4, LONG)
    assert repeats.draft_of(repeats.suggestions(prompts, events), row["id"], NOW)


def test_sidechain_events_always_take_part(spark):
    prompts, events = store(spark, [SENT[1], SENT[3]])
    scope = Scope(include_sidechain=False)
    side = events.withColumn("is_sidechain", F.lit(True))
    assert len(rows_of(repeats.suggestions(prompts, side, scope))) == 1


def test_furniture_is_set_aside_and_counted(spark):
    sent = [
        (text, "p", 4)
        for text in [
            "/compact", "/compact", "<command-name>x", "<command-name>x",
            "[Request interrupted by user]", "[Request interrupted by user]", SHORT, SHORT,
        ]
    ]
    prompts, events = store(spark, sent)
    assert one(repeats.furniture(prompts, events)) == {"groups": 1, "furniture": 3}
    assert [row["text"] for row in rows_of(repeats.suggestions(prompts, events))] == [SHORT]


def test_without_texts_groups_stay(spark):
    sent = [("/compact", "p", 4)] * 2
    prompts, events = store(spark, sent)
    row = one(repeats.suggestions(repeats.redacted(prompts), events))
    assert (row["text"], row["text_indexed"], row["count"]) == (None, False, 2)
    assert (row["suggestion"], row["skill_name"]) == ("skill", "repeated-prompt")
    assert "not stored" in repeats.draft_of(
        repeats.suggestions(repeats.redacted(prompts), events), row["id"], NOW
    )


def test_any_stored_text_serves_the_group(spark):
    prompts, events = store(spark, [(SHORT, "p", 4)] * 3)
    kept = F.col("seq") == 1
    mixed = prompts.withColumn("text", F.when(kept, F.col("text"))).withColumn("text_indexed", kept)
    assert one(repeats.suggestions(mixed, events))["text"] == SHORT


def test_prompt_rows_are_counted_not_events(spark):
    prompts, events = store(spark, [(SHORT, "p", 4)])
    twice = prompts.unionByName(prompts.withColumn("seq", F.lit(7).cast("long")))
    assert one(repeats.suggestions(twice, events))["count"] == 2


def test_order_is_total(spark):
    sent = [(text, "p", day) for text, day in [("a", 4), ("b", 5), ("c", 4)] for _ in range(2)]
    found = rows_of(repeats.suggestions(*store(spark, sent)))
    assert found[0]["text"] == "b"
    assert [row["id"] for row in found[1:]] == sorted(row["id"] for row in found[1:])


def test_drafts(spark):
    groups = repeats.suggestions(*store(spark, SENT))
    drafts = rows_of(repeats.with_drafts(groups, NOW))
    long = drafts[1]["draft"]
    assert long.startswith("---\nname: go-through-open-questions\n")
    assert "2 times, last 10d ago" in long and f"```\n{LONG}\n```" in long
    assert drafts[1]["id"] in long and drafts[1]["text_hash"] in long
    assert "name: bump-version\n" in drafts[0]["draft"]
    assert "Projects: mill, quay." in drafts[0]["draft"]


def test_lookup_needs_exactly_one_group(spark):
    groups = repeats.suggestions(*store(spark, SENT))
    first, second = rows_of(groups)
    assert one(repeats.lookup(groups, f" {first['id']} "))["text"] == SHORT
    assert one(repeats.lookup(groups, second["text_hash"][:12]))["text"] == LONG
    assert SHORT in repeats.draft_of(groups, first["text_hash"], NOW)
    for wrong in ("no-such-id", ""):
        with pytest.raises(ValueError):
            repeats.draft_of(groups, wrong, NOW)


def test_a_prompt_that_makes_up_most_rows(spark):
    sent = [(SHORT, f"p{n % 7}", 1 + n % 20) for n in range(600)]
    sent += [(f"text {n % 250}", None if n % 3 else "q", 2) for n in range(700)]
    expected = defaultdict(lambda: [0, 0, set()])
    for text, project, day in sent:
        group = expected[text]
        group[0] += 1
        group[1] = max(group[1], at(day))
        group[2] |= {project} - {None}
    found = rows_of(repeats.suggestions(*store(spark, sent)))
    assert {row["text"]: [row["count"], row["last_ts"], set(row["projects"])] for row in found} == {
        text: group for text, group in expected.items() if group[0] > 1
    }
