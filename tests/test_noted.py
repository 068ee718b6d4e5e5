"""Reports with notes, from one scan."""

import pytest
from conftest import AUG, DAY, rows_of
from pyspark.sql import functions as F
from test_store import stored_line, write_lines
from test_sums import add, prices, some_events  # noqa: F401

from turnledger.functions.clock import Window
from turnledger.operators.scope import Scope
from turnledger.plans import notes, reports
from turnledger.plans.noted import noted
from turnledger.sources import store as stores
from turnledger.sources import totals

SCOPES = [Scope(), Scope(include_sidechain=False), Scope(Window(AUG - 9 * DAY, AUG + 3 * DAY), "p1")]


@pytest.mark.parametrize("scope", SCOPES)
def test_notes_come_with_the_report(spark, folder, prices, scope):  # noqa: F811
    events = some_events(spark)
    expected = rows_of(notes.scan_notes(events, prices, scope))
    totals.recover(spark, folder)
    add(events, folder)
    for rows in (events, totals.read_sums(spark, folder)):
        for build in (reports.projects, reports.models, reports.summary):
            found = noted(build, rows, prices, scope)
            assert rows_of(found.report) == rows_of(build(events, prices, scope))
            assert rows_of(found.notes()) == expected


def test_how_many_lie_behind_those_shown(spark, prices):  # noqa: F811
    events = some_events(spark)
    found = noted(reports.sessions, events, prices, limited=True, limit=2)
    assert rows_of(found.report) == rows_of(reports.sessions(events, prices, limit=2))
    assert found.groups() == 4
    with pytest.raises(ValueError):
        noted(reports.projects, events, prices).groups()


def test_one_scan_for_both(spark, folder, prices):  # noqa: F811
    stores.append_events(some_events(spark), folder)
    found = noted(reports.projects, stores.read_events(spark, folder), prices)
    plan = found.report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "CollectMetrics" in plan


def test_skipped_lines_of_a_json_store(spark, folder, prices):  # noqa: F811
    lines = [stored_line("a", AUG, project="p"), "{torn", stored_line("b", AUG + 1), '{"v":1}']
    write_lines(folder, "events/2026-08.jsonl", lines)
    found = noted(reports.projects, stores.read_event_lines(spark, folder, month_files=True), prices)
    assert sum(r["requests"] for r in rows_of(found.report)) == 0
    (row,) = rows_of(found.notes())
    assert (row["events"], row["lines_skipped"]) == (2, 2)
    assert rows_of(noted(reports.projects, some_events(spark).where(F.lit(False)), prices).report) == []
