"""Stored sums against the events they stand for."""

import os

import pytest
from conftest import AUG, DAY, HOUR, at, event, events_frame, rows_of, used
from pyspark.sql import functions as F

from turnledger.functions.clock import Window, month_of
from turnledger.operators.pricing import price_table
from turnledger.operators.scope import Scope
from turnledger.plans import notes, reports
from turnledger.sources import store as stores
from turnledger.sources import totals


@pytest.fixture
def prices(spark):
    return price_table(spark, [("anthropic", "big", 3.0, 15.0, 0.3, None)])


def some_events(spark):
    rows = []
    for n in range(90):
        ts = AUG - 20 * DAY + n * 11 * HOUR
        if n % 7 == 0:
            rows.append(event(f"e{n}", ts, session_id=f"s{n % 4}", project="p", duration_ms=n))
        else:
            rows.append(
                used(f"e{n}", ts, f"p{n % 3}" if n % 5 else None, ["big", "small", None, "<synthetic>"][n % 4],
                     None if n % 2 else n, 0 if n % 2 else 7, session_id=f"s{n % 4}" if n % 6 else None,
                     is_sidechain=[True, False, None][n % 3], cost_est=0.25 if n % 8 == 1 else None)
            )
    return events_frame(spark, rows).withColumn("month", month_of(F.col("ts")))


def add(events, store, batch=None):
    """As a run does it."""
    batch = totals.announced(events, store) if batch is None else batch
    stores.append_events(events, store)
    totals.extend(events, store, batch)


REPORTS = [reports.summary, reports.projects, reports.models, reports.sessions, reports.query, notes.scan_notes]


def same_reports(spark, store, events, prices, scope=Scope()):
    for build in REPORTS:
        options = {"group_by": ["agent", "day", "role", "session"]} if build is reports.query else {}
        sums = totals.read_sums(spark, store, scope.window)
        got = rows_of(build(sums, prices, scope=scope, **options))
        expected = rows_of(build(events, prices, scope=scope, **options))
        assert got == expected, build.__name__


def opened(df):
    return [path for path in df.inputFiles() if "/events/" in path]


def test_reports_from_sums_of_several_batches(spark, folder, prices):
    events = some_events(spark)
    totals.recover(spark, folder)
    for rest in range(3):
        add(events.where(F.col("seq") % 3 == rest), folder)
    same_reports(spark, folder, events, prices)
    same_reports(spark, folder, events, prices, Scope(include_sidechain=False))
    same_reports(spark, folder, events, prices, Scope(project="p1"))
    # No event file is opened.
    assert opened(totals.read_sums(spark, folder)) == []


@pytest.mark.parametrize(
    "window",
    [Window(AUG - 3 * DAY, AUG + 2 * DAY), Window(AUG - 3 * DAY + 5, AUG + 2 * DAY + HOUR), Window(AUG + HOUR, AUG + 2 * HOUR),
     Window(AUG + HOUR, AUG + DAY + HOUR), Window(None, AUG + 1), Window(AUG - 1, None), Window(AUG, AUG)],
)
def test_periods_that_begin_and_end_within_a_day(spark, folder, prices, window):
    events = some_events(spark)
    totals.recover(spark, folder)
    add(events, folder)
    scope = Scope(window)
    assert rows_of(reports.query(totals.read_sums(spark, folder, window), prices, ["day", "model"], scope)) == rows_of(
        reports.query(events, prices, ["day", "model"], scope)
    )


def test_a_run_that_died_between_events_and_sums(spark, folder, prices):
    events = some_events(spark)
    totals.recover(spark, folder)
    add(events.where("seq < 40"), folder)
    late = events.where("seq >= 40")
    totals.announced(late, folder)
    stores.append_events(late, folder)
    # A reader sums the open months itself and writes nothing.
    same_reports(spark, folder, events, prices)
    files = sum(len(names) for _, _, names in os.walk(folder))
    assert opened(totals.read_sums(spark, folder))
    assert sum(len(names) for _, _, names in os.walk(folder)) == files
    totals.recover(spark, folder)
    same_reports(spark, folder, events, prices)
    assert opened(totals.read_sums(spark, folder)) == []


def test_a_run_that_died_before_its_events_or_amid_its_sums(spark, folder, prices):
    events = some_events(spark)
    totals.recover(spark, folder)
    add(events.where("seq < 40"), folder)
    totals.announced(events.where("seq >= 40"), folder)
    totals.recover(spark, folder)
    late = events.where("seq >= 40")
    batch = totals.announced(late, folder)
    stores.append_events(late, folder)
    totals._write(totals.partial_totals(late.where("seq < 60"), "month"), folder, batch)
    same_reports(spark, folder, events, prices)
    totals.recover(spark, folder)
    same_reports(spark, folder, events, prices)


def test_many_batches_are_added_up(spark, folder, prices):
    events = some_events(spark)
    totals.recover(spark, folder)
    for rest in range(5):
        add(events.where(F.floor(F.col("seq") / 18) == rest), folder)
    before = len([p for p in totals.read_sums(spark, folder).inputFiles() if "/sums/" in p])
    totals.recover(spark, folder, many=2)
    after = len([p for p in totals.read_sums(spark, folder).inputFiles() if "/sums/" in p])
    assert after < before
    same_reports(spark, folder, events, prices)
    more = events.where("seq < 5").withColumns({"seq": F.col("seq") + 100, "id": F.concat(F.lit("x"), "id")})
    add(more, folder)
    same_reports(spark, folder, events.union(more), prices)


def test_a_store_without_sums(spark, folder, prices):
    events = some_events(spark)
    stores.append_events(events, folder)
    same_reports(spark, folder, events, prices)
    totals.recover(spark, folder)
    assert opened(totals.read_sums(spark, folder)) == []
    same_reports(spark, folder, events, prices)
    assert totals.read_sums(spark, f"{folder}/nowhere").count() == 0
