"""Which stored events a report looks at."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnledger.functions.clock import Window
from turnledger.functions.usage import is_sidechain


@dataclass(frozen=True)
class Scope:
    """The period, the project and whether sidechain events take part."""

    window: Window = field(default_factory=Window)
    project: str | None = None
    include_sidechain: bool = True


def in_window(rows: DataFrame, window: Window) -> DataFrame:
    """Rows of the period. Prunes month folders where the table has them."""
    if "month" in rows.columns:
        rows = rows.where(window.months(F.col("month")))
    return rows.where(window.holds(F.col("ts")))


def of_project(rows: DataFrame, project: str | None) -> DataFrame:
    """Exact match; a row without a project belongs to none."""
    return rows if project is None else rows.where(F.col("project") == project)


def located(events: DataFrame, scope: Scope) -> DataFrame:
    """Period and project only, for questions that take every event."""
    return of_project(in_window(events, scope.window), scope.project)


def scanned(events: DataFrame, scope: Scope) -> DataFrame:
    """Everything a report counts."""
    rows = located(events, scope)
    return rows if scope.include_sidechain else rows.where(~is_sidechain())
