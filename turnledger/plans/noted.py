"""A report and what its reader must know, from one scan.

The notes are observed while the events pass on their way into the report, so they are
there once the report has been run, and nothing is read for them again.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from turnledger.fixed_values import UNKNOWN_MODEL
from turnledger.functions.usage import has_usage, is_sidechain, is_synthetic
from turnledger.operators.scope import Scope, located
from turnledger.operators.totals import is_summed


@dataclass(frozen=True)
class Noted:
    """``report`` is to be run, once; the rest is known after that."""

    report: DataFrame
    prices: DataFrame
    _scan: Observation
    _lines: Observation | None
    _groups: Observation | None

    def notes(self) -> DataFrame:
        """The row of :func:`turnledger.plans.notes.scan_notes`."""
        spark, seen = self.report.sparkSession, self._scan.get
        named = [row.asDict() for row in seen["unpriced"]]
        asked = spark.createDataFrame(
            [(row["provider"], row["model"]) for row in named], "provider string, model string"
        )
        # Without a model there is no price; the price list is joined with a row per model.
        missing = asked.join(self.prices, ["provider", "model"], "left_anti")
        models = missing.select(F.coalesce("model", F.lit(UNKNOWN_MODEL)).alias("model"))
        counts = ("events", "requests", "sidechain_events", "synthetic_events")
        skipped = 0 if self._lines is None else self._lines.get["lines_skipped"]
        return models.agg(F.sort_array(F.collect_set("model")).alias("unpriced_models")).select(
            *[F.lit(seen[name] or 0).cast("long").alias(name) for name in counts],
            "unpriced_models",
            F.lit(skipped).cast("long").alias("lines_skipped"),
        )

    def groups(self) -> int:
        """How many groups lie behind those a limited report shows."""
        if self._groups is None:
            raise ValueError("this report shows all of its groups")
        return self._groups.get["groups"]


def noted(
    build: Callable[..., DataFrame],
    events: DataFrame,
    prices: DataFrame,
    scope: Scope = Scope(),
    limited: bool = False,
    **options,
) -> Noted:
    """A report of :mod:`turnledger.plans.reports` with its notes.

    ``events`` may be events, sums of them, or the lines of a JSON store, whose unusable
    ones are counted; ``limited`` reports take an observation of their groups.
    """
    lines = None
    if "usable" in events.columns:
        lines = Observation()
        events = events.observe(lines, F.count_if(~F.col("usable")).alias("lines_skipped"))
        events = events.where("usable").drop("usable")
    rows = located(events, scope)
    summed = is_summed(rows)
    included = F.lit(True) if scope.include_sidechain else ~is_sidechain()
    used = included & has_usage()

    def count(name: str, condition):
        return F.sum(F.when(condition, F.col(name))) if summed else F.count_if(condition)

    # A request has no price if it names no model, or if neither the list nor the store
    # has one; which models the list has is looked up afterwards.
    stored = F.col("stored_priced") >= F.col("requests") if summed else F.col("cost_est").isNotNull()
    open_ = used & ~is_synthetic() & (F.col("model").isNull() | ~stored)
    scan = Observation()
    rows = rows.observe(
        scan,
        count("events", included).alias("events"),
        count("requests", used).alias("requests"),
        count("events", is_sidechain()).alias("sidechain_events"),
        count("requests", used & is_synthetic()).alias("synthetic_events"),
        F.collect_set(F.when(open_, F.struct("provider", "model"))).alias("unpriced"),
    )
    groups = Observation() if limited else None
    if limited:
        options = options | {"observed": groups}
    # Period and project are applied already, before what is observed.
    report = build(rows, prices, scope=Scope(include_sidechain=scope.include_sidechain), **options)
    return Noted(report, prices, scan, lines, groups)
